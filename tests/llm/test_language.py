from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
import regex
from pyspark.sql import functions as F

from tidemark.llm import language as lang

SF = "/root/testdata/sf0.01"
P = lang.Params(sample_docs=600, sample_sentences=4000)
#: One function word after another says the language of the generator's sentences well enough.
STOP = {
    "en": {"the", "of", "and", "was", "that", "to"}, "de": {"der", "die", "das", "und", "auf", "den", "nicht", "zum"}, "fr": {"le", "les", "du", "une", "nous", "sur", "pour", "à"},
    "es": {"el", "los", "una", "hemos", "y", "por", "del"}, "pt": {"o", "os", "uma", "não", "da", "do", "em", "pela"}, "nl": {"het", "een", "van", "op", "niet", "voor"},
}


@pytest.fixture(scope="module")
def fitted(spark):
    proto = lang.fit(spark.read.parquet(f"{SF}/documents.parquet"), p=P)
    return proto, lang.gram_table(proto, P)


def test_held_out_accuracy(fitted):
    _, table = fitted
    d = pd.read_parquet("/root/testdata/sf0.1/documents.parquet").head(1500)
    right = wrong = 0
    texts = list(d.text.dropna())
    for text, found in zip(texts, lang.classify(texts, table, P), strict=True):
        for a, b, k, _ in found:
            w = regex.findall(r"\p{L}+", text[a:b].lower())
            n = {c: sum(x in s for x in w) for c, s in STOP.items()}
            best = max(n.values())
            if best >= 3 and sum(v == best for v in n.values()) == 1:
                right += n[lang.LANGUAGES[k]] == best
                wrong += n[lang.LANGUAGES[k]] != best
    assert right > 3000 and wrong / (right + wrong) < 0.01


def test_segments_of_a_mixed_text(fitted, spark):
    proto, table = fitted
    de = "Der Karteninhaber bestätigte die strittige Reisebuchung trotz der früheren Freigabe."
    en = "The cardholder could not confirm the travel booking despite the earlier approval."
    rows = [(1, f"{de} {de}\n\n> {en}\n> {en}\n{de}", "de"), (2, en, "EN-gb "), (3, en, None), (4, "", "en"), (5, None, "en"), (6, "ee4c358f c95fb6f3 76263660 4495f044 9208f167 9d1f31ba 2772c9ed", "en"), (7, f"{en} “Guten Tag” {en}", "en"), (8, "Dear team,\nthanks.", "en"), (2, en, "xx"), (9, (en + " ") * 700, "en")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").withColumns({"seg": F.lit(0), "label": F.lit("clash"), "confidence": F.lit(1)})
    got = lang.segments(df, proto, p=P).collect()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append((r.seg, r.lang))
    assert by[1] == [(1, "de"), (2, "en"), (3, "de")]
    assert by[2] == [(1, "en"), (1, "en")] and by[3] == by[7] == by[9] == [(1, "en")]
    assert by[4] == by[5] == by[6] == by[8] == [(None, None)]
    assert all(0.5 <= r.confidence <= 1 for r in got if r.seg)
    docs = {(r.doc_id, r.label): (r.lang, r.n_langs) for r in lang.document_languages(lang.segments(df, proto, p=P)).collect()}
    assert docs[1, "de"] == ("de", 2) and docs[4, "en"] == (None, 0)


def test_labels(spark):
    names = ["en", " EN ", "en-GB", "pt_BR", "English", "deu", "ger", "Dutch", "", " ", None, "xx", "unknown", "en GB", "it", "FR-ca"]
    df = spark.createDataFrame([(n,) for n in names], "l string")
    assert [r[0] for r in df.select(lang.label_code(F.col("l"))).collect()] == ["en", "en", "en", "pt", "en", "de", "de", "nl", None, None, None, None, None, None, None, "fr"]


def test_tables_give_what_plain_bundling_gives(fitted):
    """Every counted sentence's vector made, and compared with the prototypes by its true length."""
    proto, table = fitted
    space = lang.Space.of(P.dim, P.seed)
    texts = [s for t in pd.read_parquet(f"{SF}/documents.parquet").text.dropna() for _, _, s in lang.sentences(t) if lang.words(s) >= P.least_words]
    texts += ["zq xw vv kk qq jj", "Ночью рыбаки вернулись домой с пустыми сетями", "", "а" * 30, "e " * 9000]
    best, confidence = lang.judge(texts, table, P)
    for t, b, c in zip(texts, best, confidence, strict=True):
        codes, _ = lang.grams([t])
        vector = space.bundle(codes)
        cos = proto.astype(float) @ vector / max(np.linalg.norm(vector), 1)
        top = np.sort(cos)
        if len(codes) and top[-1] >= P.least_cosine:
            assert b == cos.argmax() and abs(c - (0.5 + 0.5 * min(1, (top[-1] - top[-2]) / top[-1]))) < 1e-4
        else:
            assert (b, c) == (-1, 0)


def spelt(text):
    return lang.grams([text])[0].tolist()


def test_letters_and_words():
    assert spelt("Ça—va?") == spelt("ca va") == spelt("ÇA  VA") == spelt(" c\u0327a, va ")
    assert spelt("Дом") == spelt("дом") != spelt("дам") and spelt("--- 12") == [] and len(spelt("ab")) == 2
    codes, owners = lang.grams(["ab", "", " - ", "c d"])
    assert owners.tolist() == [0, 0, 3, 3, 3] and codes.tolist() == spelt("ab") + spelt("c d")
    assert lang.words("one two three four five six") == 6 and lang.words("ee4c358f c95fb6f3 one") == 0


def test_a_rare_language_has_its_share_of_the_sample(spark):
    en = ["The cardholder could not confirm the travel booking despite the earlier approval.", "Nobody on the team documented the three declined payments until further notice."]
    de = ["Der Karteninhaber konnte die Reisebuchung trotz der früheren Freigabe nicht bestätigen.", "Niemand im Team dokumentierte die drei abgelehnten Zahlungen bis auf Weiteres."]
    rows = [(i, en[i % 2], "en") for i in range(3000)] + [(3000 + i, de[i % 2], "de") for i in range(3)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    proto = lang.fit(df, p=lang.Params(sample_docs=60))
    got = {r.doc_id: r.lang for r in lang.segments(df, proto).collect()}
    assert got[0] == got[1] == "en" and got[3000] == got[3001] == "de"


def test_no_training_rows(spark):
    none = spark.createDataFrame([], "doc_id bigint, text string, lang string")
    proto = lang.fit(none, p=P)
    some = spark.createDataFrame([(1, "The cardholder could not confirm the travel booking despite the approval.", "en")], none.schema)
    assert [r.seg for r in lang.segments(some, proto, p=P).collect()] == [None]
