from __future__ import annotations

from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import tokens as t

PIECES = ["a", "é", " ", "  ", "\n", "\t", "1", "²", "!", "…", "漢字", "　", "‍", "👩‍💻", "'s", "'", "x'll", " the", "́", "\x1c", " ", "\x85", "<|endoftext|>", "ß"]
ENCODE = t.encoder(t.default_ranks()).encode_ordinary


def pieces_of(text: str) -> list[str]:
    ends = dict(t.cuts([text])).get(0, [])
    return [text[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=bool(ends))]


def whole(text: str) -> list[int]:
    """As token_ids puts it together, with every, every second and no chunk in the dictionary."""
    pieces = pieces_of(text)
    assert "".join(pieces) == text and all(0 < len(p) <= t.MAX_CHUNK for p in pieces)
    ends = dict(t.cuts([text])).get(0, [])
    results = [t.assembled(text, ends, {p: ENCODE(p) for p in pieces[k::step]}, ENCODE) for k, step in ((0, 1), (0, 2), (1, 2), (len(pieces), 1))]
    assert all(r == results[0] for r in results)
    return results[0]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=400).map("".join))
def test_equal_to_encoding_the_whole(text):
    assert whole(text) == ENCODE(text)


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=300))
def test_any_text(text):
    text = text.encode("utf-8", "ignore").decode()
    assert whole(text) == ENCODE(text)


def test_long_runs():
    for text in ("a" * 20_000, " " * 9000, "漢字" * 5000, "ab " * 6000, "x" * 5000 + " " * 5000 + "\n" * 5000):
        assert whole(text) == ENCODE(text)


def test_equal_passages_are_cut_alike():
    passage = " ".join(f"word{i % 37} and more" for i in range(400))
    a, b = "Some other beginning. " + passage, "X" * 91 + " " + passage
    pa, pb = set(pieces_of(a)), set(pieces_of(b))
    assert len(pa & pb) >= 0.7 * len(pa)


def test_texts_are_cut_alike_in_any_company():
    texts = ["Some text. " * 40, "", "x", "漢字 and more " * 90, " ".join(str(i) for i in range(900))]
    assert dict(t.cuts(texts)) == {i: e for i, x in enumerate(texts) for _, e in t.cuts([x])}
    hashes, counts, kinds = t._chunk_counts([x for x in texts for _ in range(2)])
    assert len(set(hashes)) == len(set(kinds)) == len(kinds) and min(counts) == 2 and sum(len(k) * c for k, c in zip(kinds, counts, strict=True)) == 2 * sum(map(len, texts))


def test_the_dictionary_is_bounded_and_holds_recurring_chunks_only(spark, monkeypatch):
    shared = [" ".join(f"word{(i * k) % 97} and more" for i in range(200)) for k in (3, 5)]
    rows = [(i, f"Beginning {i}. " + shared[i % 2]) for i in range(8)] + [(100, "Nothing like it stands anywhere else in these few texts, not once.")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    known = t.dictionary(df, "text", t.default_ranks())
    assert known and all(ids == ENCODE(c) and sum(x.count(c) for _, x in rows) > 1 for c, ids in known.items())
    monkeypatch.setattr(t, "DICTIONARY_CHARS", 500)
    few = t.dictionary(df, "text", t.default_ranks())
    assert 0 < len(few) < len(known) and sum(map(len, few)) <= 500
    assert {r.doc_id: list(r.ids) for r in t.token_ids(df).collect()} == {i: ENCODE(x) for i, x in rows}


def test_in_spark_against_the_other_library(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    rows = [(1, "Hello  world\n\n again"), (2, ""), (3, None), (4, "a" * 9000), (5, "<|endoftext|> is text"), (6, "漢字 emoji 👩‍💻 " * 800), (6, "Hello  world\n\n again"), (None, "no id")] + [(100 + i, "shared boilerplate words " * 40) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 AS row", "2 AS key", "3 AS ids")
    got = sorted(((r.doc_id, list(r.ids)) for r in t.token_ids(df).collect()), key=str)
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tok.encode_special_tokens = True
    want = sorted(((i, tok.encode(x or "", add_special_tokens=False).ids) for i, x in rows), key=str)
    assert got == want
