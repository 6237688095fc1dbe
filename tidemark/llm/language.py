"""Language of documents and of each segment of mixed ones, by hyperdimensional profiles.

Each letter is a fixed random vector of +1 and -1. An n-gram's vector binds its letters' vectors,
permuted by their position (a rotation), by multiplication; a text's vector bundles, that is adds,
those of its n-grams. A language's prototype bundles the sentences of a bounded sample of labelled
documents, drawn language by language, less what all prototypes share, and is then retrained on them. A
sentence goes to the prototype of the highest cosine.

Products are linear, so a sentence's product with a prototype is the sum of its n-grams' products, which are
tabulated: the same number without making the sentence's vector. The vector's length only decides whether
the best cosine reaches the least one; it is estimated from the n-grams' counts, and where that leaves any
doubt the vector is made and measured.

Sentences of six words or more speak for a language, if they consist mostly of words and lie near some
prototype; shorter ones, names, codes and machine output count for none. A segment is a longest run of
consecutive counted sentences in one language.

Everything but the fit works row by row on whole texts: one pass, no shuffle.

Defined cases: a null, empty or wordless text has no segment, and as a document the language null with
confidence 0; a null label names no language; equal cosines go to the first code in byte order;
repeated rows give repeated results; an empty table gives none.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LANGUAGES = ("de", "en", "es", "fr", "nl", "pt")
#: The two-letter code, the three-letter codes and the English name of each language.
NAMES = {
    "de": ("de", "deu", "ger", "german"),
    "en": ("en", "eng", "english"),
    "es": ("es", "spa", "spanish"),
    "fr": ("fr", "fra", "fre", "french"),
    "nl": ("nl", "nld", "dut", "dutch"),
    "pt": ("pt", "por", "portuguese"),
}


@dataclass(frozen=True)
class Params:
    """dim: length of the vectors; sample_docs, sample_chars and sample_sentences bound the labelled sample
    that the prototypes are fitted on: about that many documents, an equal share of each language's, each of at
    most that many characters, and that many of their sentences, again in equal shares. least_cosine: a text
    that has nothing to do with a prototype has a cosine of 0 with a spread of 1 / sqrt(dim), here 0.022."""

    dim: int = 2048
    seed: int = 20270901
    sample_docs: int = 2000
    sample_chars: int = 4000
    sample_sentences: int = 12_000
    least_words: int = 6
    rounds: int = 40
    rate: float = 2.0
    momentum: float = 0.9
    sharpness: float = 12.0
    least_cosine: float = 0.06
    languages: tuple[str, ...] = field(default=LANGUAGES)


#: Symbols: a blank for whatever is no letter, a to z, and OTHERS that all other letters share by code point.
OTHERS = 13
_N = 27 + OTHERS
_DROP, _END = 255, 254
#: Characters of sentences that are looked at together.
_BLOCK = 250_000
_BREAK = regex.compile(r"(?<=[.!?…])[\"'”’»)\]*_]*\s+|\r?\n|\r|</?\w+[^<>]{0,80}>|\|")
_CONTINUES = regex.compile(r"[\s>*_-]*(?:\p{Ll}|\p{N})")
_LEAD = regex.compile(r"^[\s>*_#-]*(?:\[\d{1,2}:\d{2}\]\s*\p{Lu}:|\d{1,3}[.)](?=\s))?")
_WORD = regex.compile(r"^[\p{P}\p{S}\p{Cf}]*\p{L}[\p{L}\p{M}\p{Cf}]*(?:['’‑.-][\p{L}\p{M}]+)*[\p{P}\p{S}\p{Cf}]*$")


def sentences(text: str) -> list[tuple[int, int, str]]:
    """(start, end, sentence) over the whole text. A line end parts sentences unless the next line goes on
    in lower case; markup, list and chat marks are left out."""
    out: list[tuple[int, int, str]] = []
    at, start, held = 0, 0, ""
    for m in _BREAK.finditer(text):
        piece = text[at : m.start()]
        line_end = m.group().strip() == "" and ("\n" in m.group() or "\r" in m.group()) and not piece.rstrip().endswith((".", "!", "?", "…"))
        held, start = (held + " " + _LEAD.sub("", piece), start) if held else (_LEAD.sub("", piece), at)
        at = m.end()
        if line_end and piece.strip() and _CONTINUES.match(text, at, at + 40):
            continue
        if held.strip():
            out.append((start, m.start(), held.strip()))
        held = ""
    piece = text[at:]
    held, start = (held + " " + _LEAD.sub("", piece), start) if held else (_LEAD.sub("", piece), at)
    if held.strip():
        out.append((start, len(text), held.strip()))
    return out


def words(sentence: str) -> int:
    """Words of letters, unless they are fewer than half of the tokens."""
    tokens = sentence.split()
    n = sum(1 for t in tokens if t.isalpha() or _WORD.match(t))
    return n if n * 2 >= len(tokens) else 0


@lru_cache(maxsize=1)
def _symbols() -> np.ndarray:
    """Each code point's symbol, after decomposition and case folding."""
    out = np.zeros(0x110000, np.uint8)
    for c in range(0x80, 0x110000):
        kind = unicodedata.category(chr(c))
        if kind[0] == "L":
            out[c] = 27 + c % OTHERS
        elif kind == "Mn":
            out[c] = _DROP
    for i in range(26):
        out[97 + i] = out[65 + i] = 1 + i
    out[10] = _END
    return out


def grams(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """(codes, owners): the numbers of all n-grams of three symbols in the texts, accents dropped, runs of anything
    but letters as one blank, each text between two blanks; and the text that each belongs to, in order."""
    whole = "\n".join(texts)
    if not whole.isascii():
        whole = unicodedata.normalize("NFKD", whole).casefold()
    s = _symbols()[np.frombuffer(whole.encode("utf-32-le", "replace"), np.uint32)]
    s = np.concatenate(([_END], s[s != _DROP], [_END])).astype(np.uint8)
    blank = (s == 0) | (s == _END)
    s = s[np.concatenate(([True], ~((s[1:] == 0) & blank[:-1])))]
    s = s[np.concatenate((~((s[:-1] == 0) & (s[1:] == _END)), [True]))]
    end = s == _END
    owners, v = np.cumsum(end) - 1, np.where(end, 0, s).astype(np.int32)
    codes, inside = (v[:-2] * _N + v[1:-1]) * _N + v[2:], ~end[1:-1]
    return codes[inside], owners[1:-1][inside]


def _counted(texts: Sequence[str]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, last, codes, owners) of blocks of the texts, so that memory is bounded."""
    first, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= _BLOCK or i == len(texts) - 1:
            yield first, i + 1, *grams(texts[first : i + 1])
            first, size = i + 1, 0


def _sums(values: np.ndarray, owners: np.ndarray, n: int) -> np.ndarray:
    """The sums of the values' rows by owner (owners in order)."""
    out = np.zeros((n, values.shape[1]), values.dtype)
    if len(owners):
        starts = np.flatnonzero(np.concatenate(([True], owners[1:] != owners[:-1])))
        out[owners[starts]] = np.add.reduceat(values, starts, axis=0)
    return out


class Space:
    """The letters' vectors, rotated for the first and the second place of an n-gram, and what is bound of them."""

    def __init__(self, dim: int, seed: int):
        rng = np.random.default_rng(seed)
        self.third = rng.choice(np.array([-1, 1], dtype=np.int8), size=(_N, dim))
        self.first, self.second = np.roll(self.third, 2, axis=1), np.roll(self.third, 1, axis=1)

    @staticmethod
    @lru_cache(maxsize=2)
    def of(dim: int, seed: int) -> Space:
        return Space(dim, seed)

    def bound(self, codes: np.ndarray) -> np.ndarray:
        return self.first[codes // (_N * _N)] * self.second[codes // _N % _N] * self.third[codes % _N]

    def bundle(self, codes: np.ndarray) -> np.ndarray:
        """The sum of the n-grams' vectors. A long sentence is added up in blocks, so memory stays bounded."""
        total = np.zeros(self.third.shape[1], np.int64)
        for i in range(0, len(codes), 4096):
            total += self.bound(codes[i : i + 4096]).sum(axis=0, dtype=np.int32)
        return total

    def products(self, proto: np.ndarray) -> np.ndarray:
        """(n-grams, languages): each n-gram vector's product with each prototype."""
        pairs = (self.first[:, None, :] * self.second[None, :, :]).reshape(_N * _N, -1).astype(np.float32)
        out = np.empty((_N * _N, _N, len(proto)))
        for k in range(_N):
            out[:, k] = pairs @ (proto * self.third[k]).T
        return out.reshape(_N**3, len(proto))


def prototypes(rows: list[tuple[str, str]], p: Params) -> np.ndarray:
    """(languages, dim) of unit length from (language, text).

    Sentences are bundled by their document's label. Sentences that then lie nearer to another language
    by a clear lead are taken for wrong labels or foreign passages and left out. On the rest the
    prototypes are retrained: in each round every sentence is added to its own language's prototype and
    taken from the others' in proportion to how near it lies to them, rounds gaining momentum."""
    space, k = Space.of(p.dim, p.seed), len(p.languages)
    index, room = {code: i for i, code in enumerate(p.languages)}, {code: p.sample_sentences // k for code in p.languages}
    texts, said = [], []
    for code, text in rows:
        for _, _, s in sentences(text):
            if room[code] > 0 and words(s) >= p.least_words:
                texts.append(s)
                said.append(index[code])
                room[code] -= 1
    x = np.zeros((len(texts), p.dim), np.float32)
    for first, last, codes, owners in _counted(texts):
        cut = np.searchsorted(owners, np.arange(last - first + 1))
        for i in range(last - first):
            x[first + i] = space.bundle(codes[cut[i] : cut[i + 1]])
    length = np.linalg.norm(x, axis=1)
    x, y = x[length > 0] / length[length > 0, None], np.array(said, int)[length > 0]
    if not len(y):
        return np.zeros((k, p.dim), np.float32)
    proto = _centred(x, y, k)
    for _ in range(2):
        cos = x @ proto.T
        clear = cos.max(axis=1) - cos[np.arange(len(y)), y] > 0.15
        proto = _centred(x[~clear], y[~clear], k)
    x, y = x[~clear], y[~clear]
    there = np.isin(np.arange(k), y)
    own, pace = np.eye(k, dtype=np.float32)[y], np.zeros_like(proto)
    for _ in range(p.rounds):
        near = (x @ proto.T) * p.sharpness
        near[:, ~there] = -np.inf
        near = np.exp(near - near.max(axis=1, keepdims=True))
        near /= near.sum(axis=1, keepdims=True)
        pace = p.momentum * pace + (p.rate / len(y)) * ((own - near).T @ x)
        proto = proto + pace
        proto[there] /= np.linalg.norm(proto[there], axis=1, keepdims=True)
        proto[~there] = 0
    return proto.astype(np.float32)


def _centred(x: np.ndarray, y: np.ndarray, k: int) -> np.ndarray:
    proto = np.zeros((k, x.shape[1]), np.float32)
    there = np.isin(np.arange(k), y)
    for i in np.flatnonzero(there):
        m = x[y == i].mean(axis=0)
        proto[i] = m / (np.linalg.norm(m) or 1)
    if there.sum() > 1:
        proto[there] -= proto[there].mean(axis=0)
        proto[there] /= np.linalg.norm(proto[there], axis=1, keepdims=True)
    return proto


def gram_table(proto: np.ndarray, p: Params) -> np.ndarray:
    """Each n-gram's product with each prototype."""
    return Space.of(p.dim, p.seed).products(proto)


def judge(texts: Sequence[str], table: np.ndarray, p: Params) -> tuple[np.ndarray, np.ndarray]:
    """For each sentence the number of its language, -1 for none, and the confidence: from 0.5, as near to
    another language, to 1, no nearer to any other than a random text."""
    best, confidence = np.full(len(texts), -1), np.zeros(len(texts))
    for first, last, codes, owners in _counted(texts):
        n = last - first
        dots = _sums(table[codes], owners, n)
        # Were n-grams' vectors at right angles, a bundle's squared length would be dim x the sum of squared counts.
        each, times = np.unique(owners * np.int64(_N**3) + codes, return_counts=True)
        length = np.sqrt(p.dim * np.bincount(each // _N**3, weights=times.astype(float) ** 2, minlength=n))
        cos = dots.max(axis=1) / np.maximum(length, 1)
        doubt = np.flatnonzero((length > 0) & (np.abs(np.log(np.maximum(cos, 1e-9) / p.least_cosine)) < np.log(2)))
        for i in doubt:
            own = codes[np.searchsorted(owners, i) : np.searchsorted(owners, i + 1)]
            cos[i] = dots[i].max() / max(np.linalg.norm(Space.of(p.dim, p.seed).bundle(own)), 1)
        top = np.sort(dots, axis=1)
        lead = top[:, -1] - top[:, -2] if dots.shape[1] > 1 else top[:, -1]
        good = (length > 0) & (cos >= p.least_cosine)
        best[first:last] = np.where(good, dots.argmax(axis=1), -1)
        confidence[first:last] = np.where(good, 0.5 + 0.5 * np.minimum(1.0, lead / np.where(good, top[:, -1], 1)), 0)
    return best, confidence


def classify(texts: Sequence[str | None], table: np.ndarray, p: Params) -> list[list[tuple[int, int, int, float]]]:
    """For each text (start, end, language number, confidence) of its counted sentences."""
    out: list[list] = [[] for _ in texts]
    places, said = [], []
    for k, t in enumerate(texts):
        for a, b, s in sentences(t) if isinstance(t, str) else ():
            if words(s) >= p.least_words:
                places.append((k, a, b))
                said.append(s)
    best, confidence = judge(said, table, p)
    for (k, a, b), i, c in zip(places, best.tolist(), confidence.tolist(), strict=True):
        if i >= 0:
            out[k].append((a, b, i, c))
    return out


def label_code(label: Column, languages: tuple[str, ...] = LANGUAGES) -> Column:
    """The two-letter code that a label names, in any case and with or without a region; else null."""
    head = F.regexp_extract(F.lower(F.regexp_replace(label, r"^\s+|\s+$", "")), r"^([a-z]+)([-_][a-z0-9]+)*$", 1)
    code = F.lit(None).cast("string")
    for c in languages:
        code = F.when(head.isin(*NAMES[c]), c).otherwise(code)
    return code


def fit(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "lang", p: Params = Params()) -> np.ndarray:
    """Prototypes from a sample of the labelled documents, an equal share of each language, chosen by hashes of
    their ids. The labels are counted first, without the texts; then the documents under their language's
    threshold are read: about p.sample_docs rows reach the driver, each of at most p.sample_chars characters."""
    labelled = documents.select(label_code(F.col(label), p.languages).alias("__code"), doc_id, text).where("__code IS NOT NULL")
    counts = {r["__code"]: r["n"] for r in labelled.groupBy("__code").agg(F.count(F.lit(1)).alias("n")).collect()}
    want, scale = p.sample_docs / len(p.languages), 1 << 40
    reach = F.lit(0)
    for code, n in counts.items():
        reach = F.when(F.col("__code") == code, F.lit(min(scale, int(scale * want / n)))).otherwise(reach)
    h = F.pmod(F.xxhash64(doc_id), F.lit(scale))
    chosen = labelled.where((h < reach) & F.length(text).between(40, p.sample_chars))
    rows = sorted((r["h"], r["__code"], r["t"]) for r in chosen.select("__code", h.alias("h"), F.col(text).alias("t")).collect())
    return prototypes([(code, t) for _, code, t in rows], p)


def segments(documents: DataFrame, proto: np.ndarray, doc_id: str = "doc_id", text: str = "text", label: str = "lang", p: Params = Params()) -> DataFrame:
    """(doc_id, label, seg, lang, confidence, start, end, n_langs): one row per segment, numbered in
    order of the text; a document without counted sentence has one row with seg null."""
    kept = gram_table(proto, p)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            judged = classify(pdf["__text"].tolist(), kept, p)
            for i, said, found in zip(pdf["__id"], pdf["__label"], judged, strict=True):
                runs: list[list] = []
                for a, b, k, c in found:
                    if runs and runs[-1][2] == k:
                        runs[-1][1] = b
                        runs[-1][3].append(c)
                    else:
                        runs.append([a, b, k, [c]])
                n = len({r[2] for r in runs})
                if not runs:
                    rows.append((i, said, None, None, 0.0, None, None, 0))
                for seg, (a, b, k, c) in enumerate(runs, 1):
                    rows.append((i, said, seg, p.languages[k], float(np.mean(c)), a, b, n))
            yield pd.DataFrame(rows, columns=["doc_id", "label", "seg", "lang", "confidence", "start", "end", "n_langs"]).astype({"doc_id": "Int64", "seg": "Int64", "start": "Int64", "end": "Int64"})

    chosen = documents.select(F.col(doc_id).cast("long").alias("__id"), F.col(label).alias("__label"), F.col(text).alias("__text"))
    return chosen.mapInPandas(run, "doc_id long, label string, seg long, lang string, confidence double, start long, end long, n_langs int")


def document_languages(found: DataFrame) -> DataFrame:
    """(doc_id, label, lang, confidence, n_langs): a document's language is that of most of its text; ties
    go to the first code. Rows of one document are few and come from one place."""
    size = F.coalesce(F.col("end") - F.col("start"), F.lit(0))
    per = found.groupBy("doc_id", "label", "lang").agg(F.sum(size).alias("chars"), F.try_divide(F.sum(F.col("confidence") * size), F.sum(size)).alias("confidence"), F.max("n_langs").alias("n_langs"))
    best = per.groupBy("doc_id", "label").agg(F.min(F.struct(-F.col("chars"), "lang", "confidence", "n_langs")).alias("b"))
    return best.select("doc_id", "label", F.col("b.lang").alias("lang"), F.coalesce(F.col("b.confidence"), F.lit(0.0)).alias("confidence"), F.col("b.n_langs").alias("n_langs"))
