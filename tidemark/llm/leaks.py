"""Documents that hold passages of held-out evaluation items.

Item texts are normalised to words, and every run of `words` consecutive words becomes a pattern of one
Aho-Corasick automaton. Each document is normalised the same way and scanned once; a match is found
however the passage is laid out, and its place is mapped back to the original text.

The items are a stated set, scanned for in all documents. They go to every task, so their size is
checked: items above `block_chars` characters in all are split into blocks by a hash of their ids, and
the corpus is scanned once for each block.

Defined cases: a null, empty or wordless text, and an item of fewer than `words` words, match nothing;
an item given twice counts once; equal runs in several items lead to all of them; an empty table on
either side gives no rows. Columns other than those named are ignored.
"""

from __future__ import annotations

import unicodedata
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_WORDS = regex.compile(r"[\p{L}\p{N}]+")
_FORMAT = regex.compile(r"\p{Cf}+")
#: A base character with all that may melt into it under normalisation.
_CLUSTER = regex.compile(r"\X", regex.V1)
_PIECE = regex.compile(r"\S+|\s+")
BLOCK_CHARS = 8_000_000


def normal_words(text: str) -> list[str]:
    """Runs of letters and digits after NFKC, without format characters, case-folded."""
    if text.isascii():
        return _WORDS.findall(text.lower())
    return _WORDS.findall(_FORMAT.sub("", unicodedata.normalize("NFKC", text)).casefold())


def _plain(text: str) -> str:
    return _FORMAT.sub("", unicodedata.normalize("NFKC", text)).casefold()


def placed_words(text: str) -> list[tuple[str, int, int]]:
    """normal_words with each word's start and end in the original text.

    The text is normalised piece by piece between white space, which melts into nothing, and in a piece cluster
    by cluster with the origin kept; a piece of which that makes something else than normalising it as a
    whole has the place of the whole piece."""
    pieces, origin = [], []
    for m in _PIECE.finditer(text):
        piece, at = m.group(), m.start()
        whole = _plain(piece)
        parts = [(_plain(c.group()), at + c.start(), at + c.end()) for c in _CLUSTER.finditer(piece)]
        if "".join(x for x, _, _ in parts) != whole:
            parts = [(whole, at, m.end())]
        pieces.append(whole)
        for x, start, end in parts:
            origin += [(start, end)] * len(x)
    return [(m.group(), origin[m.start()][0], origin[m.end() - 1][1]) for m in _WORDS.finditer("".join(pieces))]


@lru_cache(maxsize=4)
def _automaton(items: tuple[tuple[int, str], ...], words: int):
    by_run: dict[str, set[tuple[int, int]]] = defaultdict(set)
    for item, text in items:
        w = normal_words(text)
        for i in range(len(w) - words + 1):
            by_run[f" {' '.join(w[i : i + words])} "].add((item, i))
    if not by_run:
        return None
    a = ahocorasick.Automaton()
    for run, places in by_run.items():
        a.add_word(run, (len(run), tuple(sorted(places))))
    a.make_automaton()
    return a


def matched_items(text: str, automaton) -> set[int]:
    """The items that share a run of words with the text."""
    flat = f" {' '.join(normal_words(text))} "
    return {item for _, (_, places) in automaton.iter(flat) for item, _ in places}


def spans(text: str, automaton) -> list[tuple[int, int, int, int]]:
    """(item, start, end, words): longest stretches of the text that stand in an item, placed in the original
    text. Runs make one stretch if they follow one another in the item as they do in the text."""
    placed = placed_words(text)
    starts, ends, at = {}, {}, 1
    for k, (w, _, _) in enumerate(placed):
        starts[at] = k
        ends[at + len(w)] = k
        at += len(w) + 1
    flat = f" {' '.join(w for w, _, _ in placed)} "
    open_: dict[tuple[int, int], list[int]] = {}
    found: dict[int, set[tuple[int, int]]] = defaultdict(set)
    for end, (size, places) in automaton.iter(flat):
        a, b = starts[end + 2 - size], ends[end]
        for item, offset in places:
            stretch = open_.get((item, offset - a))
            if stretch is not None and stretch[2] == a - 1:
                stretch[1:] = [b, a]
            else:
                if stretch is not None:
                    found[item].add((stretch[0], stretch[1]))
                open_[item, offset - a] = [a, b, a]
    for (item, _), (a, b, _) in open_.items():
        found[item].add((a, b))
    out = []
    for item, stretches in found.items():
        reach = -1
        for a, b in sorted(stretches, key=lambda x: (x[0], -x[1])):
            if b > reach:  # else it lies within a longer one
                out.append((item, placed[a][1], placed[b][2], b - a + 1))
                reach = b
    return out


def _blocks(items: DataFrame, item_id: str, text: str, block_chars: int) -> Iterator[tuple[tuple[int, str], ...]]:
    chosen = items.select(F.col(item_id).cast("long").alias("i"), F.col(text).alias("t")).where(F.col("i").isNotNull() & F.col("t").isNotNull())
    chars = chosen.agg(F.coalesce(F.sum(F.length("t")), F.lit(0))).first()[0]
    n = max(1, -(-chars // block_chars))
    for k in range(n):
        block = chosen if n == 1 else chosen.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k)
        yield tuple(sorted({(r.i, r.t) for r in block.collect()}))


def leaks(documents: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", words: int = 13, places: bool = False, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc_id, item_id), once for each pair of a document's row; with places, (doc_id, item_id, start, end,
    n_words), one row per longest shared stretch, offsets in characters of the original text."""
    chosen = documents.select(F.col(doc_id).cast("long").alias("__id"), F.col(text).alias("__text")).where(F.col("__text").isNotNull())
    context, out = documents.sparkSession.sparkContext, None
    for block in _blocks(items, item_id, item_text, block_chars):
        sent = context.broadcast(block)

        def run(batches: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            automaton = _automaton(sent.value, words)
            for pdf in batches:
                rows: list[tuple] = []
                for i, t in zip(pdf["__id"], pdf["__text"], strict=True) if automaton else ():
                    found = matched_items(t, automaton)
                    if found and places:
                        rows += [(i, *s) for s in spans(t, automaton)]
                    else:
                        rows += [(i, item) for item in sorted(found)]
                names = ["doc_id", "item_id", "start", "end", "n_words"] if places else ["doc_id", "item_id"]
                yield pd.DataFrame(rows, columns=names).astype({"doc_id": "Int64"})

        part = chosen.mapInPandas(run, "doc_id long, item_id long, start long, end long, n_words long" if places else "doc_id long, item_id long")
        out = part if out is None else out.unionByName(part)
    return out
