"""Token ids of every text by a public byte-level BPE tokenizer, sharing work between documents.

Texts are cut where a rolling hash of the last 32 characters says so, so equal passages are cut alike
wherever they stand. Chunks are counted over the whole corpus; those that recur are encoded once, into a
dictionary, and looked up wherever they stand. The others stay with their document and are encoded in place,
neighbours together. The ids are then put together; where a token might cross a join with a looked-up
chunk, the text around it is encoded anew, outwards until both sides agree with the chunks' own tokens, so
that the result is exactly that of encoding the whole text.

A cut between a character and a following space can't be crossed by a token (the tokenizer's pattern
takes white space only at a token's start), so such joins need no repair and are preferred.

The dictionary goes to every task, so its size is bounded: the chunks that save most, DICTIONARY_CHUNKS and
DICTIONARY_CHARS at most; a recurring chunk beyond that is encoded in place, with the same result. No text
is shuffled but the dictionary's; the counts are 12 bytes a distinct chunk and batch.

Defined cases: a null or empty text has the empty list; special tokens' strings are ordinary text;
repeated rows give repeated results; lone surrogates can't occur in Spark's strings; an empty table gives no
rows. Columns other than the two named are ignored.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemark.session import written

WINDOW = 32
MIN_CHUNK, MAX_CHUNK = 24, 4096
#: A hash hit in so many ends a chunk: at a space, or anywhere.
AT_SPACE, ANYWHERE = 32, 1024
#: Bounds of the dictionary of recurring chunks.
DICTIONARY_CHUNKS, DICTIONARY_CHARS = 65_536, 4_000_000
#: Characters that are cut together.
_BLOCK = 1_000_000
#: Fixed value: the tokenizer's own split pattern.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


@lru_cache(maxsize=2)
def encoder(ranks_path: str):
    import tiktoken

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("byte_bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)


def _rolling(u: np.ndarray) -> np.ndarray:
    """For each position the hash of the WINDOW characters before it."""
    h = (u + np.uint32(0x9E3779B9)) * np.uint32(0x85EBCA6B)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0xC2B2AE35)
    h ^= h >> np.uint32(13)
    step = 1
    while step < WINDOW:
        shifted = np.zeros_like(h)
        shifted[step:] = h[:-step] << np.uint32(step)
        h = h + shifted
        step *= 2
    h = (h * np.uint32(0x9E3779B1)) >> np.uint32(12)
    return np.concatenate((np.zeros(1, np.uint32), h[:-1])) if len(h) else h


def _clean(u: np.ndarray) -> np.ndarray:
    """Whether a plain space stands at a position, after a character that isn't white space."""
    white = (u <= 32) | (u == 0x7F) | ((u >= 0x80) & (u <= 0xA0)) | ((u >= 0x1680) & (u <= 0x205F) & ((u == 0x1680) | (u >= 0x2000))) | (u == 0x3000)
    out = np.zeros(len(u), bool)
    out[1:] = (u[1:] == 32) & ~white[:-1]
    return out


def cuts(texts: Sequence[str]) -> Iterator[tuple[int, list[int]]]:
    """(number of the text, ends of its chunks, the last one its length), for texts that aren't empty."""
    first, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= _BLOCK or i == len(texts) - 1:
            yield from _cut_block(texts, first, i + 1)
            first, size = i + 1, 0


def _cut_block(texts: Sequence[str], first: int, last: int) -> Iterator[tuple[int, list[int]]]:
    u = _points("".join(texts[first:last]))
    h = _rolling(u)
    hits = np.flatnonzero(((h % AT_SPACE == 0) & _clean(u)) | (h % ANYWHERE == 0))
    start = 0
    for i in range(first, last):
        n = len(texts[i])
        if not n:
            continue
        own, ends, at = hits[np.searchsorted(hits, start + WINDOW) : np.searchsorted(hits, start + n)], [], 0
        for p in (*(own - start).tolist(), n) if n > 2 * MIN_CHUNK else (n,):
            while p - at > MAX_CHUNK:
                at += MAX_CHUNK
                ends.append(at)
            if p - at >= MIN_CHUNK and p < n:
                ends.append(p)
                at = p
        if at < n:
            ends.append(n)
        yield i, ends
        start += n


def joined(parts: list[tuple[str, list[int]]], encode) -> list[int]:
    """The ids of the whole text from those of its chunks in order, joins repaired."""
    out: list[int] = []
    carry = None  # text from a sure boundary on whose ids are still to be found
    for k, (chunk, ids) in enumerate(parts):
        inner, lo = np.flatnonzero(_clean(_points(chunk))), 0
        if carry is not None:
            if not len(inner):
                carry += chunk
                if k == len(parts) - 1:
                    out += encode(carry)
                continue
            lo = int(inner[0])
            out += encode(carry + chunk[:lo])
            ids = ids[len(encode(chunk[:lo])) :]
            carry = None
        if k == len(parts) - 1 or _sure(chunk, parts[k + 1][0]):
            out += ids
            continue
        hi = max(lo, int(inner[-1])) if len(inner) else lo
        out += ids[: len(ids) - len(encode(chunk[hi:]))]
        carry = chunk[hi:]
    return out


def _sure(left: str, right: str) -> bool:
    return right[:1] == " " and bool(left) and not left[-1].isspace() and left[-1] > " "


def assembled(text: str, ends: Sequence[int], known: dict[str, list[int]], encode) -> list[int]:
    """The text's ids: known chunks from the dictionary, stretches of others encoded in place, joins repaired."""
    if not known:
        return encode(text)
    parts: list[tuple[str, list[int] | None]] = []
    at = open_from = 0
    for end in ends:
        ids = known.get(text[at:end])
        if ids is not None:
            if open_from < at:
                parts.append((text[open_from:at], None))
            parts.append((text[at:end], ids))
            open_from = end
        at = end
    if not parts:
        return encode(text)
    if open_from < len(text):
        parts.append((text[open_from:], None))
    out: list[int] = []
    group: list[tuple[str, list[int]]] = []
    for k, (piece, ids) in enumerate(parts):
        group.append((piece, encode(piece) if ids is None else ids))
        if k == len(parts) - 1 or _sure(piece, parts[k + 1][0]):
            out += group[0][1] if len(group) == 1 else joined(group, encode)
            group = []
    return out


_POWERS = np.random.default_rng(20270901).integers(0, 2**64, MAX_CHUNK + 1, dtype=np.uint64)


def _chunk_counts(texts: Sequence[str]) -> tuple[list[int], list[int], list[str]]:
    """(hashes, counts, texts) of the distinct chunks of some texts."""
    pieces = [t[a:b] for i, ends in cuts(texts) for t in (texts[i],) for a, b in zip([0, *ends[:-1]], ends, strict=True)]
    found: dict[str, int] = {}
    for p in pieces:
        found[p] = found.get(p, 0) + 1
    kinds, hashes = list(found), []
    for i in range(0, len(kinds), 4096):
        some = kinds[i : i + 4096]
        lengths = np.fromiter(map(len, some), int, len(some))
        starts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
        u = _points("".join(some)).astype(np.uint64) + np.uint64(1)
        place = np.arange(len(u)) - np.repeat(starts, lengths)
        hashes += np.add.reduceat(u * _POWERS[place], starts).view(np.int64).tolist()
    return hashes, list(found.values()), kinds


def chunk_counts(documents: DataFrame, text: str) -> DataFrame:
    """(hash, n, chunk): the distinct chunks of each batch of texts and how often they stand in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, counts, kinds = _chunk_counts([t for t in batch.column(0).to_pylist() if t])
            yield pa.RecordBatch.from_arrays([pa.array(hashes, pa.int64()), pa.array(counts, pa.int32()), pa.array(kinds, pa.string())], ["hash", "n", "chunk"])

    return documents.select(text).where(F.length(text) > 0).mapInArrow(run, "hash long, n int, chunk string")


def dictionary(documents: DataFrame, text: str, ranks_path: str) -> dict[str, list[int]]:
    """Recurring chunks and their ids, each encoded once. At most DICTIONARY_CHUNKS chunks of DICTIONARY_CHARS
    characters in all reach the driver: those that save most, ties going to the smaller hash."""
    chunks = written(chunk_counts(documents, text), "chunks")
    n = chunks.groupBy("hash").agg(F.sum("n").alias("n"), F.max(F.length("chunk")).alias("size")).where("n > 1")
    saves = (F.col("n") - 1) * F.col("size")
    best = n.orderBy(saves.desc(), "hash").limit(DICTIONARY_CHUNKS).select("hash", F.sum("size").over(W.orderBy(saves.desc(), "hash")).alias("upto"))
    chosen = best.where(F.col("upto") <= DICTIONARY_CHARS).select("hash")
    texts = chunks.join(F.broadcast(chosen), "hash").groupBy("hash").agg(F.min("chunk").alias("chunk")).select("chunk")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(ranks_path).encode_ordinary
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([encode(t) for t in batch.column(0).to_pylist()], pa.list_(pa.int32()))], ["chunk", "ids"])

    found = texts.mapInArrow(run, "chunk string, ids array<int>").toArrow()
    return dict(zip(found.column("chunk").to_pylist(), found.column("ids").to_pylist(), strict=True))


def token_ids(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", ranks_path: str | None = None) -> DataFrame:
    """(doc_id, ids) of every row."""
    path = ranks_path or default_ranks()
    known = documents.sparkSession.sparkContext.broadcast(dictionary(documents, text, path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).encode_ordinary
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            ids: list[list[int]] = [[] for _ in texts]
            for i, ends in cuts(texts):
                ids[i] = assembled(texts[i], ends, known.value, encode)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, ids array<int>")
