"""Served feature values against their definition, in time linear in the events but for sorting.

The definition is evaluated apart from `features`, without its deltas and running sums: an entity's events
are sorted by time, each event's window is a stretch of them found by binary search, and the aggregate is
taken over that stretch. An entity's time is cut into blocks; an event also goes to the next block if it
can be seen there, so a block holds all that its own events see and a hot entity is spread over its blocks.
Served values travel to the block of their event and are compared there: nothing is joined again, and what
comes out is a line per feature and task.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.times import DAY, floor_to
from tidemark.operators.features import EMPTY, NULL_VALUE, FeatureSpec

TOLERANCE = 1e-9
#: Rows that are judged at once, and more where one block of an entity has more.
CHUNK = 200_000
COUNTS = "feature string, compared long, violations long"


def violations(txn: DataFrame, served: DataFrame, specs: Sequence[FeatureSpec]) -> DataFrame:
    """(feature, compared, violations) for the features of one entity with bounded windows. txn: event_id, us, the
    entity's id and fields; served: event_id, us, the id and the features. An event that only one of them has
    counts as compared and as a violation; an event without the entity's id has -1."""
    if len({s.entity for s in specs}) != 1 or any(s.window is None for s in specs):
        raise ValueError("one entity's bounded windows are audited at a time")
    reach = max(s.window + (s.resolution or 0) for s in specs)
    length = max(DAY, 5 * reach)
    own = floor_to(F.col("us"), length)
    fields = {}
    for s in specs:
        if s.field:
            distinct = s.aggregation == "distinct_count"
            c = F.col(s.field)
            fields[_column(s)] = F.coalesce(c.cast("string"), F.lit(NULL_VALUE)) if distinct else c.cast("double")
    event = F.xxhash64("event_id")
    at = [F.col(f"{specs[0].entity}_id").cast("string").alias("id"), "us"]
    seen_next = F.when(F.col("us") + reach >= own + length, own + length)
    data = txn.select(*at, event.alias("event"), F.explode(F.array_compact(F.array(own, seen_next))).alias("block"), F.lit(False).alias("claim"), *[c.alias(n) for n, c in fields.items()])
    # Who an event is matters in its own block only.
    data = data.withColumn("event", F.when(F.col("block") == own, F.col("event")).otherwise(F.lit(0).cast("long")))
    claims = served.select(*at, event.alias("event"), own.alias("block"), F.lit(True).alias("claim"), *[F.col(s.name) for s in specs])
    both = data.unionByName(claims, allowMissingColumns=True).repartition("id", "block")
    # The hash leads, so that sorting seldom compares names.
    both = both.sortWithinPartitions(F.xxhash64("id", "block"), "id", "block", "us", "event", "claim")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compared, wrong = 0, np.zeros(len(specs), np.int64)
        for rows in _whole_blocks(batches):
            n, bad = _judge(rows, specs, length, reach)
            compared += n
            wrong += bad
        if compared:
            yield pa.RecordBatch.from_pydict({"feature": [s.name for s in specs], "compared": pa.array([compared] * len(specs), pa.int64()), "violations": pa.array(wrong, pa.int64())})

    return both.mapInArrow(run, COUNTS).groupBy("feature").agg(F.sum("compared").alias("compared"), F.sum("violations").alias("violations"))


def _column(s: FeatureSpec) -> str:
    return f"__{'v' if s.aggregation == 'distinct_count' else 'x'}_{s.field}"


def _changes(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Where a row is of another block or entity than the row before it, and which rows have no id."""
    codes = rows["id"].combine_chunks().dictionary_encode()
    codes = codes.combine_chunks() if isinstance(codes, pa.ChunkedArray) else codes
    ids, blocks = codes.indices.fill_null(-1).to_numpy(zero_copy_only=False), rows["block"].to_numpy()
    return np.flatnonzero((ids[1:] != ids[:-1]) | (blocks[1:] != blocks[:-1])) + 1, ids < 0


def _whole_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The sorted rows in pieces of CHUNK and more that part no entity's block."""
    held: list[pa.RecordBatch] = []
    n, least = 0, CHUNK
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n < least:
            continue
        rows = pa.Table.from_batches(held)
        ends = _changes(rows)[0]
        if len(ends):
            cut = int(ends[-1])
            yield rows.slice(0, cut)
            rest = rows.slice(cut)
            held, n, least = pa.table(rest).to_batches(), rest.num_rows, max(CHUNK, 2 * rest.num_rows)
        else:
            least = 2 * n
    if n:
        yield pa.Table.from_batches(held)


def _judge(rows: pa.Table, specs: Sequence[FeatureSpec], length: int, reach: int) -> tuple[int, np.ndarray]:
    """Events compared, and violations of each feature."""
    size = rows.num_rows
    ends, nameless = _changes(rows)
    group = np.zeros(size, np.int64)
    group[ends] = 1
    group = np.cumsum(group)
    us, block, event = (rows[c].to_numpy() for c in ("us", "block", "event"))
    claim = rows["claim"].to_numpy().astype(bool)
    is_own = ~claim & (us - us % length == block)
    # A claim stands right behind its event.
    met = np.zeros(size, bool)
    met[1:] = claim[1:] & is_own[:-1] & (group[1:] == group[:-1]) & (us[1:] == us[:-1]) & (event[1:] == event[:-1])
    claims = np.flatnonzero(met)
    lone = int(is_own.sum()) - len(claims) + int(claim.sum()) - len(claims)

    data = np.flatnonzero(~claim)
    place = np.cumsum(~claim) - 1
    asked = claims - 1
    # Entity and time in one number: times lie within the block and the reach before it.
    span = length + 2 * reach
    key = group[data] * span + (us[data] - block[data] + reach)
    end = np.searchsorted(key, key[place[asked]], "left")
    t, void = us[asked], nameless[asked]
    bad = np.full(len(specs), lone, np.int64)
    starts: dict[tuple, np.ndarray] = {}
    for i, s in enumerate(specs):
        lane = (s.window, s.resolution)
        if lane not in starts:
            since = t - s.window
            since = since - since % s.resolution if s.resolution else since
            starts[lane] = np.searchsorted(key, group[asked] * span + (since - block[asked] + reach), "left")
        start = starts[lane]
        if s.aggregation == "count":
            value = (end - start).astype(float)
            some = end > start
        elif s.aggregation == "seconds_since_last":
            some = end > start
            value = (t - us[data][np.maximum(end - 1, 0)]) / 1e6
        elif s.aggregation == "distinct_count":
            value = _distinct(rows[_column(s)].combine_chunks().take(pa.array(data)), group[data], start, end).astype(float)
            some = end > start
        else:
            x = rows[_column(s)].combine_chunks().take(pa.array(data))
            there = x.is_valid().to_numpy(zero_copy_only=False)
            x = x.fill_null(0.0).to_numpy(zero_copy_only=False)
            upto = np.concatenate(([0], np.cumsum(there)))
            n = upto[end] - upto[start]
            some = n > 0
            if s.aggregation in ("sum", "mean"):
                # Wider than a double, so that whole numbers stay exact.
                total = np.concatenate(([0], np.cumsum(x.astype(np.longdouble))))
                value = (total[end] - total[start]).astype(float)
                value = value / np.maximum(n, 1) if s.aggregation == "mean" else value
            else:
                sign = 1.0 if s.aggregation == "max" else -1.0
                value = sign * _greatest(np.where(there, sign * x, -np.inf), start, end)
        value = np.where(some & ~void, value, EMPTY)
        told = rows[s.name].combine_chunks().take(pa.array(claims)).cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False)
        bad[i] += int((~(np.abs(told - value) <= TOLERANCE)).sum())
    return len(claims) + lone, bad


def _greatest(x: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The greatest of x[start:end], -inf where that is empty: two stretches of a power of two cover it."""
    out = np.full(len(start), -np.inf)
    size = end - start
    step, level = 1, x
    while len(level) and (size >= step).any():
        at = np.flatnonzero((size >= step) & (size < 2 * step))
        out[at] = np.maximum(level[start[at]], level[end[at] - step])
        level = np.maximum(level[:-step], level[step:]) if len(level) > step else level[:0]
        step *= 2
    return out


def _distinct(values: pa.Array, group: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Different values in each stretch; stretches are in order. A row counts in those stretches that hold it and
    not the row before it of the same group and value, which are neighbours."""
    codes = values.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    rows = np.arange(len(codes))
    order = np.lexsort((rows, codes, group))
    same = (group[order][1:] == group[order][:-1]) & (codes[order][1:] == codes[order][:-1])
    before = np.full(len(codes), -1, np.int64)
    before[order[1:][same]] = order[:-1][same]
    first = np.maximum(np.searchsorted(end, rows, "right"), np.searchsorted(start, before, "right"))
    last = np.searchsorted(start, rows, "right")
    counts = np.zeros(len(start) + 1, np.int64)
    some = first < last
    np.add.at(counts, first[some], 1)
    np.add.at(counts, last[some], -1)
    return np.cumsum(counts)[:-1]
