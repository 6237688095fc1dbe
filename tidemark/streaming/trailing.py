"""Trailing counts and sums kept per entity in Spark's own streaming state (RocksDB).

An event sees the entity's earlier events within the window, none of its own instant. State holds one
entry per instant, pruned as the window moves on, so it is bounded by an entity's instants in a window.
For entities hotter than one task can hold, use `scorer.StreamScorer`, whose plan splits them by time.

Defined cases: an event earlier than the entity's window start sees what is left of it; a null amount
adds 0; an event without entity or time is left out.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StringType, StructField, StructType

OUT = StructType([StructField("id", StringType()), StructField("event_id", StringType()), StructField("us", LongType()), StructField("n", LongType()), StructField("total", LongType())])


class TrailingWindow(StatefulProcessor):
    def __init__(self, window: int, idle_ms: int | None = None):
        self.window, self.idle_ms = window, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getMapState("seen", "us bigint", "n bigint, total bigint", **({"ttlDurationMs": self.idle_ms} if self.idle_ms else {}))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        past = {k[0]: (v[0], v[1]) for k, v in self.seen.iterator()}
        kept, new = set(past), sorted(rows, key=lambda r: r.us)
        for r in new:
            n, total = past.get(r.us, (0, 0))
            past[r.us] = (n + 1, total + (r.amount or 0))
        # Both ends of the window only move on, so each instant is added and taken away once.
        instants = sorted(past)
        low = high = n = total = 0
        for r in new:
            while high < len(instants) and instants[high] < r.us:
                n, total, high = n + past[instants[high]][0], total + past[instants[high]][1], high + 1
            while low < high and instants[low] < r.us - self.window:
                n, total, low = n - past[instants[low]][0], total - past[instants[low]][1], low + 1
            yield Row(id=key[0], event_id=r.event_id, us=r.us, n=n, total=total)
        newest = instants[-1]
        for u in instants:
            if u >= newest - self.window:
                self.seen.updateValue((u,), past[u])
            elif u in kept:
                self.seen.removeKey((u,))

    def close(self) -> None:
        pass


def trailing(stream: DataFrame, entity: str, event_id: str, us: str, amount: str, window: int, idle_ms: int | None = None) -> DataFrame:
    """(id, event_id, us, n, total). Needs the RocksDB state store in the session's settings. With idle_ms, an
    entity without events for so long, by the clock on the wall, is forgotten."""
    rows = stream.select(F.col(entity).alias("id"), F.col(event_id).alias("event_id"), F.col(us).cast("long").alias("us"), F.col(amount).cast("long").alias("amount"))
    rows = rows.where(F.col("id").isNotNull() & F.col("us").isNotNull())
    return rows.groupBy("id").transformWithState(statefulProcessor=TrailingWindow(window, idle_ms), outputStructType=OUT, outputMode="Append", timeMode="ProcessingTime" if idle_ms else "None")
