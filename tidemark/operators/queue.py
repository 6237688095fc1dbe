"""A capacity-limited review queue, hour by hour, with expiry, for each day and policy.

Each hour's end admits what arrived before it; the best items are reviewed until the capacity is used;
items that waited longer than max_wait expire, without using capacity. The shift starts at the hour of
the day's first arrival. Ties go to the earlier arrival, then to the smaller id.

Only the simulation of the items that could ever be reviewed is sequential. Of the items of one arrival
hour that expire together, at most capacity x (hours until expiry) can be reviewed, the best ones, so
the rest are counted as expired without entering a task. That ranking is a window top-k, cut down before
its shuffle, and leaves a bounded number of items a day.

Defined cases: items without arrival time are left out; a null priority ranks last; a day without
items has no row.
"""

from __future__ import annotations

import heapq
import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

HOUR_US = 3_600_000_000


def simulate(items: DataFrame, policies: dict[str, Column], capacity: int, max_wait_us: int, recovery: float, hours: int = 24) -> DataFrame:
    """(day, policy, reviewed, caught_cents, expired). items: event_id, arrived_us, amount_cents, is_fraud and
    what the policies read."""
    if capacity < 1 or max_wait_us < HOUR_US:
        raise ValueError("a capacity is at least 1 and a wait at least an hour")
    each = [F.struct(F.lit(n).alias("policy"), F.coalesce(c.cast("double"), F.lit(float("-inf"))).alias("priority")) for n, c in policies.items()]
    rows = items.where(F.col("arrived_us").isNotNull()).select(
        F.floor(F.col("arrived_us") / F.lit(24 * HOUR_US)).alias("day"), "event_id", "arrived_us", F.coalesce(F.col("amount_cents").cast("double"), F.lit(0.0)).alias("amount"),
        F.coalesce("is_fraud", F.lit(False)).alias("fraud"), F.inline(F.array(*each)),
    )
    # The last review that an item can wait for: its expiry class within its hour.
    into = F.pmod("arrived_us", F.lit(HOUR_US))
    lasts = F.floor((into + max_wait_us) / F.lit(HOUR_US))
    w = W.partitionBy("day", "policy", F.floor(F.col("arrived_us") / HOUR_US), lasts).orderBy(F.desc("priority"), "arrived_us", "event_id")
    bound = capacity * (math.ceil(max_wait_us / HOUR_US) + 1)
    able = rows.withColumn("__k", F.row_number().over(w)).where(F.col("__k") <= bound)
    counts = rows.groupBy("day", "policy").agg(F.count(F.lit(1)).alias("n"), F.min("arrived_us").alias("first_us"))

    def day(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["arrived_us", "event_id"])
        start = int(pdf["first_us"].iloc[0]) // HOUR_US * HOUR_US
        arrived, fraud, amount, priority = (pdf[c].to_numpy() for c in ("arrived_us", "fraud", "amount", "priority"))
        heap: list[tuple[float, int]] = []
        at = reviewed = 0
        caught = 0.0
        for h in range(hours):
            end = start + (h + 1) * HOUR_US
            while at < len(arrived) and arrived[at] < end:
                heapq.heappush(heap, (-priority[at], at))
                at += 1
            left = capacity
            while heap and left:
                _, i = heapq.heappop(heap)
                if end - arrived[i] <= max_wait_us:
                    left -= 1
                    reviewed += 1
                    caught += amount[i] * (1 - recovery) if fraud[i] else 0.0
        return pd.DataFrame({"day": pdf["day"].iloc[:1].to_numpy(), "policy": pdf["policy"].iloc[:1].to_numpy(), "reviewed": [reviewed], "caught_cents": [caught]})

    first = counts.select("day", "policy", "first_us")
    done = able.join(first, ["day", "policy"]).groupBy("day", "policy").applyInPandas(day, "day long, policy string, reviewed long, caught_cents double")
    return done.join(counts, ["day", "policy"]).select("day", "policy", "reviewed", "caught_cents", (F.col("n") - F.col("reviewed")).alias("expired"))


def paired_by_day(results: DataFrame, a: str, b: str) -> DataFrame:
    """(day, difference): what policy a caught above policy b."""
    return results.groupBy("day").agg((F.sum(F.when(F.col("policy") == a, F.col("caught_cents"))) - F.sum(F.when(F.col("policy") == b, F.col("caught_cents")))).alias("difference"))
