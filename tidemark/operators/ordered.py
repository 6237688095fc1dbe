"""Running sums and exact percentiles without a single-task step.

A total order is cut into parts (ranges of the ordering value); a running sum is that inside the part
plus the totals of the parts before. A value's part is its bucket of 1 % relative width, so parts
follow the data's scale; equal values are added up before anything is ordered.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def value_part(value: Column) -> Column:
    """A whole number that grows with the value: which hundredth of a power of e it lies in."""
    size = F.ceil(F.ln(F.abs(value)) * 100).cast("long") + 100_000
    return F.when(value == 0, F.lit(0).cast("long")).otherwise(F.signum(value).cast("long") * size)


def running_sums(rows: DataFrame, groups: Sequence[str], part: str, order: str, sums: Mapping[str, str], ties: bool = True) -> DataFrame:
    """rows with each of sums (new name -> column) added up over all rows at or before it in (part, order)
    within its group. With ties, rows of equal order share a sum; else the frame ends at the row itself.
    A part's rows meet in one task; `part` must not fall while `order` grows."""
    inside = W.partitionBy(*groups, part).orderBy(order)
    inside = inside.rangeBetween(W.unboundedPreceding, 0) if ties else inside.rowsBetween(W.unboundedPreceding, 0)
    before = W.partitionBy(*groups).orderBy(part).rowsBetween(W.unboundedPreceding, -1)
    totals = rows.groupBy(*groups, part).agg(*[F.sum(c).alias(f"__t_{n}") for n, c in sums.items()])
    totals = totals.select(*groups, part, *[F.coalesce(F.sum(f"__t_{n}").over(before), F.lit(0)).alias(f"__b_{n}") for n in sums])
    inner = rows.withColumns({f"__i_{n}": F.sum(c).over(inside) for n, c in sums.items()})
    on = [inner[g].eqNullSafe(totals[g]) for g in (*groups, part)]
    keys = on[0]
    for k in on[1:]:
        keys = keys & k
    joined = inner.join(totals, keys)
    return joined.select(*[inner[c] for c in rows.columns], *[(F.col(f"__i_{n}") + F.col(f"__b_{n}")).alias(n) for n in sums])


def exact_percentiles(rows: DataFrame, groups: Sequence[str], value: str, probabilities: Sequence[float], count: str | None = None) -> DataFrame:
    """(groups, n, q: array of the percentiles, in the order given), with linear interpolation between order
    statistics. Null and NaN are no values; a group without values has no row. With count, a row stands for so
    many."""
    v = F.col(value).cast("double")
    by_value = rows.where(v.isNotNull() & ~F.isnan(v)).groupBy(*groups, v.alias("__v")).agg((F.sum(count) if count else F.count(F.lit(1))).alias("__n")).withColumn("__p", value_part(F.col("__v")))
    placed = running_sums(by_value, groups, "__p", "__v", {"__upto": "__n"})
    sizes = by_value.groupBy(*groups).agg(F.sum("__n").alias("__size"))
    match = F.lit(True)
    for g in groups:
        match = match & placed[g].eqNullSafe(sizes[g])
    joined = placed.join(sizes, match) if groups else placed.crossJoin(F.broadcast(sizes))
    picks = []
    for i, p in enumerate(probabilities):
        at = F.lit(float(p)) * (F.col("__size") - 1)
        for side, rank in (("lo", F.floor(at) + 1), ("hi", F.ceil(at) + 1)):
            picks.append(F.min(F.when(F.col("__upto") >= rank, F.col("__v"))).alias(f"__{side}{i}"))
    columns = [placed[g] for g in groups]
    found = joined.groupBy(*columns).agg(F.max("__size").alias("n"), *picks)
    answers = []
    for i, p in enumerate(probabilities):
        at = F.lit(float(p)) * (F.col("n") - 1)
        answers.append(F.col(f"__lo{i}") + (F.col(f"__hi{i}") - F.col(f"__lo{i}")) * (at - F.floor(at)))
    return found.where("n IS NOT NULL").select(*groups, "n", F.array(*answers).alias("q"))
