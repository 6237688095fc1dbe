"""Percentiles of very large numeric columns with a guaranteed relative error, from mergeable counts.

A value x > 0 falls into bucket ceil(log_g |x|), with g = (1 + a) / (1 - a); negative values have
buckets of their own, zeros one. A bucket answers with 2 g^i / (g + 1), which is within a of each of its
values, relatively. A sketch is a table of counts by bucket: those of days, instances or partitions add
up to the sketch of all, exactly. A group has at most some 70,000 buckets at a = 0.01 over the whole
range of doubles, a few hundred in practice, however many values it has.

The q-percentile is the value of rank floor(q (n - 1)) + 1 of the group's n values in order.

Histograms with cumulative counts by bound know a value only up to its interval (lower, upper]. Such a
mass goes into two sketches, by lower and by upper bound, and the percentile of the values lies between
the two sketches' percentiles (each within a of its bound).

Defined cases: null and NaN are no values; infinities are the outermost buckets and answer as such;
values too small for a logarithm's difference (subnormal) are still bucketed; an empty group has no row; a
null group is a group of its own. In a histogram: null or empty buckets are no values; a bound that is
null or NaN is ignored; a missing bound merely widens an interval; counts that fall are taken as not
rising; a missing bound at infinity takes the total given, if that is more than the last count.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

ALPHA = 0.01
_FAR = 1_000_000  # the index of infinity


def _gamma(alpha: float) -> float:
    if not 0 < alpha < 1:
        raise ValueError("the relative error lies between 0 and 1")
    return (1 + alpha) / (1 - alpha)


def bucket(value: Column, alpha: float = ALPHA) -> Column:
    """The signed bucket as one ordered number: 0 for zero, else sign x (index + offset), offset above
    any index's size, so that order by it is order by value."""
    size = F.abs(value)
    i = F.when(size == float("inf"), _FAR).otherwise(F.ceil(F.ln(size) / F.lit(math.log(_gamma(alpha)))).cast("int"))
    return F.when(value == 0, 0).otherwise(F.signum(value).cast("int") * (i + 2 * _FAR))


def bucket_value(b: Column, alpha: float = ALPHA) -> Column:
    """What a bucket answers."""
    g = _gamma(alpha)
    i = F.abs(b) - 2 * _FAR
    size = F.when(i == _FAR, F.lit(float("inf"))).otherwise(F.exp(i * math.log(g)) * (2 / (g + 1)))
    return F.when(b == 0, F.lit(0.0)).otherwise(F.signum(b.cast("double")) * size)


def sketch(rows: DataFrame, groups: Sequence[str], value: str, alpha: float = ALPHA, weight: str | None = None) -> DataFrame:
    """(groups, bucket, n). Counts are combined before the shuffle, so a hot group brings a row per bucket and task."""
    v = F.col(value).cast("double")
    return (
        rows.where(v.isNotNull() & ~F.isnan(v))
        .groupBy(*groups, bucket(v, alpha).alias("bucket"))
        .agg((F.sum(F.col(weight).cast("long")) if weight else F.count(F.lit(1))).alias("n"))
    )


def merge(sketches: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Adds up sketches by fewer groups."""
    return sketches.groupBy(*groups, "bucket").agg(F.sum("n").alias("n"))


def merge_sets(sketches: DataFrame, sets: Sequence[Sequence[str]], groups: Sequence[str], merged: str = "(all)") -> DataFrame:
    """The sketches of several groupings at once; a column that is merged away holds `merged`."""
    out = None
    for s in sets:
        part = merge(sketches, s).select(*[F.col(g) if g in s else F.lit(merged).alias(g) for g in groups], "bucket", "n")
        out = part if out is None else out.unionByName(part)
    return out


def percentiles(sketches: DataFrame, groups: Sequence[str], qs: dict[str, float], alpha: float = ALPHA) -> DataFrame:
    """(groups, n, and a column for each of qs: name -> share). Works on bucket counts alone."""
    w = W.partitionBy(*groups)
    upto = w.orderBy("bucket").rowsBetween(W.unboundedPreceding, 0)
    ranked = sketches.where("n > 0").withColumns({"__upto": F.sum("n").over(upto), "__n": F.sum("n").over(w)})
    rank = lambda q: F.floor(F.lit(q) * (F.col("__n") - 1)).cast("long") + 1
    picked = [F.min(F.when(F.col("__upto") >= rank(q), F.col("bucket"))).alias(f"__{name}") for name, q in qs.items()]
    found = ranked.groupBy(*groups).agg(F.first("__n").alias("n"), *picked)
    return found.select(*groups, "n", *[bucket_value(F.col(f"__{name}"), alpha).alias(name) for name in qs])


def histogram_intervals(rows: DataFrame, keep: Sequence[str], buckets: str, total: str) -> DataFrame:
    """(keep, lower, upper, n) of histograms, a map from bound to cumulative count."""
    entries = F.filter(F.map_entries(buckets), lambda e: e["key"].isNotNull() & ~F.isnan(e["key"]) & e["value"].isNotNull() & ~F.isnan(e["value"]))
    ordered = F.array_sort(F.transform(entries, lambda e: F.struct(e["key"].alias("le"), e["value"].alias("c"))))
    inf = F.lit(float("inf"))
    last = F.try_element_at("__h", F.lit(-1))
    sure = F.when(F.col(total).isNotNull() & ~F.isnan(F.col(total)), F.col(total).cast("double"))
    closed = F.when(
        (F.size("__h") > 0) & (last["le"] < inf) & (sure > last["c"]), F.concat("__h", F.array(F.struct(inf.alias("le"), sure.alias("c"))))
    ).otherwise(F.col("__h"))
    start = F.struct(F.lit(0.0).alias("le"), F.lit(0.0).alias("c"), F.array().cast("array<struct<lower:double,upper:double,n:bigint>>").alias("out"))

    def step(acc, e):
        n = F.greatest(e["c"] - acc["c"], F.lit(0.0))
        mass = F.struct(acc["le"].alias("lower"), e["le"].alias("upper"), F.round(n).cast("long").alias("n"))
        return F.struct(e["le"].alias("le"), F.greatest(e["c"], acc["c"]).alias("c"), F.concat(acc["out"], F.array(mass)).alias("out"))

    masses = F.aggregate("__h", start, step, lambda acc: acc["out"])
    return (
        rows.where(F.col(buckets).isNotNull())
        .select(*keep, total, ordered.alias("__h"))
        .withColumn("__h", closed)
        .select(*keep, F.inline(masses))
        .where("n > 0")
        .groupBy(*keep, "lower", "upper")
        .agg(F.sum("n").alias("n"))
    )
