"""Minutes of a live service: gaps filled, histograms merged, quantiles, recoveries, stops, daily rows.

Minutes are few per instance (525,600 a year), so windows over an instance's minutes are bounded; counts
of histograms are combined before the shuffle.

Defined cases: a minute scraped twice counts once (the largest values); a missing minute has zeros; NaN
counts as missing; a missing lag is not on time; an empty histogram has no quantiles; a minute's missing
bound takes the count of the nearest lower one, as its step function does.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: A feed's lag that is on time, and how much above what was sent counts as catching up.
FEED_ON_TIME, CATCH_UP, SUSTAIN = 1.0, 1.1, 2
MINUTE_S = 60


def _number(c: str) -> Column:
    return F.when(~F.isnan(c), F.col(c))


def assembled(minutes: DataFrame, start: Column | None = None, end: Column | None = None) -> DataFrame:
    """(instance_id, at, decisions, sent, feed_lag, buckets): every minute from the first to the last (or
    the bounds given) of each instance once."""
    best = F.struct(F.coalesce(F.array_max(F.map_values("buckets")), F.lit(-1.0)).alias("m"), F.array_sort(F.map_entries("buckets")).alias("e"))
    once = minutes.where(F.col("minute_at").isNotNull()).groupBy("instance_id", F.date_trunc("minute", "minute_at").alias("at")).agg(
        F.max(_number("decisions")).alias("decisions"), F.max(_number("sent")).alias("sent"), F.max(_number("feed_lag")).alias("feed_lag"), F.max(F.when(F.col("buckets").isNotNull(), best)).alias("b"),
    )
    # Each minute brings the missing ones up to the next, as in a calendar join, within the instance's partition.
    w = W.partitionBy("instance_id").orderBy("at")
    gap = F.sequence(F.col("at"), F.greatest("at", F.col("__next") - F.expr("INTERVAL 1 MINUTE")), F.expr("INTERVAL 1 MINUTE"))
    last = F.col("at") if end is None else F.greatest(F.col("at"), end)
    filled = once.withColumn("__next", F.coalesce(F.lead("at").over(w), last + F.expr("INTERVAL 1 MINUTE"))).select("*", F.explode(gap).alias("__at"))
    real = F.col("__at") == F.col("at")
    zero = lambda c: F.when(real, F.coalesce(c, F.lit(0.0))).otherwise(0.0).alias(c)
    rows = filled.select("instance_id", F.col("__at").alias("at"), zero("decisions"), zero("sent"), F.when(real, F.col("feed_lag")).alias("feed_lag"), F.when(real, F.map_from_entries("b.e")).alias("buckets"))
    return rows if start is None else rows.where(F.col("at") >= start)


def caught_up() -> Column:
    """The feed was on time and the scorer decided about what was sent."""
    on_time = F.col("feed_lag").isNotNull() & (F.col("feed_lag") <= FEED_ON_TIME)
    return on_time & (F.col("sent") > 0) & (F.col("decisions") > 0) & (F.col("decisions") <= F.col("sent") * CATCH_UP)


def idle_runs(rows: DataFrame) -> DataFrame:
    """(instance_id, first, last, minutes): runs of adjacent minutes without a decision."""
    idle = rows.where(F.col("decisions") <= 0)
    w = W.partitionBy("instance_id").orderBy("at")
    island = F.unix_timestamp("at") - F.row_number().over(w) * MINUTE_S
    return idle.withColumn("__i", island).groupBy("instance_id", "__i").agg(F.min("at").alias("first"), F.max("at").alias("last"), F.count(F.lit(1)).alias("minutes")).drop("__i")


def recoveries(rows: DataFrame, notices: DataFrame, within_s: int = 900, late_s: float = 1.0) -> DataFrame:
    """(instance_id, noticed_at, start, end, minutes_without_decisions, decided, decided_late): for every notice
    after which the stream stopped within `within_s`, the window up to the first minute at or after the stop
    from which it stayed caught up. Notices are events of operation, few; each meets its instance's minutes."""
    w = W.partitionBy("instance_id").orderBy("at")
    flags = rows.withColumn("__cu", caught_up())
    sustained = F.col("__cu")
    for k in range(1, SUSTAIN):
        sustained = sustained & F.coalesce(F.lead("__cu", k).over(w), F.lit(False))
    flags = flags.withColumn("__ok", sustained)
    n = notices.select("instance_id", "noticed_at", F.date_trunc("minute", "noticed_at").alias("start"))
    after = n.join(flags, "instance_id").where(F.col("at") >= F.col("start"))
    stop = F.min(F.when(~F.col("__cu") & (F.unix_timestamp("at") < F.unix_timestamp("start") + within_s), F.col("at")))
    by = W.partitionBy("instance_id", "noticed_at")
    seen = after.withColumn("__stop", stop.over(by)).where(F.col("__stop").isNotNull())
    end = F.min(F.when(F.col("__ok") & (F.col("at") >= F.col("__stop")), F.col("at")))
    seen = seen.withColumn("end", end.over(by)).where(F.col("end").isNull() | (F.col("at") < F.col("end")))
    return seen.groupBy("instance_id", "noticed_at", "start", "end").agg(
        F.count_if(F.col("decisions") <= 0).alias("minutes_without_decisions"), F.sum("decisions").alias("decided"), F.sum(over_bound(F.col("buckets"), late_s)).alias("decided_late")
    )


def over_bound(buckets: Column, bound: float) -> Column:
    """How many observations lie above a bound: the total less the count at the highest bound up to it."""
    total = F.coalesce(F.try_element_at(buckets, F.lit(float("inf"))), F.lit(0.0))
    under = F.array_max(F.transform(F.filter(F.map_entries(buckets), lambda e: e["key"] <= bound), lambda e: e["value"]))
    return F.when(buckets.isNotNull(), F.greatest(total - F.coalesce(under, F.lit(0.0)), F.lit(0.0))).otherwise(0.0)


def merged_histograms(rows: DataFrame, groups: Sequence[str]) -> DataFrame:
    """(groups, le, count): cumulative counts over all bounds that occur in the group.

    A minute is a step function that rises at its own bounds, so the sum at any bound is the sum of the
    rises up to it: minutes need not be spread over all bounds. A falling count rises by nothing."""
    steps = F.array_sort(F.map_entries("buckets"))
    rise = F.aggregate(
        "__e",
        F.struct(F.lit(0.0).alias("c"), F.array().cast("array<struct<le:double,rise:double>>").alias("o")),
        lambda a, e: F.struct(F.greatest(a["c"], e["value"]).alias("c"), F.concat(a["o"], F.array(F.struct(e["key"].alias("le"), F.greatest(e["value"] - a["c"], F.lit(0.0)).alias("rise")))).alias("o")),
        lambda a: a["o"],
    )
    rises = rows.where(F.col("buckets").isNotNull()).withColumn("__e", steps).select(*groups, F.inline(rise))
    by = rises.groupBy(*groups, "le").agg(F.sum("rise").alias("rise"))
    upto = W.partitionBy(*groups).orderBy("le").rowsBetween(W.unboundedPreceding, 0)
    return by.select(*groups, "le", F.sum("rise").over(upto).alias("count"))


def histogram_quantiles(merged: DataFrame, groups: Sequence[str], qs: dict[str, float]) -> DataFrame:
    """(groups, total, and each quantile): linear within a bucket, the first from zero; above the highest finite
    bound, that bound; null without observations."""
    w = W.partitionBy(*groups).orderBy("le")
    inf = float("inf")
    total = F.max(F.when(F.col("le") == inf, F.col("count"))).over(W.partitionBy(*groups))
    rows = merged.withColumns({"__lo": F.coalesce(F.lag("le").over(w), F.lit(0.0)), "__c0": F.coalesce(F.lag("count").over(w), F.lit(0.0)), "__total": total})
    out = []
    for name, q in qs.items():
        rank = F.lit(q) * F.col("__total")
        inside = F.col("__lo") + (F.col("le") - F.col("__lo")) * F.try_divide(rank - F.col("__c0"), F.col("count") - F.col("__c0"))
        value = F.when(F.col("le") == inf, F.col("__lo")).when(F.col("count") == F.col("__c0"), F.col("le")).otherwise(inside)
        out.append(F.min_by(F.when(F.col("__total") > 0, value), F.when(F.col("count") >= rank, F.col("le"))).alias(name))
    return rows.groupBy(*groups).agg(F.coalesce(F.max("__total"), F.lit(0.0)).alias("total"), *out)


def daily_rows(rows: DataFrame, budget_s: float = 0.05) -> DataFrame:
    """(day, minutes, decisions, peak_per_second, uptime, idle_minutes, over_budget_share) over all instances."""
    day = F.date_format("at", "yyyy-MM-dd").alias("day")
    per_minute = rows.groupBy(day, "at").agg(F.sum("decisions").alias("d"), F.sum(over_bound(F.col("buckets"), budget_s)).alias("over"), F.sum(F.coalesce(F.try_element_at("buckets", F.lit(float("inf"))), F.lit(0.0))).alias("n"))
    return per_minute.groupBy("day").agg(
        F.count(F.lit(1)).alias("minutes"), F.sum("d").alias("decisions"), (F.max("d") / 60).alias("peak_per_second"), (F.count_if(F.col("d") > 0) / F.count(F.lit(1))).alias("uptime"),
        F.count_if(F.col("d") <= 0).alias("idle_minutes"), F.try_divide(F.sum("over"), F.sum("n")).alias("over_budget_share"),
    )


def serving(rows: DataFrame, windows: DataFrame) -> DataFrame:
    """rows outside every recovery window (start up to, not including, end; a null end never ends)."""
    w = windows.select(F.col("instance_id").alias("__i"), F.col("start").alias("__a"), F.col("end").alias("__b"))
    inside = (F.col("instance_id") == F.col("__i")) & (F.col("at") >= F.col("__a")) & (F.col("__b").isNull() | (F.col("at") < F.col("__b")))
    return rows.join(w, inside, "left_anti")


def availability(rows: DataFrame, notices: DataFrame, qs: dict[str, float], within_s: int = 900) -> DataFrame:
    """(scope, minutes, total, quantiles): latency over every minute, and over the minutes while serving."""
    out = None
    for scope, part in (("every", rows), ("serving", serving(rows, recoveries(rows, notices, within_s)))):
        tagged = part.withColumn("scope", F.lit(scope))
        n = tagged.groupBy("scope").agg(F.count(F.lit(1)).alias("minutes"), (F.count_if(F.col("decisions") > 0) / F.count(F.lit(1))).alias("uptime"))
        got = n.join(histogram_quantiles(merged_histograms(tagged, ["scope"]), ["scope"], qs), "scope", "left")
        out = got if out is None else out.unionByName(got)
    return out


_RANGE = "struct<data:struct<result:array<struct<metric:map<string,string>,values:array<array<string>>>>>>"


def minutes_of_ranges(results: DataFrame, instance: str) -> DataFrame:
    """Minutes from a monitoring server's range-query documents: (name, json), name one of decisions, sent,
    feed_lag, buckets. A value that is no number is missing."""
    series = results.select("name", F.inline(F.from_json("json", _RANGE)["data"]["result"]))
    points = series.select("name", F.try_element_at("metric", F.lit("le")).alias("le"), F.explode("values").alias("p"))
    number = lambda c: F.when(F.lower(c).isin("+inf", "inf"), float("inf")).otherwise(c.try_cast("double"))
    rows = points.select("name", number(F.col("le")).alias("le"), F.timestamp_seconds(F.col("p")[0].try_cast("double").cast("long")).alias("minute_at"), number(F.col("p")[1]).alias("v"))
    of = lambda n: F.max(F.when(F.col("name") == n, F.col("v"))).alias(n)
    bound = F.when((F.col("name") == "buckets") & F.col("le").isNotNull() & F.col("v").isNotNull(), F.struct("le", "v"))
    return rows.groupBy("minute_at").agg(of("decisions"), of("sent"), of("feed_lag"), F.map_from_entries(F.array_sort(F.collect_set(bound))).alias("buckets")).withColumn("instance_id", F.lit(instance))
