"""Daily drift of quantities against a reference: bins, PSI, KS, a verdict, and what follows from it.

Values are added up by (day, quantity, value) before they are ordered; reference and days are then
compared by running sums in ranges of values, so neither has to fit one task. Bin edges are at most nine
numbers a quantity.

Defined cases: null and NaN are no values; a day without a quantity's values has 0 of them and is
insufficient; an empty reference judges nothing.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemark.operators.ordered import exact_percentiles, running_sums, value_part
from tidemark.session import written

#: A quantity's verdict.
LEAST_VALUES = 500
PSI_MODERATE, PSI_DRIFTED = 0.10, 0.25
KS_DRIFTED, KS_P = 0.10, 0.01
SHARE_FLOOR = 1e-4
SENTINEL = -1.0


def long_form(rows: DataFrame, day: Column, quantities: dict[str, Column]) -> DataFrame:
    """(day, quantity, value)."""
    each = [F.struct(F.lit(n).alias("quantity"), c.cast("double").alias("value")) for n, c in quantities.items()]
    return rows.select(day.alias("day"), F.inline(F.array(*each))).where(F.col("value").isNotNull() & ~F.isnan("value"))


def counted(values: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, quantity, value, times): values added up, or added up further if they were before."""
    times = F.sum("times") if "times" in values.columns else F.count(F.lit(1))
    return values.groupBy(*keys, "quantity", "value").agg(times.alias("times"))


def bin_edges(reference: DataFrame, bins: int = 10) -> DataFrame:
    """(quantity, edges): distinct inner quantiles of the values other than the sentinel."""
    inner = [i / bins for i in range(1, bins)]
    q = exact_percentiles(counted(reference, []).where(F.col("value") != SENTINEL), ["quantity"], "value", inner, "times")
    return q.select("quantity", F.array_sort(F.array_distinct("q")).alias("edges"))


def bin_of(value: Column, edges: Column) -> Column:
    """How many edges are at or below the value; the sentinel has the bin after the last."""
    return F.when(value == SENTINEL, F.size(edges) + 1).otherwise(F.size(F.filter(edges, lambda e: e <= value)))


def bin_shares(values: DataFrame, edges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, quantity, bin, n, share), one row for every bin, empty or not."""
    # One row a quantity, of at most nine edges.
    placed = values.join(F.broadcast(edges), "quantity")
    n = F.sum("times") if "times" in values.columns else F.count(F.lit(1))
    counts = placed.groupBy(*keys, "quantity", bin_of(F.col("value"), F.col("edges")).alias("bin")).agg(n.alias("n"))
    spine = counts.select(*keys, "quantity").distinct().join(F.broadcast(edges), "quantity")
    spine = spine.select(*keys, "quantity", F.explode(F.sequence(F.lit(0), F.size("edges") + 1)).alias("bin"))
    full = spine.join(counts, [*keys, "quantity", "bin"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return full.withColumn("share", F.col("n") / F.sum("n").over(W.partitionBy(*keys, "quantity")))


def psi(reference: DataFrame, current: DataFrame, edges: DataFrame) -> DataFrame:
    """(day, quantity, psi)."""
    expected = bin_shares(reference, edges, []).select("quantity", "bin", F.greatest("share", F.lit(SHARE_FLOOR)).alias("e"))
    actual = bin_shares(current, edges, ["day"]).withColumn("a", F.greatest("share", F.lit(SHARE_FLOOR)))
    both = actual.join(expected, ["quantity", "bin"])
    return both.groupBy("day", "quantity").agg(F.sum((F.col("a") - F.col("e")) * F.ln(F.col("a") / F.col("e"))).alias("psi"))


def kolmogorov_q(x: Column) -> Column:
    """The chance of a scaled statistic above x."""
    terms = F.aggregate(F.sequence(F.lit(1), F.lit(100)), F.lit(0.0), lambda s, k: s + F.when(k % 2 == 1, 2.0).otherwise(-2.0) * F.exp(-2.0 * k * k * x * x))
    return F.when(x < 1e-3, 1.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), terms)))


def ks(reference: DataFrame, current: DataFrame) -> DataFrame:
    """(day, quantity, n, n_reference, ks, ks_p). The largest gap lies at a value of the day or just before it:
    between two of its values the day's share stands still and the reference's only grows."""
    ref = counted(reference, []).withColumnRenamed("times", "r")
    cur = counted(current, ["day"]).withColumnRenamed("times", "c")
    no_day = F.lit(None).cast(dict(current.dtypes)["day"])
    both = ref.select(no_day.alias("day"), "quantity", "value", "r", F.lit(0).cast("long").alias("c")).unionByName(cur.select("day", "quantity", "value", F.lit(0).cast("long").alias("r"), "c"))
    both = written(both.withColumn("__p", value_part(F.col("value"))), "ks")
    # The same partitioning and order as the running sums', so no exchange of its own.
    own = F.sum("r").over(W.partitionBy("quantity", "__p").orderBy("value").rangeBetween(0, 0))
    seen = running_sums(both.withColumn("own", own), ["quantity"], "__p", "value", {"r_upto": "r"}).where(F.col("day").isNotNull())
    seen = running_sums(written(seen, "ks"), ["day", "quantity"], "__p", "value", {"c_upto": "c"})
    n_ref = ref.groupBy("quantity").agg(F.sum("r").alias("n_reference"))
    n_cur = cur.groupBy("day", "quantity").agg(F.sum("c").alias("n"))
    s = seen.join(n_cur, ["day", "quantity"]).join(n_ref, "quantity")
    at = F.abs(F.col("r_upto") / F.col("n_reference") - F.col("c_upto") / F.col("n"))
    under = F.abs((F.col("r_upto") - F.col("own")) / F.col("n_reference") - (F.col("c_upto") - F.col("c")) / F.col("n"))
    g = s.groupBy("day", "quantity").agg(F.max("n").alias("n"), F.max("n_reference").alias("n_reference"), F.max(F.greatest(at, under)).alias("ks"))
    size = F.sqrt(F.col("n") * F.col("n_reference") / (F.col("n") + F.col("n_reference")))
    return g.withColumn("ks_p", kolmogorov_q((size + 0.12 + 0.11 / size) * F.col("ks")))


def judged(reference: DataFrame, current: DataFrame, days: DataFrame, quantities: Sequence[str], least: int = LEAST_VALUES) -> DataFrame:
    """(day, quantity, n, psi, ks, ks_p, status) for every day and quantity. Values are added up once and stored;
    bins, PSI and KS all start from the sums."""
    reference, current = written(counted(reference, []), "reference"), written(counted(current, ["day"]), "current")
    edges = written(bin_edges(reference), "edges")
    spine = days.select("day", F.explode(F.array(*[F.lit(q) for q in quantities])).alias("quantity"))
    found = spine.join(psi(reference, current, edges), ["day", "quantity"], "left").join(ks(reference, current), ["day", "quantity"], "left")
    n = F.coalesce("n", F.lit(0))
    status = (
        F.when((n < least) | (F.coalesce("n_reference", F.lit(0)) < least), "insufficient")
        .when((F.col("psi") >= PSI_DRIFTED) | ((F.col("ks") >= KS_DRIFTED) & (F.col("ks_p") < KS_P)), "drifted")
        .when(F.col("psi") >= PSI_MODERATE, "moderate")
        .otherwise("stable")
    )
    return found.select("day", "quantity", n.alias("n"), "psi", "ks", "ks_p", status.alias("status"))


def triggers(verdicts: DataFrame) -> DataFrame:
    """(day, quantities): days that complete two adjacent days on which a quantity drifted. day is a date."""
    w = W.partitionBy("quantity").orderBy("day")
    rows = verdicts.withColumns({"__d": F.lag("day").over(w), "__s": F.lag("status").over(w)})
    hit = (F.datediff("day", "__d") == 1) & (F.col("status") == "drifted") & (F.col("__s") == "drifted")
    return rows.where(hit).groupBy("day").agg(F.array_sort(F.collect_set("quantity")).alias("quantities"))


def resolutions(verdicts: DataFrame, requests: DataFrame) -> DataFrame:
    """(request, ended_on): the first day that completes two adjacent days, both after the request opened,
    on which every quantity it names was judged and none drifted. requests: request, opened_on, quantities."""
    named = requests.select("request", "opened_on", F.size("quantities").alias("k"), F.explode("quantities").alias("quantity"))
    days = named.join(verdicts, "quantity").where(F.col("day") > F.col("opened_on"))
    clean = days.groupBy("request", "k", "day").agg(F.count_if(~F.col("status").isin("drifted", "insufficient")).alias("ok")).withColumn("clean", F.col("ok") == F.col("k"))
    w = W.partitionBy("request").orderBy("day")
    pairs = clean.withColumns({"__d": F.lag("day").over(w), "__c": F.lag("clean").over(w)}).where((F.datediff("day", "__d") == 1) & F.col("clean") & F.col("__c"))
    return requests.select("request").join(pairs.groupBy("request").agg(F.min("day").alias("ended_on")), "request", "left")


def runs_of_any(verdicts: DataFrame, requests: DataFrame) -> DataFrame:
    """(request, began): the first day of the run of adjacent days, up to the request's evidence_day, on each
    of which some quantity that it names drifted. requests: request, evidence_day, quantities."""
    named = requests.select("request", "evidence_day", F.explode("quantities").alias("quantity"))
    days = named.join(verdicts.where(F.col("status") == "drifted"), "quantity").where(F.col("day") <= F.col("evidence_day"))
    one = days.select("request", "evidence_day", "day").distinct()
    w = W.partitionBy("request").orderBy(F.desc("day"))
    back = one.withColumn("__k", F.row_number().over(w)).where(F.datediff("evidence_day", "day") == F.col("__k") - 1)
    return requests.select("request", "evidence_day").join(back.groupBy("request").agg(F.min("day").alias("first")), "request", "left").select("request", F.coalesce("first", "evidence_day").alias("began"))


def reference_days(hours: DataFrame, cold: DataFrame, since: Column, count: int = 2, least_hours: int = 20) -> DataFrame:
    """One row at most, (first_day): the earliest `count` adjacent days from `since` on with enough hours and
    no cold start in reach. hours: (day date, n_hours); cold: (started_at), a handful of rows."""
    start, reach = F.unix_timestamp(F.col("day").cast("timestamp")), 25 * 3600
    t = F.unix_timestamp("started_at")
    touched = hours.join(cold, (t > start - reach) & (t < start + 86_400), "left_semi").select("day")
    good = hours.where((F.col("day") >= since) & (F.col("n_hours") >= least_hours)).join(touched, "day", "left_anti")
    w = W.partitionBy().orderBy("day")  # days are few
    ahead = good.withColumn("__n", F.lead("day", count - 1).over(w))
    return ahead.where(F.datediff("__n", "day") == count - 1).agg(F.min("day").alias("first_day")).where(F.col("first_day").isNotNull())
