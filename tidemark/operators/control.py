"""What follows from verdicts and finished days: requests, candidates, replays, gates, alerts and their state.

Days, requests and models are few; the functions still are plans over tables, so that they run where the
tables lie. Times of day-long facts are dates.

Defined cases: a request without quantities was opened by hand and no end of drift closes it; a candidate,
replay or gate that was told before is judged by what was told; empty tables give no rows; a null day is
no day.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemark.functions.times import HOUR
from tidemark.operators import drift, metrics
from tidemark.operators.ordered import exact_percentiles
from tidemark.session import FileStore

#: Days that make a candidate, a drift's candidate, a later one, a fit, a replay and a gate.
MIN_DAYS, DRIFT_DAYS, NEW_DAYS, FIT_DAYS, REPLAY_DAYS, SHADOW_DAYS = 3, 2, 3, 14, 2, 7
#: Fixed value: how often a firing alert is told again.
REMIND = 6 * HOUR


def first_trigger(verdicts: DataFrame) -> DataFrame:
    """(day, quantities, days_judged) of the first day that opens a request, asked day by day; no row without one."""
    judged = verdicts.select("day").distinct()
    first = drift.triggers(verdicts).orderBy("day").limit(1)
    return first.join(judged.select(F.col("day").alias("__j")), F.col("__j") <= F.col("day")).groupBy("day", "quantities").agg(F.count(F.lit(1)).alias("days_judged"))


def recent_days(days: DataFrame, n: int = FIT_DAYS) -> DataFrame:
    """The n latest distinct days, a top-n."""
    return days.where(F.col("day").isNotNull()).select("day").distinct().orderBy(F.desc("day")).limit(n)


def head(rows: DataFrame, order: Sequence[str | Column], n: int) -> DataFrame:
    """The first n rows in a stated order: a report's examples are the same in every run."""
    return rows.orderBy(*order).limit(n)


def replayed_rows(rows: DataFrame, version: str, champion: str | None = None) -> DataFrame:
    """Rows that a candidate may be replayed on: decided by another model (or by that champion)."""
    other = rows.where(F.col("champion_version") != version)
    return other if champion is None else other.where(F.col("champion_version") == champion)


def merged_streams(streams: Mapping[str, DataFrame], time: str, order: Sequence[str]) -> DataFrame:
    """Streams of one schema as one log, with `stream` and `seq`, the place in order of (time, stream, order).

    Numbered in two levels, inside hours and over hours, so no task holds the log."""
    from tidemark.sources.tables import numbered

    out = None
    for name, rows in streams.items():
        part = rows.where(F.col(time).isNotNull()).withColumn("stream", F.lit(name))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return numbered(out, F.floor(F.unix_micros(time) / HOUR), [time, "stream", *order])


def load_summary(rows: DataFrame, run: str, kind: str, value: str, qs: Mapping[str, float]) -> DataFrame:
    """(kind, quantile, n, mean, low, high): each run's exact percentiles, and over the runs their mean with a 95 %
    t interval; low and high are null for a single run."""
    per_run = exact_percentiles(rows, [run, kind], value, list(qs.values()))
    each = per_run.select(kind, F.inline(F.array(*[F.struct(F.lit(name).alias("quantile"), F.col("q")[i].alias("v")) for i, name in enumerate(qs)])))
    return metrics.t_interval(each, [kind, "quantile"], "v")


def candidates_due(requests: DataFrame, finalised: DataFrame, candidates: DataFrame) -> DataFrame:
    """(request, days): the days to fit and test on for each open request that is due. requests: request,
    drift_began (null if opened by hand); finalised: day; candidates: request, last_day of earlier ones."""
    days = finalised.where(F.col("day").isNotNull()).select("day").distinct()
    told = candidates.groupBy("request").agg(F.max("last_day").alias("last_day"))
    open_ = requests.join(told, "request", "left")
    met = open_.join(days).groupBy("request", "drift_began", "last_day").agg(F.array_sort(F.collect_list("day")).alias("all"))
    after = lambda c, strict: F.size(F.filter("all", (lambda x: x > c) if strict else (lambda x: x >= c)))
    due = (
        (F.size("all") >= MIN_DAYS)
        & (F.col("drift_began").isNull() | (after(F.col("drift_began"), False) >= DRIFT_DAYS + 1))
        & (F.col("last_day").isNull() | (after(F.col("last_day"), True) >= NEW_DAYS))
    )
    return met.where(due).select("request", F.slice("all", F.greatest(F.size("all") - (FIT_DAYS - 1), F.lit(1)), FIT_DAYS).alias("days"))


def replays_due(candidates: DataFrame, finalised: DataFrame, replays: DataFrame) -> DataFrame:
    """(version, days): finalised days after a candidate's last, once they are enough, if it was never replayed."""
    asked = candidates.join(replays.select("version").distinct(), "version", "left_anti")
    days = finalised.where(F.col("day").isNotNull()).select("day").distinct()
    after = asked.join(days, F.col("day") > F.col("last_day")).groupBy("version").agg(F.array_sort(F.collect_list("day")).alias("days"))
    return after.where(F.size("days") >= REPLAY_DAYS)


def gates_due(shadows: DataFrame, verdicts: DataFrame) -> DataFrame:
    """(version): shadows worth a verdict now. shadows: version, days_scored, eligible_now; verdicts: version, eligible."""
    told = verdicts.groupBy("version").agg(F.bool_or("eligible").alias("__was"), F.count(F.lit(1)).alias("__told"))
    first = F.col("__told").isNull()
    return shadows.join(told, "version", "left").where((F.col("days_scored") >= SHADOW_DAYS) & (first | (F.col("eligible_now") & ~F.col("__was")))).select("version")


def drift_coverage(requests: DataFrame, last_trained: str = "last_trained") -> DataFrame:
    """requests with covers_the_drift and days_short: whether training reached the first drifted day. Null for one
    opened by hand (first_drifted null)."""
    first, last = F.col("first_drifted"), F.to_date(last_trained)
    return requests.withColumns({"covers_the_drift": last >= first, "days_short": F.greatest(F.lit(0), F.datediff(first, last)).cast("int")}).withColumn(
        "days_short", F.when(first.isNotNull(), F.col("days_short"))
    )


def request_states(requests: DataFrame, verdicts: DataFrame, answered: DataFrame) -> DataFrame:
    """(request, state): answered if a candidate beat the incumbent; drift-ended if the last two judged days after it
    opened are adjacent and clean of its quantities; else still-open. answered: request."""
    beat = answered.select("request").distinct().withColumn("__beat", F.lit(True))
    named = requests.select("request", "opened_on", F.explode_outer("quantities").alias("quantity"))
    after = verdicts.select(F.col("quantity").alias("__q"), "day", "status")
    days = requests.select("request", "opened_on").join(after.select("day").distinct(), F.col("day") > F.col("opened_on"))
    last = days.withColumn("__k", F.row_number().over(W.partitionBy("request").orderBy(F.desc("day")))).where("__k <= 2")
    adjacent = last.groupBy("request").agg(((F.count(F.lit(1)) == 2) & (F.datediff(F.max("day"), F.min("day")) == 1)).alias("__adjacent"))
    judged = last.join(named.drop("opened_on"), "request").where(F.col("quantity").isNotNull()).join(after.withColumnRenamed("day", "__day"), (F.col("quantity") == F.col("__q")) & (F.col("day") == F.col("__day")), "left")
    clean = judged.groupBy("request").agg(F.every(~F.coalesce(F.col("status"), F.lit("insufficient")).isin("drifted", "insufficient")).alias("__clean"))
    both = requests.select("request").join(beat, "request", "left").join(adjacent, "request", "left").join(clean, "request", "left")
    ended = F.coalesce(F.col("__adjacent") & F.col("__clean"), F.lit(False))
    return both.select("request", F.when(F.col("__beat"), "answered").when(ended, "drift-ended").otherwise("still-open").alias("state"))


def alert_messages(polls: DataFrame, remind: int = REMIND) -> DataFrame:
    """(alert, us, message): fire at the first poll of a run of firing ones, remind every `remind` micros while it
    lasts, resolve at the first poll after it. polls: alert, us, firing."""
    w = W.partitionBy("alert").orderBy("us")
    marked = polls.withColumns({"__was": F.coalesce(F.lag("firing").over(w), F.lit(False)), "__run": F.sum(F.when(F.col("firing"), 0).otherwise(1)).over(w)})
    runs = marked.where("firing").groupBy("alert", "__run").agg(F.min("us").alias("a"), F.max("us").alias("b"))
    fires = runs.select("alert", F.col("a").alias("us"), F.lit("fire").alias("message"))
    reminds = runs.where(F.col("b") >= F.col("a") + remind).select("alert", F.explode(F.sequence(F.col("a") + remind, F.col("b"), F.lit(remind))).alias("us"), F.lit("remind").alias("message"))
    resolves = marked.where(~F.col("firing") & F.col("__was")).select("alert", "us", F.lit("resolve").alias("message"))
    return fires.unionByName(reminds).unionByName(resolves)


def refuse_stale(queries: DataFrame, at: str, clock: int) -> DataFrame:
    """queries, as they are if none asks for a moment before the engine's clock (micros); else an error: state that
    has moved on can't answer for the past, `features.as_of_values` over stored rows can."""
    checked = F.when(F.col(at) < clock, F.raise_error(F.concat(F.lit("asked for the past: "), F.col(at).cast("string")))).otherwise(F.col(at))
    return queries.withColumn(at, checked.cast(queries.schema[at].dataType))


class StateTables:
    """Small append-only tables under `root`, such as judged days, requests, candidates, verdicts and reference
    values: `name/batch=B`, a batch replacing itself when written again."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.store = spark, root.rstrip("/"), FileStore(spark, root)

    def append(self, name: str, batch: str, rows: DataFrame) -> None:
        rows.write.mode("overwrite").parquet(f"{self.root}/{name}/batch={batch}")

    def read(self, name: str) -> DataFrame | None:
        folders = [f"{self.root}/{name}/{b}" for b in self.store.list(name) if self.store.exists(f"{name}/{b}/_SUCCESS")]
        return self.spark.read.parquet(*folders) if folders else None

    def latest(self, name: str, key: Sequence[str], order: str) -> DataFrame | None:
        """Each key's newest record; ties go to the greatest remaining columns."""
        rows = self.read(name)
        if rows is None:
            return None
        best = rows.groupBy(*key).agg(F.max(F.struct(order, *[c for c in rows.columns if c not in (*key, order)])).alias("b"))
        return best.select(*key, "b.*")


def watch(state: StateTables, verdicts: DataFrame, batch: str) -> DataFrame:
    """One pass of the drift watch: files the verdicts of days that were not judged before, then opens a request for
    each new trigger day while none is open. Returns the requests filed in this pass."""
    known = state.read("days")
    fresh = verdicts if known is None else verdicts.join(known.select("day").distinct(), "day", "left_anti")
    state.append("days", batch, fresh)
    days, requests = state.read("days"), state.read("requests")
    hits = drift.triggers(days).join(fresh.select("day").distinct(), "day", "left_semi")
    if requests is not None:
        open_ = request_states(requests, days, requests.where("false")).where("state = 'still-open'")
        hits = hits.join(open_.agg(F.count(F.lit(1)).alias("__open")).where("__open > 0"), F.lit(True), "left_anti")
    new = hits.orderBy("day").limit(1).select(F.date_format("day", "yyyy-MM-dd").alias("request"), F.col("day").alias("opened_on"), "quantities")
    state.append("requests", batch, new)
    return state.read("requests").join(fresh.select("day").distinct(), F.col("opened_on") == F.col("day"), "left_semi")
