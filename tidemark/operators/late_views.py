"""Per-period aggregates by event time, corrected as late records arrive, up to a cut-off.

Two layers keep one view (`LambdaView`). The fast layer takes each delivery in as it comes: records of
periods that are still provisional (up to `grace` after their end) are added to increments, later ones are
left to the batch layer, and what comes after `cutoff`, or to a frozen period, is refused. The batch layer
runs on a schedule: it recomputes each period that is closed to the fast layer and still open from the full
log, replaces the period's row, and freezes it at the first run after `cutoff`.

Records are distinct already (see `earliest_arrivals`).

Defined cases: an arrival exactly at a limit is within it; a record without event time or arrival
time belongs to no period and appears in no view; a null amount adds nothing but its record counts;
an arrival before its event is an early arrival and on time; an empty log gives empty views.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.types import StructType

from tidemark.functions.times import DAY, HOUR, MINUTE, floor_to, micros
from tidemark.session import FileStore, scratch_path

FAST, BATCH, REFUSED = "fast", "batch", "refused"


@dataclass(frozen=True)
class LatePolicy:
    """Lengths in microseconds: the period, and after its end the provisional and the open time."""

    period: int
    grace: int
    cutoff: int
    every: int = HOUR

    def __post_init__(self):
        if self.period <= 0 or self.every <= 0 or not 0 <= self.grace <= self.cutoff:
            raise ValueError("a period and a schedule are positive, and 0 <= grace <= cutoff")


HOURLY_DECISIONS = LatePolicy(period=HOUR, grace=10 * MINUTE, cutoff=24 * HOUR)
DAILY_LABELS = LatePolicy(period=DAY, grace=7 * DAY, cutoff=7 * DAY + 6 * HOUR, every=6 * HOUR)


def placed(log: DataFrame, policy: LatePolicy, event_time: str, arrival: str) -> DataFrame:
    """The log's rows with __start (the period, micros), __at (arrival, micros) and __lane.

    __lane is the layer that takes the row in: fast, batch or refused; null if a time is missing."""
    start = floor_to(micros(event_time), policy.period)
    end = F.col("__start") + policy.period
    lane = (
        F.when(F.col("__at") <= end + policy.grace, FAST)
        .when(F.col("__at") <= end + policy.cutoff, BATCH)
        .when(F.col("__at").isNotNull() & F.col("__start").isNotNull(), REFUSED)
    )
    return log.withColumns({"__start": start, "__at": micros(arrival)}).withColumn("__lane", lane)


def late_outcomes(log: DataFrame, policy: LatePolicy, event_time: str, arrival: str) -> DataFrame:
    """The rule in closed form, as an oracle for the layers: rows that the fast layer's view lacks, with
    `outcome`: corrected by a recompute, or refused."""
    rows = placed(log, policy, event_time, arrival).where(F.col("__lane").isin(BATCH, REFUSED))
    return rows.withColumn("outcome", F.when(F.col("__lane") == BATCH, "corrected").otherwise("refused"))


def _sums(measures: dict[str, Column], on: Column) -> list[Column]:
    return [F.coalesce(F.sum(F.when(on, m)), F.lit(0)).alias(name) for name, m in measures.items()]


def final_views(log: DataFrame, policy: LatePolicy, event_time: str, arrival: str, measures: dict[str, Column]) -> DataFrame:
    """One row per period: the frozen sums, the provisional ones as first shown, and the refused records, in
    closed form over a whole log.

    measures: name -> whole-number column to be summed (a literal 1 counts)."""
    lane = F.col("__lane")
    provisional = {f"provisional_{k}": v for k, v in measures.items()}
    return (
        placed(log, policy, event_time, arrival)
        .where(lane.isNotNull())
        .groupBy("__start")
        .agg(
            *_sums(measures, lane != REFUSED),
            *_sums(provisional, lane == FAST),
            F.count_if(lane == BATCH).alias("n_corrections"),
            F.count_if(lane == REFUSED).alias("n_refused"),
        )
    )


def view_versions(log: DataFrame, policy: LatePolicy, event_time: str, arrival: str, measures: dict[str, Column]) -> DataFrame:
    """Each period's row as every scheduled run that changed or froze it left it.

    A run at moment r takes in what arrived up to r (and up to the period's cut-off), so an arrival
    belongs to the first run at or after it. Increments are summed by period and run before the
    shuffle; the running sum over a period's runs, at most (period + cutoff) / every of them, equals a
    recompute from the log at each run."""
    run = F.ceil(F.col("__at") / F.lit(policy.every)).cast("long") * policy.every
    due = F.col("__start") + policy.period + policy.cutoff
    frozen_at = (F.floor(due / F.lit(policy.every)).cast("long") + 1) * policy.every
    rows = placed(log, policy, event_time, arrival).where(F.col("__lane").isin(FAST, BATCH))
    per_run = (
        rows.withColumn("__run", F.least(F.greatest(run, F.col("__start") + policy.every), frozen_at))
        .groupBy("__start", "__run")
        .agg(*_sums(measures, F.lit(True)))
    )
    freeze = per_run.groupBy("__start").agg(frozen_at.alias("__run"), *[F.lit(0).cast("long").alias(m) for m in measures])
    both = per_run.select("__start", "__run", *measures).unionByName(freeze.select("__start", "__run", *measures))
    merged = both.groupBy("__start", "__run").agg(*[F.sum(m).alias(m) for m in measures])
    upto = W.partitionBy("__start").orderBy("__run").rowsBetween(W.unboundedPreceding, 0)
    return merged.withColumns({m: F.sum(m).over(upto) for m in measures}).withColumn("frozen", F.col("__run") == frozen_at)


def earliest_arrivals(rows: DataFrame, key: str, arrival: str, fixed: Sequence[str]) -> DataFrame:
    """One row per key at its earliest arrival. `fixed` are fixed-width columns equal in all copies.

    Copies are combined before the shuffle, so a key with a third of all rows is no hot spot. Rows
    without a key can't be told to be copies: each is kept."""
    alone = F.when(F.col(key).isNull(), F.monotonically_increasing_id()).alias("__alone")
    return rows.groupBy(key, alone).agg(F.min(arrival).alias(arrival), *[F.min(c).alias(c) for c in fixed]).drop("__alone")


class LambdaView:
    """The two layers on storage, under `root`:

    `log/batch=N`         the deliveries' rows with __start, __at and __lane, the layer that took each in
    `fast/batch=N`        the increments of a delivery, one row per provisional period in it
    `runs/run=R/frozen=F` the periods that run R recomputed; those frozen are written once and never again
    `CURRENT`             the last run's moment, all runs, and the fast batches that still count

    CURRENT is renamed into place last, so a lost executor or a rerun leaves no half-written view; a delivery
    or a run that is there already isn't taken in again. Periods lie in the log as a plain column, so a run
    reads the deliveries that hold open periods and leaves out the rest by their statistics."""

    def __init__(self, spark: SparkSession, root: str, policy: LatePolicy, event_time: str, arrival: str, measures: dict[str, Column]):
        self.spark, self.root, self.policy = spark, root.rstrip("/"), policy
        self.event_time, self.arrival, self.measures = event_time, arrival, measures
        self.store = FileStore(spark, self.root)

    def _state(self) -> dict:
        return json.loads(self.store.read("CURRENT") or '{"as_of": null, "runs": [], "fast": {}}')

    def _is_frozen(self, as_of: int) -> Column:
        return F.col("__start") + (self.policy.period + self.policy.cutoff) < as_of

    def _is_provisional(self, as_of: int) -> Column:
        return F.col("__start") >= as_of - self.policy.period - self.policy.grace

    def add(self, batch_id: int, rows: DataFrame) -> None:
        """Fast layer: takes one delivery in. A batch_id that was taken in before changes nothing."""
        state, name = self._state(), str(batch_id)
        if name in state["fast"]:
            return
        lane = F.col("__lane")
        if state["as_of"] is not None:
            lane = F.when(self._is_frozen(state["as_of"]), REFUSED).otherwise(lane)
        taken = placed(rows, self.policy, self.event_time, self.arrival).where("__lane IS NOT NULL").withColumn("__lane", lane)
        taken.write.mode("overwrite").parquet(f"{self.root}/log/batch={batch_id}")
        state["schema"] = taken.schema.jsonValue()
        log = self.spark.read.schema(taken.schema).parquet(f"{self.root}/log/batch={batch_id}")
        seen = Observation()
        increments = log.where(F.col("__lane") == FAST).groupBy("__start").agg(*_sums(self.measures, F.lit(True)))
        increments.coalesce(1).observe(seen, F.max("__start").alias("newest")).write.mode("overwrite").parquet(f"{self.root}/fast/batch={batch_id}")
        state["fast"][name] = seen.get["newest"]
        self.store.publish("CURRENT", json.dumps(state))

    def log(self) -> DataFrame | None:
        """All deliveries' rows, with `batch`, __start, __at and __lane."""
        state = self._state()
        if not state["fast"]:
            return None
        schema = StructType.fromJson(state["schema"]).add("batch", "long")
        return self.spark.read.schema(schema).parquet(f"{self.root}/log")

    def recompute(self, as_of: int) -> None:
        """Batch layer at moment as_of (micros), on or off the schedule: periods closed to the fast layer and
        not frozen by an earlier run come anew from the log as it stood at as_of, those past the cut-off for
        the last time. Runs go forward; a run that was published before changes nothing."""
        state = self._state()
        last = state["as_of"]
        if last is not None and as_of <= last:
            if as_of < last and as_of not in state["runs"]:
                raise ValueError(f"a run at {as_of} after one at {last}")
            return
        log = self.log()
        if log is not None:
            lane = F.col("__lane")
            rows = log.where((lane != REFUSED) & (F.col("__at") <= as_of) & ~self._is_provisional(as_of))
            if last is not None:
                rows = rows.where(F.col("__start") >= last - self.policy.period - self.policy.cutoff)
            provisional = {f"provisional_{k}": v for k, v in self.measures.items()}
            fresh = rows.groupBy("__start").agg(
                *_sums(self.measures, F.lit(True)), *_sums(provisional, lane == FAST), F.count_if(lane == BATCH).alias("n_corrections")
            )
            fresh.coalesce(1).withColumn("frozen", self._is_frozen(as_of)).write.partitionBy("frozen").mode("overwrite").parquet(f"{self.root}/runs/run={as_of}")
            state["runs"].append(as_of)
        state["as_of"] = as_of
        self.store.publish("CURRENT", json.dumps(state))

    def _runs(self, frozen: bool, runs: Sequence[int]) -> DataFrame:
        """The periods that the runs named left frozen, or open."""
        kinds = ", ".join(["__start BIGINT", *[f"{p}{m} BIGINT" for p in ("", "provisional_") for m in self.measures], "n_corrections BIGINT"])
        there = [p for p in (f"runs/run={r}/frozen={str(frozen).lower()}" for r in runs) if self.store.exists(p)]
        read = self.spark.read.schema(kinds)
        rows = read.parquet(*[f"{self.root}/{p}" for p in there]) if there else self.spark.createDataFrame([], kinds)
        return rows.withColumn("frozen", F.lit(frozen))

    def frozen(self) -> DataFrame:
        """(__start, measures, provisional_measures, n_corrections, frozen) of all frozen periods."""
        return self._runs(True, self._state()["runs"])

    def corrections(self) -> DataFrame:
        """The log's rows by which frozen periods differ from what the fast layer had shown of them."""
        log = self.log()
        if log is None:
            raise ValueError("no batch has been added")
        changed = self.frozen().where("n_corrections > 0").select("__start")
        return log.where(F.col("__lane") == BATCH).join(changed, "__start", "left_semi")

    def refused(self) -> DataFrame:
        """The log's rows that came after the cut-off, or to a frozen period."""
        log = self.log()
        if log is None:
            raise ValueError("no batch has been added")
        return log.where(F.col("__lane") == REFUSED)

    def view(self) -> DataFrame:
        """(__start, measures, frozen) as served: periods of the batch layer's rows, and for the provisional
        ones the fast layer's increments. No period comes from both. Fast batches without a provisional
        period aren't read."""
        state, names = self._state(), list(self.measures)
        if not state["fast"] and state["as_of"] is None:
            raise ValueError("no batch has been added and no run has been made")
        last = state["as_of"]
        rows = self.frozen().unionByName(self._runs(False, state["runs"][-1:])).select("__start", *names, "frozen")
        reach = None if last is None else last - self.policy.period - self.policy.grace
        counts = [n for n, newest in state["fast"].items() if newest is not None and (reach is None or newest >= reach)]
        if not counts:
            return rows
        kinds = ", ".join(["__start BIGINT", *[f"{m} BIGINT" for m in names]])
        fast = self.spark.read.schema(kinds).parquet(*[f"{self.root}/fast/batch={n}" for n in counts])
        if last is not None:
            fast = fast.where(self._is_provisional(last))
        return rows.unionByName(fast.groupBy("__start").agg(*[F.sum(m).alias(m) for m in names]).withColumn("frozen", F.lit(False)))


def replay(view: LambdaView, rows: DataFrame, step: int) -> LambdaView:
    """Feeds rows to the view in the order of their arrival, in deliveries of `step` microseconds, with a run of
    the batch layer after each, and one at the end by which every period is frozen."""
    spark, path = rows.sparkSession, scratch_path(rows.sparkSession, "deliveries")
    slices = rows.withColumn("__slice", F.floor(micros(view.arrival) / F.lit(step)).cast("long")).where("__slice IS NOT NULL")
    slices.write.partitionBy("__slice").parquet(path)
    numbers = sorted(int(n.split("=")[1]) for n in FileStore(spark, path).list() if n.startswith("__slice="))
    for n in numbers:
        view.add(n, spark.read.schema(rows.schema).parquet(f"{path}/__slice={n}"))
        view.recompute((n + 1) * step - 1)
    if not numbers:
        view.add(0, rows)
        view.recompute(0)
    else:
        newest = view.log().where(F.col("__lane") != REFUSED).agg(F.max("__start")).first()[0]
        if newest is not None:
            view.recompute(max(newest + view.policy.period + view.policy.cutoff + 1, (numbers[-1] + 1) * step))
    return view
