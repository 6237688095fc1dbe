"""From staged decisions and late labels to a kept, weighted sample, and training sets from it.

A draw depends on the event id alone, so rows that no rate could keep are dropped before the label join,
which then moves only candidates. Both sides are reduced to one row per event before they meet: copies
combine before the shuffle, so no event is a hot spot.

Defined cases: rows without event id are left out of the sample; an event without label is excluded and
counted, never read as not fraud; of several labels the earliest counts, ties going to not fraud.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.times import DAY, HOUR, MINUTE, floor_to
from tidemark.operators.decide import APPROVE, draw, stratum
from tidemark.operators.features import first_wins

SALT = "tidemark/history/1:"
TRAIN_SALT = "tidemark/train/1:"


def first_labels(labels: DataFrame, upto: Column | None = None) -> DataFrame:
    """(event_id, label_time, is_fraud, recovered_cents): each event's earliest label."""
    rows = labels.where(F.col("event_id").isNotNull() & F.col("label_time").isNotNull())
    if upto is not None:
        rows = rows.where(F.col("label_time") <= upto)
    return first_wins(rows.select("event_id", "label_time", "is_fraud", "recovered_cents"), "event_id", ["label_time", "is_fraud"])


def could_be_kept(action: Column, key: Column, rates: Mapping[str, float], salt: str = SALT) -> Column:
    """Before the label is known: acted on, or drawn at the largest of the other rates."""
    return (action != APPROVE) | (draw(key, salt) < max(rates["fraud"], rates["legit"]))


def rate_of(which: Column, rates: Mapping[str, float]) -> Column:
    out = F.lit(None).cast("double")
    for name, r in rates.items():
        out = F.when(which == name, F.lit(float(r))).otherwise(out)
    return out


def kept_sample(staged: DataFrame, labels: DataFrame, rates: Mapping[str, float], order: Sequence[str] = ("decided_at",), salt: str = SALT) -> DataFrame:
    """Staged rows, once per event, with the label, stratum and weight, kept with the stratum's rate."""
    candidates = first_wins(staged.where(could_be_kept(F.col("action"), F.col("event_id"), rates, salt)), "event_id", order)
    joined = candidates.join(first_labels(labels), "event_id").withColumn("stratum", stratum(F.col("action"), F.col("is_fraud")))
    rate = rate_of(F.col("stratum"), rates)
    return joined.where(draw(F.col("event_id"), salt) < rate).withColumn("weight", 1.0 / rate)


def manifest(staged: DataFrame, labels: DataFrame, rates: Mapping[str, float], salt: str = SALT) -> DataFrame:
    """One row per event day: staged rows, duplicates, candidates, unlabelled, kept by stratum, estimates.

    Every event counts on its earliest copy's day; one shuffle by event id, then one by day."""
    code = F.col("label_time").isNotNull()
    ev = staged.where(F.col("event_id").isNotNull()).groupBy("event_id").agg(
        F.min("event_time").alias("event_time"), F.count(F.lit(1)).alias("copies"), F.max(F.col("action") != APPROVE).alias("acted")
    )
    rows = ev.join(first_labels(labels), "event_id", "left")
    which = F.when(F.col("acted"), "acted").when(F.col("is_fraud"), "fraud").when(~F.col("is_fraud"), "legit")
    d = draw(F.col("event_id"), salt)
    rows = rows.withColumns({"stratum": F.when(code, which), "__d": d, "candidate": F.col("acted") | (d < max(rates["fraud"], rates["legit"]))})
    rate = rate_of(F.col("stratum"), rates)
    rows = rows.withColumns({"kept": F.coalesce(F.col("candidate") & (F.col("__d") < rate), F.lit(False)), "weight": 1.0 / rate})
    kept = F.col("kept")
    return rows.groupBy(F.date_format("event_time", "yyyy-MM-dd").alias("day")).agg(
        F.sum("copies").alias("staged_rows"),
        F.sum(F.col("copies") - 1).alias("duplicates"),
        F.count_if("candidate").alias("candidates"),
        F.count_if(F.col("candidate") & ~code).alias("unlabelled"),
        *[F.count_if(kept & (F.col("stratum") == s)).alias(f"kept_{s}") for s in ("acted", "fraud", "legit")],
        F.coalesce(F.sum(F.when(kept, F.col("weight"))), F.lit(0.0)).alias("estimated_transactions"),
        F.coalesce(F.sum(F.when(kept & F.col("is_fraud"), F.col("weight"))), F.lit(0.0)).alias("estimated_frauds"),
    )


def hour_states(staged: DataFrame, now: Column, settle: int = 10 * MINUTE) -> DataFrame:
    """Each event hour's rows and whether it may be sealed: ended more than `settle` before now."""
    hour = floor_to(F.unix_micros("event_time"), HOUR)
    rows = staged.where(F.col("event_time").isNotNull()).groupBy(hour.alias("hour_us")).agg(F.count(F.lit(1)).alias("n_rows"))
    return rows.withColumn("closed", F.col("hour_us") + HOUR + settle <= F.unix_micros(now))


def finalisable_days(staged: DataFrame, finalised: DataFrame, now: Column, delay: int = 7 * DAY, grace: int = 6 * HOUR) -> DataFrame:
    """Days whose labels have had their time (end + delay + grace <= now) and that are not finalised yet.
    finalised: (day date)."""
    days = staged.where(F.col("event_time").isNotNull()).groupBy(F.to_date("event_time").alias("day")).agg(F.count(F.lit(1)).alias("n_rows"))
    final = (F.unix_date("day").cast("long") + 1) * DAY + delay + grace
    return days.where(final <= F.unix_micros(now)).join(finalised.select("day"), "day", "left_anti")


def at_cutoff(rows: DataFrame, cutoff: Column) -> DataFrame:
    """Training rows known at a moment: happened before it, labelled by it."""
    return rows.where((F.col("event_time") < cutoff) & (F.col("label_time") <= cutoff))


def split_by_time(rows: DataFrame, share: float = 0.7, wait_for_labels: bool = False) -> DataFrame:
    """rows with `part`: train, test, or null where the label came too late for either. The bounds are one
    row of four numbers."""
    b = rows.agg(F.min("event_time").alias("a"), F.max("event_time").alias("b"), F.max("label_time").alias("l"))
    point = F.timestamp_micros((F.unix_micros("a") + (F.unix_micros("b") - F.unix_micros("a")) * F.lit(share)).cast("long"))
    bounds = b.select(point.alias("__point"), F.timestamp_micros(F.unix_micros("l") + 1).alias("__end"))
    joined = rows.crossJoin(F.broadcast(bounds))
    known = F.col("label_time") <= (F.col("__end") if wait_for_labels else F.col("__point"))
    part = F.when((F.col("event_time") < F.col("__point")) & known, "train").when((F.col("event_time") >= F.col("__point")) & (F.col("label_time") <= F.col("__end")), "test")
    return joined.withColumn("part", part).drop("__point", "__end")


def bounded_rows(rows: DataFrame, targets: Mapping[bool, int], salt: str = TRAIN_SALT) -> DataFrame:
    """rows thinned by hash to about targets[label] per label; weights grow by what thinning took.
    The shares come from one small aggregate."""
    counts = {r.is_fraud: r.n for r in rows.where(F.col("is_fraud").isNotNull()).groupBy("is_fraud").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = {k: min(1.0, targets[k] / counts[k]) if counts.get(k) else 1.0 for k in (True, False)}
    s = F.when(F.col("is_fraud"), F.lit(share[True])).otherwise(F.lit(share[False]))
    return rows.where(F.col("is_fraud").isNotNull() & (draw(F.col("event_id"), salt) < s)).withColumn("weight", F.col("weight") / s)


def scored_beside(rows: DataFrame, shadow: str, champion: str | None = None) -> DataFrame:
    """Rows that a shadow scored beside another champion (or beside that champion)."""
    on = (F.col("shadow_version") == shadow) & F.col("shadow_score").isNotNull() & (F.col("champion_version") != shadow)
    return rows.where(on if champion is None else on & (F.col("champion_version") == champion))


def current_shadow(rows: DataFrame) -> DataFrame:
    """The most common shadow version; ties go to the one seen first, then by name."""
    n = rows.where(F.col("shadow_version").isNotNull()).groupBy("shadow_version").agg(F.count(F.lit(1)).alias("n"), F.min("decided_at").alias("first"))
    return n.orderBy(F.desc("n"), "first", "shadow_version").limit(1).select("shadow_version", "n")
