"""Weighted ranking metrics, decision cost and quality, bootstrap intervals and a promotion gate.

Scores are aggregated by value before anything is ordered. Cumulative sums over scores run in two levels,
in ranges of scores and over range totals, so a ranking of any size has no single-task step.

Defined cases: rows without score or label are left out of ranking metrics and counted where a query
reports counts; a null weight weighs 1; no positives give an average precision of 0; empty denominators
give null.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemark.session import written

#: Edges of the score bands.
BANDS = (0.0, 0.1, 0.2, 0.3, 0.5, 0.7, 0.9, 1.0000001)
RANGES = 4096


def average_precision(rows: DataFrame, label: str, score: str, weight: str, groups: Sequence[str] = ()) -> DataFrame:
    """(groups, n_rows, positives, average_precision): weighted, tied scores being one threshold."""
    w = F.coalesce(F.col(weight).cast("double"), F.lit(1.0))
    used = rows.where(F.col(label).isNotNull() & F.col(score).isNotNull() & ~F.isnan(score))
    by_score = used.groupBy(*groups, F.col(score).alias("__s")).agg(F.count(F.lit(1)).alias("__k"), F.sum(F.when(F.col(label), w).otherwise(0.0)).alias("__tp"), F.sum(w).alias("__all"))
    part = F.floor(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("__s"))) * RANGES).cast("int")
    by_score = by_score.withColumn("__r", part)
    inside = W.partitionBy(*groups, "__r").orderBy(F.desc("__s")).rowsBetween(W.unboundedPreceding, 0)
    above = W.partitionBy(*groups).orderBy(F.desc("__r")).rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy(*groups)
    totals = by_score.groupBy(*groups, "__r").agg(F.sum("__tp").alias("t"), F.sum("__all").alias("a"))
    totals = totals.select(*groups, "__r", F.coalesce(F.sum("t").over(above), F.lit(0.0)).alias("__t0"), F.coalesce(F.sum("a").over(above), F.lit(0.0)).alias("__a0"), F.sum("t").over(whole).alias("__pos"))
    joined = by_score.withColumns({"__ct": F.sum("__tp").over(inside), "__ca": F.sum("__all").over(inside)}).join(totals, [*groups, "__r"])
    precision = (F.col("__ct") + F.col("__t0")) / (F.col("__ca") + F.col("__a0"))
    gain = F.when(F.col("__tp") > 0, F.col("__tp") / F.col("__pos") * precision).otherwise(0.0)
    return joined.groupBy(*groups).agg(F.sum("__k").alias("n_rows"), F.max("__pos").alias("positives"), F.sum(gain).alias("average_precision"))


def row_cost(action: Column, is_fraud: Column, amount: Column, review_cost: float = 500.0, declined_share: float = 0.10) -> Column:
    """Of one row: an approved fraud's amount, a review's cost, a share of a declined good amount."""
    return (
        F.when((action == "approve") & is_fraud, amount).otherwise(0.0)
        + F.when(action == "review", F.lit(review_cost)).otherwise(0.0)
        + F.when((action == "decline") & ~is_fraud, amount * declined_share).otherwise(0.0)
    )


def decision_cost(action: Column, is_fraud: Column, amount: Column, weight: Column, review_cost: float = 500.0, declined_share: float = 0.10) -> Column:
    """An aggregate: the weighted cost of all rows."""
    return F.sum(weight * row_cost(action, is_fraud, amount, review_cost, declined_share))


def quality_measures(weight: Column, acted: Column, fraud: Column) -> list[Column]:
    total = lambda on: F.sum(F.when(on, weight).otherwise(0.0))
    share = lambda a, b: F.try_divide(a, b)
    return [
        F.sum(weight).alias("transactions"),
        share(total(fraud), F.sum(weight)).alias("fraud_share"),
        share(total(acted), F.sum(weight)).alias("acted_share"),
        share(total(acted & fraud), total(acted)).alias("acted_precision"),
        share(total(acted & fraud), total(fraud)).alias("acted_recall"),
    ]


def decision_quality(rows: DataFrame, day: Column | None = None) -> DataFrame:
    """Weighted quality, of all rows, or by day and of all (one pass, grouping sets)."""
    used = rows.where(F.col("is_fraud").isNotNull()).withColumn("__w", F.coalesce("weight", F.lit(1.0)))
    m = quality_measures(F.col("__w"), F.col("action") != "approve", F.col("is_fraud"))
    if day is None:
        return used.agg(*m)
    return used.withColumn("day", day).rollup("day").agg(F.grouping_id().alias("__g"), *m).withColumn("day", F.when(F.col("__g") == 1, "(all)").otherwise(F.col("day"))).drop("__g")


def by_value(rows: DataFrame, column: str) -> DataFrame:
    """Of each value: its share, fraud rate and share of all fraud, weighted."""
    used = rows.where(F.col("is_fraud").isNotNull()).withColumn("__w", F.coalesce("weight", F.lit(1.0)))
    g = used.groupBy(F.col(column).alias("value")).agg(F.sum("__w").alias("w"), F.sum(F.when(F.col("is_fraud"), F.col("__w")).otherwise(0.0)).alias("f"))
    # Values of an action or rule are few: the window runs over their sums.
    everything = W.partitionBy()
    return g.select("value", F.try_divide("w", F.sum("w").over(everything)).alias("share"), F.try_divide("f", "w").alias("fraud_rate"), F.try_divide("f", F.sum("f").over(everything)).alias("share_of_fraud"))


def score_bands(rows: DataFrame, score: str) -> DataFrame:
    """Of each band of scores that occurs: its share of the scored, mean score and fraud rate, weighted."""
    used = rows.where(F.col("is_fraud").isNotNull() & F.col(score).isNotNull()).withColumn("__w", F.coalesce("weight", F.lit(1.0)))
    band = F.lit(None).cast("double")
    for low, high in zip(BANDS[:-1], BANDS[1:], strict=True):
        band = F.when((F.col(score) >= low) & (F.col(score) < high), F.lit(low)).otherwise(band)
    g = used.withColumn("band", band).groupBy("band").agg(
        F.sum("__w").alias("w"), F.sum(F.col("__w") * F.col(score)).alias("ws"), F.sum(F.when(F.col("is_fraud"), F.col("__w")).otherwise(0.0)).alias("f")
    )
    return g.select("band", F.try_divide("w", F.sum("w").over(W.partitionBy())).alias("share"), F.try_divide("ws", "w").alias("mean_score"), F.try_divide("f", "w").alias("fraud_rate"))


#: Resamples that a block draws at a time, so that its memory is bounded.
_AT_ONCE = 50
#: Chances of at most 0, 1, 2, ... of a Poisson number of mean 1.
_POISSON = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(19)])


def _draws(cells: np.ndarray, counts: np.ndarray, first: int, last: int, seed: int) -> np.ndarray:
    """(cells, resamples first to last - 1): how often each cell's rows are drawn, by the cell's hash, the
    resample and the seed alone. A row is drawn a Poisson number of times of mean 1, a cell of n rows of mean n."""
    r = np.arange(first, last, dtype=np.uint64) + np.uint64(seed) * np.uint64(1 << 32) + np.uint64(1)
    with np.errstate(over="ignore"):
        z = cells.astype(np.uint64)[:, None] + r[None, :] * np.uint64(0x9E3779B97F4A7C15)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            z = (z ^ (z >> np.uint64(shift))) * np.uint64(factor)
        z ^= z >> np.uint64(31)
    out = np.searchsorted(_POISSON, (z >> np.uint64(11)) * 2.0**-53, side="right").astype(float)
    for i in np.flatnonzero(counts > 1):
        # The same resample draws the same number whatever the resamples beside it.
        out[i] = [np.random.default_rng([seed, int(cells[i]) % 2**63, k]).poisson(counts[i]) for k in range(first, last)]
    return out


def _cells(rows: DataFrame, label: str, scores: Sequence[str], weight: str, *others: Column) -> DataFrame:
    """(s0, s1, ..., y, w, others, n, h): rows that are alike for a resample, added up, and their hash."""
    used = rows.where(F.col(label).isNotNull())
    for c in scores:
        used = used.where(F.col(c).isNotNull() & ~F.isnan(c))
    keys = [*[F.col(c).cast("double").alias(f"s{i}") for i, c in enumerate(scores)], F.col(label).cast("double").alias("y"), F.coalesce(F.col(weight).cast("double"), F.lit(1.0)).alias("w"), *others]
    named = used.select(*keys)
    return named.groupBy(*named.columns).agg(F.count(F.lit(1)).alias("n")).withColumn("h", F.xxhash64(*named.columns))


def _precision_of(cells: DataFrame, score: str, resamples: int, seed: int) -> DataFrame:
    """(resample, ap): in blocks of scores in falling order, first each block's mass, then its gains."""
    blocks = written(cells.repartitionByRange(F.desc(score)).withColumn("b", F.spark_partition_id()).select("b", F.col(score).alias("s"), "y", "w", "n", "h"), "blocks")

    def drawn(pdf: pd.DataFrame):
        h, n, w = (pdf[c].to_numpy() for c in ("h", "n", "w"))
        for first in range(0, resamples, _AT_ONCE):
            last = min(resamples, first + _AT_ONCE)
            yield first, last, _draws(h.view(np.uint64), n, first, last, seed) * w[:, None]

    def masses(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("h")
        y, out = pdf["y"].to_numpy(), []
        for first, last, mass in drawn(pdf):
            out.append(pd.DataFrame({"b": pdf["b"].iloc[0], "r": np.arange(first, last), "hit": y @ mass, "all": mass.sum(axis=0)}))
        return pd.concat(out)

    def gains(pdf: pd.DataFrame, before: pd.DataFrame) -> pd.DataFrame:
        if not len(pdf):
            return pd.DataFrame({"r": [], "gain": []})
        pdf, before = pdf.sort_values(["s", "h"], ascending=[False, True]), before.sort_values("r")
        y, s, out = pdf["y"].to_numpy(), pdf["s"].to_numpy(), []
        starts = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1])))  # tied scores are one threshold
        for first, last, mass in drawn(pdf):
            hit, reached = np.add.reduceat(mass * y[:, None], starts, axis=0), np.add.reduceat(mass, starts, axis=0)
            hits, alls = hit.cumsum(axis=0) + before["hit0"].to_numpy()[first:last], reached.cumsum(axis=0) + before["all0"].to_numpy()[first:last]
            out.append(pd.DataFrame({"r": np.arange(first, last), "gain": (hit * np.divide(hits, alls, out=np.zeros_like(hits), where=alls > 0)).sum(axis=0)}))
        return pd.concat(out)

    found = written(blocks.groupBy("b").applyInPandas(masses, "b int, r int, hit double, all double"), "masses")
    above = W.partitionBy("r").orderBy("b").rowsBetween(W.unboundedPreceding, -1)
    before = found.select("b", "r", *[F.coalesce(F.sum(c).over(above), F.lit(0.0)).alias(f"{c}0") for c in ("hit", "all")])
    gained = blocks.groupBy("b").cogroup(before.groupBy("b")).applyInPandas(gains, "r int, gain double")
    total = found.groupBy("r").agg(F.sum("hit").alias("hit"))
    ap = gained.groupBy("r").agg(F.sum("gain").alias("gain")).join(total, "r")
    return ap.select(F.col("r").cast("long").alias("resample"), F.coalesce(F.try_divide("gain", "hit"), F.lit(0.0)).alias("ap"))


def bootstrap_precision(rows: DataFrame, label: str, scores: Sequence[str], weight: str, resamples: int = 1000, seed: int = 1) -> DataFrame:
    """(resample, a column per score): average precision of Poisson resamples, exact in the scores and paired across
    them: a row is drawn as often for one score as for the other.

    Rows alike are added up; the rest stays in blocks of a score's range, each drawing its own rows' numbers from
    their hashes, so nothing but a line per block and resample is moved. Unlike draws of fixed size, a stratum's
    size varies with the draw. Rows of one tied score are in one block, their memory bounded by _AT_ONCE."""
    cells = written(_cells(rows, label, scores, weight), "cells")
    out = None
    for i, name in enumerate(scores):
        part = _precision_of(cells, f"s{i}", resamples, seed).withColumnRenamed("ap", name)
        out = part if out is None else out.join(part, "resample")
    return out


def bootstrap_total(rows: DataFrame, label: str, scores: Sequence[str], weight: str, value: Column, resamples: int = 1000, seed: int = 1) -> DataFrame:
    """(resample, total): the weighted sum of a value over the same kind of resamples, partition by partition."""
    cells = _cells(rows, label, scores, weight, value.cast("double").alias("v"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = np.zeros(resamples)
        for pdf in batches:
            for at in range(0, len(pdf), 4096):
                some = pdf.iloc[at : at + 4096]
                worth = (some["w"] * some["v"]).to_numpy()
                for first in range(0, resamples, _AT_ONCE):
                    last = min(resamples, first + _AT_ONCE)
                    sums[first:last] += worth @ _draws(some["h"].to_numpy().view(np.uint64), some["n"].to_numpy(), first, last, seed)
        yield pd.DataFrame({"resample": np.arange(resamples), "total": sums})

    return cells.mapInPandas(run, "resample long, total double").groupBy("resample").agg(F.sum("total").alias("total"))


def interval(resampled: DataFrame, value: Column, level: float = 0.95) -> DataFrame:
    """(low, high) of a value over the resamples."""
    a = (1 - level) / 2
    return resampled.agg(F.percentile(value, F.lit(a)).alias("low"), F.percentile(value, F.lit(1 - a)).alias("high"))


#: Two-sided 95 % points of the t distribution by degrees of freedom.
T_TABLE = {
    1: 12.706, 2: 4.303, 3: 3.182, 4: 2.776, 5: 2.571, 6: 2.447, 7: 2.365, 8: 2.306, 9: 2.262, 10: 2.228,
    11: 2.201, 12: 2.179, 13: 2.160, 14: 2.145, 15: 2.131, 16: 2.120, 17: 2.110, 18: 2.101, 19: 2.093, 20: 2.086,
    25: 2.060, 30: 2.042,
}


def t_critical(df: Column) -> Column:
    """The table's value, degrees of freedom rounded down to a listed number."""
    out = F.lit(None).cast("double")
    for k, v in T_TABLE.items():
        out = F.when(df >= k, F.lit(v)).otherwise(out)
    return out


def t_interval(rows: DataFrame, groups: Sequence[str], value: str) -> DataFrame:
    """(groups, n, mean, low, high): the mean's 95 % interval over independent runs; null below two runs."""
    g = rows.where(F.col(value).isNotNull()).groupBy(*groups).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("__s"))
    half = t_critical(F.col("n") - 1) * F.col("__s") / F.sqrt(F.col("n").cast("double"))
    return g.select(*groups, "n", "mean", (F.col("mean") - half).alias("low"), (F.col("mean") + half).alias("high"))


def promotion_gate(rows: DataFrame, least_rows: int = 1000, least_frauds: int = 50, ap_margin: float = 0.0, cost_fraction: float = 0.0, resamples: int = 1000, seed: int = 1) -> DataFrame:
    """One row: challenger against champion by average precision and decision cost, the 95 % intervals of both
    differences, and whether to promote, with the reasons against. rows: is_fraud, amount_cents, champion_score,
    challenger_score, weight.

    Precision may be lower by no more than ap_margin, at the lower end of its interval; decisions may cost more
    than the champion's by no more than cost_fraction of it, at the upper end. Evidence counts rows; estimates use weights."""
    from tidemark.operators.decide import Rules

    w = F.coalesce(F.col("weight"), F.lit(1.0))
    act = lambda c: Rules().decide(F.col(c), F.col("amount_cents"))["action"]
    amount, scores = F.col("amount_cents").cast("double"), ["champion_score", "challenger_score"]
    cost = {c: decision_cost(act(c), F.col("is_fraud"), amount, w) for c in scores}
    facts = rows.where(F.col("is_fraud").isNotNull()).agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if("is_fraud").alias("n_frauds"), F.count_if(F.col("champion_score").isNull() | F.col("challenger_score").isNull()).alias("n_excluded"),
        cost[scores[0]].alias("champion_cost"), cost[scores[1]].alias("challenger_cost"),
    )
    for name in ("champion", "challenger"):
        ap = average_precision(rows, "is_fraud", f"{name}_score", "weight")
        facts = facts.crossJoin(ap.select(F.col("average_precision").alias(f"{name}_ap")))
    boot = bootstrap_precision(rows, "is_fraud", scores, "weight", resamples, seed)
    more = row_cost(act(scores[1]), F.col("is_fraud"), amount) - row_cost(act(scores[0]), F.col("is_fraud"), amount)
    costs = bootstrap_total(rows, "is_fraud", scores, "weight", more, resamples, seed)
    facts = facts.crossJoin(interval(boot, F.col(scores[1]) - F.col(scores[0])).withColumnsRenamed({"low": "ap_low", "high": "ap_high"}))
    facts = facts.crossJoin(interval(costs, F.col("total")).withColumnsRenamed({"low": "cost_low", "high": "cost_high"}))
    against = {
        "too few rows": F.col("n_rows") < least_rows, "too few frauds": F.col("n_frauds") < least_frauds,
        "precision could be lower": F.col("ap_low") < -ap_margin, "decisions could cost more": F.col("cost_high") > cost_fraction * F.col("champion_cost"),
    }
    reasons = F.array_compact(F.array(*[F.when(F.coalesce(on, F.lit(True)), text) for text, on in against.items()]))
    return facts.withColumn("reasons", F.array_join(reasons, "; ")).withColumn("promote", F.col("reasons") == "")
