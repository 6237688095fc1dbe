"""The queries of problems 2, 3, 7, 8 and 9, with their SQL where SQL can say it."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import language, leaks, quantiles, sample, tokens
from tidemark.session import table, written

QS = {"p50": 0.50, "p95": 0.95, "p99": 0.99}
_SETS = [["instance_id", "day"], ["instance_id"], ["day"], []]


def _minutes(spark: SparkSession, d: str) -> DataFrame:
    """Each instance's minute once. Of several scrapes the largest counts; of several maps the one with
    the largest total, then the largest entries."""
    m = table(spark, d, "latency_minutes")
    n = F.when(~F.isnan("decisions"), F.col("decisions"))
    e = F.array_sort(F.map_entries("buckets"))
    best = F.struct(F.coalesce(F.array_max(F.map_values("buckets")), F.lit(-1.0)).alias("most"), e.alias("e"))
    return (
        m.groupBy("instance_id", "minute_at")
        .agg(F.max(n).alias("decisions"), F.max(F.when(F.col("buckets").isNotNull(), best)).alias("b"))
        .select("instance_id", F.date_format("minute_at", "yyyy-MM-dd").alias("day"), "decisions", F.map_from_entries("b.e").alias("buckets"))
    )


def p2_decisions(spark: SparkSession, d: str) -> DataFrame:
    # The days' sketches are stored; all groupings are combined from them, none from the minutes.
    base = written(quantiles.sketch(_minutes(spark, d), ["instance_id", "day"], "decisions"), "sketches")
    found = quantiles.percentiles(quantiles.merge_sets(base, _SETS, ["instance_id", "day"]), ["instance_id", "day"], QS)
    return found.select("instance_id", "day", "n", *[F.round(q, 4).alias(q) for q in QS], F.lit(quantiles.ALPHA).alias("relative_error"))


def p2_latency(spark: SparkSession, d: str) -> DataFrame:
    """The percentile lies between pNN_low and pNN_high, the bounds widened by the sketch's relative error; pNN is
    the middle, off by pNN_error at most (infinite, and pNN the lower bound, where the highest bound has no end)."""
    groups = ["instance_id", "day"]
    masses = written(quantiles.histogram_intervals(_minutes(spark, d), groups, "buckets", "decisions"), "intervals")
    out = None
    for side, bound in (("low", "lower"), ("high", "upper")):
        base = quantiles.sketch(masses, groups, bound, weight="n")
        factor = 1 - quantiles.ALPHA if side == "low" else 1 + quantiles.ALPHA
        found = quantiles.percentiles(quantiles.merge_sets(base, _SETS, groups), groups, QS)
        found = found.select(*groups, F.col("n").alias(f"n_{side}"), *[(F.col(q) * factor).alias(f"{q}_{side}") for q in QS])
        out = found if out is None else out.join(found, groups)
    mid = [F.round(F.when(F.col(f"{q}_high") == float("inf"), F.col(f"{q}_low")).otherwise((F.col(f"{q}_low") + F.col(f"{q}_high")) / 2), 9).alias(q) for q in QS]
    off = [F.round((F.col(f"{q}_high") - F.col(f"{q}_low")) / F.when(F.col(f"{q}_high") == float("inf"), 1).otherwise(2), 9).alias(f"{q}_error") for q in QS]
    return out.select(*groups, F.col("n_low").alias("n"), *mid, *off, *[F.round(f"{q}_{s}", 9).alias(f"{q}_{s}") for q in QS for s in ("low", "high")])


RATES = {"fraud": 0.5, "acted": 0.1, "legit": 0.05}
OTHER_RATE = 0.05


def _stratum():
    """The row's stratum in one spelling; where missing, what its action and outcome say."""
    said = F.lower(F.trim("stratum"))
    acted = F.when(F.col("action") != "approve", "acted").when(F.col("is_fraud"), "fraud").when(~F.col("is_fraud"), "legit")
    return F.when(said.isin(*RATES), said).otherwise(acted)


def p3_sample(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "kept_history").withColumn("weight", F.when(~F.isnan("weight"), F.col("weight")))
    held = sample.stable_sample(rows.withColumn("stratum", _stratum()), "event_id", F.col("stratum"), RATES, OTHER_RATE, "weight")
    return held.select("event_id", "card_id", F.unix_micros("decided_at").alias("decided_us"), "stratum", "weight", "sample_bucket", "sample_rate", F.round("sample_weight", 6).alias("sample_weight"))


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.token_ids(table(spark, d, "documents"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return leaks.leaks(table(spark, d, "documents"), table(spark, d, "eval_items")).distinct()


def p8_places(spark: SparkSession, d: str) -> DataFrame:
    return leaks.leaks(table(spark, d, "documents"), table(spark, d, "eval_items"), places=True)


def _segments(spark: SparkSession, d: str) -> DataFrame:
    documents = table(spark, d, "documents")
    return language.segments(documents, language.fit(documents))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    named = language.label_code(F.col("label"))
    case = (F.col("n_langs") > 1) | named.isNull() | (named != F.col("lang"))
    return _segments(spark, d).where(F.col("seg").isNotNull() & case).select("doc_id", "seg", "lang")


def p9_segments(spark: SparkSession, d: str) -> DataFrame:
    return _segments(spark, d).where(F.col("seg").isNotNull()).select("doc_id", "seg", "lang", F.round("confidence", 4).alias("confidence"), "start", "end")


def p9_documents(spark: SparkSession, d: str) -> DataFrame:
    return language.document_languages(_segments(spark, d)).select("doc_id", "label", "lang", F.round("confidence", 4).alias("confidence"), "n_langs")


QUERIES = {
    "p2_decisions": p2_decisions, "p2_latency": p2_latency, "p3_sample": p3_sample, "p7_ids": p7_ids,
    "p8_found": p8_found, "p8_places": p8_places, "p9_found": p9_found, "p9_segments": p9_segments, "p9_documents": p9_documents,
}

_G = (1 + quantiles.ALPHA) / (1 - quantiles.ALPHA)
_STRATUM = "CASE WHEN lower(trim(stratum)) IN ('fraud', 'acted', 'legit') THEN lower(trim(stratum)) WHEN action <> 'approve' THEN 'acted' WHEN is_fraud THEN 'fraud' WHEN NOT is_fraud THEN 'legit' END"
_PICK = ", ".join(f"round(min(CASE WHEN upto >= CAST(floor({q} * (n - 1)) AS BIGINT) + 1 THEN b END), 0) AS b_{name}" for name, q in QS.items())
_ANSWER = ", ".join(f"round(CASE WHEN b_{name} < -1e8 THEN 0 ELSE exp(b_{name} * {math.log(_G)!r}) * {2 / (_G + 1)!r} END, 4) AS {name}" for name in QS)

SQL = {
    "p2_decisions": f"""WITH m AS (SELECT instance_id, strftime(minute_at, '%Y-%m-%d') AS day, max(CASE WHEN NOT isnan(decisions) THEN decisions END) AS v FROM latency_minutes GROUP BY instance_id, minute_at, day),
c AS (SELECT coalesce(instance_id, '(all)') AS instance_id, coalesce(day, '(all)') AS day, CASE WHEN v = 0 THEN -1e9 ELSE ceil(ln(v) / {math.log(_G)!r}) END AS b, count(*) AS k
  FROM m WHERE v IS NOT NULL GROUP BY GROUPING SETS ((instance_id, day, b), (instance_id, b), (day, b), (b))),
r AS (SELECT *, sum(k) OVER (PARTITION BY instance_id, day ORDER BY b ROWS UNBOUNDED PRECEDING) AS upto, CAST(sum(k) OVER (PARTITION BY instance_id, day) AS BIGINT) AS n FROM c)
SELECT instance_id, day, n, {_ANSWER}, CAST({quantiles.ALPHA} AS DOUBLE) AS relative_error FROM (SELECT instance_id, day, n, {_PICK} FROM r GROUP BY instance_id, day, n)""",
    "p3_sample": f"""WITH k AS (SELECT event_id, card_id, epoch_us(decided_at) AS decided_us, {_STRATUM} AS stratum, CASE WHEN NOT isnan(weight) THEN weight END AS weight,
  CAST('0x' || substr(sha256('tidemark/sample/1' || event_id), 1, 4) AS INTEGER) AS sample_bucket FROM kept_history WHERE event_id IS NOT NULL),
r AS (SELECT *, CASE stratum WHEN 'fraud' THEN {sample.held_buckets(0.5)} WHEN 'acted' THEN {sample.held_buckets(0.1)} ELSE {sample.held_buckets(0.05)} END AS own, (sample_bucket::BIGINT * {sample.STEP} + {sample.START}) % {sample.BUCKETS} AS place FROM k),
e AS (SELECT *, max(own) OVER (PARTITION BY event_id) AS reach FROM r)
SELECT event_id, card_id, decided_us, stratum, weight, sample_bucket, reach / {float(sample.BUCKETS)} AS sample_rate, round(weight / (reach / {float(sample.BUCKETS)}), 6) AS sample_weight FROM e WHERE place < reach""",
}
