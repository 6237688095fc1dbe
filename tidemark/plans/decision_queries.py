"""Scoring, history, training and metric queries, and the SQL they are compared with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.times import DAY, HOUR
from tidemark.operators import decide, history, metrics, models
from tidemark.operators.features import FEATURE_NAMES, first_wins
from tidemark.session import table

ORDER = ["decided_at", "batch_no", "champion_version", "champion_score", "shadow_version", "shadow_score", "shadow_action"]
CARRIED = ["card_id", "event_time", "amount_cents", "action", "rule", *ORDER[2:], *FEATURE_NAMES]
RATES = {"acted": 1.0, "fraud": 0.5, "legit": 0.1}
NOW = "2027-11-15 12:00:00"
CUTOFF = "2027-10-20 00:00:00"
CHALLENGER = "challenger-b7c91e50fa23"


def staged(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "staged_decisions")


def distinct_staged(spark: SparkSession, d: str) -> DataFrame:
    """Each event's earliest delivery, all columns."""
    return first_wins(staged(spark, d).select("event_id", *ORDER, *[c for c in CARRIED if c not in ORDER]), "event_id", ORDER)


def kept(spark: SparkSession, d: str) -> DataFrame:
    """kept_history, each event's first row; NaN weights missing."""
    order = ["decided_at", "label_time", "stratum", "weight"]
    cols = ["event_id", *order, "card_id", "event_time", "amount_cents", "action", "rule", "champion_version", "champion_score", "shadow_version", "shadow_score", "is_fraud", "recovered_cents"]
    rows = table(spark, d, "kept_history").select(*cols).withColumn("weight", F.when(~F.isnan("weight"), F.col("weight")))
    return first_wins(rows, "event_id", order)


def _score(features, amount):
    return decide.stand_in_score(features, amount)


def _shadow(features, amount):
    return decide.stand_in_score(features, amount) * 0.9 + 0.02 * F.greatest(features["session_txn_count"], F.lit(0.0))


def decide_all(spark: SparkSession, d: str) -> DataFrame:
    rows = distinct_staged(spark, d).select("event_id", "amount_cents", *FEATURE_NAMES)
    out = decide.decided(rows, FEATURE_NAMES, "amount_cents", _score, "stand-in", _shadow, "stand-in-2", shadow_where=F.col("card_txn_count_24h") > 0)
    return out.select("event_id", F.round("champion_score", 9).alias("champion_score"), "action", "rule", "shadow_version", F.round("shadow_score", 9).alias("shadow_score"), "shadow_action")


def shadow_compare(spark: SparkSession, d: str) -> DataFrame:
    rows = history.scored_beside(distinct_staged(spark, d), CHALLENGER)
    return rows.groupBy("champion_version", "action", "shadow_action").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col("shadow_score") - F.col("champion_score")), 9).alias("mean_difference"))


def current_shadow(spark: SparkSession, d: str) -> DataFrame:
    return history.current_shadow(staged(spark, d))


def hash_draw(spark: SparkSession, d: str) -> DataFrame:
    return staged(spark, d).select("event_id").distinct().select("event_id", decide.draw(F.col("event_id"), history.SALT).alias("drawn"))


def history_kept(spark: SparkSession, d: str) -> DataFrame:
    rows = history.kept_sample(staged(spark, d).select("event_id", *ORDER, "card_id", "event_time", "amount_cents", "action", "rule"), table(spark, d, "label_spool"), RATES, ORDER)
    return rows.select("event_id", "card_id", F.unix_micros("decided_at").alias("decided_us"), F.unix_micros("label_time").alias("label_us"), "is_fraud", "recovered_cents", "stratum", "weight")


def history_manifest(spark: SparkSession, d: str) -> DataFrame:
    return history.manifest(staged(spark, d), table(spark, d, "label_spool"), RATES)


def history_hours(spark: SparkSession, d: str) -> DataFrame:
    return history.hour_states(staged(spark, d), F.lit(NOW).cast("timestamp"))


def history_finalisable(spark: SparkSession, d: str) -> DataFrame:
    done = spark.sql("SELECT explode(sequence(date'2027-09-01', date'2027-09-20')) AS day")
    return history.finalisable_days(staged(spark, d), done, F.lit(NOW).cast("timestamp")).select(F.date_format("day", "yyyy-MM-dd").alias("day"), "n_rows")


def unlabelled(spark: SparkSession, d: str) -> DataFrame:
    ids = staged(spark, d).select("event_id").distinct()
    known = table(spark, d, "label_spool").select("event_id").distinct().withColumn("has", F.lit(True))
    return ids.join(known, "event_id", "left").agg(F.count(F.lit(1)).alias("events"), F.count_if(F.col("has").isNull()).alias("unlabelled"))


def train_at_cutoff(spark: SparkSession, d: str) -> DataFrame:
    t = F.lit(CUTOFF).cast("timestamp")
    rows = kept(spark, d)
    return history.at_cutoff(rows, t).select("event_id", "is_fraud", "weight", F.lit("known").alias("state")).unionByName(
        rows.where((F.col("event_time") < t) & (F.col("label_time") > t)).select("event_id", "is_fraud", "weight", F.lit("waiting").alias("state"))
    )


def train_split(spark: SparkSession, d: str) -> DataFrame:
    return history.split_by_time(kept(spark, d)).groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.count_if("is_fraud").alias("frauds"))


#: Targets for the table that candidates are fitted on, by label.
TRAIN_TARGETS = {True: 400_000, False: 2_000_000}


def train_bounded(spark: SparkSession, d: str) -> DataFrame:
    """The training set under its bounds: below them every labelled row stays."""
    rows = history.bounded_rows(kept(spark, d).withColumn("weight", F.coalesce("weight", F.lit(1.0))), TRAIN_TARGETS)
    return rows.select("event_id", "is_fraud", F.round("weight", 6).alias("weight"))


def pr_auc(spark: SparkSession, d: str) -> DataFrame:
    return metrics.average_precision(kept(spark, d), "is_fraud", "champion_score", "weight").select("n_rows", F.round("positives", 6).alias("positives"), F.round("average_precision", 9).alias("average_precision"))


def pr_auc_by_action(spark: SparkSession, d: str) -> DataFrame:
    got = metrics.average_precision(kept(spark, d).withColumn("tied", F.round("champion_score", 2)), "is_fraud", "tied", "weight", ["action"])
    return got.select("action", "n_rows", F.round("average_precision", 9).alias("average_precision"))


def decision_cost(spark: SparkSession, d: str) -> DataFrame:
    w = F.coalesce(F.col("weight"), F.lit(1.0))
    return kept(spark, d).groupBy("champion_version").agg(F.round(metrics.decision_cost(F.col("action"), F.col("is_fraud"), F.col("amount_cents").cast("double"), w), 3).alias("cost"))


def _round_all(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(*keys, *[F.round(c, 9).alias(c) for c in df.columns if c not in keys])


def quality_overall(spark: SparkSession, d: str) -> DataFrame:
    return _round_all(metrics.decision_quality(kept(spark, d)))


def quality_daily(spark: SparkSession, d: str) -> DataFrame:
    return _round_all(metrics.decision_quality(kept(spark, d), F.date_format("event_time", "yyyy-MM-dd")), "day")


def quality_by_action(spark: SparkSession, d: str) -> DataFrame:
    return _round_all(metrics.by_value(kept(spark, d), "action"), "value")


def quality_by_rule(spark: SparkSession, d: str) -> DataFrame:
    return _round_all(metrics.by_value(kept(spark, d), "rule"), "value")


def quality_bands(spark: SparkSession, d: str) -> DataFrame:
    return _round_all(metrics.score_bands(kept(spark, d), "champion_score"), "band")


def _shadow_rows(spark: SparkSession, d: str) -> DataFrame:
    return history.scored_beside(kept(spark, d), CHALLENGER).select("event_id", "is_fraud", "amount_cents", "champion_score", F.col("shadow_score").alias("challenger_score"), "weight")


def pr_auc_bootstrap(spark: SparkSession, d: str) -> DataFrame:
    return metrics.bootstrap_precision(_shadow_rows(spark, d), "is_fraud", ["champion_score", "challenger_score"], "weight")


def promotion_gate(spark: SparkSession, d: str) -> DataFrame:
    return metrics.promotion_gate(_shadow_rows(spark, d))


def t_interval(spark: SparkSession, d: str) -> DataFrame:
    """The mean of daily event counts by action, with its interval: days as runs."""
    runs = staged(spark, d).groupBy("action", F.to_date("event_time").alias("run")).agg(F.count(F.lit(1)).cast("double").alias("n_events"))
    return _round_all(metrics.t_interval(runs, ["action"], "n_events"), "action", "n")


def _trainable(spark: SparkSession, d: str) -> DataFrame:
    """kept_history with features, each event's first row."""
    rows = table(spark, d, "kept_history").select("event_id", "decided_at", "label_time", "event_time", "amount_cents", "is_fraud", F.when(~F.isnan("weight"), F.col("weight")).alias("weight"), *FEATURE_NAMES)
    return first_wins(rows, "event_id", ["decided_at", "label_time"])


def train_standardisation(spark: SparkSession, d: str) -> DataFrame:
    return _round_all(models.standardisation(_trainable(spark, d)), "input")


def train_model(spark: SparkSession, d: str) -> DataFrame:
    """Fitted on the rows known at the cut-off, scored on what happened after it: rows and average precision."""
    rows, t = _trainable(spark, d), F.lit(CUTOFF).cast("timestamp")
    model = models.fit(history.at_cutoff(rows, t), trees=5, depth=3)
    test = models.scored(model, rows.where(F.col("event_time") >= t))
    return metrics.average_precision(test, "is_fraud", "score", "weight").withColumn("version", F.lit(models.version(model, "champion")))


QUERIES = {
    "decide": decide_all, "shadow_compare": shadow_compare, "current_shadow": current_shadow, "hash_draw": hash_draw,
    "history_kept": history_kept, "history_manifest": history_manifest, "history_hours": history_hours, "history_finalisable": history_finalisable, "unlabelled": unlabelled,
    "train_at_cutoff": train_at_cutoff, "train_split": train_split, "train_bounded": train_bounded, "train_standardisation": train_standardisation, "train_model": train_model,
    "pr_auc": pr_auc, "pr_auc_by_action": pr_auc_by_action, "decision_cost": decision_cost,
    "quality_overall": quality_overall, "quality_daily": quality_daily, "quality_by_action": quality_by_action, "quality_by_rule": quality_by_rule, "quality_bands": quality_bands,
    "pr_auc_bootstrap": pr_auc_bootstrap, "promotion_gate": promotion_gate, "t_interval": t_interval,
}

_ORDERED = ", ".join(f"{c} NULLS FIRST" for c in ORDER)
ST = f"st AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY {_ORDERED}) AS rn FROM staged_decisions) WHERE rn = 1)"
KEPT = """kw AS (SELECT * REPLACE (CASE WHEN NOT isnan(weight) THEN weight END AS weight) FROM kept_history),
kept AS (SELECT *, coalesce(weight, 1.0) AS w FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY decided_at, label_time, stratum NULLS FIRST, weight NULLS FIRST) AS rn FROM kw) WHERE rn = 1)"""
LAB = "lab AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY label_time, is_fraud, recovered_cents) AS ln FROM label_spool) WHERE ln = 1)"


def _u64(salt: str) -> str:
    return f"(CAST(CAST('0x' || substr(sha256('{salt}' || event_id), 1, 16) AS UBIGINT) AS DOUBLE) / 18446744073709551616.0)"


_DRAW = _u64(history.SALT)
_Z = """(-4.0 + 0.6 * ln(1 + greatest(card_txn_count_1h, 0)) + 0.8 * ln(1 + greatest(device_distinct_cards_1h, 0)) + CASE WHEN card_amount_mean_24h > 0 AND amount_cents > 3 * card_amount_mean_24h THEN 1.5 ELSE 0 END)"""


def _decision(s: str) -> tuple[str, str]:
    when = f"CASE WHEN {s} >= 0.9 THEN '{{}}' WHEN {s} >= 0.5 THEN '{{}}' WHEN {s} IS NOT NULL AND amount_cents >= 500000 THEN '{{}}' WHEN {s} IS NOT NULL THEN '{{}}' END"
    return when.format("decline", "review", "review", "approve"), when.format("score-decline", "score-review", "large-amount-review", "default-approve")


def _ap(score: str, groups: str = "") -> str:
    g, p = (f"{groups}, ", f"PARTITION BY {groups} ") if groups else ("", "")
    return f"""WITH {KEPT}, b AS (SELECT {g}{score} AS s, count(*) AS k, sum(CASE WHEN is_fraud THEN w ELSE 0 END) AS tp, sum(w) AS a FROM kept WHERE is_fraud IS NOT NULL AND {score} IS NOT NULL GROUP BY {g}s),
c AS (SELECT *, sum(tp) OVER ({p}ORDER BY s DESC ROWS UNBOUNDED PRECEDING) AS ct, sum(a) OVER ({p}ORDER BY s DESC ROWS UNBOUNDED PRECEDING) AS ca, sum(tp) OVER ({p.strip()}) AS pos FROM b)
SELECT {g}CAST(sum(k) AS BIGINT) AS n_rows, round(max(pos), 6) AS positives, round(sum(CASE WHEN tp > 0 THEN tp / pos * (ct / ca) ELSE 0 END), 9) AS average_precision FROM c {"GROUP BY " + groups if groups else ""}"""


_QUALITY = """round(sum(w), 9) AS transactions, round(sum(CASE WHEN is_fraud THEN w ELSE 0 END) / sum(w), 9) AS fraud_share, round(sum(CASE WHEN action <> 'approve' THEN w ELSE 0 END) / sum(w), 9) AS acted_share,
round(sum(CASE WHEN action <> 'approve' AND is_fraud THEN w ELSE 0 END) / nullif(sum(CASE WHEN action <> 'approve' THEN w ELSE 0 END), 0), 9) AS acted_precision,
round(sum(CASE WHEN action <> 'approve' AND is_fraud THEN w ELSE 0 END) / nullif(sum(CASE WHEN is_fraud THEN w ELSE 0 END), 0), 9) AS acted_recall"""


def _by(column: str) -> str:
    return f"""WITH {KEPT}, g AS (SELECT {column} AS value, sum(w) AS w, sum(CASE WHEN is_fraud THEN w ELSE 0 END) AS f FROM kept WHERE is_fraud IS NOT NULL GROUP BY 1)
SELECT value, round(w / sum(w) OVER (), 9) AS share, round(f / nullif(w, 0), 9) AS fraud_rate, round(f / nullif(sum(f) OVER (), 0), 9) AS share_of_fraud FROM g"""


_BAND = " ".join(f"WHEN champion_score >= {lo} AND champion_score < {hi} THEN {lo}" for lo, hi in zip(metrics.BANDS[:-1], metrics.BANDS[1:], strict=True))
_TRATE = "CASE WHEN action <> 'approve' THEN 1.0 WHEN is_fraud THEN 0.5 WHEN NOT is_fraud THEN 0.1 END"
_TSTRAT = "CASE WHEN action <> 'approve' THEN 'acted' WHEN is_fraud THEN 'fraud' WHEN NOT is_fraud THEN 'legit' END"
_A, _R = _decision("cs")
_SA, _ = _decision("ss")
_TQ = " ".join(f"WHEN n - 1 >= {k} THEN {v}" for k, v in sorted(metrics.T_TABLE.items(), reverse=True))

def _standardisation_sql() -> str:
    x = {c: f"ln(1 + greatest(coalesce(CAST({c} AS DOUBLE), 0), 0))" for c in models.INPUTS}
    each = " UNION ALL ".join(f"SELECT '{c}' AS input, round(sum(w * {v}) / sum(w), 9) AS mean, round(sqrt(greatest(sum(w * {v} * {v}) / sum(w) - power(sum(w * {v}) / sum(w), 2), 0)), 9) AS std FROM one" for c, v in x.items())
    order = ", ".join(["decided_at", "label_time", "event_time", "amount_cents", "is_fraud", "weight NULLS FIRST", *FEATURE_NAMES])
    return f"""WITH kw AS (SELECT * REPLACE (CASE WHEN NOT isnan(weight) THEN weight END AS weight) FROM kept_history),
one AS (SELECT *, coalesce(weight, 1.0) AS w FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY {order}) AS rn FROM kw) WHERE rn = 1) {each}"""


SQL = {
    "decide": f"""WITH {ST}, s AS (SELECT *, 1.0 / (1.0 + exp(-{_Z})) AS cs FROM st), t AS (SELECT *, CASE WHEN card_txn_count_24h > 0 THEN least(1, greatest(0, cs * 0.9 + 0.02 * greatest(session_txn_count, 0))) END AS ss FROM s)
SELECT event_id, round(cs, 9) AS champion_score, {_A} AS action, {_R} AS rule, CASE WHEN ss IS NOT NULL THEN 'stand-in-2' END AS shadow_version, round(ss, 9) AS shadow_score, {_SA} AS shadow_action FROM t""",
    "shadow_compare": f"WITH {ST} SELECT champion_version, action, shadow_action, count(*) AS n, round(avg(shadow_score - champion_score), 9) AS mean_difference FROM st WHERE shadow_version = '{CHALLENGER}' AND shadow_score IS NOT NULL AND champion_version <> '{CHALLENGER}' GROUP BY ALL",
    "current_shadow": "SELECT shadow_version, count(*) AS n FROM staged_decisions WHERE shadow_version IS NOT NULL GROUP BY 1 ORDER BY n DESC, min(decided_at), shadow_version LIMIT 1",
    "hash_draw": f"SELECT event_id, {_DRAW} AS drawn FROM (SELECT DISTINCT event_id FROM staged_decisions)",
    "history_kept": f"""WITH {ST}, {LAB}, j AS (SELECT st.event_id, card_id, epoch_us(decided_at) AS decided_us, epoch_us(label_time) AS label_us, is_fraud, recovered_cents, {_TSTRAT} AS stratum, {_TRATE} AS rate FROM st JOIN lab ON st.event_id = lab.event_id)
SELECT event_id, card_id, decided_us, label_us, is_fraud, recovered_cents, stratum, 1.0 / rate AS weight FROM j WHERE {_DRAW} < rate""",
    "history_manifest": f"""WITH {LAB}, e AS (SELECT event_id, min(event_time) AS event_time, count(*) AS copies, any_value(action) AS action FROM staged_decisions GROUP BY event_id),
j AS (SELECT e.*, label_time, is_fraud, {_TSTRAT} AS stratum, {_TRATE} AS rate FROM e LEFT JOIN lab ON e.event_id = lab.event_id), k AS (SELECT *, {_DRAW} AS d, action <> 'approve' OR {_DRAW} < 0.5 AS cand FROM j),
m AS (SELECT *, cand AND label_time IS NOT NULL AND d < rate AS kept FROM k)
SELECT strftime(event_time, '%Y-%m-%d') AS day, CAST(sum(copies) AS BIGINT) AS staged_rows, CAST(sum(copies - 1) AS BIGINT) AS duplicates, count(*) FILTER (cand) AS candidates, count(*) FILTER (cand AND label_time IS NULL) AS unlabelled,
count(*) FILTER (kept AND stratum = 'acted') AS kept_acted, count(*) FILTER (kept AND stratum = 'fraud') AS kept_fraud, count(*) FILTER (kept AND stratum = 'legit') AS kept_legit,
CAST(coalesce(sum(1.0 / rate) FILTER (kept), 0) AS DOUBLE) AS estimated_transactions, CAST(coalesce(sum(1.0 / rate) FILTER (kept AND is_fraud), 0) AS DOUBLE) AS estimated_frauds FROM m GROUP BY 1""",
    "history_hours": f"SELECT epoch_us(event_time) // {HOUR} * {HOUR} AS hour_us, count(*) AS n_rows, epoch_us(event_time) // {HOUR} * {HOUR} + {HOUR + 600_000_000} <= epoch_us(TIMESTAMPTZ '{NOW}+00') AS closed FROM staged_decisions GROUP BY ALL",
    "history_finalisable": f"""SELECT strftime(event_time, '%Y-%m-%d') AS day, count(*) AS n_rows FROM staged_decisions GROUP BY 1
HAVING (epoch_us(min(event_time)) // {DAY} + 1) * {DAY} + {7 * DAY + 6 * HOUR} <= epoch_us(TIMESTAMPTZ '{NOW}+00') AND day NOT BETWEEN '2027-09-01' AND '2027-09-20'""",
    "unlabelled": "SELECT count(*) AS events, count(*) FILTER (event_id NOT IN (SELECT event_id FROM label_spool)) AS unlabelled FROM (SELECT DISTINCT event_id FROM staged_decisions)",
    "train_at_cutoff": f"WITH {KEPT} SELECT event_id, is_fraud, weight, CASE WHEN label_time <= TIMESTAMPTZ '{CUTOFF}+00' THEN 'known' ELSE 'waiting' END AS state FROM kept WHERE event_time < TIMESTAMPTZ '{CUTOFF}+00'",
    "train_split": f"""WITH {KEPT}, b AS (SELECT epoch_us(min(event_time)) AS a, epoch_us(max(event_time)) AS z, epoch_us(max(label_time)) AS l FROM kept),
p AS (SELECT *, CAST(floor(a + (z - a) * 0.7) AS BIGINT) AS pt FROM kept, b)
SELECT CASE WHEN epoch_us(event_time) < pt AND epoch_us(label_time) <= pt THEN 'train' WHEN epoch_us(event_time) >= pt THEN 'test' END AS part, count(*) AS n, count(*) FILTER (is_fraud) AS frauds FROM p GROUP BY 1""",
    "train_bounded": f"""WITH {KEPT}, c AS (SELECT least(1.0, 400000 / nullif(count(*) FILTER (is_fraud), 0)) AS f, least(1.0, 2000000 / nullif(count(*) FILTER (NOT is_fraud), 0)) AS l FROM kept),
s AS (SELECT event_id, is_fraud, w, CASE WHEN is_fraud THEN f ELSE l END AS share FROM kept, c) SELECT event_id, is_fraud, round(w / share, 6) AS weight FROM s WHERE {_u64(history.TRAIN_SALT)} < share""",
    "train_standardisation": _standardisation_sql(),
    "pr_auc": _ap("champion_score"),
    "pr_auc_by_action": f"SELECT action, n_rows, average_precision FROM ({_ap('round(champion_score, 2)', 'action')})",
    "decision_cost": f"""WITH {KEPT} SELECT champion_version, round(sum(w * (CASE WHEN action = 'approve' AND is_fraud THEN amount_cents ELSE 0 END + CASE WHEN action = 'review' THEN 500.0 ELSE 0 END + CASE WHEN action = 'decline' AND NOT is_fraud THEN amount_cents * 0.1 ELSE 0 END)), 3) AS cost FROM kept GROUP BY 1""",
    "quality_overall": f"WITH {KEPT} SELECT {_QUALITY} FROM kept WHERE is_fraud IS NOT NULL",
    "quality_daily": f"WITH {KEPT}, q AS (SELECT *, strftime(event_time, '%Y-%m-%d') AS day FROM kept WHERE is_fraud IS NOT NULL) SELECT coalesce(day, '(all)') AS day, {_QUALITY} FROM q GROUP BY ROLLUP (day)",
    "quality_by_action": _by("action"),
    "quality_by_rule": _by("rule"),
    "quality_bands": f"""WITH {KEPT}, g AS (SELECT CAST(CASE {_BAND} END AS DOUBLE) AS band, sum(w) AS w, sum(w * champion_score) AS ws, sum(CASE WHEN is_fraud THEN w ELSE 0 END) AS f FROM kept WHERE is_fraud IS NOT NULL AND champion_score IS NOT NULL GROUP BY 1)
SELECT band, round(w / sum(w) OVER (), 9) AS share, round(ws / w, 9) AS mean_score, round(f / w, 9) AS fraud_rate FROM g""",
    "t_interval": f"""WITH r AS (SELECT action, strftime(event_time, '%Y-%m-%d') AS run, CAST(count(*) AS DOUBLE) AS v FROM staged_decisions GROUP BY ALL), g AS (SELECT action, count(*) AS n, avg(v) AS mean, stddev_samp(v) AS s FROM r GROUP BY action)
SELECT action, n, round(mean, 9) AS mean, round(mean - (CASE {_TQ} END) * s / sqrt(n), 9) AS low, round(mean + (CASE {_TQ} END) * s / sqrt(n), 9) AS high FROM g""",
}
