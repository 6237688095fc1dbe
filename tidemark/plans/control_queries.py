"""Queries on requests, candidates, replays, gates, alerts and merged streams, and the SQL they are compared with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import control, ops
from tidemark.plans.decision_queries import _TQ, KEPT, ST, distinct_staged, kept
from tidemark.plans.ops_queries import _JUDGE, _M1, _TRIG, _minutes, _verdicts
from tidemark.session import table, written

QS = {"p50": 0.50, "p95": 0.95, "p99": 0.99}
REQUESTS = "VALUES ('a', date'2027-11-20', date'2027-11-18'), ('b', date'2027-10-01', CAST(NULL AS DATE)), ('c', date'2027-11-27', date'2027-11-28'), ('d', date'2027-11-01', CAST(NULL AS DATE)), ('e', date'2027-11-25', CAST(NULL AS DATE)) AS t(request, opened_on, drift_began)"
CANDIDATES = "VALUES ('d', 'v1', date'2027-11-27'), ('e', 'v2', date'2027-11-20'), ('b', 'v3', date'2027-11-28'), ('b', 'v4', date'2027-11-29'), ('a', 'v5', date'2027-11-10') AS t(request, version, last_day)"
STATES = "VALUES ('amount', date'2027-09-20', array('amount_cents')), ('all', date'2027-10-01', array('amount_cents', 'declined')), ('late', date'2027-11-28', array('amount_cents')), ('hand', date'2027-09-20', CAST(array() AS array<string>)), ('beaten', date'2027-11-28', array('declined')) AS t(request, opened_on, quantities)"


def _days(spark: SparkSession, d: str) -> DataFrame:
    return kept(spark, d).select(F.to_date("event_time").alias("day"))


def ctl_first_trigger(spark: SparkSession, d: str) -> DataFrame:
    got = control.first_trigger(written(_verdicts(spark, d), "verdicts"))
    return got.select(F.date_format("day", "yyyy-MM-dd").alias("day"), F.array_join("quantities", ",").alias("quantities"), "days_judged")


def ctl_recent_days(spark: SparkSession, d: str) -> DataFrame:
    return control.recent_days(_days(spark, d)).select(F.date_format("day", "yyyy-MM-dd").alias("day"))


def ctl_head(spark: SparkSession, d: str) -> DataFrame:
    """The ten dearest frauds, a report's examples."""
    return control.head(kept(spark, d).where("is_fraud"), [F.desc("amount_cents"), "event_id"], 10).select("event_id", "amount_cents")


def ctl_replayed_rows(spark: SparkSession, d: str) -> DataFrame:
    """By champion and shadow, the kept rows that the shadow may be replayed on."""
    rows = kept(spark, d)
    out = None
    for version in ("v1", "v2"):
        named = rows.select(F.min("champion_version").alias("a"), F.max("champion_version").alias("b")).first()
        part = control.replayed_rows(rows, (named.a if version == "v1" else named.b) or "").groupBy("champion_version").agg(F.count(F.lit(1)).alias("n")).withColumn("which", F.lit(version))
        out = part if out is None else out.unionByName(part)
    return out


def ctl_merged_streams(spark: SparkSession, d: str) -> DataFrame:
    """Staged decisions and labels as one log in order of their times."""
    staged = table(spark, d, "staged_decisions").select("event_id", F.col("decided_at").alias("at"))
    labels = table(spark, d, "label_spool").select("event_id", F.col("label_time").alias("at"))
    return control.merged_streams({"decision": staged, "label": labels}, "at", ["event_id"]).select("seq", "stream", "event_id", F.unix_micros("at").alias("us"))


def ctl_load_summary(spark: SparkSession, d: str) -> DataFrame:
    """Days as runs: the delay of a decision in milliseconds, by action."""
    rows = distinct_staged(spark, d).select(F.to_date("event_time").alias("run"), "action", ((F.unix_micros("decided_at") - F.unix_micros("event_time")) / 1000).alias("ms"))
    got = control.load_summary(rows, "run", "action", "ms", QS)
    return got.select("action", "quantile", "n", *[F.round(c, 5).alias(c) for c in ("mean", "low", "high")])


def ctl_candidates_due(spark: SparkSession, d: str) -> DataFrame:
    got = control.candidates_due(spark.sql(f"SELECT * FROM {REQUESTS}"), _days(spark, d), spark.sql(f"SELECT * FROM {CANDIDATES}"))
    return got.select("request", F.array_join(F.transform("days", lambda x: F.date_format(x, "yyyy-MM-dd")), ",").alias("days"))


def ctl_replays_due(spark: SparkSession, d: str) -> DataFrame:
    got = control.replays_due(spark.sql(f"SELECT version, last_day FROM {CANDIDATES}"), _days(spark, d), spark.sql("SELECT 'v5' AS version"))
    return got.select("version", F.array_join(F.transform("days", lambda x: F.date_format(x, "yyyy-MM-dd")), ",").alias("days"))


def ctl_gates_due(spark: SparkSession, d: str) -> DataFrame:
    """Shadows by the days that they scored on; the most common one was told to be ineligible before."""
    scored = kept(spark, d).where("shadow_version IS NOT NULL AND shadow_score IS NOT NULL")
    shadows = scored.groupBy(F.col("shadow_version").alias("version")).agg(F.count_distinct(F.to_date("event_time")).alias("days_scored"), (F.count(F.lit(1)) % 2 == 0).alias("eligible_now"))
    told = shadows.agg(F.max("version").alias("version")).where("version IS NOT NULL").withColumn("eligible", F.lit(False))
    return control.gates_due(shadows, told)


def ctl_coverage(spark: SparkSession, d: str) -> DataFrame:
    last = _days(spark, d).agg(F.max("day").alias("last_trained"))
    asked = spark.sql(f"SELECT request, drift_began AS first_drifted FROM {REQUESTS} UNION ALL SELECT 'far', date'2027-12-24'").crossJoin(F.broadcast(last))
    return control.drift_coverage(asked).select("request", "covers_the_drift", "days_short")


def ctl_request_states(spark: SparkSession, d: str) -> DataFrame:
    return control.request_states(spark.sql(f"SELECT * FROM {STATES}"), written(_verdicts(spark, d), "verdicts"), spark.sql("SELECT 'beaten' AS request"))


def ctl_alerts(spark: SparkSession, d: str) -> DataFrame:
    """An instance's alert fires while it isn't caught up; told again every two minutes, so that reminders occur."""
    polls = _minutes(spark, d).select(F.col("instance_id").alias("alert"), F.unix_micros("at").alias("us"), (~ops.caught_up()).alias("firing"))
    return control.alert_messages(polls, 120_000_000)


QUERIES = {
    "ctl_first_trigger": ctl_first_trigger, "ctl_recent_days": ctl_recent_days, "ctl_head": ctl_head, "ctl_replayed_rows": ctl_replayed_rows, "ctl_merged_streams": ctl_merged_streams, "ctl_load_summary": ctl_load_summary,
    "ctl_candidates_due": ctl_candidates_due, "ctl_replays_due": ctl_replays_due, "ctl_gates_due": ctl_gates_due, "ctl_coverage": ctl_coverage, "ctl_request_states": ctl_request_states, "ctl_alerts": ctl_alerts,
}


def _values(text: str) -> str:
    body, name = text.replace("date'", "DATE '").replace("array(", "list_value(").replace("CAST(list_value() AS array<string>)", "CAST([] AS VARCHAR[])").rsplit(" AS t(", 1)
    return f"(SELECT * FROM ({body}) AS t({name})"


_D = f"{KEPT}, d AS (SELECT DISTINCT CAST(event_time AS DATE) AS day FROM kept WHERE event_time IS NOT NULL)"
_TEXT = "array_to_string(list_transform({}, lambda x: strftime(x, '%Y-%m-%d')), ',')"
SQL = {
    "ctl_first_trigger": f"WITH {_JUDGE}, {_TRIG}, o AS (SELECT * FROM tr ORDER BY day LIMIT 1) SELECT strftime(day, '%Y-%m-%d') AS day, array_to_string(qs, ',') AS quantities, (SELECT count(DISTINCT v.day) FROM v WHERE v.day <= o.day) AS days_judged FROM o",
    "ctl_recent_days": f"WITH {_D} SELECT strftime(day, '%Y-%m-%d') AS day FROM d ORDER BY day DESC LIMIT 14",
    "ctl_head": f"WITH {KEPT} SELECT event_id, amount_cents FROM kept WHERE is_fraud ORDER BY amount_cents DESC, event_id LIMIT 10",
    "ctl_replayed_rows": f"""WITH {KEPT} SELECT champion_version, count(*) AS n, 'v1' AS which FROM kept WHERE champion_version <> (SELECT min(champion_version) FROM kept) GROUP BY 1
UNION ALL SELECT champion_version, count(*), 'v2' FROM kept WHERE champion_version <> (SELECT max(champion_version) FROM kept) GROUP BY 1""",
    "ctl_merged_streams": """WITH u AS (SELECT 'decision' AS stream, event_id, decided_at AS t FROM staged_decisions UNION ALL SELECT 'label', event_id, label_time FROM label_spool)
SELECT row_number() OVER (ORDER BY t, stream, event_id NULLS FIRST) - 1 AS seq, stream, event_id, epoch_us(t) AS us FROM u WHERE t IS NOT NULL""",
    "ctl_load_summary": f"""WITH {ST}, r AS (SELECT CAST(event_time AS DATE) AS run, action, quantile_cont((epoch_us(decided_at) - epoch_us(event_time)) / 1000, [0.5, 0.95, 0.99]) AS q FROM st GROUP BY ALL),
e AS (SELECT action, unnest(['p50', 'p95', 'p99']) AS quantile, unnest(q) AS x FROM r), g AS (SELECT action, quantile, count(*) AS n, avg(x) AS mean, stddev_samp(x) AS s FROM e GROUP BY ALL)
SELECT action, quantile, n, round(mean, 5) AS mean, round(mean - (CASE {_TQ} END) * s / sqrt(n), 5) AS low, round(mean + (CASE {_TQ} END) * s / sqrt(n), 5) AS high FROM g""",
    "ctl_candidates_due": f"""WITH {_D}, rq AS {_values(REQUESTS)}, ca AS (SELECT request, max(last_day) AS last_day FROM {_values(CANDIDATES)} GROUP BY 1), al AS (SELECT list_sort(list(day)) AS a FROM d),
j AS (SELECT rq.request, drift_began, last_day, a FROM rq LEFT JOIN ca USING (request), al)
SELECT request, {_TEXT.format("a[greatest(len(a) - 13, 1):]")} AS days FROM j WHERE len(a) >= 3 AND (drift_began IS NULL OR len(list_filter(a, lambda x: x >= drift_began)) >= 3) AND (last_day IS NULL OR len(list_filter(a, lambda x: x > last_day)) >= 3)""",
    "ctl_replays_due": f"""WITH {_D}, ca AS {_values(CANDIDATES)} SELECT version, {_TEXT.format("list_sort(list(day))")} AS days FROM ca JOIN d ON day > last_day WHERE version <> 'v5' GROUP BY version HAVING count(*) >= 2""",
    "ctl_gates_due": f"""WITH {KEPT}, sh AS (SELECT shadow_version AS version, count(DISTINCT CAST(event_time AS DATE)) AS k, count(*) % 2 = 0 AS now FROM kept WHERE shadow_version IS NOT NULL AND shadow_score IS NOT NULL GROUP BY 1)
SELECT version FROM sh WHERE k >= 7 AND (version <> (SELECT max(version) FROM sh) OR now)""",
    "ctl_coverage": f"""WITH {_D}, l AS (SELECT max(day) AS last FROM d), rq AS (SELECT request, drift_began AS f FROM {_values(REQUESTS)} UNION ALL SELECT 'far', DATE '2027-12-24')
SELECT request, last >= f AS covers_the_drift, CASE WHEN f IS NOT NULL THEN CAST(greatest(0, f - last) AS INTEGER) END AS days_short FROM rq, l""",
    "ctl_request_states": f"""WITH {_JUDGE}, rq AS {_values(STATES)}, dd AS (SELECT DISTINCT day FROM v), l AS (SELECT * FROM (SELECT request, quantities, day, row_number() OVER (PARTITION BY request ORDER BY day DESC) AS k FROM rq JOIN dd ON day > opened_on) WHERE k <= 2),
x AS (SELECT request, any_value(quantities) AS qs, count(*) = 2 AND max(day) - min(day) = 1 AS adj, list(day) AS ds FROM l GROUP BY request)
SELECT rq.request, CASE WHEN rq.request = 'beaten' THEN 'answered' WHEN adj AND len(qs) > 0 AND NOT EXISTS (SELECT 1 FROM v WHERE list_contains(ds, v.day) AND list_contains(qs, v.quantity) AND v.status IN ('drifted', 'insufficient')) THEN 'drift-ended' ELSE 'still-open' END AS state FROM rq LEFT JOIN x USING (request)""",
    "ctl_alerts": f"""WITH {_M1}, p AS (SELECT instance_id AS alert, mt AS us, NOT cu AS firing, coalesce(lag(NOT cu) OVER w, false) AS was, sum(CASE WHEN cu THEN 1 ELSE 0 END) OVER (w ROWS UNBOUNDED PRECEDING) AS run FROM m WINDOW w AS (PARTITION BY instance_id ORDER BY mt)),
r AS (SELECT alert, run, min(us) AS a, max(us) AS b FROM p WHERE firing GROUP BY ALL)
SELECT alert, a AS us, 'fire' AS message FROM r UNION ALL SELECT alert, unnest(range(a + 120000000, b + 1, 120000000)), 'remind' FROM r UNION ALL SELECT alert, us, 'resolve' FROM p WHERE was AND NOT firing""",
}
