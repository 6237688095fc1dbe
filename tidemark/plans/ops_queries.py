"""Drift, review-queue and operations queries, and the SQL they are compared with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import drift, metrics, ops, queue
from tidemark.operators.decide import expected_loss
from tidemark.operators.ordered import exact_percentiles
from tidemark.plans.decision_queries import KEPT, ST, distinct_staged, kept
from tidemark.session import table, written

REFERENCE_END = "2027-09-15"
LEAST = 100
QUANTITIES = ("amount_cents", "card_txn_count_24h", "champion_score", "declined")


def _values(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Reference and current values of the distinct staged events, in long form."""
    rows = distinct_staged(spark, d)
    q = {"amount_cents": F.col("amount_cents"), "card_txn_count_24h": F.col("card_txn_count_24h"), "champion_score": F.col("champion_score"), "declined": (F.col("action") == "decline").cast("double")}
    long = written(drift.long_form(rows, F.to_date("event_time"), q), "drift")
    cut = F.lit(REFERENCE_END).cast("date")
    return long.where(F.col("day") < cut), long.where(F.col("day") >= cut)


def drift_bins(spark: SparkSession, d: str) -> DataFrame:
    reference, _ = _values(spark, d)
    return drift.bin_edges(reference).select("quantity", F.posexplode("edges").alias("k", "edge")).select("quantity", "k", F.round("edge", 9).alias("edge"))


def drift_psi(spark: SparkSession, d: str) -> DataFrame:
    reference, current = _values(spark, d)
    return drift.psi(reference, current, drift.bin_edges(reference)).select(F.date_format("day", "yyyy-MM-dd").alias("day"), "quantity", F.round("psi", 9).alias("psi"))


def drift_ks(spark: SparkSession, d: str) -> DataFrame:
    return drift.ks(*_values(spark, d)).select(F.date_format("day", "yyyy-MM-dd").alias("day"), "quantity", "n", "n_reference", F.round("ks", 9).alias("ks"), F.round("ks_p", 6).alias("ks_p"))


def _verdicts(spark: SparkSession, d: str) -> DataFrame:
    reference, current = _values(spark, d)
    days = spark.sql(f"SELECT explode(sequence(date'{REFERENCE_END}', date'2027-11-30')) AS day")
    return drift.judged(reference, current, days, QUANTITIES, LEAST)


def drift_judge(spark: SparkSession, d: str) -> DataFrame:
    return _verdicts(spark, d).select(F.date_format("day", "yyyy-MM-dd").alias("day"), "quantity", "n", F.round("psi", 6).alias("psi"), F.round("ks", 6).alias("ks"), "status")


def drift_trigger(spark: SparkSession, d: str) -> DataFrame:
    return drift.triggers(_verdicts(spark, d)).select(F.date_format("day", "yyyy-MM-dd").alias("day"), F.array_join("quantities", ",").alias("quantities"))


def drift_requests(spark: SparkSession, d: str) -> DataFrame:
    """A request for every trigger day: when the drift that it answers began and when it ended."""
    v = written(_verdicts(spark, d), "verdicts")
    t = drift.triggers(v).select(F.date_format("day", "yyyy-MM-dd").alias("request"), F.col("day").alias("opened_on"), F.date_sub("day", 1).alias("evidence_day"), "quantities")
    both = drift.runs_of_any(v, t).join(drift.resolutions(v, t), "request")
    return both.select("request", F.date_format("began", "yyyy-MM-dd").alias("began"), F.date_format("ended_on", "yyyy-MM-dd").alias("ended_on"))


def drift_reference_days(spark: SparkSession, d: str) -> DataFrame:
    hours = distinct_staged(spark, d).groupBy(F.to_date("event_time").alias("day")).agg(F.count_distinct(F.hour("event_time")).alias("n_hours"))
    cold = spark.sql("SELECT timestamp'2027-09-03 06:00:00' AS started_at")
    return drift.reference_days(hours, cold, F.lit("2027-09-02").cast("date"), least_hours=20).select(F.date_format("first_day", "yyyy-MM-dd").alias("first_day"))


def percentiles_exact(spark: SparkSession, d: str) -> DataFrame:
    got = exact_percentiles(distinct_staged(spark, d), ["action"], "amount_cents", [0.0, 0.25, 0.5, 0.9, 0.99, 1.0])
    return got.select("action", "n", *[F.round(F.col("q")[i], 6).alias(f"q{i}") for i in range(6)])


RECOVERY, REVIEW_COST = 0.3, 500.0


def _queue(spark: SparkSession, d: str) -> DataFrame:
    items = kept(spark, d).select("event_id", F.unix_micros("decided_at").alias("arrived_us"), "amount_cents", "is_fraud", "champion_score")
    policies = {"score": F.col("champion_score"), "expected_loss": expected_loss(F.col("champion_score"), F.col("amount_cents"), RECOVERY, REVIEW_COST)}
    return queue.simulate(items, policies, capacity=2, max_wait_us=4 * queue.HOUR_US, recovery=RECOVERY)


def queue_days(spark: SparkSession, d: str) -> DataFrame:
    return _queue(spark, d).select(F.date_format(F.date_from_unix_date(F.col("day").cast("int")), "yyyy-MM-dd").alias("day"), "policy", "reviewed", F.round("caught_cents", 4).alias("caught_cents"), "expired")


def queue_compare(spark: SparkSession, d: str) -> DataFrame:
    """The mean daily gain of ranking by expected loss, with its interval over days."""
    diff = queue.paired_by_day(_queue(spark, d), "expected_loss", "score").where(F.col("difference").isNotNull()).withColumn("pair", F.lit("expected_loss-score"))
    return metrics.t_interval(diff, ["pair"], "difference")


def queue_expected_loss(spark: SparkSession, d: str) -> DataFrame:
    return kept(spark, d).select("event_id", F.round(expected_loss(F.col("champion_score"), F.col("amount_cents"), RECOVERY, REVIEW_COST), 6).alias("expected_loss"))


def _minutes(spark: SparkSession, d: str) -> DataFrame:
    return ops.assembled(table(spark, d, "latency_minutes"))


def ops_minutes(spark: SparkSession, d: str) -> DataFrame:
    rows = _minutes(spark, d)
    return rows.select("instance_id", F.unix_micros("at").alias("at_us"), "decisions", "sent", "feed_lag", ops.caught_up().alias("caught_up"))


def ops_idle_runs(spark: SparkSession, d: str) -> DataFrame:
    return ops.idle_runs(_minutes(spark, d)).select("instance_id", F.unix_micros("first").alias("first_us"), F.unix_micros("last").alias("last_us"), "minutes")


#: Notices before stops of either instance, one before none, one before the instance's minutes begin.
NOTICES = "VALUES ('scorer-00-00', timestamp'2027-10-31 16:40:00'), ('scorer-00-00', timestamp'2027-10-31 17:50:30'), ('scorer-00-00', timestamp'2027-10-31 18:35:00'), ('scorer-00-00', timestamp'2027-10-31 20:05:10'), ('scorer-00-01', timestamp'2027-10-18 15:00:00'), ('scorer-00-01', timestamp'2027-10-18 16:10:59'), ('scorer-00-01', timestamp'2027-09-05 10:00:30') AS t(instance_id, noticed_at)"


def ops_recoveries(spark: SparkSession, d: str) -> DataFrame:
    got = ops.recoveries(_minutes(spark, d), spark.sql(f"SELECT * FROM {NOTICES}"))
    return got.select("instance_id", F.unix_micros("noticed_at").alias("noticed_us"), F.unix_micros("end").alias("end_us"), "minutes_without_decisions", F.round("decided", 3).alias("decided"), F.round("decided_late", 3).alias("decided_late"))


def ops_availability(spark: SparkSession, d: str) -> DataFrame:
    got = ops.availability(_minutes(spark, d), spark.sql(f"SELECT * FROM {NOTICES}"), QS)
    return got.select("scope", "minutes", F.round("uptime", 9).alias("uptime"), F.round("total", 3).alias("total"), *[F.round(q, 9).alias(q) for q in QS])


def ops_histogram(spark: SparkSession, d: str) -> DataFrame:
    rows = _minutes(spark, d).withColumn("day", F.date_format("at", "yyyy-MM-dd"))
    return ops.merged_histograms(rows, ["day"]).select("day", F.col("le").cast("string").alias("le"), F.round("count", 3).alias("count"))


QS = {"p50": 0.5, "p95": 0.95, "p99": 0.99}


def ops_latency(spark: SparkSession, d: str) -> DataFrame:
    rows = _minutes(spark, d).withColumn("day", F.date_format("at", "yyyy-MM-dd"))
    got = ops.histogram_quantiles(ops.merged_histograms(rows, ["day"]), ["day"], QS)
    return got.select("day", F.round("total", 3).alias("total"), *[F.round(q, 9).alias(q) for q in QS])


def ops_daily(spark: SparkSession, d: str) -> DataFrame:
    got = ops.daily_rows(_minutes(spark, d))
    return got.select("day", "minutes", F.round("decisions", 3).alias("decisions"), F.round("peak_per_second", 6).alias("peak_per_second"), F.round("uptime", 9).alias("uptime"), "idle_minutes", F.round("over_budget_share", 9).alias("over_budget_share"))


QUERIES = {
    "drift_bins": drift_bins, "drift_psi": drift_psi, "drift_ks": drift_ks, "drift_judge": drift_judge, "drift_trigger": drift_trigger, "drift_requests": drift_requests, "drift_reference_days": drift_reference_days,
    "percentiles_exact": percentiles_exact, "queue_days": queue_days, "queue_compare": queue_compare, "queue_expected_loss": queue_expected_loss,
    "ops_minutes": ops_minutes, "ops_idle_runs": ops_idle_runs, "ops_recoveries": ops_recoveries, "ops_histogram": ops_histogram, "ops_latency": ops_latency, "ops_daily": ops_daily, "ops_availability": ops_availability,
}

_LONG = f"""{ST}, lf AS (SELECT CAST(event_time AS DATE) AS day, unnest(['amount_cents', 'card_txn_count_24h', 'champion_score', 'declined']) AS quantity,
  unnest([CAST(amount_cents AS DOUBLE), card_txn_count_24h, champion_score, CASE WHEN action = 'decline' THEN 1.0 ELSE 0.0 END]) AS value FROM st),
ref AS (SELECT * FROM lf WHERE value IS NOT NULL AND day < DATE '{REFERENCE_END}'), cur AS (SELECT * FROM lf WHERE value IS NOT NULL AND day >= DATE '{REFERENCE_END}'),
edges AS (SELECT quantity, list_sort(list_distinct(quantile_cont(value, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]))) AS edges FROM ref WHERE value <> -1 GROUP BY quantity)"""
_BIN = "CASE WHEN value = -1 THEN len(edges) + 1 ELSE len(list_filter(edges, lambda e: e <= value)) END"
_PSI = f"""rb AS (SELECT quantity, {_BIN} AS bin, count(*) AS n FROM ref JOIN edges USING (quantity) GROUP BY ALL), cb AS (SELECT day, quantity, {_BIN} AS bin, count(*) AS n FROM cur JOIN edges USING (quantity) GROUP BY ALL),
sp AS (SELECT DISTINCT day, quantity, unnest(range(0, len(edges) + 2)) AS bin FROM cur JOIN edges USING (quantity)),
rn AS (SELECT quantity, sum(n) AS t FROM rb GROUP BY 1), cn AS (SELECT day, quantity, sum(n) AS t FROM cb GROUP BY ALL),
sh AS (SELECT sp.day, sp.quantity, greatest(coalesce(cb.n, 0) / cn.t, 0.0001) AS a, greatest(coalesce(rb.n, 0) / rn.t, 0.0001) AS e FROM sp JOIN cn USING (day, quantity) JOIN rn USING (quantity)
  LEFT JOIN cb ON cb.day = sp.day AND cb.quantity = sp.quantity AND cb.bin = sp.bin LEFT JOIN rb ON rb.quantity = sp.quantity AND rb.bin = sp.bin),
psi AS (SELECT day, quantity, sum((a - e) * ln(a / e)) AS psi FROM sh GROUP BY ALL)"""
_KS = """rv AS (SELECT quantity, value, count(*) AS r FROM ref GROUP BY ALL), cv AS (SELECT day, quantity, value, count(*) AS c FROM cur GROUP BY ALL),
rc AS (SELECT quantity, value, sum(r) OVER (PARTITION BY quantity ORDER BY value) AS upto, sum(r) OVER (PARTITION BY quantity) AS nr FROM rv),
cc AS (SELECT day, quantity, value, sum(c) OVER (PARTITION BY day, quantity ORDER BY value) AS upto, sum(c) OVER (PARTITION BY day, quantity) AS nc FROM cv),
grid AS (SELECT DISTINCT c.day, c.quantity, v.value FROM (SELECT DISTINCT day, quantity FROM cv) c JOIN (SELECT quantity, value FROM rv UNION SELECT quantity, value FROM cv) v ON v.quantity = c.quantity),
g1 AS (SELECT g.*, rc.upto AS ru FROM grid g ASOF LEFT JOIN rc ON rc.quantity = g.quantity AND g.value >= rc.value),
g2 AS (SELECT g1.*, cc.upto AS cu FROM g1 ASOF LEFT JOIN cc ON cc.quantity = g1.quantity AND cc.day = g1.day AND g1.value >= cc.value),
ks0 AS (SELECT g2.day, g2.quantity, CAST(max(c.nc) AS BIGINT) AS n, CAST(max(r.nr) AS BIGINT) AS n_reference, max(abs(coalesce(ru, 0) / r.nr - coalesce(cu, 0) / c.nc)) AS ks FROM g2
  JOIN (SELECT DISTINCT quantity, nr FROM rc) r ON r.quantity = g2.quantity JOIN (SELECT DISTINCT day, quantity, nc FROM cc) c ON c.day = g2.day AND c.quantity = g2.quantity GROUP BY ALL),
kl AS (SELECT *, sqrt(n * n_reference / (n + n_reference)) AS m FROM ks0), kx AS (SELECT *, (m + 0.12 + 0.11 / m) * ks AS x FROM kl),
ks AS (SELECT *, CASE WHEN x < 0.001 THEN 1 ELSE least(1, greatest(0, list_sum(list_transform(range(1, 101), lambda k: (CASE WHEN k % 2 = 1 THEN 2.0 ELSE -2.0 END) * exp(-2.0 * k * k * x * x))))) END AS ks_p FROM kx)"""
_JUDGE = f"""{_LONG}, {_PSI}, {_KS}, spine AS (SELECT CAST(unnest(generate_series(TIMESTAMP '{REFERENCE_END}', TIMESTAMP '2027-11-30', INTERVAL 1 DAY)) AS DATE) AS day),
v AS (SELECT s.day, q.quantity, coalesce(ks.n, 0) AS n, psi.psi, ks.ks, ks.ks_p, CASE WHEN coalesce(ks.n, 0) < {LEAST} OR coalesce(ks.n_reference, 0) < {LEAST} THEN 'insufficient'
  WHEN psi.psi >= 0.25 OR (ks.ks >= 0.1 AND ks.ks_p < 0.01) THEN 'drifted' WHEN psi.psi >= 0.1 THEN 'moderate' ELSE 'stable' END AS status
  FROM spine s CROSS JOIN (SELECT unnest(['amount_cents', 'card_txn_count_24h', 'champion_score', 'declined']) AS quantity) q
  LEFT JOIN psi ON psi.day = s.day AND psi.quantity = q.quantity LEFT JOIN ks ON ks.day = s.day AND ks.quantity = q.quantity)"""
_TRIG = "tr AS (SELECT a.day, list_sort(list(a.quantity)) AS qs FROM v a JOIN v b ON a.quantity = b.quantity AND a.day = b.day + 1 AND a.status = 'drifted' AND b.status = 'drifted' GROUP BY a.day)"
_M1 = """mm AS (SELECT instance_id, epoch_us(date_trunc('minute', minute_at)) AS mt, max(CASE WHEN NOT isnan(decisions) THEN decisions END) AS decisions, max(CASE WHEN NOT isnan(sent) THEN sent END) AS sent, max(CASE WHEN NOT isnan(feed_lag) THEN feed_lag END) AS feed_lag,
  arg_max(list_sort(map_entries(buckets)), list_max(map_values(buckets))) FILTER (buckets IS NOT NULL AND cardinality(buckets) > 0) AS e FROM latency_minutes WHERE minute_at IS NOT NULL GROUP BY ALL),
sp AS (SELECT instance_id, unnest(generate_series(min(mt), max(mt), 60000000)) AS mt FROM mm GROUP BY instance_id),
m AS (SELECT sp.instance_id, sp.mt, coalesce(decisions, 0) AS decisions, coalesce(sent, 0) AS sent, feed_lag, e, coalesce(feed_lag <= 1.0, false) AND coalesce(sent, 0) > 0 AND coalesce(decisions, 0) > 0 AND coalesce(decisions, 0) <= coalesce(sent, 0) * 1.1 AS cu
  FROM sp LEFT JOIN mm ON sp.instance_id = mm.instance_id AND sp.mt = mm.mt)"""
_OVER = "(CASE WHEN e IS NULL THEN 0 ELSE greatest(coalesce(list_max([x.value FOR x IN e IF x.key = 'inf'::DOUBLE]), 0) - coalesce(list_max([x.value FOR x IN e IF x.key <= {}]), 0), 0) END)"
_HIST = f"""{_M1}, st1 AS (SELECT strftime(make_timestamp(mt), '%Y-%m-%d') AS day, unnest(e) AS x, instance_id, mt FROM m WHERE e IS NOT NULL),
st2 AS (SELECT day, x.key AS le, instance_id, mt, max(x.value) OVER (PARTITION BY instance_id, mt ORDER BY x.key ROWS UNBOUNDED PRECEDING) AS c FROM st1),
rise AS (SELECT day, le, c - coalesce(lag(c) OVER (PARTITION BY instance_id, mt ORDER BY le), 0) AS r FROM st2),
h AS (SELECT day, le, sum(sum(r)) OVER (PARTITION BY day ORDER BY le ROWS UNBOUNDED PRECEDING) AS c FROM rise GROUP BY day, le)"""


def _hq(name: str, q: float) -> str:
    return f"""round(arg_min(CASE WHEN total > 0 THEN CASE WHEN le = 'inf'::DOUBLE THEN lo WHEN c = c0 THEN le ELSE lo + (le - lo) * (({q} * total - c0) / (c - c0)) END END, le) FILTER (c >= {q} * total), 9) AS {name}"""


SQL = {
    "drift_bins": f"WITH {_LONG} SELECT quantity, CAST(k AS INTEGER) AS k, round(edges[k + 1], 9) AS edge FROM (SELECT quantity, edges, unnest(range(0, len(edges))) AS k FROM edges)",
    "drift_psi": f"WITH {_LONG}, {_PSI} SELECT strftime(day, '%Y-%m-%d') AS day, quantity, round(psi, 9) AS psi FROM psi",
    "drift_ks": f"WITH {_LONG}, {_KS} SELECT strftime(day, '%Y-%m-%d') AS day, quantity, n, n_reference, round(ks, 9) AS ks, round(ks_p, 6) AS ks_p FROM ks",
    "drift_judge": f"WITH {_JUDGE} SELECT strftime(day, '%Y-%m-%d') AS day, quantity, n, round(psi, 6) AS psi, round(ks, 6) AS ks, status FROM v",
    "drift_trigger": f"WITH {_JUDGE}, {_TRIG} SELECT strftime(day, '%Y-%m-%d') AS day, array_to_string(qs, ',') AS quantities FROM tr",
    "drift_reference_days": f"""WITH {ST}, h AS (SELECT CAST(event_time AS DATE) AS day, count(DISTINCT hour(event_time)) AS n FROM st GROUP BY 1),
g AS (SELECT day FROM h WHERE day >= DATE '2027-09-02' AND n >= 20 AND NOT (TIMESTAMP '2027-09-03 06:00:00' > day - INTERVAL 25 HOUR AND TIMESTAMP '2027-09-03 06:00:00' < day + INTERVAL 24 HOUR))
SELECT strftime(min(a.day), '%Y-%m-%d') AS first_day FROM g a JOIN g b ON b.day = a.day + 1 HAVING min(a.day) IS NOT NULL""",
    "percentiles_exact": f"WITH {ST}, q AS (SELECT action, count(amount_cents) AS n, quantile_cont(CAST(amount_cents AS DOUBLE), [0.0, 0.25, 0.5, 0.9, 0.99, 1.0]) AS q FROM st GROUP BY action) SELECT action, n, {', '.join(f'round(q[{i + 1}], 6) AS q{i}' for i in range(6))} FROM q",
    "queue_expected_loss": f"WITH {KEPT} SELECT event_id, round(champion_score * amount_cents * 0.7 - 500.0, 6) AS expected_loss FROM kept",
    "ops_minutes": f"WITH {_M1} SELECT instance_id, mt AS at_us, decisions, sent, feed_lag, cu AS caught_up FROM m",
    "ops_idle_runs": f"""WITH {_M1}, i AS (SELECT instance_id, mt, mt - 60000000 * row_number() OVER (PARTITION BY instance_id ORDER BY mt) AS g FROM m WHERE decisions <= 0)
SELECT instance_id, min(mt) AS first_us, max(mt) AS last_us, count(*) AS minutes FROM i GROUP BY instance_id, g""",
    "ops_recoveries": f"""WITH {_M1}, nn AS (SELECT instance_id, epoch_us(noticed_at) AS nu, epoch_us(noticed_at) // 60000000 * 60000000 AS su FROM (SELECT * FROM ({NOTICES.replace("timestamp'", "TIMESTAMP '").replace(" AS t(", ") AS t(")})),
f AS (SELECT *, cu AND coalesce(lead(cu) OVER (PARTITION BY instance_id ORDER BY mt), false) AS ok FROM m),
a AS (SELECT f.*, nu, su FROM nn JOIN f ON f.instance_id = nn.instance_id AND f.mt >= su),
s AS (SELECT *, min(CASE WHEN NOT cu AND mt < su + 900000000 THEN mt END) OVER (PARTITION BY instance_id, nu) AS stop FROM a),
w AS (SELECT *, min(CASE WHEN ok AND mt >= stop THEN mt END) OVER (PARTITION BY instance_id, nu) AS eu FROM s WHERE stop IS NOT NULL)
SELECT instance_id, nu AS noticed_us, eu AS end_us, count(*) FILTER (decisions <= 0) AS minutes_without_decisions, round(sum(decisions), 3) AS decided, round(sum({_OVER.format("1.0")}), 3) AS decided_late FROM w WHERE eu IS NULL OR mt < eu GROUP BY instance_id, nu, eu""",
    "ops_histogram": f"WITH {_HIST} SELECT day, CASE WHEN le = 'inf'::DOUBLE THEN 'Infinity' ELSE CAST(le AS VARCHAR) END AS le, round(c, 3) AS count FROM h",
    "ops_latency": f"""WITH {_HIST}, b AS (SELECT *, coalesce(lag(le) OVER (PARTITION BY day ORDER BY le), 0) AS lo, coalesce(lag(c) OVER (PARTITION BY day ORDER BY le), 0) AS c0, max(c) FILTER (le = 'inf'::DOUBLE) OVER (PARTITION BY day) AS total FROM h)
SELECT day, round(coalesce(max(total), 0), 3) AS total, {", ".join(_hq(n, q) for n, q in QS.items())} FROM b GROUP BY day""",
    "ops_daily": f"""WITH {_M1}, p AS (SELECT strftime(make_timestamp(mt), '%Y-%m-%d') AS day, mt, sum(decisions) AS dd, sum({_OVER.format("0.05")}) AS ov, sum(CASE WHEN e IS NULL THEN 0 ELSE coalesce(list_max([x.value FOR x IN e IF x.key = 'inf'::DOUBLE]), 0) END) AS n FROM m GROUP BY ALL)
SELECT day, count(*) AS minutes, round(sum(dd), 3) AS decisions, round(max(dd) / 60, 6) AS peak_per_second, round(count(*) FILTER (dd > 0) / count(*), 9) AS uptime, count(*) FILTER (dd <= 0) AS idle_minutes, round(sum(ov) / nullif(sum(n), 0), 9) AS over_budget_share FROM p GROUP BY day""",
}

SQL["drift_requests"] = f"""WITH {_JUDGE}, {_TRIG},
dd AS (SELECT DISTINCT tr.day AS r, v.day AS d FROM tr JOIN v ON list_contains(qs, v.quantity) AND v.status = 'drifted' AND v.day <= tr.day - 1),
bk AS (SELECT r, d, row_number() OVER (PARTITION BY r ORDER BY d DESC) AS k FROM dd), bg AS (SELECT r, min(d) AS began FROM bk WHERE (r - 1) - d = k - 1 GROUP BY r),
cl AS (SELECT tr.day AS r, v.day AS d, count(*) FILTER (v.status NOT IN ('drifted', 'insufficient')) = len(any_value(qs)) AS clean FROM tr JOIN v ON list_contains(qs, v.quantity) AND v.day > tr.day GROUP BY tr.day, v.day),
pr AS (SELECT r, d, clean AND lag(clean) OVER w AND d - lag(d) OVER w = 1 AS ok FROM cl WINDOW w AS (PARTITION BY r ORDER BY d)), en AS (SELECT r, min(d) AS ended FROM pr WHERE ok GROUP BY r)
SELECT strftime(tr.day, '%Y-%m-%d') AS request, strftime(coalesce(began, tr.day - 1), '%Y-%m-%d') AS began, strftime(ended, '%Y-%m-%d') AS ended_on FROM tr LEFT JOIN bg ON bg.r = tr.day LEFT JOIN en ON en.r = tr.day"""
_WINDOWS = SQL["ops_recoveries"].removeprefix("WITH ").rsplit("\nSELECT", 1)[0]
_SCOPES = f"""{_WINDOWS}, rw AS (SELECT DISTINCT instance_id, su, eu FROM w),
al AS (SELECT 'every' AS day, * FROM m UNION ALL SELECT 'serving', * FROM m WHERE NOT EXISTS (SELECT 1 FROM rw WHERE rw.instance_id = m.instance_id AND m.mt >= su AND (eu IS NULL OR m.mt < eu)))"""
_SCOPED = _HIST.replace(_M1, _SCOPES).replace("strftime(make_timestamp(mt), '%Y-%m-%d') AS day", "day").replace("FROM m WHERE e IS NOT NULL", "FROM al WHERE e IS NOT NULL").replace("PARTITION BY instance_id, mt", "PARTITION BY day, instance_id, mt")
SQL["ops_availability"] = f"""WITH {_SCOPED}, b AS (SELECT *, coalesce(lag(le) OVER (PARTITION BY day ORDER BY le), 0) AS lo, coalesce(lag(c) OVER (PARTITION BY day ORDER BY le), 0) AS c0, max(c) FILTER (le = 'inf'::DOUBLE) OVER (PARTITION BY day) AS total FROM h),
lq AS (SELECT day, round(coalesce(max(total), 0), 3) AS total, {", ".join(_hq(n, q) for n, q in QS.items())} FROM b GROUP BY day), up AS (SELECT day, count(*) AS minutes, round(count(*) FILTER (decisions > 0) / count(*), 9) AS uptime FROM al GROUP BY day)
SELECT day AS scope, minutes, uptime, total, {", ".join(QS)} FROM up LEFT JOIN lq USING (day)"""
