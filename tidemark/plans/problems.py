"""The queries of problems 1, 4, 5 and 6 over the test tables, with their SQL."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.times import DAY, day_text, hour_text
from tidemark.operators import dedupe, entity_vectors, late_views, rolling
from tidemark.session import scratch_path, table

END_DAY = "2027-11-29"
AS_OF = "2027-11-20 00:00:00"
#: The platform's rule names: what is watched, of which entity, over which window.
RULES = sorted(
    f"{what}_{of}_{window}"
    for what in ("amt", "dev", "geo", "mcc", "new", "rep", "ses", "vel")
    for of in ("bin", "card", "country", "device", "merchant", "pair")
    for window in ("5m", "1h", "6h", "24h", "7d")
)


def staged_events(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """Each event once, decided at its earliest decided_at, with the columns named."""
    rows = table(spark, d, "staged_decisions").select("event_id", "decided_at", *columns)
    return dedupe.first_copies(rows, "event_id", "decided_at", columns).drop("__copies")


def _decision_log(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "staged_decisions").select("event_id", "event_time", "decided_at", "amount_cents")
    return late_views.earliest_arrivals(rows, "event_id", "decided_at", ["event_time", "amount_cents"])


def _label_log(spark: SparkSession, d: str) -> DataFrame:
    """Labelled staged events: the event time and the earliest label's time and outcome.

    Both tables are reduced by event_id in one shuffle. The label packs into one long, time first, then
    the outcome (not fraud, fraud, unknown), so its minimum is the earliest label with ties decided."""
    staged = table(spark, d, "staged_decisions").select("event_id", "event_time", F.lit(None).cast("long").alias("packed"))
    code = F.when(F.col("is_fraud").isNull(), 2).otherwise(F.col("is_fraud").cast("int"))
    labels = table(spark, d, "label_spool").select("event_id", F.lit(None).cast("timestamp").alias("event_time"), (F.unix_micros("label_time") * 4 + code).alias("packed"))
    both = staged.unionByName(labels).where(F.col("event_id").isNotNull()).groupBy("event_id").agg(F.min("event_time").alias("event_time"), F.min("packed").alias("packed"))
    return both.where(F.col("event_time").isNotNull() & F.col("packed").isNotNull()).select(
        "event_id", "event_time", F.timestamp_micros(F.expr("packed div 4")).alias("label_time"), (F.pmod("packed", F.lit(4)) == 1).alias("is_fraud")
    )


def _one():
    return F.lit(1).cast("long")


#: Length of a delivery when a table is replayed through the layers.
REPLAY = 14 * DAY


def _decision_view(spark: SparkSession, d: str) -> late_views.LambdaView:
    measures = {"n_events": _one(), "amount_cents": F.col("amount_cents")}
    view = late_views.LambdaView(spark, scratch_path(spark, "hours"), late_views.HOURLY_DECISIONS, "event_time", "decided_at", measures)
    return late_views.replay(view, _decision_log(spark, d), REPLAY)


def _label_view(spark: SparkSession, d: str) -> late_views.LambdaView:
    measures = {"n_labels": _one(), "n_frauds": F.col("is_fraud").cast("long")}
    view = late_views.LambdaView(spark, scratch_path(spark, "days"), late_views.DAILY_LABELS, "event_time", "label_time", measures)
    return late_views.replay(view, _label_log(spark, d), REPLAY)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """What the layers corrected and refused, after a replay of both tables in order of arrival."""
    with ThreadPoolExecutor(2) as pool:  # the two views are independent
        views = list(pool.map(inheritable_thread_target(spark)(lambda make: make(spark, d)), (_decision_view, _label_view)))
    out = None
    for kind, view, text in zip(("decision", "label"), views, (hour_text, day_text), strict=True):
        for outcome, rows in (("corrected", view.corrections()), ("refused", view.refused())):
            part = rows.select(F.lit(kind).alias("kind"), "event_id", text(F.col("__start")).alias("period"), F.lit(outcome).alias("outcome"))
            out = part if out is None else out.unionByName(part)
    return out


def _frozen_periods(view: late_views.LambdaView, measures: list[str]) -> DataFrame:
    """(__start, measures, n_corrections, n_refused) of the frozen periods and those with refused rows only."""
    refused = view.refused().groupBy("__start").agg(F.count(F.lit(1)).alias("n_refused"))
    both = view.frozen().drop("frozen").withColumn("n_refused", F.lit(0).cast("long")).unionByName(refused, allowMissingColumns=True)
    return both.groupBy("__start").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in [*measures, "n_corrections", "n_refused"]])


def p1_hours(spark: SparkSession, d: str) -> DataFrame:
    measures = ["n_events", "amount_cents", "provisional_n_events", "provisional_amount_cents"]
    return _frozen_periods(_decision_view(spark, d), measures).select(
        hour_text(F.col("__start")).alias("period"), "n_events", "amount_cents", F.col("provisional_n_events").alias("first_n_events"), F.col("provisional_amount_cents").alias("first_amount_cents"), "n_corrections", "n_refused"
    )


def p1_days(spark: SparkSession, d: str) -> DataFrame:
    return _frozen_periods(_label_view(spark, d), ["n_labels", "n_frauds"]).select(day_text(F.col("__start")).alias("period"), "n_labels", "n_frauds", "n_corrections", "n_refused")


def p1_versions(spark: SparkSession, d: str) -> DataFrame:
    """What a run at every full hour would have left, in closed form: a replay would take 2,000 runs."""
    views = late_views.view_versions(
        _decision_log(spark, d), late_views.HOURLY_DECISIONS, "event_time", "decided_at", {"n_events": _one(), "amount_cents": F.col("amount_cents")}
    )
    return views.select(hour_text(F.col("__start")).alias("period"), hour_text(F.col("__run")).alias("run_at"), "n_events", "amount_cents", "frozen")


def _rolling(spark: SparkSession, d: str) -> DataFrame:
    return rolling.rolling_totals(staged_events(spark, d, "card_id", "event_time", "amount_cents"), "card_id", "event_time", "amount_cents", END_DAY)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    # total_7 / 7 >= 3.5 * total_30 / 30, without fractions
    case = (F.col("day_of_entity") >= 30) & (F.col("n_30") >= 10) & (F.col("total_7") * 60 >= F.col("total_30") * 49)
    return _rolling(spark, d).where(case).select("card_id", F.date_format(F.date_from_unix_date("day_no"), "yyyy-MM-dd").alias("day"))


def p4_rolling(spark: SparkSession, d: str) -> DataFrame:
    return _rolling(spark, d).select(
        "card_id", F.date_format(F.date_from_unix_date("day_no"), "yyyy-MM-dd").alias("day"), "n_7", "total_7", F.round("mean_7", 6).alias("mean_7"), "n_30", "total_30", F.round("mean_30", 6).alias("mean_30")
    )


def _vectors(spark: SparkSession, d: str, known: list[str] = ()) -> entity_vectors.VectorStore:
    """The stored states of the cards' days. Its states merged up to AS_OF are each card's vector as that day began."""
    store = entity_vectors.VectorStore(spark, scratch_path(spark, "vectors"), "card_id", "rule", "event_time", "amount_cents")
    if known:
        store.learn(spark.createDataFrame([(k,) for k in known], "name string"))
    store.add(0, staged_events(spark, d, "card_id", "event_time", "amount_cents", "rule"))
    return store


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    store = _vectors(spark, d)
    quiet = F.unix_micros(F.lit(AS_OF).cast("timestamp")) - F.unix_micros("last") > 21 * DAY
    case = (F.col("n") >= 3) & (F.col("total") >= 20_000) & quiet
    found = entity_vectors.vector_entries(store.merged(AS_OF[:10]), "card_id").where(case)
    return found.join(store.dictionary(), "idx").select("card_id", F.nullif("name", F.lit(entity_vectors.NULL_TYPE)).alias("rule"))


def p5_features(spark: SparkSession, d: str) -> DataFrame:
    """A column triple for every rule of the platform, occurring or not, and for any other in the data."""
    store = _vectors(spark, d, RULES)
    return entity_vectors.expand(store.merged(AS_OF[:10]), "card_id", store.types, F.lit(AS_OF).cast("timestamp"))


def p5_vectors(spark: SparkSession, d: str) -> DataFrame:
    """The vectors as text, for comparison: idx:n:total:last_us, joined by commas."""
    item = lambda x: F.concat_ws(":", x["idx"].cast("string"), x["n"].cast("string"), x["total"].cast("string"), F.unix_micros(x["last"]).cast("string"))
    return _vectors(spark, d).merged(AS_OF[:10]).select("card_id", F.array_join(F.transform("vector", item), ",").alias("vector"))


#: Deliveries that the table is taken in by, ranges of batches.
DELIVERIES = 10


def _seen(spark: SparkSession, rows: DataFrame, order: list[str] = ()) -> DataFrame:
    store = dedupe.SeenStore(spark, scratch_path(spark, "seen"))
    return dedupe.replay(store, rows, "batch_no", DELIVERIES, "event_id", "decided_at", order).view("event_id", "decided_at")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "staged_decisions").select("event_id", "decided_at", "batch_no")
    repeated = (F.col("__copies") > 1) & F.col("event_id").isNotNull()
    return _seen(spark, rows).where(repeated).select("event_id", F.unix_micros("decided_at").alias("kept_us"))


P6_ORDER = ["batch_no", "champion_version", "champion_score", "shadow_version", "shadow_score", "shadow_action"]


def p6_kept(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "staged_decisions").select("event_id", "card_id", "event_time", "amount_cents", "decided_at", "action", "rule", *P6_ORDER)
    return _seen(spark, rows, P6_ORDER).select("event_id", "card_id", "amount_cents", "action", "rule", "batch_no", "champion_version", F.round("champion_score", 9).alias("champion_score"), F.unix_micros("decided_at").alias("kept_us"))


_DECISIONS = """
WITH ev AS (SELECT event_id, min(event_time) AS t, min(decided_at) AS a, min(amount_cents) AS amount_cents FROM staged_decisions GROUP BY event_id),
dec AS (SELECT *, (epoch_us(t) // 3600000000 + 1) * 3600000000 AS e, epoch_us(a) AS au FROM ev)
"""
_LABELS = """
ev AS (SELECT event_id, min(event_time) AS t FROM staged_decisions GROUP BY event_id),
lab AS (SELECT event_id, min(epoch_us(label_time) * 4 + CASE WHEN is_fraud IS NULL THEN 2 WHEN is_fraud THEN 1 ELSE 0 END) AS p FROM label_spool GROUP BY event_id),
dl AS (SELECT event_id, (epoch_us(t) // 86400000000 + 1) * 86400000000 AS e, p // 4 AS au, p % 4 = 1 AS fraud FROM ev JOIN lab USING (event_id))
"""
_HOUR = "strftime(make_timestamp(e - 3600000000), '%Y-%m-%dT%H')"
_DAY = "strftime(make_timestamp(e - 86400000000), '%Y-%m-%d')"
_EVENTS = "SELECT event_id, min(card_id) AS card_id, min(event_time) AS event_time, min(amount_cents) AS amount_cents, min(rule) AS rule FROM staged_decisions GROUP BY event_id"
_ROLL = f"""
WITH ev AS ({_EVENTS}),
daily AS (SELECT card_id, epoch_us(event_time) // 86400000000 AS dn, count(*) AS n, sum(amount_cents) AS s FROM ev GROUP BY ALL),
cal AS (SELECT card_id, unnest(generate_series(min(dn), epoch_us(TIMESTAMP '{END_DAY}') // 86400000000)) AS dn FROM daily GROUP BY card_id),
dense AS (SELECT c.card_id, c.dn, coalesce(n, 0) AS n, coalesce(s, 0) AS s FROM cal c LEFT JOIN daily d ON c.card_id = d.card_id AND c.dn = d.dn),
roll AS (SELECT card_id, dn, row_number() OVER w AS k,
  CAST(sum(n) OVER (w ROWS 6 PRECEDING) AS BIGINT) AS n_7, CAST(sum(s) OVER (w ROWS 6 PRECEDING) AS BIGINT) AS total_7,
  CAST(sum(n) OVER (w ROWS 29 PRECEDING) AS BIGINT) AS n_30, CAST(sum(s) OVER (w ROWS 29 PRECEDING) AS BIGINT) AS total_30
  FROM dense WINDOW w AS (PARTITION BY card_id ORDER BY dn))
"""
_DAYTEXT = "strftime(make_timestamp(dn * 86400000000), '%Y-%m-%d')"
_VEC = f"""
WITH ev AS ({_EVENTS}),
types AS (SELECT t, row_number() OVER (ORDER BY encode(t)) - 1 AS idx FROM (SELECT DISTINCT coalesce(rule, '(none)') AS t FROM staged_decisions)),
ent AS (SELECT card_id, rule, idx, count(*) AS n, CAST(sum(amount_cents) AS BIGINT) AS total, epoch_us(max(event_time)) AS last_us
  FROM ev JOIN types ON t = coalesce(rule, '(none)') WHERE event_time < TIMESTAMPTZ '{AS_OF}+00' GROUP BY ALL)
"""

_WIDE = ", ".join(
    f"CAST(coalesce(sum(n) FILTER (rule = '{r}'), 0) AS BIGINT) AS n_{r}, CAST(coalesce(sum(total) FILTER (rule = '{r}'), 0) AS BIGINT) AS total_{r}, epoch_us(TIMESTAMPTZ '{AS_OF}+00') - max(last_us) FILTER (rule = '{r}') AS idle_us_{r}"
    for r in RULES
)

QUERIES = {
    "p1_found": p1_found, "p1_hours": p1_hours, "p1_days": p1_days, "p1_versions": p1_versions,
    "p4_found": p4_found, "p4_rolling": p4_rolling,
    "p5_found": p5_found, "p5_features": p5_features, "p5_vectors": p5_vectors,
    "p6_found": p6_found, "p6_kept": p6_kept,
}

SQL = {
    "p1_found": f"""{_DECISIONS}, {_LABELS.replace("ev AS", "ev2 AS").replace("FROM ev JOIN", "FROM ev2 JOIN")}
SELECT 'decision' AS kind, event_id, {_HOUR} AS period, CASE WHEN au > e + 86400000000 THEN 'refused' ELSE 'corrected' END AS outcome FROM dec WHERE au > e + 600000000
UNION ALL
SELECT 'label', event_id, {_DAY}, CASE WHEN au > e + 626400000000 THEN 'refused' ELSE 'corrected' END FROM dl WHERE au > e + 604800000000""",
    "p1_hours": f"""{_DECISIONS} SELECT {_HOUR} AS period,
CAST(count(*) FILTER (au <= e + 86400000000) AS BIGINT) AS n_events, CAST(coalesce(sum(amount_cents) FILTER (au <= e + 86400000000), 0) AS BIGINT) AS amount_cents,
CAST(count(*) FILTER (au <= e + 600000000) AS BIGINT) AS first_n_events, CAST(coalesce(sum(amount_cents) FILTER (au <= e + 600000000), 0) AS BIGINT) AS first_amount_cents,
count(*) FILTER (au > e + 600000000 AND au <= e + 86400000000) AS n_corrections, count(*) FILTER (au > e + 86400000000) AS n_refused FROM dec GROUP BY e""",
    "p1_days": f"""WITH {_LABELS} SELECT {_DAY} AS period, CAST(count(*) FILTER (au <= e + 626400000000) AS BIGINT) AS n_labels, CAST(count(*) FILTER (fraud AND au <= e + 626400000000) AS BIGINT) AS n_frauds,
count(*) FILTER (au > e + 604800000000 AND au <= e + 626400000000) AS n_corrections, count(*) FILTER (au > e + 626400000000) AS n_refused FROM dl GROUP BY e""",
    "p1_versions": f"""{_DECISIONS}, inc AS (SELECT e, greatest((au + 3599999999) // 3600000000 * 3600000000, e) AS r, count(*) AS n, sum(amount_cents) AS s FROM dec WHERE au <= e + 86400000000 GROUP BY ALL),
runs AS (SELECT e, r, n, s FROM inc UNION ALL SELECT DISTINCT e, e + 90000000000, 0, 0 FROM inc),
folded AS (SELECT e, r, sum(n) AS n, sum(s) AS s FROM runs GROUP BY e, r)
SELECT {_HOUR} AS period, strftime(make_timestamp(r), '%Y-%m-%dT%H') AS run_at, CAST(sum(n) OVER w AS BIGINT) AS n_events, CAST(sum(s) OVER w AS BIGINT) AS amount_cents, r = e + 90000000000 AS frozen
FROM folded WINDOW w AS (PARTITION BY e ORDER BY r ROWS UNBOUNDED PRECEDING)""",
    "p4_found": f"{_ROLL} SELECT card_id, {_DAYTEXT} AS day FROM roll WHERE k >= 30 AND n_30 >= 10 AND total_7 * 60 >= total_30 * 49",
    "p4_rolling": f"{_ROLL} SELECT card_id, {_DAYTEXT} AS day, n_7, total_7, round(total_7 / 7, 6) AS mean_7, n_30, total_30, round(total_30 / 30, 6) AS mean_30 FROM roll",
    "p5_found": f"{_VEC} SELECT card_id, rule FROM ent WHERE n >= 3 AND total >= 20000 AND epoch_us(TIMESTAMPTZ '{AS_OF}+00') - last_us > 1814400000000",
    "p5_features": f"{_VEC} SELECT card_id, {_WIDE} FROM ent GROUP BY card_id",
    "p5_vectors": f"{_VEC} SELECT card_id, string_agg(concat(idx, ':', n, ':', total, ':', last_us), ',' ORDER BY idx) AS vector FROM ent GROUP BY card_id",
    "p6_found": "SELECT event_id, epoch_us(min(decided_at)) AS kept_us FROM staged_decisions GROUP BY event_id HAVING count(*) > 1",
    "p6_kept": f"""SELECT event_id, card_id, amount_cents, action, rule, batch_no, champion_version, round(champion_score, 9) AS champion_score, epoch_us(decided_at) AS kept_us FROM
(SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY decided_at, {", ".join(f"{c} ASC NULLS FIRST" for c in P6_ORDER)}) AS rn FROM staged_decisions) WHERE rn = 1""",
}
