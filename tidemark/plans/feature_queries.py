"""Feature queries over txn_stream, their audits, and the SQL they are compared with."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemark.functions.times import DAY, HOUR, floor_to
from tidemark.operators import audit, registry
from tidemark.operators import features as fx
from tidemark.session import scratch_path, shuffles_dropped, table, written
from tidemark.sources import tables

SCHEMA_VERSION = 2


def transactions(spark: SparkSession, d: str) -> DataFrame:
    """The valid transactions once each, the earliest copy: event_id, us, ids and the amount."""
    rows = (
        table(spark, d, "txn_stream")
        .where((F.col("schema_version") == SCHEMA_VERSION) & F.col("event_time").isNotNull() & F.col("card_id").isNotNull())
        .select("event_id", F.unix_micros("event_time").alias("us"), "card_id", "device_id", "merchant_id", "session_id", "amount_cents")
    )
    return fx.first_wins(rows, "event_id", ["us"])


def _rounded(df: DataFrame, specs, *keep: str) -> DataFrame:
    return df.select("event_id", *keep, *[F.round(s.name, 6).alias(s.name) for s in specs])


def feat_wide(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(fx.compute(transactions(spark, d), fx.FEATURE_SET), fx.FEATURE_SET)


def _of(entity: str):
    return [s for s in fx.FEATURE_SET if s.entity == entity]


KINDS = ("card", "device", "merchant", "session")


def _per_entity(entity: str):
    def query(spark: SparkSession, d: str) -> DataFrame:
        return _rounded(fx.compute(transactions(spark, d), _of(entity)), _of(entity))

    return query


EXTRA = (
    fx.FeatureSpec("card_amount_min_24h", "card", "min", "amount_cents", DAY, HOUR),
    fx.FeatureSpec("card_amount_min_1h", "card", "min", "amount_cents", HOUR),
    fx.FeatureSpec("card_amount_max_1h", "card", "max", "amount_cents", HOUR),
    fx.FeatureSpec("merchant_amount_max_1h", "merchant", "max", "amount_cents", HOUR),
    fx.FeatureSpec("card_amount_mean_1h", "card", "mean", "amount_cents", HOUR),
    fx.FeatureSpec("card_seconds_since_last_1h", "card", "seconds_since_last", None, HOUR),
)
UNBOUNDED = (
    fx.FeatureSpec("card_count_ever", "card", "count", None, None),
    fx.FeatureSpec("card_sum_ever", "card", "sum", "amount_cents", None),
    fx.FeatureSpec("card_max_ever", "card", "max", "amount_cents", None),
    fx.FeatureSpec("card_merchants_ever", "card", "distinct_count", "merchant_id", None),
    fx.FeatureSpec("device_seconds_since_last_ever", "device", "seconds_since_last", None, None),
)


def feat_extra(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(fx.compute(transactions(spark, d), EXTRA), EXTRA)


def feat_unbounded(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(fx.compute(transactions(spark, d), UNBOUNDED), UNBOUNDED)


def feat_same_instant(spark: SparkSession, d: str) -> DataFrame:
    """All times floored to the hour, so that many events share an instant."""
    return _rounded(fx.compute(transactions(spark, d).withColumn("us", floor_to(F.col("us"), HOUR)), fx.FEATURE_SET), fx.FEATURE_SET)


def feat_narrow(spark: SparkSession, d: str) -> DataFrame:
    """A row per event and entity that it has; another entity's features are null there."""
    return fx.narrow(transactions(spark, d), fx.FEATURE_SET).select("event_id", "entity", "entity_id", *[F.round(F.try_element_at("features", F.lit(n)), 6).alias(n) for n in fx.FEATURE_NAMES])


#: All sixteen features are audited.
AUDITED = list(fx.FEATURE_SET)


def pit_violations(spark: SparkSession, d: str) -> DataFrame:
    """Served values against the definition, by feature: rows compared, rows that differ. An entity's features at
    a time, each written before the next begins: no event's values of all entities have to meet, and the disk
    holds one entity's shuffles."""
    found = []
    with shuffles_dropped(spark):
        txn = written(transactions(spark, d), "transactions")
        for k in dict.fromkeys(s.entity for s in AUDITED):
            found.append(written(audit.violations(txn, fx.compute_again(txn, _of(k), [f"{k}_id"]), _of(k)), "violations"))
    return reduce(DataFrame.unionByName, found)


def _differences(served: DataFrame, defined: DataFrame, specs) -> DataFrame:
    right = defined.select("event_id", *[F.col(s.name).alias(f"d_{s.name}") for s in specs])
    wrong = [F.struct(F.lit(s.name).alias("feature"), F.coalesce(F.abs(F.col(s.name) - F.col(f"d_{s.name}")) > 1e-9, F.lit(True)).cast("long").alias("bad")) for s in specs]
    rows = served.join(right, "event_id", "full").select(F.inline(F.array(*wrong)))
    return rows.groupBy("feature").agg(F.count(F.lit(1)).alias("compared"), F.sum("bad").alias("violations"))


LEAKY = [fx.FEATURE_SET[0], fx.FEATURE_SET[2]]


def leak_planted(spark: SparkSession, d: str) -> DataFrame:
    """The audit over a planted leak: windows that end at the event's instant, not before it, on hourly times."""
    txn = transactions(spark, d).withColumn("us", floor_to(F.col("us"), HOUR))
    w = W.partitionBy("card_id").orderBy("us").rangeBetween(-HOUR, 0)
    leaky = txn.select("event_id", F.count(F.lit(1)).over(w).cast("double").alias("card_txn_count_1h"), F.sum("amount_cents").over(w).cast("double").alias("card_amount_sum_1h"))
    return _differences(leaky, fx.compute(txn, LEAKY), LEAKY)


def parity_latest(spark: SparkSession, d: str) -> DataFrame:
    """Online against offline: every entity's newest row as a feature store keeps it, written in two batches,
    and as ordering the whole history finds it; by entity kind the rows compared and those that differ."""
    rows = written(fx.narrow(transactions(spark, d), fx.FEATURE_SET), "narrow")
    store, half = tables.FeatureStore(spark, scratch_path(spark, "features")), 1_821_000_000_000_000
    store.write(rows.where(F.col("us") < half), 0)
    store.write(rows.where(F.col("us") >= half), 1)
    newest = W.partitionBy("entity", "entity_id").orderBy(F.desc("us"), F.desc("event_id"))
    offline = rows.withColumn("__k", F.row_number().over(newest)).where("__k = 1")
    told = lambda df, name: df.select("entity", "entity_id", F.struct("us", "event_id", F.array_sort(F.map_entries("features")).alias("f")).alias(name))
    both = told(store.online(), "l").join(told(offline, "r"), ["entity", "entity_id"], "full")
    return both.groupBy("entity").agg(F.count(F.lit(1)).alias("compared"), F.count_if(~F.col("l").eqNullSafe(F.col("r"))).alias("violations"))


CARD_NAMES = [s.name for s in fx.FEATURE_SET if s.entity == "card"]


def _card_states(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The transactions, and each card's features at each of its moments."""
    txn = transactions(spark, d)
    states = fx.compute(txn, _of("card"), keep=["card_id"]).groupBy("card_id", "us").agg(*[F.round(F.max(n), 6).alias(n) for n in CARD_NAMES])
    return txn, states


def _first_label_times(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "label_spool").groupBy("event_id").agg(F.min(F.unix_micros("label_time")).alias("label_us"))


def asof_retrieval(spark: SparkSession, d: str) -> DataFrame:
    """For every labelled event, its card's features as of the label's arrival, if younger than 25 hours."""
    txn, states = _card_states(spark, d)
    asked = txn.select("event_id", "card_id").join(_first_label_times(spark, d), "event_id")
    return fx.as_of_values(asked, states, "card_id", "label_us", "us", CARD_NAMES, 25 * HOUR).select("event_id", *CARD_NAMES)


def entity_sample(spark: SparkSession, d: str) -> DataFrame:
    """Cards in a sample of 50 in a thousand, by hash."""
    h = F.conv(F.substring(F.sha2("card_id", 256), 1, 8), 16, 10).cast("long")
    return table(spark, d, "txn_stream").where(F.pmod(h, F.lit(1000)) < 50).groupBy("card_id").agg(F.count(F.lit(1)).alias("n"))


def label_shift(spark: SparkSession, d: str) -> DataFrame:
    """Training rows are retrieved as of the event's time, so they must not move when labels arrive 30 days
    later; retrieval as of the label's time is the leak that this must find. By path, the rows compared and moved."""
    txn, states = _card_states(spark, d)
    states = written(states, "states")
    labelled = written(txn.select("event_id", "card_id", F.col("us").alias("event_us")).join(_first_label_times(spark, d), "event_id"), "labelled")
    out = None
    for path, at in (("event time", "event_us"), ("label time", "label_us")):
        rows = []
        for shift in (0, 30 * DAY):
            asked = labelled.withColumn("label_us", F.col("label_us") + shift).select("event_id", "card_id", F.col(at).alias("at"))
            rows.append(fx.as_of_values(asked, states, "card_id", "at", "us", CARD_NAMES, 25 * HOUR).select("event_id", F.struct(*CARD_NAMES).alias(f"v{shift}")))
        moved = ~F.col("v0").eqNullSafe(F.col(f"v{30 * DAY}"))
        part = rows[0].join(rows[1], "event_id", "full").agg(F.count(F.lit(1)).alias("compared"), F.count_if(moved).alias("moved")).select(F.lit(path).alias("path"), "compared", "moved")
        out = part if out is None else out.unionByName(part)
    return out


def path_parity(spark: SparkSession, d: str) -> DataFrame:
    """All features by the batch path over the whole against the path over its events in two halves, the second
    with a day's history before it."""
    specs, names = fx.FEATURE_SET, list(fx.FEATURE_NAMES)
    txn = transactions(spark, d)
    cut = 1_823_000_000_000_000
    halves = fx.compute(txn.where(F.col("us") < cut), specs).unionByName(fx.compute(txn.where(F.col("us") >= cut - 26 * HOUR), specs).where(F.col("us") >= cut))
    return registry.parity(fx.compute(txn, specs), halves, "event_id", names, 1e-9)


def feature_views(spark: SparkSession, d: str) -> DataFrame:
    """The catalog's four views, by SQL."""
    registry.create_views(written(fx.narrow(transactions(spark, d), fx.FEATURE_SET), "narrow"), fx.FEATURE_SET)
    parts = [f"SELECT '{k}' AS entity, entity_id, count(*) AS n, max({_of(k)[0].name}) AS most FROM {registry.view_name(k)} GROUP BY entity_id" for k in KINDS]
    return spark.sql(" UNION ALL ".join(parts))


TXN = f"""txn AS (SELECT event_id, us, card_id, device_id, merchant_id, session_id, amount_cents FROM (
  SELECT *, epoch_us(event_time) AS us, row_number() OVER (PARTITION BY event_id ORDER BY event_time, card_id NULLS FIRST, device_id NULLS FIRST, merchant_id NULLS FIRST, session_id NULLS FIRST, amount_cents NULLS FIRST) AS rn
  FROM txn_stream WHERE schema_version = {SCHEMA_VERSION} AND event_time IS NOT NULL AND card_id IS NOT NULL AND event_id IS NOT NULL) WHERE rn = 1)"""


def feature_sql(specs, us: str = "us", source: str = TXN) -> str:
    """Range frames, one per specification."""
    out = []
    for s in specs:
        if s.window is None:
            far = "UNBOUNDED PRECEDING"
        elif s.resolution is None:
            far = f"{s.window} PRECEDING"
        else:
            far = f"(us - ((us - {s.window}) // {s.resolution}) * {s.resolution}) PRECEDING"
        w = f"OVER (PARTITION BY {s.entity}_id ORDER BY us RANGE BETWEEN {far} AND 1 PRECEDING)"
        v = {
            "count": f"nullif(count(*) {w}, 0)", "sum": f"sum({s.field}) {w}", "mean": f"avg({s.field}) {w}", "max": f"max({s.field}) {w}", "min": f"min({s.field}) {w}",
            "distinct_count": f"nullif(len(list_distinct(list(coalesce({s.field}, '-')) {w})), 0)",
            "seconds_since_last": f"(us - max(us) {w}) / 1e6",
        }[s.aggregation]
        out.append(f"round(CASE WHEN {s.entity}_id IS NULL THEN -1 ELSE coalesce(CAST({v} AS DOUBLE), -1) END, 6) AS {s.name}")
    return f"WITH {source}, moved AS (SELECT * REPLACE ({us} AS us) FROM txn) SELECT event_id, {', '.join(out)} FROM moved"


_STATES = f"""WITH {TXN}, f AS ({feature_sql(_of('card'))}),
st AS (SELECT card_id, us, {', '.join(f'max({n}) AS {n}' for n in CARD_NAMES)} FROM f JOIN txn USING (event_id) GROUP BY card_id, us),
q AS (SELECT event_id, card_id, min(epoch_us(label_time)) AS at FROM txn JOIN label_spool USING (event_id) GROUP BY event_id, card_id)"""


def _as_of(asked: str) -> str:
    values = ", ".join(f"coalesce(CASE WHEN s.us >= a.at - {25 * HOUR} THEN s.{n} END, -1) AS {n}" for n in CARD_NAMES)
    return f"SELECT a.event_id, {values} FROM {asked} a ASOF LEFT JOIN st s ON a.card_id = s.card_id AND a.at >= s.us"


QUERIES = {
    "feat_wide": feat_wide, "feat_card": _per_entity("card"), "feat_device": _per_entity("device"), "feat_merchant": _per_entity("merchant"), "feat_session": _per_entity("session"),
    "feat_extra": feat_extra, "feat_unbounded": feat_unbounded, "feat_same_instant": feat_same_instant, "feat_narrow": feat_narrow,
    "pit_violations": pit_violations, "leak_planted": leak_planted, "parity_latest": parity_latest, "asof_retrieval": asof_retrieval, "entity_sample": entity_sample, "label_shift": label_shift, "path_parity": path_parity, "feature_views": feature_views,
}

SQL = {
    "feat_wide": feature_sql(fx.FEATURE_SET),
    **{f"feat_{k}": feature_sql(_of(k)) for k in ("card", "device", "merchant", "session")},
    "feat_extra": feature_sql(EXTRA),
    "feat_unbounded": feature_sql(UNBOUNDED),
    "feat_same_instant": feature_sql(fx.FEATURE_SET, f"us // {HOUR} * {HOUR}"),
    "feat_narrow": f"WITH f AS ({feature_sql(fx.FEATURE_SET)}), t AS (WITH {TXN} SELECT * FROM txn) " + " UNION ALL BY NAME ".join(
        f"SELECT f.event_id, '{k}' AS entity, {k}_id AS entity_id, {', '.join(x.name for x in _of(k))} FROM f JOIN t ON f.event_id = t.event_id WHERE {k}_id IS NOT NULL" for k in KINDS
    ),
    "pit_violations": f"WITH {TXN} SELECT unnest([{', '.join(repr(s.name) for s in AUDITED)}]) AS feature, count(*) AS compared, CAST(0 AS BIGINT) AS violations FROM txn",
    "leak_planted": f"""WITH {TXN}, h AS (SELECT card_id, us // {HOUR} AS b FROM txn), seen AS (SELECT count(*) AS n FROM h)
SELECT unnest(['card_txn_count_1h', 'card_amount_sum_1h']) AS feature, n AS compared, n AS violations FROM seen""",
    "parity_latest": f"WITH {TXN} " + " UNION ALL ".join(f"SELECT '{k}' AS entity, count(DISTINCT {k}_id) AS compared, CAST(0 AS BIGINT) AS violations FROM txn HAVING count({k}_id) > 0" for k in KINDS),
    "asof_retrieval": f"{_STATES} SELECT event_id, {', '.join(CARD_NAMES)} FROM ({_as_of('q')})",
    "entity_sample": "SELECT card_id, count(*) AS n FROM txn_stream WHERE CAST('0x' || substr(sha256(card_id), 1, 8) AS BIGINT) % 1000 < 50 GROUP BY card_id",
    "path_parity": f"WITH {TXN} SELECT count(*) AS compared, CAST(0 AS BIGINT) AS rows_differing, CAST(0 AS BIGINT) AS cells_differing, CAST(1.0 AS DOUBLE) AS parity FROM txn",
    "feature_views": f"WITH f AS ({feature_sql(fx.FEATURE_SET)}), t AS (WITH {TXN} SELECT * FROM txn) " + " UNION ALL ".join(
        f"SELECT '{k}' AS entity, {k}_id AS entity_id, count(*) AS n, max({_of(k)[0].name}) AS most FROM f JOIN t ON f.event_id = t.event_id WHERE {k}_id IS NOT NULL GROUP BY {k}_id" for k in KINDS
    ),
    "label_shift": f"""{_STATES}, r AS ({_as_of('q')}), later AS (SELECT event_id, card_id, q.at + {30 * DAY} AS at FROM q), l AS ({_as_of('later')})
SELECT 'event time' AS path, count(*) AS compared, CAST(0 AS BIGINT) AS moved FROM q
UNION ALL SELECT 'label time', count(*), count(*) FILTER ({' OR '.join(f'r.{n} IS DISTINCT FROM l.{n}' for n in CARD_NAMES)}) FROM r JOIN l USING (event_id)""",
}
