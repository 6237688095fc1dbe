"""Source, mapping, generator and streaming queries, and the SQL they are compared with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.times import HOUR
from tidemark.operators import features as fx
from tidemark.plans.feature_queries import TXN, feature_sql
from tidemark.session import scratch_path, table, written
from tidemark.sources import card_csv, generator, records, tables
from tidemark.streaming import scorer


def _txn(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "txn_stream").select(*[f.name for f in records.TRANSACTION.fields])


def src_json_log(spark: SparkSession, d: str) -> DataFrame:
    """The stream written as a compressed raw log and read back through the version gate and the rules."""
    path = scratch_path(spark, "log")
    records.write_log(_txn(spark, d), path)
    return records.read_transactions(spark, path).select("event_id", F.unix_micros("event_time").alias("us"), "card_id", "device_id", "merchant_id", "session_id", "amount_cents", "merchant_category", "entry_mode")


def src_labels_log(spark: SparkSession, d: str) -> DataFrame:
    path = scratch_path(spark, "log")
    records.write_log(table(spark, d, "label_spool").select("event_id", "label_time", "is_fraud", "recovered_cents"), path, gzip=False)
    return records.read_labels(spark, path).select("event_id", F.unix_micros("label_time").alias("us"), "is_fraud", "recovered_cents")


def src_dead_letters(spark: SparkSession, d: str) -> DataFrame:
    return records.dead_letters(records.decoded(records.to_wire(_txn(spark, d)))).groupBy("reason", "detail").agg(F.count(F.lit(1)).alias("n"))


def src_bad_runs(spark: SparkSession, d: str) -> DataFrame:
    """The longest run of bad records, the log being in order of event time and id."""
    return _bad_runs(_txn(spark, d))


def _bad_runs(rows: DataFrame) -> DataFrame:
    """Every record counts; of equal time and id the good come first."""
    lines = rows.withColumn("value", F.to_json(F.struct(*rows.columns), {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'", "ignoreNullFields": "false"})).select(F.unix_micros("event_time").alias("us"), "event_id", "value")
    log = records.decoded(lines).select("us", "event_id", "reason")
    return records.longest_bad_run(tables.numbered(log, F.floor(F.col("us") / 60_000_000), ["us", "event_id", "reason"]), "seq")


def src_replay_late(spark: SparkSession, d: str) -> DataFrame:
    """Deliveries in order of batch and decision, and whether each is earlier in event time than one before it."""
    rows = table(spark, d, "staged_decisions").select("batch_no", "decided_at", "event_id", F.unix_micros("event_time").alias("us"))
    log = tables.numbered(rows, F.col("batch_no"), ["decided_at", "event_id", "us"])
    return tables.late_in_log(log, "us", "seq").select("batch_no", "event_id", "us", "late")


def src_replay_span(spark: SparkSession, d: str) -> DataFrame:
    cut = tables.before(_txn(spark, d), "event_time", F.lit("2027-10-01 00:00:00").cast("timestamp"))
    return tables.span(cut, "event_time").select(F.unix_micros("first").alias("first_us"), F.unix_micros("last").alias("last_us"))


def src_hour_spool(spark: SparkSession, d: str) -> DataFrame:
    """All staged rows spooled by hour, every hour before the data's last one sealed, and all read back by hour."""
    return _spooled(spark, d).read().groupBy(F.date_format("event_time", "yyyy-MM-dd'T'HH").alias("hour")).agg(F.count(F.lit(1)).alias("n"), F.sum("amount_cents").alias("amount_cents"))


def _spooled(spark: SparkSession, d: str) -> tables.HourSpool:
    spool = tables.HourSpool(spark, scratch_path(spark, "spool"))
    spool.append(table(spark, d, "staged_decisions").select("event_id", "event_time", "amount_cents"))
    if hours := spool.hours():
        spool.seal_closed(hours[-1])
    return spool


def src_profile(spark: SparkSession, d: str) -> DataFrame:
    got = tables.profile(_txn(spark, d).drop("event_time"))
    return got.select("column", "n", F.round("missing_share", 9).alias("missing_share"), "n_distinct")


def src_time_resolution(spark: SparkSession, d: str) -> DataFrame:
    got = tables.time_resolution(_txn(spark, d), "event_time")
    return got.withColumn("share_sharing", F.round("share_sharing", 9))


def src_checksums(spark: SparkSession, d: str) -> DataFrame:
    """The checksums of all the folder's files, verified against a record in which one file was other, one wasn't
    and one was that is gone."""
    name = F.col("name")
    now = written(tables.checksums(spark, d).select("name", "sha256"), "sums")
    then = now.where(~F.startswith(name, F.lit("nation."))).withColumn("sha256", F.when(F.startswith(name, F.lit("region.")), F.reverse("sha256")).otherwise(F.col("sha256")))
    return tables.verify(spark, d, then.unionByName(spark.createDataFrame([("gone.parquet", "0")], "name string, sha256 string")))


def src_feature_store(spark: SparkSession, d: str) -> DataFrame:
    """Session features written in two batches, and the online rows after the second."""
    from tidemark.plans.feature_queries import transactions

    specs = [s for s in fx.FEATURE_SET if s.entity == "session"]
    rows = fx.narrow(transactions(spark, d), specs)
    store = tables.FeatureStore(spark, scratch_path(spark, "features"))
    cut = 1_823_000_000_000_000
    store.write(rows.where(F.col("us") < cut), 0)
    store.write(rows.where(F.col("us") >= cut), 1)
    return store.online().select("entity_id", "us", "event_id", *[F.col("features")[s.name].alias(s.name) for s in specs])


def _cells(spark: SparkSession, d: str) -> DataFrame:
    """Order lines as competition-shaped text cells, some of them missing or bad."""
    n = F.col("l_orderkey") * 8 + F.col("l_linenumber")
    part = lambda c, k: F.when(F.pmod(n, F.lit(k)) == 0, F.lit("")).otherwise(c)
    return table(spark, d, "lineitem").select(
        n.cast("string").alias("TransactionID"),
        (F.unix_timestamp("l_shipdate") - 788_918_400 + 86_400_000).cast("string").alias("TransactionDT"),
        F.when(F.pmod(n, F.lit(97)) == 0, "twelve").when(F.pmod(n, F.lit(101)) == 0, "-3.00").otherwise((F.col("l_extendedprice") * 1000).cast("bigint").cast("decimal(20,0)").cast("string")).alias("raw"),
        F.when(F.col("l_returnflag") == "R", "1").otherwise("0").alias("isFraud"),
        part(F.pmod(n, F.lit(400)).cast("string"), 13).alias("D1"),
        F.concat(F.col("l_suppkey").cast("string"), F.lit(".0")).alias("card1"), F.lit("nan").alias("card2"), F.lit("150.0").alias("card3"), F.lit("visa").alias("card4"), F.lit(None).cast("string").alias("card5"),
        F.col("l_linestatus").alias("card6"), part(F.lit("315.0"), 11).alias("addr1"),
    ).withColumn("TransactionAmt", F.when(F.col("raw").rlike("^[0-9]+$"), F.regexp_replace("raw", r"(\d{3})$", ".$1")).otherwise(F.col("raw"))).drop("raw")


def map_cards(spark: SparkSession, d: str) -> DataFrame:
    """Written to CSV, read back as text, mapped."""
    path = scratch_path(spark, "csv")
    _cells(spark, d).write.option("header", True).option("emptyValue", "").csv(path)
    got = card_csv.mapped(card_csv.read_csv(spark, path))
    good = got.where(F.col("reason").isNull())
    return good.select("event_id", F.unix_micros("event_time").alias("us"), "card_id", "amount_cents", F.unix_micros("label_time").alias("label_us"), "is_fraud", "linked", "rounded")


def map_report(spark: SparkSession, d: str) -> DataFrame:
    got = card_csv.mapping_report(card_csv.mapped(_cells(spark, d)))
    return got.select("n_rows", "refused", "linked_cards", *[F.round(c, 9).alias(c) for c in ("fraud_share", "linked_share", "rounded_share")], F.unix_micros("first").alias("first_us"), F.unix_micros("last").alias("last_us"))


def src_mapped_logs(spark: SparkSession, d: str) -> DataFrame:
    """The mapped lines written as three logs and each read back: rows, and what each log alone knows."""
    path = scratch_path(spark, "logs")
    good = card_csv.mapped(_cells(spark, d)).where(F.col("reason").isNull())
    blank = {f.name: F.lit(None).cast(f.dataType) for f in [*records.TRANSACTION.fields, *records.LABEL.fields, *records.TRUTH.fields] if f.name not in good.columns}
    filled = {"schema_version": F.lit(2), "currency": F.lit("USD"), "entry_mode": F.lit("ecommerce"), "card_country": F.lit("US"), "merchant_country": F.lit("US"), "is_recurring": F.lit(False), "recovered_cents": F.lit(0).cast("long")}
    records.write_event_logs(good.withColumns(blank | {k: v for k, v in filled.items() if k in blank}), path)
    sums = {"transactions": (records.read_transactions, F.sum("amount_cents")), "labels": (records.read_labels, F.sum(F.unix_seconds("label_time"))), "ground_truth": (records.read_ground_truth, F.count_if("is_fraud"))}
    out = None
    for name, (read, what) in sums.items():
        part = read(spark, f"{path}/{name}").agg(F.count(F.lit(1)).alias("n"), what.cast("long").alias("total")).select(F.lit(name).alias("log"), "n", "total")
        out = part if out is None else out.unionByName(part)
    return out


def src_findings(spark: SparkSession, d: str) -> DataFrame:
    """The stream's merchants, devices, staged events as identities, and labels."""
    got = tables.findings(_txn(spark, d), "event_id", ["merchant_id", "device_id"], table(spark, d, "staged_decisions"), table(spark, d, "label_spool"))
    return got.select("n_rows", *[F.round(c, 9).alias(c) for c in got.columns[1:]])


REGIMES = (generator.Regime("base", 0), generator.Regime("online", 3, 0.6), generator.Regime("dear", 5, 0.6, 1.5))


def gen_traffic(spark: SparkSession, d: str) -> DataFrame:
    """A week of generated traffic, by day, regime and scenario."""
    rows = generator.traffic(spark, generator.World(), 7, REGIMES)
    return rows.groupBy(F.date_format("event_time", "yyyy-MM-dd").alias("day"), "regime", "scenario").agg(F.count(F.lit(1)).alias("n"), F.sum("amount_cents").alias("amount_cents"), F.count_distinct("card_id").alias("cards"))


def gen_features(spark: SparkSession, d: str) -> DataFrame:
    """Training rows from generated traffic: features, label, weight; frauds kept and a tenth of the rest."""
    from tidemark.operators.decide import draw

    rows = generator.traffic(spark, generator.World(per_day=2000), 7, REGIMES).withColumn("us", F.unix_micros("event_time"))
    x = fx.compute(rows, fx.FEATURE_SET)
    y = rows.select("event_id", "amount_cents", "is_fraud").where(F.col("is_fraud") | (draw(F.col("event_id"), "tidemark/replay/1:") < 0.1))
    return x.join(y, "event_id").withColumn("weight", F.when(F.col("is_fraud"), 1.0).otherwise(10.0))


STREAM_PARTS = 3


def _streamed(spark: SparkSession, d: str, disorder_us: int = 1) -> scorer.StreamScorer:
    """The transaction stream as a log of several files in order of event time, of equal times (times that lie in
    the same disorder_us micros) in order of id, scored as a stream."""
    path = scratch_path(spark, "stream")
    rows = _txn(spark, d).withColumn("__us", F.unix_micros("event_time"))
    low, high = rows.agg(F.min("__us"), F.max("__us")).first()
    edges = [low + (high - low) * k // STREAM_PARTS for k in range(STREAM_PARTS)] + [high + 1]
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        part = rows.where((F.col("__us") >= a) & (F.col("__us") < b)).orderBy(F.floor(F.col("__us") / disorder_us), "event_id").drop("__us")
        records.to_wire(part).coalesce(1).write.mode("append").text(path)
    out = scorer.StreamScorer(spark, scratch_path(spark, "scored"))
    out.run(scorer.text_stream(spark, path), scratch_path(spark, "checkpoint"))
    return out


def stream_decide(spark: SparkSession, d: str) -> DataFrame:
    """What the stream decided; equal to the batch plan."""
    rows = _streamed(spark, d).read("staged")
    return rows.select("event_id", "card_txn_count_1h", "card_txn_count_24h", F.round("card_amount_mean_24h", 6).alias("card_amount_mean_24h"), "device_distinct_cards_1h", F.round("champion_score", 9).alias("champion_score"), "action", "rule")


def stream_dead_letters(spark: SparkSession, d: str) -> DataFrame:
    return _streamed(spark, d).read("dead").groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


DISORDER = 600_000_000


def stream_refused(spark: SparkSession, d: str) -> DataFrame:
    """What the stream refuses, and why, if the log is out of order inside every ten minutes."""
    return _streamed(spark, d, DISORDER).read("dead").groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {
    "src_json_log": src_json_log, "src_labels_log": src_labels_log, "src_dead_letters": src_dead_letters, "src_bad_runs": src_bad_runs, "src_replay_late": src_replay_late, "src_replay_span": src_replay_span,
    "src_hour_spool": src_hour_spool, "src_profile": src_profile, "src_time_resolution": src_time_resolution, "src_checksums": src_checksums, "src_feature_store": src_feature_store,
    "src_mapped_logs": src_mapped_logs, "src_findings": src_findings, "map_cards": map_cards, "map_report": map_report, "gen_traffic": gen_traffic, "gen_features": gen_features, "stream_decide": stream_decide, "stream_dead_letters": stream_dead_letters, "stream_refused": stream_refused,
}

_COLUMNS = [f.name for f in records.TRANSACTION.fields if f.name not in ("event_time", "schema_version")] + ["schema_version"]
_N = "(l_orderkey * 8 + l_linenumber)"
_MAP = f"""c AS (SELECT {_N} AS n, CAST(epoch(l_shipdate) AS BIGINT) - 788918400 + 86400000 AS dt, CAST(trunc(l_extendedprice * 1000) AS BIGINT) AS mills, l_returnflag = 'R' AS is_fraud, {_N} % 13 <> 0 AND {_N} % 11 <> 0 AS linked, l_suppkey, l_linestatus FROM lineitem),
g AS (SELECT *, mills // 10 AS q, mills % 10 AS r, n % 97 = 0 OR n % 101 = 0 AS bad FROM c),
m AS (SELECT *, CASE WHEN r > 5 OR (r = 5 AND q % 2 = 1) THEN q + 1 ELSE q END AS cents FROM g),
t AS (SELECT 'ieee-' || n AS event_id, (1512086400 + dt) * 1000000 AS us, (1512086400 + 604800 + dt) * 1000000 AS label_us, is_fraud, linked, r <> 0 AS rounded, cents AS amount_cents, bad,
  CASE WHEN linked THEN 'ieee-card-' || substr(sha256(concat(l_suppkey, '|~|150|visa|~|', l_linestatus, '|315|', dt // 86400 - n % 400)), 1, 20) ELSE 'ieee-unlinked-' || n END AS card_id FROM m)"""

_TABLES = ("region nation customer supplier part orders lineitem events documents embeddings txn_stream staged_decisions label_spool kept_history latency_minutes eval_items gone").split()

SQL = {
    "src_json_log": "SELECT event_id, epoch_us(event_time) AS us, card_id, device_id, merchant_id, session_id, amount_cents, merchant_category, entry_mode FROM txn_stream WHERE schema_version = 2",
    "src_labels_log": "SELECT event_id, epoch_us(label_time) AS us, is_fraud, recovered_cents FROM label_spool",
    "src_dead_letters": "SELECT 'unknown_schema_version' AS reason, CAST(schema_version AS VARCHAR) AS detail, count(*) AS n FROM txn_stream WHERE schema_version <> 2 GROUP BY 2",
    "src_bad_runs": """WITH o AS (SELECT event_time AS t, event_id, CASE WHEN schema_version <> 2 THEN 1 ELSE 0 END AS bad FROM txn_stream),
i AS (SELECT bad, row_number() OVER (ORDER BY t, event_id, bad) - row_number() OVER (PARTITION BY bad ORDER BY t, event_id) AS g FROM o) SELECT coalesce(max(n), 0) AS longest FROM (SELECT count(*) AS n FROM i WHERE bad = 1 GROUP BY g)""",
    "src_replay_late": """SELECT batch_no, event_id, epoch_us(event_time) AS us, coalesce(epoch_us(event_time) < max(epoch_us(event_time)) OVER (ORDER BY batch_no NULLS FIRST, decided_at NULLS FIRST, event_id NULLS FIRST, event_time NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS late FROM staged_decisions""",
    "src_replay_span": "SELECT epoch_us(min(event_time)) AS first_us, epoch_us(max(event_time)) AS last_us FROM txn_stream WHERE event_time < TIMESTAMPTZ '2027-10-01 00:00:00+00'",
    "src_hour_spool": "SELECT strftime(event_time, '%Y-%m-%dT%H') AS hour, count(*) AS n, CAST(sum(amount_cents) AS BIGINT) AS amount_cents FROM staged_decisions WHERE event_time IS NOT NULL GROUP BY 1",
    "src_profile": " UNION ALL ".join(f"SELECT '{c}' AS column, count(*) AS n, round(avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END), 9) AS missing_share, count(DISTINCT {c}) AS n_distinct FROM txn_stream" for c in _COLUMNS),
    "src_time_resolution": """WITH u AS (SELECT epoch_us(event_time) AS us, count(*) AS n FROM txn_stream GROUP BY 1), g AS (SELECT *, us - lag(us) OVER (ORDER BY us) AS gap FROM u)
SELECT min(us) AS first_us, max(us) AS last_us, count(*) AS n_distinct, round(sum(CASE WHEN n > 1 THEN n ELSE 0 END) / sum(n), 9) AS share_sharing, min(gap) AS smallest_gap_us FROM g""",
    "src_checksums": f"SELECT name, CASE name WHEN 'region.parquet' THEN 'changed' WHEN 'nation.parquet' THEN 'new' WHEN 'gone.parquet' THEN 'missing' ELSE 'same' END AS state FROM (SELECT unnest([{', '.join(repr(f'{t}.parquet') for t in _TABLES)}]) AS name)",
    "src_feature_store": f"""WITH {TXN}, f AS ({feature_sql([s for s in fx.FEATURE_SET if s.entity == "session"])})
SELECT entity_id, us, event_id, session_txn_count, session_amount_sum FROM (SELECT session_id AS entity_id, us, f.*, row_number() OVER (PARTITION BY session_id ORDER BY us DESC, f.event_id DESC) AS rn FROM f JOIN txn ON f.event_id = txn.event_id WHERE session_id IS NOT NULL) WHERE rn = 1""",
    "src_mapped_logs": f"""WITH {_MAP} SELECT 'transactions' AS log, count(*) AS n, CAST(sum(amount_cents) AS BIGINT) AS total FROM t WHERE NOT bad
UNION ALL SELECT 'labels', count(*), CAST(sum(label_us // 1000000) AS BIGINT) FROM t WHERE NOT bad UNION ALL SELECT 'ground_truth', count(*), count(*) FILTER (is_fraud) FROM t WHERE NOT bad""",
    "src_findings": """WITH i AS (SELECT DISTINCT event_id AS k FROM staged_decisions), l AS (SELECT event_id AS k, max(CAST(is_fraud AS INTEGER)) AS f FROM label_spool WHERE is_fraud IS NOT NULL GROUP BY 1)
SELECT count(*) AS n_rows, round(avg(CASE WHEN merchant_id IS NULL THEN 0.0 ELSE 1.0 END), 9) AS merchant_id_share, round(avg(CASE WHEN device_id IS NULL THEN 0.0 ELSE 1.0 END), 9) AS device_id_share,
round(avg(CASE WHEN i.k IS NULL THEN 0.0 ELSE 1.0 END), 9) AS identity_share, round(avg(CASE WHEN f IS NULL THEN 0.0 ELSE 1.0 END), 9) AS labelled_share, round(avg(CAST(f AS DOUBLE)), 9) AS fraud_share
FROM txn_stream t LEFT JOIN i ON t.event_id = i.k LEFT JOIN l ON t.event_id = l.k""",
    "map_cards": f"WITH {_MAP} SELECT event_id, us, card_id, amount_cents, label_us, is_fraud, linked, rounded FROM t WHERE NOT bad",
    "map_report": f"""WITH {_MAP} SELECT count(*) FILTER (NOT bad) AS n_rows, count(*) FILTER (bad) AS refused, count(DISTINCT card_id) FILTER (NOT bad AND linked) AS linked_cards,
round(avg(CASE WHEN is_fraud THEN 1.0 ELSE 0.0 END) FILTER (NOT bad), 9) AS fraud_share, round(avg(CASE WHEN linked THEN 1.0 ELSE 0.0 END) FILTER (NOT bad), 9) AS linked_share, round(avg(CASE WHEN rounded THEN 1.0 ELSE 0.0 END) FILTER (NOT bad), 9) AS rounded_share,
min(us) FILTER (NOT bad) AS first_us, max(us) FILTER (NOT bad) AS last_us FROM t""",
}
_SERVED = feature_sql([s for s in fx.FEATURE_SET if s.name in ("card_txn_count_1h", "card_txn_count_24h", "card_amount_mean_24h", "device_distinct_cards_1h")])
_Z = "(-4.0 + 0.6 * ln(1 + greatest(card_txn_count_1h, 0)) + 0.8 * ln(1 + greatest(device_distinct_cards_1h, 0)) + CASE WHEN card_amount_mean_24h > 0 AND amount_cents > 3 * card_amount_mean_24h THEN 1.5 ELSE 0 END)"
SQL["stream_decide"] = f"""WITH {TXN}, f AS ({_SERVED}), s AS (SELECT f.*, amount_cents, 1.0 / (1.0 + exp(-{_Z})) AS cs FROM f JOIN txn ON f.event_id = txn.event_id)
SELECT event_id, card_txn_count_1h, card_txn_count_24h, card_amount_mean_24h, device_distinct_cards_1h, round(cs, 9) AS champion_score,
CASE WHEN cs >= 0.9 THEN 'decline' WHEN cs >= 0.5 OR amount_cents >= 500000 THEN 'review' ELSE 'approve' END AS action,
CASE WHEN cs >= 0.9 THEN 'score-decline' WHEN cs >= 0.5 THEN 'score-review' WHEN amount_cents >= 500000 THEN 'large-amount-review' ELSE 'default-approve' END AS rule FROM s"""
SQL["stream_dead_letters"] = "SELECT 'unknown_schema_version' AS reason, count(*) AS n FROM txn_stream WHERE schema_version <> 2 HAVING count(*) > 0"
SQL["stream_refused"] = f"""WITH e AS (SELECT min(epoch_us(event_time)) AS lo, max(epoch_us(event_time)) AS hi FROM txn_stream),
r AS (SELECT event_id, epoch_us(event_time) AS us, CASE WHEN epoch_us(event_time) >= lo + (hi - lo) * 2 // {STREAM_PARTS} THEN 2 WHEN epoch_us(event_time) >= lo + (hi - lo) // {STREAM_PARTS} THEN 1 ELSE 0 END AS part FROM txn_stream, e WHERE schema_version = 2),
f AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY part, us // {DISORDER}, us) AS rn FROM r),
l AS (SELECT us < max(us) OVER (ORDER BY part, us // {DISORDER}, event_id, us ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS late FROM f WHERE rn = 1)
SELECT 'late' AS reason, count(*) AS n FROM l WHERE late HAVING count(*) > 0 UNION ALL SELECT 'unknown_schema_version', count(*) FROM txn_stream WHERE schema_version <> 2 HAVING count(*) > 0"""
