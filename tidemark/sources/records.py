"""Wire records: schemas, decoding with a version gate, field constraints, dead letters, raw logs.

Defined cases: a blank line is no record; a record of another schema version is refused before its
fields are looked at; an unknown or missing field, a wrong type or a broken constraint is a dead letter
with its reason; a null value is undecodable.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql import types as T

SCHEMA_VERSION = 2


def _schema(text: str) -> T.StructType:
    kinds = {"int": T.IntegerType(), "string": T.StringType(), "timestamp": T.TimestampType(), "bigint": T.LongType(), "boolean": T.BooleanType(), "double": T.DoubleType()}
    return T.StructType([T.StructField(name, kinds[kind]) for name, kind in (f.split() for f in text.split(", "))])


TRANSACTION = _schema(
    "schema_version int, event_id string, event_time timestamp, card_id string, device_id string, merchant_id string, session_id string, amount_cents bigint, currency string, "
    "merchant_category string, entry_mode string, card_country string, merchant_country string, is_recurring boolean"
)
LABEL = _schema("event_id string, label_time timestamp, is_fraud boolean, recovered_cents bigint")
TRUTH = _schema("event_id string, is_fraud boolean, scenario string, regime string")
DECISION = _schema("event_id string, card_id string, action string, score double, rule string, model_version string, decided_at timestamp")

#: The wire format's enumerations.
ENTRY_MODES = ("chip", "contactless", "magstripe", "ecommerce", "manual")
CATEGORIES = (
    "entertainment", "food_dining", "gas_transport", "grocery_net", "grocery_pos", "health_fitness", "home",
    "kids_pets", "misc_net", "misc_pos", "personal_care", "shopping_net", "shopping_pos", "travel",
)
MAX_CENTS = 100_000_000
TIMES = {"transaction": "event_time", "label": "label_time"}


def identifier_ok(c: str, optional: bool = False) -> Column:
    ok = F.length(c).between(1, 64)
    return F.col(c).isNull() | ok if optional else F.coalesce(ok, F.lit(False))


def transaction_rules() -> dict[str, Column]:
    """Each constraint by name: true where a decoded transaction keeps it."""
    held = lambda c: F.coalesce(c, F.lit(False))
    return {
        "event_id": identifier_ok("event_id"),
        "event_time": F.col("event_time").isNotNull(),
        "card_id": identifier_ok("card_id"),
        "device_id": identifier_ok("device_id", True),
        "merchant_id": identifier_ok("merchant_id", True),
        "session_id": identifier_ok("session_id", True),
        "amount_cents": held((F.col("amount_cents") > 0) & (F.col("amount_cents") <= MAX_CENTS)),
        "currency": held(F.col("currency") == "USD"),
        "merchant_category": F.col("merchant_category").isNull() | F.col("merchant_category").isin(*CATEGORIES),
        "entry_mode": held(F.col("entry_mode").isin(*ENTRY_MODES)),
        "card_country": held(F.col("card_country").rlike("^[A-Z]{2}$")),
        "merchant_country": held(F.col("merchant_country").rlike("^[A-Z]{2}$")),
        "is_recurring": F.col("is_recurring").isNotNull(),
    }


def label_rules() -> dict[str, Column]:
    return {
        "event_id": identifier_ok("event_id"),
        "label_time": F.col("label_time").isNotNull(),
        "is_fraud": F.col("is_fraud").isNotNull(),
        "recovered_cents": F.coalesce(F.col("recovered_cents") >= 0, F.lit(False)),
    }


def broken(rules: dict[str, Column]) -> Column:
    """The names of the broken rules, joined by commas; empty if none."""
    return F.concat_ws(",", *[F.when(~ok, F.lit(name)) for name, ok in rules.items()])


def decoded(raw: DataFrame, value: str = "value", schema: T.StructType = TRANSACTION, rules: dict[str, Column] | None = None, version: int | None = SCHEMA_VERSION) -> DataFrame:
    """raw's other columns, `reason` and `detail` (null for good records) and `record`.

    Works alike on batches and streams: one projection."""
    names = {c: f"__raw{i}" for i, c in enumerate(raw.columns)}
    text = F.col(names[value]).cast("string")
    at = [f.name for f in schema.fields if isinstance(f.dataType, T.TimestampType)]
    peeked = {"__version": F.get_json_object(text, "$.schema_version"), "__keys": F.json_object_keys(text)} | {f"__t_{t}": F.get_json_object(text, f"$.{t}") for t in at}
    wide = T.StructType([*schema.fields, T.StructField("__bad", T.StringType())])
    record = F.from_json(text, wide, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__bad"})
    # A generator keeps the parsed fields as columns: the optimiser doesn't copy the parsing into every use.
    rows = raw.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()]).withColumns(peeked)
    rows = rows.select("*", F.inline(F.array(record)))
    known = F.array(*[F.lit(f.name) for f in schema.fields])
    wrong = broken(rules if rules is not None else transaction_rules())
    reason = F.when(F.col("__keys").isNull(), "undecodable")
    if version is not None:
        reason = reason.when(F.coalesce(F.col("__version") != str(version), F.lit(True)), "unknown_schema_version")
    reason = reason.when(F.size(F.array_except("__keys", known)) > 0, "unknown_field").when(F.col("__bad").isNotNull(), "undecodable")
    for t in at:
        # Only UTC times are taken: one that names another zone, or none, is a broken record.
        reason = reason.when(~F.coalesce(F.col(f"__t_{t}").rlike(r"(Z|\+00:?00)$"), F.lit(False)), "not_utc")
    checked = rows.withColumn("__wrong", wrong).withColumn("__reason", reason.when(F.col("__wrong") != "", "invalid"))
    detail = F.when(F.col("__reason") == "invalid", F.col("__wrong")).when(F.col("__reason") == "unknown_schema_version", F.col("__version"))
    detail = detail.when(F.col("__reason").isNotNull(), F.substring(text, 1, 500))
    kept = F.struct(*[F.col(f.name) for f in schema.fields])
    return checked.select(*[F.col(n).alias(c) for c, n in names.items()], F.col("__reason").alias("reason"), detail.alias("detail"), kept.alias("record"))


def good(decoded_rows: DataFrame) -> DataFrame:
    return decoded_rows.where(F.col("reason").isNull()).select("record.*")


def dead_letters(decoded_rows: DataFrame, value: str = "value") -> DataFrame:
    """(reason, detail, payload): the payload in base64, the detail cut to 500 characters."""
    return decoded_rows.where(F.col("reason").isNotNull()).select("reason", F.substring("detail", 1, 500).alias("detail"), F.base64(F.col(value).cast("binary")).alias("payload"))


def longest_bad_run(decoded_rows: DataFrame, order: str, partition: str | None = None) -> DataFrame:
    """(longest): the longest run of adjacent bad records of a partition in its order. A partition's offsets
    are cut into blocks of 100,000; runs are kept by their ends, so no partition is sorted in one task."""
    p = [F.col(partition)] if partition else []
    rows = decoded_rows.select(*[c.alias("__p") for c in p] or [F.lit(0).alias("__p")], F.col(order).alias("__o"), F.col("reason").isNotNull().alias("__bad"))
    block = F.floor(F.col("__o") / 100_000)
    w = W.partitionBy("__p", "__b").orderBy("__o")
    marked = rows.withColumn("__b", block).withColumn("__g", F.sum(F.when(F.col("__bad"), 0).otherwise(1)).over(w))
    runs = marked.groupBy("__p", "__b", "__g").agg(F.count_if("__bad").alias("n"))
    ends = runs.groupBy("__p", "__b").agg(
        F.max(F.when(F.col("__g") > 0, F.col("n")).otherwise(F.col("n"))).alias("inner"), F.min_by("n", F.when(F.col("__g") == 0, 0)).alias("head"), F.max_by("n", "__g").alias("tail"), F.max("__g").alias("goods")
    )
    # Blocks joined by a fold over their three numbers, in order: bounded by the number of blocks.
    ordered = ends.groupBy("__p").agg(F.array_sort(F.collect_list(F.struct("__b", "inner", "head", "tail", "goods"))).alias("bs"))
    start = F.struct(F.lit(0).cast("long").alias("open"), F.lit(0).cast("long").alias("best"))

    def step(a, b):
        through = b["goods"] == 0
        head = F.coalesce(b["head"], F.lit(0).cast("long"))
        joined = a["open"] + head
        return F.struct(F.when(through, a["open"] + b["inner"]).otherwise(b["tail"]).alias("open"), F.greatest(a["best"], b["inner"], joined, F.when(through, a["open"] + b["inner"]).otherwise(F.lit(0).cast("long"))).alias("best"))

    return ordered.select(F.aggregate("bs", start, step, lambda a: a["best"]).alias("n")).agg(F.coalesce(F.max("n"), F.lit(0)).alias("longest"))


def to_wire(rows: DataFrame) -> DataFrame:
    """(value): one JSON document per row, times in UTC, nulls written out."""
    return rows.select(F.to_json(F.struct(*rows.columns), {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'", "ignoreNullFields": "false"}).alias("value"))


def write_log(rows: DataFrame, path: str, mode: str = "append", gzip: bool = True) -> None:
    """A raw log of JSON lines, compressed unless said otherwise."""
    to_wire(rows).write.mode(mode).option("compression", "gzip" if gzip else "none").text(path)


def write_event_logs(rows: DataFrame, root: str, mode: str = "append") -> None:
    """Mapped or generated events as three logs, `transactions`, `labels` and `ground_truth`, so that no reader of
    transactions can see an outcome. rows: the transaction's and the label's columns, is_fraud and scenario."""
    truth = [f.name for f in TRUTH.fields]
    for name, columns in (("transactions", [f.name for f in TRANSACTION.fields]), ("labels", [f.name for f in LABEL.fields]), ("ground_truth", truth)):
        write_log(rows.select(*columns), f"{root}/{name}", mode)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """(value): the log's lines, blank ones left out; compressed or not."""
    return spark.read.text(path).where(F.trim("value") != "")


def read_transactions(spark: SparkSession, path: str) -> DataFrame:
    return good(decoded(read_log(spark, path)))


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    return good(decoded(read_log(spark, path), schema=LABEL, rules=label_rules(), version=None))


def read_ground_truth(spark: SparkSession, path: str) -> DataFrame:
    return good(decoded(read_log(spark, path), schema=TRUTH, rules={"event_id": identifier_ok("event_id")}, version=None))
