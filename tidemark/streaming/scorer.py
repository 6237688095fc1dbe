"""The decision stream: decode, refuse, deduplicate, serve features, score, decide, stage.

Each micro-batch runs the batch plan over itself and the retained history, so streamed features equal
those of the batch path exactly. Everything a batch writes lies in folders of its own number, written by
overwriting, and the state file is renamed into place last: a batch that is run again after a failure
replaces what it left behind.

Defined cases: a record that can't be decoded, has another schema version or breaks a rule is a dead letter; so
is one earlier than the latest event accepted before it (`late`); events of one instant are not late
and don't see each other; a copy of an accepted event is dropped and counted; more than `stop_after` bad
records in a row stop the stream; an empty batch changes nothing.
"""

from __future__ import annotations

import datetime
import json
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.times import HOUR
from tidemark.operators import decide, features
from tidemark.session import FileStore
from tidemark.sources import records, tables


class TooManyBadRecords(RuntimeError):
    pass


@dataclass
class StreamScorer:
    spark: SparkSession
    root: str
    champion: Callable = decide.stand_in_score
    version: str = "stand-in"
    shadow: Callable | None = None
    shadow_version: str | None = None
    specs: Sequence[features.FeatureSpec] = features.FEATURE_SET
    rules: decide.Rules = field(default_factory=decide.Rules)
    stop_after: int = 50
    retain: int = 25 * HOUR
    #: (version -> model), read anew for each batch through the pointer file CHAMPION, if there is one.
    models: dict[str, Callable] = field(default_factory=dict)

    def __post_init__(self):
        self.root = self.root.rstrip("/")
        self.store = FileStore(self.spark, self.root)
        self.names = [s.name for s in self.specs]

    def state(self) -> dict:
        return json.loads(self.store.read("STATE") or '{"batch": -1, "clock_us": null}')

    def point(self, version: str) -> None:
        """Makes another known model the champion from the next batch on."""
        if version not in self.models:
            raise ValueError(f"unknown model {version}")
        now = json.loads(self.store.read("CHAMPION") or "{}")
        self.store.publish("CHAMPION", json.dumps({"version": version, "previous": now.get("version", self.version)}))

    def roll_back(self) -> None:
        now = json.loads(self.store.read("CHAMPION") or "{}")
        if "previous" not in now:
            raise ValueError("there is no champion to go back to")
        self.store.publish("CHAMPION", json.dumps({"version": now["previous"], "previous": now["version"]}))

    def _model(self) -> tuple[str, Callable]:
        said = json.loads(self.store.read("CHAMPION") or "{}").get("version")
        # A pointer at nothing known is refused: the champion stays.
        return (said, self.models[said]) if said in self.models else (self.version, self.champion)

    def read(self, what: str) -> DataFrame | None:
        """The staged rows or dead letters of all published batches."""
        if not self.store.list(what):
            return None
        return self.spark.read.option("basePath", f"{self.root}/{what}").parquet(f"{self.root}/{what}").where(F.col("batch") <= self.state()["batch"])

    def process(self, raw: DataFrame, batch_id: int) -> None:
        """One micro-batch (for foreachBatch). raw: value, and seq, the place in the log, if the source has one."""
        now = self.state()
        if batch_id < now["batch"] or raw.isEmpty():
            return
        # The batch that the state ends with is run again if the engine failed before noting it: from the clock before.
        clock = now.get("before_us") if batch_id == now["batch"] else now["clock_us"]
        if "seq" not in raw.columns:
            raw = raw.withColumn("seq", F.monotonically_increasing_id())
        # Written once: the batch is read several times and its sequence must stay.
        path = f"{self.root}/taken/batch={batch_id}"
        records.decoded(raw.select("seq", "value")).write.mode("overwrite").parquet(path)
        taken = self.spark.read.parquet(path)
        if taken.where(F.col("reason").isNotNull()).limit(1).count():
            run = records.longest_bad_run(taken.select("seq", "reason"), "seq").first().longest
            if run > self.stop_after:
                raise TooManyBadRecords(f"{run} bad records in a row in batch {batch_id}")
        ok = taken.where(F.col("reason").isNull()).select("seq", "value", "record.*").withColumn("us", F.unix_micros("event_time"))
        before = clock
        history = self._history(batch_id, clock)
        first = features.first_wins(ok, "event_id", ["seq"])
        if history is not None:
            first = first.join(history.select("event_id"), "event_id", "left_anti")
        marked = tables.late_in_log(first, "us", "seq")
        late = F.col("late") | (F.col("us") < F.lit(clock).cast("long")) if clock is not None else F.col("late")
        path = f"{self.root}/marked/batch={batch_id}"
        marked.withColumn("late", late).write.mode("overwrite").parquet(path)
        marked = self.spark.read.parquet(path)
        fresh = marked.where(~F.col("late"))
        ids = ["event_id", "us", "card_id", "device_id", "merchant_id", "session_id", "amount_cents"]
        window = fresh.select(*ids)
        if history is not None:
            window = window.unionByName(history.select(*ids))
        served = features.compute(window, self.specs).join(fresh.select("event_id"), "event_id", "left_semi").drop("us")
        version, model = self._model()
        rows = fresh.select("event_id", "event_time", "us", "card_id", "device_id", "merchant_id", "session_id", "amount_cents").join(served, "event_id")
        decided = decide.decided(rows, self.names, "amount_cents", model, version, self.shadow, self.shadow_version, self.rules)
        day = F.date_format("event_time", "yyyyMMdd")
        decided.withColumns({"decided_at": F.current_timestamp(), "day": day}).write.mode("overwrite").partitionBy("day").parquet(f"{self.root}/staged/batch={batch_id}")
        dead = records.dead_letters(taken).unionByName(marked.where("late").select(F.lit("late").alias("reason"), F.lit(None).cast("string").alias("detail"), F.base64(F.col("value").cast("binary")).alias("payload")))
        dead.write.mode("overwrite").parquet(f"{self.root}/dead/batch={batch_id}")
        top = fresh.agg(F.max("us")).first()[0]  # from the written file's statistics
        clock = max(x for x in (clock, top) if x is not None) if (clock is not None or top is not None) else None
        self.store.publish("STATE", json.dumps({"batch": batch_id, "clock_us": clock, "before_us": before}))

    def _history(self, batch_id: int, clock: int | None) -> DataFrame | None:
        """The staged rows of earlier batches that a window can still reach; partitions by day are pruned."""
        if clock is None or not self.store.list("staged"):
            return None
        rows = self.spark.read.option("basePath", f"{self.root}/staged").parquet(f"{self.root}/staged").where(F.col("batch") < batch_id)
        floor = datetime.datetime.fromtimestamp((clock - self.retain) / 1e6, datetime.UTC).strftime("%Y%m%d")
        return rows.where((F.col("day") >= int(floor)) & (F.col("us") >= clock - self.retain))

    def run(self, stream: DataFrame, checkpoint: str) -> None:
        """Takes all that is there, batch by batch, and returns."""
        query = stream.writeStream.foreachBatch(self.process).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()


def text_stream(spark: SparkSession, path: str, files_per_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(T.StructType([T.StructField("value", T.StringType())])).option("maxFilesPerTrigger", files_per_batch).text(path)


def kafka_stream(spark: SparkSession, servers: str, topic: str) -> DataFrame:
    """value and seq of a topic. One partition's offsets are a sequence; late is judged against them."""
    raw = spark.readStream.format("kafka").options(**tables.kafka_options(servers, topic)).load()
    return raw.select(F.col("value").cast("string").alias("value"), (F.col("offset") * 4096 + F.col("partition")).alias("seq"))


def deduplicated(stream: DataFrame, key: str, time: str, delay: str = "48 hours") -> DataFrame:
    """The stream without copies that arrive within the delay, by Spark's own state."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def hourly_counts(stream: DataFrame, time: str, amount: str, delay: str | None = "24 hours") -> DataFrame:
    """Counts and totals by event hour in Spark's own state, final once the delay has passed; with no delay
    given, the stream's own watermark counts."""
    marked = stream if delay is None else stream.withWatermark(time, delay)
    return marked.groupBy(F.window(time, "1 hour")).agg(F.count(F.lit(1)).alias("n_events"), F.sum(amount).alias("amount_cents"))


def collect_labels(spark: SparkSession, lines: DataFrame, spool: tables.HourSpool, checkpoint: str) -> None:
    """A label stream into a spool by label hour. Unreadable labels are skipped."""

    def take(raw: DataFrame, batch_id: int) -> None:
        spool.append(records.good(records.decoded(raw, schema=records.LABEL, rules=records.label_rules(), version=None)), batch_id)

    lines.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
