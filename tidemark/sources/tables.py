"""Replay, spools by hour, feature stores, profiles and checksums, on ordinary Parquet and files.

Defined cases: rows without event time are in no hour and are left out of spools, replays and spans; an
empty table has a span of nulls and an empty profile of counts 0.
"""

from __future__ import annotations

import datetime
import json
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemark.session import FileStore


def late_in_log(rows: DataFrame, time: str, seq: str, block: int = 100_000) -> DataFrame:
    """rows with `late`: whether an earlier row of the log has a later time. The log's sequence numbers are
    cut into blocks; each knows the latest time of all blocks before, so the log isn't sorted in one task.
    A late row doesn't move the clock: it is below it."""
    b = F.floor(F.col(seq) / block)
    placed = rows.withColumn("__b", b)
    tops = placed.groupBy("__b").agg(F.max(time).alias("__top"))
    before = tops.select("__b", F.max("__top").over(W.orderBy("__b").rowsBetween(W.unboundedPreceding, -1)).alias("__before"))
    inside = W.partitionBy("__b").orderBy(seq).rowsBetween(W.unboundedPreceding, -1)
    found = placed.withColumn("__in", F.max(time).over(inside)).join(before, "__b", "left")
    return found.select(*rows.columns, F.coalesce(F.col(time) < F.greatest("__in", "__before"), F.lit(False)).alias("late"))


def in_time_order(rows: DataFrame, time: str, seq: str, strict: bool = True) -> DataFrame:
    """The log without its backward steps; strict, an error when a row steps back."""
    marked = late_in_log(rows, time, seq)
    if not strict:
        return marked.where(~F.col("late")).select(*rows.columns)
    checked = F.when(F.col("late"), F.raise_error(F.concat(F.lit("out of time order at "), F.col(seq).cast("string")))).otherwise(F.col(time))
    return marked.withColumn(time, checked.cast(rows.schema[time].dataType)).select(*rows.columns)


def numbered(rows: DataFrame, part: Column, order: Sequence[str], name: str = "seq") -> DataFrame:
    """rows with their places from 0 on in order of (part, order): places inside a part, after the rows of the
    parts before. `part` must not fall while `order` grows; only the parts' sizes meet in one task."""
    placed = rows.withColumn("__p", part)
    sizes = placed.groupBy("__p").agg(F.count(F.lit(1)).alias("__n"))
    ahead = F.coalesce(F.sum("__n").over(W.orderBy("__p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0).cast("long"))
    starts = sizes.select(F.col("__p").alias("__q"), ahead.alias("__ahead"))
    inside = placed.withColumn("__i", F.row_number().over(W.partitionBy("__p").orderBy(*order)) - 1)
    return inside.join(starts, F.col("__p").eqNullSafe(F.col("__q"))).select(*rows.columns, (F.col("__i") + F.col("__ahead")).alias(name))


def before(rows: DataFrame, time: str, moment: Column) -> DataFrame:
    """Rows strictly before a moment."""
    return rows.where(F.col(time) < moment)


def span(rows: DataFrame, time: str) -> DataFrame:
    return rows.agg(F.min(time).alias("first"), F.max(time).alias("last"))


class HourSpool:
    """Rows by event hour: appended as `root/open/batch=B/hour=H`, and sealed, each hour into few sorted zstd
    files, as `root/sealed/hour=H`. A hot hour is split by its rows' size, not forced into one file.

    Sealing takes the files that it has listed, so rows appended meanwhile stay open. Its moves and deletions
    are published as JOURNAL before the first of them and done again from there if a run dies. LEDGER says which
    hours of a batch were sealed, so that a batch delivered again adds nothing to them."""

    def __init__(self, spark: SparkSession, root: str, time: str = "event_time"):
        self.spark, self.root, self.time, self.store = spark, root.rstrip("/"), time, FileStore(spark, root)
        self.recover()

    def append(self, rows: DataFrame, batch_id: int | str | None = None) -> None:
        """A batch with an id replaces itself when it is delivered again."""
        name = uuid.uuid4().hex if batch_id is None else str(batch_id)
        hour = F.date_format(self.time, "yyyy-MM-dd'T'HH")
        due = rows.where(F.col(self.time).isNotNull()).withColumn("hour", hour)
        if gone := self._ledger().get(name):
            due = due.where(~F.col("hour").isin(*gone))
        due.hint("rebalance", "hour").write.mode("overwrite").partitionBy("hour").parquet(f"{self.root}/open/batch={name}")

    def _ledger(self) -> dict[str, list[str]]:
        return json.loads(self.store.read("LEDGER") or "{}")

    def _hours(self, folder: str) -> list[str]:
        return [n.removeprefix("hour=") for n in self.store.list(folder) if n.startswith("hour=")]

    def _of(self, state: str) -> list[str]:
        if state == "sealed":
            return self._hours("sealed")
        return sorted({h for batch in self.store.list("open") for h in self._hours(f"open/{batch}")})

    def hours(self) -> list[str]:
        return sorted({*self._of("open"), *self._of("sealed")})

    def sealed(self) -> list[str]:
        return self._of("sealed")

    def read(self, hours: Sequence[str] | None = None, columns: Sequence[str] | None = None) -> DataFrame | None:
        """Sealed and open rows of the hours named (all, if none are): partitions and columns are pruned."""
        parts = []
        for state in ("sealed", "open"):
            if self._of(state):
                df = self.spark.read.option("basePath", f"{self.root}/{state}").option("mergeSchema", False).parquet(f"{self.root}/{state}")
                df = df if hours is None else df.where(F.col("hour").cast("string").isin(*hours))
                parts.append(df.select(*(columns or [c for c in df.columns if c not in ("hour", "batch")])))
        return None if not parts else parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])

    def _files(self, folder: str) -> list[str]:
        return [f"{folder}/{n}" for n in self.store.list(folder) if n.startswith("part-")]

    def seal(self, hour: str, sort: Sequence[str] = (), max_rows: int = 5_000_000) -> bool:
        """Compacts an hour's open files, and what was sealed of it before; False if nothing is open."""
        return bool(self._seal([hour], sort, max_rows))

    def _seal(self, hours: Sequence[str], sort: Sequence[str] = (), max_rows: int = 5_000_000) -> list[str]:
        """Compacts those of the hours that are open, in one job."""
        open_ = {h: [f"open/{b}/hour={h}" for b in self.store.list("open") if self.store.exists(f"open/{b}/hour={h}")] for h in hours}
        due = sorted(h for h, folders in open_.items() if folders)
        if not due:
            return []
        taken = [f for h in due for folder in (*open_[h], f"sealed/hour={h}") for f in self._files(folder)]
        rows = self.spark.read.parquet(*[f"{self.root}/{f}" for f in taken]).withColumn("hour", F.date_format(self.time, "yyyy-MM-dd'T'HH"))
        # Rows of an hour come together; a large hour is split by its size.
        out = rows.hint("rebalance", "hour")
        out = out.sortWithinPartitions("hour", *sort) if sort else out
        self.store.delete("sealing")
        out.write.mode("overwrite").option("compression", "zstd").option("maxRecordsPerFile", max_rows).partitionBy("hour").parquet(f"{self.root}/sealing")
        ledger: dict[str, list[str]] = {}
        for h in due:
            for folder in open_[h]:
                ledger.setdefault(folder.split("/")[1].removeprefix("batch="), []).append(h)
        moves = [[f, f.replace("sealing/", "sealed/", 1)] for h in self._hours("sealing") for f in self._files(f"sealing/hour={h}")]
        self.store.publish("JOURNAL", json.dumps({"moves": moves, "deletes": taken, "folders": [f for h in due for f in open_[h]], "ledger": ledger}))
        self.recover()
        return due

    def recover(self) -> None:
        """Finishes a sealing whose run died after its journal was published."""
        if not (text := self.store.read("JOURNAL")):
            return
        journal, path, fs = json.loads(text), self.store._path, self.store._fs
        for folder in {dst.rsplit("/", 1)[0] for _, dst in journal["moves"]}:
            fs.mkdirs(path(f"{self.root}/{folder}"))
        for src, dst in journal["moves"]:
            fs.rename(path(f"{self.root}/{src}"), path(f"{self.root}/{dst}"))  # false where it is moved already
        for f in journal["deletes"]:
            fs.delete(path(f"{self.root}/{f}"), False)
        for folder in journal["folders"]:
            if not self._files(folder):
                self.store.delete(folder)
        ledger = self._ledger()
        for batch, hours in journal["ledger"].items():
            ledger[batch] = sorted({*ledger.get(batch, []), *hours})
        self.store.publish("LEDGER", json.dumps(ledger))
        self.store.delete("JOURNAL")

    def seal_closed(self, now_hour: str, limit: int | None = None) -> list[str]:
        """Seals open hours before now_hour, the oldest first."""
        return self._seal([h for h in self._of("open") if h < now_hour][:limit])

    def seal_settled(self, now: datetime.datetime, settle_minutes: int = 10) -> list[str]:
        """Seals open hours that ended at least settle_minutes before now."""
        return self.seal_closed((now - datetime.timedelta(minutes=settle_minutes)).strftime("%Y-%m-%dT%H"))

    def day_ready(self, day: str, now: datetime.datetime, settle_hours: int = 3) -> bool:
        """Whether a day is over, settled, and none of its hours is open."""
        end = datetime.datetime.fromisoformat(day).replace(tzinfo=now.tzinfo) + datetime.timedelta(days=1, hours=settle_hours)
        return now >= end and not any(h.startswith(day) for h in self._of("open"))

    def delete(self, hours: Sequence[str]) -> None:
        for h in hours:
            self.store.delete(f"sealed/hour={h}")
            for batch in self.store.list("open"):
                self.store.delete(f"open/{batch}/hour={h}")


class FeatureStore:
    """Offline rows appended by entity kind, and the newest row per entity as the online table."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.store = spark, root.rstrip("/"), FileStore(spark, root)

    def write(self, narrow_rows: DataFrame, batch_id: int) -> None:
        """Offline first, then online; a batch written again replaces itself. narrow_rows: event_id, us, entity,
        entity_id, features."""
        rows = narrow_rows.select("entity", "entity_id", "event_id", "us", "features")
        rows.write.mode("overwrite").partitionBy("entity").parquet(f"{self.root}/offline/batch={batch_id}")
        written = self.spark.read.parquet(f"{self.root}/offline/batch={batch_id}").select(*rows.columns)
        from tidemark.operators.features import latest_values

        old = self.online()
        merged = latest_values(written if old is None else old.unionByName(written)).select(*rows.columns)
        version = int(self.store.read("ONLINE") or -1) + 1
        merged.write.mode("overwrite").parquet(f"{self.root}/online/{version}")
        self.store.publish("ONLINE", str(version))

    def offline(self, entity: str | None = None) -> DataFrame:
        rows = self.spark.read.parquet(f"{self.root}/offline").drop("batch")
        return rows if entity is None else rows.where(F.col("entity") == entity)

    def online(self) -> DataFrame | None:
        v = self.store.read("ONLINE")
        return None if v is None else self.spark.read.parquet(f"{self.root}/online/{v}")


def profile(rows: DataFrame) -> DataFrame:
    """(column, type, n, missing_share, n_distinct, example): whole columns; the smallest value as `example`."""
    kinds = dict(rows.dtypes)
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("v")) for c in rows.columns])
    by_value = rows.select(F.inline(cells)).groupBy("column", "v").agg(F.count(F.lit(1)).alias("n"))
    g = by_value.groupBy("column").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("v").isNull(), F.col("n")).otherwise(0)).alias("m"), F.count("v").alias("n_distinct"), F.min("v").alias("e"))
    kind = F.create_map(*[x for c, k in kinds.items() for x in (F.lit(c), F.lit(k))])
    return g.select("column", kind[F.col("column")].alias("type"), "n", F.try_divide("m", "n").alias("missing_share"), "n_distinct", F.col("e").alias("example"))


def time_resolution(rows: DataFrame, time: str) -> DataFrame:
    """One row: first, last, distinct moments, share of rows that share a moment, smallest positive gap (micros).

    Gaps are taken inside days, and between a day's last moment and the next day's first."""
    us = rows.select(F.unix_micros(time).alias("us")).where(F.col("us").isNotNull()).groupBy("us").agg(F.count(F.lit(1)).alias("n"))
    day = F.floor(F.col("us") / 86_400_000_000)
    w = W.partitionBy("d").orderBy("us")
    inner = us.withColumn("d", day).withColumn("gap", F.col("us") - F.lag("us").over(w))
    days = inner.groupBy("d").agg(F.min("us").alias("a"), F.max("us").alias("b"), F.count(F.lit(1)).alias("k"), F.sum("n").alias("n"), F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(0)).alias("s"), F.min("gap").alias("g"))
    edges = days.withColumn("e", F.col("a") - F.lag("b").over(W.orderBy("d")))
    return edges.agg(F.min("a").alias("first_us"), F.max("b").alias("last_us"), F.sum("k").alias("n_distinct"), F.try_divide(F.sum("s"), F.sum("n")).alias("share_sharing"), F.least(F.min("g"), F.min("e")).alias("smallest_gap_us"))


def findings(rows: DataFrame, key: str, present: Sequence[str], identities: DataFrame, labels: DataFrame) -> DataFrame:
    """One row about a dataset: n_rows, the share of rows with each of the columns in `present`, the share whose
    key has an identity record, and of the labelled rows' keys the share labelled fraud. identities: key; labels:
    key, is_fraud. Copies on either side count once a row."""
    known = identities.select(F.col(key).alias("__k")).where("__k IS NOT NULL").distinct().withColumn("__known", F.lit(1))
    said = labels.where(F.col("is_fraud").isNotNull()).groupBy(F.col(key).alias("__l")).agg(F.max(F.col("is_fraud").cast("int")).alias("__fraud"))
    both = rows.join(known, F.col(key) == F.col("__k"), "left").join(said, F.col(key) == F.col("__l"), "left")
    return both.agg(
        F.count(F.lit(1)).alias("n_rows"), *[F.avg(F.col(c).isNotNull().cast("int")).alias(f"{c}_share") for c in present],
        F.avg(F.coalesce("__known", F.lit(0))).alias("identity_share"), F.avg(F.col("__fraud").isNotNull().cast("int")).alias("labelled_share"), F.avg("__fraud").alias("fraud_share"),
    )


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """(name, size, sha256) of the files under a path, named from there on. A file is read whole by one task."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    root = place.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(place).toString()
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    below = F.when(F.startswith("path", F.lit(f"{root}/")), F.substring("path", len(root) + 2, 1_000_000)).otherwise(F.element_at(F.split("path", "/"), -1))
    return files.select(below.alias("name"), F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))


def verify(spark: SparkSession, path: str, recorded: DataFrame) -> DataFrame:
    """(name, state): same, changed, missing or new, against recorded (name, sha256)."""
    now = checksums(spark, path).select("name", F.col("sha256").alias("now"))
    both = recorded.select("name", F.col("sha256").alias("then")).join(now, "name", "full")
    state = F.when(F.col("now").isNull(), "missing").when(F.col("then").isNull(), "new").when(F.col("now") == F.col("then"), "same").otherwise("changed")
    return both.select("name", state.alias("state"))


def kafka_options(servers: str, topic: str, starting: str = "earliest", ending: str | None = None, fail_on_loss: bool = True) -> dict[str, str]:
    """Options for spark.read or spark.readStream with format kafka. The connector is the cluster's to provide."""
    out = {"kafka.bootstrap.servers": servers, "subscribe": topic, "startingOffsets": starting, "failOnDataLoss": str(fail_on_loss).lower()}
    return out | ({"endingOffsets": ending} if ending else {})


def kafka_sink_options(servers: str, topic: str) -> dict[str, str]:
    return {"kafka.bootstrap.servers": servers, "topic": topic, "kafka.acks": "all", "kafka.enable.idempotence": "true"}
