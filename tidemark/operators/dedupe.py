"""Exactly one copy of each message that was delivered at least once.

Identifiers are dictionary-encoded exactly: an identifier is given its code, a place in a shard of the delivery
that brought it first, once and for ever, so code and identifier stand for each other without collisions.
What has been seen is a bitmap over codes, in words of 64 bits, sharded like the codes and compressed in
Parquet. A delivery is reduced to one arrival per identifier and encoded; the new codes are published; then
each code's bit is tested, the arrivals of unseen bits are kept, and the bits are united with the seen
ones and published with the delivery by one rename. A run that dies between the two publications leaves
codes without bits, so its rerun keeps their rows; a delivery that was published before isn't taken in again.

Copies are combined before the shuffle, so an identifier with a third of all rows is no hot spot. A delivery
has as many shards as its size asks for, and identifiers are numbered inside a shard. Looking up a delivery
reads the dictionary's narrow columns and lets through a sieve of fixed size, made from the delivery's
identifiers, what may be in it; only that meets the delivery by a shuffle. Deltas of the dictionary and of the
bitmaps are merged every COMPACT deliveries.

Defined cases: of several copies the one with the earliest arrival time is kept; ties go to the
earlier delivery, then to the smallest remaining columns in the order given, so the result never depends on
partitioning; a missing arrival time comes last; rows without identifier can't be told to be copies and are
all kept, outside the dictionary. If a later delivery holds an earlier copy of a seen identifier, it comes out as
`replace` (with the arrival time that it replaces), so that the view by identifier stays the earliest.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.types import StructType

from tidemark.functions.sieve import may_be_in
from tidemark.operators.features import first_row
from tidemark.session import FileStore

#: Deltas that make a merge worth while, and identifiers of a delivery that one shard numbers.
COMPACT, PER_SHARD = 8, 500_000
_PLACE = ["shard", "version", "word"]


def first_copies(rows: DataFrame, key: str, arrival: str, tie_break: Sequence[str] = ()) -> DataFrame:
    """Whole rows, one per identifier, by the rule above: `rows`' columns and __copies. Rows without
    identifier don't take part in the shuffle."""
    best = rows.where(F.col(key).isNotNull()).groupBy(key).agg(
        first_row(rows, [c for c in rows.columns if c != key], [F.col(arrival).isNull(), arrival, *tie_break]).alias("__best"), F.count(F.lit(1)).alias("__copies")
    )
    named = best.select(*[F.col(key) if c == key else F.col("__best")[c].alias(c) for c in rows.columns], "__copies")
    return named.unionByName(rows.where(F.col(key).isNull()).withColumn("__copies", F.lit(1).cast("long")))


class SeenStore:
    """The dictionary and the seen-bitmaps, in numbered versions under `root`.

    Version v holds `arrivals` (a delivery's first copies), `coded` (those with an identifier, and its __shard,
    __version and __code; __fresh if the delivery brought it; __old and __before, the arrival kept and the copies
    taken in until then), `kept` (its rows kept) and `bits` (shard, version, word, bits: what it has seen first).
    CURRENT names what counts; it is renamed into place last."""

    def __init__(self, spark: SparkSession, root: str, per_shard: int = PER_SHARD):
        self.spark, self.store, self.root, self.per_shard = spark, FileStore(spark, root), root.rstrip("/"), per_shard

    def _state(self) -> dict:
        return json.loads(self.store.read("CURRENT") or '{"version": 0, "deliveries": {}, "dictionary": [], "bits": [], "schemas": {}}')

    def _publish(self, state: dict) -> None:
        self.store.publish("CURRENT", json.dumps(state))

    def _read(self, state: dict, kind: str, paths: Sequence[str]) -> DataFrame | None:
        if not paths:
            return None
        return self.spark.read.schema(StructType.fromJson(state["schemas"][kind])).parquet(*[f"{self.root}/{p}" for p in paths])

    def _write(self, state: dict, kind: str, df: DataFrame, path: str) -> DataFrame:
        df.write.mode("overwrite").option("compression", "zstd").parquet(f"{self.root}/{path}")
        state["schemas"][kind] = df.schema.jsonValue()
        return self._read(state, kind, [path])

    def _known(self, state: dict) -> DataFrame | None:
        """(key, shard, version, code, arrival, copies, before, done): what each delivery said of its identifiers."""
        done, parts = {str(v) for v in state["deliveries"].values()}, []
        names = ["shard", "version", "code", "arrival", "copies", "before"]
        for kind in ("merged", "coded"):
            for is_done in (True, False):
                paths = [p for p in state["dictionary"] if p.endswith(kind) and (kind == "merged" or p.split("/")[0] in done) == is_done]
                rows = self._read(state, kind, paths)
                if rows is not None:
                    if kind == "coded":
                        rows = rows.select(F.col(state["key"]).alias("key"), *[F.col(state["arrival"] if c == "arrival" else f"__{c}").alias(c) for c in names])
                    parts.append(rows.select("key", *names).withColumn("done", F.lit(is_done)))
        return reduce(DataFrame.unionByName, parts) if parts else None

    def dictionary(self) -> DataFrame | None:
        """(key, shard, version, code, kept, copies) of all deliveries published: kept is the earliest arrival."""
        rows = self._known(self._state())
        return None if rows is None else self._merged(rows.where("done")).withColumnRenamed("arrival", "kept")

    @staticmethod
    def _merged(known: DataFrame) -> DataFrame:
        """One row per identifier; a copy has the code of the first."""
        return known.groupBy("key").agg(
            F.min("shard").alias("shard"), F.min("version").alias("version"), F.min("code").alias("code"), F.min("arrival").alias("arrival"), F.sum("copies").alias("copies")
        )

    def _coded(self, state: dict, arrivals: DataFrame, key: str, arrival: str, version: int, shards: int) -> DataFrame:
        """The delivery's identified rows with their codes: known identifiers have theirs, fresh ones get the next."""
        own, known = arrivals.where(F.col(key).isNotNull()), self._known(state)
        kind = arrivals.schema[arrival].dataType
        if known is None:
            out = own.withColumns({"__shard": F.lit(None).cast("int"), "__version": F.lit(None).cast("int"), "__code": F.lit(None).cast("long"), "__old": F.lit(None).cast(kind), "__before": F.lit(0).cast("long")})
        else:
            keys = own.select(F.col(key).alias("key"))
            shared = known.where(may_be_in(F.col("key"), keys)).join(keys, "key").groupBy("key").agg(
                *[F.min(c).alias(f"__{c}") for c in ("shard", "version", "code")], F.min(F.when(F.col("done"), F.col("arrival"))).alias("__old"), F.sum(F.when(F.col("done"), F.col("copies")).otherwise(0)).alias("__before")
            )
            out = own.join(shared.withColumnRenamed("key", "__key"), F.col(key) == F.col("__key"), "left").drop("__key")
        fresh = out.withColumns({"__fresh": F.col("__code").isNull(), "__s": F.pmod(F.xxhash64(key), F.lit(shards)).cast("int"), "__before": F.coalesce("__before", F.lit(0).cast("long"))})
        number = F.row_number().over(W.partitionBy("__s", "__fresh").orderBy(key)).cast("long") - 1
        return fresh.withColumns({
            "__code": F.when(F.col("__fresh"), number).otherwise(F.col("__code")), "__shard": F.coalesce("__shard", "__s"), "__version": F.coalesce("__version", F.lit(version))
        }).drop("__s")

    def _judged(self, state: dict, coded: DataFrame) -> DataFrame:
        """coded, with __word, __bit and __seen, whether the code's bit is set."""
        placed = coded.withColumns({"__word": F.expr("__code div 64"), "__bit": F.pmod("__code", F.lit(64)).cast("int")})
        bits = self._read(state, "bits", state["bits"])
        if bits is None:
            return placed.withColumn("__seen", F.lit(False))
        own = [F.col(f"__{c}").alias(c) for c in _PLACE]
        touched = placed.where("NOT __fresh").select(*own).distinct()
        words = bits.join(touched, _PLACE, "left_semi").groupBy(*[F.col(c).alias(f"__{c}") for c in _PLACE]).agg(F.bit_or("bits").alias("__bits"))
        joined = placed.join(words, [f"__{c}" for c in _PLACE], "left")
        return joined.withColumn("__seen", F.coalesce(F.getbit("__bits", "__bit") == 1, F.lit(False))).drop("__bits")

    def take(self, delivery: DataFrame, key: str, arrival: str, tie_break: Sequence[str] = (), delivery_id: str | None = None) -> DataFrame:
        """Takes one delivery in and returns its rows to be kept: `delivery`'s columns, __copies (in this
        delivery), __change (`new` or `replace`) and __replaces. The state is published before it returns.
        A delivery_id that was taken in before gives the same rows again and changes nothing."""
        state = self._state()
        if delivery_id is not None and delivery_id in state["deliveries"]:
            return self._kept(state, [state["deliveries"][delivery_id]])
        version = state["version"] + 1
        size = Observation()
        best = first_copies(delivery, key, arrival, tie_break).observe(size, F.count(F.lit(1)).alias("n"))
        arrivals = self._write(state, "arrivals", best, f"{version}/arrivals")
        shards = max(1, -(-size.get["n"] // self.per_shard))
        coded = self._write(state, "coded", self._coded(state, arrivals, key, arrival, version, shards), f"{version}/coded")
        state |= {"version": version, "dictionary": [*state["dictionary"], f"{version}/coded"], "key": key, "arrival": arrival}
        self._publish(state)
        at, old = F.col(arrival), F.col("__old")
        change = F.when(~F.col("__seen"), "new").when(at.isNotNull() & (old.isNull() | (at < old)), "replace")
        judged = self._judged(state, coded).withColumns({"__change": change, "__replaces": F.when(F.col("__seen"), old)}).where("__change IS NOT NULL").drop("__old", "__before", "__fresh", "__seen")
        bare = arrivals.where(F.col(key).isNull()).withColumn("__change", F.lit("new"))
        kept = self._write(state, "kept", judged.unionByName(bare, allowMissingColumns=True), f"{version}/kept")
        fresh = kept.where((F.col("__change") == "new") & F.col("__word").isNotNull())
        bit = F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("__bit"))).alias("bits")
        self._write(state, "bits", fresh.groupBy(*[F.col(f"__{c}").alias(c) for c in _PLACE]).agg(bit), f"{version}/bits")
        state["bits"].append(f"{version}/bits")
        state["deliveries"][delivery_id if delivery_id is not None else f"#{version}"] = version
        self._publish(state)
        if len(state["bits"]) > COMPACT:
            self.compact()
        return self._kept(state, [version])

    def _kept(self, state: dict, versions: Sequence[int]) -> DataFrame | None:
        rows = self._read(state, "kept", [f"{v}/kept" for v in versions])
        return None if rows is None else rows.drop(*[f"__{c}" for c in _PLACE], "__code", "__bit")

    def compact(self) -> None:
        """Merges the deltas. Codes of a delivery that was not published stay as they are until its rerun."""
        state = self._state()
        done, name = {str(v) for v in state["deliveries"].values()}, f"merged-{state['version']}"
        known = self._known(state)
        if known is None or not state["bits"]:
            return
        merged = self._merged(known.where("done")).withColumn("before", F.lit(0).cast("long"))
        self._write(state, "merged", merged, f"{name}/merged")
        bits = self._read(state, "bits", state["bits"])
        self._write(state, "bits", bits.groupBy(*_PLACE).agg(F.bit_or("bits").alias("bits")), f"{name}/bits")
        left = [p for p in state["dictionary"] if not p.endswith("merged") and p.split("/")[0] not in done]
        state |= {"dictionary": [f"{name}/merged", *left], "bits": [f"{name}/bits"]}
        self._publish(state)

    def view(self, key: str, arrival: str) -> DataFrame | None:
        """Every delivery's kept rows, replaced ones left out: one row per identifier, __copies counting
        those of all deliveries."""
        state = self._state()
        rows = self._kept(state, list(state["deliveries"].values()))
        if rows is None:
            return None
        gone = rows.where(F.col("__change") == "replace").select(F.col(key).alias("__k"), F.col("__replaces").alias("__r"))
        left = rows.join(gone, (F.col(key) == F.col("__k")) & F.col(arrival).eqNullSafe(F.col("__r")), "left_anti").drop("__copies", "__change", "__replaces")
        total = F.col("before") + F.col("copies")
        many = self._known(state).where(F.col("done") & (total > 1)).groupBy(F.col("key").alias("__k")).agg(F.max(total).alias("__n"))
        return left.join(many, F.col(key) == F.col("__k"), "left").withColumn("__copies", F.coalesce("__n", F.lit(1).cast("long"))).drop("__k", "__n")

    def seen_count(self) -> int:
        """How many identifiers have been seen: the set bits."""
        state = self._state()
        bits = self._read(state, "bits", state["bits"])
        return 0 if bits is None else bits.groupBy(*_PLACE).agg(F.bit_or("bits").alias("b")).agg(F.sum(F.bit_count("b"))).first()[0] or 0


def replay(store: SeenStore, rows: DataFrame, by: str, deliveries: int, key: str, arrival: str, tie_break: Sequence[str] = ()) -> SeenStore:
    """Takes rows in as `deliveries` deliveries, equal ranges of the whole-number column `by` in rising order;
    rows without it come with the first. The column isn't part of the message unless it breaks ties."""
    low, high = rows.agg(F.min(by), F.max(by)).first()
    at = [] if low is None else [low + (high + 1 - low) * i // deliveries for i in range(1, deliveries)]
    edges = [None, *sorted(set(at)), None]
    columns = [c for c in rows.columns if c != by or by in tie_break]
    for i, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
        bounds = [F.col(by) >= a] * (a is not None) + [F.col(by) < b] * (b is not None)
        part = reduce(lambda x, y: x & y, bounds, F.lit(True))
        store.take(rows.where(part if a is not None else part | F.col(by).isNull()).select(*columns), key, arrival, tie_break, f"{by} {i}")
    return store
