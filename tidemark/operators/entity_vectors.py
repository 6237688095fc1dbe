"""One row per entity with count, total and latest time of each of hundreds of event types.

Types are encoded as indices by an append-only dictionary: a type keeps its index for ever, so states made
at different times merge by index. An entity's state is a sparse vector, an array of (idx, n, total, last)
sorted by idx: counts and totals add, the latest time wins. `VectorStore` keeps one state per entity and day
of event time; states of days, partitions or regions combine to that of all. Columns are made at the very end.

Events are combined by (day, entity, type) before the shuffle, so an entity with a third of all events
brings at most one row per day, type and task.

Defined cases: a null type is a type of its own, named NULL_TYPE; a null entity is an entity of its
own; an event without a time is left out (it is neither before nor after the moment); a null amount
adds 0; an empty table gives no rows. Extra columns of the input are ignored.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemark.session import FileStore

NULL_TYPE = "(none)"
_ENTRY = "idx INT, n BIGINT, total BIGINT, last TIMESTAMP"


def entity_vectors(entries: DataFrame, dictionary: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, vector) from entries (keys, name, n, total, last) and the dictionary (name, idx). A type without
    an index is an error, not a loss. Spark broadcasts the dictionary if it is small enough for that."""
    coded = entries.join(dictionary, "name", "left")
    idx = F.coalesce(F.col("idx"), F.raise_error(F.concat(F.lit("type without an index: "), F.col("name"))).cast("int"))
    return _packed(coded.select(*keys, idx.alias("idx"), "n", "total", "last"), keys)


def _packed(entries: DataFrame, keys: Sequence[str]) -> DataFrame:
    return entries.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("idx", "n", "total", "last"))).alias("vector"))


def vector_entries(vectors: DataFrame, entity: str) -> DataFrame:
    """(entity, idx, n, total, last): the vectors' entries as rows."""
    return vectors.select(F.col(entity), F.inline("vector"))


def merge_vectors(entity: str, *states: DataFrame) -> DataFrame:
    """One state per entity from several tables of states, several rows an entity in each. Order and grouping
    of the merges don't matter; entries combine before the shuffle."""
    rows = vector_entries(states[0], entity)
    for s in states[1:]:
        rows = rows.unionByName(vector_entries(s, entity))
    merged = rows.groupBy(entity, "idx").agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.max("last").alias("last"))
    return _packed(merged, [entity])


def expand(vectors: DataFrame, entity: str, types: Sequence[str], as_of: Column) -> DataFrame:
    """(entity, and for each type n_T, total_T, idle_us_T): 0, 0 and null for a type that never occurred.
    types: the names in order of their indices.

    Entries are spread over a dense array once per entity, gaps filled by repetition, then picked by position."""
    before = lambda k: F.when(k == 0, F.lit(-1)).otherwise(F.get(F.col("vector"), k - 1)["idx"])
    gap = lambda x, k: F.array_repeat(F.lit(None).cast(f"struct<{_ENTRY}>"), x["idx"] - before(k) - 1)
    rows = vectors.select(F.col(entity).alias("__e"), F.flatten(F.transform("vector", lambda x, k: F.concat(gap(x, k), F.array(x)))).alias("__d"), F.unix_micros(as_of).alias("__now"))
    columns = []
    for i, t in enumerate(types):
        e, name = f"get(__d, {i})", t.replace("`", "``")
        columns += [f"coalesce({e}.n, 0L) AS `n_{name}`", f"coalesce({e}.total, 0L) AS `total_{name}`", f"__now - unix_micros({e}.last) AS `idle_us_{name}`"]
    return rows.selectExpr("__e AS `" + entity.replace("`", "``") + "`", *columns)


class VectorStore:
    """States by day under `root`: `entries/batch=N` (day, entity, name, n, total, last), `states/batch=N` (day,
    entity, vector) and CURRENT, with what counts of the dictionary and the batches, renamed into place last.

    The dictionary lies in `types/part=P` (name, idx); only `types`, which names columns, brings it to the driver."""

    def __init__(self, spark: SparkSession, root: str, entity: str, type_col: str, event_time: str, amount: str):
        self.spark, self.store, self.root = spark, FileStore(spark, root), root.rstrip("/")
        self.entity, self.type_col, self.event_time, self.amount = entity, type_col, event_time, amount

    def _state(self) -> dict:
        return json.loads(self.store.read("CURRENT") or '{"n_types": 0, "parts": 0, "batches": [], "kind": "string"}')

    def dictionary(self) -> DataFrame:
        """(name, idx) of all types so far."""
        parts = self._state()["parts"]
        if not parts:
            return self.spark.createDataFrame([], "name STRING, idx INT")
        return self.spark.read.schema("name STRING, idx INT").parquet(*[f"{self.root}/types/part={p}" for p in range(parts)])

    @property
    def types(self) -> list[str]:
        """Names in order of their indices."""
        return [r.name for r in self.dictionary().orderBy("idx").collect()]

    def learn(self, names: DataFrame) -> None:
        """Appends those of the names (name) that are new, in byte order; no index ever changes."""
        state, size = self._state(), Observation()
        fresh = names.select("name").distinct().join(self.dictionary(), "name", "left_anti")
        rows = fresh.select("name", (F.row_number().over(W.orderBy("name")) + (state["n_types"] - 1)).cast("int").alias("idx"))
        rows.observe(size, F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(f"{self.root}/types/part={state['parts']}")
        self.store.publish("CURRENT", json.dumps(state | {"n_types": state["n_types"] + size.get["n"], "parts": state["parts"] + 1}))

    def add(self, batch_id: int, events: DataFrame) -> None:
        """Takes in the distinct events of one batch, of any days. A batch_id taken in before changes nothing."""
        state = self._state()
        if batch_id in state["batches"]:
            return
        rows = events.select(
            F.to_date(self.event_time).alias("day"), F.col(self.entity).alias("entity"), F.coalesce(F.col(self.type_col), F.lit(NULL_TYPE)).alias("name"),
            F.col(self.event_time).alias("__t"), F.col(self.amount).cast("long").alias("__a"),
        ).where("__t IS NOT NULL")
        entries = rows.groupBy("day", "entity", "name").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("__a"), F.lit(0)).alias("total"), F.max("__t").alias("last"))
        entries.write.mode("overwrite").parquet(f"{self.root}/entries/batch={batch_id}")
        entries = self.spark.read.schema(entries.schema).parquet(f"{self.root}/entries/batch={batch_id}")
        self.learn(entries)
        states = entity_vectors(entries, self.dictionary(), ["day", "entity"])
        states.write.mode("overwrite").parquet(f"{self.root}/states/batch={batch_id}")
        state = self._state()
        state |= {"batches": [*state["batches"], batch_id], "kind": dict(states.dtypes)["entity"]}
        self.store.publish("CURRENT", json.dumps(state))
        self.store.delete(f"entries/batch={batch_id}")

    def states(self) -> DataFrame:
        """(day, entity, vector), one row per entity, day and batch."""
        state = self._state()
        kinds = f"day DATE, entity {state['kind']}, vector ARRAY<STRUCT<{', '.join(x.replace(' ', ': ', 1) for x in _ENTRY.split(', '))}>>"
        if not state["batches"]:
            return self.spark.createDataFrame([], kinds)
        return self.spark.read.schema(kinds).parquet(*[f"{self.root}/states/batch={b}" for b in state["batches"]])

    def merged(self, before: str | None = None) -> DataFrame:
        """(entity, vector) of the days before one (all days without it): what was known as that day began."""
        states = self.states()
        if before is not None:
            states = states.where(F.col("day") < F.lit(before).cast("date"))
        return merge_vectors("entity", states).withColumnRenamed("entity", self.entity)
