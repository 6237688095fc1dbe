"""Feature views by entity in the Spark catalog, and parity of two paths.

Defined cases: an entity with an unbounded window keeps its values for 90 days; views of no specification
are none; a row missing on either side of a comparison differs, nulls equal nulls.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.times import DAY
from tidemark.operators.features import EMPTY, FeatureSpec


def by_entity(specs: Sequence[FeatureSpec]) -> dict[str, list[FeatureSpec]]:
    out: dict[str, list[FeatureSpec]] = {}
    for s in specs:
        out.setdefault(s.entity, []).append(s)
    return out


def view_name(entity: str) -> str:
    return f"{entity}_features"


def feature_refs(specs: Sequence[FeatureSpec]) -> list[str]:
    return [f"{view_name(s.entity)}:{s.name}" for s in specs]


def view_ttl(specs: Sequence[FeatureSpec]) -> int:
    """How long a value stays fresh: the longest lookback, resolution included."""
    return max(90 * DAY if s.window is None else s.window + (s.resolution or 0) for s in specs)


def create_views(narrow_rows: DataFrame, specs: Sequence[FeatureSpec], as_of: int | None = None) -> list[str]:
    """A temporary view per entity with a column per feature, fresh values only if as_of is given."""
    names = []
    for entity, own in by_entity(specs).items():
        rows = narrow_rows.where(F.col("entity") == entity)
        if as_of is not None:
            rows = rows.where((F.col("us") <= as_of) & (F.col("us") >= as_of - view_ttl(own)))
        rows.select("entity_id", "event_id", "us", *[F.coalesce(F.try_element_at("features", F.lit(s.name)), F.lit(EMPTY)).alias(s.name) for s in own]).createOrReplaceTempView(view_name(entity))
        names.append(view_name(entity))
    return names


def disagreements(left: DataFrame, right: DataFrame, key: str, columns: Sequence[str], tolerance: float = 0.0) -> DataFrame:
    """(key, column, left, right) of every cell that differs; rows missing on one side differ as a whole, with
    column `(row)`. One full join on the key."""
    a = left.select(F.col(key), F.struct(*columns).alias("__l"))
    b = right.select(F.col(key), F.struct(*columns).alias("__r"))
    both = a.join(b, key, "full")
    kinds = dict(left.dtypes)

    def cell(c: str):
        x, y = F.col("__l")[c], F.col("__r")[c]
        same = x.eqNullSafe(y)
        if tolerance and kinds[c] in ("double", "float", "bigint", "int"):
            same = same | F.coalesce(F.abs(x - y) <= tolerance, F.lit(False))
        return F.when(~same, F.struct(F.lit(c).alias("column"), x.cast("string").alias("left"), y.cast("string").alias("right")))

    missing = F.when(F.col("__l").isNull() | F.col("__r").isNull(), F.array(F.struct(F.lit("(row)").alias("column"), F.col("__l").cast("string").alias("left"), F.col("__r").cast("string").alias("right"))))
    return both.select(key, F.inline(F.coalesce(missing, F.array_compact(F.array(*[cell(c) for c in columns])))))


def parity(left: DataFrame, right: DataFrame, key: str, columns: Sequence[str], tolerance: float = 0.0) -> DataFrame:
    """One row: keys on either side, rows and cells that differ, and the share of rows that agree."""
    n = left.select(key).unionByName(right.select(key)).distinct().agg(F.count(F.lit(1)).alias("compared"))
    d = disagreements(left, right, key, columns, tolerance).agg(F.count_distinct(key).alias("rows_differing"), F.count(F.lit(1)).alias("cells_differing"))
    return n.crossJoin(d).withColumn("parity", F.try_divide(F.col("compared") - F.col("rows_differing"), F.col("compared")))
