"""A sieve of fixed size for the keys of a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: 512 KB, whatever the number of keys.
BITS = 1 << 22


def may_be_in(column: Column, keys: DataFrame) -> Column:
    """A condition that holds for every value of keys' only column and, while these are fewer than BITS, for few
    others. It is false for null. The bits are made once, by a subquery."""
    slot = lambda c: F.pmod(F.xxhash64(c), F.lit(BITS))
    word, bit = lambda c: (slot(c) / 64).cast("int"), lambda c: F.pmod(slot(c), F.lit(64)).cast("int")
    key = F.col(keys.columns[0])
    none = keys.sparkSession.range(BITS // 64).select(F.col("id").cast("int").alias("w"), F.lit(0).cast("long").alias("b"))
    some = keys.where(key.isNotNull()).select(word(key).alias("w"), F.call_function("shiftleft", F.lit(1).cast("long"), bit(key)).alias("b"))
    words = none.unionByName(some).groupBy("w").agg(F.bit_or("b").alias("b"))
    bits = words.agg(F.array_sort(F.collect_list(F.struct("w", "b"))).alias("s")).select(F.transform("s", lambda x: x["b"]))
    return column.isNotNull() & (F.getbit(F.get(bits.scalar(), word(column)), bit(column)) == 1)
