"""A sample by key that is the same in every rerun and partitioning and only grows with the data.

Each key belongs for ever to one of 65,536 fine buckets, by a hash. A fixed permutation orders the
buckets; a sample of rate r holds the first r x 65,536 of them. A larger rate appends buckets, so
samples are nested; new records change no old one's bucket, so what was held stays.

Rates may differ by stratum. All rows of a key are treated alike: a key is held if its bucket is in the
list of any stratum among its rows. Later rows can only add strata, so nothing that was held is lost.

Defined cases: a row without key is never held; a missing stratum, or one without a rate, has the rate
`other`; a missing weight stays missing and gives a missing sample weight; repeated rows are all held
or all left; an empty table gives an empty sample. Extra columns pass through.
"""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.sieve import may_be_in

BUCKETS = 65_536
#: The permutation b -> (b x STEP + START) mod BUCKETS; an odd step makes it one-to-one.
STEP, START = 40_503, 12_289
SALTS = 16


def fine_bucket(key: Column, salt: str) -> Column:
    return F.conv(F.substring(F.sha2(F.concat(F.lit(salt), key.cast("string")), 256), 1, 4), 16, 10).cast("int")


def place(bucket: Column) -> Column:
    """The bucket's place in the fixed order."""
    return F.pmod(bucket.cast("long") * STEP + START, F.lit(BUCKETS)).cast("int")


def bucket_list(rate: float) -> list[int]:
    """The buckets that a rate selects, in their fixed order: a prefix of any larger rate's list."""
    back = pow(STEP, -1, BUCKETS)
    return [(p - START) * back % BUCKETS for p in range(held_buckets(rate))]


def held_buckets(rate: float) -> int:
    """Any rate above 0 holds a bucket at least; `sample_rate` says what is held in fact."""
    if not 0 <= rate <= 1:
        raise ValueError("a rate lies between 0 and 1")
    return math.ceil(rate * BUCKETS - 1e-9)


def stable_sample(rows: DataFrame, key: str, stratum: Column, rates: Mapping[str, float], other: float, weight: str | None = None, salt: str = "tidemark/sample/1") -> DataFrame:
    """rows held, with sample_bucket, sample_rate (of the key) and sample_weight (the weight, or 1, over the rate).

    Buckets that no rate reaches are left out at the scan. Keys whose rows have different rates are found by an
    aggregation that combines before its shuffle. Only rows that pass a sieve of these keys are looked up, over
    salted keys, so a key with a third of all rows is spread over several tasks; the others stay where they are."""
    reach = F.lit(held_buckets(other))
    for name, rate in rates.items():
        reach = F.when(stratum == name, held_buckets(rate)).otherwise(reach)
    most = max([held_buckets(other), *map(held_buckets, rates.values())])
    placed = rows.withColumns({"sample_bucket": fine_bucket(F.col(key), salt), "__reach": reach}).withColumn("__place", place(F.col("sample_bucket")))
    within = placed.where(F.col(key).isNotNull() & (F.col("__place") < most))
    uneven = within.groupBy(F.col(key).alias("__key")).agg(F.max("__reach").alias("__most"), F.min("__reach").alias("__least")).where("__most > __least")
    salted = uneven.select("__key", "__most", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("__salt"))
    plain = [c for c, kind in rows.dtypes if "map<" not in kind]
    spread = within.withColumn("__salt", F.pmod(F.xxhash64(*plain), F.lit(SALTS)).cast("int"))
    uneven_key = may_be_in(F.col(key), uneven.select(F.col("__key")))
    looked = spread.where(uneven_key).join(salted, (F.col(key) == F.col("__key")) & (spread["__salt"] == salted["__salt"]), "left")
    looked = looked.withColumn("__reach", F.coalesce("__most", "__reach")).select(*within.columns)
    held = within.where(~uneven_key).unionByName(looked).where(F.col("__place") < F.col("__reach"))
    rate = F.col("__reach") / F.lit(float(BUCKETS))
    worth = F.col(weight).cast("double") if weight else F.lit(1.0)
    return held.withColumns({"sample_rate": rate, "sample_weight": worth / rate}).select(*rows.columns, "sample_bucket", "sample_rate", "sample_weight")
