"""Fitting and scoring a tree ensemble with Spark ML, versions by content, behind the Model protocol.

Training is distributed; scoring is a projection. Inputs are the sixteen features in their order, then
the amount. Defined cases: rows without label are left out; a missing input is the empty window, -1; a
missing weight weighs 1.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.features import EMPTY, FEATURE_NAMES

INPUTS = (*FEATURE_NAMES, "amount_cents")


def assembled(rows: DataFrame, inputs: Sequence[str] = INPUTS) -> DataFrame:
    from pyspark.ml.functions import array_to_vector

    if missing := [c for c in inputs if c not in rows.columns]:
        raise ValueError(f"missing inputs: {missing}")
    return rows.withColumn("inputs", array_to_vector(F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(EMPTY)) for c in inputs])))


def fit(rows: DataFrame, inputs: Sequence[str] = INPUTS, trees: int = 20, depth: int = 4, seed: int = 1):
    """A gradient-boosted classifier of is_fraud, weighted."""
    from pyspark.ml.classification import GBTClassifier

    data = assembled(rows.where(F.col("is_fraud").isNotNull()), inputs).select("inputs", F.col("is_fraud").cast("double").alias("label"), F.coalesce("weight", F.lit(1.0)).alias("w"))
    return GBTClassifier(featuresCol="inputs", labelCol="label", weightCol="w", maxIter=trees, maxDepth=depth, seed=seed).fit(data)


def scored(model, rows: DataFrame, inputs: Sequence[str] = INPUTS, score: str = "score") -> DataFrame:
    from pyspark.ml.functions import vector_to_array

    out = model.transform(assembled(rows, inputs))
    return out.withColumn(score, vector_to_array("probability")[1]).drop("inputs", "rawPrediction", "probability", "prediction")


def version(model, role: str) -> str:
    """role and 12 hex digits of the model's content."""
    return f"{role}-{hashlib.sha256(model.toDebugString.split(chr(10), 1)[1].encode()).hexdigest()[:12]}"


def standardisation(rows: DataFrame, inputs: Sequence[str] = INPUTS) -> DataFrame:
    """(input, mean, std) of log1p of the inputs, weighted, the empty window as 0. One aggregate."""
    w = F.coalesce("weight", F.lit(1.0))
    x = {c: F.log1p(F.greatest(F.coalesce(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0))) for c in inputs}
    sums = rows.agg(F.sum(w).alias("w"), *[F.sum(w * v).alias(f"a_{c}") for c, v in x.items()], *[F.sum(w * v * v).alias(f"b_{c}") for c, v in x.items()])
    each = [F.struct(F.lit(c).alias("input"), F.try_divide(f"a_{c}", "w").alias("mean"), F.try_divide(f"b_{c}", "w").alias("sq")) for c in inputs]
    return sums.select(F.inline(F.array(*each))).select("input", "mean", F.sqrt(F.greatest(F.col("sq") - F.col("mean") * F.col("mean"), F.lit(0.0))).alias("std"))
