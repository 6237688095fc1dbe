"""Scores, rules, strata and hash draws as column expressions.

Everything here is a projection: it stays in one generated stage with its input. Defined cases: a
missing feature counts as the empty window, -1; a null score decides as missing, action null; a null
amount is no large amount; a null id draws null and is never kept.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

APPROVE, REVIEW, DECLINE = "approve", "review", "decline"


@dataclass(frozen=True)
class Rules:
    decline_at: float = 0.90
    review_at: float = 0.50
    large_cents: int = 500_000

    def __post_init__(self):
        if not 0 <= self.review_at <= self.decline_at <= 1:
            raise ValueError("thresholds lie in order between 0 and 1")

    def decide(self, score: Column, amount: Column) -> Column:
        """struct(action, rule). The names are fixed values."""
        pair = lambda a, r: F.struct(F.lit(a).alias("action"), F.lit(r).alias("rule"))
        return (
            F.when(score >= self.decline_at, pair(DECLINE, "score-decline"))
            .when(score >= self.review_at, pair(REVIEW, "score-review"))
            .when(score.isNotNull() & (amount >= self.large_cents), pair(REVIEW, "large-amount-review"))
            .when(score.isNotNull(), pair(APPROVE, "default-approve"))
        )


def clamp(score: Column) -> Column:
    return F.when(F.isnan(score), F.lit(None).cast("double")).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), score)))


def stand_in_score(features: Mapping[str, Column], amount: Column) -> Column:
    """A fixed logistic of recent activity, for use where no fitted model is given."""
    seen = lambda name: F.greatest(F.coalesce(features[name], F.lit(-1.0)), F.lit(0.0))
    unusual = (seen("card_amount_mean_24h") > 0) & (amount > 3 * seen("card_amount_mean_24h"))
    z = -4.0 + 0.6 * F.log1p(seen("card_txn_count_1h")) + 0.8 * F.log1p(seen("device_distinct_cards_1h")) + F.when(unusual, 1.5).otherwise(0.0)
    return 1.0 / (1.0 + F.exp(-z))


Model = Callable[[Mapping[str, Column], Column], Column]


def decided(rows: DataFrame, inputs: Sequence[str], amount: str, champion: Model, champion_version: str, shadow: Model | None = None, shadow_version: str | None = None, rules: Rules = Rules(), shadow_where: Column | None = None) -> DataFrame:
    """rows with champion_*, action, rule and shadow_* columns. The champion's score decides; the shadow's
    is only recorded, where shadow_where holds."""
    features, cents = {c: F.col(c) for c in inputs}, F.col(amount)
    out = rows.withColumns({"champion_version": F.lit(champion_version), "champion_score": clamp(champion(features, cents))})
    out = out.withColumn("__d", rules.decide(F.col("champion_score"), cents)).withColumns({"action": F.col("__d.action"), "rule": F.col("__d.rule")}).drop("__d")
    if shadow is None:
        return out
    on = F.lit(True) if shadow_where is None else shadow_where
    out = out.withColumn("shadow_score", F.when(on, clamp(shadow(features, cents))))
    there = F.col("shadow_score").isNotNull()
    return out.withColumns({"shadow_version": F.when(there, F.lit(shadow_version)), "shadow_action": F.when(there, rules.decide(F.col("shadow_score"), cents)["action"])})


def batch_model(score: Callable, inputs: Sequence[str]):
    """A Model from a function of a float64 matrix, run on Arrow batches (an ONNX session, say)."""
    import pandas as pd

    def run(*columns: pd.Series) -> pd.Series:
        return pd.Series(score(pd.concat(columns, axis=1).to_numpy("float64")))

    run.__annotations__ = {"columns": pd.Series, "return": pd.Series}
    udf = F.pandas_udf(run, "double")
    return lambda features, amount: udf(*[features[c].cast("double") for c in inputs], amount.cast("double"))


def model_inputs(columns: Sequence[str], inputs: Sequence[str]) -> Column:
    """The inputs in order as one array; a missing column is an error."""
    if missing := [c for c in inputs if c not in columns]:
        raise ValueError(f"missing inputs: {missing}")
    return F.array(*[F.col(c).cast("double") for c in inputs])


def stratum(action: Column, is_fraud: Column) -> Column:
    return F.when(action != APPROVE, "acted").when(is_fraud, "fraud").when(~is_fraud, "legit")


def draw(key: Column, salt: str) -> Column:
    """A number in [0, 1) from the first 8 bytes of SHA-256 over salt and key; the same everywhere."""
    head = F.conv(F.substring(F.sha2(F.concat(F.lit(salt), key.cast("string")), 256), 1, 16), 16, 10)
    return head.cast("decimal(20,0)").cast("double") / F.lit(2.0**64)


def per_mille(key: Column, n: int) -> Column:
    """Whether a key is in a sample of n in a thousand."""
    return F.pmod(F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("long"), F.lit(1000)) < n


def expected_loss(p: Column, amount: Column, recovery: float, review_cost: float) -> Column:
    return p * amount * (1 - recovery) - review_cost
