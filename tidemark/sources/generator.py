"""A seeded transaction generator: every row is a function of its number and the seed.

Rows can be made in any order, partitioning and portion, and resumed at any number, with equal results:
uniform numbers come from hashes of (seed, purpose, number), and a row's event time from its number.
Entities are drawn by a power of a uniform number, so some are far busier than others. A regime schedule
changes rates by day; planned attacks add bursts of their own.

Defined cases: zero rows give an empty table; attacks of a rate 0 give none.
"""

from __future__ import annotations

import hashlib
import hmac
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.times import DAY, HOUR
from tidemark.sources.records import CATEGORIES


@dataclass(frozen=True)
class World:
    seed: int = 11
    cards: int = 2000
    devices: int = 1500
    merchants: int = 200
    per_day: int = 20_000
    start_us: int = 1_819_756_800_000_000
    attack_share: float = 0.01


@dataclass(frozen=True)
class Regime:
    name: str
    first_day: int
    online_share: float = 0.35
    amount_factor: float = 1.0


def uniform(purpose: str, seed: int, *of: Column) -> Column:
    """In [0, 1), independent for each purpose."""
    return F.pmod(F.xxhash64(F.lit(purpose), F.lit(seed), *of), F.lit(1 << 52)).cast("double") / F.lit(float(1 << 52))


def normal(purpose: str, seed: int, *of: Column) -> Column:
    a, b = uniform(f"{purpose}/a", seed, *of), uniform(f"{purpose}/b", seed, *of)
    return F.sqrt(-2 * F.ln(1 - a)) * F.cos(2 * 3.141592653589793 * b)


def pick(purpose: str, seed: int, n: int, skew: float, *of: Column) -> Column:
    """0..n-1, small numbers more often the larger the skew."""
    return F.floor(F.pow(uniform(purpose, seed, *of), F.lit(skew)) * n).cast("long")


def entity_id(prefix: str, number: Column, width: int) -> Column:
    return F.concat(F.lit(f"{prefix}-"), F.lpad(number.cast("string"), width, "0"))


def schedule(spark: SparkSession, regimes: Sequence[Regime], days: int) -> DataFrame:
    """(day_no, regime, online_share, amount_factor): the regime in force on each day; one row a day."""
    rows = [(k, r.name, r.online_share, r.amount_factor) for k in range(days) for r in [max((r for r in regimes if r.first_day <= k), key=lambda r: r.first_day)]]
    return spark.createDataFrame(rows, "day_no int, regime string, online_share double, amount_factor double")


def sealed_commitment(secret: bytes, text: str) -> str:
    """A commitment to a schedule, checkable once the secret is published."""
    return hmac.new(secret, text.encode(), hashlib.sha256).hexdigest()


def day_share(u: Column) -> Column:
    """Spreads a uniform number over the day with a quiet night: the inverse of 1 - 0.5 cos over the day, by
    one Newton step."""
    tau = 6.283185307179586
    return u + 0.5 / tau * F.sin(tau * u) / (1 - 0.5 * F.cos(tau * u))


def traffic(spark: SparkSession, w: World, days: int, regimes: Sequence[Regime] = (Regime("base", 0),), first: int = 0, until: int | None = None) -> DataFrame:
    """Transactions numbered first..until-1 of days * w.per_day, with regime, scenario and is_fraud: the labels'
    and the ground truth's part, to be split off by `split`."""
    n = F.col("id")
    rows = spark.range(first, days * w.per_day if until is None else until)
    rows = rows.withColumn("day_no", F.floor(n / w.per_day).cast("int"))
    # One row a day: the number of days bounds it.
    rows = rows.join(F.broadcast(schedule(spark, regimes, days)), "day_no")
    attack = uniform("attack", w.seed, n) < w.attack_share
    card = F.when(attack, F.floor(uniform("victim", w.seed, F.floor(n / 16)) * w.cards).cast("long")).otherwise(pick("card", w.seed, w.cards, 3.0, n))
    online = uniform("online", w.seed, n) < F.col("online_share")
    device = F.when(attack, F.pmod(F.floor(n / 64) * 7919, F.lit(w.devices))).when(online, F.pmod(card * 31 + F.floor(uniform("dev", w.seed, n) * 2).cast("long"), F.lit(w.devices)))
    merchant = pick("merchant", w.seed, w.merchants, 2.0, n)
    us = F.lit(w.start_us) + F.col("day_no").cast("long") * DAY + F.floor(day_share(uniform("time", w.seed, n)) * DAY).cast("long")
    amount = F.greatest(F.lit(1), F.round(F.exp(7.8 + 0.9 * normal("amount", w.seed, n)) * F.col("amount_factor") * F.when(attack, 2.5).otherwise(1.0)).cast("long"))
    category = F.array(*[F.lit(c) for c in CATEGORIES])[F.pmod(merchant, F.lit(len(CATEGORIES))).cast("int")]
    scenario = F.when(attack, F.when(F.pmod(n, F.lit(3)) == 0, "card_testing").when(F.pmod(n, F.lit(3)) == 1, "takeover").otherwise("collusion"))
    return rows.select(
        n.alias("number"), F.lit(2).alias("schema_version"), entity_id("evt", n, 12).alias("event_id"), F.timestamp_micros(us).alias("event_time"), entity_id("card", card, 8).alias("card_id"),
        entity_id("dev", device, 8).alias("device_id"), entity_id("mer", merchant, 6).alias("merchant_id"),
        F.when(online, F.concat(F.lit("ses-"), card.cast("string"), F.lit("-"), F.floor(us / (HOUR // 2)).cast("string"))).alias("session_id"), amount.alias("amount_cents"), F.lit("USD").alias("currency"),
        category.alias("merchant_category"), F.when(online, "ecommerce").otherwise("chip").alias("entry_mode"), F.lit("US").alias("card_country"), F.lit("US").alias("merchant_country"),
        F.lit(False).alias("is_recurring"), "regime", scenario.alias("scenario"), attack.alias("is_fraud"),
    )


def split(rows: DataFrame, delay: int = 7 * DAY) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The transactions, their labels a week later, and the ground truth that no feature may see."""
    transactions = rows.drop("number", "regime", "scenario", "is_fraud")
    labels = rows.select("event_id", F.timestamp_micros(F.unix_micros("event_time") + delay).alias("label_time"), "is_fraud", F.when(F.col("is_fraud"), F.floor(F.col("amount_cents") * 0.3).cast("long")).otherwise(F.lit(0)).alias("recovered_cents"))
    return transactions, labels, rows.select("event_id", "is_fraud", "scenario", "regime")


def with_faults(lines: DataFrame, key: str, seed: int, duplicate: float = 0.0, truncate: float = 0.0, rename: float = 0.0) -> DataFrame:
    """JSON lines (value) with planted faults by hash of key: repeated, cut short, or with a renamed field."""
    k = F.col(key)
    value = F.when(uniform("cut", seed, k) < truncate, F.expr("substring(value, 1, length(value) div 2)")).when(uniform("name", seed, k) < rename, F.regexp_replace("value", '"card_id"', '"cardId"')).otherwise(F.col("value"))
    times = F.when(uniform("twice", seed, k) < duplicate, 2).otherwise(1)
    return lines.withColumn("value", value).withColumn("__n", F.explode(F.sequence(F.lit(1), times))).drop("__n")


def reversed_blocks(rows: DataFrame, seq: str, block: int) -> DataFrame:
    """The rows renumbered so that each block of the sequence runs backwards."""
    b = F.floor(F.col(seq) / block) * block
    return rows.withColumn(seq, (b + (block - 1) - (F.col(seq) - b)).cast("long"))


def shifted_clock(rows: DataFrame, time: str, key: str, offset_us: int, share: float, seed: int) -> DataFrame:
    """A share of the rows, by hash of key, with their clock off by offset_us."""
    off = F.timestamp_micros(F.unix_micros(time) + offset_us)
    return rows.withColumn(time, F.when(uniform("clock", seed, F.col(key)) < share, off).otherwise(F.col(time)))


def mean_attack(weights: dict[str, float], sizes: dict[str, float], gaps_s: dict[str, float], intensity: float = 1.0) -> tuple[float, float]:
    """(events, seconds) that one attack is expected to bring and to last, scenarios drawn by weight."""
    total = sum(weights.values())
    if total <= 0:
        raise ValueError("scenario weights add up to nothing")
    size = {k: w / total * sizes[k] * intensity for k, w in weights.items()}
    return sum(size.values()), sum(n * gaps_s[k] for k, n in size.items())
