"""A competition-shaped card CSV mapped to events and labels.

All cells are read as text and cast here, so a bad cell names its row instead of becoming null.

Defined cases: a missing, non-numeric or negative time, a non-positive or non-numeric amount, a missing
id or a label other than 0 and 1 refuse the row (`reason`); a missing addr1 or D1 leaves the card
unlinked. An empty cell, blanks and nan in any case are missing.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The columns that make a card key, in order, and those read at all.
CARD_COLUMNS = ("card1", "card2", "card3", "card4", "card5", "card6", "addr1")
USED_COLUMNS = ("TransactionID", "TransactionDT", "TransactionAmt", "isFraud", "D1", *CARD_COLUMNS)
#: The mark of a missing cell, the first moment in seconds (2017-12-01 UTC), the labels' delay.
MISSING = "~"
EPOCH_S = 1_512_086_400
LABEL_DELAY_S = 7 * 86_400


def read_csv(spark: SparkSession, path: str, columns: Sequence[str] = USED_COLUMNS) -> DataFrame:
    """The columns named, as text; an error if one is absent. Only they are parsed."""
    raw = spark.read.option("header", True).option("inferSchema", False).csv(path)
    if absent := [c for c in columns if c not in raw.columns]:
        raise ValueError(f"columns absent: {absent}")
    return raw.select(*columns)


def normal(cell: Column) -> Column:
    """Trimmed text; a whole number without its fraction; the missing mark for nothing."""
    text = F.trim(cell)
    number = text.try_cast("double")
    whole = number.isNotNull() & (number == F.floor(number)) & (F.abs(number) < 1e15)
    return F.when(text.isNull() | (text == "") | (F.lower(text) == "nan"), MISSING).when(whole, number.cast("decimal(18,0)").cast("string")).otherwise(text)


def cents(cell: Column) -> tuple[Column, Column]:
    """The amount in cents, half to even, and whether it was rounded; null for no positive amount."""
    exact = F.trim(cell).try_cast("decimal(30,10)") * F.lit(100).cast("decimal(3,0)")
    rounded = F.bround(exact, 0).cast("bigint")
    return F.when(rounded > 0, rounded), rounded.cast("decimal(38,10)") != exact


def mapped(rows: DataFrame) -> DataFrame:
    """(transaction_id, event_id, event_time, card_id, amount_cents, label_time, is_fraud, linked, rounded,
    reason): one projection. Columns but reason mean nothing where reason is set."""
    tid, seconds = normal(F.col("TransactionID")), F.floor(F.trim("TransactionDT").try_cast("double")).cast("bigint")
    amount, rounded = cents(F.col("TransactionAmt"))
    fraud = normal(F.col("isFraud"))
    d1 = F.trim("D1").try_cast("double")
    start = d1.cast("bigint")
    linked = (normal(F.col("addr1")) != MISSING) & (normal(F.col("D1")) != MISSING)
    day = F.floor(seconds / 86_400)
    key = F.concat_ws("|", *[normal(F.col(c)) for c in CARD_COLUMNS], (day - start).cast("string"))
    card = F.when(linked, F.concat(F.lit("ieee-card-"), F.substring(F.sha2(key, 256), 1, 20))).otherwise(F.concat(F.lit("ieee-unlinked-"), tid))
    at = F.timestamp_seconds(EPOCH_S + seconds)
    reason = (
        F.when(tid == MISSING, "no id")
        .when(seconds.isNull() | (seconds < 0), "no time")
        .when(amount.isNull(), "no positive amount")
        .when(~fraud.isin("0", "1"), "no label")
        .when(linked & d1.isNull(), "no start day")
    )
    return rows.select(
        tid.alias("transaction_id"), F.concat(F.lit("ieee-"), tid).alias("event_id"), at.alias("event_time"), card.alias("card_id"), amount.alias("amount_cents"),
        F.timestamp_seconds(EPOCH_S + LABEL_DELAY_S + seconds).alias("label_time"), (fraud == "1").alias("is_fraud"), linked.alias("linked"), rounded.alias("rounded"), reason.alias("reason"),
    )


def mapping_report(rows: DataFrame) -> DataFrame:
    """One row: mapped and refused rows, shares of fraud, linked and rounded, linked cards, first and last time."""
    ok = F.col("reason").isNull()
    share = lambda c: F.try_divide(F.count_if(ok & c), F.count_if(ok))
    return rows.agg(
        F.count_if(ok).alias("n_rows"), F.count_if(~ok).alias("refused"), share(F.col("is_fraud")).alias("fraud_share"), share(F.col("linked")).alias("linked_share"),
        share(F.col("rounded")).alias("rounded_share"), F.count_distinct(F.when(ok & F.col("linked"), F.col("card_id"))).alias("linked_cards"),
        F.min(F.when(ok, F.col("event_time"))).alias("first"), F.max(F.when(ok, F.col("event_time"))).alias("last"),
    )
