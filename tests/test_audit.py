"""The audit finds what differs from the definition, whatever an entity's density, and moves each event once."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tests.test_features import BASE, SCHEMA, SPECS, events
from tidemark.functions.times import DAY, HOUR, SECOND
from tidemark.operators import audit
from tidemark.operators import features as fx
from tidemark.session import shuffles_dropped, written

CARD = [s for s in SPECS if s.entity == "card"]
DEVICE = [s for s in SPECS if s.entity == "device"]


def found(df):
    return {r.feature: (r.compared, r.violations) for r in df.collect()}


@pytest.mark.parametrize("specs", [CARD, DEVICE])
def test_the_definition_has_no_violations(spark, monkeypatch, specs):
    monkeypatch.setattr(audit, "CHUNK", 50)
    txn = spark.createDataFrame(events(6, 300), SCHEMA)
    served = fx.range_join_features(txn, specs).join(txn.select("event_id", "us", f"{specs[0].entity}_id"), "event_id")
    assert found(audit.violations(txn, served, specs)) == {s.name: (300, 0) for s in specs}


def test_wrong_missing_and_invented_values_are_counted(spark):
    rows = events(7)
    txn = spark.createDataFrame(rows, SCHEMA)
    served = fx.compute(txn, CARD, keep=["card_id"])
    wrong = served.withColumn("max_d", F.when(F.col("event_id").isin("e1", "e2"), F.lit(None)).otherwise(F.col("max_d"))).withColumn("count_h", F.when(F.col("event_id") == "e3", F.col("count_h") + 1).otherwise(F.col("count_h")))
    wrong = wrong.where("event_id != 'e4'").unionByName(served.where("event_id = 'e5'").withColumn("event_id", F.lit("other")))
    assert found(audit.violations(txn, wrong, CARD)) == {s.name: (len(rows) + 1, 2 + {"max_d": 2, "count_h": 1}.get(s.name, 0)) for s in CARD}
    assert found(audit.violations(txn.limit(0), served.limit(0), CARD)) == {}
    with pytest.raises(ValueError):
        audit.violations(txn, served, SPECS)


def test_dense_events_across_blocks(spark):
    """A card with 20,000 events in ten days: the definition's pairs would be some 40 million for each daily window."""
    rows = spark.range(20_000).select(
        F.col("id").cast("string").alias("event_id"), (F.lit(BASE) + F.col("id") * 43 * SECOND).alias("us"), F.lit("c").alias("card_id"), F.lit(None).cast("string").alias("device_id"),
        F.concat(F.lit("m"), F.col("id") % 97).alias("merchant_id"), F.lit(None).cast("string").alias("session_id"), (F.col("id") % 1013).alias("amount_cents"),
    )
    specs = [s for s in fx.FEATURE_SET if s.entity == "card"]
    served = fx.compute(rows, specs, keep=["card_id"])
    assert found(audit.violations(rows, served, specs)) == {s.name: (20_000, 0) for s in specs}
    assert served.agg(F.max("card_distinct_merchants_24h")).first()[0] == 97
    late = served.withColumn("us", F.col("us") + 1)
    assert found(audit.violations(rows, late, specs)) == {s.name: (40_000, 40_000) for s in specs}


def test_one_exchange_for_each_side_and_no_join(spark):
    txn = written(spark.createDataFrame(events(8), SCHEMA), "events")
    card = [s for s in fx.FEATURE_SET if s.entity == "card"]
    plan = fx.compute_again(txn, card, ["card_id"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan
    plan = audit.violations(txn, fx.compute_again(txn, card, ["card_id"]), card)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 3 and "Join" not in plan


def test_shuffles_go_with_their_action(spark):
    def files():
        manager = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
        return {b.toString() for b in spark.sparkContext._jvm.scala.jdk.javaapi.CollectionConverters.asJava(manager.getAllBlocks()) if b.isShuffle()}

    def run():
        written(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "counts")

    before = files()
    with shuffles_dropped(spark):
        run()
    assert not files() - before
    run()
    assert files() - before


def test_events_before_1970_and_on_edges(spark):
    specs = [s for s in fx.FEATURE_SET if s.entity == "card"]
    rows = [(f"e{i}", at, "c", None, "m", None, i) for i, at in enumerate([-5 * DAY, -25 * HOUR, -24 * HOUR, -1, 0, 0, 1, HOUR, DAY, DAY + 1, 25 * HOUR, 25 * HOUR + 1])]
    txn = spark.createDataFrame(rows, SCHEMA)
    served = fx.compute(txn, specs, keep=["card_id"])
    assert found(audit.violations(txn, served, specs)) == {s.name: (len(rows), 0) for s in specs}
    want = {r.event_id: tuple(r[s.name] for s in specs) for r in fx.range_join_features(txn, specs).collect()}
    assert {r.event_id: tuple(r[s.name] for s in specs) for r in served.collect()} == want
