"""Windows against the definition on random events; order, later events and partitions change nothing."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions.times import DAY, HOUR, MINUTE
from tidemark.operators import features as fx

SCHEMA = "event_id string, us bigint, card_id string, device_id string, merchant_id string, session_id string, amount_cents bigint"
BASE = 1_821_000_000_000_000
SPECS = [
    fx.FeatureSpec(f"{a}_{w}", "card", a, None if a in ("count", "seconds_since_last") else "merchant_id" if a == "distinct_count" else "amount_cents", *lane)
    for a in fx.AGGREGATIONS
    for w, lane in {"h": (HOUR, None), "q": (HOUR, 15 * MINUTE), "d": (DAY, HOUR)}.items()
] + [fx.FeatureSpec("cards", "device", "distinct_count", "card_id", HOUR), fx.FeatureSpec("merchants_of_device", "device", "distinct_count", "merchant_id", HOUR)]


def events(seed, n=120):
    r = random.Random(seed)
    return [
        (f"e{i}", BASE + r.choice([r.randrange(300) * MINUTE, r.randrange(3) * HOUR, r.randrange(2 * DAY)]), r.choice(["c1", "c2"]), r.choice([None, "d1"]), r.choice([None, "m1", "m2", "m3"]), None, r.choice([1, 5, 900, None]))
        for i in range(n)
    ]


def values(df, specs=SPECS):
    return {r.event_id: tuple(round(r[s.name], 6) for s in specs) for r in df.collect()}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_equal_to_the_definition(spark, seed):
    txn = spark.createDataFrame(events(seed), SCHEMA)
    assert values(fx.compute(txn, SPECS)) == values(fx.range_join_features(txn, SPECS))


def test_later_events_and_order_change_nothing(spark):
    rows = sorted(events(4), key=lambda r: r[1])
    early = values(fx.compute(spark.createDataFrame(rows[:80], SCHEMA), SPECS))
    shuffled = rows[:]
    random.Random(5).shuffle(shuffled)
    late = values(fx.compute(spark.createDataFrame(shuffled, SCHEMA).repartition(7), SPECS))
    last = rows[79][1]
    assert all(late[k] == v for k, v in early.items() if next(r for r in rows if r[0] == k)[1] < last)


def test_edges(spark):
    rows = [("a", BASE, "c", None, None, None, 5), ("b", BASE + HOUR, "c", None, None, None, 7), ("c", BASE + HOUR + 1, "c", None, None, None, 1), ("d", BASE + HOUR, None, None, None, None, 1), (None, BASE, "c", None, None, None, 1), ("e", None, "c", None, None, None, 1)]
    got = {r.event_id: (r.card_txn_count_1h, r.card_amount_sum_1h) for r in fx.compute(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {"a": (-1.0, -1.0), "b": (1.0, 5.0), "c": (1.0, 7.0), "d": (-1.0, -1.0)}
    assert fx.compute(spark.createDataFrame([], SCHEMA)).count() == 0


def test_specifications_are_checked():
    for bad in (dict(aggregation="median"), dict(aggregation="sum"), dict(aggregation="count", field="x"), dict(aggregation="count", window=0), dict(aggregation="count", resolution=7)):
        with pytest.raises(ValueError):
            fx.FeatureSpec("x", "card", **bad)
    with pytest.raises(ValueError):
        fx.validate([SPECS[0], SPECS[0]])
    assert [s.name for s in fx.features_on(fx.FEATURE_SET, ["card_id", "amount_cents"])] == [s.name for s in fx.FEATURE_SET if s.entity == "card" and s.field != "merchant_id"]


def test_as_of(spark):
    states = spark.createDataFrame([("x", BASE, 1.0), ("x", BASE + 10, 2.0), ("x", BASE + 3 * DAY, 3.0)], "id string, us bigint, v double")
    asked = spark.createDataFrame([("x", BASE - 1, "before"), ("x", BASE, "at"), ("x", BASE + 11, "after"), ("x", BASE + 2 * DAY, "old"), ("y", BASE, "none"), ("x", BASE + 4 * DAY, "next")], "id string, at bigint, name string")
    got = {r.name: r.v for r in fx.as_of_values(asked, states, "id", "at", "us", ["v"], DAY).collect()}
    assert got == {"before": -1.0, "at": 1.0, "after": 2.0, "old": -1.0, "none": -1.0, "next": 3.0}


def test_a_planted_leak_is_seen(spark):
    from tidemark.plans.feature_queries import leak_planted

    assert all(r.violations == r.compared > 0 for r in leak_planted(spark, "/root/testdata/sf0.001").collect())


def test_latest_values(spark):
    rows = spark.createDataFrame([("card", "c", "a", 1, {"v": 1.0}), ("card", "c", "b", 5, {"v": 2.0}), ("card", "d", "c", 2, {"v": 3.0})], "entity string, entity_id string, event_id string, us bigint, features map<string,double>")
    assert {(r.entity_id, r.event_id) for r in fx.latest_values(rows).collect()} == {("c", "b"), ("d", "c")}
    assert {(r.entity_id, r.event_id) for r in fx.latest_values(rows, as_of=4, ttl=2).collect()} == {("d", "c")}
    assert fx.first_wins(rows.withColumn("x", F.lit(1)), "entity_id", ["us"]).count() == 2
