from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tidemark.llm import sample as s

SCHEMA = "id string, stratum string, weight double, day int, sample_note string, tags map<string,int>"
RATES = {"a": 0.5, "b": 0.1}


def rows(n=3000, seed=1):
    rnd = random.Random(seed)
    return [(f"e{rnd.randrange(n)}", rnd.choice(["a", "b", "c", None]), rnd.choice([None, 2.0]), i // 1000, "x", {"k": 1}) for i in range(n)] + [(None, "a", 1.0, 0, "x", None)]


def held(spark, data, parts=3, rates=RATES):
    df = spark.createDataFrame(data, SCHEMA).repartition(parts)
    return s.stable_sample(df, "id", F.col("stratum"), rates, 0.02, "weight")


def brute(data, rates=RATES):
    import hashlib

    reach = {}
    for r in data:
        if r[0] is not None:
            reach[r[0]] = max(reach.get(r[0], 0), s.held_buckets(rates.get(r[1], 0.02)))
    where = lambda k: (int(hashlib.sha256(f"tidemark/sample/1{k}".encode()).hexdigest()[:4], 16) * s.STEP + s.START) % s.BUCKETS
    return {k for k, n in reach.items() if where(k) < n}


def test_brute_force_whole_events_any_partitioning(spark):
    data = rows()
    want = brute(data)
    for n in (1, 6):
        got = held(spark, data, n).collect()
        assert {r.id for r in got} == want
        assert len(got) == sum(r[0] in want for r in data)
        assert all((r.sample_weight is None) == (r.weight is None) for r in got)


def test_grows_with_data_and_rate(spark):
    data = rows()
    first = {r.id for r in held(spark, [r for r in data if r[3] == 0]).collect()}
    both = {r.id for r in held(spark, [r for r in data if r[3] <= 1]).collect()}
    every = {r.id for r in held(spark, data).collect()}
    more = {r.id for r in held(spark, data, rates={"a": 0.6, "b": 0.2}).collect()}
    assert first <= both <= every <= more and first and len(more) > len(every)


def test_buckets_are_a_permutation():
    assert sorted(s.bucket_list(1.0)) == list(range(s.BUCKETS))
    assert s.bucket_list(0.3)[: len(s.bucket_list(0.1))] == s.bucket_list(0.1)
    with pytest.raises(ValueError):
        s.held_buckets(1.1)


def test_weights_estimate_the_whole(spark):
    data = [(f"k{i}", "a" if i % 2 else "b", 3.0, 0, "", None) for i in range(20_000)]
    total = held(spark, data).agg(F.sum("sample_weight")).first()[0]
    assert abs(total / 60_000 - 1) < 0.06


def test_hot_key_and_repeated_rows(spark):
    data = [("hot", "a" if i == 0 else "c", 1.0, 0, "", None) for i in range(2000)] + [(f"k{i}", "c", 1.0, 0, "", None) for i in range(50)]
    n = held(spark, data).where("id = 'hot'").count()
    assert n == (2000 if "hot" in brute(data) else 0)


def test_a_tiny_rate_holds_something():
    assert s.held_buckets(5e-6) == 1 and s.held_buckets(0) == 0 and s.held_buckets(1) == s.BUCKETS
