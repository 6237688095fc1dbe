from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from tidemark.llm import quantiles as q

INF = float("inf")
QS = {"lo": 0.01, "mid": 0.5, "hi": 0.99, "top": 1.0, "least": 0.0}


def rank_value(xs, share):
    return sorted(xs)[math.floor(share * (len(xs) - 1))]


def test_error_bound_and_merge(spark):
    rnd = random.Random(1)
    rows = [(g, p, rnd.choice([-1, 1]) * rnd.lognormvariate(0, 6)) for g in ("a", "b", None) for p in range(4) for _ in range(400)] + [("a", 0, 0.0)] * 30
    df = spark.createDataFrame(rows, "g string, p int, v double")
    whole = {r.g: r for r in q.percentiles(q.sketch(df, ["g"], "v"), ["g"], QS).collect()}
    parts = q.sketch(df.where("p = 0"), ["g"], "v")
    for p in range(1, 4):
        parts = parts.unionByName(q.sketch(df.where(f"p = {p}"), ["g"], "v"))
    merged = {r.g: r for r in q.percentiles(q.merge(parts, ["g"]), ["g"], QS).collect()}
    assert whole == merged
    for g, r in whole.items():
        xs = [x for h, _, x in rows if h == g]
        assert r.n == len(xs)
        for name, share in QS.items():
            want = rank_value(xs, share)
            assert abs(r[name] - want) <= q.ALPHA * abs(want) * (1 + 1e-9)


def test_odd_values(spark):
    df = spark.createDataFrame([("n", None), ("n", float("nan")), ("i", INF), ("i", -INF), ("z", 0.0), ("z", -0.0), ("t", 5e-324), ("t", 1.7e308)], "g string, v double")
    got = {r.g: r for r in q.percentiles(q.sketch(df, ["g"], "v"), ["g"], {"a": 0.0, "b": 1.0}).collect()}
    assert "n" not in got and (got["i"].a, got["i"].b) == (-INF, INF) and (got["z"].a, got["z"].b) == (0.0, 0.0)
    assert got["t"].a >= 0 and abs(got["t"].b / 1.7e308 - 1) < 0.011
    with pytest.raises(ValueError):
        q.bucket(F.lit(1.0), 1.5)


def test_histogram_intervals(spark):
    rows = [
        ("plain", 10.0, {0.1: 2.0, 0.5: 7.0, INF: 10.0}),
        ("no_inf", 10.0, {0.1: 2.0, 0.5: 7.0}),
        ("no_inf_no_total", float("nan"), {0.1: 2.0, 0.5: 7.0}),
        ("falls", None, {0.1: 5.0, 0.5: 3.0, 1.0: 6.0}),
        ("empty", 3.0, {}),
        ("null", 3.0, None),
    ]
    df = spark.createDataFrame(rows, "k string, total double, b map<double,double>")
    got = {}
    for r in q.histogram_intervals(df, ["k"], "b", "total").collect():
        got.setdefault(r.k, set()).add((r.lower, r.upper, r.n))
    assert got["plain"] == got["no_inf"] == {(0.0, 0.1, 2), (0.1, 0.5, 5), (0.5, INF, 3)}
    assert got["no_inf_no_total"] == {(0.0, 0.1, 2), (0.1, 0.5, 5)}
    assert got["falls"] == {(0.0, 0.1, 5), (0.5, 1.0, 1)}
    # Three observations whose bounds start at infinity are known to be above 0, no more.
    assert "null" not in got and got.get("empty", set()) <= {(0.0, INF, 3)}


def test_latency_bracket(spark):
    from tidemark.llm.catalog import p2_latency

    got = p2_latency(spark, "/root/testdata/sf0.001").collect()
    assert got and all(r.p50_low <= r.p50 <= r.p50_high and r.p50_low <= r.p95_low and r.p95_high <= r.p99_high for r in got)
    alls = [r for r in got if r.instance_id == "(all)" and r.day == "(all)"]
    assert len(alls) == 1 and alls[0].n == sum(r.n for r in got if r.instance_id != "(all)" and r.day != "(all)")
