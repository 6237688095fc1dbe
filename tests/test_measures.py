"""Metrics, percentiles, drift, queue and operations against plain Python."""

from __future__ import annotations

import datetime as dt
import heapq
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import decide, drift, history, metrics, ops, ordered, queue

T0 = dt.datetime(2027, 9, 1, tzinfo=dt.UTC)


def test_percentiles_equal_numpy(spark):
    r = random.Random(1)
    rows = [(g, r.choice([0.0, -3.5, r.gauss(0, 100), 1e300, None])) for g in ("a", "b", None) for _ in range(200)] + [("c", None), ("d", float("nan"))]
    df = spark.createDataFrame(rows, "g string, v double")
    ps = [0.0, 0.1, 0.5, 0.77, 1.0]
    got = {x.g: (x.n, list(x.q)) for x in ordered.exact_percentiles(df, ["g"], "v", ps).collect()}
    assert set(got) == {"a", "b", None}
    for g, (n, q) in got.items():
        xs = [v for h, v in rows if h == g and v is not None]
        assert n == len(xs) and np.allclose(q, np.percentile(xs, [p * 100 for p in ps]))
    assert ordered.exact_percentiles(df.where("false"), [], "v", ps).count() == 0


def test_average_precision(spark):
    r = random.Random(2)
    rows = [(r.random() < 0.2, round(r.random(), 1), r.choice([None, 1.0, 10.0])) for _ in range(500)] + [(None, 0.5, 1.0), (True, None, 1.0)]
    df = spark.createDataFrame(rows, "y boolean, s double, w double")
    used = [(y, s, 1.0 if w is None else w) for y, s, w in rows if y is not None and s is not None]
    total, tp, seen, want = sum(w for y, _, w in used if y), 0.0, 0.0, 0.0
    for s in sorted({x[1] for x in used}, reverse=True):
        gain = sum(w for y, t, w in used if t == s and y)
        tp, seen = tp + gain, seen + sum(w for _, t, w in used if t == s)
        want += gain / total * tp / seen
    got = metrics.average_precision(df, "y", "s", "w").first()
    assert got.n_rows == 500 and abs(got.average_precision - want) < 1e-12
    assert metrics.average_precision(df.where("not y"), "y", "s", "w").first().average_precision == 0
    boot = metrics.bootstrap_precision(df, "y", ["s"], "w", 60, 3).toPandas()
    assert abs(boot.s.mean() - want) < 0.05 and boot.s.std() > 0
    again = metrics.bootstrap_precision(df.repartition(5), "y", ["s"], "w", 60, 3).toPandas()
    assert dict(zip(boot["resample"], boot["s"], strict=True)) == dict(zip(again["resample"], again["s"], strict=True))


def test_bootstrap_against_the_plain_one(spark):
    import numpy as np

    r = random.Random(12)
    rows = [(i, r.random() < 0.3, min(1.0, r.random() ** 2), r.random(), r.choice([1.0, 5.0]), r.randrange(100)) for i in range(400)]
    rows += [(1000 + i, i % 2 == 0, 0.5, 0.5, 1.0, 7) for i in range(60)]  # alike but for the label
    df = spark.createDataFrame(rows, "i int, y boolean, s double, t double, w double, v int")
    cells = {(x.s0, x.s1, x.y, x.w): (x.h, x.n) for x in metrics._cells(df, "y", ["s", "t"], "w").collect()}
    assert max(n for _, n in cells.values()) == 30
    keys = list(cells)
    draws = metrics._draws(np.array([cells[k][0] for k in keys], np.int64).view(np.uint64), np.array([cells[k][1] for k in keys]), 0, 40, 5)
    assert abs(draws.sum() / 40 / 460 - 1) < 0.05
    got = {x.resample: (x.s, x.t) for x in metrics.bootstrap_precision(df.repartition(3), "y", ["s", "t"], "w", 40, 5).collect()}
    for k in (0, 7, 39):
        for col in (0, 1):
            mass = {}
            for key, n in zip(keys, draws[:, k], strict=True):
                hit, every = mass.get(key[col], (0, 0))
                mass[key[col]] = (hit + n * key[3] * key[2], every + n * key[3])
            total, seen, tp, want = sum(h for h, _ in mass.values()), 0, 0, 0
            for score in sorted(mass, reverse=True):
                tp, seen = tp + mass[score][0], seen + mass[score][1]
                want += mass[score][0] / total * (tp / seen if seen else 0)
            assert abs(got[k][col] - want) < 1e-9
    whole = metrics.bootstrap_total(df, "y", ["s", "t"], "w", F.col("v"), 300, 5).toPandas()
    true = sum(w * v for *_, w, v in rows)
    spread = sum((w * v) ** 2 for *_, w, v in rows) ** 0.5
    assert abs(whole.total.mean() / true - 1) < 0.02 and abs(whole.total.std() / spread - 1) < 0.15
    assert metrics.bootstrap_precision(df.where("false"), "y", ["s", "t"], "w", 5).count() == 0


def test_gate(spark):
    r = random.Random(13)
    rows = []
    for _ in range(1500):
        y = r.random() < 0.1
        good, noise = (0.9 if y else 0.1) + r.uniform(-0.3, 0.09), r.random()
        rows.append((y, r.randrange(100, 9000), noise, good, 1.0))
    df = spark.createDataFrame(rows, "is_fraud boolean, amount_cents bigint, champion_score double, challenger_score double, weight double")
    better = metrics.promotion_gate(df, resamples=60).first()
    assert better.promote and better.reasons == "" and 0 < better.ap_low < better.challenger_ap - better.champion_ap < better.ap_high and better.cost_high < 0
    worse = metrics.promotion_gate(df.selectExpr("is_fraud", "amount_cents", "challenger_score AS champion_score", "champion_score AS challenger_score", "weight"), least_rows=2000, resamples=60).first()
    assert not worse.promote and worse.reasons == "too few rows; precision could be lower; decisions could cost more"


def test_ks_and_psi(spark):
    r = random.Random(3)
    ref = [round(r.gauss(0, 1), 2) for _ in range(700)] + [-1.0] * 40
    days = {dt.date(2027, 9, 1): [round(r.gauss(0, 1), 2) for _ in range(300)] + [-1.0] * 17, dt.date(2027, 9, 2): [round(r.gauss(1, 1), 2) for _ in range(300)], dt.date(2027, 9, 3): [5.0]}
    mk = lambda rows: spark.createDataFrame(rows, "day date, quantity string, value double")
    reference, current = mk([(dt.date(2027, 8, 1), "q", v) for v in ref]), mk([(d, "q", v) for d, vs in days.items() for v in vs])
    for row in drift.ks(reference, current).collect():
        grid = np.array(ref + days[row.day])
        f = lambda xs: np.searchsorted(np.sort(xs), grid, side="right") / len(xs)  # noqa: B023, E731
        assert abs(row.ks - np.max(np.abs(f(ref) - f(days[row.day])))) < 1e-12
    edges = drift.bin_edges(reference)
    inner = np.unique(np.percentile([v for v in ref if v != -1.0], range(10, 100, 10)))
    place = lambda v: len(inner) + 1 if v == -1.0 else int(np.searchsorted(inner, v, side="right"))
    for row in drift.psi(reference, current, edges).collect():
        share = lambda xs: np.maximum(np.bincount([place(v) for v in xs], minlength=len(inner) + 2) / len(xs), 1e-4)
        e, a = share(ref), share(days[row.day])
        assert abs(row.psi - np.sum((a - e) * np.log(a / e))) < 1e-9
    spine = spark.sql("SELECT explode(sequence(date'2027-09-01', date'2027-09-04')) AS day")
    status = {x.day.day: x.status for x in drift.judged(reference, current, spine, ["q"], 100).collect()}
    assert status == {1: "stable", 2: "drifted", 3: "insufficient", 4: "insufficient"}


def verdicts(spark, text):
    """One letter a day: d drifted, s stable, i insufficient; a gap for a day without a verdict."""
    name = {"d": "drifted", "s": "stable", "i": "insufficient"}
    rows = [(dt.date(2027, 9, 1) + dt.timedelta(days=k), q, name[c]) for q, line in text.items() for k, c in enumerate(line) if c != " "]
    return spark.createDataFrame(rows, "day date, quantity string, status string")


def test_trigger_and_what_follows(spark):
    v = verdicts(spark, {"a": "sddsdid dss", "b": "ssddsssssss"})
    assert {r.day.day: r.quantities for r in drift.triggers(v).collect()} == {3: ["a"], 4: ["b"]}
    q = spark.createDataFrame([("x", dt.date(2027, 9, 4), dt.date(2027, 9, 3), ["a", "b"]), ("y", dt.date(2027, 9, 10), dt.date(2027, 9, 9), ["a"])], "request string, opened_on date, evidence_day date, quantities array<string>")
    assert {r.request: r.began.day for r in drift.runs_of_any(v, q).collect()} == {"x": 2, "y": 9}
    ended = {r.request: r.ended_on for r in drift.resolutions(v, q).collect()}
    assert ended["x"].day == 11 and ended["y"] is None


def simulate(items, score, capacity, wait, recovery):
    """The queue, item by item."""
    items = sorted(items, key=lambda x: (x[1], x[0]))
    start = items[0][1] // queue.HOUR_US * queue.HOUR_US
    heap, at, reviewed, caught = [], 0, 0, 0.0
    for h in range(1, 25):
        end = start + h * queue.HOUR_US
        while at < len(items) and items[at][1] < end:
            heapq.heappush(heap, (-score(items[at]), at))
            at += 1
        done = 0
        while heap and done < capacity:
            i = heapq.heappop(heap)[1]
            if end - items[i][1] <= wait:
                done, reviewed = done + 1, reviewed + 1
                caught += items[i][2] * (1 - recovery) * items[i][3]
        heap = [e for e in heap if end - items[e[1]][1] <= wait]
        heapq.heapify(heap)
    return reviewed, round(caught, 6), len(items) - reviewed


@pytest.mark.parametrize("wait", [queue.HOUR_US, int(1.5 * queue.HOUR_US), 4 * queue.HOUR_US])
def test_queue_equals_the_plain_simulation(spark, wait):
    r = random.Random(6)
    day0 = 20_000 * 24 * queue.HOUR_US
    rows = [(f"e{i}", day0 + r.randrange(2) * 24 * queue.HOUR_US + r.choice([r.randrange(24 * 60) * 60_000_000, r.randrange(3) * queue.HOUR_US]), r.randrange(1, 500), r.random() < 0.3, round(r.random(), 1)) for i in range(400)]
    df = spark.createDataFrame(rows + [("null", None, 1, True, 0.1)], "event_id string, arrived_us bigint, amount_cents bigint, is_fraud boolean, p double")
    got = {(x.day, x.policy): (x.reviewed, round(x.caught_cents, 6), x.expired) for x in queue.simulate(df, {"p": F.col("p"), "loss": F.col("p") * F.col("amount_cents")}, 3, wait, 0.25).collect()}
    assert len(got) == 4
    for (day, policy), have in got.items():
        items = [x for x in rows if x[1] // (24 * queue.HOUR_US) == day]
        assert have == simulate(items, (lambda x: x[4]) if policy == "p" else (lambda x: x[4] * x[2]), 3, wait, 0.25)
    assert queue.simulate(df.where("false"), {"p": F.col("p")}, 3, wait, 0.25).count() == 0


MIN = "instance_id string, minute_at timestamp, decisions double, sent double, feed_lag double, buckets map<double,double>"


def test_minutes(spark):
    m = lambda k, n, sent=10.0, lag=0.1, b=None: ("i", T0 + dt.timedelta(minutes=k), n, sent, lag, b)
    inf = float("inf")
    rows = [m(0, 10.0, b={0.1: 4.0, inf: 10.0}), m(0, 10.0, b={0.1: 4.0, inf: 10.0}), m(1, None), m(4, 0.0), m(5, 10.0, b={0.2: 6.0, inf: 10.0}), m(6, 10.0, lag=None), m(7, float("nan")), m(8, 9.0), m(9, 9.0), ("j", T0, 1.0, 1.0, 0.0, {})]
    df = spark.createDataFrame(rows, MIN)
    full = ops.assembled(df)
    assert full.where("instance_id = 'i'").count() == 10 and full.where("instance_id = 'j'").count() == 1
    runs = sorted((r.first.minute, r.last.minute, r.minutes) for r in ops.idle_runs(full).collect())
    assert runs == [(1, 4, 4), (7, 7, 1)]
    notices = spark.createDataFrame([("i", T0 + dt.timedelta(seconds=50)), ("i", T0 + dt.timedelta(minutes=8))], "instance_id string, noticed_at timestamp")
    got = ops.recoveries(full, notices).collect()
    assert len(got) == 1 and got[0].end.minute == 8 and got[0].minutes_without_decisions == 5 and got[0].decided == 30
    merged = ops.merged_histograms(full, ["instance_id"])
    assert [(r.le, r["count"]) for r in merged.where("instance_id = 'i'").orderBy("le").collect()] == [(0.1, 4.0), (0.2, 10.0), (inf, 20.0)]
    q = ops.histogram_quantiles(merged, ["instance_id"], {"a": 0.1, "b": 0.35, "c": 0.9}).where("instance_id = 'i'").first()
    assert (q.a, round(q.b, 9), q.c) == (0.05, 0.15, 0.2)
    assert ops.assembled(df.where("false")).count() == 0


def test_decisions_and_draws(spark):
    df = spark.createDataFrame([(0.95, 1), (0.5, 1), (0.1, 500_000), (0.1, 1), (None, 1), (0.1, None)], "s double, a bigint")
    got = [tuple(r.d) if r.d else None for r in df.select(decide.Rules().decide(F.col("s"), F.col("a")).alias("d")).collect()]
    assert got == [("decline", "score-decline"), ("review", "score-review"), ("review", "large-amount-review"), ("approve", "default-approve"), None, ("approve", "default-approve")]
    with pytest.raises(ValueError):
        decide.Rules(0.4, 0.5)
    drawn = np.array([r[0] for r in spark.range(4000).select(decide.draw(F.col("id"), "x")).collect()])
    assert abs(drawn.mean() - 0.5) < 0.02 and drawn.min() >= 0 and drawn.max() < 1
    model = decide.batch_model(lambda x: x.sum(axis=1) / 10, ["f"])
    out = decide.decided(spark.createDataFrame([(3.0, 4)], "f double, amount_cents bigint"), ["f"], "amount_cents", model, "m").first()
    assert abs(out.champion_score - 0.7) < 1e-12 and out.action == "review"


def test_the_kept_sample_stands_for_the_day(spark):
    r = random.Random(8)
    staged = spark.createDataFrame([(f"e{i}", T0, r.choice(["approve"] * 9 + ["review"])) for i in range(20_000)], "event_id string, decided_at timestamp, action string")
    labels = staged.select("event_id", F.lit(T0).alias("label_time"), (F.rand(1) < 0.05).alias("is_fraud"), F.lit(0).cast("long").alias("recovered_cents"))
    kept = history.kept_sample(staged, labels, {"acted": 1.0, "fraud": 0.5, "legit": 0.1})
    assert abs(kept.agg(F.sum("weight")).first()[0] / 20_000 - 1) < 0.05


def test_minutes_from_documents_and_availability(spark):
    import json

    t = int(T0.timestamp())
    doc = lambda *series: json.dumps({"data": {"result": [{"metric": m, "values": v} for m, v in series]}})
    rows = [("decisions", doc(({}, [[t, "5"], [t + 60, "NaN"], [t + 120, "7"]]))), ("sent", doc(({}, [[t, "5"], [t + 120, "x"]]))), ("buckets", doc(({"le": "0.1"}, [[t, "2"]]), ({"le": "+Inf"}, [[t, "5"], [t + 120, "7"]])))]
    got = ops.minutes_of_ranges(spark.createDataFrame(rows, "name string, json string"), "i")
    full = {r.at.minute: r for r in ops.assembled(got).collect()}
    assert len(full) == 3 and full[0].buckets == {0.1: 2.0, float("inf"): 5.0} and full[1].decisions == 0 and full[2].sent == 0
    w = spark.createDataFrame([("i", T0, T0 + dt.timedelta(minutes=1))], "instance_id string, start timestamp, end timestamp")
    assert sorted(r.at.minute for r in ops.serving(ops.assembled(got), w).collect()) == [1, 2]


def test_parity(spark):
    from tidemark.operators import registry

    a = spark.createDataFrame([("x", 1.0, None), ("y", 2.0, "s"), ("only", 1.0, "s")], "k string, v double, t string")
    b = spark.createDataFrame([("x", 1.0, None), ("y", 2.5, "s"), ("z", 1.0, "s")], "k string, v double, t string")
    got = {(r.k, r.column) for r in registry.disagreements(a, b, "k", ["v", "t"]).collect()}
    assert got == {("y", "v"), ("only", "(row)"), ("z", "(row)")}
    p = registry.parity(a, b, "k", ["v", "t"], tolerance=0.6).first()
    assert (p.compared, p.rows_differing, p.parity) == (4, 2, 0.5)
