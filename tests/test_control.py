"""Requests, candidates, replays, gates, alerts, merged streams and their state."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tests.test_measures import verdicts
from tidemark.operators import control
from tidemark.session import scratch_path

D0 = dt.date(2027, 9, 1)


def day(k):
    return D0 + dt.timedelta(days=k)


def days(spark, *ks):
    return spark.createDataFrame([(day(k),) for k in ks] + [(None,)], "day date")


def test_first_trigger_is_asked_day_by_day(spark):
    got = control.first_trigger(verdicts(spark, {"a": "sddsdd", "b": "ssddss"})).first()
    assert (got.day, got.quantities, got.days_judged) == (day(2), ["a"], 3)
    assert control.first_trigger(verdicts(spark, {"a": "sdsds"})).count() == 0


def test_recent_days_and_head(spark):
    assert [r.day for r in control.recent_days(days(spark, 1, 1, 2, 3), 2).collect()] == [day(3), day(2)]
    rows = spark.createDataFrame([(1, "b"), (1, "a"), (0, "c")], "n int, s string")
    assert [r.s for r in control.head(rows, [F.desc("n"), "s"], 2).collect()] == ["a", "b"]


def test_candidates(spark):
    def due(finalised, began=None, last=None):
        r = spark.createDataFrame([("x", None if began is None else day(began))], "request string, drift_began date")
        c = spark.createDataFrame([] if last is None else [("x", day(last)), ("x", day(0)), ("y", day(90))], "request string, last_day date")
        got = control.candidates_due(r, days(spark, *finalised), c).first()
        return None if got is None else [(x - D0).days for x in got.days]

    assert due([1, 2]) is None and due([1, 2, 3]) == [1, 2, 3]
    assert due([1, 2, 3, 4], began=3) is None and due([1, 2, 3, 4, 5], began=3) == [1, 2, 3, 4, 5]
    assert due([1, 2, 3, 4], last=2) is None and due([1, 2, 3, 4, 5], last=2) == [1, 2, 3, 4, 5]
    assert due(range(20)) == list(range(6, 20))


def test_replays_and_gates(spark):
    c = spark.createDataFrame([("a", day(3)), ("b", day(4)), ("c", day(1))], "version string, last_day date")
    got = control.replays_due(c, days(spark, 4, 5), spark.createDataFrame([("c",)], "version string")).collect()
    assert [(r.version, r.days) for r in got] == [("a", [day(4), day(5)])]
    s = spark.createDataFrame([("few", 6, True), ("first", 7, False), ("again", 9, True), ("no", 9, False), ("was", 9, True)], "version string, days_scored int, eligible_now boolean")
    v = spark.createDataFrame([("again", False), ("no", False), ("was", False), ("was", True)], "version string, eligible boolean")
    assert {r.version for r in control.gates_due(s, v).collect()} == {"first", "again"}


def test_coverage_and_states(spark):
    r = spark.createDataFrame([("x", day(3), day(5)), ("y", day(5), day(3)), ("hand", None, day(3))], "request string, first_drifted date, last_trained date")
    assert {x.request: (x.covers_the_drift, x.days_short) for x in control.drift_coverage(r).collect()} == {"x": (True, 0), "y": (False, 2), "hand": (None, None)}
    q = spark.createDataFrame([("clean", day(0), ["a"]), ("both", day(0), ["a", "b"]), ("late", day(4), ["a"]), ("hand", day(0), []), ("beat", day(4), ["b"])], "request string, opened_on date, quantities array<string>")
    state = lambda text: {x.request: x.state for x in control.request_states(q, verdicts(spark, text), spark.createDataFrame([("beat",)], "request string")).collect()}
    assert state({"a": "dddsss", "b": "dddsid"}) == {"clean": "drift-ended", "both": "still-open", "late": "still-open", "hand": "still-open", "beat": "answered"}
    assert state({"a": "ddds s", "b": "ddds s"})["clean"] == "still-open"


def test_alerts(spark):
    h = 3_600_000_000
    polls = [("x", k * h, 2 <= k <= 15 or k == 20) for k in range(22)] + [("y", 0, True), ("z", 0, False)]
    got = {(r.alert, r.us // h, r.message) for r in control.alert_messages(spark.createDataFrame(polls, "alert string, us bigint, firing boolean")).collect()}
    assert got == {("x", 2, "fire"), ("x", 8, "remind"), ("x", 14, "remind"), ("x", 16, "resolve"), ("x", 20, "fire"), ("x", 21, "resolve"), ("y", 0, "fire")}


def test_merged_streams_and_stale_queries(spark):
    rnd = random.Random(9)
    mk = lambda n: [(f"e{i}", dt.datetime(2027, 9, 1) + dt.timedelta(minutes=rnd.randrange(300))) for i in range(n)] + [("none", None)]
    a, b = mk(40), mk(30)
    schema = "id string, t timestamp"
    got = control.merged_streams({"a": spark.createDataFrame(a, schema), "b": spark.createDataFrame(b, schema)}, "t", ["id"]).orderBy("seq").collect()
    want = sorted([(t, s, i) for s, rows in (("a", a), ("b", b)) for i, t in rows if t is not None])
    assert [(r.t, r.stream, r.id) for r in got] == want and [r.seq for r in got] == list(range(70))
    asked = spark.createDataFrame([(5,), (9,)], "at bigint")
    assert control.refuse_stale(asked, "at", 5).count() == 2 and [r.at for r in control.refuse_stale(asked, "at", 5).collect()] == [5, 9]
    with pytest.raises(Exception, match="asked for the past"):
        control.refuse_stale(asked, "at", 6).collect()


def test_load_summary(spark):
    rows = spark.createDataFrame([(r, "hop", float(v + r)) for r in range(3) for v in range(101)] + [(0, "once", 1.0), (0, "once", None)], "run int, kind string, ms double")
    got = {(r.kind, r.quantile): (r.n, r.mean, r.low) for r in control.load_summary(rows, "run", "kind", "ms", {"p50": 0.5}).collect()}
    assert got["hop", "p50"][:2] == (3, 51.0) and abs(got["hop", "p50"][2] - (51 - 4.303 / 3**0.5)) < 1e-9
    assert got["once", "p50"] == (1, 1.0, None)


def test_watch_judges_each_day_once_and_opens_one_request_at_a_time(spark):
    state = control.StateTables(spark, scratch_path(spark, "state"))
    assert state.read("days") is None and state.latest("days", ["day"], "status") is None
    text = "sddsdddss"
    opened = []
    for k in range(1, len(text) + 1):
        v = verdicts(spark, {"a": text[:k]})
        opened += [(k, r.request) for r in control.watch(state, v, f"{k:03d}").collect()]
        again = control.watch(state, v, f"{k:03d}b")
        assert again.count() == 0
    assert state.read("days").count() == len(text)
    assert opened == [(3, "2027-09-03")]  # open until two clean days, the last two here
    more = verdicts(spark, {"a": text + "sdd"})
    assert [r.request for r in control.watch(state, more, "999").collect()] in (["2027-09-12"], [])
    state.append("models", "1", spark.createDataFrame([("m", 1, "old")], "version string, at int, verdict string"))
    state.append("models", "2", spark.createDataFrame([("m", 2, "new")], "version string, at int, verdict string"))
    assert [(r.version, r.verdict) for r in state.latest("models", ["version"], "at").collect()] == [("m", "new")]


def test_clock_fault_and_mean_attack(spark):
    from tidemark.sources import generator

    rows = spark.createDataFrame([(f"e{i}", dt.datetime(2027, 9, 1)) for i in range(400)], "id string, t timestamp")
    got = generator.shifted_clock(rows, "t", "id", -3_600_000_000, 0.25, 3).groupBy("t").count().collect()
    assert {r.t: 60 < r["count"] < 140 for r in got} == {dt.datetime(2027, 8, 31, 23): True, dt.datetime(2027, 9, 1): False}
    assert generator.mean_attack({"a": 1, "b": 3}, {"a": 4, "b": 8}, {"a": 10, "b": 2}, 2.0) == (14.0, 44.0)
    with pytest.raises(ValueError):
        generator.mean_attack({"a": 0}, {"a": 1}, {"a": 1})
