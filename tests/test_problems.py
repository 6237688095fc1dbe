"""Problems 1, 4, 5 and 6: brute force, nulls, ties, copies, empty tables, clashing names, reruns."""

from __future__ import annotations

import datetime as dt
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tidemark.functions.times import DAY, HOUR, MINUTE
from tidemark.operators import dedupe, entity_vectors, late_views, rolling
from tidemark.plans import problems
from tidemark.session import scratch_path

T0 = dt.datetime(2027, 9, 1, tzinfo=dt.UTC)
LOG = "event_id string, t timestamp, a timestamp, amount bigint"
POLICY = late_views.LatePolicy(period=HOUR, grace=10 * MINUTE, cutoff=24 * HOUR)


def at(**k):
    return T0 + dt.timedelta(**k)


def log(spark, rows):
    return spark.createDataFrame(rows, LOG)


def measures():
    return {"n": F.lit(1).cast("long"), "total": F.col("amount")}


def test_limits_belong_to_the_period(spark):
    rows = [("a", at(), at(hours=1, minutes=10), 1), ("b", at(), at(hours=1, minutes=10, microseconds=1), 2), ("c", at(), at(hours=25), 4), ("d", at(), at(hours=25, microseconds=1), 8)]
    got = {r.event_id: r.outcome for r in late_views.late_outcomes(log(spark, rows), POLICY, "t", "a").collect()}
    assert got == {"b": "corrected", "c": "corrected", "d": "refused"}
    v = late_views.final_views(log(spark, rows), POLICY, "t", "a", measures()).first()
    assert (v.n, v.total, v.provisional_n, v.n_corrections, v.n_refused) == (3, 7, 1, 2, 1)


def test_late_views_take_nulls_and_early_arrivals(spark):
    rows = [("a", None, at(), 1), ("b", at(), None, 1), ("c", at(hours=5), at(), None), (None, at(hours=5), at(hours=5), 3)]
    v = late_views.final_views(log(spark, rows), POLICY, "t", "a", measures()).collect()
    assert [(r.n, r.total, r.n_refused) for r in v] == [(2, 3, 0)]
    assert late_views.final_views(log(spark, []), POLICY, "t", "a", measures()).count() == 0


def test_earliest_arrivals_keeps_rows_without_key(spark):
    rows = [("a", at(), at(hours=2), 1), ("a", at(), at(hours=1), 1), (None, at(), at(), 5), (None, at(), at(), 5)]
    got = late_views.earliest_arrivals(log(spark, rows), "event_id", "a", ["t", "amount"])
    assert got.count() == 3 and got.where("event_id = 'a'").agg(F.hour(F.max("a"))).first()[0] == 1


def test_versions_end_at_the_final_view(spark):
    rnd = random.Random(3)
    rows = [(f"e{i}", at(minutes=rnd.randrange(300)), at(minutes=rnd.randrange(2400)), rnd.randrange(100)) for i in range(300)]
    df = log(spark, rows)
    final = {r["__start"]: (r.n, r.total) for r in late_views.final_views(df, POLICY, "t", "a", measures()).collect() if r.n}
    frozen = {r["__start"]: (r.n, r.total) for r in late_views.view_versions(df, POLICY, "t", "a", measures()).where("frozen").collect()}
    assert frozen == final


def us(moment):
    return round((moment - dt.datetime(1970, 1, 1, tzinfo=dt.UTC)).total_seconds() * 1e6)


def lambda_view(spark, policy=POLICY):
    return late_views.LambdaView(spark, scratch_path(spark, "lambda"), policy, "t", "a", measures())


def served(view):
    return {r["__start"]: (r.n, r.total) for r in view.view().collect() if r.n}


def test_a_run_off_the_schedule_counts_once(spark):
    for grace, at_run in ((10 * MINUTE, 1), (2 * HOUR, 1)):
        view = lambda_view(spark, late_views.LatePolicy(period=HOUR, grace=grace, cutoff=24 * HOUR))
        view.add(1, log(spark, [("a", at(hours=9, minutes=30), at(hours=10, minutes=15), 5)]))
        view.recompute(us(at(hours=10, minutes=30)))
        assert served(view) == {us(at(hours=9)): (at_run, 5)}
        view.recompute(us(at(hours=13, minutes=7)))
        assert served(view) == {us(at(hours=9)): (1, 5)}


def test_layers_on_storage_agree_with_the_log(spark):
    rnd = random.Random(4)
    rows = sorted([(f"e{i}", at(minutes=rnd.randrange(600)), at(minutes=rnd.randrange(2700)), rnd.randrange(100)) for i in range(200)], key=lambda r: r[2])
    view, closed = lambda_view(spark), lambda upto: {
        r["__start"]: (r.n, r.total) for r in late_views.final_views(log(spark, [x for x in rows if x[2] <= upto]), POLICY, "t", "a", measures()).collect() if r.n
    }
    for day in range(3):
        due = [r for r in rows if day * 15 * 60 <= (r[2] - T0).total_seconds() / 60 < (day + 1) * 15 * 60]
        view.add(day, log(spark, due))
        view.add(day, log(spark, due))  # delivered again: not taken in again
        moment = at(hours=(day + 1) * 15, minutes=17 * day - 20)
        view.recompute(us(moment))
        view.recompute(us(moment))
        early = {s for s, in view.view().where("not frozen").select("__start").collect() if s + HOUR + POLICY.grace >= us(moment)}
        want = closed(moment)
        assert {s: v for s, v in served(view).items() if s not in early} == {s: v for s, v in want.items() if s + HOUR + POLICY.grace < us(moment)}
    view.recompute(us(at(hours=60)))
    want = closed(at(hours=60))
    assert served(view) == want and view.view().where("not frozen").count() == 0
    view.add(9, log(spark, [("late", at(), at(minutes=5), 1000)]))  # to a frozen period: refused
    view.recompute(us(at(hours=61)))
    assert served(view) == want and "late" in {r.event_id for r in view.refused().collect()}
    with pytest.raises(ValueError):
        view.recompute(us(at(hours=59)))
    outcomes = {(r.event_id, r.outcome) for r in late_views.late_outcomes(log(spark, rows), POLICY, "t", "a").collect()}
    assert outcomes == {(r.event_id, "corrected") for r in view.corrections().collect()} | {(r.event_id, "refused") for r in view.refused().collect() if r.event_id != "late"}
    fast = spark.read.parquet(f"{view.root}/fast").groupBy("__start").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    assert {r["__start"]: (r.n, r.total) for r in fast.collect()} == {r["__start"]: (r.provisional_n, r.provisional_total) for r in view.frozen().collect() if r.provisional_n}


def test_replay_of_nothing_and_of_odd_rows(spark):
    empty = late_views.replay(lambda_view(spark), log(spark, []), DAY)
    assert empty.view().count() == empty.corrections().count() == empty.refused().count() == 0
    odd = late_views.replay(lambda_view(spark), log(spark, [("a", None, at(), 1), ("b", at(), None, 1), ("c", at(hours=5), at(), None), ("d", at(), at(days=9), 3)]), DAY)
    assert served(odd) == {us(at(hours=5)): (1, 0)} and [r.event_id for r in odd.refused().collect()] == ["d"]


def test_policy_is_checked():
    with pytest.raises(ValueError):
        late_views.LatePolicy(period=HOUR, grace=2, cutoff=1)


ACT = "card string, t timestamp, cents bigint, n int, total string"


def test_rolling_against_brute_force(spark):
    rnd = random.Random(5)
    rows = [(rnd.choice(["x", "y", None]), at(days=rnd.randrange(40), minutes=rnd.randrange(1440)), rnd.choice([None, 5, 7]), 1, "clash") for _ in range(150)]
    got = {(r.card, r.day_no): (r.n_7, r.total_7, r.n_3, r.total_3, round(r.mean_3, 9)) for r in rolling.rolling_totals(spark.createDataFrame(rows, ACT), "card", "t", "cents", "2027-10-20", (3, 7)).collect()}
    base = (T0.date() - dt.date(1970, 1, 1)).days
    per = defaultdict(list)
    for c, t, a, *_ in rows:
        per[c].append(((t.date() - dt.date(1970, 1, 1)).days, a or 0))
    want = {}
    for c, ev in per.items():
        for d in range(min(x for x, _ in ev), base + 50):
            s7, s3 = [a for x, a in ev if d - 7 < x <= d], [a for x, a in ev if d - 3 < x <= d]
            want[c, d] = (len(s7), sum(s7), len(s3), sum(s3), round(sum(s3) / 3, 9))
    assert got == want


def test_rolling_edges(spark):
    empty = spark.createDataFrame([], ACT)
    assert rolling.rolling_totals(empty, "card", "t", "cents", "2027-10-20").count() == 0
    only = spark.createDataFrame([("x", None, 1, 1, ""), ("x", at(days=90), 1, 1, ""), ("x", at(), 1, 1, "")], ACT)
    assert rolling.rolling_totals(only, "card", "t", "cents", "2027-09-02").count() == 2
    with pytest.raises(ValueError):
        rolling.rolling_totals(empty, "card", "t", "cents", "2027-10-20", (0,))


EV = "card string, kind string, t timestamp, cents bigint, idx int, vector string"


def events(spark, seed=6):
    rnd = random.Random(seed)
    return [(rnd.choice(["x", "y", None]), rnd.choice(["p", "q", "", None]), rnd.choice([at(minutes=rnd.randrange(500)), None]), rnd.choice([None, 3, 4]), 0, "clash") for _ in range(120)]


def vector_store(spark, *batches):
    store = entity_vectors.VectorStore(spark, scratch_path(spark, "vectors"), "card", "kind", "t", "cents")
    for i, rows in enumerate(batches):
        store.add(i, spark.createDataFrame(rows, EV))
    return store


def named(store, before=None):
    types = store.types
    return {(r.card, types[r.idx]): (r.n, r.total, r.last) for r in entity_vectors.vector_entries(store.merged(before), "card").collect()}


def test_vectors_merge_and_expand(spark):
    rows = events(spark)
    whole, parts = vector_store(spark, rows), vector_store(spark, rows[::3], rows[1::3], rows[2::3])
    parts.add(1, spark.createDataFrame(rows, EV))  # taken in before: changes nothing
    assert whole.types == sorted({r[1] if r[1] is not None else entity_vectors.NULL_TYPE for r in rows if r[2] is not None}, key=str.encode)
    assert named(whole) == named(parts)
    wide = {r.card: r for r in entity_vectors.expand(whole.merged(), "card", whole.types, F.lit(at(days=1))).collect()}
    for card in ("x", "y", None):
        for t in whole.types:
            own = [r for r in rows if r[0] == card and (r[1] if r[1] is not None else entity_vectors.NULL_TYPE) == t and r[2] is not None]
            assert wide[card][f"n_{t}"] == len(own) and wide[card][f"total_{t}"] == sum(r[3] or 0 for r in own)
            idle = wide[card][f"idle_us_{t}"]
            assert idle == (round((at(days=1) - max(r[2] for r in own)).total_seconds() * 1e6) if own else None)


def test_a_type_of_the_second_day_moves_no_index(spark):
    store = vector_store(spark, [("x", "m", at(hours=1), 5, 0, ""), ("x", "z", at(hours=2), 1, 0, "")])
    first = store.types
    store.add(1, spark.createDataFrame([("x", "a", at(days=1), 7, 0, ""), ("x", "m", at(days=1, hours=3), 5, 0, "")], EV))
    assert first == ["m", "z"] and store.types == ["m", "z", "a"]
    assert {k: v[:2] for k, v in named(store).items()} == {("x", "m"): (2, 10), ("x", "z"): (1, 1), ("x", "a"): (1, 7)}
    assert {k: v[:2] for k, v in named(store, "2027-09-02").items()} == {("x", "m"): (1, 5), ("x", "z"): (1, 1)}
    wide = entity_vectors.expand(store.merged(), "card", [*store.types, "never"], F.lit(at(days=2))).first()
    assert (wide.n_m, wide.n_z, wide.n_a, wide.n_never, wide.idle_us_never) == (2, 1, 1, 0, None)


def test_vectors_refuse_an_unknown_type_and_take_nothing(spark):
    store = vector_store(spark, events(spark))
    entries = spark.createDataFrame([("x", "unheard of", 1, 1, at())], "card string, name string, n bigint, total bigint, last timestamp")
    with pytest.raises(Exception, match="type without an index"):
        entity_vectors.entity_vectors(entries, store.dictionary(), ["card"]).collect()
    empty = vector_store(spark, [])
    assert empty.types == [] and empty.merged().count() == 0
    assert entity_vectors.expand(empty.merged(), "card", [], F.current_timestamp()).columns == ["card"]


MSG = "id string, a timestamp, x int, shard int, key string"


def test_dedupe_one_row_each_whatever_the_partitioning(spark):
    rnd = random.Random(7)
    rows = [(rnd.choice([None, "", *map(str, range(40))]), rnd.choice([None, at(), at(minutes=1)]), rnd.randrange(3), 1, "k") for _ in range(300)]
    want = {}
    for r in rows:
        k = (r[1] is None, r[1] or T0, r[2])
        if r[0] is not None and (r[0] not in want or k < want[r[0]][0]):
            want[r[0]] = (k, r)
    for n in (1, 7):
        df = spark.createDataFrame(rows, MSG).repartition(n)
        kept = seen_store(spark).take(df, "id", "a", ["x"]).collect()
        assert {r.id: (r.a, r.x) for r in kept if r.id is not None} == {k: (v[1][1].replace(tzinfo=None) if v[1][1] else None, v[1][2]) for k, v in want.items()}
        assert sum(r.id is None for r in kept) == sum(r[0] is None for r in rows)


def messages(spark, *rows):
    return spark.createDataFrame([(i, a, 0, 0, "") for i, a in rows], MSG)


def seen_store(spark, root=None):
    return dedupe.SeenStore(spark, root or scratch_path(spark, "seen"), per_shard=20)


def test_dedupe_across_deliveries(spark):
    store, mk = seen_store(spark), lambda *rows: messages(spark, *rows)
    assert store.take(mk(*[(f"m{i}", at()) for i in range(50)], ("z", at(hours=2))), "id", "a", delivery_id="one").count() == 51
    second = store.take(mk(("m1", at(hours=1)), ("z", at(hours=1)), ("new", at()), ("new", None), (None, at())), "id", "a", delivery_id="two").collect()
    assert {(r.id, r["__change"]) for r in second} == {("z", "replace"), ("new", "new"), (None, "new")}
    assert store.seen_count() == 52
    again = store.take(mk(("never looked at", at())), "id", "a", delivery_id="two").collect()
    assert sorted(map(str, again)) == sorted(map(str, second)) and store.seen_count() == 52
    assert store.take(mk(("z", at(hours=1)), ("new", at(hours=5))), "id", "a").count() == 0
    assert store.take(mk(), "id", "a").count() == 0
    words = store.dictionary().groupBy("shard", "version", "code").count().where("count > 1").count()
    assert words == 0 and store.dictionary().count() == 52 and store.dictionary().select("shard").distinct().count() == 3
    other = seen_store(spark, store.root)
    assert other.take(mk(("m7", at())), "id", "a").count() == 0
    view = {r.id: (r.a, r["__copies"]) for r in store.view("id", "a").collect()}
    plain = lambda **k: at(**k).replace(tzinfo=None)
    assert len(view) == 53 and view["z"] == (plain(hours=1), 3) and view["new"] == (plain(), 3) and view["m7"] == (plain(), 2) and view["m2"] == (plain(), 1)


def test_dedupe_replays_like_one_delivery_and_merges_its_deltas(spark):
    rnd = random.Random(8)
    rows = [(rnd.choice([None, *map(str, range(90))]), rnd.choice([None, *[at(minutes=m) for m in range(6)]]), rnd.randrange(3), rnd.choice([None, *range(30)]), "k") for _ in range(600)]
    df = spark.createDataFrame(rows, MSG)
    store = dedupe.replay(seen_store(spark), df, "shard", 12, "id", "a", ["shard", "x"])
    got = {r.id: (r.a, r.shard, r["__copies"]) for r in store.view("id", "a").collect() if r.id is not None}
    want = {}
    for i in {r[0] for r in rows} - {None}:
        own = [r for r in rows if r[0] == i]
        best = min(own, key=lambda r: (r[1] is None, r[1] or T0, r[3] is not None, r[3] or 0))
        want[i] = (best[1].replace(tzinfo=None) if best[1] else None, best[3], len(own))
    assert got == want and store.seen_count() == len(want)
    assert store.view("id", "a").where("id IS NULL").count() == sum(r[0] is None for r in rows)
    assert any(p.startswith("merged") for p in store._state()["dictionary"])


def test_the_bit_decides_where_a_run_died_before_it_was_published(spark):
    store = seen_store(spark)
    store.take(messages(spark, ("a", at())), "id", "a", delivery_id="1")
    before = store._state()
    store.take(messages(spark, ("b", at()), ("a", at(hours=1))), "id", "a", delivery_id="2")
    after = store._state()
    # As if only the codes had been published: the dictionary knows b, its bit is not set.
    store._publish(after | {"deliveries": before["deliveries"], "bits": before["bits"]})
    again = store.take(messages(spark, ("b", at()), ("a", at(hours=1))), "id", "a", delivery_id="2").collect()
    assert [(r.id, r["__change"]) for r in again] == [("b", "new")]
    assert store.seen_count() == 2 and {r.id: r["__copies"] for r in store.view("id", "a").collect()} == {"a": 2, "b": 1}


def test_problem_queries_are_the_same_in_other_partitions(spark, tmp_path):
    d = str(tmp_path)
    for t in ("staged_decisions", "label_spool"):
        spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet").repartition(5).write.parquet(f"{d}/{t}.parquet")
    for name in ("p1_found", "p4_found", "p5_found", "p6_found"):
        a, b = (sorted(map(tuple, problems.QUERIES[name](spark, x).collect())) for x in (d, "/root/testdata/sf0.001"))
        assert a == b


def test_problem_queries_take_empty_tables(spark, tmp_path):
    d = str(tmp_path)
    for t in ("staged_decisions", "label_spool"):
        spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet").where("false").write.parquet(f"{d}/{t}.parquet")
    for name in ("p1_found", "p1_hours", "p1_days", "p1_versions", "p4_found", "p5_found", "p6_found", "p6_kept"):
        assert problems.QUERIES[name](spark, d).count() == 0
