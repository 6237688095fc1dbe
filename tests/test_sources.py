"""Decoding, logs, replay, spools, stores, mapping, generator and the stream."""

from __future__ import annotations

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import features as fx
from tidemark.session import scratch_path
from tidemark.sources import card_csv, generator, records, tables
from tidemark.streaming import scorer

GOOD = {
    "schema_version": 2, "event_id": "e1", "event_time": "2027-09-01T10:00:00.000001Z", "card_id": "c", "device_id": None, "merchant_id": "m", "session_id": None, "amount_cents": 5,
    "currency": "USD", "merchant_category": "travel", "entry_mode": "chip", "card_country": "US", "merchant_country": "US", "is_recurring": False,
}


def line(**changes):
    return json.dumps(GOOD | changes)


def decoded(spark, lines):
    return records.decoded(spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "seq bigint, value string"))


@pytest.mark.parametrize(
    ("text", "reason"),
    [
        (line(), None), (line(device_id="d" * 64), None), (None, "undecodable"), ("", "undecodable"), (line()[:40], "undecodable"), ("[1]", "undecodable"), (line(schema_version=1), "unknown_schema_version"),
        (line(schema_version=None), "unknown_schema_version"), (line(extra=1), "unknown_field"), (line(amount_cents="five"), "undecodable"), (line(amount_cents=0), "invalid"), (line(amount_cents=100_000_001), "invalid"),
        (line(currency="EUR"), "invalid"), (line(card_country="us"), "invalid"), (line(entry_mode="x"), "invalid"), (line(event_id=""), "invalid"), (line(event_id="e" * 65), "invalid"), (line(card_id=None), "invalid"),
        (line(event_time="2027-09-01T10:00:00+02:00"), "not_utc"), (line(event_time="2027-09-01T10:00:00"), "not_utc"), (line(merchant_category=None), None),
    ],
)
def test_decode(spark, text, reason):
    row = decoded(spark, [text]).first()
    assert row.reason == reason
    if reason is None:
        assert row.record.event_id == "e1" and row.record.event_time.microsecond == 1
    else:
        import base64

        dead = records.dead_letters(decoded(spark, [text])).first()
        assert dead.reason == reason and (dead.payload is None if text is None else base64.b64decode(dead.payload).decode() == text)


def test_bad_runs(spark):
    r = random.Random(1)
    for _ in range(3):
        flags = [r.random() < 0.8 for _ in range(60)]
        rows = spark.createDataFrame([(i * 9_000, "bad" if b else None) for i, b in enumerate(flags)], "seq bigint, reason string")
        want = max((len(x) for x in "".join("b" if b else " " for b in flags).split()), default=0)
        assert records.longest_bad_run(rows, "seq").first().longest == want
    assert records.longest_bad_run(rows.where("false"), "seq").first().longest == 0


def test_log_round_trip(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/txn_stream.parquet").select(*[f.name for f in records.TRANSACTION.fields]).where("schema_version = 2")
    path = scratch_path(spark, "log")
    records.write_log(rows, path)
    assert records.read_transactions(spark, path).exceptAll(rows).count() == 0


def test_time_order(spark):
    r = random.Random(2)
    rows = [(i, r.randrange(100)) for i in range(200)]
    df = spark.createDataFrame(rows, "seq bigint, t bigint")
    top, want = -1, []
    for i, t in rows:
        if t >= top:
            want.append(i)
            top = t
    assert [x.seq for x in tables.in_time_order(df, "t", "seq", strict=False).orderBy("seq").collect()] == want
    assert {x.seq for x in tables.late_in_log(df, "t", "seq", block=7).where("not late").collect()} == set(want)
    with pytest.raises(Exception, match="out of time order"):
        tables.in_time_order(df, "t", "seq").collect()
    assert tables.in_time_order(df.orderBy("t").selectExpr("t AS seq", "t"), "t", "seq").count() == 200


def test_spool(spark):
    spool = tables.HourSpool(spark, scratch_path(spark, "spool"))
    rows = spark.createDataFrame([(dt.datetime(2027, 9, 1, h, m), h) for h in range(3) for m in range(4)] + [(None, 9)], "event_time timestamp, x int")
    spool.append(rows)
    assert spool.seal_closed("2027-09-01T02", limit=1) == ["2027-09-01T00"]
    spool.append(rows.where("x = 0"))
    assert spool.hours() == [f"2027-09-01T0{h}" for h in range(3)] and spool.read().count() == 16
    assert spool.seal("2027-09-01T00", ["event_time"]) and not spool.seal("2027-09-01T00") and spool.sealed() == ["2027-09-01T00"]
    assert spool.read(["2027-09-01T00"], ["x"]).groupBy("x").count().collect()[0]["count"] == 8
    spool.delete(["2027-09-01T00"])
    assert spool.read().count() == 8


def test_feature_store(spark):
    mk = lambda *r: spark.createDataFrame(r, "event_id string, us bigint, entity string, entity_id string, features map<string,double>")
    store = tables.FeatureStore(spark, scratch_path(spark, "store"))
    store.write(mk(("a", 1, "card", "x", {"f": 1.0}), ("b", 9, "card", "y", {"f": 2.0})), 0)
    store.write(mk(("c", 5, "card", "x", {"f": 3.0})), 1)
    store.write(mk(("c", 5, "card", "x", {"f": 3.0})), 1)
    assert store.offline("card").count() == 3
    assert {(r.entity_id, r.event_id) for r in store.online().collect()} == {("x", "c"), ("y", "b")}


def test_profile_and_checksums(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("b", None), ("a", 3)], "s string, n int")
    got = {r.column: (r.n, round(r.missing_share, 3), r.n_distinct, r.example) for r in tables.profile(df).collect()}
    assert got == {"s": (3, 0.0, 2, "a"), "n": (3, 0.333, 2, "1")}
    (tmp_path / "f").write_text("x")
    (tmp_path / "g").write_text("y")
    seen = tables.checksums(spark, str(tmp_path)).collect()
    then = spark.createDataFrame([(r.name, r.sha256) for r in seen] + [("gone", "0")], "name string, sha256 string")
    (tmp_path / "g").write_text("z")
    assert {r.name: r.state for r in tables.verify(spark, str(tmp_path), then).collect()} == {"f": "same", "g": "changed", "gone": "missing"}


def test_mapping(spark):
    base = dict(TransactionID="7", TransactionDT="86400.0", TransactionAmt="12.345", isFraud="1", D1="14.0", card1="315.0", card2="", card3=" 150 ", card4="visa", card5="NaN", card6="debit", addr1="299.0")
    rows = [base, base | dict(TransactionAmt="0.004"), base | dict(TransactionAmt="-3.00"), base | dict(TransactionAmt="twelve"), base | dict(addr1=None), base | dict(isFraud="2"), base | dict(TransactionDT="-1"), base | dict(TransactionID=""), base | dict(D1="x"), base | dict(TransactionAmt="12.355")]
    got = card_csv.mapped(spark.createDataFrame([[r[c] for c in card_csv.USED_COLUMNS] for r in rows], ", ".join(f"{c} string" for c in card_csv.USED_COLUMNS))).collect()
    import hashlib

    key = "315|~|150|visa|~|debit|299|-13"
    assert got[0].card_id == "ieee-card-" + hashlib.sha256(key.encode()).hexdigest()[:20] and got[0].amount_cents == 1234 and got[0].rounded and got[0].event_id == "ieee-7"
    assert got[0].event_time == dt.datetime(2017, 12, 2) and got[0].label_time == dt.datetime(2017, 12, 9)
    assert [r.reason for r in got[1:4]] == ["no positive amount"] * 3 and got[4].card_id == "ieee-unlinked-7" and got[4].reason is None
    assert [r.reason for r in got[5:9]] == ["no label", "no time", "no id", "no start day"] and got[9].amount_cents == 1236


def test_generator_is_a_function_of_the_number(spark):
    w = generator.World(per_day=500)
    whole = generator.traffic(spark, w, 2)
    parts = generator.traffic(spark, w, 2, first=300, until=1000).unionByName(generator.traffic(spark, w, 2, until=300)).repartition(3)
    assert whole.count() == 1000 and whole.exceptAll(parts).count() == parts.exceptAll(whole).count() == 0
    txn, labels, truth = generator.split(whole)
    rules = records.broken(records.transaction_rules())
    assert txn.where(rules != "").count() == 0 and labels.count() == truth.count() == 1000
    assert truth.where("is_fraud AND scenario IS NULL OR NOT is_fraud AND scenario IS NOT NULL").count() == 0
    assert generator.traffic(spark, w, 0).count() == 0


def test_faults(spark):
    lines = records.to_wire(spark.read.parquet("/root/testdata/sf0.001/txn_stream.parquet").where("schema_version = 2")).withColumn("k", F.xxhash64("value"))
    bad = records.decoded(generator.with_faults(lines, "k", 1, duplicate=0.2, truncate=0.1, rename=0.1).select("value"))
    share = {r.reason: r["count"] for r in bad.groupBy("reason").count().collect()}
    n = lines.count()
    assert bad.count() > 1.1 * n and 0.05 * n < share["undecodable"] < 0.2 * n and share["unknown_field"] > 0.03 * n
    back = generator.reversed_blocks(spark.range(10).withColumnRenamed("id", "seq"), "seq", 4).collect()
    assert [r.seq for r in back][:4] == [3, 2, 1, 0]


def test_stream_equals_batch_and_refuses(spark):
    path, at = scratch_path(spark, "in"), lambda m: (dt.datetime(2027, 9, 1, 10) + dt.timedelta(minutes=m)).strftime("%Y-%m-%dT%H:%M:%S.%fZ")
    first = [line(event_id=f"a{m}", event_time=at(m), amount_cents=m + 1) for m in range(5)] + [line(event_id="old", event_time=at(1)), "broken", line(event_id="a4", event_time=at(4), amount_cents=5)]
    second = [line(event_id="a3", event_time=at(3), amount_cents=4), line(event_id="late", event_time=at(2)), line(event_id="b", event_time=at(4)), line(event_id="c", event_time=at(30))]
    for batch in (first, second):
        spark.createDataFrame([(x,) for x in batch], "value string").coalesce(1).write.mode("append").text(path)
        import time

        time.sleep(1.1)
    s = scorer.StreamScorer(spark, scratch_path(spark, "out"), models={"two": lambda f, a: F.lit(0.95)})
    s.run(scorer.text_stream(spark, path), scratch_path(spark, "checkpoint"))
    staged = {r.event_id: r.card_txn_count_1h for r in s.read("staged").collect()}
    assert staged == {"a0": -1, "a1": 1, "a2": 2, "a3": 3, "a4": 4, "b": 4, "c": 6}
    dead = sorted(r.reason for r in s.read("dead").collect())
    assert dead == ["late", "late", "undecodable"] and s.state()["batch"] == 1
    ids = spark.createDataFrame([(json.loads(x)["event_id"], json.loads(x)["event_time"]) for x in first + second if x != "broken"], "event_id string, t string").where("event_id NOT IN ('old', 'late')").distinct()
    txn = ids.select("event_id", F.unix_micros(F.to_timestamp("t")).alias("us"), F.lit("c").alias("card_id"), F.lit(None).cast("string").alias("device_id"), F.lit("m").alias("merchant_id"), F.lit(None).cast("string").alias("session_id"), F.lit(1).alias("amount_cents"))
    assert {r.event_id: r.card_txn_count_1h for r in fx.compute(txn).collect()} == staged
    # A batch run again replaces what it wrote.
    s.process(spark.createDataFrame([(x,) for x in second], "value string").coalesce(1), 1)
    assert s.read("staged").count() == 7
    s.point("two")
    s.process(spark.createDataFrame([(line(event_id="d", event_time=at(60)),)], "value string"), 2)
    assert s.read("staged").where("event_id = 'd'").first().action == "decline"
    s.roll_back()
    s.process(spark.createDataFrame([(line(event_id="e", event_time=at(61)),)], "value string"), 3)
    assert s.read("staged").where("event_id = 'e'").first().champion_version == "stand-in"
    with pytest.raises(ValueError):
        s.point("three")
    with pytest.raises(scorer.TooManyBadRecords):
        s.process(spark.createDataFrame([("x",)] * 60, "value string"), 4)


def test_streaming_state(spark):
    path = scratch_path(spark, "states")
    rows = [("a", "2027-09-01 10:00:00", 1), ("a", "2027-09-01 10:00:00", 1), ("b", "2027-09-01 11:30:00", 2)]
    spark.createDataFrame(rows, "id string, t string, n int").selectExpr("id", "CAST(t AS timestamp) AS t", "n").write.parquet(path)
    stream = spark.readStream.schema("id string, t timestamp, n int").parquet(path)
    q = scorer.hourly_counts(scorer.deduplicated(stream, "id", "t"), "t", "n", None).writeStream.format("memory").queryName("hours").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("hours").count() <= 2


def test_trailing_state_equals_batch(spark):
    from tidemark.functions.times import HOUR
    from tidemark.streaming.trailing import trailing

    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    r, path = random.Random(9), scratch_path(spark, "trail")
    rows = sorted([(f"e{i}", 1_821_000_000_000_000 + r.randrange(40) * HOUR // 7, r.choice(["x", "y"]), r.randrange(9)) for i in range(60)], key=lambda x: x[1])
    for part in (rows[:25], rows[25:]):
        spark.createDataFrame(part, "event_id string, us bigint, card_id string, amount_cents bigint").coalesce(1).write.mode("append").parquet(path)
        import time

        time.sleep(1.1)
    stream = spark.readStream.schema("event_id string, us bigint, card_id string, amount_cents bigint").option("maxFilesPerTrigger", 1).parquet(path)
    q = trailing(stream, "card_id", "event_id", "us", "amount_cents", HOUR).writeStream.format("memory").queryName("trail").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    want = {e: (sum(1 for _, v, d, _ in rows if d == c and u - HOUR <= v < u), sum(a for _, v, d, a in rows if d == c and u - HOUR <= v < u)) for e, u, c, _ in rows}
    cut = rows[25][1]
    got = {x.event_id: (x.n, x.total) for x in spark.table("trail").collect()}
    assert set(got) == set(want) and all(got[e] == want[e] for e, u, _, _ in rows if u != cut)
