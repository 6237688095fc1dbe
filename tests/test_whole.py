"""Queries over all of their rows, where an earlier form took a part of them."""

from __future__ import annotations

import datetime as dt
import hashlib
from pathlib import Path

from pyspark.sql import functions as F

import __spark_entry__ as entry
from tests.compare import duck
from tidemark.plans import source_queries
from tidemark.session import scratch_path
from tidemark.sources import records, tables

SF = "/root/testdata/sf0.001"


def test_training_set_below_the_bounds_is_all_labelled_rows(spark):
    labelled = duck(SF).execute("SELECT count(DISTINCT event_id) FROM kept_history WHERE is_fraud IS NOT NULL").fetchone()[0]
    assert entry.queries()["train_bounded"](spark, SF).count() == labelled


def test_all_closed_hours_are_sealed(spark):
    spool = source_queries._spooled(spark, SF)
    hours = {r[0] for r in duck(SF).execute("SELECT DISTINCT strftime(event_time, '%Y-%m-%dT%H') FROM staged_decisions WHERE event_time IS NOT NULL").fetchall()}
    assert set(spool.sealed()) == hours - {max(hours)} and spool._of("open") == [max(hours)]


def test_sealing_many_hours_keeps_late_rows(spark):
    spool = tables.HourSpool(spark, scratch_path(spark, "spool"))
    rows = spark.sql("SELECT id, timestamp'2027-09-01 00:30:00' + make_interval(0, 0, 0, 0, id % 3) AS event_time FROM range(30)")
    spool.append(rows)
    assert spool.seal_closed("2027-09-01T02") == ["2027-09-01T00", "2027-09-01T01"]
    spool.append(rows.where("id < 6").withColumn("id", F.col("id") + 100))
    assert spool.seal_closed("2027-09-01T03") == ["2027-09-01T00", "2027-09-01T01", "2027-09-01T02"]
    assert sorted(r.id for r in spool.read().collect()) == [*range(30), *range(100, 106)]


def test_checksums_cover_the_folder(spark, tmp_path):
    for name in ("a/part-0", "b/part-0"):
        (tmp_path / name).parent.mkdir()
        (tmp_path / name).write_text(name)
    got = {r.name: r.sha256 for r in tables.checksums(spark, str(tmp_path)).collect()}
    assert got == {n: hashlib.sha256(n.encode()).hexdigest() for n in ("a/part-0", "b/part-0")}
    then = spark.createDataFrame([(n, x if n != "b/part-0" else "other") for n, x in got.items()], "name string, sha256 string")
    assert {r.name: r.state for r in tables.verify(spark, str(tmp_path), then).collect()} == {"a/part-0": "same", "b/part-0": "changed"}
    found = {r.name: r.state for r in entry.queries()["src_checksums"](spark, SF).collect()}
    files = {str(p.relative_to(SF)) for p in Path(SF).rglob("*") if p.is_file() and not p.name.startswith((".", "_"))}
    assert found == dict.fromkeys(files, "same") | {"region.parquet": "changed", "nation.parquet": "new", "gone.parquet": "missing"}


def test_a_batch_delivered_again_and_a_sealing_that_died(spark):
    root = scratch_path(spark, "spool")
    spool = tables.HourSpool(spark, root)
    rows = spark.sql("SELECT id, timestamp'2027-09-01 00:30:00' + make_interval(0, 0, 0, 0, id % 2) AS event_time FROM range(10)")
    spool.append(rows, 7)
    spool.append(rows, 7)
    recover, spool.recover = spool.recover, lambda: None  # the run dies after its journal
    spool.seal_closed("2027-09-01T01")
    spool.append(rows.where("id < 4").withColumn("id", F.col("id") + 100), 8)
    again = tables.HourSpool(spark, root)
    assert again.sealed() == ["2027-09-01T00"] and sorted(r.id for r in again.read().collect()) == [*range(10), *range(100, 104)]
    again.append(rows, 7)  # its first hour is sealed
    assert sorted(r.id for r in again.read().collect()) == [*range(10), *range(100, 104)]
    now = dt.datetime(2027, 9, 1, 2, 9)
    assert again.seal_settled(now) == ["2027-09-01T00"] and again.seal_settled(now + dt.timedelta(minutes=1)) == ["2027-09-01T01"]
    assert again.day_ready("2027-09-01", dt.datetime(2027, 9, 2, 3)) and not again.day_ready("2027-09-01", dt.datetime(2027, 9, 2, 2))


def test_good_records_end_a_bad_run_inside_and_across_minutes(spark):
    full = spark.read.parquet(f"{SF}/txn_stream.parquet").where("schema_version = 2 AND event_time IS NOT NULL").limit(1).select(*[f.name for f in records.TRANSACTION.fields])
    bad = [1, 0, 1, 1, 0, 0, 1, 0, 1, 0, 1, 1, 1, 0, 0, 1]  # five seconds apart: each minute has a bad one
    n = spark.createDataFrame(list(enumerate(bad)), "n int, bad int")
    rows = full.crossJoin(n).withColumn("event_time", F.timestamp_seconds(1_820_000_000 + F.col("n") * 5)).withColumn("event_id", F.format_string("e%03d", "n"))
    rows = rows.withColumn("schema_version", F.when(F.col("bad") == 1, 1).otherwise(2).cast(full.schema["schema_version"].dataType)).drop("n", "bad")
    assert source_queries._bad_runs(rows).first().longest == 3


def test_late_deliveries_are_found_among_all_rows(spark):
    got = entry.queries()["src_replay_late"](spark, SF)
    assert got.count() == duck(SF).execute("SELECT count(*) FROM staged_decisions").fetchone()[0]


def test_numbers_follow_parts_then_order(spark):
    rows = spark.createDataFrame([(k // 7, (k * 5) % 7) for k in range(30)], "b int, v int")
    got = [(r.b, r.v) for r in tables.numbered(rows, F.col("b"), ["v"]).orderBy("seq").collect()]
    assert got == sorted((k // 7, (k * 5) % 7) for k in range(30))
