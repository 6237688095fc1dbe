from __future__ import annotations

import pytest

from tests.compare import compare
from tidemark.llm import catalog

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, name):
    assert compare(spark, name, SF) == ""


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_on_empty_tables(spark, name, tmp_path):
    for t in ("documents", "eval_items", "kept_history", "latency_minutes"):
        spark.read.parquet(f"{SF}/{t}.parquet").where("false").write.parquet(f"{tmp_path}/{t}.parquet")
    assert catalog.QUERIES[name](spark, str(tmp_path)).count() == 0


def test_queries_are_the_same_in_other_partitions(spark, tmp_path):
    for t in ("documents", "eval_items", "kept_history"):
        spark.read.parquet(f"{SF}/{t}.parquet").repartition(5).write.parquet(f"{tmp_path}/{t}.parquet")
    for name in ("p3_sample", "p8_found", "p9_found", "p7_ids"):
        a, b = (sorted(map(str, catalog.QUERIES[name](spark, x).collect())) for x in (str(tmp_path), SF))
        assert a == b
