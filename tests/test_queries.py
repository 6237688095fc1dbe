"""Every query outside the llm subpackage against its SQL, on the smallest tables."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from tests.compare import compare
from tidemark.plans import catalog

SF = "/root/testdata/sf0.001"
SLOW = {"stream_dead_letters", "p5_features"}


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - SLOW))
def test_query(spark, name):
    assert compare(spark, name, SF) == ""


def test_entry(spark):
    assert entry.entry(spark).columns == ["card_id", "day"]


def test_contract():
    assert set(entry.oracle_sql()) <= set(entry.queries())
