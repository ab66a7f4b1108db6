"""Every registered query against its SQL twin on the smallest data."""

import pytest
from conftest import SMALL
from twin_check import difference, duck

import __spark_entry__ as entry_points
from tidemark.plans.registry import all_queries, all_twins

QUERIES, TWINS = all_queries(), all_twins()
# Too few snapshots at this size for one to expire.
EMPTY = ("expirable_snapshots",)


@pytest.fixture(scope="module")
def con():
    return duck(SMALL)


def test_every_query_has_a_twin():
    assert set(QUERIES) == set(TWINS)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_twin(spark, con, name):
    expected = "both sides are empty" if name in EMPTY else None
    assert difference(QUERIES[name](spark, SMALL), con, TWINS[name]) == expected


def test_entry(spark):
    df = entry_points.entry(spark)
    assert df.columns == ["event_id", "user_id", "event_type", "value", "ts"] and not df.isEmpty()
