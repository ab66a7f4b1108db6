"""Unions of branches that Spark shuffles by the same key."""

from conftest import SMALL
from twin_check import difference, duck

from tidemark.plans.registry import all_queries, all_twins


def test_a_repair_without_broadcast_joins(spark):
    # Both branches of the union are shuffled by the key; the target is itself a union, so it has twice the partitions.
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    try:
        assert difference(all_queries()["audit_repair"](spark, SMALL), duck(SMALL), all_twins()["audit_repair"]) is None
    finally:
        spark.conf.set(key, before)
