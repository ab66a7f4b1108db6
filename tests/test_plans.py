"""Shape of the physical plans: what reaches the scan, and what must never appear."""

import datetime as dt

import pytest
from conftest import SMALL
from pyspark.sql import functions as F

import __spark_entry__ as entry_points
from tidemark.operators import cursors as C
from tidemark.operators import load as L
from tidemark.operators import windows as W
from tidemark.sources import extract as X

# These run and write while they are built; their result is a plain file scan.
WRITERS = ("stream_", "append_", "staged_", "jsonl_", "ledger_append", "full_replace", "partition_replace",
           "compacted_", "versioned_", "snapshot_ancestry", "window_containment", "unexplained_")
PURE = sorted(n for n in entry_points.queries() if not n.startswith(WRITERS))


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", PURE)
def test_no_pairwise_joins_and_no_python(spark, name):
    plan = plan_of(entry_points.queries()[name](spark, SMALL))
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "ArrowEvalPython", "BatchEvalPython", "MapInPandas"):
        assert bad not in plan
    for line in plan.splitlines():
        # A window without keys would gather the whole table in one task.
        assert not ("Window [" in line and line.rstrip().endswith("], []"))


def test_window_is_pushed_to_the_scan(tables):
    plan = plan_of(W.in_window(tables.events, "ts", dt.datetime(2024, 1, 10), dt.datetime(2024, 1, 20)).select("event_id"))
    assert "GreaterThanOrEqual(ts," in plan and "LessThan(ts," in plan
    assert "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz>" in plan


def test_keyset_window_is_pushed_to_the_scan(tables):
    plan = plan_of(C.keyset_window(tables.events, "ts", "event_id", (dt.datetime(2024, 1, 10), 5), (dt.datetime(2024, 1, 20), 9)))
    assert "GreaterThanOrEqual(ts," in plan and "LessThanOrEqual(ts," in plan


def test_only_the_touched_partitions_of_the_target_are_read(spark, folder, tables):
    tables.orders.withColumn("day", F.date_format("o_orderdate", "yyyy-MM")).write.partitionBy("day").parquet(folder)
    target = spark.read.parquet(folder).where("day = '1998-01'")
    assert "PartitionFilters: [isnotnull(day" in plan_of(L.pk_reconcile(tables.orders, target, ["o_orderkey"]))


def test_dedup_drops_rows_before_the_shuffle(tables):
    plan = plan_of(L.dedup_latest(tables.lineitem, ["l_orderkey", "l_linenumber"], [F.desc("l_shipdate")]))
    assert plan.index("WindowGroupLimit") < plan.index("Exchange") < plan.rindex("WindowGroupLimit")


def test_small_batch_leaves_the_target_unshuffled(tables):
    batch = tables.orders.where("o_orderkey < 10")
    plan = plan_of(L.merge_cow(tables.orders, batch, ["o_orderkey"]))
    assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan


def test_extract_text():
    bound = X.WindowBound("UPDATE_DT", "TIMESTAMP(6)", dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 2, 3, 4, 5, 6))
    assert X.extract_sql("HR.EMP", ["ID", "NAME"], bound, "DEPT = 'A'", "ID > 0") == (
        "SELECT ID, NAME FROM HR.EMP WHERE UPDATE_DT >= TIMESTAMP '2024-01-01 00:00:00.000000' "
        "AND UPDATE_DT < TIMESTAMP '2024-01-02 03:04:05.000006' AND (DEPT = 'A') AND (ID > 0)")


@pytest.fixture(scope="module")
def sides(spark):
    """A stored target and a batch small enough to be broadcast."""
    from tidemark.session import scratch_path

    path = scratch_path(spark, "target")
    spark.range(50_000).selectExpr("id", "id % 7 AS v", "timestamp_ntz'2024-01-01' + make_dt_interval(0, 0, 0, id) AS at").write.parquet(path)
    spark.createDataFrame([(5, 1), (10 ** 6, 2)], "id LONG, v LONG").selectExpr("id", "v", "timestamp_ntz'2024-01-02' AS at").write.parquet(path + "-batch")
    return spark.read.parquet(path), spark.read.parquet(path + "-batch")


def test_small_batches_leave_the_target_in_place(spark, sides):
    from datetime import datetime

    from tidemark.operators import load as L
    from tidemark.operators.quality import merge_metrics

    target, batch = sides
    merged = L.merge_cow(target, batch, ["id"], when="b.v <> t.v")
    plans = {
        "merge": merged, "read": L.read_mor(target, batch, ["id"], [F.desc("at")]),
        "audit": L.audit(batch, target, ["id"], "at", datetime(2024, 1, 1), datetime(2025, 1, 1)),
        "metrics": merge_metrics(target, batch, ["id"], when="b.v <> t.v")}
    for name, df in plans.items():
        text = plan_of(df)
        assert "BroadcastHashJoin" in text and "SortMergeJoin" not in text, name
        # The newest row of each key of the delta log is found before the read; only the audit deals its batch by key here.
        assert ("Exchange hashpartitioning" in text) == (name == "audit"), name
    got = {r.id: r.v for r in merged.where("id IN (4, 5, 1000000)").collect()}
    assert got == {4: 4, 5: 1, 10 ** 6: 2} and merged.count() == 50_001
    assert plans["metrics"].collect()[0].asDict() == {
        "input_rows": 2, "inserted_rows": 1, "updated_rows": 1, "deleted_rows": 0, "ignored_rows": 0, "balanced": True}
