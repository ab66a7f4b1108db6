from pyspark.sql import functions as F

from tidemark.functions.canon import rules_from_schema
from tidemark.operators import compare as P


def test_equal_tables_end_after_one_level(spark, monkeypatch):
    df = spark.range(20_000).withColumn("v", F.col("id") % 7)
    levels = []
    made = P.materialised
    monkeypatch.setattr(P, "materialised", lambda rows, label="rows": levels.append(label) or made(rows, label))
    found = P.compare_tree(df, df.repartition(3), ["id"])
    assert levels == ["digests"] and found.isEmpty()
    assert "Exchange" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_few_differences_are_found_in_few_leaves(spark):
    a = spark.range(20_000).withColumn("v", F.col("id") % 7)
    b = a.where("id <> 5").withColumn("v", F.when(F.col("id") % 4000 == 11, -1).otherwise(F.col("v"))).unionByName(
        spark.createDataFrame([(10 ** 9, 1)], a.schema))
    leaves, bits = P.differing_leaves(a, b, ["id"], bits=5, leaf_rows=50)
    assert bits >= 10 and leaves.count() <= 7 and leaves.agg(F.sum("n")).first()[0] < 700
    got = {(r.id, r.difference) for r in P.compare_tree(a, b, ["id"], bits=5, leaf_rows=50).collect()}
    assert got == {(5, "MISSING"), (10 ** 9, "EXTRA")} | {(i, "HASH_MISMATCH") for i in range(11, 20_000, 4000)}
    assert got == {(r.id, r.difference) for r in P.compare_exact(a, b, ["id"]).collect()}


def test_different_tables_stop_descending(spark):
    a = spark.range(3000).withColumn("v", F.lit(1))
    b = a.withColumn("v", F.lit(2))
    leaves, bits = P.differing_leaves(a, b, ["id"], bits=4, leaf_rows=1)
    assert bits == 8 and P.compare_tree(a, b, ["id"], bits=4, leaf_rows=1).count() == 3000


def test_numbers_that_do_not_fit_are_findings(spark):
    rows = [(1, 1e30), (2, 1.5), (3, float("nan")), (4, None), (5, 2e30)]
    a = spark.createDataFrame(rows, "id INT, v DOUBLE")
    rules = rules_from_schema(a.schema, scales={"v": 10})
    for kw in ({}, {"buckets": 4}):
        got = {(r.id, r.difference) for r in P.compare_exact(a, a, ["id"], rules, **kw).collect()}
        assert got == {(1, "UNCOMPARED"), (5, "UNCOMPARED")}
    assert {r.id for r in P.compare_tree(a, a, ["id"], rules).collect()} == {1, 5}
    b = spark.createDataFrame([(1, "1" * 36)], "id INT, v STRING").selectExpr("id", "CAST(v AS DECIMAL(38,0)) AS v")
    from tidemark.functions.canon import ColumnRule

    wide = [ColumnRule("id", "NUMBER", 38, 0), ColumnRule("v", "NUMBER", 38, 6)]
    assert [r.difference for r in P.compare_exact(b, b, ["id"], wide).collect()] == ["UNCOMPARED"]


def test_scattered_differences_are_found_in_few_leaves(spark):
    # Every node of the first two levels holds a difference, yet one row in a hundred differs.
    a = spark.range(40_000).withColumn("v", F.col("id") % 7)
    b = a.withColumn("v", F.when(F.col("id") % 100 == 11, -1).otherwise(F.col("v")))
    leaves, _ = P.differing_leaves(a, b, ["id"], bits=3, leaf_rows=10)
    assert leaves.agg(F.sum("n")).first()[0] < 40_000 / 5
    assert P.compare_tree(a, b, ["id"], bits=3, leaf_rows=10).count() == 400
