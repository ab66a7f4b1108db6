"""Writes that are repeated, empty or broken must not damage what is readable."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.operators.compare import compare_exact
from tidemark.operators.load import dedup_latest, dedup_standard, latest_first, merge_cow
from tidemark.operators.quality import QualitySpec, quality_aggregates, run_dq
from tidemark.sources import storage as S
from tidemark.streaming import jobs as J

T0 = dt.datetime(2024, 1, 1)


def keys(df):
    return sorted(r[0] for r in df.select("id").collect())


def test_full_replace_keeps_the_old_version_on_zero_rows(spark, folder):
    assert S.write_full(spark.range(5), folder)["published"]
    assert not S.write_full(spark.range(0), folder)["published"]
    assert keys(S.read_current(spark, folder)) == [0, 1, 2, 3, 4]
    S.write_full(spark.range(2), folder)
    assert keys(S.read_current(spark, folder)) == [0, 1]


def test_failed_full_replace_leaves_the_old_version(spark, folder):
    S.write_full(spark.range(3), folder)
    broken = spark.range(10).select(F.when(F.col("id") < 9, F.col("id")).otherwise(F.raise_error(F.lit("lost")).cast("bigint")).alias("id"))
    with pytest.raises(Exception, match="lost"):
        S.write_full(broken, folder)
    assert keys(S.read_current(spark, folder)) == [0, 1, 2]


def test_read_before_the_first_version(spark, folder):
    assert S.current_path(spark, folder) is None
    with pytest.raises(ValueError):
        S.read_current(spark, folder)


def test_append_is_repeatable(spark, folder):
    for _ in range(2):
        S.write_append(spark.range(4), folder, S.ChunkKey(1, 1, 1), {})
    S.write_append(spark.range(4, 6), folder, S.ChunkKey(1, 1, 2), {})
    assert keys(spark.read.schema("id BIGINT").parquet(folder)) == [0, 1, 2, 3, 4, 5]


def test_stage_is_sealed_and_checked(spark, folder):
    df = spark.range(50).withColumn("at", F.lit(T0).cast("timestamp_ntz"))
    row = S.stage_chunk(df, folder, S.ChunkKey(3, 1, 2), T0, T0 + dt.timedelta(days=1))
    staged = S.read_staged(spark, row, df.schema)
    assert S.verify_staged(staged, row).collect()[0].is_intact
    assert not S.verify_staged(staged.where("id <> 7"), row).collect()[0].is_intact
    swapped = staged.withColumn("id", F.when(F.col("id") == 7, 8).otherwise(F.col("id")))
    assert not S.verify_staged(swapped, row).collect()[0].is_intact
    with pytest.raises(ValueError):
        S.read_staged(spark, row, spark.range(1).schema)


def test_compaction_keeps_rows(spark, folder):
    spark.range(1000).withColumn("p", F.col("id") % 2).repartition(16).write.partitionBy("p").parquet(f"{folder}/a")
    facts = S.compact(spark, f"{folder}/a", f"{folder}/b", ["p"])
    assert facts["rows"] == 1000 and facts["files_after"] < facts["files_before"]
    assert keys(spark.read.parquet(f"{folder}/b")) == list(range(1000))


def test_orphans_need_age_and_absence(spark):
    now = T0 + dt.timedelta(days=10)
    listing = spark.createDataFrame([("a", T0), ("b", T0), ("c", now)], "path STRING, modified_at TIMESTAMP_NTZ")
    live = spark.createDataFrame([("a",)], "path STRING")
    assert [r.path for r in S.orphan_files(listing, live, dt.timedelta(days=3), now).collect()] == ["b"]


def test_listed_files(spark, folder):
    spark.range(10).repartition(3).write.parquet(folder)
    files = S.list_files(spark, folder)
    assert files.count() == 3 and files.where("bytes > 0").count() == 3


def test_merge_ingest_is_idempotent(spark, folder):
    schema = spark.sql("SELECT 1L AS id, 1L AS v").schema
    order = [F.desc("v")]
    body = J.merge_batches(folder, ["id"], order)
    one = spark.createDataFrame([(1, 10), (2, 20), (1, 11)], schema)
    two = spark.createDataFrame([(2, 19), (3, 30)], schema)
    want = [(1, 11), (2, 20), (3, 30)]
    read = lambda: sorted((r.id, r.v) for r in J.read_merged(spark, folder, ["id"], order, schema).collect())
    for batch, number in ((one, 0), (two, 1), (two, 1)):
        body(batch, number)
    assert read() == want
    J.fold_deltas(spark, folder, ["id"], order, schema)
    assert J.folded_to(spark, folder) == 1 and read() == want
    body(spark.createDataFrame([(3, 31)], schema), 2)
    assert read() == [(1, 11), (2, 20), (3, 31)]


def test_dedup_of_one_hot_key(spark):
    # A third of the rows are versions and copies of one key.
    df = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, F.lit(-1)).otherwise(F.col("id")).alias("k"),
        (F.lit(T0).cast("timestamp_ntz") + F.make_dt_interval(hours=(F.col("id") % 5).cast("int"))).alias("at"),
        (F.col("id") % 7).alias("v")).repartition(6)
    a = dedup_standard(df, ["k"], "at")
    b = dedup_latest(df, ["k"], latest_first(df, "at"))
    assert a.count() == b.count() == 2001
    assert compare_exact(a, b, ["k"]).isEmpty()


def test_broken_merge_is_noticed(spark):
    src = spark.range(100).withColumn("v", F.col("id") * 2)
    tgt = src.where("id < 50").withColumn("v", F.lit(0).cast("bigint"))
    good = merge_cow(tgt, src, ["id"])
    assert compare_exact(src, good, ["id"]).isEmpty()
    blind = tgt.unionByName(src)
    assert not compare_exact(src, blind, ["id"]).isEmpty()
    chunk = blind.select("id", F.lit(1).alias("chunk"), F.lit(T0).cast("timestamp_ntz").alias("wm"), F.lit(T0).cast("timestamp_ntz").alias("high"))
    spec = QualitySpec(["id"], "wm", "chunk", "high")
    row = run_dq(chunk, spec).collect()[0]
    assert row.dq_failed and row.duplicate_rows == 50
    facts = chunk.agg(*quality_aggregates(spec)).collect()[0]
    assert (facts.chunk_rows, facts.null_id, facts.rows_above_high) == (150, 0, 0)


def test_full_tables_are_not_compacted(spark, folder):
    with pytest.raises(ValueError):
        S.compact(spark, folder, folder + "-b", load_mode="FULL")


def test_shared_folder(spark, monkeypatch):
    from tidemark import session

    class Conf:
        def get(self, key, default=None):
            return None

    class Context:
        applicationId = "test-app"
        master = "local[2]"

    class Fake:
        conf, sparkContext = Conf(), Context()

    assert session.shared_root(Fake) == session.shared_root(Fake)
    Context.master = "spark://host:7077"
    with pytest.raises(RuntimeError):
        session.shared_root(Fake)
    assert session.shared_root(spark) == spark.conf.get("spark.checkpoint.dir")


def test_compaction_reads_its_target(spark, folder, monkeypatch):
    src, out = f"{folder}/small", f"{folder}/large"
    spark.range(1000).repartition(20).write.parquet(src)
    S.compact(spark, src, out)
    facts = dict(rows=1000, checksum=spark.read.parquet(src).agg(S.content_checksum(["id"])).collect()[0][0])
    schema = spark.read.parquet(src).schema
    S.check_same_rows(spark, out, schema, facts)
    spark.range(1000).selectExpr("id + 1 AS id").write.mode("overwrite").parquet(out)
    with pytest.raises(RuntimeError):
        S.check_same_rows(spark, out, schema, facts)


def test_a_repeated_commit_leaves_one_ledger_row(spark, folder):
    for n in (1, 2):
        S.write_append(spark.range(n), f"{folder}/data", S.ChunkKey(1, 1, 1), {}, f"{folder}/ledger")
    S.write_append(spark.range(5), f"{folder}/data", S.ChunkKey(1, 1, 2), {}, f"{folder}/ledger")
    rows = S.ledger_log(spark, f"{folder}/ledger").read().collect()
    assert sorted((r.chunk_no, r.written_rows) for r in rows) == [(1, 2), (2, 5)]


def test_a_fold_during_a_read_loses_nothing(spark, folder):
    from pyspark.sql import functions as F

    from tidemark.streaming import jobs as J

    schema = spark.range(1).selectExpr("id", "1 AS v").schema
    put = J.merge_batches(folder, ["id"], [F.desc("v")])
    put(spark.range(3).selectExpr("id", "1 AS v"), 0)
    J.fold_deltas(spark, folder, ["id"], [F.desc("v")], schema)
    put(spark.range(2, 5).selectExpr("id", "2 AS v"), 1)
    before = J.read_merged(spark, folder, ["id"], [F.desc("v")], schema)  # planned, not yet run
    J.fold_deltas(spark, folder, ["id"], [F.desc("v")], schema)
    want = {0: 1, 1: 1, 2: 2, 3: 2, 4: 2}
    assert {r.id: r.v for r in before.collect()} == want
    assert {r.id: r.v for r in J.read_merged(spark, folder, ["id"], [F.desc("v")], schema).collect()} == want


def test_append_keeps_late_rows_and_drops_repeats(spark, folder):
    body = J.append_batches(folder, ["id"], "at", "1 HOUR")
    schema = "id INT, at TIMESTAMP_NTZ"
    hour = lambda h: T0 + dt.timedelta(hours=h)
    batches = [[(1, hour(0)), (2, hour(5)), (2, hour(5))], [(2, hour(5)), (3, hour(1)), (4, hour(9))], [(5, hour(7)), (6, hour(8.5)), (7, None)]]
    for again in range(2):
        for n, rows in enumerate(batches):
            body(spark.createDataFrame(rows, schema), n)
    read = lambda name: sorted(r.id for r in spark.read.parquet(f"{folder}/{name}").collect())
    assert read("main") == [1, 2, 4, 6] and read("late") == [3, 5, 7]
    counts = J.late_counts(spark, folder, spark.createDataFrame([], schema).schema)
    assert {r.batch_id: r.late_rows for r in counts.collect()} == {1: 1, 2: 2}


def test_a_key_that_returns_after_the_overlap_is_reported(spark, folder):
    body = J.append_batches(folder, ["id"], "at", "10 MINUTES", 4)
    schema = "id INT, at TIMESTAMP_NTZ"
    hour = lambda h: T0 + dt.timedelta(hours=h)
    put = lambda n, *rows: body(spark.createDataFrame(list(rows), schema), n)
    read = lambda name: sorted((r.id, r.at.hour) for r in spark.read.schema(schema).parquet(f"{folder}/{name}").collect())
    put(0, (1, hour(0)), (2, hour(1)))
    put(1, (1, hour(4)), (3, hour(4)))
    assert read("main") == [(1, 0), (2, 1), (3, 4)] and read("repeats") == [(1, 4)]
    pk = spark.createDataFrame([], schema).select("id").schema
    assert J.fold_key_index(spark, folder, pk) == 1 and J.fold_key_index(spark, folder, pk) == 1
    for _ in range(2):
        put(2, (2, hour(9)), (4, hour(9)))
    # A batch that runs again after a later fold decides as before.
    J.fold_key_index(spark, folder, pk)
    put(2, (2, hour(9)), (4, hour(9)))
    put(3, (4, hour(12)))
    assert read("main") == [(1, 0), (2, 1), (3, 4), (4, 9)] and read("repeats") == [(1, 4), (2, 9), (4, 12)]


def test_a_delta_dedup_with_ties_leaves_one_row(spark):
    from tidemark.operators.load import read_mor

    base = spark.range(5).selectExpr("id", "0L AS v")
    deltas = spark.range(40).selectExpr("id % 4 AS id", "id AS v")
    assert read_mor(base, deltas, ["id"], [F.lit(1)]).groupBy("id").count().where("count > 1").isEmpty()
