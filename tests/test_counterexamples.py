"""Known ways to lose rows: each shown to lose, and its counterpart to hold."""

import datetime as dt

from pyspark.sql import functions as F

from tidemark.operators import compare as P
from tidemark.operators import cursors as C
from tidemark.operators import load as L
from tidemark.operators import windows as W

T0 = dt.datetime(2024, 1, 1)
SEC = dt.timedelta(seconds=1)


def events(spark, rows):
    return spark.createDataFrame(rows, "id INT, wm TIMESTAMP_NTZ, commit_ts TIMESTAMP_NTZ")


def ids(df, col="id"):
    return sorted(r[col] for r in df.collect())


def test_equal_watermark_late_commit(spark):
    rows = [(i, T0 + i * SEC, T0 + i * SEC) for i in range(5)] + [(5, T0 + 4 * SEC, T0 + 60 * SEC)]
    src = events(spark, rows)
    seen = src.where(F.col("commit_ts") < F.lit(T0 + 30 * SEC).cast("timestamp_ntz"))
    first = W.in_window(seen, "wm", T0, T0 + 5 * SEC)
    second = W.in_window(src, "wm", T0 + 5 * SEC, T0 + 90 * SEC)
    loaded = first.unionByName(second)
    assert ids(C.never_loaded(src, loaded, ["id"])) == [5]
    ledger = spark.createDataFrame([(1, T0, T0 + 5 * SEC, T0 + 30 * SEC)], "job INT, window_low TIMESTAMP_NTZ, window_high TIMESTAMP_NTZ, cas_at TIMESTAMP_NTZ")
    late = C.late_commits(src.withColumn("job", F.lit(1)), ledger, "job", "wm", "commit_ts")
    assert ids(late) == [5]
    # Re-reading the overlap finds it without duplicates.
    batch = W.in_window(src, "wm", T0, T0 + 90 * SEC)
    new = L.overlap_anti_join(batch, first, ["id"], "wm", T0 + 5 * SEC, dt.timedelta(minutes=1))
    assert ids(new) == [5] and new.collect()[0].overlap_recovered


def test_future_outlier_does_not_move_the_cursor(spark):
    rows = [(i, T0 + i * SEC, T0) for i in range(10)] + [(10, T0 + dt.timedelta(days=30), T0)]
    src = events(spark, rows)
    row = W.eligible_high(src, "wm", T0 + 20 * SEC).collect()[0]
    assert row.eligible_high == T0 + 9 * SEC and row.raw_high > row.eligible_high and row.quarantined == 1
    assert ids(W.quarantine(src, "wm", T0 + 20 * SEC)) == [10]
    assert ids(W.quarantine(src, "wm", T0 + dt.timedelta(days=31))) == []


def test_null_watermarks_are_neither_in_nor_out(spark):
    src = events(spark, [(i, T0 + i * SEC if i < 8 else None, T0 + i * SEC) for i in range(12)])
    c = W.window_census(src, "wm", T0, T0 + 4 * SEC).collect()[0]
    assert (c.rows_in, c.rows_out, c.rows_unknown, c.balanced) == (4, 4, 4, True)
    assert ids(C.null_wm_rows(src, "wm", "commit_ts", T0, T0 + 60 * SEC)) == [8, 9, 10, 11]


def test_empty_source_needs_a_bootstrap(spark):
    jobs = spark.sql("SELECT 1 AS job_id, 1 AS source_id, CAST(NULL AS TIMESTAMP_NTZ) AS current_watermark")
    fences = spark.sql("SELECT 1 AS source_id, TIMESTAMP_NTZ '2024-01-05' AS safe_cutoff")
    assert W.plan_windows(jobs, fences).collect()[0].window_status == "NEEDS_BOOTSTRAP"
    assert W.plan_windows(jobs, fences, T0).collect()[0].window_status == "READY"
    empty = fences.withColumn("safe_cutoff", F.lit(None).cast("timestamp_ntz"))
    assert W.plan_windows(jobs, empty, T0).collect()[0].window_status == "NO_DATA"


def test_two_watermarks(spark):
    rows = [(i, T0 + i * SEC, None) for i in range(5)] + [(i, T0, T0 + i * SEC) for i in range(5, 10)] + [(10, None, T0 + 7 * SEC)]
    src = spark.createDataFrame(rows, "id INT, insert_dt TIMESTAMP_NTZ, update_dt TIMESTAMP_NTZ")
    cols, bounds = ["insert_dt", "update_dt"], [(T0 + 2 * SEC, T0 + 9 * SEC), (T0 + 6 * SEC, T0 + 9 * SEC)]
    either = C.dual_window_or(src, cols, bounds)
    assert ids(either) == [2, 3, 4, 6, 7, 8, 10] == ids(C.dual_window_union(src, cols, bounds))
    assert ids(either) == ids(C.dual_window_union(src, cols, bounds, pk=["id"]))


def test_per_shard_cursors_lose_rows(spark):
    src = spark.createDataFrame([(1, 0, 5), (2, 1, 12), (3, 0, 15), (4, 1, 18)], "pk INT, shard INT, seq INT")
    cursors = spark.createDataFrame([(0, 10), (1, 14)], "shard INT, cursor_seq INT")
    assert ids(C.shard_sweep(src, "shard", "seq", cursors, 20, global_=False), "pk") == [3, 4]
    assert ids(C.shard_sweep(src, "shard", "seq", cursors, 20), "pk") == [2, 3, 4]
    assert ids(C.shard_sweep_loss(src, "shard", "seq", cursors, 20), "pk") == [2]


def test_tuple_cursor_closes_ties(spark):
    src = events(spark, [(i, T0 + (i // 3) * SEC, T0) for i in range(9)])
    a = C.keyset_window(src, "wm", "id", (T0, 0), (T0 + SEC, 5))
    b = C.keyset_window(src, "wm", "id", (T0 + SEC, 5), (T0 + 9 * SEC, 0))
    assert ids(a) == [0, 1, 2, 3, 4] and ids(b) == [5, 6, 7, 8]
    assert C.next_keyset(src, "wm", "id").collect()[0].cursor_pk == 8


def test_crashed_sweep(spark):
    src = spark.createDataFrame([(p, p * 20 + i) for p in range(10) for i in range(20)], "part INT, pk INT")
    staged = src.where("part < 9 OR pk % 2 = 0").where("part >= 5")
    sink = src.where("part < 5")
    manifest = spark.createDataFrame([(p, "SEALED", 20) for p in range(9)] + [(9, "OPEN", 10)], "part INT, status STRING, rows_written BIGINT")
    lost = P.staging_lost(src, staged, manifest, sink, "part", ["pk"])
    assert ids(lost, "pk") == list(range(181, 200, 2))
    states = {r.part: r.stage_state for r in P.staging_residue(src, staged, manifest, "part").collect()}
    assert states[8] == "COMPLETE" and states[9] == "UNSEALED"


def test_census_methods_see_different_things(spark):
    one = spark.createDataFrame([(i, f"v{i}") for i in range(20)], "pk INT, h STRING")
    two = one.where("pk <> 3").withColumn("h", F.when(F.col("pk").isin(7, 10), "new").otherwise(F.col("h")))
    assert ids(P.census_diff(one, two, ["pk"], "PK_ONLY"), "pk") == [3]
    assert ids(P.census_diff(one, two, ["pk"], "SAMPLE_HASH"), "pk") == [10]
    assert ids(P.census_diff(one, two, ["pk"], "FULL_HASH"), "pk") == [3, 7, 10]


def test_partition_skew(spark):
    reads = spark.createDataFrame([(1,), (2,), (2,), (4,)], "pk INT")
    found = {(r.pk, r.finding) for r in P.partition_skew(reads, spark.createDataFrame([(i,) for i in range(1, 5)], "pk INT"), ["pk"]).collect()}
    assert found == {(2, "READ_TWICE"), (3, "NEVER_READ")}


def test_sampled_fence_facts_are_marked(spark):
    src = spark.range(1000).select(F.expr("timestamp_ntz'2024-01-01' + id * INTERVAL 1 SECOND").alias("wm"))
    exact = W.fence_facts(src, "wm", T0).collect()[0]
    rough = W.fence_facts(src, "wm", T0, sample=0.2).collect()[0]
    assert exact.exact and exact.rows_scanned == 1000 and exact.tied_at_max == 1
    assert not rough.exact and 0 < rough.rows_scanned < 1000


def test_equal_tables_shuffle_no_rows(spark):
    src = spark.range(500).withColumn("v", F.col("id") * 3)
    assert P.compare_exact(src, src.where("id >= 0"), ["id"], buckets=16).isEmpty()
    changed = src.withColumn("v", F.when(F.col("id") == 77, 0).otherwise(F.col("v"))).where("id <> 5")
    assert P.differing_buckets(src, changed, ["id"], None, 64).count() <= 2
    found = P.compare_exact(src, changed, ["id"], buckets=64).collect()
    assert sorted((r.id, r.difference) for r in found) == [(5, "MISSING"), (77, "HASH_MISMATCH")]


def test_overlap_applies_to_the_uncovered_window_only(spark):
    w = spark.createDataFrame([(1, T0, T0), (2, T0 + SEC, T0)], "job INT, window_low TIMESTAMP_NTZ, original_low TIMESTAMP_NTZ")
    got = {r.job: r.extract_low for r in W.with_extract_low(w, dt.timedelta(minutes=30)).collect()}
    assert got == {1: T0 - dt.timedelta(minutes=30), 2: T0 + SEC}
