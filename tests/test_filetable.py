import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.sources.filetable import FileTable, compaction_plan, unmasked
from tidemark.sources.storage import count_files

DDL = "id BIGINT, day DATE, v STRING"
D = [dt.date(2024, 1, n) for n in range(1, 6)]


def table(spark, folder, rows=()):
    t = FileTable(spark, folder, spark.createDataFrame([], DDL).schema, "day")
    if rows:
        t.create(spark.createDataFrame(rows, DDL))
    return t


def rows(t, **kw):
    return sorted((tuple(r) for r in t.read(**kw).collect()), key=repr)


def paths(t, where="kind = 'DATA'"):
    return {(r.part, r.path) for r in t.files().where(where).collect()}


def batch(spark, *rs):
    return spark.createDataFrame(list(rs), DDL)


START = [(i, D[i % 3], f"a{i}") for i in range(9)] + [(100, None, "n")]


def test_merge_rewrites_only_the_partitions_of_its_keys(spark, folder):
    t = table(spark, folder, START)
    before = paths(t)
    facts = t.merge(batch(spark, (0, D[0], "b0"), (50, D[0], "new")), ["id"])
    assert facts["partitions"] == 1
    after = paths(t)
    assert {p for p in before if p[0] != "2024-01-01"} == {p for p in after if p[0] != "2024-01-01"}
    assert {p for p in before if p[0] == "2024-01-01"}.isdisjoint(after)
    want = [(0, D[0], "b0"), (50, D[0], "new"), *START[1:]]
    assert rows(t) == sorted(want, key=repr)
    assert rows(t, seq=1) == sorted(START, key=repr)


def test_a_key_that_changes_its_partition_leaves_the_old_one(spark, folder):
    t = table(spark, folder, START)
    assert t.merge(batch(spark, (1, D[4], "moved"), (100, D[2], "dated")), ["id"])["partitions"] == 4
    got = rows(t)
    assert [r for r in got if r[0] in (1, 100)] == [(1, D[4], "moved"), (100, D[2], "dated")] and len(got) == 10
    assert {p for p, _ in paths(t)} == {"2024-01-01", "2024-01-02", "2024-01-03", "2024-01-05"}


def test_a_conditional_merge(spark, folder):
    t = table(spark, folder, START)
    t.merge(batch(spark, (0, D[0], "Z"), (1, D[1], "z")), ["id"], when="b.v > t.v")
    assert {r[0]: r[2] for r in rows(t)} == {r[0]: r[2] for r in START} | {1: "z"}


def test_a_failure_before_the_pointer_leaves_the_old_version(spark, folder, monkeypatch):
    t = table(spark, folder, START)
    broken = batch(spark, (0, D[0], "b")).withColumn("v", F.raise_error(F.lit("lost")).cast("string"))
    with pytest.raises(Exception, match="lost"):
        t.merge(broken, ["id"])
    with pytest.raises(Exception, match="lost"):
        t.merge_delta(broken, ["id"])
    monkeypatch.setattr(t.log, "append", lambda *a, **k: (_ for _ in ()).throw(RuntimeError("no pointer")))
    with pytest.raises(RuntimeError):
        t.merge(batch(spark, (0, D[0], "b")), ["id"])
    monkeypatch.undo()
    assert t.version().seq == 1 and rows(t) == sorted(START, key=repr)


def test_two_writers_of_one_version(spark, folder):
    t = table(spark, folder, START)
    t._base = lambda: 0
    with pytest.raises(Exception, match="ALREADY_EXISTS"):
        t.merge(batch(spark, (0, D[0], "b")), ["id"])
    assert rows(t) == sorted(START, key=repr)


def test_positions_mask_updates_of_updates(spark, folder):
    t = table(spark, folder, START)
    t.merge_delta(batch(spark, (0, D[0], "u1"), (1, D[4], "u1"), (60, D[1], "u1")), ["id"])
    t.merge_delta(batch(spark, (0, D[1], "u2"), (60, D[1], "u2")), ["id"], deletes=batch(spark, (2, None, None)))
    t.merge_delta(batch(spark, (0, D[0], "u3")), ["id"])
    want = {r[0]: (r[1], r[2]) for r in START} | {0: (D[0], "u3"), 1: (D[4], "u1"), 60: (D[1], "u2")}
    del want[2]
    assert {r[0]: r[1:] for r in rows(t)} == want and len(rows(t)) == len(want)
    # Copy-on-write over masked files, then compaction: the same rows, no masks.
    t.merge(batch(spark, (3, D[0], "m")), ["id"])
    want[3] = (D[0], "m")
    assert {r[0]: r[1:] for r in rows(t)} == want
    t.compact()
    assert {r[0]: r[1:] for r in rows(t)} == want and not paths(t, "kind = 'MASK'")
    assert rows(t, where="part = '2024-01-05'") == [(1, D[4], "u1")]


def test_masks_beyond_one_bitmap(spark, folder):
    t = FileTable(spark, folder, spark.range(1).selectExpr("id", "'p' AS day").schema, "day")
    t.create(spark.range(0, 70_000, 1, 1).selectExpr("id", "'p' AS day"))
    t.merge_delta(spark.createDataFrame([], t.schema), ["id"], deletes=spark.range(0, 70_000, 3))
    got = t.read()
    assert got.where("id % 3 = 0").isEmpty() and got.count() == 70_000 - len(range(0, 70_000, 3))


def test_a_masked_read_joins_no_keys(spark, folder):
    t = table(spark, folder, START)
    t.merge_delta(batch(spark, (0, D[0], "u1")), ["id"])
    plan = t.read()._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join" in line]
    assert len(joins) == 1 and "id#" not in joins[0]


def test_compaction_keeps_good_files_and_is_done_after_one_run(spark, folder):
    t = table(spark, folder, [(i, D[0], "x" * 50) for i in range(3000)])
    big = paths(t)
    for k in range(5):
        more = spark.range(10).selectExpr(f"id + {10_000 + 10 * k} AS id", "date'2024-01-01' AS day", "'s' AS v")
        t.merge_delta(more, ["id"])
    want = rows(t)
    size = t.files().agg(F.max("bytes")).first()[0]
    facts = t.compact(size)
    assert facts["files_before"] == 5 and facts["files_after"] == 1
    assert big <= paths(t) and len(paths(t)) == len(big) + 1 and rows(t) == want
    again = t.compact(size)
    assert again["files_before"] == 0 and again["seq"] == facts["seq"]


def test_plan_fills_bins(spark):
    files = [("DATA", f"s{i % 2}", "p", f"file:///d/{i}", 10 + i, False) for i in range(20)] + [
        ("DATA", "s0", "p", "file:/d/big", 1000, False), ("DATA", "s0", "p", "file:/d/done", 5, True), ("DATA", "s2", "p", "file:/d/alone", 5, False)]
    df = spark.createDataFrame(files, "kind STRING, slot STRING, part STRING, path STRING, bytes BIGINT, filled BOOLEAN")
    plan = compaction_plan(df, spark.createDataFrame([("file:/d/big",)], "file STRING"), 100).collect()
    assert {r.path for r in plan} == {f"file:///d/{i}" for i in range(20)} | {"file:/d/big"}
    assert all(r.bin_bytes <= 1200 for r in plan) and len({r.bin for r in plan}) == 4


def test_versions_fold(spark, folder):
    t = table(spark, folder, START)
    for k in range(3):
        t.merge_delta(batch(spark, (k, D[0], "u")), ["id"])
    want = rows(t)
    t.log.fold()
    t.log.purge()
    assert rows(t) == want and count_files(spark, f"{folder}/versions") < 4
    t.merge(batch(spark, (0, D[0], "w")), ["id"])
    assert t.version().seq == 5


def test_a_folder_that_listings_and_row_metadata_write_differently(spark, folder):
    t = table(spark, f"{folder}/a b", START)
    t.merge_delta(batch(spark, (0, D[0], "u")), ["id"])
    assert t.compact()["files_before"] == 2
    assert rows(t) == sorted([(0, D[0], "u"), *START[1:]], key=repr) and not paths(t, "kind = 'MASK'")


def test_a_masked_read_makes_no_text_per_row(spark, folder):
    t = table(spark, folder, START)
    t.merge_delta(batch(spark, (0, D[0], "u")), ["id"])
    lines = t.read()._jdf.queryExecution().optimizedPlan().toString().splitlines()
    at = next(i for i, line in enumerate(lines) if "Join" in line)
    assert not any("regexp" in line for line in lines) and not any("conv(" in line for line in lines[:at + 1])


def test_masks_that_name_whole_paths_count(spark, folder):
    t = table(spark, folder, START)
    masks = t.files().where("part = '2024-01-01'").select(F.col("path").alias("file"), F.lit(0).cast("bigint").alias("bucket")).join(
        spark.range(1, 3).agg(F.bitmap_construct_agg("id").alias("bits")))
    left = unmasked(t._rows(t.files()), masks)
    assert left.count() == len(START) - 2 and left.where("day = date'2024-01-01'").count() == 1
