import datetime as dt

import pytest

from tidemark.sources.log import TieredLog
from tidemark.sources.storage import count_files

DDL = "commit BIGINT, chunk BIGINT, v STRING, at TIMESTAMP_NTZ"


def log(spark, folder, **kw):
    return TieredLog(spark, folder, DDL, ["commit", "chunk"], **kw)


def rows(x):
    return sorted((r.commit, r.chunk, r.v) for r in x.read().collect())


def put(x, commit, v, chunk=1, **kw):
    x.append([dict(commit=commit, chunk=chunk, v=v, at=dt.datetime(2024, 1, 1))], **kw)


def test_a_repeated_commit_is_one_row_across_folds(spark, folder):
    x = log(spark, folder)
    assert rows(x) == [] and x.fold()["folded_rows"] == 0
    put(x, 1, "a")
    put(x, 1, "b")
    put(x, 2, "c")
    assert rows(x) == [(1, 1, "b"), (2, 1, "c")]
    x.fold()
    assert rows(x) == [(1, 1, "b"), (2, 1, "c")]
    put(x, 2, "d")
    assert rows(x) == [(1, 1, "b"), (2, 1, "d")]
    x.fold()
    x.purge()
    assert rows(x) == [(1, 1, "b"), (2, 1, "d")]
    put(x, 1, "e", chunk=2)
    assert rows(x) == [(1, 1, "b"), (1, 2, "e"), (2, 1, "d")]


def test_rows_of_an_entry_appear_together_and_names_are_taken_once(spark, folder):
    x = log(spark, folder)
    put(x, 1, "a", entry="first")
    with pytest.raises(Exception, match="ALREADY_EXISTS"):
        put(x, 2, "b", entry="first")
    assert rows(x) == [(1, 1, "a")]


def test_a_reader_sees_every_row_once_during_folds(spark, folder):
    x = log(spark, folder)
    for i in range(4):
        put(x, i, "a")
    planned = x.read()
    x.fold()
    put(x, 9, "late")
    assert sorted(r.commit for r in planned.collect()) == [0, 1, 2, 3]
    second = x.read()
    x.fold()
    assert sorted(r.commit for r in second.collect()) == [0, 1, 2, 3, 9]


def test_an_entry_that_arrives_during_a_fold_is_kept(spark, folder, monkeypatch):
    x = log(spark, folder)
    put(x, 1, "a")
    newest = TieredLog._newest
    monkeypatch.setattr(TieredLog, "_newest", lambda self, df: (put(self, 2, "b", entry="meanwhile") if rows_once.pop() else None, newest(self, df))[1])
    rows_once = [False, True]
    x.fold()
    monkeypatch.undo()
    x.purge()
    assert rows(x) == [(1, 1, "a"), (2, 1, "b")]


def test_runs_stay_few_and_large_ones_are_left_alone(spark, folder):
    x = log(spark, folder)
    x.append_each(spark.range(100).selectExpr("id AS commit", "1L AS chunk", "'x' AS v", "timestamp_ntz'2024-01-01' AS at").repartition(1))
    x.fold()
    big = x.state()[1][0].run
    for i in range(6):
        put(x, 1000 + i, "y")
        x.fold()
    runs = x.state()[1]
    assert runs[0].run == big and len(runs) <= 3 and sum(r.run_rows for r in runs) == 106
    assert x.purge() == 106
    assert count_files(spark, folder) < 20 and len(rows(x)) == 106


def test_a_lost_race_between_folds_is_an_error(spark, folder):
    x = log(spark, folder)
    put(x, 1, "a")
    state = x.state()
    x.fold()
    put(x, 2, "b")
    x.state = lambda: state
    with pytest.raises(Exception, match="ALREADY_EXISTS"):
        x.fold()
    del x.state
    assert rows(x) == [(1, 1, "a"), (2, 1, "b")]


def test_entries_appended_in_bulk_share_files(spark, folder):
    x = log(spark, folder)
    commits = spark.range(1000).selectExpr("id % 900 AS commit", "1L AS chunk", "CAST(id AS STRING) AS v", "timestamp_ntz'2024-01-01' AS at")
    x.append_each(commits.repartition(3))
    assert count_files(spark, f"{folder}/tail") < 20
    before = rows(x)
    x.fold()
    assert len(before) == 900 and rows(x) == before
    x.append_each(commits.where("commit < 5").coalesce(1))
    put(x, 900, "single")
    x.fold()
    assert x.purge() == 1000 + 10 + 1
    assert len(rows(x)) == 901 and count_files(spark, f"{folder}/tail") == 0
