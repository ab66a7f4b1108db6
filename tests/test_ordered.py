"""Ordered scans against plain Python, with many bins and one key that owns a third of the rows."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import ordered as O
from tidemark.operators.evidence import merge_windows, overlap_counts_per_window
from tidemark.operators.quantiles import exact_percentiles

T0 = dt.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(5)
    out = []
    for i in range(900):
        key = 0 if i % 3 == 0 else rnd.randrange(1, 40)
        out.append((key, T0 + dt.timedelta(seconds=rnd.randrange(200_000)), i, rnd.choice([None, rnd.randrange(100)])))
    return out


@pytest.fixture(scope="module")
def df(spark, rows):
    return spark.createDataFrame(rows, "k INT, at TIMESTAMP_NTZ, i INT, v INT")


@pytest.fixture(params=["heavy", "narrow", "one"])
def bins(request, monkeypatch):
    monkeypatch.setattr(O, "ROWS_PER_BIN", 20)
    return {"heavy": None, "narrow": 7, "one": 10**9}[request.param]


def by_key(rows):
    keys = {}
    for r in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        keys.setdefault(r[0], []).append(r)
    return keys


def test_previous_and_next(df, rows, bins):
    got_p = {r.i: r.p for r in O.previous_values(df, ["k"], ["at", "i"], {"p": "i"}, bins).collect()}
    got_n = {r.i: r.n for r in O.next_values(df, ["k"], ["at", "i"], {"n": "i"}, bins).collect()}
    want_p, want_n = {}, {}
    for rs in by_key(rows).values():
        for a, b in zip([None, *rs], rs):
            want_p[b[2]] = a and a[2]
        for a, b in zip(rs, [*rs[1:], None]):
            want_n[a[2]] = b and b[2]
    assert got_p == want_p and got_n == want_n


@pytest.mark.parametrize("inclusive", [True, False])
def test_running(df, rows, bins, inclusive):
    out = O.running(df, ["k"], ["at", "i"], {"s": ("sum", "v"), "m": ("max", "v"), "l": ("last", "v")}, bins, inclusive)
    got = {r.i: (r.s, r.m, r.l) for r in out.collect()}
    want = {}
    for rs in by_key(rows).values():
        seen = []
        for r in rs:
            if inclusive:
                seen.append(r[3])
            known = [v for v in seen if v is not None]
            want[r[2]] = (sum(known), max(known, default=None), known[-1] if known else None)
            if not inclusive:
                seen.append(r[3])
    assert got == want


def test_asof(spark, df, rows, bins):
    right = [(k, T0 + dt.timedelta(seconds=s), s) for k in range(0, 30) for s in range(k * 100, 200_000, 17_000)]
    r = spark.createDataFrame(right, "k INT, since TIMESTAMP_NTZ, x INT")
    got = {q.i: q.x for q in O.asof_join(df, r, ["k"], "at", "since", ["x"], bins).collect()}
    for k, at, i, _ in rows:
        hits = [x for kk, s, x in right if kk == k and s <= at]
        assert got[i] == (max(hits) if hits else None)


def test_overlap_counts_match_pairs(spark, bins):
    rnd = random.Random(9)
    iv = []
    for i in range(300):
        s = rnd.randrange(5000)
        iv.append((0 if i % 3 == 0 else rnd.randrange(8), T0 + dt.timedelta(minutes=s), T0 + dt.timedelta(minutes=s + rnd.randrange(0, 300)), i))
    d = spark.createDataFrame(iv, "k INT, lo TIMESTAMP_NTZ, hi TIMESTAMP_NTZ, i INT")
    got = {r.i: (r.overlap_count, r.overlap_with) for r in overlap_counts_per_window(d, ["k"], "lo", "hi", "i", bins).collect()}
    want = {}
    for k, lo, hi, i in iv:
        open_ = [b for b in iv if b[0] == k and b[3] != i and b[1] < hi and lo < b[2] and b[1] < b[2] and lo < hi
                 and (b[1], b[3]) < (lo, i)]
        if open_:
            want[i] = (len(open_), max((b[2], b[3]) for b in open_)[1])
    assert got == want


def test_merge_windows_is_the_union(spark, bins):
    rnd = random.Random(3)
    iv = [(rnd.randrange(3), s := rnd.randrange(2000), s + rnd.randrange(0, 40)) for _ in range(200)]
    d = spark.createDataFrame([(k, T0 + dt.timedelta(minutes=a), T0 + dt.timedelta(minutes=b)) for k, a, b in iv],
                              "k INT, window_low TIMESTAMP_NTZ, window_high TIMESTAMP_NTZ")
    got = {}
    for r in merge_windows(d, ["k"], bins=bins).collect():
        a, b = (int((x - T0).total_seconds() // 60) for x in (r.window_low, r.window_high))
        for m in range(a, b):
            assert (r.k, m) not in got
            got[(r.k, m)] = True
    assert set(got) == {(k, m) for k, a, b in iv for m in range(a, b)}


@pytest.mark.parametrize("limit", [None, 1000])
def test_exact_percentiles(spark, limit):
    d = spark.range(20_000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 7)).alias("g"),
        F.pmod(F.hash("id"), F.lit(1_000_003)).cast("double").alias("v"))
    d = d.unionByName(spark.range(15_000).select(F.lit("hot").alias("g"), (F.col("id") % 11).cast("double").alias("v")))
    d = d.unionByName(spark.range(3).select(F.lit("none").alias("g"), F.lit(None).cast("double").alias("v")))
    wanted = {"a": 0.5, "b": 0.95, "c": 0.99, "lo": 0.0, "hi": 1.0}
    got = {r.g: tuple(r[n] for n in wanted) for r in exact_percentiles(d, ["g"], "v", wanted, limit).collect()}
    want = {r.g: tuple(r.p) if r.p else (None,) * 5 for r in d.groupBy("g").agg(F.percentile("v", list(wanted.values())).alias("p")).collect()}
    assert got.keys() == want.keys() and got["none"] == (None,) * 5
    for g in want:
        assert got[g] == want[g] or got[g] == pytest.approx(want[g])
    whole = exact_percentiles(d, [], "v", {"m": 0.5}, limit).collect()
    assert whole[0].m == pytest.approx(d.agg(F.percentile("v", 0.5)).collect()[0][0])


def test_only_large_keys_are_heavy(df):
    assert [r.k for r in O.heavy_keys(df, ["k"], "at", 100).collect()] == [0]
    assert O.heavy_keys(df, ["k"], "at", 1000).isEmpty()
    assert {r._bin for r in O.with_bins(df, ["k"], "at", 1000).collect()} == {0}


def test_bins_follow_rows_not_time(spark):
    """A far value, a burst and a value with many ties: no bin holds more than twice the limit."""
    at = [T0 + dt.timedelta(seconds=i // 50) for i in range(4000)] + [T0 + dt.timedelta(hours=1)] * 3000 + [dt.datetime(9999, 12, 31)]
    d = spark.createDataFrame([(1, a, i) for i, a in enumerate(at)], "k INT, at TIMESTAMP_NTZ, i INT")
    sizes = [r["count"] for r in O.with_bins(d, ["k"], "at", 500, "i").groupBy(O.BIN).count().collect()]
    assert max(sizes) <= 1000 and len(sizes) > 10
    got = {r.i: r.p for r in O.previous_values(d, ["k"], ["at", "i"], {"p": "i"}, 500).collect()}
    assert got == {i: (i - 1 if i else None) for i in range(len(at))}


def test_open_intervals_overlap_everything_later(spark):
    rows = [(1, T0, None, 0), (1, T0 + dt.timedelta(hours=1), T0 + dt.timedelta(hours=2), 1), (1, T0 + dt.timedelta(hours=3), T0 + dt.timedelta(hours=4), 2)]
    d = spark.createDataFrame(rows, "k INT, lo TIMESTAMP_NTZ, hi TIMESTAMP_NTZ, i INT")
    got = {r.i: (r.overlap_count, r.overlap_with) for r in overlap_counts_per_window(d, ["k"], "lo", "hi", "i").collect()}
    assert got == {1: (1, 0), 2: (1, 0)}


@pytest.mark.parametrize("n", [2, 5])
def test_row_count_drift_across_bins(df, rows, bins, n):
    from tidemark.operators.load import row_count_drift

    stats = df.groupBy("k", "at").agg(F.max("i").cast("bigint").alias("row_count"))
    got = {(r.k, r.at): r.trailing_avg for r in row_count_drift(stats, ["k"], "at", n, 10.0 ** 9, bins).collect()}
    want, by = {}, {}
    for r in sorted(stats.collect(), key=lambda r: (r.k, r.at)):
        seen = by.setdefault(r.k, [])
        if seen:
            want[r.k, r.at] = sum(seen[-n:]) / len(seen[-n:])
        seen.append(r.row_count)
    assert got == pytest.approx(want)
