import math

from helpers import stored
from pyspark.sql import functions as F

from tidemark.llm.topk import top_k

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, k, every):
    good = [(i, n, [math.floor(256 * x) for x in v]) for n, (i, v) in enumerate(rows)
            if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, n, q in good:
        if i % every == 0:
            found = sorted((-sum(a * b for a, b in zip(q, c)), j) for j, m, c in good if m != n)[:k]
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(found)]
    return sorted(out)


def run(spark, rows, k=5, every=2, **options):
    df = stored(spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA))
    got = top_k(df, F.col("id") % every == 0, k, **options).collect()
    return sorted((r.query_id, r.rank, r.vec_id, r.score) for r in got)


def test_ties_repeats_nulls_and_uneven(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [0.5, -0.25]), (1, [0.5, -0.25]), (2, [0.5, -0.25]), (2, [0.5, -0.25]), (3, None), (None, [1.0]), (4, [nan, 1.0]), (5, [inf]),
            (6, []), (7, [0.5]), (8, [0.001, 0.5, 0.25]), (9, [None, 1.0]), (10, [-1.0, -1.0])]
    for options in ({}, {"tile_rows": 2, "least_tiles": 5, "fan_in": 2}):
        assert run(spark, rows, **options) == brute(rows, 5, 2)
    assert run(spark, []) == [] and run(spark, [(2, [1.0])]) == []


def test_large_parts_stay_exact(spark):
    rows = [(i, [float(2 ** 22 + i), float(2 ** 20)]) for i in range(6)]
    assert run(spark, rows, k=3) == brute(rows, 3, 2)
    huge = run(spark, [(0, [1e30]), (1, [1e30]), (2, [-1e30])], k=2)
    assert (0, 1, 1, 2 ** 63 - 1) in huge and (2, 1, 0, -(2 ** 63)) in huge
