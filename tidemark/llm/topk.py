"""Exact top-k search by tiled matrix products.

Vectors are dealt at random into query tiles and candidate shards of bounded size. One task multiplies one tile
with one shard, selects the k best per query there, and a merge tree of bounded fan-in joins the lists of a
query. Nothing is broadcast, and no task ever holds more than one tile, one shard and one block of scores.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import ROW, with_row

LONG = (-(1 << 63), (1 << 63) - 1)
#: Cells of the score matrix held at once.
BLOCK_CELLS = 1 << 22


def _matrix(bodies: list[bytes]) -> np.ndarray:
    """Rows of float64; shorter vectors are filled with zeros."""
    width = max(map(len, bodies), default=0) // 8
    if all(len(b) == 8 * width for b in bodies):
        return np.frombuffer(b"".join(bodies)).reshape(len(bodies), width)
    out = np.zeros((len(bodies), width))
    for line, b in zip(out, bodies):
        line[:len(b) // 8] = np.frombuffer(b)
    return out


def _products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Inner products of integer-valued vectors: float64 where that is exact, else exact integers kept to a long."""
    most = np.abs(q).max(initial=0) * np.abs(c).max(initial=0) * max(1, q.shape[1])
    if most < 2 ** 53:
        return q @ c.T
    exact = np.array([[int(x) for x in v] for v in q.tolist()], object) @ np.array([[int(x) for x in v] for v in c.tolist()], object).T
    return np.clip(exact, *LONG)


def _best(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Columns and scores of each row's k largest values, ties to the smaller column."""
    if scores.dtype == object:
        at = np.array([sorted(range(len(s)), key=lambda j: (-s[j], j))[:k] for s in scores.tolist()])
        return at, np.take_along_axis(scores, at, 1)
    line, at, got, work = np.arange(len(scores)), [], [], scores
    for _ in range(k):
        j = work.argmax(1)
        at.append(j)
        got.append(work[line, j])
        work[line, j] = -np.inf
    return np.stack(at, 1), np.stack(got, 1)


def tile_lists(queries: pa.Table, cands: pa.Table, k: int) -> Iterator[tuple]:
    """(query row, query id, candidate id, score) of the k best candidates of each query in this shard."""
    order = np.lexsort((cands[ROW].to_numpy(), cands["id"].to_numpy()))
    cands = cands.take(order)
    c, ids, rows = _matrix(cands["body"].to_pylist()), cands["id"].to_numpy(), cands[ROW].to_numpy()
    q_all, q_ids, q_rows = _matrix(queries["body"].to_pylist()), queries["id"].to_pylist(), queries[ROW].to_numpy()
    if c.shape[1] != q_all.shape[1]:
        width = max(c.shape[1], q_all.shape[1])
        c, q_all = (np.pad(m, ((0, 0), (0, width - m.shape[1]))) for m in (c, q_all))
    step = max(1, BLOCK_CELLS // max(1, len(ids)))
    where = {r: j for j, r in enumerate(rows.tolist())}
    for lo in range(0, len(q_ids), step):
        scores = _products(q_all[lo:lo + step], c)
        own = [where.get(r) for r in q_rows[lo:lo + step].tolist()]
        take = min(k + 1, scores.shape[1])  # one more than asked for: the query itself may be among them
        at, got = _best(scores, take)
        for i, (cols, vals) in enumerate(zip(at.tolist(), got.tolist())):
            kept = [(j, v) for j, v in zip(cols, vals) if j != own[i]][:k]
            for j, v in kept:
                yield int(q_rows[lo + i]), q_ids[lo + i], int(ids[j]), int(v)


def integer_vectors(df: DataFrame, id_col: str, vector_col: str, scale: float) -> DataFrame:
    """(id, __row, body): floor(scale * x) as packed float64. Null ids, null vectors and non-finite parts take no part."""
    rows = with_row(df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")))
    rows = rows.where("id IS NOT NULL AND v IS NOT NULL")

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep, body = [], []
            v, off = b.column("v"), b.column("v").offsets.to_numpy()
            flat = v.values.to_numpy(zero_copy_only=False)
            good = np.isfinite(flat)
            with np.errstate(invalid="ignore", over="ignore"):
                whole = np.floor(flat * scale)
            good &= np.isfinite(whole)
            for i, (lo, hi) in enumerate(zip(off[:-1].tolist(), off[1:].tolist())):
                keep.append(bool(good[lo:hi].all()))
                body.append(whole[lo:hi].tobytes())
            out = pa.RecordBatch.from_arrays([b.column("id"), b.column(ROW), pa.array(body, pa.binary())], ["id", ROW, "body"])
            yield out.filter(pa.array(keep, pa.bool_()))

    return rows.mapInArrow(packed, f"id long, {ROW} long, body binary")


def _top(df: DataFrame, keys: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "vec_id", "shard")
    return df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_k(df: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding",
          scale: float = 256.0, tile_rows: int = 4096, least_tiles: int = 48, fan_in: int = 32) -> DataFrame:
    """(query_id, rank, vec_id, score) for the rows where ``is_query`` (a column over ``id``) holds.

    Every other row is a candidate, also one that repeats the query's id or vector; ties go to the smaller id,
    then to the earlier row. Parts are floor(scale * x); scores are exact integers, beyond a long kept at its
    ends. Vectors of other lengths count as filled with zeros, empty ones score 0. Null ids and vectors that
    are null or hold null, NaN or infinite parts are left out. A query with fewer candidates gets all of
    them; an empty table gives an empty result. At least ``least_tiles`` shards keep small tables parallel.
    """
    vectors = integer_vectors(df, id_col, vector_col, scale)
    counts = df.select(F.col(id_col).cast("long").alias("id")).agg(
        F.count("*").alias("n"), F.count(F.when(is_query, 1)).alias("q")).first()
    tiles, shards = math.ceil(counts["q"] / tile_rows) or 1, max(math.ceil(counts["n"] / tile_rows), least_tiles)
    place = F.xxhash64(ROW, F.lit(7))
    q = vectors.where(is_query).select(
        "id", ROW, "body", F.pmod(place, F.lit(tiles)).cast("int").alias("tile"),
        F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"))
    fresh = [F.col(x).alias(x) for x in ("id", ROW, "body")]  # the two sides of a cogroup must not share columns
    c = vectors.select(*fresh, F.pmod(place, F.lit(shards)).cast("int").alias("shard"),
                       F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))).alias("tile"))
    names = ["query_row", "query_id", "vec_id", "score", "shard"]
    kinds = pa.schema([(n, pa.int64()) for n in names[:4]] + [("shard", pa.int32())])

    def multiplied(key, queries: pa.Table, cands: pa.Table) -> pa.Table:
        if not len(queries) or not len(cands):
            return kinds.empty_table()
        rows = list(tile_lists(queries, cands, k))
        shard = key[1].as_py()
        return pa.Table.from_arrays([pa.array([r[j] for r in rows], pa.int64()) for j in range(4)]
                                    + [pa.array([shard] * len(rows), pa.int32())], schema=kinds)

    lists = q.groupBy("tile", "shard").cogroup(c.groupBy("tile", "shard")).applyInArrow(
        multiplied, "query_row long, query_id long, vec_id long, score long, shard int")
    while shards > fan_in:
        shards = math.ceil(shards / fan_in)
        lists = _top(lists.withColumn("shard", F.col("shard") % shards), ["query_row", "shard"], k).select(*names)
    return _top(lists, ["query_row"], k).select("query_id", "rank", "vec_id", "score")
