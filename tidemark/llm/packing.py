"""Packing by concatenate and cut.

Pass one tokenizes each input partition once, numbers its tokens from 0 and writes the ids to the shared folder.
The partition totals (one row each) are summed up in order, which gives every partition its place in one long
stream; pass two cuts the stream into fixed windows. A document that crosses a window border leaves one record on
each side of it. No row is shuffled.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import RANKS_FILE, SPECIAL, SPECIAL_ID, library, shared_table, text_or_empty, tokenizer_path

WINDOW, END = 2048, 1
#: Input partitions at most (more are merged): bounds the table of totals that is broadcast, 16 bytes each.
MOST_PARTITIONS = 500_000
#: A text with a run of letters or of white space longer than this is left to the library.
LONG_RUN = 20_000


@functools.cache
def encoder(path: str, ranks_path: str):
    """Function from a text to its ids as little-endian unsigned 32-bit integers, one per worker process.

    The ids are the library's; texts usually go through the same vocabulary as ranks, which is faster.
    """
    import base64

    import public_tokenizers
    import regex
    import tiktoken

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={SPECIAL: SPECIAL_ID})
    odd = regex.compile(rf"\S{{{LONG_RUN}}}|\s{{{LONG_RUN}}}").search
    tok = library(path)

    def encode(text: str) -> np.ndarray:
        if len(text) > LONG_RUN and odd(text):
            return np.array(tok.encode(text, add_special_tokens=False).ids, "<u4")
        return fast.encode_to_numpy(text, allowed_special="all").astype("<u4", copy=False)

    return encode


def pack(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, end: int = END,
         path: str | None = None, ranks_path: str | None = None, with_ids: bool = False) -> DataFrame:
    """One row per piece: (id, start, length, ids_crc32, doc_tokens, sequence_id, offset[, ids]).

    A document's ids are the library's for its whole text (null: empty) and then ``end``, so every document has a
    piece. Documents follow each other in the order of the input partitions; all windows are full but the last.
    ids may be null or repeat: each row is packed. An empty table gives an empty result; other columns are not
    read. ``with_ids`` adds the ids of the piece as binary.
    """
    path, ranks_path = path or tokenizer_path(), ranks_path or tokenizer_path(RANKS_FILE)
    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("body")).coalesce(MOST_PARTITIONS)

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, at = encoder(path, ranks_path), TaskContext.get().partitionId(), 0
        tail = np.array([end], "<u4").tobytes()
        for b in batches:
            ids = [encode(t).tobytes() + tail for t in b.column("body").to_pylist()]
            n = np.array([len(x) // 4 for x in ids], np.int64)
            before = at + np.cumsum(n) - n
            at += int(n.sum())
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), pa.array(np.full(len(n), part)), pa.array(before), pa.array(n), pa.array(ids, pa.binary())],
                ["id", "part", "before", "n", "ids"])

    ids = shared_table(rows.mapInArrow(encoded, f"id {kind}, part long, before long, n long, ids binary"), "packing")
    totals = ids.groupBy("part").agg(F.sum("n").alias("n"))
    # Sums over groups of partitions first, so that no window sees more than a square root of them.
    totals = totals.withColumn("block", F.floor(F.col("part") / 1024))
    inside = Window.partitionBy("block").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    blocks = totals.groupBy("block").agg(F.sum("n").alias("block_n"))
    across = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("block", F.coalesce(F.sum("block_n").over(across), F.lit(0)).alias("base"))
    starts = totals.withColumn("inner", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(blocks, "block").select(
        "part", (F.col("base") + F.col("inner")).alias("base"))
    placed = ids.join(F.broadcast(starts), "part").select("id", (F.col("base") + F.col("before")).alias("at"), "n", "ids")
    names = ["start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            who, rows, bodies = [], [], []
            for i, (at, n, body) in enumerate(zip(*(b.column(c).to_pylist() for c in ("at", "n", "ids")))):
                start = 0
                while start < n:
                    seq, off = divmod(at + start, window)
                    length = min(window - off, n - start)
                    piece = body[4 * start:4 * (start + length)]
                    who.append(i)
                    rows.append((start, length, zlib.crc32(piece), n, seq, off))
                    bodies.append(piece if with_ids else b"")
                    start += length
            cols = [pa.array(c, pa.int64()) for c in zip(*rows)] if rows else [pa.array([], pa.int64())] * 6
            yield pa.RecordBatch.from_arrays(
                [b.column("id").take(pa.array(who, pa.int64())), *cols] + [pa.array(bodies, pa.binary())] * with_ids,
                ["id", *names] + ["ids"] * with_ids)

    schema = f"id {kind}, " + ", ".join(f"{x} long" for x in names) + ", ids binary" * with_ids
    return placed.mapInArrow(cut, schema).withColumnRenamed("id", id_col)
