"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Documents of a source are dealt by a hash into blocks of about equal word counts. A source's quota is a number of
block draws: whole passes over its blocks, then a permuted part of them, whose last block is drawn in part. The
tree splits the quotas of all sources among the output shards: at each node the draws of the left half are a
multivariate-hypergeometric sample of the node's draws. A shard then takes its own range of each source's
permuted draws, and documents are shuffled inside their shard. All randomness comes from hashes and fixed seeds.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import ROW, text_or_empty, with_row
from tidemark.session import cut_lineage

#: Fixed values of the contract: weights of the sources in turn, share of all sizes, limit of a source.
WEIGHTS, SHARE, MOST = (5, 2, 1), 1.5, 2.0
#: Words of a block at least, and blocks over all sources at most (larger inputs get larger blocks).
BLOCK_WORDS, MOST_BLOCKS = 1 << 16, 200_000
BINS = 1 << 20
#: Output shards: one for so many drawn words, and at least so many that small mixes stay parallel.
SHARD_WORDS, LEAST_SHARDS = 1 << 24, 64
#: With more sources than this, their targets are joined by a shuffle instead of a broadcast.
FEW_SOURCES = 10_000
DRAWS = "array<struct<shard:int,pass:int,part:boolean>>"


def words(text: str | Column) -> Column:
    return F.regexp_count(text_or_empty(text), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def source_targets(sizes: DataFrame, share: float = SHARE, most: float = MOST, weights=WEIGHTS) -> DataFrame:
    """Add ``target`` to one row per source (source, source_size).

    Sources in code-point order, null last, weigh ``weights`` in turn and share ``share`` of all sizes; a target
    stops at ``most`` times its source's size and the excess is shared again by weight. The fixed point is a
    water level: a source is full if its limit per weight is below the level left to it and its successors; that
    level falls from the first source that is not full, so the highest one is the answer.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    pick = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    df = sizes.withColumn("weight", pick.cast("double")).withColumn("stop", most * F.col("source_size"))
    order = Window.orderBy(F.col("stop") / F.col("weight"), F.col("source").asc_nulls_last())
    below, rest = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    total = share * F.sum("source_size").over(Window.partitionBy())
    df = df.withColumn("level", (total - F.coalesce(F.sum("stop").over(below), F.lit(0.0))) / F.sum("weight").over(rest))
    full = F.col("stop") <= F.col("weight") * F.col("level")
    level = F.max(F.when(~full, F.col("level"))).over(Window.partitionBy())
    return df.select("source", "source_size", F.when(full, F.col("stop")).otherwise(F.col("weight") * level).alias("target"))


def split_leaves(quotas: np.ndarray, shards: int, seed: int = 0):
    """(shard, sources, draws) of every shard in order, by a tree of hypergeometric splits; shards get equal numbers of draws.

    A node holds only the sources that have draws there, so memory follows the draws and not sources times shards.
    """
    every = np.flatnonzero(quotas)
    stack = [(0, shards, every, quotas[every].astype(np.int64))]
    while stack:
        lo, hi, who, have = stack.pop()
        if hi - lo == 1:
            yield lo, who, have
            continue
        mid, total = (lo + hi) // 2, int(have.sum())
        take = total * (mid - lo) // (hi - lo)
        rng, left, rest = np.random.default_rng((seed, lo, hi)), np.zeros_like(have), total
        for i, n in enumerate(have.tolist()):
            rest -= n
            left[i] = rng.hypergeometric(n, rest, take) if take else 0
            take -= int(left[i])
        for at in ((mid, hi, have - left), (lo, mid, left)):
            some = at[2] > 0
            stack.append((*at[:2], who[some], at[2][some]))


def split_quotas(quotas: np.ndarray, shards: int, seed: int = 0) -> np.ndarray:
    """The same as a table: draws of each source in each shard."""
    out = np.zeros((len(quotas), shards), dtype=np.int64)
    for shard, who, have in split_leaves(quotas, shards, seed):
        out[who, shard] = have
    return out


def _fill(rows: pd.DataFrame) -> pd.DataFrame:
    """Of the last, partly drawn block: documents in hash order as far as they fit, then later ones that still do.

    The first are told by the key of the last of them, the others by their row keys (few, as they share one gap).
    """
    rows = rows.sort_values(["place", ROW], kind="stable")
    left, cut, later, fits = int(rows["need"].iloc[0]), (-(1 << 63), -1), [], True
    for place, row, size in zip(rows["place"].tolist(), rows[ROW].tolist(), rows["size"].tolist()):
        if size <= left:
            left -= size
            if fits:
                cut = (place, row)
            elif size:
                later.append(row)
        else:
            fits = False
    first = rows.iloc[0]
    return pd.DataFrame({"source": [first["source"]], "block": [first["block"]], "place": [cut[0]], "row": [cut[1]], "later": [later]})


def numbered(rows: DataFrame) -> DataFrame:
    """Add ``nth``: numbers from 0 among the rows of one ``same``, which are interchangeable.

    Draws depend on these numbers and never on a row's place in the input, so the mix is the same however the input
    is split. Rows with many equals are numbered in 64 parts.
    """
    rows = cut_lineage(rows)
    many = rows.groupBy("same").count().where("count > 1").select("same")
    equal = rows.join(many, "same", "left_semi").select("same", ROW, F.pmod(F.xxhash64(ROW), F.lit(64)).alias("part"))
    parts = equal.groupBy("same", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("same").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("same", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy("same", "part").orderBy(ROW)) - 1
    equal = equal.withColumn("inside", inside).join(parts, ["same", "part"]).select(ROW, (F.col("before") + F.col("inside")).alias("nth"))
    return rows.join(equal, ROW, "left").withColumn("nth", F.coalesce("nth", F.lit(0)))


def mixed(df: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text",
          shards: int | None = None, seed: int = 0) -> tuple[DataFrame, int]:
    """((id, row key, size, source_size, target, place, draws), shards): ``draws`` lists the (shard, pass) that take the row."""
    source = F.col(source_col).cast("string")
    rows = cut_lineage(numbered(df.select(
        F.col(id_col).alias("id"), ROW, source.alias("source"), words(text_col).alias("size"),
        F.xxhash64(F.col(id_col), source, F.col(text_col)).alias("same"))))
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = cut_lineage(source_targets(sizes))
    total, n_sources = targets.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.count("*")).first()
    block_words = max(BLOCK_WORDS, total // MOST_BLOCKS)
    shards = shards or max(LEAST_SHARDS, int(SHARE * total) // SHARD_WORDS)
    if n_sources <= FEW_SOURCES:
        targets = F.broadcast(targets)
    n_blocks = F.greatest(F.lit(1), F.ceil(F.col("source_size") / F.lit(block_words)))
    place = F.xxhash64("same", "nth", F.lit(seed))
    # A source's first hash bits give its block, so a block is known for any row from its source's size alone.
    block = F.floor(F.pmod(place, F.lit(BINS)) * n_blocks / F.lit(BINS)).cast("long")
    known = rows.join(targets, rows["source"].eqNullSafe(targets["source"])).select(
        "id", ROW, rows["source"], "size", "source_size", "target", block.alias("block"), place.alias("place"))
    known = cut_lineage(known)
    blocks = known.groupBy("source", "block").agg(
        F.sum("size").alias("words"), F.first("source_size").alias("source_size"), F.first("target").alias("target"))
    # Draw order: whole passes first, then blocks in permuted order up to the quota; each is one draw.
    order = Window.partitionBy("source").orderBy(F.xxhash64("block", F.lit(seed + 1)), "block")
    blocks = blocks.where("words > 0").select(
        "source", "block", "words", F.row_number().over(order).alias("nth"),
        F.count("*").over(Window.partitionBy("source")).alias("n"),
        (F.sum("words").over(order) - F.col("words")).alias("before"), F.col("source_size"),
        F.floor(F.col("target") / F.col("source_size")).cast("long").alias("full"), "target")
    need = F.round(F.col("target") - F.col("full") * F.col("source_size")).cast("long") - F.col("before")
    blocks = cut_lineage(blocks.withColumn("need", need))
    partly = blocks.where("need > 0 AND need < words").select("source", "block", "need")
    picks = known.where("size > 0").withColumnRenamed("source", "s").withColumnRenamed("block", "b").join(
        partly, F.col("s").eqNullSafe(F.col("source")) & (F.col("b") == F.col("block"))).select(
        "source", "block", "need", ROW, "size", "place")
    picks = picks.groupBy("source", "block").applyInPandas(_fill, "source string, block long, place long, row long, later array<long>")
    # pass < full: the whole block; pass = full: the permuted part.
    passes = F.explode(F.sequence(F.lit(0), F.col("full").cast("int")))
    draws = blocks.select("source", "block", "nth", "n", "full", "need", "words", passes.alias("pass"))
    draws = draws.where("pass < full OR need > 0").select(
        "source", "block", "pass", (F.col("pass") * F.col("n") + F.col("nth") - 1).alias("at"),
        (F.col("pass").eqNullSafe(F.col("full")) & (F.col("need") < F.col("words"))).alias("part"))
    quotas = draws.groupBy("source").agg(F.count("*").alias("quota"), F.lit(0).alias("tree"))

    def tree(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("source", na_position="last", kind="stable")
        names, end, parts = pdf["source"].to_numpy(dtype=object), np.zeros(len(pdf), np.int64), []
        for shard, who, have in split_leaves(pdf["quota"].to_numpy(), shards, seed):
            end[who] += have
            parts.append((names[who], np.full(len(who), shard), end[who] - have, end[who]))
        return pd.DataFrame(dict(zip(("source", "shard", "lo", "hi"), map(np.concatenate, zip(*parts)))))

    ranges = quotas.groupBy("tree").applyInPandas(tree, "source string, shard int, lo long, hi long")
    dealt = ranges.select(F.col("source").alias("s"), "shard", F.explode(F.sequence("lo", F.col("hi") - 1)).alias("k"))
    draws = draws.join(dealt, F.col("s").eqNullSafe(F.col("source")) & (F.col("k") == F.col("at")))
    draws = draws.groupBy("source", "block").agg(F.collect_list(F.struct("shard", "pass", "part")).alias("draws"))
    draws = draws.alias("d").join(picks.alias("p"), F.expr("d.source <=> p.source AND d.block = p.block"), "left")
    draws = cut_lineage(draws.select(
        "d.source", "d.block", "draws", F.struct("p.place", "p.row", "p.later").alias("cut"))).alias("d")
    out = known.alias("k").join(draws, F.expr("k.source <=> d.source AND k.block = d.block"), "left")
    inside = (F.struct("place", ROW) <= F.struct("cut.place", "cut.row")) | F.array_contains("cut.later", F.col(ROW))
    mine = F.when(F.col("size") > 0, F.filter("draws", lambda x: ~x["part"] | F.coalesce(inside, F.lit(False))))
    return out.select(F.col("id").alias(id_col), ROW, "size", "source_size", "target", "place",
                      F.coalesce(mine, F.array().cast(DRAWS)).alias("draws")), shards


def mix(df: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", seed: int = 0) -> DataFrame:
    """(id, size, source_size, target, taken) per row.

    ``size`` counts runs without ASCII white space (null text: 0), ``taken`` the words that the mix takes of the
    row: 0, 1 or 2 times its size. A source's taken words miss its target by less than the smallest document that
    its last block left out. Rows without words take nothing; a null source is a source of its own; ids may be
    null or repeat. Reruns agree under any split of the input: which of several equal rows is drawn is the only
    thing left to chance. An empty table gives an empty result.
    """
    out, _ = mixed(with_row(df.select(id_col, source_col, text_col)), id_col, source_col, text_col, seed=seed)
    return out.select(id_col, "size", "source_size", F.coalesce("target", F.lit(0.0)).alias("target"),
                      (F.size("draws") * F.col("size")).alias("taken"))


def mixture(df: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text",
            shards: int | None = None, seed: int = 0) -> DataFrame:
    """The mix itself: rows of ``df`` with their columns, repeated as drawn, dealt to shards and shuffled there."""
    rows = with_row(df)
    drawn, shards = mixed(rows, id_col, source_col, text_col, shards, seed)
    drawn = drawn.where(F.size("draws") > 0).select(ROW, "draws", "place")
    body = rows.select(ROW, F.struct(*df.columns).alias("body")).join(drawn, ROW)
    body = body.select("place", "body", F.explode("draws").alias("draw")).repartition(shards, "draw.shard")
    local = F.xxhash64("place", "draw.pass", F.lit(seed + 2))
    return body.sortWithinPartitions("draw.shard", local).select("body.*")
