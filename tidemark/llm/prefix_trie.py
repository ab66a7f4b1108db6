"""Conversation prefix trie by Spark SQL ROLLUP over positional turn-id columns.

A conversation's turns are laid out as columns ``t1 … t8``, so that ``ROLLUP(t1, …, t8)`` aggregates every prefix of
every conversation at once: a node of the trie is one group, and grouping_id tells its level. Conversations of more
than eight turns continue in further blocks of eight columns, grouped by the prior block's node as well. A second
ROLLUP over the nodes themselves sums up subtrees; totals of later blocks reach it by pointer doubling over the
blocks, which takes the logarithm of the longest conversation in rounds.

A turn id is 128 bits of the SHA-256 of role and text; the node of a prefix is keyed by its depth and 128 bits that
hash (position, turn id) pairs, so keys of any depth come from one prefix sum per conversation.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import shared_table, text_or_empty
from tidemark.operators.ordered import BIN, HEAVY, with_bins
from tidemark.session import cut_lineage

#: Turn columns of a block.
WIDTH = 8
#: Turns of a conversation, blocks of a conversation, and ids below a node that one group holds at most.
CHUNK = 4096
#: Nodes with more children than this are matched with them in so many pieces.
WIDE, PIECES = 1024, 64
KEY = ["depth", "s1", "s2"]


def numbered_turns(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                   text_col: str = "text", bins: int | None = None) -> DataFrame:
    """(conv_id, pos, t): the turns of each conversation from 1, by turn (null first), then by their digest.

    ``t`` is (id, words). Null roles and texts count as empty; rows without a conversation id belong to none.
    Conversations too large for one task are numbered in ``bins``.
    """
    role, text = text_or_empty(role_col), text_or_empty(text_col)
    digest = F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)
    rows = df.where(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), digest.alias("digest"),
        F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words"))
    # The first 60 bits of the digest order like the digest and cut a turn number that fills a bin by itself.
    rows = rows.withColumn("tie", F.conv(F.substring("digest", 1, 15), 16, 10).cast("long"))
    binned = with_bins(rows, ["conv_id"], "turn", bins, "tie")
    order = [F.col("turn").asc_nulls_first(), F.col("digest")]
    local = binned.withColumn("pos", F.row_number().over(Window.partitionBy("conv_id", BIN).orderBy(*order)).cast("long"))
    sizes = binned.where(HEAVY).groupBy("conv_id", BIN).agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("conv_id").orderBy(BIN).rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select("conv_id", BIN, before.alias("before"))
    turn = F.struct(F.substring(F.unhex("digest"), 1, 16).alias("id"), "words")
    return local.join(offsets, ["conv_id", BIN], "left").select(
        "conv_id", (F.col("pos") + F.coalesce("before", F.lit(0))).alias("pos"), turn.alias("t"))


def spliced(turns: DataFrame, every: int = 20, heads: int = 4) -> tuple[DataFrame, DataFrame]:
    """(turns, conversations) with shared beginnings: (conv_id, pos, t) and (conv_id, n) of every conversation.

    Conversation c starts with the first h turns of conversation c - c % every (all if fewer, none if absent) and
    goes on with its own turns after its first h, where h = crc32(c as decimal text) % heads.
    """
    own = turns.groupBy("conv_id").agg(F.count("*").alias("n_own"))
    base = (F.col("conv_id") - F.col("conv_id") % every).alias("base")
    own = own.select("conv_id", "n_own", base, (F.crc32(F.col("conv_id").cast("string")) % heads).alias("h"))
    bases = own.where("conv_id = base").select(F.col("base"), F.col("n_own").alias("n_base"))
    kept = F.least("h", F.coalesce("n_base", F.lit(0)))
    convs = own.join(bases, "base", "left").select("conv_id", "base", "h", "n_own", kept.alias("k"))
    convs = cut_lineage(convs.withColumn("n", F.col("k") + F.greatest(F.col("n_own") - F.col("h"), F.lit(0))))
    first = turns.where(F.col("conv_id") % every == 0).where(F.col("pos") < heads)
    first = first.select(F.col("conv_id").alias("base"), "pos", "t")
    shared = convs.join(first, "base").where("pos <= k").select("conv_id", "pos", "t")
    # A conversation's facts meet its turns chunk by chunk, so that none needs one task for all its turns.
    chunk = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n_own") - 1) / CHUNK)))
    facts = convs.where("n_own > h").select("conv_id", "h", "k", chunk.alias("chunk"))
    rest = turns.withColumn("chunk", F.floor((F.col("pos") - 1) / CHUNK)).join(facts, ["conv_id", "chunk"]).where("pos > h")
    rest = rest.select("conv_id", (F.col("pos") - F.col("h") + F.col("k")).alias("pos"), "t")
    return shared.unionAll(rest), convs.select("conv_id", "n")


def _mark(pos: Column, t: str, seed: int) -> Column:
    return F.xxhash64(pos, F.col(t)["id"], F.lit(seed))


def _blocks(turns: DataFrame, convs: DataFrame, width: int) -> DataFrame:
    """(conv_id, n, block, p1, p2, t1…): one row per conversation and block; p1 and p2 key the node before it."""
    block = F.floor((F.col("pos") - 1) / width)
    slots = turns.groupBy("conv_id", block.alias("block")).agg(
        F.sort_array(F.collect_list(F.struct("pos", "t"))).alias("slots"),
        *(F.bit_xor(_mark(F.col("pos"), "t", s)).alias(f"x{s}") for s in (1, 2)))
    # Keys before each block: exclusive running XOR, within pieces of blocks and across the pieces.
    slots = slots.withColumn("piece", F.floor(F.col("block") / CHUNK))
    inner = Window.partitionBy("conv_id", "piece").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    outer = Window.partitionBy("conv_id").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    long = slots.where((F.col("block") % CHUNK == CHUNK - 1)).select("conv_id", "piece").distinct()
    tails = slots.join(long, ["conv_id", "piece"], "left_semi").groupBy("conv_id", "piece").agg(
        F.bit_xor("x1").alias("x1"), F.bit_xor("x2").alias("x2"))
    tails = tails.select("conv_id", (F.col("piece") + 1).alias("piece"),
                         *(F.bit_xor(f"x{s}").over(outer.rowsBetween(Window.unboundedPreceding, 0)).alias(f"o{s}") for s in (1, 2)))
    slots = slots.select("conv_id", "block", "piece", "slots", *(F.bit_xor(f"x{s}").over(inner).alias(f"i{s}") for s in (1, 2)))
    slots = slots.join(tails, ["conv_id", "piece"], "left")
    zero = F.lit(0).cast("long")
    keys = [F.coalesce(f"i{s}", zero).bitwiseXOR(F.coalesce(f"o{s}", zero)).alias(f"p{s}") for s in (1, 2)]
    cols = [F.get("slots", F.lit(i))["t"].alias(f"t{i + 1}") for i in range(width)]
    filled = slots.select("conv_id", "block", *keys, *cols)
    kind = turns.schema["t"].dataType
    blank = convs.where("n = 0").select(
        "conv_id", zero.alias("block"), zero.alias("p1"), zero.alias("p2"), *(F.lit(None).cast(kind).alias(f"t{i + 1}") for i in range(width)))
    return filled.unionAll(blank)


def _rollup(rows: DataFrame, width: int, measures: str) -> DataFrame:
    """Groups of all prefixes within a block: (block, p1, p2, level, t1…, measures)."""
    cols = ", ".join(f"t{i + 1}" for i in range(width))
    out = rows.sparkSession.sql(
        f"SELECT block, p1, p2, {cols}, {width} - bit_count(grouping_id()) AS level, {measures} "
        f"FROM {{rows}} GROUP BY block, p1, p2, ROLLUP({cols})", rows=rows)
    # A group whose last column is empty repeats a shorter prefix, and level 0 of a later block its key's node.
    last = F.element_at(F.array(*(F.col(f"t{i + 1}").isNotNull() for i in range(width))), F.greatest(F.col("level"), F.lit(1)))
    return out.where(F.when(F.col("level") == 0, F.col("block") == 0).otherwise(last))


def _node_key(width: int, level: Column, s: int) -> Column:
    key = F.col(f"p{s}")
    for i in range(width):
        mark = _mark(F.col("block") * width + i + 1, f"t{i + 1}", s)
        key = key.bitwiseXOR(F.when(level > i, mark).otherwise(F.lit(0).cast("long")))
    return key


def _later_totals(groups: DataFrame) -> DataFrame:
    """(block, p1, p2, leaves, saved) of whole block groups with all later ones, by pointer doubling.

    ``groups`` has (block, p1, p2, leaves, saved, up): sums of the group's own nodes and the key of the group that
    holds the node it continues (null for the first block).
    """
    state = cut_lineage(groups.select(F.struct("block", "p1", "p2").alias("me"), "up", "leaves", "saved"))
    while not state.where("up IS NOT NULL").isEmpty():
        given = state.where("up IS NOT NULL").groupBy(F.col("up").alias("me")).agg(
            F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"))
        jump = state.select(F.col("me").alias("up"), F.col("up").alias("next"))
        state = state.join(given, "me", "left").join(jump, "up", "left")
        state = cut_lineage(state.select(
            "me", F.col("next").alias("up"), (F.col("leaves") + F.coalesce("more_leaves", F.lit(0))).alias("leaves"),
            (F.col("saved") + F.coalesce("more_saved", F.lit(0))).alias("saved")))
    return state.select("me.*", "leaves", "saved")


def _with_parent(nodes: DataFrame) -> DataFrame:
    """Add ``parent_conv_id``. Children of wide nodes meet copies of them piece by piece."""
    up = [F.col(c).alias(f"u_{c}") for c in KEY]
    wide = nodes.where(F.col("n_children") > WIDE).select(
        *up, F.col("conv_id").alias("wide_conv"), F.explode(F.sequence(F.lit(0), F.lit(PIECES - 1))).alias("part"))
    rest = nodes.where(F.col("n_children").between(1, WIDE)).select(*up, F.col("conv_id").alias("rest_conv"))
    rows = nodes.withColumn("part", F.pmod(F.xxhash64("conv_id", *KEY), F.lit(PIECES)).cast("int"))
    on = (F.col("depth") - 1 == F.col("u_depth")) & (F.col("ps1") == F.col("u_s1")) & (F.col("ps2") == F.col("u_s2"))
    rows = rows.join(wide.withColumnRenamed("part", "u_part"), on & (F.col("part") == F.col("u_part")), "left")
    rows = rows.drop("u_depth", "u_s1", "u_s2", "u_part", "part")
    # Rows that are done look for a key of their own, which no node has.
    seek = F.when(F.col("wide_conv").isNull(), F.col("depth") - 1).otherwise(-1 - F.pmod(F.xxhash64("conv_id"), F.lit(1 << 20)))
    rows = rows.withColumn("seek", seek)
    rows = rows.join(rest, (F.col("seek") == F.col("u_depth")) & (F.col("ps1") == F.col("u_s1")) & (F.col("ps2") == F.col("u_s2")), "left")
    return rows.withColumn("parent_conv_id", F.coalesce("wide_conv", "rest_conv"))


def _end_digests(ends: DataFrame) -> DataFrame:
    """(depth, s1, s2, ends_sha256): SHA-256 of the conversations that end at a node, ascending, comma-joined.

    A group gathers the ids of one range of 4,096; the digests stream over the ranges of a node in order.
    """
    ranges = ends.groupBy(*KEY, F.floor(F.col("conv_id") / CHUNK).alias("range")).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda x: x.cast("string")), ",").alias("ids"))
    dealt = ranges.repartition(*KEY).sortWithinPartitions(*KEY, "range")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, kinds = [*KEY, "ends_sha256"], [pa.int64()] * 3 + [pa.string()]
        key, state = None, None
        for b in batches:
            done = []
            for *k, ids in zip(*(b.column(c).to_pylist() for c in (*KEY, "ids"))):
                if k == key:
                    state.update(b"," + ids.encode())
                    continue
                if key is not None:
                    done.append((*key, state.hexdigest()))
                key, state = k, hashlib.sha256(ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in done], t) for i, t in enumerate(kinds)], names)
        if key is not None:
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((*key, state.hexdigest()), kinds)], names)

    return dealt.mapInArrow(hashed, "depth long, s1 long, s2 long, ends_sha256 string")


def prefix_trie(turns: DataFrame, convs: DataFrame, width: int = WIDTH) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    ``turns`` has (conv_id, pos from 1, t: (id, words)), ``convs`` (conv_id, n turns) of every conversation; those
    without turns are members of the root only. A node is named by its depth and its smallest member.
    saved_tokens sums, over the node's subtree, (members - 1) x words of the node's last text. Without
    conversations there is no node.
    """
    blocks = shared_table(_blocks(turns, convs, width), "trie-blocks")
    level = F.col("level")
    nodes = _rollup(blocks, width, "min(conv_id) AS conv_id, count(*) AS n_convs")
    words = F.element_at(F.array(*(F.col(f"t{i + 1}")["words"] for i in range(width))), F.greatest(level, F.lit(1)))
    cols = [f"t{i + 1}" for i in range(width)]
    nodes = nodes.select(
        "block", "p1", "p2", "level", *cols, "conv_id", "n_convs", (F.col("block") * width + level).alias("depth"),
        *(_node_key(width, level, s).alias(f"s{s}") for s in (1, 2)), *(_node_key(width, level - 1, s).alias(f"ps{s}") for s in (1, 2)),
        F.when(level > 0, (F.col("n_convs") - 1) * words).otherwise(F.lit(0)).cast("long").alias("own"))
    nodes = shared_table(nodes, "trie-nodes")
    children = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("ps1").alias("s1"), F.col("ps2").alias("s2")).agg(
        F.count("*").alias("n_children"))
    nodes = nodes.join(children, KEY, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    nodes = nodes.withColumn("leaf", (F.col("n_children") == 0).cast("long"))
    later = nodes.where("block > 0")
    weighed = nodes.withColumn("more_leaves", F.lit(0)).withColumn("more_saved", F.lit(0))
    if not blocks.where("block > 0").isEmpty():
        up = F.when(F.col("block") > 0, F.struct("block", "p1", "p2"))
        hooks = nodes.where((level == width) & (F.col("n_children") > 0)).select(
            (F.col("block") + 1).alias("block"), F.col("s1").alias("p1"), F.col("s2").alias("p2"), up.alias("up"))
        groups = later.groupBy("block", "p1", "p2").agg(F.sum("leaf").alias("leaves"), F.sum("own").alias("saved"))
        totals = _later_totals(groups.join(hooks, ["block", "p1", "p2"])).select(
            F.col("block").alias("g"), F.col("p1").alias("s1"), F.col("p2").alias("s2"), F.col("leaves").alias("more_leaves"),
            F.col("saved").alias("more_saved"))
        ready = F.when(level == width, F.col("block") + 1).alias("g")
        weighed = nodes.select("*", ready).join(totals, ["g", "s1", "s2"], "left")
    weighed = weighed.select(
        "block", "p1", "p2", *cols, "conv_id", (F.col("leaf") + F.coalesce("more_leaves", F.lit(0))).alias("leaves"),
        (F.col("own") + F.coalesce("more_saved", F.lit(0))).alias("saved"))
    subtrees = _rollup(weighed, width, "min(conv_id) AS conv_id, sum(leaves) AS n_leaves, sum(saved) AS saved_tokens").select(
        (F.col("block") * width + level).alias("depth"), "conv_id", "n_leaves", "saved_tokens")
    last = blocks.join(convs, "conv_id").where(F.greatest(F.floor((F.col("n") - 1) / width), F.lit(0)) == F.col("block"))
    ends = last.select("conv_id", F.col("n").alias("depth"), (F.col("n") - F.col("block") * width).alias("level"), "block", "p1", "p2", *cols)
    ends = ends.select("conv_id", "depth", *(_node_key(width, level, s).alias(f"s{s}") for s in (1, 2)))
    out = _with_parent(nodes.select("conv_id", *KEY, "ps1", "ps2", "n_convs", "n_children"))
    out = out.join(subtrees, ["depth", "conv_id"]).join(_end_digests(ends), KEY, "left")
    nothing = hashlib.sha256(b"").hexdigest()
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
                      F.coalesce("ends_sha256", F.lit(nothing)).alias("ends_sha256"))


def conversation_trie(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                      text_col: str = "text", width: int = WIDTH, bins: int | None = None) -> DataFrame:
    """The prefix trie of the conversations of ``df`` rebuilt with shared beginnings (``spliced``).

    Turns go by number, null first, then by the digest of role and text. Null roles and texts are empty; rows
    without a conversation id belong to no conversation; an empty table gives an empty result; other columns are
    not read.
    """
    turns = shared_table(numbered_turns(df, conv_col, turn_col, role_col, text_col, bins), "trie-turns")
    return prefix_trie(*spliced(turns), width)
