"""Two-sided table comparison by key and canonical row hash."""

from __future__ import annotations

import math
from collections.abc import Sequence
from datetime import timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.canon import ColumnRule, row_hash, rules_from_schema
from tidemark.operators.windows import as_col, inside
from tidemark.session import materialised


#: The numbers of differing buckets are broadcast: 8 bytes each.
MOST_BUCKETS = 1 << 20


def hashed(df: DataFrame, pk: Sequence[str], rules: Sequence[ColumnRule] | None = None,
           carry: Sequence[str] = ()) -> DataFrame:
    """Key, carried columns and row hash: all that has to be shuffled for a comparison."""
    rules = rules or rules_from_schema(df.schema)
    return df.select(*pk, *carry, row_hash(rules).alias("row_hash"))


def _digests(df: DataFrame, pk: Sequence[str], rules: Sequence[ColumnRule] | None, name: str,
             carry: Sequence[str] = ()) -> DataFrame:
    """Like :func:`hashed` with the hash as 32 bytes: half the text form in the shuffle."""
    rules = rules or rules_from_schema(df.schema)
    return df.select(*pk, *carry, F.unhex(row_hash(rules)).alias(name))


def _side(df: DataFrame, pk: Sequence[str], rules: Sequence[ColumnRule] | None, side: str,
          carry: Sequence[str] = ()) -> DataFrame:
    """One row per key: its hash, how many rows have it, and the largest carried values.

    The count keeps repeated keys from multiplying in the join; copies of one key combine before the shuffle.
    """
    rows = _digests(df, pk, rules, f"{side}_hash", carry)
    return rows.groupBy(*pk).agg(
        F.min(f"{side}_hash").alias(f"{side}_hash"), F.count(F.lit(1)).alias(f"{side}_rows"),
        *[F.max(c).alias(c) for c in carry])


def _matched(s: DataFrame, t: DataFrame, pk: Sequence[str]) -> DataFrame:
    """Full join of two sides with their difference.

    A key with a NULL part names no row and a repeated key names several: both are findings of their own.
    """
    null_key = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in pk])
    counts = {c: F.coalesce(c, F.lit(0)).cast("bigint") for c in ("source_rows", "target_rows")}
    return s.join(t, list(pk), "full_outer").withColumns(counts).withColumn(
        "difference",
        F.when(null_key, "NULL_KEY").when((F.col("source_rows") > 1) | (F.col("target_rows") > 1), "DUPLICATE_KEY")
        .when(F.col("target_rows") == 0, "MISSING").when(F.col("source_rows") == 0, "EXTRA")
        .when(F.col("source_hash").isNull() | F.col("target_hash").isNull(), "UNCOMPARED")
        .when(F.col("source_hash") != F.col("target_hash"), "HASH_MISMATCH"))


def _hex_hashes(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.lower(F.hex(c)) for c in ("source_hash", "target_hash")})


DIGEST = ["n", "unhashed", *[f"w{i}" for i in range(8)]]


def _summed(rows: DataFrame, by: str) -> DataFrame:
    """Row counts and summed words of the hash ``_h`` per group; combines before the shuffle."""
    words = [
        F.sum(F.conv(F.substring("_h", 1 + 8 * i, 8), 16, 10).cast("bigint")).alias(f"w{i}") for i in range(8)]
    return rows.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("_h").isNull()).alias("unhashed"), *words)


def _differing(s: DataFrame, t: DataFrame, by: str) -> DataFrame:
    """Groups whose digests differ or hide rows without a hash, with the larger row count of both sides."""
    both = s.select(by, F.struct(*DIGEST).alias("_s")).join(t.select(by, F.struct(*DIGEST).alias("_t")), by, "full_outer")
    hidden = F.coalesce(F.col("_s.unhashed") + F.col("_t.unhashed") > 0, F.lit(False))
    return both.where(~F.col("_s").eqNullSafe(F.col("_t")) | hidden).select(by, F.greatest("_s.n", "_t.n").alias("n"))


def bucket_digests(df: DataFrame, pk: Sequence[str], rules: Sequence[ColumnRule] | None, buckets: int) -> DataFrame:
    """Row count and summed hash words per key bucket."""
    return _summed(df.select(
        F.pmod(F.xxhash64(*pk), F.lit(buckets)).alias("bucket"),
        row_hash(rules or rules_from_schema(df.schema)).alias("_h")), "bucket")


def differing_buckets(src: DataFrame, tgt: DataFrame, pk: Sequence[str],
                      rules: Sequence[ColumnRule] | None, buckets: int) -> DataFrame:
    """Buckets whose contents are not the same on both sides: at most ``buckets`` rows."""
    return _differing(bucket_digests(src, pk, rules, buckets), bucket_digests(tgt, pk, rules, buckets), "bucket").select("bucket")


def _node(pk: Sequence[str], bits: int) -> Column:
    """Node of a row's key in the digest tree: the first ``bits`` bits of the key's hash."""
    return F.shiftrightunsigned(F.xxhash64(*pk), 64 - bits)


def differing_leaves(src: DataFrame, tgt: DataFrame, pk: Sequence[str], rules: Sequence[ColumnRule] | None = None,
                     bits: int = 10, leaf_rows: int = 1000) -> tuple[DataFrame | None, int]:
    """((node, n) of the leaves that differ, bits of a leaf) of a tree of key-range digests; None if nothing differs.

    The first level sums all rows into 2^bits nodes. Each further level splits the nodes that differ, and only their
    rows are hashed again. It ends when a node has about ``leaf_rows`` rows. Where most rows of the level above lie in
    differing nodes, each may hold a single difference: one more pass splits them to about ``leaf_rows`` at once, and
    is kept unless most rows differ there too. Only digests are shuffled, a node per input partition at most.
    """
    rules, depth, bad, before = rules or rules_from_schema(src.schema), 0, None, None
    step, last = bits, False
    while True:
        above, depth = (bad, depth), depth + step
        sides = []
        for df in (src, tgt):
            rows = df if bad is None else within(df, pk, bad, depth - step)
            sides.append(_summed(rows.select(_node(pk, depth).alias("node"), row_hash(rules).alias("_h")), "node"))
        bad = materialised(_differing(*sides, "node"), "digests")
        nodes, rows = bad.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        if not nodes:
            return None, depth
        if last:
            return above if 2 * rows > before else (bad, depth)
        if rows <= leaf_rows * nodes or depth + bits > 60:
            return bad, depth
        if before is not None and 2 * rows > before:
            last, step = True, min(60 - depth, max(bits, math.ceil(math.log2(rows / (leaf_rows * nodes)))))
        before = rows


def within(df: DataFrame, pk: Sequence[str], nodes: DataFrame, bits: int) -> DataFrame:
    """Rows whose key lies in one of the nodes, which Spark broadcasts by their size."""
    return df.withColumn("_node", _node(pk, bits)).join(nodes.select(F.col("node").alias("_node")), "_node", "left_semi").drop("_node")


def compare_tree(src: DataFrame, tgt: DataFrame, pk: Sequence[str], rules: Sequence[ColumnRule] | None = None,
                 bits: int = 10, leaf_rows: int = 1000) -> DataFrame:
    """The findings of :func:`compare_exact`, reading by key only the leaves of a digest tree that differ.

    The tree has as many levels as the tables need, so there is no limit on its leaves. Equal tables end after one level.
    """
    rules = rules or rules_from_schema(src.schema)
    leaves, depth = differing_leaves(src, tgt, pk, rules, bits, leaf_rows)
    if leaves is None:
        src, tgt = src.where("false"), tgt.where("false")
    else:
        src, tgt = within(src, pk, leaves, depth), within(tgt, pk, leaves, depth)
    return compare_exact(src, tgt, pk, rules)


def compare_exact(src: DataFrame, tgt: DataFrame, pk: Sequence[str],
                  rules: Sequence[ColumnRule] | None = None, buckets: int | None = None) -> DataFrame:
    """Keys that differ: MISSING (source only), EXTRA (target only), HASH_MISMATCH, or UNCOMPARED where a row has
    a number that does not fit its rule.

    DUPLICATE_KEY (with the row counts of both sides) and NULL_KEY rows cannot be compared by key and are
    reported instead. With ``buckets`` both sides are first reduced to one digest per key bucket, and only rows of
    differing buckets are shuffled: for tables expected to be equal, next to nothing is.
    """
    if buckets is not None:
        if buckets > MOST_BUCKETS:
            raise ValueError(f"{buckets} buckets exceed the limit of {MOST_BUCKETS}")
        bad = F.broadcast(differing_buckets(src, tgt, pk, rules, buckets))
        pick = lambda df: df.withColumn("bucket", F.pmod(F.xxhash64(*pk), F.lit(buckets))).join(
            bad, "bucket", "left_semi").drop("bucket")
        rules = rules or rules_from_schema(src.schema)
        src, tgt = pick(src), pick(tgt)
    found = _matched(_side(src, pk, rules, "source"), _side(tgt, pk, rules, "target"), pk)
    return _hex_hashes(found.where(F.col("difference").isNotNull()))


def cell_diff(src: DataFrame, tgt: DataFrame, pk: Sequence[str], cols: Sequence[str],
              keys: DataFrame | None = None) -> DataFrame:
    """(key, column, source_value, target_value) of differing cells, for ``keys`` or all common keys."""
    s, t = src, tgt
    if keys is not None:
        s = s.join(keys.select(*pk), list(pk), "left_semi")
        t = t.join(keys.select(*pk), list(pk), "left_semi")
    s = s.select(*pk, *[F.col(c).alias(f"_s_{c}") for c in cols])
    t = t.select(*pk, *[F.col(c).alias(f"_t_{c}") for c in cols])
    cells = F.array_compact(F.array(*[
        F.when(~F.col(f"_s_{c}").eqNullSafe(F.col(f"_t_{c}")), F.struct(
            F.lit(c).alias("column_name"),
            F.col(f"_s_{c}").cast("string").alias("source_value"),
            F.col(f"_t_{c}").cast("string").alias("target_value")))
        for c in cols]))
    return s.join(t, list(pk)).select(*pk, F.explode(cells).alias("_cell")).select(*pk, "_cell.*")


def compare_settled(
    src: DataFrame, tgt: DataFrame, pk: Sequence[str], wm: str, settled_before, now, delete_slo: timedelta,
    rules: Sequence[ColumnRule] | None = None,
) -> DataFrame:
    """Differences in the settled region (watermark below ``settled_before``).

    An extra row is explained while it is younger than the delete-lag SLO; a missing row never is.
    """
    bound = as_col(settled_before)
    rules = rules or rules_from_schema(src.schema)
    s = _side(src.where(F.col(wm) < bound), pk, rules, "source")
    t = _side(tgt.where(F.col(wm) < bound), pk, rules, "target", [wm])
    young = F.col(wm) >= as_col(now) - F.lit(delete_slo)
    return _hex_hashes(
        _matched(s, t, pk).where(F.col("difference").isNotNull())
        .withColumn("is_explained", (F.col("difference") == "EXTRA") & F.coalesce(young, F.lit(False))).drop(wm))


def classify_differences(diffs: DataFrame, explanations: DataFrame, uncompared: DataFrame,
                         pk: Sequence[str]) -> DataFrame:
    """Counts of explained, unexplained and uncompared keys, each by reason.

    ``explanations``: pk, reason (DELETE, PRE_AUDIT_GAP, ACCEPTED), one per key. ``uncompared``:
    pk, reason. A key that could not be compared is never counted as explained.
    """
    marked = diffs.select(*pk).join(uncompared.select(*pk), list(pk), "left_anti")
    judged = marked.join(explanations.select(*pk, "reason"), list(pk), "left").select(
        F.when(F.col("reason").isNotNull(), "EXPLAINED").otherwise("UNEXPLAINED").alias("class"),
        F.coalesce("reason", F.lit("NONE")).alias("reason"))
    skipped = uncompared.select(F.lit("UNCOMPARED").alias("class"), "reason")
    return judged.unionByName(skipped).groupBy("class", "reason").agg(
        F.count(F.lit(1)).alias("key_count"))


def excluded_columns(columns: DataFrame) -> DataFrame:
    """(job_id, column_name) left out of the hash. ``columns``: job_id, column_name, hash_participation."""
    return columns.where(F.col("hash_participation") == "EXCLUDED").select("job_id", "column_name").distinct()


def uncompared_jobs(columns: DataFrame) -> DataFrame:
    """Per job the number of columns left out of the hash. Jobs with any leave the strict sample."""
    out = F.col("hash_participation") == "EXCLUDED"
    return columns.groupBy("job_id").agg(
        F.count(F.lit(1)).alias("column_count"),
        F.count_if(out).alias("excluded_count"),
        F.min(F.when(out, F.col("column_name"))).alias("first_excluded"),
    ).withColumn("in_strict_sample", F.col("excluded_count") == 0)


def census_diff(c1: DataFrame, c2: DataFrame, pk: Sequence[str], method: str = "FULL_HASH", mod: int = 5) -> DataFrame:
    """Changes between two censuses (pk, h): PK_ONLY, SAMPLE_HASH (``pk % mod = 0``) or FULL_HASH.

    PK_ONLY misses reused keys and SAMPLE_HASH those outside its sample. A row created and deleted
    between the two pictures is in neither and cannot be found by any method.
    """
    if method == "PK_ONLY":
        gone = c1.select(*pk).join(c2.select(*pk), list(pk), "left_anti").withColumn("change", F.lit("GONE"))
        new = c2.select(*pk).join(c1.select(*pk), list(pk), "left_anti").withColumn("change", F.lit("NEW"))
        return gone.unionByName(new)
    a = c1.select(*pk, F.col("h").alias("_h1"), F.lit(True).alias("_a"))
    b = c2.select(*pk, F.col("h").alias("_h2"), F.lit(True).alias("_b"))
    if method == "SAMPLE_HASH":
        pick = reduce(lambda x, y: x & y, [F.pmod(F.col(c), F.lit(mod)) == 0 for c in pk])
        a, b = a.where(pick), b.where(pick)
        joined = a.join(b, list(pk), "inner")
    elif method == "FULL_HASH":
        joined = a.join(b, list(pk), "full_outer")
    else:
        raise ValueError(f"unknown method {method!r}")
    change = (
        F.when(F.col("_b").isNull(), "GONE").when(F.col("_a").isNull(), "NEW")
        .when(~F.col("_h1").eqNullSafe(F.col("_h2")), "REUSED_OR_CHANGED"))
    return joined.select(*pk, change.alias("change")).where(F.col("change").isNotNull())


def partition_skew(reads: DataFrame, expected: DataFrame, pk: Sequence[str]) -> DataFrame:
    """Keys read more than once or never across partitioned reads."""
    counted = reads.groupBy(*pk).agg(F.count(F.lit(1)).alias("read_count"))
    many = counted.where("read_count > 1").withColumn("finding", F.lit("READ_TWICE"))
    never = (
        expected.select(*pk).join(reads.select(*pk), list(pk), "left_anti")
        .withColumn("read_count", F.lit(0).cast("bigint")).withColumn("finding", F.lit("NEVER_READ")))
    return many.unionByName(never)


def staging_residue(src: DataFrame, staged: DataFrame, manifest: DataFrame, part: str) -> DataFrame:
    """Source, staged and manifest row counts per partition, and what that says about the stage.

    ``manifest``: part, status, rows_written.
    """
    tagged = src.select(part, F.lit(1).alias("_s"), F.lit(0).alias("_g")).unionByName(
        staged.select(part, F.lit(0).alias("_s"), F.lit(1).alias("_g")))
    counts = tagged.groupBy(part).agg(
        F.sum("_s").cast("bigint").alias("source_rows"), F.sum("_g").cast("bigint").alias("staged_rows"))
    sealed = F.col("status") == "SEALED"
    state = (
        F.when(F.col("status").isNull(), "NOT_STAGED")
        .when(~sealed, "UNSEALED")
        .when(F.col("rows_written") != F.col("staged_rows"), "MANIFEST_MISMATCH")
        .when(F.col("staged_rows") < F.col("source_rows"), "SHORT")
        .otherwise("COMPLETE"))
    return counts.join(manifest.select(part, "status", "rows_written"), part, "full_outer").withColumn(
        "stage_state", state)


def staging_lost(src: DataFrame, staged: DataFrame, manifest: DataFrame, sink: DataFrame,
                 part: str, pk: Sequence[str]) -> DataFrame:
    """Keys that resuming after the last started partition loses: staged by nobody, published nowhere."""
    started = manifest.select(part)
    return (
        src.select(part, *pk).join(started, part, "left_semi")
        .join(staged.select(*pk), list(pk), "left_anti")
        .join(sink.select(*pk), list(pk), "left_anti"))


def compare_overlap(src: DataFrame, tgt: DataFrame, pk: Sequence[str], wm: str, extract_low, original_low,
                    rules: Sequence[ColumnRule] | None = None) -> DataFrame:
    """The exact comparison on the overlap slice ``[extract_low, original_low)`` only."""
    return compare_exact(
        src.where(inside(wm, extract_low, original_low)), tgt.where(inside(wm, extract_low, original_low)),
        pk, rules)
