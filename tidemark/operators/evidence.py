"""Audits over commit evidence: snapshots, receipts, leases and the commit ledger."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.ordered import Bins, asof_join, next_values, previous_values, running, with_bins
from tidemark.operators.quantiles import exact_percentiles
from tidemark.session import cut_lineage, materialised


#: Rows of a task that shortens or walks chains in memory, 40 bytes each or so.
NEAR_ROWS = 200_000


def _links(rows: pd.DataFrame) -> np.ndarray:
    """Row of every row's parent, or the number of rows if the path stops before it; one more entry for that end itself.

    A path stops where the parent is not among the rows, is recorded more than once, or lies on or below a cycle.
    """
    n = len(rows)
    ids = pd.factorize(pd.concat([rows["snapshot_id"], rows["parent_id"]], ignore_index=True))[0]
    tables = pd.factorize(rows["table_id"])[0].astype(np.int64) * (2 * n)
    own, parent = tables + ids[:n], tables + ids[n:]
    order = np.argsort(own, kind="stable")
    left, right = (np.searchsorted(own[order], parent, side) for side in ("left", "right"))
    single = (right - left == 1) & ~rows["root"].to_numpy(bool)
    up = np.append(np.where(single, order[np.minimum(left, n - 1)], n), n)
    end = up
    for _ in range(n.bit_length()):
        end = end[end]
    endless = end != n
    up[:n][endless[up[:n]]] = n
    return up


def _shorten(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Add to every row of a task the first ancestor beyond the task's rows (``exit_id``) and the steps to it."""
    frames = list(batches)
    if not frames:
        return
    rows = pd.concat(frames, ignore_index=True)
    n, up = len(rows), _links(rows)
    last = np.append(np.where(up[:n] < n, up[:n], np.arange(n)), n)
    steps = np.append((up[:n] < n).astype(np.int64), 0)
    for _ in range(n.bit_length()):
        steps = steps + steps[last]
        last = last[last]
    last, steps = last[:n], steps[:n]
    yield rows.assign(
        near=np.int32(TaskContext.get().partitionId()), exit_id=rows["parent_id"].to_numpy()[last],
        steps=steps + np.where(rows["root"].to_numpy(bool)[last], 0, 1))


def _near(snapshots: DataFrame) -> DataFrame:
    """Snapshots (table_id, snapshot_id, parent_id) in ranges of ``NEAR_ROWS``, each with the range's number ``near``, the first
    ancestor outside of the range and the steps to it. A snapshot without parent (``root``) is its own parent, 0 steps away.

    Where parents are close to their children in the order of ids, few snapshots are such an ancestor; where they are not,
    all may be, and what follows costs as much as it would over all snapshots.
    """
    rows = materialised(snapshots.where("table_id IS NOT NULL AND snapshot_id IS NOT NULL").select(
        "table_id", "snapshot_id", F.coalesce("parent_id", "snapshot_id").alias("parent_id"), F.col("parent_id").isNull().alias("root")))
    ranges = rows.repartitionByRange(1 + rows.count() // NEAR_ROWS, "table_id", "snapshot_id")
    kind = rows.schema["parent_id"].dataType
    schema = T.StructType([*rows.schema, T.StructField("near", T.IntegerType()), T.StructField("exit_id", kind), T.StructField("steps", T.LongType())])
    return materialised(ranges.mapInPandas(_shorten, schema))


def _rows_of(rows: pd.DataFrame, asked: pd.DataFrame, by: str) -> pd.DataFrame:
    """``asked`` with the number of every row (``_at``) whose snapshot its column ``by`` names."""
    named = rows[["table_id", "snapshot_id"]].rename(columns={"snapshot_id": by})
    return asked.merge(named.assign(_at=np.arange(len(rows))), on=["table_id", by])


def _walk(rows: pd.DataFrame, starts: pd.DataFrame) -> pd.DataFrame:
    """What lies between each start and its exit, with the depth."""
    up, n, found, depths = _links(rows).tolist(), len(rows), [], []
    starts = _rows_of(rows, starts, "snapshot_id")
    for at, depth in zip(starts["_at"].tolist(), starts["depth"].tolist()):
        at = up[at]
        while at < n:
            depth += 1
            found.append(at)
            depths.append(depth)
            at = up[at]
    return rows[["table_id", "snapshot_id"]].iloc[found].assign(depth=np.array(depths, np.int64))


def _lifted(rows: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
    """The questions (at, left, snapshot_id) whose snapshot lies ``left`` steps above ``at``."""
    up = _links(rows)
    asked = _rows_of(rows, asked, "at")
    at, left = asked["_at"].to_numpy(), asked["left"].to_numpy().copy()
    far = left >= len(rows)
    while left.any():
        at = np.where(left & 1 == 1, up[at], at)
        left >>= 1
        up = up[up]
    ids = rows["snapshot_id"].to_numpy()
    hit = ~far & (at < len(rows))
    hit[hit] = ids[at[hit]] == asked["snapshot_id"].to_numpy()[hit]
    return asked.loc[hit, ["table_id", "snapshot_id", "head_id"]]


def ancestry(snapshots: DataFrame, heads: DataFrame, bases: DataFrame | None = None) -> DataFrame:
    """Snapshots on the parent chain from each table's head down to (not including) its base.

    ``snapshots``: table_id, snapshot_id, parent_id. ``heads``/``bases``: table_id, snapshot_id.
    Chains are first shortened to the snapshots at which they pass from one range of ids to another. These are walked by
    pointer doubling: round k adds those up to 2^k steps away. What lies between is listed range by range.
    """
    id_ = ["table_id", "snapshot_id"]
    jump = snapshots.select(*id_, "parent_id")
    if bases is not None:
        # A base ends the chain: nothing may jump across it.
        stop = bases.select("table_id", F.col("snapshot_id").alias("parent_id"), F.lit(True).alias("_stop"))
        jump = jump.join(stop, ["table_id", "parent_id"], "left").select(
            *id_, F.when(F.col("_stop").isNull(), F.col("parent_id")).alias("parent_id"))
    near = _near(jump.where(F.col("parent_id").isNotNull()))
    start = heads.select(*id_, F.lit(0).cast("bigint").alias("depth"))
    if bases is not None:
        start = start.join(bases.select(*id_), id_, "left_anti")
    reached = cut_lineage(start)
    stations = near.select("table_id", F.col("exit_id").alias("snapshot_id")).unionByName(reached.select(*id_)).distinct()
    edges = materialised(near.join(materialised(stations), id_, "left_semi"))
    jump = edges.select(*id_, F.col("exit_id").alias("parent_id"), "steps")
    longest = jump.count()
    stride = 1
    while True:
        step = cut_lineage(reached.join(jump, id_).select(
            "table_id", F.col("parent_id").alias("snapshot_id"), (F.col("depth") + F.col("steps")).alias("depth")))
        if step.isEmpty():
            break
        if stride > longest:
            raise ValueError("the parent chain has a cycle")
        # Every part of the union is materialised, so the plan grows by one leaf per round only.
        reached = reached.unionByName(step)
        far = jump.select("table_id", F.col("snapshot_id").alias("parent_id"), F.col("parent_id").alias("_far"), F.col("steps").alias("_more"))
        jump = cut_lineage(jump.join(far, ["table_id", "parent_id"]).select(
            *id_, F.col("_far").alias("parent_id"), (F.col("steps") + F.col("_more")).alias("steps")))
        stride *= 2
    starts = reached.join(edges.select(*id_, "near").distinct(), id_)
    columns = near.select(*id_, "parent_id", "root", "near")
    between = columns.groupBy("near").cogroup(starts.groupBy("near")).applyInPandas(_walk, reached.schema)
    return reached.unionByName(between)


def ancestor_pairs(snapshots: DataFrame, pairs: DataFrame) -> DataFrame:
    """The distinct (table_id, snapshot_id, head_id) of ``pairs`` whose snapshot is the head or one of its ancestors.

    ``snapshots``: table_id, snapshot_id, parent_id of what is retained; a parent that is gone ends its chain. Chains are
    shortened as for :func:`ancestry`. Binary lifting over what is left: table k holds the station 2^k stations up. A pair is
    lifted to the last station that is not above its snapshot's depth, all pairs at once; from there the snapshot must be so
    many steps up within one range of ids.
    """
    id_ = ["table_id", "snapshot_id"]
    pairs = materialised(pairs.select(*id_, "head_id").where("snapshot_id IS NOT NULL AND head_id IS NOT NULL").distinct())
    near = _near(snapshots)
    stations = materialised(near.select("table_id", F.col("exit_id").alias("snapshot_id")).distinct())
    # A station that is not retained is the end of its chain, like one without parent.
    edges = materialised(stations.join(near.join(stations, id_, "left_semi"), id_, "left").select(
        *id_, "near", F.coalesce("exit_id", "snapshot_id").alias("up"), F.coalesce("steps", F.lit(0)).cast("bigint").alias("steps")))
    step = edges.drop("near")
    tables, total, n = [], None, None
    while True:
        now, count = step.agg(F.coalesce(F.sum("steps"), F.lit(0)), F.count("*")).first()
        n = n or count
        if now == total:
            break
        if tables and 2 ** (len(tables) - 1) > n:
            raise ValueError("the parent chain has a cycle")
        tables.append(step)
        total = now
        onward = step.select("table_id", F.col("snapshot_id").alias("up"), F.col("up").alias("_far"), F.col("steps").alias("_more"))
        step = materialised(step.join(onward, ["table_id", "up"]).select(
            *id_, F.col("_far").alias("up"), (F.col("steps") + F.col("_more")).alias("steps")))
    below = step.select("table_id", F.col("snapshot_id").alias("exit_id"), F.col("steps").alias("_below"))
    known = near.join(below, ["table_id", "exit_id"]).select(*id_, "near", "exit_id", "steps", (F.col("steps") + F.col("_below")).alias("depth"))
    heads = known.select("table_id", F.col("snapshot_id").alias("head_id"), F.col("near").alias("at_near"), "exit_id", "steps", F.col("depth").alias("_head_depth"))
    at = pairs.join(heads, ["table_id", "head_id"]).join(known.select(*id_, "near", "depth"), id_)
    # ``left``: steps from where the pair stands down to the depth of its snapshot.
    at = at.withColumn("left", F.col("_head_depth") - F.col("depth")).where("left >= 0")
    out = F.col("steps") <= F.col("left")
    at = materialised(at.select(
        *id_, "head_id", "near", F.when(out, F.col("exit_id")).otherwise(F.col("head_id")).alias("at"),
        (F.col("left") - F.when(out, F.col("steps")).otherwise(0)).alias("left"), (~out).alias("_own"), "at_near"))
    for table in reversed(tables):
        lift = table.select("table_id", F.col("snapshot_id").alias("at"), "up", F.col("steps").alias("_steps"))
        fits = ~F.col("_own") & (F.col("_steps") <= F.col("left"))
        at = materialised(at.join(lift, ["table_id", "at"], "left").select(
            *id_, "head_id", "near", F.when(fits, F.col("up")).otherwise(F.col("at")).alias("at"),
            (F.col("left") - F.when(fits, F.col("_steps")).otherwise(0)).alias("left"), "_own", "at_near"))
    there = edges.select("table_id", F.col("snapshot_id").alias("at"), F.col("near").alias("_near")).distinct()
    asked = at.join(there, ["table_id", "at"], "left").where(
        (F.col("left") > 0) & F.when(F.col("_own"), F.col("at_near") == F.col("near")).otherwise(F.col("_near") == F.col("near")))
    asked = asked.select(*id_, "head_id", "near", "at", "left")
    columns = near.select(*id_, "parent_id", "root", "near")
    within = columns.groupBy("near").cogroup(asked.groupBy("near")).applyInPandas(_lifted, pairs.schema)
    same = pairs.where("snapshot_id = head_id")
    met = at.where("left = 0 AND at = snapshot_id").select(*id_, "head_id")
    return within.unionByName(met).unionByName(same).distinct()


def _with_lease(snapshots: DataFrame, leases: DataFrame, parents: DataFrame | None) -> DataFrame:
    """Add ``_leased``: a lease is on record, and was not reclaimed before the snapshot was part of the table."""
    if "reclaimed_head_id" not in leases.columns:
        known = leases.select("lease_id", F.lit(True).alias("_leased")).dropDuplicates(["lease_id"])
        return snapshots.join(known, "lease_id", "left")
    known = leases.groupBy("lease_id").agg(
        F.bool_or(F.col("reclaimed_head_id").isNotNull()).alias("_reclaimed"), F.max("reclaimed_head_id").alias("_head"))
    out = snapshots.join(known, "lease_id", "left")
    reclaimed = out.where("_head IS NOT NULL").select("table_id", "snapshot_id", F.col("_head").alias("head_id"))
    inside = ancestor_pairs(parents if parents is not None else snapshots, reclaimed).select(
        "table_id", "snapshot_id", F.col("head_id").alias("_head"), F.lit(True).alias("_inside"))
    out = out.join(inside, ["table_id", "snapshot_id", "_head"], "left")
    valid = F.when(F.col("_reclaimed").isNull(), F.lit(None)).when(~F.col("_reclaimed") | F.coalesce("_inside", F.lit(False)), F.lit(True))
    return out.withColumn("_leased", valid.cast("boolean")).drop("_reclaimed", "_head", "_inside")


def _expired(contracts: DataFrame, parents: DataFrame) -> DataFrame:
    """Contracts whose base snapshot is no longer on the chain of the head they are judged by."""
    asked = contracts.where(F.col("base_snapshot_id").isNotNull())
    base = asked.select("table_id", F.col("base_snapshot_id").alias("snapshot_id"), F.col("head_snapshot_id").alias("head_id"))
    fine = ancestor_pairs(parents, base).select(
        "table_id", F.col("snapshot_id").alias("base_snapshot_id"), F.col("head_id").alias("head_snapshot_id"))
    # A base that is the head itself must still be retained.
    kept = parents.select("table_id", F.col("snapshot_id").alias("base_snapshot_id"))
    fine = fine.join(kept, ["table_id", "base_snapshot_id"], "left_semi")
    return asked.join(fine, ["table_id", "base_snapshot_id", "head_snapshot_id"], "left_anti").select(
        "contract_id", "attempt_no", F.lit(True).alias("_expired")).distinct()


def adjudicate(
    snapshots: DataFrame, receipts: DataFrame, leases: DataFrame, contracts: DataFrame, parents: DataFrame | None = None,
) -> DataFrame:
    """Verdict per contract attempt from what is provably committed.

    ``contracts``: contract_id, attempt_no, expected_chunks, load_mode, on_empty_source.
    ``snapshots``: snapshot_id, contract_id, attempt_no, chunk_no, writer_kind, lease_id,
    observed_contract_id, observed_attempt_no (whose attempt range the snapshot was found in).
    ``receipts``: contract_id, attempt_no, chunk_no, extracted_rows, committed.
    ``leases``: lease_id of maintenance or repair leases. With ``reclaimed_head_id``, a reclaimed lease covers only
    snapshots that are that head or its ancestors. ``parents`` (table_id, snapshot_id, parent_id) are the retained snapshots;
    with them and table_id, base_snapshot_id, head_snapshot_id in ``contracts``, a base that has expired from the
    head's chain leaves no proof: RECONCILIATION_REQUIRED.
    """
    key = ["contract_id", "attempt_no"]
    service = F.col("writer_kind").isin("maintenance", "repair")
    leased = _with_lease(snapshots, leases, parents)
    counted = leased.where(~(F.coalesce(service, F.lit(False)) & F.col("_leased").isNotNull()))
    own = (
        (F.col("contract_id") == F.col("observed_contract_id"))
        & (F.col("attempt_no") == F.col("observed_attempt_no"))
        & (F.col("writer_kind") == "ingest") & F.col("chunk_no").isNotNull())
    own = F.coalesce(own, F.lit(False))
    facts = counted.select(
        F.col("observed_contract_id").alias("contract_id"), F.col("observed_attempt_no").alias("attempt_no"),
        F.when(own, F.col("chunk_no")).alias("chunk_no"),
        F.when(own, 1).otherwise(0).alias("_snap"), F.lit(0).alias("_zero"),
        F.when(own, 0).otherwise(1).alias("_foreign"))
    zero = receipts.where((F.col("extracted_rows") == 0) & ~F.col("committed")).select(
        *key, "chunk_no", F.lit(0).alias("_snap"), F.lit(1).alias("_zero"), F.lit(0).alias("_foreign"))
    per_chunk = facts.unionByName(zero).groupBy(*key, "chunk_no").agg(
        F.sum("_snap").alias("_snap"), F.max("_zero").alias("_zero"), F.sum("_foreign").alias("_foreign"))
    present = F.col("chunk_no").isNotNull()
    per_attempt = per_chunk.groupBy(*key).agg(
        F.count_if(present).alias("_chunks"),
        F.max("chunk_no").alias("_last"),
        F.min("chunk_no").alias("_first"),
        F.sum("_snap").alias("_snaps"),
        F.max(F.when(present, F.col("_snap") + F.col("_zero"))).alias("_most"),
        F.sum("_foreign").alias("_foreign"))
    zeros = [F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c)
             for c in ("_chunks", "_last", "_snaps", "_most", "_foreign")]
    joined = contracts.join(per_attempt, key, "left").select(*contracts.columns, "_first", *zeros)
    lost = F.lit(False)
    if parents is not None and "base_snapshot_id" in contracts.columns:
        joined, lost = joined.join(_expired(contracts, parents), key, "left"), F.col("_expired").isNotNull()
    prefix = (F.col("_first") == 1) & (F.col("_last") == F.col("_chunks"))
    keeps = F.col("load_mode").isin("APPEND", "MERGE") | (
        F.coalesce(F.col("on_empty_source"), F.lit("FAIL")) == "RETAIN_PREVIOUS")
    verdict = (
        F.when(lost | (F.col("_foreign") > 0) | (F.col("_most") > 1), "RECONCILIATION_REQUIRED")
        .when(F.col("_chunks") == 0, "NO_COMMIT")
        .when(~prefix | (F.col("_last") > F.col("expected_chunks")), "RECONCILIATION_REQUIRED")
        .when(F.col("_chunks") < F.col("expected_chunks"), "PARTIAL_COMMIT")
        .when(F.col("_snaps") > 0, "COMMIT")
        .when(keeps, "FINALIZED_NO_DATA")
        .otherwise("NO_COMMIT(EMPTY_FULL)"))
    return joined.select(
        *contracts.columns, verdict.alias("verdict"),
        F.when(verdict.isin("COMMIT", "PARTIAL_COMMIT", "FINALIZED_NO_DATA"), F.col("_chunks"))
        .otherwise(F.lit(0)).cast("bigint").alias("covered_chunks"))


def duplicate_commits(snapshots: DataFrame, ledger: DataFrame) -> DataFrame:
    """Commit identities seen twice, and ledger rows and snapshots without their counterpart."""
    ident = ["contract_id", "attempt_no", "chunk_no"]
    twice = (
        snapshots.groupBy(*ident).agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")
        .withColumn("finding", F.lit("DUPLICATE_SNAPSHOT")))
    rows = (
        ledger.groupBy(*ident).agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")
        .withColumn("finding", F.lit("DUPLICATE_LEDGER_ROW")))
    applied = ledger.where(F.col("cas_applied") & F.col("committed_snapshot_id").isNotNull())
    link = F.col("committed_snapshot_id") == F.col("snapshot_id")
    one = F.lit(1).cast("bigint").alias("copies")
    lost = applied.join(snapshots.select("snapshot_id"), link, "left_anti").select(
        *ident, one, F.lit("LEDGER_WITHOUT_SNAPSHOT").alias("finding"))
    extra = snapshots.join(applied.select("committed_snapshot_id"), link, "left_anti").select(
        *ident, one, F.lit("SNAPSHOT_WITHOUT_LEDGER").alias("finding"))
    return twice.unionByName(rows).unionByName(lost).unionByName(extra)


def overlap_counts_per_window(
    df: DataFrame, keys: Sequence[str], low: str, high: str, ident: str, bins: Bins = None,
) -> DataFrame:
    """How many earlier-starting intervals of the same key are still open when each one starts.

    A sweep: +1 at each start, -1 at each end, running sum in time order. Every overlapping pair is
    counted at the later start, so nothing grows with the number of pairs. Intervals are half-open;
    equal starts are ordered by ``ident``. ``overlap_with`` names one of the open intervals: the
    earlier one that ends last. A NULL end is open: the interval never ends and sends no -1.
    """
    keys = list(keys)
    real = df.where(F.col(high).isNull() | (F.col(high) > F.col(low)))
    last = F.struct(F.col(high).isNull().alias("open"), F.col(high), F.col(ident))
    row = F.struct(*[F.col(c) for c in df.columns])
    starts = real.select(
        *keys, F.col(low).alias("_at"), F.lit(1).alias("_kind"), F.col(ident).alias("_id"),
        F.lit(1).alias("_delta"), last.alias("_end"), row.alias("_row"))
    ends = real.where(F.col(high).isNotNull()).select(
        *keys, F.col(high).alias("_at"), F.lit(0).alias("_kind"), F.col(ident).alias("_id"),
        F.lit(-1).alias("_delta"))
    events = starts.unionByName(ends, allowMissingColumns=True)
    swept = running(
        events, keys, ["_at", "_kind", "_id"],
        {"_open": ("sum", "_delta"), "_latest": ("max", "_end")}, bins, inclusive=False)
    return swept.where((F.col("_kind") == 1) & (F.col("_open") > 0)).select(
        "_row.*",
        F.col("_open").cast("bigint").alias("overlap_count"),
        F.col(f"_latest.{ident}").alias("overlap_with"))


def overlapping_windows(snapshots: DataFrame, bins: Bins = None) -> DataFrame:
    """Snapshots whose logical window overlaps an earlier one of the same (job, lane)."""
    return overlap_counts_per_window(
        snapshots, ["job_id", "lane"], "window_low", "window_high", "snapshot_id", bins)


def merge_windows(df: DataFrame, keys: Sequence[str], low: str = "window_low", high: str = "window_high",
                  bins: Bins = None) -> DataFrame:
    """Union of touching or overlapping windows per key, as disjoint intervals."""
    keys = list(keys)
    distinct = df.where(F.col(high) > F.col(low)).groupBy(*keys, low).agg(F.max(high).alias(high))
    binned = with_bins(distinct, keys, low, bins)
    reach = running(binned, keys, [low], {"_reach": ("max", high)}, bins, inclusive=False)
    fresh = F.when(F.col("_reach").isNull() | (F.col(low) > F.col("_reach")), 1).otherwise(0)
    islands = running(reach.withColumn("_new", fresh), keys, [low], {"_island": ("sum", "_new")}, bins)
    return (
        islands.groupBy(*keys, "_island").agg(
            F.min(low).alias(low), F.max(high).alias(high), F.count(F.lit(1)).alias("merged_windows"))
        .drop("_island"))


def covered_by(df: DataFrame, merged: DataFrame, keys: Sequence[str], low: str = "window_low",
               high: str = "window_high", bins: Bins = None) -> DataFrame:
    """Add ``is_covered``: does the merged union of the same key contain ``[low, high)``?"""
    cover = merged.select(
        *keys, F.col(low).alias("_cover_low"), F.col(high).alias("_cover_high"))
    found = asof_join(df, cover, keys, low, "_cover_low", ["_cover_high"], bins)
    return found.select(
        *df.columns, F.coalesce(F.col(high) <= F.col("_cover_high"), F.lit(False)).alias("is_covered"))


def unexplained_snapshots(
    snapshots: DataFrame, ledger: DataFrame, attempts: DataFrame, detections: DataFrame, repairs: DataFrame,
) -> DataFrame:
    """Ingest snapshots no ledger row adopted, with the four parts of their explanation.

    ``attempts``: contract_id, attempt_no, verdict. ``detections``: snapshot_id, detected_by (the
    contract moved to reconciliation). ``repairs``: parent_contract_id, window_low, window_high of
    finalised repair ledger rows. A snapshot is explained when it was decided as not committed,
    detected, and the detecting contract's repair covers its window.
    """
    adopted = ledger.where("cas_applied").select(F.col("committed_snapshot_id").alias("snapshot_id"))
    loose = snapshots.where(F.col("writer_kind") == "ingest").join(adopted, "snapshot_id", "left_anti")
    decided = attempts.where(F.col("verdict") == "NO_COMMIT").select(
        "contract_id", "attempt_no", F.lit(True).alias("is_decided")).dropDuplicates()
    found = detections.select("snapshot_id", "detected_by").dropDuplicates(["snapshot_id"])
    base = (
        loose.select("snapshot_id", "contract_id", "attempt_no", "window_low", "window_high")
        .join(decided, ["contract_id", "attempt_no"], "left")
        .join(found, "snapshot_id", "left"))
    # The merged windows feed several scans below; materialised, they are computed once.
    union = cut_lineage(merge_windows(
        repairs.select(F.col("parent_contract_id").alias("detected_by"), "window_low", "window_high"),
        ["detected_by"]))
    known = base.where(F.col("detected_by").isNotNull())
    unknown = base.where(F.col("detected_by").isNull()).withColumn("is_covered", F.lit(False))
    checked = covered_by(known, union, ["detected_by"]).unionByName(unknown)
    return checked.select(
        "snapshot_id", "contract_id", "attempt_no",
        F.coalesce("is_decided", F.lit(False)).alias("is_decided"),
        F.col("detected_by").isNotNull().alias("is_detected"),
        F.col("is_covered").alias("is_repaired"),
    ).withColumn("is_explained", F.col("is_decided") & F.col("is_detected") & F.col("is_repaired"))


def ledger_gaps(ledger: DataFrame, exempt: Sequence[str] = ("INITIAL_LOAD", "REPAIR"),
                bins: Bins = None) -> DataFrame:
    """Breaks between consecutive applied ledger rows of a job: GAP, OVERLAP or REGRESSION.

    ``ledger``: job_id, cas_at, ledger_id (tie-break), window_low, window_high, cas_applied,
    operation_class. Rows of an exempt class start a new sequence without a finding.
    """
    applied = ledger.where("cas_applied")
    seen = previous_values(applied, ["job_id"], ["cas_at", "ledger_id"], {"previous_high": "window_high"}, bins)
    finding = (
        F.when(F.col("operation_class").isin(*exempt), None)
        .when(F.col("window_high") <= F.col("window_low"), "REGRESSION")
        .when(F.col("previous_high").isNull(), None)
        .when(F.col("window_low") > F.col("previous_high"), "GAP")
        .when(F.col("window_low") < F.col("previous_high"), "OVERLAP"))
    return seen.withColumn("finding", finding).where(F.col("finding").isNotNull())


def tag_coverage(snapshots: DataFrame, allow: DataFrame) -> DataFrame:
    """Share of snapshots with the required tags; listed injection snapshots are left out.

    Ingest needs a contract, maintenance a lease.
    """
    rest = snapshots.join(allow.select("snapshot_id"), "snapshot_id", "left_anti")
    tagged = F.when(F.col("writer_kind") == "maintenance", F.col("lease_id").isNotNull()).otherwise(
        F.col("writer_kind").isNotNull() & F.col("contract_id").isNotNull())
    return rest.groupBy("table_id").agg(
        F.count(F.lit(1)).alias("snapshot_count"), F.count_if(tagged).alias("tagged_count"),
    ).withColumn("coverage_pct", F.round(F.lit(100.0) * F.col("tagged_count") / F.col("snapshot_count"), 4))


def exposure_p99(pairs: DataFrame) -> DataFrame:
    """p99 of the seconds a bad snapshot stayed visible, and how many still are.

    ``pairs``: committed_at, repair_finalized_at (NULL while unresolved).
    """
    seconds = (F.unix_micros(F.col("repair_finalized_at").cast("timestamp"))
               - F.unix_micros(F.col("committed_at").cast("timestamp"))) / F.lit(1_000_000.0)
    rows = pairs.select(seconds.alias("exposure_s"))
    p99 = exact_percentiles(rows, [], "exposure_s", {"exposure_p99_s": 0.99}).scalar()
    return rows.agg(
        F.count(F.lit(1)).alias("bad_snapshots"),
        F.count_if(F.col("exposure_s").isNull()).alias("unresolved"),
    ).select(p99.alias("exposure_p99_s"), "bad_snapshots", "unresolved")


def case_crosscheck(expected: DataFrame, observed: DataFrame, key: str = "case_id") -> DataFrame:
    """Expected against observed count per case; both excess and shortage fail."""
    joined = expected.select(key, "expected_count").join(
        observed.select(key, "observed_count"), key, "full_outer")
    e, o = (F.coalesce(c, F.lit(0)).cast("bigint") for c in ("expected_count", "observed_count"))
    return joined.select(key, e.alias("expected_count"), o.alias("observed_count")).withColumn(
        "case_result",
        F.when(F.col("observed_count") > F.col("expected_count"), "EXCESS")
        .when(F.col("observed_count") < F.col("expected_count"), "SHORTAGE").otherwise("MATCH"))


def current_watermark(ledger: DataFrame) -> DataFrame:
    """Covered upper bound per job, and where a partly committed contract resumes."""
    applied = F.col("cas_applied")
    return ledger.groupBy("job_id").agg(
        F.max(F.when(applied, F.col("window_high"))).alias("current_watermark"),
        F.count_if(applied).alias("applied_chunks"),
        F.count_if(~applied).alias("rejected_chunks"))


def resume_points(ledger: DataFrame) -> DataFrame:
    """Per contract: the window's remaining part after what applied chunks cover without a gap from its start.

    A missing chunk ends the covered part, whatever was applied after it.
    """
    bounds = ledger.groupBy("contract_id").agg(
        F.min("window_low").alias("contract_low"), F.max("window_high").alias("contract_high"))
    covered = merge_windows(ledger.where("cas_applied"), ["contract_id"]).select(
        "contract_id", F.col("window_low").alias("contract_low"), F.col("window_high").alias("_covered_to"))
    return bounds.join(covered, ["contract_id", "contract_low"], "left").select(
        "contract_id", F.coalesce("_covered_to", "contract_low").alias("resume_low"), "contract_high",
    ).where(F.col("resume_low") < F.col("contract_high"))


def watermark_regressions(ledger: DataFrame, bins: Bins = None) -> DataFrame:
    """Applied rows whose upper bound is below one reached earlier by the same job."""
    applied = ledger.where("cas_applied")
    seen = running(
        applied, ["job_id"], ["cas_at", "ledger_id"], {"reached_high": ("max", "window_high")},
        bins, inclusive=False)
    return seen.where(F.col("window_high") < F.col("reached_high"))


def following_commit(ledger: DataFrame, bins: Bins = None) -> DataFrame:
    """Add the next applied commit time of the same job, for publication intervals."""
    return next_values(
        ledger.where("cas_applied"), ["job_id"], ["cas_at", "ledger_id"], {"next_cas_at": "cas_at"}, bins)
