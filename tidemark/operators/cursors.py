"""Cursor strategies and the audits that show what a cursor alone misses.

A cursor never proves completeness: rows may commit late with an old watermark, tie at the cursor,
or carry none. :func:`never_loaded`, :func:`late_commits` and :func:`null_wm_rows` find those.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.ordered import Bins, asof_join, previous_values, running, with_bins
from tidemark.operators.windows import as_col, inside


def _or_false(test: Column) -> Column:
    return F.coalesce(test, F.lit(False))


def dual_window_or(df: DataFrame, cols: Sequence[str], bounds: Sequence[tuple]) -> DataFrame:
    """Rows inside any of the half-open ranges, one per watermark column: one scan with OR."""
    tests = [_or_false(inside(c, low, high)) for c, (low, high) in zip(cols, bounds)]
    return df.where(reduce(lambda a, b: a | b, tests))


def dual_window_union(
    df: DataFrame, cols: Sequence[str], bounds: Sequence[tuple],
    pk: Sequence[str] | None = None, order: Sequence[Column] = (),
) -> DataFrame:
    """The same rows as :func:`dual_window_or` from one bounded scan per watermark column.

    Each branch leaves out what an earlier branch already took, so UNION ALL needs no duplicate
    removal. Give ``pk`` when the branches read a source that may change between the scans.
    """
    parts, taken = [], None
    for col, (low, high) in zip(cols, bounds):
        part = in_range = df.where(inside(col, low, high))
        if taken is not None:
            part = in_range.where(~taken)
        test = _or_false(inside(col, low, high))
        taken = test if taken is None else taken | test
        parts.append(part)
    rows = reduce(DataFrame.unionByName, parts)
    if pk is None:
        return rows
    ranking = list(order) or [F.col(c).desc_nulls_last() for c in cols]
    w = Window.partitionBy(*pk).orderBy(*ranking)
    return rows.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def axis_recall(source: DataFrame, loaded: DataFrame, pk: Sequence[str]) -> DataFrame:
    """Loaded and missed source rows per cursor strategy.

    ``loaded`` holds (strategy, pk…). Loads of rows that are not in the source do not count; a strategy
    that loaded nothing of it is listed with 0.
    """
    total = source.select(*pk).distinct().agg(F.count(F.lit(1))).scalar()
    known = source.select(*pk, F.lit(True).alias("_known")).distinct()
    hits = (
        loaded.select("strategy", *pk).distinct().join(known, list(pk), "left")
        .groupBy("strategy").agg(F.count("_known").alias("loaded_rows"))
    )
    counted = hits.select("strategy", "loaded_rows", total.alias("source_rows"))
    return counted.withColumn("missed_rows", F.col("source_rows") - F.col("loaded_rows"))


def never_loaded(source: DataFrame, sink: DataFrame, pk: Sequence[str]) -> DataFrame:
    """Source rows that no load cycle has written."""
    return source.join(sink.select(*pk), list(pk), "left_anti")


def late_commits(
    rows: DataFrame, ledger: DataFrame, job: str, wm: str, commit_ts: str, bins: Bins = None,
) -> DataFrame:
    """Rows committed after the cursor had passed their watermark, ties at the cursor included.

    ``ledger`` holds (job, window_low, window_high, cas_at) with disjoint windows per job. The
    window of each row is found by an as-of lookup on ``window_low``.
    """
    placed = asof_join(
        rows, ledger.select(job, "window_low", "window_high", "cas_at"), [job], wm, "window_low",
        ["window_low", "window_high", "cas_at"], bins)
    return placed.where(
        (F.col(wm) < F.col("window_high")) & (F.col(commit_ts) > F.col("cas_at")))


def null_wm_rows(df: DataFrame, wm: str, axis: str, low, high) -> DataFrame:
    """Rows without a watermark, reached by an independent axis."""
    return df.where(F.col(wm).isNull() & inside(axis, low, high))


def shard_sweep(
    df: DataFrame, shard: str, seq: str, cursors: DataFrame, now_seq, global_: bool = True,
) -> DataFrame:
    """Rows a sharded sweep reads in ``(cursor, now_seq]``.

    With ``global_`` every shard starts at the smallest cursor; otherwise each at its own, which
    loses rows committed on a shard below the cursor it had already reached.
    """
    due = F.col(seq) <= as_col(now_seq)
    if global_:
        return df.where(due & (F.col(seq) > cursors.agg(F.min("cursor_seq")).scalar()))
    return (
        df.where(due).join(cursors.select(shard, "cursor_seq"), shard, "inner")
        .where(F.col(seq) > F.col("cursor_seq")).select(*df.columns)
    )


def shard_sweep_loss(df: DataFrame, shard: str, seq: str, cursors: DataFrame, now_seq) -> DataFrame:
    """Rows the global cursor finds and the per-shard cursors do not."""
    low = cursors.agg(F.min("cursor_seq")).scalar()
    return (
        df.where((F.col(seq) <= as_col(now_seq)) & (F.col(seq) > low))
        .join(cursors.select(shard, "cursor_seq"), shard, "left")
        .where(F.col("cursor_seq").isNull() | (F.col(seq) <= F.col("cursor_seq")))
        .select(*df.columns)
    )


def admit_ranges(requests: DataFrame, watermarks: DataFrame, job: str = "job_id") -> DataFrame:
    """Replay and backfill may only touch the closed range below the current watermark."""
    closed = F.col("range_high") <= F.col("current_watermark")
    return requests.join(watermarks.select(job, "current_watermark"), job, "left").withColumn(
        "admission",
        F.when(F.col("range_high") <= F.col("range_low"), "EMPTY_RANGE")
        .when(_or_false(closed), "ADMITTED").otherwise("OVERLAPS_OPEN_RANGE"))


def backfill_items(plans: DataFrame, jobs: DataFrame, grain: timedelta, on: str = "source_id") -> DataFrame:
    """One item per job and past window of the plan, with its place in the job's order.

    ``plans``: plan_id, the scope column, range_low, range_high. ``jobs``: job_id, scope, connections.
    """
    step = F.lit(grain)
    last = F.col("range_high") - F.lit(timedelta(microseconds=1))
    scoped = plans.where(F.col("range_high") > F.col("range_low")).join(
        jobs.select("job_id", on, "connections"), on)
    return (
        scoped.select(
            "plan_id", "job_id", on, "connections", "range_high",
            F.posexplode(F.sequence("range_low", last, step)).alias("_pos", "item_low"))
        .select(
            "plan_id", "job_id", on, "connections",
            (F.col("_pos") + 1).cast("bigint").alias("item_no"),
            "item_low",
            F.least(F.col("item_low") + step, F.col("range_high")).alias("item_high"),
            F.date_format("item_low", "yyyy-MM-dd").alias("touched_dt"),
        )
    )


def coalesce_missed(missed: DataFrame) -> DataFrame:
    """One catch-up per job: incremental jobs cover [min low, max high), full jobs keep the latest run.

    ``missed``: job_id, load_mode, logical_at, window_low, window_high.
    """
    full = F.col("load_mode") == "FULL"
    grouped = missed.groupBy("job_id", "load_mode").agg(
        F.max("logical_at").alias("logical_at"),
        F.min("window_low").alias("_low"),
        F.max("window_high").alias("_high"),
        F.count(F.lit(1)).alias("missed_runs"),
    )
    return grouped.select(
        "job_id", "load_mode", "logical_at",
        F.when(~full, F.col("_low")).alias("window_low"),
        F.when(~full, F.col("_high")).alias("window_high"),
        "missed_runs",
        F.when(full, F.col("missed_runs") - 1).otherwise(F.lit(0)).cast("bigint").alias("dropped_runs"),
    )


def unchanged_sources(stats: DataFrame, last: DataFrame, key: str = "table_id") -> DataFrame:
    """Tables whose newest update is not after the last loaded one: a full load can be skipped."""
    return stats.join(last, key).where(F.col("max_update") <= F.col("last_loaded"))


def commit_delay_stats(df: DataFrame, source: str, wm: str, commit_ts: str) -> DataFrame:
    """Largest and p99 of commit time minus watermark, in seconds, per source."""
    from tidemark.operators.quantiles import exact_percentiles

    delay = (F.unix_micros(F.col(commit_ts).cast("timestamp"))
             - F.unix_micros(F.col(wm).cast("timestamp"))) / F.lit(1_000_000.0)
    rows = df.where(F.col(wm).isNotNull() & F.col(commit_ts).isNotNull()).select(
        source, delay.alias("_delay"))
    top = rows.groupBy(source).agg(
        F.max("_delay").alias("max_delay_s"), F.count(F.lit(1)).alias("observed_rows"))
    return top.join(exact_percentiles(rows, [source], "_delay", {"p99_delay_s": 0.99}), source)


def overlap_check(jobs: DataFrame, sources: DataFrame, on: str = "source_id") -> DataFrame:
    """Is the overlap at least bound + safety lag + clock skew? All in seconds. UNKNOWN without a registered source."""
    need = F.col("max_commit_delay_s") + F.col("safety_lag_s") + F.col("clock_skew_s")
    enough = F.col("overlap_s") >= F.col("required_overlap_s")
    return (
        jobs.join(sources, on, "left")
        .withColumn("required_overlap_s", need)
        .withColumn(
            "overlap_result",
            F.when(F.col("required_overlap_s").isNull(), "UNKNOWN").when(enough, "OK").when(F.col("grade") == "ZERO_GAP", "REJECT").otherwise("WARN"))
    )


def stalled_watermarks(fence_log: DataFrame, n: int, keys: Sequence[str] = ("source_id", "table_id"),
                       bins: Bins = None) -> DataFrame:
    """Streaks of at least ``n`` fence observations in which ``max_wm`` did not advance.

    ``fence_log``: keys, observed_at (unique per key), max_wm.
    """
    keys = list(keys)
    binned = with_bins(fence_log, keys, "observed_at", bins)
    seen = previous_values(binned, keys, ["observed_at"], {"_before": "max_wm"}, bins)
    moved = F.when(F.col("_before").isNull() | (F.col("max_wm") > F.col("_before")), 1).otherwise(0)
    islands = running(
        seen.withColumn("_moved", moved), keys, ["observed_at"], {"_island": ("sum", "_moved")}, bins)
    return (
        islands.groupBy(*keys, "_island").agg(
            F.min("observed_at").alias("stalled_since"),
            F.max("observed_at").alias("last_observed"),
            F.max("max_wm").alias("max_wm"),
            F.count(F.lit(1)).alias("observations"))
        .where(F.col("observations") >= n).drop("_island")
    )


def keyset_window(df: DataFrame, wm: str, pk: str, low: tuple, high: tuple) -> DataFrame:
    """Half-open window on (watermark, key): closes ties at the cursor, not late commits.

    The plain range on the watermark is implied; it is spelled out so that the scan can use it.
    """
    pair = F.struct(F.col(wm), F.col(pk))
    low_c = F.struct(as_col(low[0]), F.lit(low[1]).cast(df.schema[pk].dataType))
    high_c = F.struct(as_col(high[0]), F.lit(high[1]).cast(df.schema[pk].dataType))
    return df.where(
        (F.col(wm) >= as_col(low[0])) & (F.col(wm) <= as_col(high[0]))
        & (pair >= low_c) & (pair < high_c))


def next_keyset(df: DataFrame, wm: str, pk: str) -> DataFrame:
    """The largest (watermark, key) pair: the next cursor."""
    best = F.max(F.when(F.col(wm).isNotNull(), F.struct(F.col(wm), F.col(pk))))
    return df.agg(best.alias("_c")).select(
        F.col(f"_c.{wm}").alias("cursor_wm"), F.col(f"_c.{pk}").alias("cursor_pk"))
