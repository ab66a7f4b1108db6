"""Half-open windows, fences and window plans."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW_IN, WINDOW_OUT, WINDOW_UNKNOWN = "IN", "OUT", "UNKNOWN"


def as_col(value) -> Column:
    """A Column as is, anything else as a literal (datetimes as wall-clock timestamps)."""
    if isinstance(value, Column):
        return value
    lit = F.lit(value)
    return lit.cast("timestamp_ntz") if hasattr(value, "year") else lit


def inside(wm: Column | str, low, high) -> Column:
    """``low <= wm < high``; NULL when the watermark is NULL."""
    c = F.col(wm) if isinstance(wm, str) else wm
    return (c >= as_col(low)) & (c < as_col(high))


def in_window(df: DataFrame, wm: str, low, high) -> DataFrame:
    """Rows of the half-open window. Plain comparisons, so the filter reaches the scan."""
    return df.where(inside(wm, low, high))


def classify_window(df: DataFrame, wm: str, low, high) -> DataFrame:
    """Add ``window_class``: IN, OUT, or UNKNOWN for a NULL watermark."""
    test = inside(wm, low, high)
    return df.withColumn(
        "window_class",
        F.when(test.isNull(), WINDOW_UNKNOWN).when(test, WINDOW_IN).otherwise(WINDOW_OUT))


def window_census(df: DataFrame, wm: str, low, high) -> DataFrame:
    """Row counts per window class with the table total, which the three classes must add up to."""
    test = inside(wm, low, high)
    return df.agg(
        F.count_if(test).alias("rows_in"),
        F.count_if(~test).alias("rows_out"),
        F.count_if(test.isNull()).alias("rows_unknown"),
        F.count(F.lit(1)).alias("rows_total"),
    ).withColumn(
        "balanced", F.col("rows_in") + F.col("rows_out") + F.col("rows_unknown") == F.col("rows_total"))


def fence_facts(df: DataFrame, wm: str, now, sample: float | None = None, seed: int = 0) -> DataFrame:
    """Facts a fence rests on: maximum, rows tied at it, NULL and future counts.

    The tie count is a second scan filtered by the maximum as a scalar subquery, which is pushed to
    the file reader. ``sample`` scales the work down on request and marks the result inexact.
    """
    rows = df.select(wm)
    if sample is not None:
        rows = rows.sample(fraction=sample, seed=seed)
    at_max = rows.where(F.col(wm) == rows.agg(F.max(wm)).scalar()).agg(F.count(F.lit(1))).scalar()
    return rows.agg(
        F.max(wm).alias("max_wm"),
        F.count(F.lit(1)).alias("rows_scanned"),
        F.count_if(F.col(wm).isNull()).alias("null_wm"),
        F.count_if(F.col(wm) > as_col(now)).alias("future_wm"),
    ).select("*", at_max.alias("tied_at_max"), F.lit(sample is None).alias("exact"))


def safe_cutoff(fences: DataFrame, strategy: str = "witness", safety_lag: timedelta = timedelta(0)) -> DataFrame:
    """Add ``safe_cutoff`` and ``cutoff_basis``.

    ``witness`` (default): ``least(t_lb, t_now) - safety_lag``.
    ``bounded``: ``least(t0 - commit_delay - safety_lag, max_wm)`` for sources without a witness;
    ``commit_delay`` is an interval column. It is an estimate, not a guarantee.
    """
    lag = F.lit(safety_lag)
    if strategy == "witness":
        both = F.col("t_lb").isNotNull() & F.col("t_now").isNotNull()
        cutoff = F.when(both, F.least("t_lb", "t_now") - lag)
        return fences.withColumn("safe_cutoff", cutoff).withColumn("cutoff_basis", F.lit("WITNESS"))
    if strategy == "bounded":
        both = F.col("t0").isNotNull() & F.col("max_wm").isNotNull()
        cutoff = F.when(both, F.least(F.col("t0") - F.col("commit_delay") - lag, F.col("max_wm")))
        return fences.withColumn("safe_cutoff", cutoff).withColumn("cutoff_basis", F.lit("HEURISTIC"))
    raise ValueError(f"unknown strategy {strategy!r}")


def eligible_high(df: DataFrame, wm: str, now) -> DataFrame:
    """Largest watermark that is not in the future, with the number of rows left out."""
    due = F.col(wm) <= as_col(now)
    return df.agg(
        F.max(F.when(due, F.col(wm))).alias("eligible_high"),
        F.max(wm).alias("raw_high"),
        F.count_if(~due).alias("quarantined"),
    )


def quarantine(df: DataFrame, wm: str, now) -> DataFrame:
    """Rows dated after ``now``: they do not move the cursor and re-enter once due."""
    return df.where(F.col(wm) > as_col(now))


def plan_windows(jobs: DataFrame, fences: DataFrame, bootstrap_low=None, on: str = "source_id") -> DataFrame:
    """``window_low``/``window_high`` per job with ``window_status``.

    The cursor of an empty or all-NULL source stays NULL: such a job needs ``bootstrap_low``.
    """
    low = F.col("current_watermark")
    if bootstrap_low is not None:
        low = F.coalesce(low, as_col(bootstrap_low))
    planned = jobs.join(fences.select(on, "safe_cutoff"), on, "left").select(
        *[F.col(c) for c in jobs.columns],
        low.alias("window_low"),
        F.col("safe_cutoff").alias("window_high"),
    )
    status = (
        F.when(F.col("window_low").isNull(), "NEEDS_BOOTSTRAP")
        .when(F.col("window_high").isNull() | (F.col("window_high") <= F.col("window_low")), "NO_DATA")
        .otherwise("READY")
    )
    return planned.withColumn("window_status", status)


def with_extract_low(windows: DataFrame, overlap: timedelta) -> DataFrame:
    """Add ``extract_low``: the overlap applies only while nothing of the window is covered yet."""
    fresh = F.col("window_low") == F.col("original_low")
    return windows.withColumn(
        "extract_low",
        F.when(fresh, F.col("original_low") - F.lit(overlap)).otherwise(F.col("window_low")))


def chunk_windows(windows: DataFrame, span: timedelta | int) -> DataFrame:
    """Split ``[window_low, window_high)`` into contiguous chunks numbered from 1."""
    step = F.lit(span)
    last = F.col("window_high") - (F.lit(timedelta(microseconds=1)) if isinstance(span, timedelta) else F.lit(1))
    keep = [F.col(c) for c in windows.columns]
    return (
        windows.where(F.col("window_high") > F.col("window_low"))
        .select(*keep, F.posexplode(F.sequence("window_low", last, step)).alias("_pos", "chunk_low"))
        .select(
            *keep,
            (F.col("_pos") + 1).cast("bigint").alias("chunk_no"),
            "chunk_low",
            F.least(F.col("chunk_low") + step, F.col("window_high")).alias("chunk_high"),
        )
    )


def initial_load_plan(jobs: DataFrame, span: timedelta, overlap: timedelta) -> DataFrame:
    """Chunks of a first load, then one sweep from the first chunk's fence minus the overlap.

    Needs ``window_low``, ``window_high``, ``first_fence`` and ``sweep_high`` per job.
    """
    chunks = chunk_windows(jobs, span).withColumn("chunk_kind", F.lit("CHUNK"))
    n_chunks = F.ceil(
        F.try_divide(
            (F.unix_micros(F.col("window_high").cast("timestamp"))
             - F.unix_micros(F.col("window_low").cast("timestamp"))).cast("double"),
            F.lit(span // timedelta(microseconds=1)))).cast("bigint")
    sweep = jobs.where(F.col("window_high") > F.col("window_low")).select(
        *[F.col(c) for c in jobs.columns],
        (n_chunks + 1).alias("chunk_no"),
        (F.col("first_fence") - F.lit(overlap)).alias("chunk_low"),
        F.col("sweep_high").alias("chunk_high"),
        F.lit("SWEEP").alias("chunk_kind"),
    )
    return chunks.unionByName(sweep)
