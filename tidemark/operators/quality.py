"""Checks that run before a chunk is committed."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.load import _same_keys
from tidemark.operators.windows import as_col


def dq_row_balance(receipts: DataFrame) -> DataFrame:
    """extracted - dedup_dropped - anti_dropped = written, and written = what the commit reports.

    Append compares with ``added_records``, Full with ``total_records``, Merge with
    ``merge_input_rows``.
    """
    left = (F.col("extracted_rows") - F.col("dedup_dropped_rows") - F.col("anti_join_dropped_rows"))
    reported = (
        F.when(F.col("load_mode") == "APPEND", F.col("added_records"))
        .when(F.col("load_mode") == "FULL", F.col("total_records"))
        .otherwise(F.col("merge_input_rows")))
    return (
        receipts.withColumn("balance_ok", left == F.col("written_rows"))
        .withColumn("commit_ok", F.coalesce(reported == F.col("written_rows"), F.lit(False)))
    )


def dq_pk_unique(df: DataFrame, pk: Sequence[str], part: Sequence[str] = ()) -> DataFrame:
    """Keys that occur more than once, within a partition when ``part`` is given."""
    keys = [*part, *pk]
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("occurrences")).where("occurrences > 1")


def dq_not_null(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """NULL count per required column, in one row."""
    return df.agg(*[F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in cols])


def dq_window_max(df: DataFrame, wm: str, high) -> DataFrame:
    """Largest watermark against the window's upper bound."""
    return df.agg(F.max(wm).alias("max_wm")).withColumn(
        "window_max_ok", F.coalesce(F.col("max_wm") <= as_col(high), F.lit(True)))


def dq_row_drop(written: DataFrame, previous: DataFrame, key: str = "table_id", keep: float = 0.5) -> DataFrame:
    """A full load at or below ``keep`` of the previous total must not be committed."""
    return written.join(previous, key, "left").withColumn(
        "row_drop_ok",
        F.col("previous_rows").isNull() | (F.col("written_rows") > F.col("previous_rows") * F.lit(keep)))


def merge_metrics(
    target: DataFrame, batch: DataFrame, pk: Sequence[str], when: str | None = None,
    delete: str | None = None,
) -> DataFrame:
    """Branch counts of a merge: input = inserted + updated + deleted + ignored.

    ``when`` and ``delete`` are conditions over ``t`` (target) and ``b`` (batch); delete goes first.
    """
    kill = F.coalesce(F.expr(delete), F.lit(False)) if delete else F.lit(False)
    change = F.coalesce(F.expr(when), F.lit(False)) if when else F.lit(True)
    # Matched pairs from the target's side, so that a small batch is broadcast and the target stays in place.
    pairs = target.alias("t").join(batch.alias("b"), _same_keys(pk)).select(F.lit(0).alias("n"), F.lit(1).alias("hit"), kill.alias("kill"), change.alias("change"))
    rows = batch.select(F.lit(1).alias("n"), F.lit(0).alias("hit"), F.lit(False).alias("kill"), F.lit(False).alias("change")).unionByName(pairs)
    hit = F.col("hit") == 1

    return rows.agg(
        F.count_if(F.col("n") == 1).alias("input_rows"),
        (F.count_if(F.col("n") == 1) - F.count_if(hit)).alias("inserted_rows"),
        F.count_if(hit & ~F.col("kill") & F.col("change")).alias("updated_rows"),
        F.count_if(hit & F.col("kill")).alias("deleted_rows"),
        F.count_if(hit & ~F.col("kill") & ~F.col("change")).alias("ignored_rows"),
    ).withColumn(
        "balanced",
        F.col("input_rows") == F.col("inserted_rows") + F.col("updated_rows")
        + F.col("deleted_rows") + F.col("ignored_rows"))


def dq_source_count(src_counts: DataFrame, receipts: DataFrame, key: str = "table_id") -> DataFrame:
    """Source COUNT(*) against loaded rows, only for non-critical sources that allow the count."""
    allowed = src_counts.where(F.col("count_allowed") & ~F.col("is_critical"))
    loaded = receipts.groupBy(key).agg(F.sum("written_rows").cast("bigint").alias("loaded_rows"))
    return allowed.join(loaded, key, "left").select(
        key, "source_rows", F.coalesce("loaded_rows", F.lit(0)).cast("bigint").alias("loaded_rows"),
    ).withColumn("source_count_ok", F.col("source_rows") == F.col("loaded_rows"))


@dataclass(frozen=True)
class QualitySpec:
    """What :func:`run_dq` checks on one table's chunks."""

    pk: Sequence[str]
    watermark: str
    chunk: str
    high: str


def quality_aggregates(spec: QualitySpec) -> list[Column]:
    """The aggregate columns of the checks that need no grouping by key; also fit ``observe``."""
    return [
        F.count(F.lit(1)).alias("chunk_rows"),
        *[F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in (*spec.pk, spec.watermark)],
        F.count_if(F.col(spec.watermark) > F.col(spec.high)).alias("rows_above_high"),
    ]


def run_dq(df: DataFrame, spec: QualitySpec) -> DataFrame:
    """All checks per chunk and one ``dq_failed`` flag.

    Rows are first counted per (chunk, key), so that duplicates and NULLs come out of one shuffle
    and a chunk of any size is summed from partial counts.
    """
    wm, high = F.col(spec.watermark), F.col(spec.high)
    no_key = F.lit(False)
    for c in spec.pk:
        no_key = no_key | F.col(c).isNull()
    per_key = df.groupBy(spec.chunk, *spec.pk).agg(
        F.count(F.lit(1)).alias("_n"),
        F.count_if(wm.isNull()).alias("_null_wm"),
        F.count_if(wm > high).alias("_above"))
    checked = per_key.groupBy(spec.chunk).agg(
        F.sum("_n").cast("bigint").alias("chunk_rows"),
        F.sum(F.when(F.col("_n") > 1, F.col("_n") - 1).otherwise(0)).cast("bigint").alias("duplicate_rows"),
        F.sum(F.when(no_key, F.col("_n")).otherwise(0)).cast("bigint").alias("null_pk_rows"),
        F.sum("_null_wm").cast("bigint").alias("null_wm_rows"),
        F.sum("_above").cast("bigint").alias("rows_above_high"))
    bad = ["duplicate_rows", "null_pk_rows", "null_wm_rows", "rows_above_high"]
    failed = F.lit(False)
    for name in bad:
        failed = failed | (F.col(name) > 0)
    return checked.withColumn("dq_failed", failed)
