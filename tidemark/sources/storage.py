"""Staging, table writes with commit evidence, and file housekeeping on shared storage.

A table is a folder of immutable version folders plus the log of its versions; the row with the highest number
names the readable one. A failed write leaves the old version in place.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import uuid
from collections.abc import Sequence
from dataclasses import dataclass
from datetime import timedelta

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators.windows import as_col
from tidemark.sources.log import TieredLog

LEDGER_DDL = (
    "contract_id BIGINT, attempt_no BIGINT, chunk_no BIGINT, expected_chunk_count BIGINT, "
    "base_snapshot_id STRING, committed_snapshot_id STRING, dq_result STRING, cas_applied BOOLEAN, "
    "cas_at TIMESTAMP_NTZ, window_low TIMESTAMP_NTZ, window_high TIMESTAMP_NTZ, actor STRING, "
    "extracted_rows BIGINT, written_rows BIGINT, dedup_dropped_rows BIGINT, anti_join_dropped_rows BIGINT, "
    "overlap_recovered_rows BIGINT, extract_window_low TIMESTAMP_NTZ, sequence_number BIGINT, summary STRING, "
    "metadata_location STRING, confidence STRING, dq_basis STRING, published_main_snapshot_id STRING")
MANIFEST_DDL = (
    "contract_id BIGINT, attempt_no BIGINT, chunk_no BIGINT, window_low TIMESTAMP_NTZ, "
    "window_high TIMESTAMP_NTZ, extract_low TIMESTAMP_NTZ, point STRING, schema_hash STRING, "
    "row_count BIGINT, content_checksum STRING, path STRING, status STRING")
VERSION_DDL = "seq BIGINT, version STRING, path STRING, operation STRING, row_count BIGINT, committed_at TIMESTAMP_NTZ"


@dataclass(frozen=True)
class ChunkKey:
    """Identity of one chunk of one attempt."""

    contract_id: int
    attempt_no: int
    chunk_no: int

    @property
    def folder(self) -> str:
        return f"{self.contract_id}/a{self.attempt_no}/c{self.chunk_no}"

    @property
    def commit_key(self) -> str:
        return f"{self.contract_id}-{self.attempt_no}-{self.chunk_no}"


def content_checksum(columns: Sequence[str]) -> Column:
    """Order-independent checksum aggregate of whole rows."""
    return F.sum(F.xxhash64(*columns).cast("decimal(38,0)")).cast("string")


def schema_hash(df: DataFrame) -> str:
    """Digest of column names and types, in order; nullability does not survive a file."""
    text = ";".join(f"{f.name}:{f.dataType.simpleString()}" for f in df.schema.fields)
    return hashlib.sha256(text.encode()).hexdigest()


def measured_write(df: DataFrame, path: str, mode: str, columns: Sequence[str] | None = None, **options) -> dict:
    """Write and count in the same pass."""
    seen = Observation()
    out = df.observe(
        seen, F.count(F.lit(1)).alias("rows"), content_checksum(columns or df.columns).alias("checksum"))
    writer = out.write.mode(mode)
    parts = options.pop("partition_by", None)
    if parts:
        writer = writer.partitionBy(*parts)
    for k, v in options.items():
        writer = writer.option(k, v)
    writer.parquet(path)
    return seen.get


def ledger_log(spark: SparkSession, path: str) -> TieredLog:
    """The commit ledger: one row per contract, attempt and chunk, however often a commit is repeated."""
    return TieredLog(spark, path, LEDGER_DDL, ["contract_id", "attempt_no", "chunk_no"])


def manifest_log(spark: SparkSession, root: str) -> TieredLog:
    """Manifest of the staged chunks below ``root``."""
    return TieredLog(spark, f"{root}/manifest", MANIFEST_DDL, ["contract_id", "attempt_no", "chunk_no"])


def version_log(spark: SparkSession, root: str) -> TieredLog:
    """Versions of the table below ``root``, in the order of their numbers."""
    return TieredLog(spark, f"{root}/_versions", VERSION_DDL, ["seq"])


def append_ledger(spark: SparkSession, rows: Sequence[dict], path: str) -> None:
    """Append ledger rows; the rows of a call become visible together and replace earlier rows of their commits."""
    ledger_log(spark, path).append(rows)


def stage_chunk(df: DataFrame, root: str, key: ChunkKey, window_low, window_high, extract_low=None, point=None) -> dict:
    """Extract once: write a chunk to its own folder, then seal it with a manifest row.

    Repeating the same chunk overwrites its folder; without the manifest row it does not count.
    """
    path = f"{root}/staging/{key.folder}"
    facts = measured_write(df, path, "overwrite")
    row = dict(
        contract_id=key.contract_id, attempt_no=key.attempt_no, chunk_no=key.chunk_no, window_low=window_low,
        window_high=window_high, extract_low=extract_low or window_low, point=point, schema_hash=schema_hash(df),
        row_count=facts["rows"], content_checksum=facts["checksum"], path=path, status="SEALED")
    manifest_log(df.sparkSession, root).append([row])
    return row


def read_staged(spark: SparkSession, row: dict, schema) -> DataFrame:
    """A sealed chunk, after checking that its schema is the manifest's."""
    df = spark.read.schema(schema).parquet(row["path"])
    if schema_hash(df) != row["schema_hash"]:
        raise ValueError(f"schema of {row['path']} differs from its manifest")
    return df


def verify_staged(df: DataFrame, row: dict) -> DataFrame:
    """Row count and checksum of the staged rows against the manifest."""
    return df.agg(
        F.count(F.lit(1)).alias("staged_rows"), content_checksum(df.columns).alias("staged_checksum"),
    ).withColumn(
        "is_intact",
        (F.col("staged_rows") == F.lit(row["row_count"]))
        & F.col("staged_checksum").eqNullSafe(F.lit(row["content_checksum"])))


def reusable_chunks(plan: DataFrame, manifest: DataFrame) -> DataFrame:
    """Planned chunks with ``chunk_action``: REUSE where a complete manifest row matches, else EXTRACT.

    ``plan``: contract_id, window_low, window_high, point. ``manifest`` adds rows_written,
    staged_rows, status. A half-written chunk is never reused.
    """
    key = ["contract_id", "window_low", "window_high", "point"]
    whole = manifest.where(
        (F.col("status") == "SEALED") & (F.col("rows_written") == F.col("staged_rows"))).select(
        *key, F.lit(True).alias("_whole")).dropDuplicates(key)
    return plan.join(whole, key, "left").withColumn(
        "chunk_action", F.when(F.col("_whole").isNotNull(), "REUSE").otherwise("EXTRACT")).drop("_whole")


def write_full(df: DataFrame, root: str, operation: str = "FULL") -> dict:
    """Replace the whole table by a new version. Zero rows are written nowhere readable."""
    version = uuid.uuid4().hex
    path = f"{root}/version-{version}"
    facts = measured_write(df, path, "errorifexists")
    if facts["rows"] == 0:
        return dict(version=None, rows=0, published=False)
    newest = _newest_version(df.sparkSession, root)
    seq = newest["seq"] + 1 if newest else 1
    row = dict(seq=seq, version=version, path=path, operation=operation, row_count=facts["rows"],
               committed_at=dt.datetime.now(dt.timezone.utc).replace(tzinfo=None))
    version_log(df.sparkSession, root).append([row], entry=f"v{seq}")
    return dict(version=version, rows=facts["rows"], published=True, path=path)


def _newest_version(spark: SparkSession, root: str):
    newest = version_log(spark, root).read().orderBy(F.desc("seq")).limit(1).collect()
    return newest[0] if newest else None


def current_path(spark: SparkSession, root: str) -> str | None:
    """Folder of the newest version, or None before the first one."""
    row = _newest_version(spark, root)
    return row["path"] if row else None


def current_version(spark: SparkSession, root: str) -> dict | None:
    """The newest version's row (path, operation, row_count, …), or None before the first one."""
    row = _newest_version(spark, root)
    return row.asDict() if row else None


def read_current(spark: SparkSession, root: str, schema=None) -> DataFrame:
    """The table's newest version."""
    path = current_path(spark, root)
    if path is None:
        if schema is None:
            raise ValueError(f"{root} has no version yet")
        return spark.createDataFrame([], schema)
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return reader.parquet(path)


def write_partitions(df: DataFrame, target: str, cols: Sequence[str]) -> dict:
    """Replace only the partitions present in ``df``. Not a substitute for a full replace.

    Rows are rebalanced by partition first: few files per partition, and large partitions split.
    """
    return measured_write(df.hint("rebalance", *cols), target, "overwrite", partition_by=list(cols), partitionOverwriteMode="dynamic")


def write_append(df: DataFrame, target: str, key: ChunkKey, tags: dict, ledger: str | None = None) -> dict:
    """Append one chunk under its commit identity and record the evidence.

    The identity is a partition folder, so repeating the commit replaces its own rows.
    """
    facts = measured_write(df, f"{target}/commit_key={key.commit_key}", "overwrite")
    row = dict(tags, contract_id=key.contract_id, attempt_no=key.attempt_no, chunk_no=key.chunk_no,
               committed_snapshot_id=key.commit_key, written_rows=facts["rows"], cas_applied=True)
    if ledger:
        append_ledger(df.sparkSession, [row], ledger)
    return row


def with_partition_cols(df: DataFrame, ts: str, sentinel_year: int = 9999) -> DataFrame:
    """Add dt, wt (Monday of the week), mt and yt; sentinel dates get NULL, their own partition."""
    real = F.year(ts) < sentinel_year
    day = F.when(real, F.col(ts))
    return df.select(
        "*", F.date_format(day, "yyyy-MM-dd").alias("dt"),
        F.date_format(F.date_trunc("week", day), "yyyy-MM-dd").alias("wt"),
        F.date_format(day, "yyyy-MM").alias("mt"), F.date_format(day, "yyyy").alias("yt"))


def compact(spark: SparkSession, source: str, target: str, cols: Sequence[str] = (), target_bytes: int = 512 << 20,
            load_mode: str = "APPEND") -> dict:
    """Rewrite a table's many small files as few large ones; the rows stay the same.

    Full tables are replaced as a whole by every load and are not compacted.

    The rebalance step lets Spark merge small partitions and split large ones to the target size.
    """
    if load_mode == "FULL":
        raise ValueError("full tables are not compacted")
    df = spark.read.parquet(source)
    # A session of its own: other queries of this application keep their partition size.
    own = spark.newSession()
    own.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", str(target_bytes))
    facts = measured_write(own.read.schema(df.schema).parquet(source).hint("rebalance", *cols), target, "errorifexists", partition_by=list(cols) or None)
    check_same_rows(spark, target, df.schema, facts)
    return dict(rows=facts["rows"], files_before=count_files(spark, source), files_after=count_files(spark, target))


def check_same_rows(spark: SparkSession, path: str, schema, facts: dict) -> None:
    """Read a written table back and compare its row count and checksum with what went in."""
    df = spark.read.schema(schema).parquet(path)
    new = df.agg(F.count(F.lit(1)).alias("rows"), content_checksum(df.columns).alias("checksum")).collect()[0]
    if (new["rows"], new["checksum"]) != (facts["rows"], facts["checksum"]):
        raise RuntimeError(f"{path} does not hold the rows that were written to it")


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, modified_at, bytes) of the data files below a folder; contents are not read."""
    return (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(path)
        .select("path", F.col("modificationTime").cast("timestamp_ntz").alias("modified_at"), F.col("length").alias("bytes")))


def count_files(spark: SparkSession, path: str) -> int:
    return list_files(spark, path).count()


def orphan_files(listing: DataFrame, live: DataFrame, min_age: timedelta, now) -> DataFrame:
    """Files in no live manifest and older than ``min_age``: candidates, not yet safe to delete."""
    return listing.where(F.col("modified_at") < as_col(now) - F.lit(min_age)).join(
        live.select("path"), "path", "left_anti")


def expirable_snapshots(snaps: DataFrame, open_contracts: DataFrame, retention: timedelta, now, keep_last: int = 1) -> DataFrame:
    """Snapshots past retention that no open contract needs, beyond each table's newest ``keep_last``."""
    w = Window.partitionBy("table_id").orderBy(F.desc("committed_at"), F.desc("snapshot_id"))
    newest = snaps.select("table_id", "snapshot_id", "committed_at").withColumn(
        "_rn", F.row_number().over(w)).where(F.col("_rn") <= keep_last).select("snapshot_id")
    old = snaps.where(F.col("committed_at") < as_col(now) - F.lit(retention))
    needed = open_contracts.select("contract_id")
    return old.join(newest, "snapshot_id", "left_anti").join(needed, "contract_id", "left_anti")


