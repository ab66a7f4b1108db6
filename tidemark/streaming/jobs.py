"""Streaming versions of the ingest, merge and monitoring jobs."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.load import dedup_latest
from tidemark.session import materialised, remove_path
from tidemark.sources.log import read_if_there
from tidemark.sources.storage import append_ledger, current_version, measured_write, write_full

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """Keep streaming state in RocksDB, off the Java heap, unless a provider was chosen."""
    key = "spark.sql.streaming.stateStore.providerClass"
    if "HDFSBacked" in spark.conf.get(key, "HDFSBacked"):
        spark.conf.set(key, ROCKSDB)


def stream_append(stream: DataFrame, pk: Sequence[str], wm: str, overlap: str) -> DataFrame:
    """Append ingest: rows may be as late as ``overlap`` and repeated keys inside it are dropped."""
    return stream.withWatermark(wm, overlap).dropDuplicatesWithinWatermark(list(pk))


def append_batches(root: str, pk: Sequence[str], wm: str, overlap: str, buckets: int = 64) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` body of an append ingest that keeps what its own watermark calls late.

    The watermark is the highest event time of the batches before, less ``overlap``. Rows below it, and rows without
    event time, go to ``late``, the others to ``main`` unless a row of their key is there already, however long ago; such
    rows go to ``repeats``. An index of the keys in ``buckets`` tells which those are; a batch reads only the buckets
    that its own keys lie in. Every folder is named by the batch, so a batch that runs again replaces its own rows and
    decides as before.
    """

    def apply(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows = materialised(batch, "append-batch")
        kind = rows.schema[wm].dataType.simpleString()
        marks = None
        if batch_id:
            seen = spark.read.schema(f"high {kind}, batch_id BIGINT").parquet(f"{root}/marks").where(F.col("batch_id") < batch_id)
            marks = seen.agg((F.max("high") - F.expr(f"INTERVAL {overlap}")).alias("low")).first()["low"]
        ok = F.col(wm).isNotNull() if marks is None else F.coalesce(F.col(wm) >= F.lit(marks).cast(kind), F.lit(False))
        fresh = rows.where(ok).dropDuplicates(list(pk)).withColumn("bucket", F.pmod(F.xxhash64(*pk), F.lit(buckets)).cast("int"))
        fresh = materialised(fresh, "append-fresh")
        hit = [r.bucket for r in fresh.select("bucket").distinct().collect()]
        seen = key_index(spark, root, rows.select(*pk).schema, batch_id).where(F.col("bucket").isin(hit)).select(*pk, F.lit(True).alias("_seen"))
        judged = fresh.join(seen.dropDuplicates(list(pk)), list(pk), "left")
        judged.where("_seen").drop("_seen", "bucket").write.mode("overwrite").parquet(f"{root}/repeats/batch_id={batch_id}")
        fresh = materialised(judged.where("_seen IS NULL").drop("_seen"), "append-new")
        fresh.select(*pk, F.lit(batch_id).cast("bigint").alias("batch_id"), "bucket").repartition("bucket").write.mode("overwrite").partitionBy(
            "bucket").parquet(f"{root}/index/kind=batch/upto={batch_id}")
        fresh = fresh.drop("bucket")
        fresh.write.mode("overwrite").parquet(f"{root}/main/batch_id={batch_id}")
        rows.where(~ok).write.mode("overwrite").parquet(f"{root}/late/batch_id={batch_id}")
        rows.agg(F.max(wm).alias("high")).write.mode("overwrite").parquet(f"{root}/marks/batch_id={batch_id}")

    return apply


def key_index(spark: SparkSession, root: str, pk: T.StructType, before: int) -> DataFrame:
    """(pk…, batch_id, bucket) of the keys that batches below ``before`` have put into main."""
    fold = read_if_there(spark, f"{root}/index_folds", "upto BIGINT").agg(F.max("upto")).first()[0]
    fold = -1 if fold is None else fold
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pk.fields)
    rows = read_if_there(spark, f"{root}/index", f"{ddl}, batch_id BIGINT, kind STRING, upto BIGINT, bucket INT")
    whole = (F.col("kind") == "fold") & (F.col("upto") == fold)
    later = (F.col("kind") == "batch") & (F.col("upto") > fold) & (F.col("upto") < before)
    return rows.where(whole | later).where(F.col("batch_id") < before).drop("kind", "upto")


def fold_key_index(spark: SparkSession, root: str, pk: T.StructType) -> int:
    """Fold the key index to one file per bucket and delete what it replaces. Run it between batches."""
    parts = [(r.kind, r.upto) for r in read_if_there(spark, f"{root}/index", "kind STRING, upto BIGINT, bucket INT").select("kind", "upto").distinct().collect()]
    last = max((n for _, n in parts), default=-1)
    if ("fold", last) in parts or last < 0:
        return last
    rows = key_index(spark, root, pk, last + 1)
    rows.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{root}/index/kind=fold/upto={last}")
    spark.range(1).select(F.lit(last).cast("bigint").alias("upto")).coalesce(1).write.mode("append").parquet(f"{root}/index_folds")
    for kind, n in parts:
        remove_path(spark, f"{root}/index/kind={kind}/upto={n}")
    return last


def late_counts(spark: SparkSession, root: str, schema: T.StructType) -> DataFrame:
    """(batch_id, late_rows) of an append ingest."""
    tagged = T.StructType([*schema.fields, T.StructField("batch_id", T.LongType())])
    return spark.read.schema(tagged).parquet(f"{root}/late").groupBy("batch_id").agg(F.count(F.lit(1)).alias("late_rows"))


def stream_dedup_events(events: DataFrame, at: str, horizon: str) -> DataFrame:
    """At-least-once deliveries to one row per event identity within the horizon."""
    ident = F.sha2(F.concat_ws("|", F.col("aggregate_id").cast("string"), "transition", "event_type"), 256)
    return events.withColumn("event_key", ident).withWatermark(at, horizon).dropDuplicatesWithinWatermark(["event_key"])


def merge_batches(root: str, pk: Sequence[str], order: Sequence[Column], ledger: str | None = None, contract_id: int = 0) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` body of a merge ingest: dedup the batch and write it as one delta.

    The base is not rewritten per batch. The batch id names the delta folder, so a batch that runs
    again replaces its own rows: the upsert is idempotent without further bookkeeping. With ``ledger``, each batch
    leaves one row there as chunk ``batch_id`` of the contract, however often it runs.
    """

    def apply(batch: DataFrame, batch_id: int) -> None:
        seen = Observation()
        facts = measured_write(dedup_latest(batch.observe(seen, F.count(F.lit(1)).alias("rows")), pk, order), f"{root}/delta/batch_id={batch_id}", "overwrite")
        if ledger:
            append_ledger(batch.sparkSession, [dict(
                contract_id=contract_id, attempt_no=1, chunk_no=batch_id, committed_snapshot_id=f"{contract_id}-{batch_id}", cas_applied=True,
                extracted_rows=seen.get["rows"], written_rows=facts["rows"], dedup_dropped_rows=seen.get["rows"] - facts["rows"])], ledger)

    return apply


def stream_merge(stream: DataFrame, root: str, pk: Sequence[str], order: Sequence[Column], checkpoint: str, ledger: str | None = None, contract_id: int = 0):
    """Start the merge ingest over everything available now."""
    return (
        stream.writeStream.foreachBatch(merge_batches(root, pk, order, ledger, contract_id))
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def read_merged(spark: SparkSession, root: str, pk: Sequence[str], order: Sequence[Column], schema: T.StructType) -> DataFrame:
    """The merged table: the newest row per key over base and deltas, later batches winning ties.

    Base path and fold mark come from one version row: a fold that lands meanwhile changes neither. Only the
    deltas and the base rows of their keys are shuffled; the rest of the base passes an anti join.
    """
    return _merged(spark, root, pk, order, schema, current_version(spark, f"{root}/base"))


def _merged(spark, root, pk, order, schema, version) -> DataFrame:
    tagged = T.StructType([*schema.fields, T.StructField("batch_id", T.LongType())])
    deltas = spark.read.schema(tagged).parquet(f"{root}/delta").where(F.col("batch_id") > _fold_mark(version))
    if version is None:
        return dedup_latest(deltas, pk, [*order, F.desc("batch_id")]).drop("batch_id")
    base = spark.read.schema(schema).parquet(version["path"])
    newest = materialised(dedup_latest(deltas, pk, [*order, F.desc("batch_id")]))  # read three times, ranked once
    keys = newest.select(*pk)
    rivals = base.join(keys, list(pk), "left_semi").withColumn("batch_id", F.lit(-1).cast("bigint"))
    won = dedup_latest(rivals.unionByName(newest), pk, [*order, F.desc("batch_id")]).drop("batch_id")
    return base.join(keys, list(pk), "left_anti").unionByName(won)


def _fold_mark(version) -> int:
    return int(version["operation"].rsplit("-", 1)[1]) if version else -1


def folded_to(spark: SparkSession, root: str) -> int:
    """Highest batch id the base already contains, -1 before the first fold."""
    return _fold_mark(current_version(spark, f"{root}/base"))


def fold_deltas(spark: SparkSession, root: str, pk: Sequence[str], order: Sequence[Column], schema: T.StructType) -> dict:
    """Fold all deltas so far into a new base version. Run it at leisure, not per batch."""
    last = spark.read.schema("batch_id BIGINT").parquet(f"{root}/delta").agg(F.max("batch_id")).collect()[0][0]
    return write_full(read_merged(spark, root, pk, order, schema), f"{root}/base", operation=f"FOLD-{last}")


def stream_freshness(occurrences: DataFrame, finishes: DataFrame, slo: str, lateness: str) -> DataFrame:
    """One breach per (job_id, logical_at) whose SLO passes without a finish.

    An outer stream join: Spark holds an occurrence in state until the watermark has passed its
    deadline and then emits it unmatched, exactly once. ``occurrences``: job_id, logical_at.
    ``finishes``: job_id, logical_at, finished_at.
    """
    o = occurrences.withWatermark("logical_at", lateness).alias("o")
    f = finishes.withWatermark("finished_at", lateness).alias("f")
    on = (
        (F.col("o.job_id") == F.col("f.job_id")) & (F.col("o.logical_at") == F.col("f.logical_at"))
        & (F.col("f.finished_at") >= F.col("o.logical_at"))
        & (F.col("f.finished_at") <= F.col("o.logical_at") + F.expr(f"INTERVAL {slo}")))
    return o.join(f, on, "left_outer").where(F.col("f.finished_at").isNull()).select("o.job_id", "o.logical_at")


def stream_metrics(df: DataFrame, at: str, size: str, by: Sequence[str], value: str,
                   lateness: str | None = None) -> DataFrame:
    """Tumbling-window count, maximum and mean of ``value`` per group; works on batch and stream."""
    rows = df.withWatermark(at, lateness) if lateness else df
    return rows.groupBy(F.window(at, size), *by).agg(
        F.count(F.lit(1)).alias("samples"), F.max(value).alias("max_value"), F.avg(value).alias("mean_value"),
    ).select(F.col("window.start").alias("window_start"), *by, "samples", "max_value", "mean_value")


def split_late(batch: DataFrame, wm: str, low) -> tuple[DataFrame, DataFrame]:
    """(on time, late): rows below ``low`` are kept aside, not dropped. NULL watermarks count as late."""
    from tidemark.operators.windows import as_col

    ok = F.coalesce(F.col(wm) >= as_col(low), F.lit(False))
    return batch.where(ok), batch.where(~ok)


def split_late_batches(main: str, side: str, wm: str, low) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` body that routes rows to the main or the late table, by batch id."""

    def apply(batch: DataFrame, batch_id: int) -> None:
        on_time, late = split_late(batch, wm, low)
        on_time.write.mode("overwrite").parquet(f"{main}/batch_id={batch_id}")
        late.write.mode("overwrite").parquet(f"{side}/batch_id={batch_id}")

    return apply
