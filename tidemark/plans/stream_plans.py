"""Streaming jobs run to completion over the sample tables."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.plans.registry import query
from tidemark.session import materialised, scratch_path
from tidemark.sources.storage import ledger_log
from tidemark.streaming import jobs as J
from tidemark.streaming.freshness import REPORT_DDL, freshness_reports

EVENTS_DDL = "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING"

#: As a pattern the path may name one file or a folder of part files.
EVENTS = "events.parque[t]"


def _event_stream(t):
    """The events file as a stream, with an event-time column Spark accepts for watermarks."""
    J.use_rocksdb(t.spark)
    return (
        t.spark.readStream.schema(EVENTS_DDL).parquet(f"{t.sf_dir}/{EVENTS}")
        .withColumn("ts", F.col("ts").cast("timestamp")))


def _repeated(stream):
    """Every fifth event is delivered twice."""
    copies = F.when(F.col("event_id") % 5 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return stream.withColumn("_copy", F.explode(copies)).drop("_copy")


def _run(t, stream, label):
    """Run a stream over everything available into files, and read those back."""
    out, state = scratch_path(t.spark, label), scratch_path(t.spark, f"{label}-checkpoint")
    job = (
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state)
        .outputMode("append").trigger(availableNow=True).start())
    job.awaitTermination()
    return t.spark.read.schema(stream.schema).parquet(out)


@query("stream_append", "SELECT event_id, ts, user_id FROM events")
def _(t):
    rows = J.stream_append(_repeated(_event_stream(t)), ["event_id"], "ts", "30 minutes")
    return _run(t, rows.select("event_id", "ts", "user_id"), "append").withColumn("ts", F.col("ts").cast("timestamp_ntz"))


_PARTS = """
WITH p AS (SELECT event_id, ts, event_id % 3 AS part FROM events),
b AS (SELECT MAX(ts) FILTER (part = 0) - INTERVAL 5 DAY AS b1, MAX(ts) FILTER (part <= 1) - INTERVAL 5 DAY AS b2 FROM p)
"""


@query("stream_append_late", _PARTS + """
SELECT event_id, ts, part AS batch_id, CASE part WHEN 0 THEN FALSE WHEN 1 THEN ts < b1 ELSE ts < b2 END AS is_late FROM p, b
""")
def _(t):
    # Three deliveries in a row; much of the second and third is older than what the ones before have reached.
    J.use_rocksdb(t.spark)
    inbox, root, state = (scratch_path(t.spark, f"append-{n}") for n in ("inbox", "table", "checkpoint"))
    for part in range(3):
        rows = t.events.where(F.col("event_id") % 3 == part).select("event_id", "ts").coalesce(1)
        rows.write.parquet(f"{inbox}/part={part}")
    schema = "event_id BIGINT, ts TIMESTAMP_NTZ"
    stream = t.spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(inbox)
    body = J.append_batches(root, ["event_id"], "ts", "5 DAYS")
    stream.writeStream.foreachBatch(body).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    read = lambda name, flag: t.spark.read.schema(f"{schema}, batch_id BIGINT").parquet(f"{root}/{name}").withColumn("is_late", F.lit(flag))
    return read("main", False).unionByName(read("late", True))


@query("stream_dedup_events", """
SELECT DISTINCT sha256(event_id // 2 || '|' || event_type || '|' || 'STATE') AS event_key FROM events
""")
def _(t):
    stream = _repeated(_event_stream(t)).select(
        F.floor(F.col("event_id") / 2).alias("aggregate_id"), F.col("event_type").alias("transition"),
        F.lit("STATE").alias("event_type"), "ts")
    return _run(t, J.stream_dedup_events(stream, "ts", "1 hour").select("event_key"), "dedup")


@query("stream_merge", """
SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, MAX(ts) AS ts, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY user_id
""")
def _(t):
    J.use_rocksdb(t.spark)
    inbox = scratch_path(t.spark, "inbox")
    cols = ["user_id", "event_id", "ts", "value"]
    t.events.select(*cols, (F.col("event_id") % 3).alias("part")).repartition("part").write.partitionBy("part").parquet(inbox)
    schema = T.StructType([
        T.StructField("user_id", T.LongType()), T.StructField("event_id", T.LongType()),
        T.StructField("ts", T.TimestampNTZType()), T.StructField("value", T.DoubleType())])
    stream = t.spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option(
        "recursiveFileLookup", "true").parquet(inbox)
    root, state = scratch_path(t.spark, "merge"), scratch_path(t.spark, "merge-checkpoint")
    pk, order = ["user_id"], [F.desc("ts"), F.desc("event_id")]
    J.stream_merge(stream, root, pk, order, state).awaitTermination()
    J.fold_deltas(t.spark, root, pk, order, schema)
    # A second start finds nothing new; base and folded deltas together give the same rows.
    J.stream_merge(stream, root, pk, order, state).awaitTermination()
    return J.read_merged(t.spark, root, pk, order, schema)


@query("stream_merge_ledger", """
SELECT 5 AS contract_id, event_id % 3 AS chunk_no, COUNT(*) AS extracted_rows, COUNT(DISTINCT user_id) AS written_rows, COUNT(*) - COUNT(DISTINCT user_id) AS dedup_dropped_rows FROM events GROUP BY event_id % 3
""")
def _(t):
    # One ledger row per batch, also for the batch that runs a second time.
    root = scratch_path(t.spark, "merge")
    body = J.merge_batches(f"{root}/table", ["user_id"], [F.desc("ts"), F.desc("event_id")], f"{root}/ledger", 5)
    for part in (0, 1, 2, 1):
        body(t.events.where(F.col("event_id") % 3 == part), part)
    return ledger_log(t.spark, f"{root}/ledger").read().select("contract_id", "chunk_no", "extracted_rows", "written_rows", "dedup_dropped_rows")


@query("stream_append_repeats", """
SELECT event_id, 'main' AS place FROM events UNION ALL SELECT event_id, 'repeat' FROM events WHERE event_id % 10 = 0
""")
def _(t):
    # Every tenth event comes again forty days later, long after the overlap; the index has been folded meanwhile.
    root = scratch_path(t.spark, "append")
    body = J.append_batches(root, ["event_id"], "ts", "1 HOUR", 16)
    rows = t.events.select("event_id", "ts")
    whole = rows.agg(F.min("ts").alias("lo"), F.max("ts").alias("hi")).first()
    half = whole.lo + (whole.hi - whole.lo) / 2
    body(rows.where(F.col("ts") < F.lit(half).cast("timestamp_ntz")), 0)
    body(rows.where(F.col("ts") >= F.lit(half).cast("timestamp_ntz")), 1)
    J.fold_key_index(t.spark, root, rows.select("event_id").schema)
    again = rows.where("event_id % 10 = 0").withColumn("ts", F.expr("ts + INTERVAL 40 DAY"))
    body(again, 2)
    body(again, 2)
    read = lambda name, place: t.spark.read.schema("event_id BIGINT, ts TIMESTAMP_NTZ").parquet(f"{root}/{name}").select("event_id", F.lit(place).alias("place"))
    return read("main", "main").unionByName(read("repeats", "repeat"))


@query("stream_freshness_reports", """
WITH e AS (SELECT event_id, user_id AS job_id, ts AS logical_at, event_id % 4 = 0 AS never, event_id % 7 = 0 AS late FROM events)
SELECT job_id, logical_at, 'BREACH' AS report, logical_at + INTERVAL 1 HOUR AS at, 0 AS left_in_state FROM e WHERE never OR late
UNION ALL SELECT job_id, logical_at, 'LATE_FINISH', logical_at + INTERVAL 5 HOUR, 0 FROM e WHERE late AND NOT never
""")
def _(t):
    # Three deliveries, a restart after each: occurrences and finishes by thirds of the time, beats on both ends.
    J.use_rocksdb(t.spark)
    inbox, out, state = (scratch_path(t.spark, f"reports-{n}") for n in ("inbox", "rows", "checkpoint"))
    late = F.when(F.col("event_id") % 7 == 0, F.expr("INTERVAL 5 HOUR")).otherwise(F.expr("INTERVAL 20 MINUTE"))
    base = t.events.select("event_id", F.col("user_id").alias("job_id"), F.col("ts").alias("logical_at"))
    due = base.select("job_id", "logical_at", F.lit(False).alias("is_finish"), F.col("logical_at").alias("at"))
    done = base.where("event_id % 4 <> 0").select("job_id", "logical_at", F.lit(True).alias("is_finish"), (F.col("logical_at") + late).alias("at"))
    low, high = t.events.agg(F.min("ts"), F.max("ts")).first()
    beat = t.spark.createDataFrame([(-1, high + timedelta(days=30), True, high + timedelta(days=30))], "job_id BIGINT, logical_at TIMESTAMP_NTZ, is_finish BOOLEAN, at TIMESTAMP_NTZ")
    rows = materialised(due.unionByName(done))
    cuts = [low + (high - low) / 3 * k for k in (1, 2)]
    lit = lambda x: F.lit(x).cast("timestamp_ntz")
    thirds = [F.col("at") < lit(cuts[0]), (F.col("at") >= lit(cuts[0])) & (F.col("at") < lit(cuts[1])), F.col("at") >= lit(cuts[1])]
    ddl = "job_id BIGINT, logical_at TIMESTAMP, is_finish BOOLEAN, at TIMESTAMP"

    def deliver(n, df):
        df.select("job_id", F.col("logical_at").cast("timestamp"), "is_finish", F.col("at").cast("timestamp")).write.parquet(f"{inbox}/n={n}")

    def run():
        stream = t.spark.readStream.schema(ddl).option("recursiveFileLookup", "true").parquet(inbox)
        reports = freshness_reports(stream, 3600, 36_000, "1 minute")
        job = reports.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).outputMode("append").trigger(availableNow=True).start()
        job.awaitTermination()
        return job.lastProgress.stateOperators[0].numRowsTotal if job.lastProgress and job.lastProgress.stateOperators else 0

    for n, third in enumerate(thirds):
        deliver(n, rows.where(third))
        run()
    deliver(3, beat)
    run()
    deliver(4, beat.withColumns({"logical_at": F.expr("logical_at + INTERVAL 30 DAY"), "at": F.expr("at + INTERVAL 30 DAY")}))
    left = run()
    found = t.spark.read.schema(REPORT_DDL).parquet(out).where("job_id >= 0")
    wall = {c: F.col(c).cast("timestamp_ntz") for c in ("logical_at", "at")}
    # Of the closing beats only the last one is still waiting.
    return found.withColumns(wall).withColumn("left_in_state", F.lit(max(left - 1, 0)))


@query("stream_freshness", """
SELECT user_id AS job_id, ts AS logical_at FROM events WHERE event_id % 4 = 0 OR event_id % 7 = 0
""")
def _(t):
    J.use_rocksdb(t.spark)
    # Finishes come as a stream of their own; every fourth is missing, every seventh too late. A
    # closing beat on both sides moves the watermark past the last deadline.
    folder = scratch_path(t.spark, "finishes")
    beat = t.events.agg((F.max("ts") + F.expr("INTERVAL 30 DAY")).alias("logical_at")).select(
        F.lit(-1).cast("bigint").alias("job_id"), "logical_at")
    due = t.events.select(F.col("user_id").alias("job_id"), F.col("ts").alias("logical_at")).unionByName(beat)
    late = F.when(F.col("event_id") % 7 == 0, F.expr("INTERVAL 5 HOUR")).otherwise(F.expr("INTERVAL 20 MINUTE"))
    done = t.events.where("event_id % 4 <> 0").select(
        F.col("user_id").alias("job_id"), F.col("ts").alias("logical_at"), (F.col("ts") + late).alias("finished_at"))
    done = done.unionByName(beat.withColumn("finished_at", F.col("logical_at")))
    due.write.parquet(f"{folder}/due")
    done.write.parquet(f"{folder}/done")
    as_ts = lambda df, *cols: df.withColumns({c: F.col(c).cast("timestamp") for c in cols})
    occurrences = as_ts(t.spark.readStream.schema("job_id BIGINT, logical_at TIMESTAMP_NTZ").parquet(f"{folder}/due"), "logical_at")
    finishes = as_ts(t.spark.readStream.schema(
        "job_id BIGINT, logical_at TIMESTAMP_NTZ, finished_at TIMESTAMP_NTZ").parquet(f"{folder}/done"), "logical_at", "finished_at")
    breaches = _run(t, J.stream_freshness(occurrences, finishes, "1 HOUR", "1 minute"), "breaches")
    return breaches.where("job_id >= 0").withColumn("logical_at", F.col("logical_at").cast("timestamp_ntz"))


@query("window_metrics", """
SELECT time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') AS window_start, event_type, COUNT(*) AS samples, MAX(value) AS max_value, AVG(value) AS mean_value FROM events GROUP BY 1, 2
""")
def _(t):
    return J.stream_metrics(t.events, "ts", "6 hours", ["event_type"], "value")


@query("stream_metrics", """
SELECT time_bucket(INTERVAL 1 DAY, ts, TIMESTAMP '1970-01-01') AS window_start, event_type, COUNT(*) AS samples, MAX(value) AS max_value, AVG(value) AS mean_value
FROM events GROUP BY 1, 2 HAVING time_bucket(INTERVAL 1 DAY, ts, TIMESTAMP '1970-01-01') + INTERVAL 1 DAY <= (SELECT MAX(ts) FROM events) - INTERVAL 1 HOUR
""")
def _(t):
    metrics = J.stream_metrics(_event_stream(t), "ts", "1 day", ["event_type"], "value", "1 hour")
    return _run(t, metrics, "metrics").withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query("late_rows", "SELECT event_id, wm, COALESCE(wm < TIMESTAMP '2024-01-10', TRUE) AS is_late FROM fx_events_null")
def _(t):
    on_time, late = J.split_late(t.fx_events_null, "wm", datetime(2024, 1, 10))
    keep = lambda df, flag: df.select("event_id", "wm", F.lit(flag).alias("is_late"))
    return keep(on_time, False).unionByName(keep(late, True))


@query("stream_late_rows", "SELECT event_id, ts, ts < TIMESTAMP '2024-01-10' AS is_late FROM events")
def _(t):
    main, side, state = (scratch_path(t.spark, f"late-{n}") for n in ("main", "side", "checkpoint"))
    stream = t.spark.readStream.schema(EVENTS_DDL).parquet(f"{t.sf_dir}/{EVENTS}")
    body = J.split_late_batches(main, side, "ts", datetime(2024, 1, 10))
    stream.writeStream.foreachBatch(body).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    read = lambda p, flag: t.spark.read.schema(EVENTS_DDL).parquet(p).select("event_id", "ts", F.lit(flag).alias("is_late"))
    return read(main, False).unionByName(read(side, True))
