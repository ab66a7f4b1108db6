"""Scans, staging and table writes over the sample tables."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.load import dedup_latest
from tidemark.plans.registry import query
from tidemark.session import scratch_path
from tidemark.sources import extract as X
from tidemark.sources import storage as S
from tidemark.sources.filetable import FileTable

ORDERS_DDL = ("o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE, "
              "o_orderdate TIMESTAMP_NTZ, o_orderpriority STRING")


@query("bounded_extract", """
SELECT event_id, ts, user_id FROM events WHERE ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-20' AND event_type <> 'error' AND user_id % 2 = 0
""")
def _(t):
    bound = X.WindowBound("ts", "TIMESTAMP(6)", datetime(2024, 1, 10), datetime(2024, 1, 20))
    text = X.extract_sql(
        "{events}", ["event_id", "ts", "user_id"], bound, "event_type <> 'error'", "user_id % 2 = 0", "TIMESTAMP_NTZ")
    return t.spark.sql(text, events=t.events)


@query("pruned_table_scan", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01'")
def _(t):
    df = X.read_table(t.spark, f"{t.sf_dir}/orders.parquet", ORDERS_DDL)
    return df.where("o_orderdate >= timestamp_ntz'1998-01-01'").select("o_orderkey", "o_totalprice")


RECORD = T.StructType([
    T.StructField("event_id", T.LongType()), T.StructField("event_type", T.StringType()),
    T.StructField("k", T.LongType())])


def _log_folder(t):
    """Log files with prefixed JSON lines, broken records and unrelated lines, one folder per stream."""
    path = scratch_path(t.spark, "logs")
    line = F.when(F.col("event_id") % 70 == 0, F.concat(F.lit("noise "), F.col("event_id").cast("string"))).when(
        F.col("event_id") % 50 == 1, F.concat(F.lit("LOG {broken "), F.col("event_id").cast("string"))).otherwise(
        F.concat(F.lit("LOG "), F.to_json(F.struct(
            "event_id", "event_type", F.get_json_object("props", "$.k").cast("bigint").alias("k")))))
    t.events.select((F.col("user_id") % 5).alias("stream"), line.alias("value")).write.partitionBy("stream").text(path)
    return path


def _stream_no():
    return F.regexp_extract("file", r"stream=(\d+)", 1).cast("bigint").alias("stream")


@query("jsonl_log_records", """
SELECT user_id % 5 AS stream, event_id, event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k
FROM events WHERE event_id % 70 <> 0 AND event_id % 50 <> 1
""")
def _(t):
    lines = X.read_jsonl_log(t.spark, _log_folder(t), RECORD, "LOG ")
    return lines.where("is_json").select(_stream_no(), "record.*")


@query("jsonl_log_counts", """
SELECT user_id % 5 AS stream, COUNT(*) AS line_count, COUNT(*) FILTER (event_id % 70 <> 0) AS record_count, COUNT(*) FILTER (event_id % 70 <> 0 AND event_id % 50 = 1) AS unparsable
FROM events GROUP BY 1
""")
def _(t):
    counts = X.log_counts(X.read_jsonl_log(t.spark, _log_folder(t), RECORD, "LOG "))
    return counts.groupBy(_stream_no()).agg(
        *[F.sum(c).cast("bigint").alias(c) for c in ("line_count", "record_count", "unparsable")])


def _stage(t):
    root = scratch_path(t.spark, "stage")
    rows = t.events.where("ts >= timestamp_ntz'2024-01-10' AND ts < timestamp_ntz'2024-01-20'")
    manifest = S.stage_chunk(
        rows, root, S.ChunkKey(7, 1, 1), datetime(2024, 1, 10), datetime(2024, 1, 20),
        datetime(2024, 1, 9, 23, 30), "fence-1")
    return root, manifest, S.read_staged(t.spark, manifest, rows.schema)


@query("staged_chunk_rows", "SELECT * FROM events WHERE ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-20'")
def _(t):
    return _stage(t)[2]


@query("staged_chunk_manifest", """
SELECT 7 AS contract_id, 1 AS attempt_no, 1 AS chunk_no, TIMESTAMP '2024-01-09 23:30:00' AS extract_low, COUNT(*) AS row_count, 'SEALED' AS status, TRUE AS is_intact
FROM events WHERE ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-20'
""")
def _(t):
    root, manifest, staged = _stage(t)
    intact = S.verify_staged(staged, manifest).select("is_intact").scalar()
    return S.manifest_log(t.spark, root).read().select(
        "contract_id", "attempt_no", "chunk_no", "extract_low", "row_count", "status", intact.alias("is_intact"))


@query("reusable_chunks", """
SELECT p.contract_id, p.window_low, CASE WHEN EXISTS (SELECT 1 FROM fx_chunk_manifest m WHERE m.contract_id = p.contract_id AND m.window_low = p.window_low
  AND m.window_high = p.window_high AND m.point = p.point AND m.status = 'SEALED' AND m.rows_written = m.staged_rows) THEN 'REUSE' ELSE 'EXTRACT' END AS chunk_action
FROM fx_chunk_plan p
""")
def _(t):
    return S.reusable_chunks(t.fx_chunk_plan, t.fx_chunk_manifest).select("contract_id", "window_low", "chunk_action")


@query("full_replace", "SELECT * FROM orders")
def _(t):
    root = scratch_path(t.spark, "full")
    S.write_full(t.fx_tgt_orders, root)
    S.write_full(t.orders, root)
    S.write_full(t.orders.where("o_orderkey < 0"), root)
    return S.read_current(t.spark, root)


@query("partition_replace", """
SELECT o_orderkey, o_totalprice, o_orderpriority FROM fx_tgt_orders WHERE o_orderpriority NOT IN ('1-URGENT', '5-LOW')
UNION ALL SELECT o_orderkey, o_totalprice, o_orderpriority FROM orders WHERE o_orderpriority IN ('1-URGENT', '5-LOW')
""")
def _(t):
    path = scratch_path(t.spark, "parts")
    S.write_partitions(t.fx_tgt_orders, path, ["o_orderpriority"])
    S.write_partitions(t.orders.where("o_orderpriority IN ('1-URGENT', '5-LOW')"), path, ["o_orderpriority"])
    return t.spark.read.schema(ORDERS_DDL).parquet(path).select("o_orderkey", "o_totalprice", "o_orderpriority")


def _appended(t):
    root = scratch_path(t.spark, "append")
    days = [(1, datetime(1, 1, 1), datetime(2024, 1, 8)), (2, datetime(2024, 1, 8), datetime(2024, 1, 15)), (3, datetime(2024, 1, 15), datetime(9999, 1, 1))]
    for chunk, low, high in [*days, days[1]]:
        rows = t.events.where((F.col("ts") >= F.lit(low).cast("timestamp_ntz")) & (F.col("ts") < F.lit(high).cast("timestamp_ntz")))
        S.write_append(
            rows, f"{root}/data", S.ChunkKey(11, 1, chunk),
            dict(window_low=low, window_high=high, expected_chunk_count=3, actor="RUNPOD", dq_result="PASSED"), f"{root}/ledger")
    return root


@query("append_commit", """
SELECT event_id, ts, CASE WHEN ts < TIMESTAMP '2024-01-08' THEN '11-1-1' WHEN ts < TIMESTAMP '2024-01-15' THEN '11-1-2' ELSE '11-1-3' END AS commit_key FROM events
""")
def _(t):
    data = t.spark.read.schema("event_id BIGINT, ts TIMESTAMP_NTZ, commit_key STRING").parquet(f"{_appended(t)}/data")
    return data.select("event_id", "ts", "commit_key")


@query("ledger_append", """
SELECT 11 AS contract_id, c AS chunk_no, '11-1-' || c AS committed_snapshot_id, CAST(n AS BIGINT) AS written_rows, r AS ledger_rows FROM (
 SELECT 1 AS c, COUNT(*) AS n, 1 AS r FROM events WHERE ts < TIMESTAMP '2024-01-08'
 UNION ALL SELECT 2, COUNT(*), 1 FROM events WHERE ts >= TIMESTAMP '2024-01-08' AND ts < TIMESTAMP '2024-01-15'
 UNION ALL SELECT 3, COUNT(*), 1 FROM events WHERE ts >= TIMESTAMP '2024-01-15')
""")
def _(t):
    ledger = S.ledger_log(t.spark, f"{_appended(t)}/ledger").read()
    return ledger.groupBy("contract_id", "chunk_no", "committed_snapshot_id", "written_rows").agg(
        F.count(F.lit(1)).alias("ledger_rows"))


@query("ledger_fold", """
SELECT event_id // 100 AS contract_id, event_id % 100 AS chunk_no, MAX(user_id) + CASE WHEN MAX(event_id) % 50 = 0 THEN 1 ELSE 0 END AS written_rows, 1 AS ledger_rows, TRUE AS few_files
FROM events WHERE event_id % 8 = 0 GROUP BY 1, 2
""")
def _(t):
    # One entry per commit, appended in bulk; some are repeated with another count after the first fold.
    log = S.ledger_log(t.spark, scratch_path(t.spark, "ledger"))
    rows = t.events.where("event_id % 8 = 0").selectExpr(
        "event_id div 100 AS contract_id", "1L AS attempt_no", "event_id % 100 AS chunk_no", "user_id AS written_rows", "event_id")
    blank = {f.name: F.lit(None).cast(f.dataType) for f in t.spark.createDataFrame([], S.LEDGER_DDL).schema if f.name not in rows.columns}
    ledger = [f.name for f in t.spark.createDataFrame([], S.LEDGER_DDL).schema]
    rows = rows.withColumns(blank)
    log.append_each(rows.select(*ledger).repartition(8, "contract_id"))
    log.fold()
    log.append_each(rows.where("event_id % 50 = 0").withColumn("written_rows", F.col("written_rows") + 1).select(*ledger).coalesce(1))
    log.fold()
    log.purge()
    few = S.count_files(t.spark, log.root) < 100
    return log.read().groupBy("contract_id", "chunk_no", "written_rows").agg(F.count("*").cast("int").alias("ledger_rows"), F.lit(few).alias("few_files"))


_UPSERT = """
SELECT COALESCE(b.o_orderkey, t.o_orderkey) AS o_orderkey, CASE WHEN b.o_orderkey IS NULL THEN t.o_totalprice ELSE b.o_totalprice END AS o_totalprice,
       CASE WHEN b.o_orderkey IS NULL THEN t.o_orderdate ELSE b.o_orderdate END AS o_orderdate,
       strftime(CASE WHEN b.o_orderkey IS NULL THEN t.o_orderdate ELSE b.o_orderdate END, '%Y-%m') AS month
"""


def _orders_by_month(t):
    month = F.date_format("o_orderdate", "yyyy-MM").alias("month")
    base, batch = (df.select("o_orderkey", "o_totalprice", "o_orderdate", month) for df in (t.fx_tgt_orders, t.fx_order_batch))
    table = FileTable(t.spark, scratch_path(t.spark, "orders"), base.schema, "month")
    table.create(base)
    return table, base, batch


@query("partition_merge_publish", _UPSERT + """, (SELECT COUNT(*) FROM (
  SELECT strftime(o_orderdate, '%Y-%m') FROM fx_order_batch WHERE strftime(o_orderdate, '%Y-%m') < '1994-01'
  UNION SELECT strftime(t.o_orderdate, '%Y-%m') FROM fx_tgt_orders t JOIN fx_order_batch b USING (o_orderkey) WHERE strftime(b.o_orderdate, '%Y-%m') < '1994-01')) AS rewritten, TRUE AS others_kept
FROM fx_tgt_orders t FULL JOIN (SELECT * FROM fx_order_batch WHERE strftime(o_orderdate, '%Y-%m') < '1994-01') b ON t.o_orderkey = b.o_orderkey
""")
def _(t):
    table, _, batch = _orders_by_month(t)
    before = {(r.part, r.path) for r in table.files().collect()}
    facts = table.merge(batch.where("month < '1994-01'"), ["o_orderkey"])
    after = {(r.part, r.path) for r in table.files().collect()}
    changed = {part for part, _ in before - after} | {part for part, _ in after - before}
    return table.read().withColumns({
        "rewritten": F.lit(facts["partitions"]).cast("bigint"), "others_kept": F.lit(len(changed) == facts["partitions"])})


@query("merge_on_read_positions", _UPSERT + "FROM fx_tgt_orders t FULL JOIN fx_order_batch b ON t.o_orderkey = b.o_orderkey")
def _(t):
    # Every row comes twice: an older price in the first delta, the last one in the second.
    table, _, batch = _orders_by_month(t)
    table.merge_delta(batch.withColumn("o_totalprice", F.lit(0.0)), ["o_orderkey"])
    table.merge_delta(batch, ["o_orderkey"])
    return table.read()


@query("file_compaction", _UPSERT + """, TRUE AS large_kept, TRUE AS fewer_files, TRUE AS done
FROM fx_tgt_orders t FULL JOIN fx_order_batch b ON t.o_orderkey = b.o_orderkey
""")
def _(t):
    table, base, batch = _orders_by_month(t)
    for part in range(3):
        table.merge_delta(batch.where(F.col("o_orderkey") % 3 == part), ["o_orderkey"])
    before = {r.path: r.bytes for r in table.files().where("kind = 'DATA'").collect()}
    target = max(before.values())
    masked = {r.path.rsplit("/", 1)[1] for r in t.spark.read.parquet(*[r.path for r in table.files().where("kind = 'MASK'").collect()]).select(
        F.col("file").alias("path")).distinct().collect()}
    table.compact(target)
    after = {r.path for r in table.files().collect()}
    large = {p for p, n in before.items() if n >= 0.75 * target and p.rsplit("/", 1)[1] not in masked}
    again = table.compact(target)
    return table.read().withColumns({
        "large_kept": F.lit(large <= after), "fewer_files": F.lit(len(after) < len(before)), "done": F.lit(again["files_before"] == 0)})


@query("partition_columns", """
SELECT o_orderkey, CASE WHEN o_orderkey % 100 <> 0 THEN strftime(o_orderdate, '%Y-%m-%d') END AS dt,
  CASE WHEN o_orderkey % 100 <> 0 THEN strftime(date_trunc('week', o_orderdate), '%Y-%m-%d') END AS wt,
  CASE WHEN o_orderkey % 100 <> 0 THEN strftime(o_orderdate, '%Y-%m') END AS mt, CASE WHEN o_orderkey % 100 <> 0 THEN strftime(o_orderdate, '%Y') END AS yt FROM orders
""")
def _(t):
    rows = t.orders.select("o_orderkey", F.expr(
        "CASE WHEN o_orderkey % 100 = 0 THEN timestamp_ntz'9999-12-31' ELSE o_orderdate END").alias("at"))
    return S.with_partition_cols(rows, "at").drop("at")


@query("compacted_table", "SELECT o_orderkey, o_totalprice, o_orderstatus, TRUE AS fewer_files FROM orders")
def _(t):
    small, big = scratch_path(t.spark, "small"), scratch_path(t.spark, "big")
    t.orders.repartition(24).write.partitionBy("o_orderstatus").parquet(small)
    facts = S.compact(t.spark, small, big, ["o_orderstatus"], 64 << 20)
    return t.spark.read.schema(ORDERS_DDL).parquet(big).select(
        "o_orderkey", "o_totalprice", "o_orderstatus", F.lit(facts["files_after"] < facts["files_before"]).alias("fewer_files"))


@query("orphan_files", """
SELECT 'f' || event_id AS path, ts AS modified_at FROM events WHERE ts < TIMESTAMP '2024-01-25' - INTERVAL 3 DAY AND event_id % 10 = 0
""")
def _(t):
    listing = t.events.selectExpr("concat('f', event_id) AS path", "ts AS modified_at")
    live = t.events.where("event_id % 10 <> 0").selectExpr("concat('f', event_id) AS path")
    return S.orphan_files(listing, live, timedelta(days=3), datetime(2024, 1, 25)).select("path", "modified_at")


@query("expirable_snapshots", """
WITH r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY table_id ORDER BY committed_at DESC, snapshot_id DESC) AS rn FROM fx_snapshots)
SELECT snapshot_id, table_id FROM r WHERE rn > 5 AND committed_at < (SELECT MAX(committed_at) FROM fx_snapshots) - INTERVAL 6 HOUR
  AND NOT EXISTS (SELECT 1 FROM fx_ledger l WHERE l.contract_id = r.contract_id AND NOT l.cas_applied)
""")
def _(t):
    now = t.fx_snapshots.agg(F.max("committed_at")).scalar()
    open_contracts = t.fx_ledger.where("NOT cas_applied").select("contract_id").distinct()
    return S.expirable_snapshots(t.fx_snapshots, open_contracts, timedelta(hours=6), now, 5).select("snapshot_id", "table_id")


@query("versioned_merge_publish", """
SELECT user_id, MAX(ts) AS last_seen FROM events GROUP BY user_id
""")
def _(t):
    from tidemark.operators.load import merge_cow

    root = scratch_path(t.spark, "merge")
    rows = t.events.select("user_id", F.col("ts").alias("last_seen"))
    newest = lambda df: dedup_latest(df, ["user_id"], [F.desc("last_seen")])
    S.write_full(newest(rows.where("last_seen < timestamp_ntz'2024-01-15'")), root)
    merged = merge_cow(S.read_current(t.spark, root), newest(rows.where("last_seen >= timestamp_ntz'2024-01-15'")), ["user_id"])
    S.write_full(merged, root, "MERGE")
    return S.read_current(t.spark, root)
