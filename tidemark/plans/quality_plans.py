"""Pre-commit checks over the sample tables."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from tidemark.operators import quality as Q
from tidemark.plans.registry import query


@query("dq_row_balance", """
SELECT receipt_id, extracted_rows = written_rows + dedup_dropped_rows + anti_join_dropped_rows AS balance_ok,
       COALESCE(written_rows = CASE load_mode WHEN 'APPEND' THEN added_records WHEN 'FULL' THEN total_records ELSE merge_input_rows END, FALSE) AS commit_ok
FROM fx_receipts
""")
def _(t):
    return Q.dq_row_balance(t.fx_receipts).select("receipt_id", "balance_ok", "commit_ok")


@query("dq_pk_unique", """
SELECT l_orderkey, l_linenumber, COUNT(*) AS occurrences FROM lineitem GROUP BY ALL HAVING COUNT(*) > 1
""")
def _(t):
    return Q.dq_pk_unique(t.lineitem, ["l_orderkey", "l_linenumber"])


@query("dq_pk_unique_in_partition", """
SELECT l_returnflag, l_orderkey, l_linenumber, COUNT(*) AS occurrences FROM lineitem GROUP BY ALL HAVING COUNT(*) > 1
""")
def _(t):
    return Q.dq_pk_unique(t.lineitem, ["l_orderkey", "l_linenumber"], ["l_returnflag"])


@query("dq_not_null", """
SELECT COUNT(*) - COUNT(event_id) AS null_event_id, COUNT(*) - COUNT(wm) AS null_wm FROM fx_events_null
""")
def _(t):
    return Q.dq_not_null(t.fx_events_null, ["event_id", "wm"])


@query("dq_window_max", """
SELECT MAX(ts) AS max_wm, MAX(ts) <= TIMESTAMP '2024-01-20' AS window_max_ok FROM events
""")
def _(t):
    return Q.dq_window_max(t.events, "ts", datetime(2024, 1, 20))


@query("dq_row_drop", """
SELECT w.table_id, written_rows, previous_rows, previous_rows IS NULL OR written_rows * 2 > previous_rows AS row_drop_ok
FROM fx_full_written w LEFT JOIN fx_full_previous p ON w.table_id = p.table_id
""")
def _(t):
    return Q.dq_row_drop(t.fx_full_written, t.fx_full_previous)


@query("merge_accounting", """
SELECT COUNT(*) AS input_rows, COUNT(*) FILTER (t.o_orderkey IS NULL) AS inserted_rows,
  COUNT(*) FILTER (t.o_orderkey IS NOT NULL AND NOT b.o_custkey % 10 = 3 AND b.o_orderdate > t.o_orderdate) AS updated_rows,
  COUNT(*) FILTER (t.o_orderkey IS NOT NULL AND b.o_custkey % 10 = 3) AS deleted_rows,
  COUNT(*) FILTER (t.o_orderkey IS NOT NULL AND NOT b.o_custkey % 10 = 3 AND NOT b.o_orderdate > t.o_orderdate) AS ignored_rows,
  TRUE AS balanced
FROM fx_order_batch b LEFT JOIN fx_tgt_orders t ON b.o_orderkey = t.o_orderkey
""")
def _(t):
    return Q.merge_metrics(
        t.fx_tgt_orders, t.fx_order_batch, ["o_orderkey"],
        when="b.o_orderdate > t.o_orderdate", delete="b.o_custkey % 10 = 3")


@query("dq_summary", """
WITH k AS (SELECT l_returnflag || l_linestatus AS chunk, l_orderkey, l_linenumber, COUNT(*) AS n,
   COUNT(*) FILTER (l_partkey % 200 = 0) AS nw, COUNT(*) FILTER (l_partkey % 200 <> 0 AND l_shipdate > TIMESTAMP '2001-12-01') AS ab
   FROM lineitem GROUP BY ALL)
SELECT chunk, CAST(SUM(n) AS BIGINT) AS chunk_rows, CAST(SUM(n - 1) AS BIGINT) AS duplicate_rows, 0 AS null_pk_rows,
  CAST(SUM(nw) AS BIGINT) AS null_wm_rows, CAST(SUM(ab) AS BIGINT) AS rows_above_high, SUM(n - 1) + SUM(nw) + SUM(ab) > 0 AS dq_failed
FROM k GROUP BY chunk
""")
def _(t):
    rows = t.lineitem.select(
        F.concat("l_returnflag", "l_linestatus").alias("chunk"), "l_orderkey", "l_linenumber",
        F.when(F.col("l_partkey") % 200 != 0, F.col("l_shipdate")).alias("wm"),
        F.lit(datetime(2001, 12, 1)).cast("timestamp_ntz").alias("high"))
    return Q.run_dq(rows, Q.QualitySpec(["l_orderkey", "l_linenumber"], "wm", "chunk", "high"))


@query("dq_source_count", """
SELECT c_custkey AS table_id, COUNT(o_orderkey) AS source_rows, COUNT(o_orderkey) FILTER (o_orderkey % 97 <> 0) AS loaded_rows,
       COUNT(o_orderkey) FILTER (o_orderkey % 97 = 0) = 0 AS source_count_ok
FROM customer JOIN orders ON c_custkey = o_custkey WHERE c_custkey % 2 = 0 AND c_custkey % 5 <> 0 GROUP BY c_custkey
""")
def _(t):
    src = t.orders.groupBy(F.col("o_custkey").alias("table_id")).agg(F.count(F.lit(1)).alias("source_rows"))
    src = src.withColumn("count_allowed", F.col("table_id") % 2 == 0).withColumn("is_critical", F.col("table_id") % 5 == 0)
    receipts = t.orders.where("o_orderkey % 97 <> 0").select(
        F.col("o_custkey").alias("table_id"), F.lit(1).alias("written_rows"))
    return Q.dq_source_count(src, receipts)
