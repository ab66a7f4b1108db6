"""Load modes over the sample tables."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tidemark.functions.canon import rules_from_schema
from tidemark.operators import load as L
from tidemark.operators.quality import QualitySpec, run_dq
from tidemark.operators.windows import in_window
from tidemark.plans.canon_sql import row_hash_sql
from tidemark.plans.registry import query, with_strangers

LINE_KEY = ["l_orderkey", "l_linenumber"]
LINE_RULES = [
    ("l_orderkey", "NUMBER", 0), ("l_partkey", "NUMBER", 0), ("l_suppkey", "NUMBER", 0),
    ("l_linenumber", "NUMBER", 0), ("l_quantity", "NUMBER", 2), ("l_extendedprice", "NUMBER", 2),
    ("l_discount", "NUMBER", 2), ("l_tax", "NUMBER", 2), ("l_returnflag", "STRING", None),
    ("l_linestatus", "STRING", None), ("l_shipdate", "TIMESTAMP", None),
]
_LINE_HASH = row_hash_sql(LINE_RULES)
_LINE_COLS = ", ".join(c for c, _, _ in LINE_RULES)
_LINES_LATEST = f"""(SELECT {_LINE_COLS} FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY l_orderkey, l_linenumber
    ORDER BY l_shipdate DESC NULLS LAST, {_LINE_HASH} DESC) AS rn FROM lineitem) WHERE rn = 1)"""


def _line_rules(t):
    return rules_from_schema(t.lineitem.schema, scales={c: s for c, _, s in LINE_RULES if s})


@query("dedup_latest", f"SELECT * FROM {_LINES_LATEST}")
def _(t):
    return L.dedup_standard(t.lineitem, LINE_KEY, "l_shipdate", _line_rules(t))


@query("dedup_latest_ranked", f"SELECT * FROM {_LINES_LATEST}")
def _(t):
    return L.dedup_latest(t.lineitem, LINE_KEY, L.latest_first(t.lineitem, "l_shipdate", _line_rules(t)))


@query("pk_cardinality_before", """
SELECT COUNT(*) AS row_count, COUNT(DISTINCT (l_orderkey, l_linenumber)) AS pk_count,
       COUNT(*) = COUNT(DISTINCT (l_orderkey, l_linenumber)) AS is_unique FROM lineitem
""")
def _(t):
    return L.pk_cardinality(t.lineitem, LINE_KEY)


@query("pk_cardinality_after_dedup", """
SELECT COUNT(DISTINCT (l_orderkey, l_linenumber)) AS row_count, COUNT(DISTINCT (l_orderkey, l_linenumber)) AS pk_count,
       TRUE AS is_unique FROM lineitem
""")
def _(t):
    return L.pk_cardinality(L.dedup_standard(t.lineitem, LINE_KEY, "l_shipdate", _line_rules(t)), LINE_KEY)


# The target holds what was committed in time; a batch re-reads half a day before its window.
_OVERLAP_SQL = """
WITH tgt AS (SELECT * FROM fx_events_commit WHERE wm < TIMESTAMP '2024-01-10' AND commit_ts < TIMESTAMP '2024-01-10'),
b AS (SELECT * FROM fx_events_commit WHERE wm >= TIMESTAMP '2024-01-09 12:00:00' AND wm < TIMESTAMP '2024-01-20')
"""


def _overlap_inputs(t):
    ev = t.fx_events_commit
    target = ev.where("wm < timestamp_ntz'2024-01-10' AND commit_ts < timestamp_ntz'2024-01-10'")
    batch = in_window(ev, "wm", datetime(2024, 1, 9, 12), datetime(2024, 1, 20))
    return batch, target


@query("overlap_anti_join", _OVERLAP_SQL + """
SELECT event_id, wm, wm < TIMESTAMP '2024-01-10' AS overlap_recovered FROM b
WHERE event_id NOT IN (SELECT event_id FROM tgt)
""")
def _(t):
    batch, target = _overlap_inputs(t)
    return L.overlap_anti_join(
        batch, target, ["event_id"], "wm", datetime(2024, 1, 10), timedelta(hours=12),
    ).select("event_id", "wm", "overlap_recovered")


@query("overlap_counts", _OVERLAP_SQL + """
SELECT COUNT(*) AS extracted_rows, COUNT(t.event_id) AS anti_join_dropped_rows,
       COUNT(*) - COUNT(t.event_id) AS written_rows,
       COUNT(*) FILTER (t.event_id IS NULL AND b.wm < TIMESTAMP '2024-01-10') AS overlap_recovered_rows
FROM b LEFT JOIN tgt t USING (event_id)
""")
def _(t):
    batch, target = _overlap_inputs(t)
    return L.overlap_counts(batch, target, ["event_id"], "wm", datetime(2024, 1, 10), timedelta(hours=12))


@query("merge_upsert", """
SELECT COALESCE(b.o_orderkey, t.o_orderkey) AS o_orderkey,
       CASE WHEN b.o_orderkey IS NULL THEN t.o_custkey ELSE b.o_custkey END AS o_custkey,
       CASE WHEN b.o_orderkey IS NULL THEN t.o_orderstatus ELSE b.o_orderstatus END AS o_orderstatus,
       CASE WHEN b.o_orderkey IS NULL THEN t.o_totalprice ELSE b.o_totalprice END AS o_totalprice,
       CASE WHEN b.o_orderkey IS NULL THEN t.o_orderdate ELSE b.o_orderdate END AS o_orderdate,
       CASE WHEN b.o_orderkey IS NULL THEN t.o_orderpriority ELSE b.o_orderpriority END AS o_orderpriority
FROM fx_tgt_orders t FULL JOIN fx_order_batch b ON t.o_orderkey = b.o_orderkey
""")
def _(t):
    return L.merge_cow(t.fx_tgt_orders, t.fx_order_batch, ["o_orderkey"])


@query("merge_upsert_conditional", """
SELECT * FROM fx_tgt_orders t WHERE NOT EXISTS (SELECT 1 FROM fx_order_batch b WHERE b.o_orderkey = t.o_orderkey AND b.o_orderdate > t.o_orderdate)
UNION ALL
SELECT b.* FROM fx_order_batch b LEFT JOIN fx_tgt_orders t ON b.o_orderkey = t.o_orderkey
WHERE t.o_orderkey IS NULL OR b.o_orderdate > t.o_orderdate
""")
def _(t):
    return L.merge_cow(t.fx_tgt_orders, t.fx_order_batch, ["o_orderkey"], when="b.o_orderdate > t.o_orderdate")


@query("merge_on_read", """
SELECT * FROM fx_tgt_orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM fx_order_batch)
UNION ALL SELECT * FROM fx_order_batch
""")
def _(t):
    # Every delta row is logged twice, an older version first.
    older = t.fx_order_batch.withColumn("o_orderdate", F.expr("o_orderdate - INTERVAL 1 DAY")).withColumn(
        "o_totalprice", F.lit(0.0))
    deltas = older.unionByName(t.fx_order_batch)
    return L.read_mor(t.fx_tgt_orders, deltas, ["o_orderkey"], [F.col("o_orderdate").desc()])


@query("soft_delete_flag", "SELECT o_orderkey, o_orderstatus = 'F' AS is_deleted FROM orders")
def _(t):
    return L.apply_soft_delete(t.orders, "o_orderstatus", "F").select("o_orderkey", "is_deleted")


@query("soft_delete_remove", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus <> 'F'")
def _(t):
    return L.apply_soft_delete(t.orders, "o_orderstatus", "F", "DELETE").select("o_orderkey", "o_orderstatus")


@query("pk_reconcile", """
SELECT o_orderkey, 'DELETE' AS pk_action FROM (SELECT o_orderkey FROM fx_tgt_orders EXCEPT SELECT o_orderkey FROM orders)
UNION ALL
SELECT o_orderkey, 'MISSING' FROM (SELECT o_orderkey FROM orders EXCEPT SELECT o_orderkey FROM fx_tgt_orders)
""")
def _(t):
    return L.pk_reconcile(t.orders, t.fx_tgt_orders, ["o_orderkey"])


@query("pk_reconcile_applied", "SELECT o_orderkey FROM fx_tgt_orders WHERE o_orderkey IN (SELECT o_orderkey FROM orders)")
def _(t):
    return L.delete_reconciled(t.fx_tgt_orders, t.orders, ["o_orderkey"]).select("o_orderkey")


_AUDIT_SQL = """
SELECT s.o_orderkey, s.o_orderdate AS source_updated, t.o_orderdate AS target_updated,
       CASE WHEN t.o_orderkey IS NULL THEN 'MISSING' ELSE 'STALE' END AS audit_state
FROM fx_order_batch s LEFT JOIN fx_tgt_orders t USING (o_orderkey)
WHERE s.o_orderdate >= TIMESTAMP '1997-01-01' AND s.o_orderdate < TIMESTAMP '1997-04-01'
  AND (t.o_orderkey IS NULL OR t.o_orderdate < s.o_orderdate)
"""


def _audit(t):
    return L.audit(
        t.fx_order_batch, t.fx_tgt_orders, ["o_orderkey"], "o_orderdate", datetime(1997, 1, 1), datetime(1997, 4, 1))


@query("rolling_audit", _AUDIT_SQL)
def _(t):
    return _audit(t)


@query("audit_repair", f"""
WITH f AS ({_AUDIT_SQL})
SELECT * FROM fx_tgt_orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM f)
UNION ALL SELECT * FROM fx_order_batch WHERE o_orderkey IN (SELECT o_orderkey FROM f)
""")
def _(t):
    return L.repair(t.fx_order_batch, t.fx_tgt_orders, ["o_orderkey"], _audit(t))


@query("empty_source_policy", """
SELECT c_custkey AS job_id, COUNT(o_orderkey) AS extracted_rows, COUNT(o_orderkey) > 0 AS write_target,
       CASE WHEN COUNT(o_orderkey) > 0 THEN 'COMMIT' WHEN c_custkey % 3 = 0 THEN 'FINALIZED_NO_DATA' ELSE 'NO_COMMIT(EMPTY_FULL)' END AS outcome,
       COUNT(o_orderkey) = 0 AS target_unchanged
FROM (SELECT c_custkey FROM customer UNION ALL SELECT c_custkey + 1000000 FROM customer WHERE c_custkey % 10 < 3) LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey
""")
def _(t):
    early = t.orders.groupBy(
        F.col("o_custkey").alias("job_id")).agg(F.count(F.lit(1)).alias("n"))
    counts = with_strangers(t.customer.select("c_custkey"), "c_custkey", "c_custkey % 10 < 3").select(
        F.col("c_custkey").alias("job_id"),
        F.expr("CASE c_custkey % 3 WHEN 0 THEN 'RETAIN_PREVIOUS' WHEN 1 THEN 'FAIL' END").alias("on_empty_source"),
    ).join(early, "job_id", "left").withColumn("extracted_rows", F.coalesce("n", F.lit(0)).cast("bigint"))
    return L.empty_policy(counts).select("job_id", "extracted_rows", "write_target", "outcome", "target_unchanged")


@query("standard_cast", """
WITH r AS (SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN '123456789.5' ELSE CAST(CAST(o_totalprice AS DECIMAL(12,2)) AS VARCHAR) END AS price,
    CASE WHEN o_orderkey % 7 = 0 THEN '' ELSE o_orderpriority END AS prio,
    CASE WHEN o_orderkey % 100 = 0 THEN TIMESTAMP '9999-12-31' ELSE o_orderdate END AS wm FROM orders)
SELECT o_orderkey, CAST(CASE WHEN o_orderkey % 10 <> 0 THEN price END AS DOUBLE) AS price, NULLIF(prio, '') AS prio, wm,
       concat_ws(',', CASE WHEN o_orderkey % 10 = 0 THEN 'price:OUT_OF_RANGE' END,
         CASE WHEN length(prio) > 8 THEN 'prio:TOO_LONG' END,
         CASE WHEN o_orderkey % 100 = 0 THEN 'wm:SENTINEL_DATE' END) AS warnings
FROM r
""")
def _(t):
    raw = t.orders.select(
        "o_orderkey",
        F.expr("CASE WHEN o_orderkey % 10 = 0 THEN '123456789.5' ELSE CAST(CAST(o_totalprice AS DECIMAL(12,2)) AS STRING) END").alias("price"),
        F.expr("CASE WHEN o_orderkey % 7 = 0 THEN '' ELSE o_orderpriority END").alias("prio"),
        F.expr("CASE WHEN o_orderkey % 100 = 0 THEN timestamp_ntz'9999-12-31' ELSE o_orderdate END").alias("wm"))
    rules = [L.CastRule("o_orderkey", "NUMBER(18)"), L.CastRule("price", "NUMBER(8,2)"),
             L.CastRule("prio", "VARCHAR2(8)"), L.CastRule("wm", "DATE")]
    return L.cast_standard(raw, rules).select(
        F.col("o_orderkey").cast("bigint").alias("o_orderkey"), F.col("price").cast("double").alias("price"),
        "prio", "wm", F.array_join("cast_warnings", ",").alias("warnings"))


@query("standard_cast_numbers", """
SELECT o_orderkey, CASE WHEN o_orderkey < 10000000 THEN CAST(round(o_orderkey / 100.0, 0) * 100 AS BIGINT) END AS hundreds,
  CAST(o_orderkey % 100 AS DOUBLE) / 100000 AS small, round(o_orderkey + 0.125, 2) AS cents, CAST(o_orderkey AS VARCHAR) AS wide,
  concat_ws(',', CASE WHEN o_orderkey % 100 <> 0 THEN 'hundreds:ROUNDED' END, 'cents:ROUNDED') AS warnings
FROM orders
""")
def _(t):
    raw = t.orders.selectExpr(
        "o_orderkey", "CAST(o_orderkey AS STRING) AS hundreds", "CAST(CAST(o_orderkey % 100 AS DECIMAL(20,5)) / 100000 AS DECIMAL(20,5)) AS small",
        "CAST(CAST(o_orderkey AS DECIMAL(20,3)) + 0.125 AS STRING) AS cents", "CAST(o_orderkey AS STRING) AS wide")
    rules = [L.CastRule("o_orderkey", "NUMBER(18)"), L.CastRule("hundreds", "NUMBER(5,-2)"), L.CastRule("small", "NUMBER(2,5)"),
             L.CastRule("cents", "NUMBER(18,2)"), L.CastRule("wide", "NUMBER(38,-5)")]
    return L.cast_standard(raw, rules).select(
        F.col("o_orderkey").cast("bigint").alias("o_orderkey"), F.col("hundreds").cast("bigint").alias("hundreds"),
        F.col("small").cast("double").alias("small"), F.col("cents").cast("double").alias("cents"), "wide",
        F.array_join("cast_warnings", ",").alias("warnings"))


@query("column_mapping", """
SELECT o_orderkey AS order_id, upper(o_orderpriority) AS priority, round(o_totalprice * 2, 2) AS doubled,
       year(o_orderdate) AS order_year FROM orders WHERE o_orderstatus = 'O' AND o_totalprice > 1000
""")
def _(t):
    return L.apply_mapping(
        t.orders,
        {"order_id": "o_orderkey", "priority": "upper(o_orderpriority)", "doubled": "round(o_totalprice * 2, 2)",
         "order_year": "CAST(year(o_orderdate) AS BIGINT)"},
        "o_orderstatus = 'O' AND o_totalprice > 1000")


# A column dictionary with one row per order: table = customer, column = order number.
_COLS_SQL = """
WITH reg AS (SELECT o_custkey AS table_id, 'C' || o_orderkey AS column_name, CASE WHEN o_orderkey % 3 = 0 THEN 'NUMBER' ELSE 'VARCHAR2' END AS data_type,
  10 + o_orderkey % 20 AS length FROM orders WHERE o_orderkey % 13 <> 0),
obs AS (SELECT o_custkey AS table_id, 'C' || o_orderkey AS column_name, CASE WHEN o_orderkey % 3 = 0 OR o_orderkey % 17 = 0 THEN 'NUMBER' ELSE 'VARCHAR2' END AS data_type,
  10 + o_orderkey % 20 - CASE WHEN o_orderkey % 19 = 0 THEN 1 ELSE 0 END AS length FROM orders WHERE o_orderkey % 11 <> 0)
"""


def _dictionaries(t):
    reg = t.orders.where("o_orderkey % 13 <> 0").selectExpr(
        "o_custkey AS table_id", "concat('C', o_orderkey) AS column_name",
        "CASE WHEN o_orderkey % 3 = 0 THEN 'NUMBER' ELSE 'VARCHAR2' END AS data_type", "10 + o_orderkey % 20 AS length")
    obs = t.orders.where("o_orderkey % 11 <> 0").selectExpr(
        "o_custkey AS table_id", "concat('C', o_orderkey) AS column_name",
        "CASE WHEN o_orderkey % 3 = 0 OR o_orderkey % 17 = 0 THEN 'NUMBER' ELSE 'VARCHAR2' END AS data_type",
        "10 + o_orderkey % 20 - CASE WHEN o_orderkey % 19 = 0 THEN 1 ELSE 0 END AS length")
    return reg, obs


@query("schema_drift", _COLS_SQL + """
SELECT table_id, column_name, reg.data_type AS registered_type, obs.data_type AS observed_type,
       CASE WHEN reg.data_type IS NULL THEN 'ADDED' WHEN obs.data_type IS NULL THEN 'REMOVED'
            WHEN reg.data_type <> obs.data_type THEN 'TYPE_CHANGED' ELSE 'NARROWED' END AS drift
FROM reg FULL JOIN obs USING (table_id, column_name)
WHERE reg.data_type IS NULL OR obs.data_type IS NULL OR reg.data_type <> obs.data_type OR obs.length < reg.length
""")
def _(t):
    reg, obs = _dictionaries(t)
    return L.schema_drift(reg, obs).select(
        "table_id", "column_name", "registered_type", "observed_type", "drift")


_WORDS = ["SUM(CAST('0x' || substr(d, {}, 8) AS BIGINT))".format(1 + 8 * i) for i in range(8)]


@query("schema_digest", _COLS_SQL + f"""
SELECT table_id, COUNT(*) AS column_count, sha256(concat_ws('|', COUNT(*), {', '.join(_WORDS)})) AS schema_digest
FROM (SELECT table_id, sha256(column_name || ':' || data_type || ':' || length) AS d FROM obs) GROUP BY table_id
""")
def _(t):
    return L.schema_digest(_dictionaries(t)[1])


@query("replay_merge_repair", """
SELECT * FROM fx_tgt_orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '2000-01-01')
UNION ALL SELECT * FROM orders WHERE o_orderdate >= TIMESTAMP '2000-01-01'
""")
def _(t):
    rows = t.orders.where("o_orderdate >= timestamp_ntz'2000-01-01'")
    return L.replay_append(t.fx_tgt_orders, rows, "MERGE_REPAIR", pk=["o_orderkey"])


@query("replay_replace_partitions", """
SELECT * FROM fx_tgt_orders WHERE o_orderdate NOT IN (SELECT o_orderdate FROM orders WHERE o_orderdate >= TIMESTAMP '2000-01-01')
UNION ALL SELECT * FROM orders WHERE o_orderdate >= TIMESTAMP '2000-01-01'
""")
def _(t):
    rows = t.orders.where("o_orderdate >= timestamp_ntz'2000-01-01'")
    return L.replay_append(t.fx_tgt_orders, rows, "REPLACE_PARTITIONS", part="o_orderdate")


@query("touched_partitions", """
WITH n AS (SELECT DISTINCT o_orderdate FROM fx_order_batch),
o AS (SELECT DISTINCT t.o_orderdate FROM fx_tgt_orders t WHERE o_orderkey IN (SELECT o_orderkey FROM fx_order_batch))
SELECT COALESCE(n.o_orderdate, o.o_orderdate) AS o_orderdate, n.o_orderdate IS NOT NULL AS receives_rows, o.o_orderdate IS NOT NULL AS loses_rows
FROM n FULL JOIN o ON n.o_orderdate = o.o_orderdate
""")
def _(t):
    return L.touched_partitions(t.fx_order_batch, t.fx_tgt_orders, ["o_orderkey"], "o_orderdate")


@query("row_count_drift", """
SELECT table_id, stat_day, row_count, trailing_avg, row_count / trailing_avg AS drift_ratio FROM (
  SELECT *, AVG(row_count) OVER (PARTITION BY table_id ORDER BY stat_day ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) AS trailing_avg FROM fx_daily_stats)
WHERE row_count < trailing_avg * 0.5
""")
def _(t):
    return L.row_count_drift(t.fx_daily_stats, ["table_id"], "stat_day", 7, 0.5)


# The whole path of one merge run: plan, extract, dedup, check, merge.
@query("incremental_merge", """
SELECT event_id, user_id, event_type, value, ts FROM (
  SELECT e.event_id, e.user_id, e.event_type, e.value, e.ts FROM events e
  WHERE e.ts < TIMESTAMP '2024-01-20' AND e.ts >= TIMESTAMP '2024-01-10'
  UNION ALL
  SELECT e.event_id, e.user_id, e.event_type, CASE WHEN event_id % 3 = 0 THEN e.value - 1 ELSE e.value END, e.ts
  FROM events e WHERE e.ts < TIMESTAMP '2024-01-10')
""")
def _(t):
    ev = t.events.select("event_id", "user_id", "event_type", "value", "ts")
    stale = F.when(F.col("event_id") % 3 == 0, F.col("value") - 1).otherwise(F.col("value"))
    # The target holds old versions, and already some rows of the window from a lost run.
    target = ev.where("ts < timestamp_ntz'2024-01-11'").withColumn("value", stale)
    extracted = in_window(ev, "ts", datetime(2024, 1, 10), datetime(2024, 1, 20))
    repeats = extracted.where("event_id % 5 = 0")
    batch = L.dedup_latest(
        extracted.unionByName(repeats), ["event_id"], [F.col("ts").desc_nulls_last(), F.col("value").desc()])
    return L.merge_cow(target, batch, ["event_id"])


@query("incremental_merge_quality", """
SELECT user_id AS chunk, COUNT(*) + COUNT(*) FILTER (event_id % 50 = 0) AS chunk_rows, COUNT(*) FILTER (event_id % 50 = 0) AS duplicate_rows,
       COUNT(*) FILTER (event_id % 100 = 0) * 0 AS null_pk_rows, COUNT(*) FILTER (event_id % 100 = 0) * 2 AS null_wm_rows,
       COUNT(*) FILTER (event_id % 100 <> 0 AND ts > TIMESTAMP '2024-01-20') + COUNT(*) FILTER (event_id % 100 = 50 AND ts > TIMESTAMP '2024-01-20') AS rows_above_high,
       COUNT(*) FILTER (event_id % 50 = 0) > 0 OR COUNT(*) FILTER (event_id % 100 <> 0 AND ts > TIMESTAMP '2024-01-20') > 0 AS dq_failed
FROM events GROUP BY user_id
""")
def _(t):
    ev = t.fx_events_null.select("event_id", F.col("user_id").alias("chunk"), "wm")
    ev = ev.unionByName(ev.where("event_id % 50 = 0")).withColumn(
        "high", F.lit(datetime(2024, 1, 20)).cast("timestamp_ntz"))
    return run_dq(ev, QualitySpec(["event_id"], "wm", "chunk", "high"))


