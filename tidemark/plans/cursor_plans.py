"""Cursor strategies and their audits over the sample tables."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tidemark.operators import cursors as C
from tidemark.plans.registry import query, with_strangers

INSERT_RANGE = (datetime(1997, 1, 1), datetime(1998, 1, 1))
UPDATE_RANGE = (datetime(1998, 6, 1), datetime(1998, 9, 1))
_TWO_COLS = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, insert_dt, update_dt"


@query("two_watermarks_or", f"""
SELECT {_TWO_COLS} FROM fx_two_wm
WHERE (insert_dt >= TIMESTAMP '1997-01-01' AND insert_dt < TIMESTAMP '1998-01-01')
   OR (update_dt >= TIMESTAMP '1998-06-01' AND update_dt < TIMESTAMP '1998-09-01')
""")
def _(t):
    return C.dual_window_or(t.fx_two_wm, ["insert_dt", "update_dt"], [INSERT_RANGE, UPDATE_RANGE])


@query("two_watermarks_union", f"""
SELECT {_TWO_COLS} FROM fx_two_wm WHERE insert_dt >= TIMESTAMP '1997-01-01' AND insert_dt < TIMESTAMP '1998-01-01'
UNION ALL
SELECT {_TWO_COLS} FROM fx_two_wm WHERE update_dt >= TIMESTAMP '1998-06-01' AND update_dt < TIMESTAMP '1998-09-01'
  AND NOT (insert_dt >= TIMESTAMP '1997-01-01' AND insert_dt < TIMESTAMP '1998-01-01')
""")
def _(t):
    return C.dual_window_union(t.fx_two_wm, ["insert_dt", "update_dt"], [INSERT_RANGE, UPDATE_RANGE])


@query("two_watermarks_union_dedup", f"""
SELECT {_TWO_COLS} FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY l_orderkey, l_linenumber
     ORDER BY update_dt DESC NULLS LAST, l_partkey DESC, l_suppkey DESC, l_quantity DESC) AS rn
  FROM fx_two_wm WHERE (insert_dt >= TIMESTAMP '1997-01-01' AND insert_dt < TIMESTAMP '1998-01-01')
     OR (update_dt >= TIMESTAMP '1998-06-01' AND update_dt < TIMESTAMP '1998-09-01')) WHERE rn = 1
""")
def _(t):
    order = [F.col("update_dt").desc_nulls_last(), *[F.desc(c) for c in ("l_partkey", "l_suppkey", "l_quantity")]]
    return C.dual_window_union(
        t.fx_two_wm, ["insert_dt", "update_dt"], [INSERT_RANGE, UPDATE_RANGE],
        pk=["l_orderkey", "l_linenumber"], order=order)


@query("axis_recall", """
SELECT strategy, COUNT(DISTINCT o_orderkey) AS loaded_rows, (SELECT COUNT(*) FROM orders) AS source_rows,
       (SELECT COUNT(*) FROM orders) - COUNT(DISTINCT o_orderkey) AS missed_rows
FROM fx_axis_loaded GROUP BY strategy
UNION ALL SELECT 'none', 0, COUNT(*), COUNT(*) FROM orders
""")
def _(t):
    # A strategy whose only loads are rows that the source does not have.
    stray = t.orders.selectExpr("'none' AS strategy", "-1 - o_orderkey AS o_orderkey")
    loaded = t.fx_axis_loaded.select("strategy", "o_orderkey").unionByName(stray)
    return C.axis_recall(t.orders, loaded, ["o_orderkey"])


@query("never_loaded", """
SELECT event_id, wm FROM fx_events_null e
WHERE NOT EXISTS (SELECT 1 FROM fx_events_null s WHERE s.event_id = e.event_id
                  AND s.wm >= TIMESTAMP '2024-01-01' AND s.wm < TIMESTAMP '2024-01-25')
""")
def _(t):
    src = t.fx_events_null
    loaded = src.where("wm >= timestamp_ntz'2024-01-01' AND wm < timestamp_ntz'2024-01-25'")
    return C.never_loaded(src, loaded, ["event_id"]).select("event_id", "wm")


@query("late_commits", """
SELECT e.event_id, e.user_id, e.wm, e.commit_ts, c.window_low, c.window_high, c.cas_at
FROM fx_events_commit e JOIN fx_cycles c ON e.user_id = c.user_id AND e.wm >= c.window_low AND e.wm < c.window_high
WHERE e.commit_ts > c.cas_at
""")
def _(t):
    rows = t.fx_events_commit.select("event_id", "user_id", "wm", "commit_ts")
    return C.late_commits(rows, t.fx_cycles, "user_id", "wm", "commit_ts")


@query("null_watermark_recovery", """
SELECT event_id, ts FROM fx_events_null WHERE wm IS NULL AND ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-20'
""")
def _(t):
    return C.null_wm_rows(
        t.fx_events_null, "wm", "ts", datetime(2024, 1, 10), datetime(2024, 1, 20)).select("event_id", "ts")


_NOW_SEQ = "(SELECT CAST(MAX(seq) - 5 AS BIGINT) FROM fx_sharded)"


def _now_seq(t):
    return t.fx_sharded.agg(F.max("seq") - 5).scalar()


@query("shard_sweep_global", f"""
SELECT pk, shard, seq FROM fx_sharded
WHERE seq > (SELECT MIN(cursor_seq) FROM fx_shard_cursors) AND seq <= {_NOW_SEQ}
""")
def _(t):
    return C.shard_sweep(t.fx_sharded, "shard", "seq", t.fx_shard_cursors, _now_seq(t)).select("pk", "shard", "seq")


@query("shard_sweep_per_shard", f"""
SELECT pk, s.shard, seq FROM fx_sharded s JOIN fx_shard_cursors c ON s.shard = c.shard
WHERE seq > cursor_seq AND seq <= {_NOW_SEQ}
""")
def _(t):
    return C.shard_sweep(
        t.fx_sharded, "shard", "seq", t.fx_shard_cursors, _now_seq(t), global_=False).select("pk", "shard", "seq")


@query("shard_sweep_loss", f"""
SELECT pk, s.shard, seq FROM fx_sharded s JOIN fx_shard_cursors c ON s.shard = c.shard
WHERE seq > (SELECT MIN(cursor_seq) FROM fx_shard_cursors) AND seq <= cursor_seq AND seq <= {_NOW_SEQ}
""")
def _(t):
    return C.shard_sweep_loss(
        t.fx_sharded, "shard", "seq", t.fx_shard_cursors, _now_seq(t)).select("pk", "shard", "seq")


@query("replay_admission", """
SELECT r.ledger_id, CASE WHEN r.window_high <= r.window_low THEN 'EMPTY_RANGE'
       WHEN r.window_high <= w.wm THEN 'ADMITTED' ELSE 'OVERLAPS_OPEN_RANGE' END AS admission
FROM fx_ledger r LEFT JOIN (SELECT job_id, MAX(window_high) - INTERVAL 200 DAY AS wm FROM fx_ledger WHERE job_id % 7 <> 0 GROUP BY job_id) w
  ON r.job_id = w.job_id
""")
def _(t):
    requests = t.fx_ledger.selectExpr("ledger_id", "job_id", "window_low AS range_low", "window_high AS range_high")
    marks = t.fx_ledger.where("job_id % 7 <> 0").groupBy("job_id").agg(
        (F.max("window_high") - F.expr("INTERVAL 200 DAY")).alias("current_watermark"))
    return C.admit_ranges(requests, marks).select("ledger_id", "admission")


@query("backfill_items", """
WITH p AS (SELECT source_id, source_id AS plan_id, TIMESTAMP '2024-01-01' AS lo,
                  TIMESTAMP '2024-01-01' + (1 + source_id % 9) * INTERVAL 10 HOUR AS hi FROM fx_sources)
SELECT plan_id, job_id, source_id, connections, i + 1 AS item_no, lo + i * INTERVAL 1 DAY AS item_low,
       LEAST(lo + (i + 1) * INTERVAL 1 DAY, hi) AS item_high, strftime(lo + i * INTERVAL 1 DAY, '%Y-%m-%d') AS touched_dt
FROM (SELECT p.*, j.job_id, j.connections, UNNEST(RANGE(CAST(CEIL(date_diff('second', lo, hi) / 86400.0) AS BIGINT))) AS i
      FROM p JOIN fx_jobs j USING (source_id))
""")
def _(t):
    plans = t.fx_sources.selectExpr(
        "source_id", "source_id AS plan_id", "timestamp_ntz'2024-01-01' AS range_low",
        "timestamp_ntz'2024-01-01' + (1 + source_id % 9) * INTERVAL 10 HOUR AS range_high")
    return C.backfill_items(plans, t.fx_jobs, timedelta(days=1))


@query("catch_up_coalesce", """
SELECT job_id, load_mode, MAX(logical_at) AS logical_at,
       CASE WHEN load_mode <> 'FULL' THEN MIN(window_low) END AS window_low,
       CASE WHEN load_mode <> 'FULL' THEN MAX(window_high) END AS window_high,
       COUNT(*) AS missed_runs, CASE WHEN load_mode = 'FULL' THEN COUNT(*) - 1 ELSE 0 END AS dropped_runs
FROM fx_missed GROUP BY job_id, load_mode
""")
def _(t):
    return C.coalesce_missed(t.fx_missed)


@query("unchanged_sources", """
SELECT o_custkey AS table_id, MAX(o_orderdate) AS max_update FROM orders GROUP BY o_custkey
HAVING MAX(o_orderdate) <= MAX(CASE WHEN o_orderkey % 3 <> 0 THEN o_orderdate END)
""")
def _(t):
    stats = t.orders.groupBy(F.col("o_custkey").alias("table_id")).agg(F.max("o_orderdate").alias("max_update"))
    last = t.orders.where("o_orderkey % 3 <> 0").groupBy(F.col("o_custkey").alias("table_id")).agg(
        F.max("o_orderdate").alias("last_loaded"))
    return C.unchanged_sources(stats, last).select("table_id", "max_update")


@query("commit_delay_stats", """
SELECT source_id, MAX(epoch_us(commit_ts) - epoch_us(wm)) / 1000000.0 AS max_delay_s, COUNT(*) AS observed_rows,
       quantile_cont((epoch_us(commit_ts) - epoch_us(wm)) / 1000000.0, 0.99) AS p99_delay_s
FROM fx_events_commit GROUP BY source_id
""")
def _(t):
    return C.commit_delay_stats(t.fx_events_commit, "source_id", "wm", "commit_ts")


@query("overlap_sufficiency", """
SELECT job_id, max_commit_delay_s + safety_lag_s + clock_skew_s AS required_overlap_s,
       CASE WHEN max_commit_delay_s IS NULL THEN 'UNKNOWN' WHEN overlap_s >= max_commit_delay_s + safety_lag_s + clock_skew_s THEN 'OK'
            WHEN grade = 'ZERO_GAP' THEN 'REJECT' ELSE 'WARN' END AS overlap_result
FROM (SELECT * FROM fx_jobs UNION ALL SELECT * REPLACE (source_id + 1000000 AS source_id) FROM fx_jobs WHERE source_id % 6 = 5) LEFT JOIN fx_sources USING (source_id)
""")
def _(t):
    return C.overlap_check(with_strangers(t.fx_jobs, "source_id", "source_id % 6 = 5"), t.fx_sources).select("job_id", "required_overlap_s", "overlap_result")


@query("stalled_watermarks", """
WITH a AS (SELECT *, LAG(max_wm) OVER (PARTITION BY source_id, table_id ORDER BY observed_at) AS pm FROM fx_fence_log),
b AS (SELECT *, SUM(CASE WHEN pm IS NULL OR max_wm > pm THEN 1 ELSE 0 END)
                OVER (PARTITION BY source_id, table_id ORDER BY observed_at) AS g FROM a)
SELECT source_id, table_id, MIN(observed_at) AS stalled_since, MAX(observed_at) AS last_observed,
       MAX(max_wm) AS max_wm, COUNT(*) AS observations
FROM b GROUP BY source_id, table_id, g HAVING COUNT(*) >= 3
""")
def _(t):
    return C.stalled_watermarks(t.fx_fence_log, 3)


@query("keyset_window", """
SELECT event_id, wm FROM fx_events_tied
WHERE (wm > TIMESTAMP '2024-01-05' OR (wm = TIMESTAMP '2024-01-05' AND event_id >= 1500))
  AND (wm < TIMESTAMP '2024-01-08' OR (wm = TIMESTAMP '2024-01-08' AND event_id < 2500))
""")
def _(t):
    return C.keyset_window(
        t.fx_events_tied, "wm", "event_id", (datetime(2024, 1, 5), 1500), (datetime(2024, 1, 8), 2500),
    ).select("event_id", "wm")


@query("keyset_next_cursor", """
SELECT wm AS cursor_wm, event_id AS cursor_pk FROM fx_events_tied ORDER BY wm DESC, event_id DESC LIMIT 1
""")
def _(t):
    return C.next_keyset(t.fx_events_tied, "wm", "event_id")
