"""Inputs derived from the sample tables, as SQL text both engines read the same way.

``{name}`` refers to a sample table or to another entry. Every rule is deterministic and works row by
row or by plain aggregation, so the inputs grow with the tables.
"""

from __future__ import annotations

FIXTURES: dict[str, str] = {}

# ---- source and target of a load -------------------------------------------------------------

FIXTURES["fx_tgt_orders"] = """
SELECT o_orderkey, o_custkey, o_orderstatus,
       CASE WHEN o_orderkey % 89 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice,
       o_orderdate, o_orderpriority
FROM {orders} WHERE o_orderkey % 97 <> 0
UNION ALL
SELECT o_orderkey + 10000000 AS o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority
FROM {orders} WHERE o_orderkey % 101 = 0
"""

# Orders as updated rows: half of the keys, later dated, some new.
FIXTURES["fx_order_batch"] = """
SELECT CASE WHEN o_orderkey % 4 = 0 THEN o_orderkey + 20000000 ELSE o_orderkey END AS o_orderkey,
       o_custkey, 'U' AS o_orderstatus, o_totalprice + 5 AS o_totalprice,
       o_orderdate + (o_orderkey % 3) * INTERVAL 1 DAY - INTERVAL 1 DAY AS o_orderdate, o_orderpriority
FROM {orders} WHERE o_orderkey % 2 = 0
"""

# ---- events with every kind of watermark ------------------------------------------------------

FIXTURES["fx_events_null"] = """
SELECT event_id, user_id, event_type, value, ts,
       CASE WHEN event_id % 100 = 0 THEN NULL ELSE ts END AS wm
FROM {events}
"""

FIXTURES["fx_events_future"] = """
SELECT event_id, user_id, event_type, value, ts,
       CASE WHEN event_id % 1000 = 0 THEN ts + INTERVAL 365 DAY ELSE ts END AS wm
FROM {events}
"""

FIXTURES["fx_events_tied"] = """
SELECT event_id, user_id, event_type, value, ts, CAST(date_trunc('day', ts) AS TIMESTAMP) AS wm
FROM {events}
"""

FIXTURES["fx_events_commit"] = """
SELECT event_id, user_id, event_type, value, ts AS wm,
       ts + (event_id % 7) * INTERVAL 1 HOUR AS commit_ts,
       user_id % 25 AS source_id
FROM {events}
"""

# Load cycles: one window per day and job (user), closed a few hours after the day ended.
FIXTURES["fx_cycles"] = """
SELECT user_id, wm AS window_low, wm + INTERVAL 1 DAY AS window_high,
       wm + INTERVAL 1 DAY + (user_id % 4) * INTERVAL 1 HOUR AS cas_at
FROM {fx_events_tied} GROUP BY user_id, wm
"""

FIXTURES["fx_fences"] = """
SELECT user_id % 25 AS source_id,
       MAX(ts) AS max_wm,
       MAX(CASE WHEN event_id % 3 = 0 THEN ts END) AS t_lb,
       MAX(ts) + INTERVAL 45 SECOND AS t_now,
       MAX(ts) + INTERVAL 10 MINUTE AS t0,
       (MIN(user_id) % 20) * INTERVAL 1 MINUTE AS commit_delay
FROM {events} GROUP BY user_id % 25
"""

FIXTURES["fx_cutoffs"] = """
SELECT source_id, CASE WHEN source_id % 12 = 11 THEN NULL ELSE max_wm END AS safe_cutoff FROM {fx_fences}
"""

# One observation of the fence per source, table and hour; tables with odd number move slowly.
FIXTURES["fx_fence_log"] = """
SELECT user_id % 25 AS source_id, user_id AS table_id, ts AS observed_at,
       CASE WHEN user_id % 2 = 0 THEN ts ELSE CAST(date_trunc('day', ts) AS TIMESTAMP) END AS max_wm
FROM {events}
"""

FIXTURES["fx_two_wm"] = """
SELECT l.l_orderkey, l.l_linenumber, l.l_partkey, l.l_suppkey, l.l_quantity, o.o_orderdate AS insert_dt,
       CASE WHEN l.l_partkey % 3 = 0 THEN NULL ELSE l.l_shipdate END AS update_dt
FROM {lineitem} l JOIN {orders} o ON l.l_orderkey = o.o_orderkey
"""

FIXTURES["fx_axis_loaded"] = """
SELECT 'insert_only' AS strategy, o_orderkey FROM {orders} WHERE o_orderkey % 3 <> 0
UNION ALL SELECT 'update_only' AS strategy, o_orderkey FROM {orders} WHERE o_orderkey % 5 = 0
UNION ALL SELECT 'independent' AS strategy, o_orderkey FROM {orders} WHERE o_orderkey % 3 <> 0 OR o_orderkey % 5 = 0
UNION ALL SELECT 'independent' AS strategy, o_orderkey FROM {orders} WHERE o_orderkey % 5 = 0
"""

FIXTURES["fx_sharded"] = """
SELECT event_id AS pk, user_id % 8 AS shard, event_id AS seq, event_type FROM {events}
"""

FIXTURES["fx_shard_cursors"] = """
SELECT user_id % 8 AS shard, CAST(floor(MAX(event_id) * (1 + MIN(user_id % 8)) / 16.0) AS BIGINT) AS cursor_seq
FROM {events} GROUP BY user_id % 8
"""

# ---- jobs, sources, runs ----------------------------------------------------------------------

FIXTURES["fx_jobs"] = """
SELECT c_custkey AS job_id, c_nationkey AS source_id, c_custkey % 150 AS table_id, c_mktsegment AS domain,
       CASE c_custkey % 5 WHEN 3 THEN 'APPEND' WHEN 4 THEN 'MERGE' ELSE 'FULL' END AS load_mode,
       CASE c_custkey % 6 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 4 WHEN 3 THEN 6 WHEN 4 THEN 12 ELSE 24 END AS period_hours,
       CASE c_custkey % 3 WHEN 0 THEN 'Asia/Seoul' WHEN 1 THEN 'America/New_York' ELSE 'UTC' END AS timezone,
       CASE WHEN c_custkey % 4 = 0 THEN 'ZERO_GAP' ELSE 'BEST_EFFORT' END AS grade,
       CASE c_custkey % 7 WHEN 0 THEN 'NONE_DECLARED' WHEN 1 THEN 'SOFT_DELETE' WHEN 2 THEN 'PK_RECONCILE'
            WHEN 3 THEN 'CDC_LATER' ELSE 'SOFT_DELETE' END AS delete_semantics,
       CASE WHEN c_custkey % 9 = 0 THEN NULL ELSE 1800 + c_custkey % 7200 END AS freshness_slo_s,
       CAST(60 + c_custkey % 600 AS BIGINT) AS duration_s, CAST(1 + c_custkey % 2 AS BIGINT) AS connections,
       CAST(c_custkey % 4000 AS BIGINT) AS overlap_s,
       CASE WHEN c_custkey % 10 = 0 THEN NULL
            ELSE TIMESTAMP '2024-01-05 00:00:00' + (c_custkey % 30) * INTERVAL 1 DAY END AS current_watermark
FROM {customer}
"""

FIXTURES["fx_sources"] = """
SELECT c_nationkey AS source_id, CAST(4 + MIN(c_nationkey) % 5 AS BIGINT) AS pool_cap,
       CAST(600 + 60 * MIN(c_nationkey) AS BIGINT) AS max_commit_delay_s, CAST(120 AS BIGINT) AS safety_lag_s,
       CAST(5 AS BIGINT) AS clock_skew_s,
       CASE WHEN MIN(c_nationkey) % 3 = 0 THEN 'ENFORCED' ELSE 'OBSERVED' END AS bound_kind,
       CASE WHEN MIN(c_nationkey) % 2 = 0 THEN TRUE ELSE FALSE END AS zero_gap_verified
FROM {customer} GROUP BY c_nationkey
"""

# Jobs with an open window, some still at their original lower bound.
FIXTURES["fx_windows"] = """
SELECT c_custkey AS job_id,
       TIMESTAMP '2024-01-10 00:00:00' + (c_custkey % 2) * INTERVAL 6 HOUR AS window_low,
       TIMESTAMP '2024-01-10 00:00:00' AS original_low,
       TIMESTAMP '2024-01-10 00:00:00' + (c_custkey % 60) * INTERVAL 90 MINUTE AS window_high
FROM {customer}
"""

FIXTURES["fx_occurrences"] = """
SELECT o_orderkey AS occurrence_id, o_custkey AS job_id, o_orderdate AS logical_at,
       CASE o_orderkey % 4 WHEN 0 THEN 'CATCHUP' WHEN 3 THEN 'BACKFILL' ELSE 'NORMAL' END AS operation_class,
       CASE WHEN o_orderkey % 19 = 0 THEN 'SKIPPED_BY_HOLD' WHEN o_orderkey % 23 = 0 THEN 'SUPERSEDED_BY'
            WHEN o_orderkey % 11 = 0 THEN 'COALESCED_INTO' WHEN o_orderkey % 29 = 0 THEN 'EXPIRED_UNLAUNCHED'
            ELSE 'EXECUTED' END AS disposition,
       CASE WHEN o_orderkey % 11 = 0 THEN CAST(floor(o_orderkey / 2) AS BIGINT) ELSE o_orderkey END AS contract_id
FROM {orders} WHERE o_orderkey % 53 <> 0
"""

FIXTURES["fx_contracts"] = """
SELECT o_orderkey AS contract_id, o_custkey AS job_id, o_orderdate AS created_at,
       o_orderdate + (o_orderkey % 600) * INTERVAL 1 SECOND AS first_guard_ok_at,
       o_orderdate + (o_orderkey % 600 + o_orderkey % 5000) * INTERVAL 1 SECOND AS last_cas_at,
       CASE WHEN o_orderkey % 31 = 0 THEN NULL
            ELSE o_orderdate + (o_orderkey % 600 + o_orderkey % 5000 + o_orderkey % 97) * INTERVAL 1 SECOND END AS finalized_at,
       CASE WHEN o_orderkey % 31 = 0 THEN 'ADJUDICATION_PENDING' WHEN o_orderkey % 37 = 0 THEN 'RECONCILIATION_REQUIRED'
            WHEN o_orderkey % 43 = 0 THEN 'DQ_FAILED' WHEN o_orderkey % 13 = 0 THEN 'FINALIZED_NO_DATA'
            WHEN o_orderkey % 17 = 0 THEN 'PLANNED' WHEN o_orderkey % 18 = 0 THEN 'ATTEMPT_ACTIVE'
            ELSE 'FINALIZED' END AS state,
       o_orderkey % 26 = 0 AS target_unchanged,
       o_orderpriority AS period_band
FROM {orders}
"""

FIXTURES["fx_expected"] = """
SELECT DISTINCT o_custkey AS job_id, o_orderdate AS logical_at FROM {orders} WHERE o_orderkey % 59 <> 0
"""

FIXTURES["fx_rejected"] = """
SELECT DISTINCT o_custkey AS job_id, o_orderdate AS logical_at FROM {orders} WHERE o_orderkey % 106 = 0
"""

FIXTURES["fx_missed"] = """
SELECT o.o_custkey AS job_id, j.load_mode, o.o_orderdate AS logical_at, o.o_orderdate AS window_low,
       o.o_orderdate + INTERVAL 1 DAY AS window_high
FROM {orders} o JOIN {fx_jobs} j ON o.o_custkey = j.job_id WHERE o.o_orderkey % 7 = 0
"""

# ---- staging ----------------------------------------------------------------------------------

FIXTURES["fx_stage_src"] = "SELECT event_id, user_id % 10 AS part, ts, value FROM {events}"

FIXTURES["fx_staged"] = "SELECT * FROM {fx_stage_src} WHERE part < 8 OR (part = 8 AND event_id % 2 = 0)"

FIXTURES["fx_manifest"] = """
SELECT part, CASE WHEN part = 8 THEN 'OPEN' ELSE 'SEALED' END AS status,
       COUNT(*) + CASE WHEN part = 3 THEN 1 ELSE 0 END AS rows_written
FROM {fx_staged} GROUP BY part
"""

FIXTURES["fx_published"] = "SELECT event_id, part FROM {fx_stage_src} WHERE part < 6"

# Planned chunks (one per user and day) and what an earlier attempt left in the stage.
FIXTURES["fx_chunk_plan"] = """
SELECT user_id AS contract_id, wm AS window_low, wm + INTERVAL 1 DAY AS window_high,
       CAST(user_id % 3 AS BIGINT) AS point, COUNT(*) AS planned_rows
FROM {fx_events_tied} GROUP BY user_id, wm
"""

FIXTURES["fx_chunk_manifest"] = """
SELECT contract_id, window_low, window_high,
       CASE WHEN contract_id % 11 = 0 THEN point + 1 ELSE point END AS point,
       planned_rows AS rows_written,
       CASE WHEN contract_id % 13 = 0 THEN planned_rows - 1 ELSE planned_rows END AS staged_rows,
       CASE WHEN contract_id % 17 = 0 THEN 'OPEN' ELSE 'SEALED' END AS status
FROM {fx_chunk_plan} WHERE contract_id % 5 <> 0
"""

# ---- commit evidence --------------------------------------------------------------------------

# Fifty tables; snapshots whose id is divisible by 41 sit on side branches.
FIXTURES["fx_snapshots"] = """
SELECT o_orderkey AS snapshot_id, o_orderkey % 50 AS table_id,
       CASE WHEN o_orderkey < 50 THEN NULL
            WHEN o_orderkey >= 100 AND (o_orderkey - 50) % 41 = 0 THEN o_orderkey - 100
            ELSE o_orderkey - 50 END AS parent_id,
       TIMESTAMP '2024-01-01 00:00:00' + o_orderkey * INTERVAL 10 SECOND AS committed_at,
       o_custkey AS job_id,
       CASE WHEN o_orderkey % 5 = 0 THEN 'REPAIR' ELSE 'INGEST' END AS lane,
       CASE WHEN o_orderkey % 211 = 0 THEN NULL WHEN o_orderkey % 29 = 0 THEN 'maintenance' ELSE 'ingest' END AS writer_kind,
       CASE WHEN o_orderkey % 29 = 0 AND o_orderkey % 3 <> 0 THEN o_orderkey ELSE NULL END AS lease_id,
       CASE WHEN o_orderkey % 173 = 0 THEN NULL ELSE CAST(floor(o_orderkey / 4) AS BIGINT) END AS contract_id,
       CAST(1 AS BIGINT) AS attempt_no,
       CASE WHEN o_orderkey % 199 = 0 THEN 1 ELSE 1 + o_orderkey % 4 END AS chunk_no,
       CAST(floor(o_orderkey / 4) AS BIGINT) AS observed_contract_id, CAST(1 AS BIGINT) AS observed_attempt_no,
       o_orderdate AS window_low,
       o_orderdate + (1 + o_orderkey % 40) * INTERVAL 1 DAY AS window_high
FROM {orders}
"""

FIXTURES["fx_heads"] = """
SELECT table_id, MAX(snapshot_id) AS snapshot_id FROM {fx_snapshots} WHERE snapshot_id % 41 <> 0 GROUP BY table_id
"""

FIXTURES["fx_bases"] = """
SELECT table_id, MAX(snapshot_id) AS snapshot_id FROM {fx_snapshots}
WHERE snapshot_id % 41 <> 0 AND table_id % 2 = 0 AND snapshot_id < 450 GROUP BY table_id
"""

# What the adjudicator sees: chunks without a snapshot reported zero rows, some were lost.
FIXTURES["fx_adj_snapshots"] = "SELECT * FROM {fx_snapshots} WHERE observed_contract_id % 6 <> 0 AND snapshot_id % 7 <> 0"

FIXTURES["fx_adj_receipts"] = """
SELECT observed_contract_id AS contract_id, observed_attempt_no AS attempt_no, 1 + snapshot_id % 4 AS chunk_no,
       CASE WHEN snapshot_id % 7 = 0 OR observed_contract_id % 6 = 0 THEN 0 ELSE 10 END AS extracted_rows,
       CASE WHEN snapshot_id % 7 = 0 OR observed_contract_id % 6 = 0 THEN FALSE ELSE TRUE END AS committed
FROM {fx_snapshots} WHERE snapshot_id % 21 <> 0 AND observed_contract_id % 18 <> 0
"""

FIXTURES["fx_leases"] = "SELECT DISTINCT lease_id FROM {fx_snapshots} WHERE lease_id IS NOT NULL AND lease_id % 58 <> 0"

FIXTURES["fx_reclaimed_leases"] = """
SELECT lease_id, CASE snapshot_id % 4 WHEN 0 THEN NULL WHEN 1 THEN snapshot_id + 150 WHEN 2 THEN snapshot_id ELSE snapshot_id - 50 END AS reclaimed_head_id
FROM {fx_snapshots} WHERE lease_id IS NOT NULL AND lease_id % 58 <> 0
"""

FIXTURES["fx_retained_snapshots"] = "SELECT table_id, snapshot_id, parent_id FROM {fx_snapshots} WHERE NOT (table_id % 7 = 3 AND snapshot_id < 2000)"

FIXTURES["fx_adj_based_contracts"] = """
SELECT c.*, s.table_id, s.snapshot_id AS base_snapshot_id,
       CASE WHEN c.contract_id % 11 = 0 THEN s.snapshot_id - 50 ELSE (SELECT MAX(h.snapshot_id) FROM {fx_snapshots} h WHERE h.table_id = s.table_id) END AS head_snapshot_id
FROM {fx_adj_contracts} c LEFT JOIN {fx_snapshots} s ON s.snapshot_id = 4 * c.contract_id AND c.contract_id % 5 <> 4
"""

FIXTURES["fx_adj_contracts"] = """
SELECT observed_contract_id AS contract_id, observed_attempt_no AS attempt_no,
       CAST(3 + observed_contract_id % 2 AS BIGINT) AS expected_chunks,
       CASE observed_contract_id % 5 WHEN 3 THEN 'APPEND' WHEN 4 THEN 'MERGE' ELSE 'FULL' END AS load_mode,
       CASE WHEN observed_contract_id % 4 = 0 THEN 'RETAIN_PREVIOUS' WHEN observed_contract_id % 4 = 1 THEN 'FAIL' END AS on_empty_source
FROM {fx_snapshots} GROUP BY observed_contract_id, observed_attempt_no
"""

FIXTURES["fx_ledger"] = """
SELECT o_orderkey AS ledger_id, o_custkey AS job_id, CAST(floor(o_orderkey / 4) AS BIGINT) AS contract_id,
       CAST(1 AS BIGINT) AS attempt_no,
       CASE WHEN o_orderkey % 223 = 0 THEN 1 ELSE 1 + o_orderkey % 4 END AS chunk_no,
       CASE WHEN o_orderkey % 47 = 0 THEN NULL WHEN o_orderkey % 37 = 0 THEN o_orderkey + 100000000
            ELSE o_orderkey END AS committed_snapshot_id,
       o_orderkey % 41 <> 0 AS cas_applied,
       TIMESTAMP '2024-01-01 00:00:00' + o_orderkey * INTERVAL 10 SECOND AS cas_at,
       o_orderdate AS window_low, o_orderdate + (o_orderkey % 30) * INTERVAL 1 DAY AS window_high,
       CASE o_orderkey % 13 WHEN 0 THEN 'INITIAL_LOAD' WHEN 1 THEN 'REPAIR' WHEN 2 THEN 'CATCHUP' ELSE 'NORMAL' END AS operation_class
FROM {orders}
"""

FIXTURES["fx_receipts"] = """
SELECT o_orderkey AS receipt_id, o_custkey % 150 AS table_id,
       CASE o_orderkey % 5 WHEN 3 THEN 'APPEND' WHEN 4 THEN 'MERGE' ELSE 'FULL' END AS load_mode,
       100 + o_orderkey % 50 AS extracted_rows, o_orderkey % 7 AS dedup_dropped_rows, o_orderkey % 3 AS anti_join_dropped_rows,
       100 + o_orderkey % 50 - o_orderkey % 7 - o_orderkey % 3 + CASE WHEN o_orderkey % 61 = 0 THEN 1 ELSE 0 END AS written_rows,
       100 + o_orderkey % 50 - o_orderkey % 7 - o_orderkey % 3 AS added_records,
       CASE WHEN o_orderkey % 67 = 0 THEN NULL ELSE 100 + o_orderkey % 50 - o_orderkey % 7 - o_orderkey % 3 END AS total_records,
       100 + o_orderkey % 50 - o_orderkey % 7 - o_orderkey % 3 - CASE WHEN o_orderkey % 71 = 0 THEN 1 ELSE 0 END AS merge_input_rows
FROM {orders}
"""

FIXTURES["fx_full_written"] = """
SELECT o_custkey AS table_id, COUNT(*) AS written_rows FROM {orders} WHERE o_orderkey % 3 <> 1 OR o_custkey % 4 <> 0 GROUP BY o_custkey
"""

FIXTURES["fx_full_previous"] = """
SELECT o_custkey AS table_id, COUNT(*) AS previous_rows FROM {orders} WHERE o_custkey % 10 <> 0 GROUP BY o_custkey
"""

FIXTURES["fx_daily_stats"] = """
SELECT user_id AS table_id, CAST(date_trunc('day', ts) AS TIMESTAMP) AS stat_day,
       COUNT(*) * CASE WHEN MIN(event_id) % 9 = 0 THEN 10 ELSE 100 END AS row_count
FROM {events} GROUP BY user_id, CAST(date_trunc('day', ts) AS TIMESTAMP)
"""

FIXTURES["fx_attempts"] = """
SELECT DISTINCT contract_id, attempt_no, CASE WHEN contract_id % 3 = 0 THEN 'COMMIT' ELSE 'NO_COMMIT' END AS verdict
FROM {fx_ledger}
"""

FIXTURES["fx_detections"] = """
SELECT snapshot_id, job_id AS detected_by FROM {fx_snapshots} WHERE snapshot_id % 3 <> 1
"""

FIXTURES["fx_repairs"] = """
SELECT o_custkey AS parent_contract_id, o_orderdate AS window_low,
       o_orderdate + (60 + o_orderkey % 90) * INTERVAL 1 DAY AS window_high
FROM {orders} WHERE o_orderkey % 2 = 0
"""

FIXTURES["fx_exposure"] = """
SELECT snapshot_id, committed_at,
       CASE WHEN snapshot_id % 301 = 0 THEN NULL ELSE committed_at + (snapshot_id % 7919) * INTERVAL 1 SECOND END AS repair_finalized_at
FROM {fx_snapshots}
"""

# ---- run history ------------------------------------------------------------------------------

FIXTURES["fx_transitions"] = """
SELECT event_id AS seq, user_id AS attempt_id, event_id % 500 AS contract_id,
       CASE WHEN event_id % 11 = 0 THEN NULL WHEN event_id % 7 = 0 THEN event_type
            WHEN event_type = 'click' THEN 'view' ELSE 'click' END AS from_state,
       event_type AS to_state, ts AS at
FROM {events}
"""

FIXTURES["fx_writers"] = """
SELECT event_id AS writer_id, user_id AS job_id, CASE WHEN event_id % 4 = 0 THEN 'REPAIR' ELSE 'INGEST' END AS lane,
       ts AS started_at,
       CASE WHEN event_id % 997 = 0 THEN NULL ELSE ts + (60 + event_id % 4000) * INTERVAL 10 SECOND END AS ended_at,
       user_id % 25 AS source_id, CAST(1 + event_id % 3 AS BIGINT) AS tokens
FROM {events}
"""

FIXTURES["fx_caps"] = """
SELECT user_id % 25 AS source_id, CAST(14 + MIN(user_id) % 25 AS BIGINT) AS cap FROM {events} GROUP BY user_id % 25
"""

FIXTURES["fx_lease_log"] = """
SELECT event_id AS seq, user_id % 40 AS resource_id, CAST(floor(event_id / 3) AS BIGINT) AS lease_id, user_id AS job_id,
       CASE event_id % 3 WHEN 0 THEN 'GRANTED' WHEN 1 THEN 'RECLAIMED' ELSE 'RELEASED' END AS to_state, ts AS at
FROM {events} WHERE event_id % 17 <> 5
"""

FIXTURES["fx_guard"] = """
SELECT event_id AS call_id, event_id % 3000 AS contract_id, user_id % 25 AS source_id,
       CASE event_id % 8 WHEN 0 THEN 'LEASE_BUSY' WHEN 1 THEN 'SOURCE_LAG_EXCEEDED' WHEN 2 THEN 'FENCE_UNAVAILABLE'
            WHEN 3 THEN 'TARGET_UNAVAILABLE' WHEN 4 THEN 'HOLD' ELSE 'OK' END AS result,
       ts - (event_id % 90) * INTERVAL 1 SECOND AS run_started_at, ts AS at,
       CASE WHEN event_id % 5 = 0 THEN NULL ELSE ts + (event_id % 600) * INTERVAL 1 SECOND END AS next_eligible_at
FROM {events}
"""

FIXTURES["fx_timeline"] = """
SELECT event_id % 3000 AS contract_id, event_id AS attempt_id, event_type AS band,
       ts AS t0, ts + (event_id % 60) * INTERVAL 1 SECOND AS t1, ts + (event_id % 60 + 5) * INTERVAL 1 SECOND AS t2,
       ts + (event_id % 60 + 9) * INTERVAL 1 SECOND AS t3, ts + (event_id % 60 + 1200) * INTERVAL 1 SECOND AS t4,
       ts + (event_id % 60 + 1200 + event_id % 45) * INTERVAL 1 SECOND AS t5,
       ts + (event_id % 60 + 1300 + event_id % 45) * INTERVAL 1 SECOND AS t6,
       CASE WHEN event_id % 77 = 0 THEN NULL ELSE ts + (event_id % 60 + 1300 + event_id % 4500) * INTERVAL 1 SECOND END AS t7
FROM {events}
"""

FIXTURES["fx_releases"] = """
SELECT s_suppkey AS release_id, s_nationkey AS nation, TIMESTAMP '1995-01-01 00:00:00' + s_suppkey * INTERVAL 1 DAY AS effective_from,
       CASE WHEN s_suppkey % 6 = 0 THEN 'REJECTED' ELSE 'ACTIVE' END AS status
FROM {supplier}
"""

# Releases per job: several orders of a customer each publish one.
FIXTURES["fx_job_releases"] = """
SELECT o_orderkey AS release_id, o_custkey AS job_id, o_orderdate AS effective_from,
       CASE WHEN o_orderkey % 6 = 0 THEN 'REJECTED' ELSE 'ACTIVE' END AS status
FROM {orders} WHERE o_orderkey % 5 = 0
"""

FIXTURES["fx_holds"] = """
SELECT c_custkey AS hold_id,
       CASE WHEN c_custkey % 500 = 7 THEN 'GLOBAL' WHEN c_custkey % 4 = 0 THEN 'SOURCE' WHEN c_custkey % 10 = 1 THEN 'DOMAIN' ELSE 'JOB' END AS scope_kind,
       CASE WHEN c_custkey % 500 = 7 THEN '*' WHEN c_custkey % 4 = 0 THEN CAST(c_nationkey AS VARCHAR(20))
            WHEN c_custkey % 10 = 1 THEN c_mktsegment ELSE CAST(c_custkey AS VARCHAR(20)) END AS scope_key,
       CASE c_custkey % 3 WHEN 0 THEN 'DRAIN' WHEN 1 THEN 'HOLD_NEW' ELSE CASE WHEN c_custkey % 7 = 0 THEN 'FORCE_STOP' ELSE 'HOLD_NEW' END END AS mode,
       TIMESTAMP '2024-01-01 00:00:00' + (c_custkey % 60) * INTERVAL 1 DAY AS starts_at,
       CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE TIMESTAMP '2024-01-01 00:00:00' + (c_custkey % 60 + 30) * INTERVAL 1 DAY END AS ends_at
FROM {customer} WHERE c_custkey % 11 < 6
"""

FIXTURES["fx_bookings"] = """
SELECT user_id % 25 AS source_id, ts AS granted_at,
       CASE WHEN event_id % 500 = 0 THEN NULL ELSE ts + (30 + event_id % 900) * INTERVAL 1 SECOND END AS returned_at,
       CAST(1 + event_id % 3 AS BIGINT) AS tokens
FROM {events} WHERE event_id % 4 = 0
"""

FIXTURES["fx_samples"] = """
SELECT user_id % 25 AS source_id, event_id AS sample_id, ts + INTERVAL 7 SECOND AS at, CAST(event_id % 4 AS BIGINT) AS observed
FROM {events} WHERE event_id % 4 <> 0
"""

FIXTURES["fx_outbox"] = """
SELECT event_id % 4000 AS aggregate_id, event_type AS transition, CASE WHEN event_id % 2 = 0 THEN 'STATE' ELSE 'ALERT' END AS event_type,
       CAST(event_id % 25 AS BIGINT) AS source_id, ts AS at
FROM {events}
"""

FIXTURES["fx_axis_values"] = """
SELECT c_custkey AS source_id, 'hash_function' AS axis, CASE c_custkey % 3 WHEN 0 THEN 'NONE' WHEN 1 THEN 'UNDETERMINED' ELSE 'SHA256' END AS value FROM {customer}
UNION ALL
SELECT c_custkey AS source_id, 'lag_admission' AS axis, CASE c_custkey % 4 WHEN 0 THEN 'NONE' ELSE 'MAX_DELAY_ENFORCED' END AS value FROM {customer}
"""

FIXTURES["fx_axis_remeasured"] = """
SELECT source_id, axis, CASE WHEN source_id % 5 = 0 THEN 'NONE' WHEN source_id % 5 = 1 AND axis = 'hash_function' THEN 'SHA256' ELSE value END AS value
FROM {fx_axis_values}
"""

# ---- probes and traces ------------------------------------------------------------------------

# Sixteen probes per source; customer numbers scatter the outcomes.
FIXTURES["fx_probes"] = """
SELECT CAST(floor(o_orderkey / 16) AS BIGINT) AS source_id,
  CASE o_orderkey % 16 WHEN 0 THEN 'dbms_flashback.get_scn' WHEN 1 THEN 'as_of_timestamp.target' WHEN 2 THEN 'v$dataguard_stats'
    WHEN 3 THEN 'alter.STANDBY_MAX_DATA_DELAY.D' WHEN 4 THEN 'alter.STANDBY_MAX_DATA_DELAY.zero' WHEN 5 THEN 'max_delay_zero.touch_target'
    WHEN 6 THEN 'feat.standard_hash_sha256' WHEN 7 THEN 'feat.fetch_first' WHEN 8 THEN 'nls.characterset' WHEN 9 THEN 'nls.nchar_characterset'
    WHEN 10 THEN 'feat.rowdependencies_target' WHEN 11 THEN 'feat.ora_rowscn_target' WHEN 12 THEN 'timestamp_to_scn'
    WHEN 13 THEN 'scn_to_timestamp.roundtrip' WHEN 14 THEN 'wm_column.type_facts' ELSE 'v$parameter.max_string' END AS probe,
  CASE WHEN o_custkey % 4 = 0 THEN FALSE WHEN o_custkey % 4 = 1 AND o_orderkey % 16 = 5 THEN FALSE ELSE TRUE END AS query_ok,
  CASE WHEN o_custkey % 17 = 0 THEN FALSE WHEN o_custkey % 17 = 1 THEN NULL ELSE TRUE END AS row_present,
  CASE WHEN o_orderkey % 16 IN (3, 4, 7, 12) THEN FALSE ELSE TRUE END AS has_value,
  CASE WHEN o_custkey % 23 = 0 OR o_orderkey % 16 IN (3, 4, 7, 12) THEN NULL WHEN o_custkey % 29 = 0 THEN ' '
    WHEN o_orderkey % 16 = 0 THEN CASE WHEN o_custkey % 7 = 0 THEN 'n/a' ELSE '48812345' END
    WHEN o_orderkey % 16 = 8 THEN CASE o_custkey % 5 WHEN 0 THEN 'KO16MSWIN949' WHEN 1 THEN 'utf 8' ELSE 'AL32UTF8' END
    WHEN o_orderkey % 16 = 10 THEN CASE o_custkey % 3 WHEN 0 THEN 'ENABLED' WHEN 1 THEN 'DISABLED' ELSE 'UNKNOWN' END
    WHEN o_orderkey % 16 = 14 THEN CASE o_custkey % 7 WHEN 0 THEN 'TIMESTAMP(6)|scale=6' WHEN 1 THEN 'DATE|scale=-' WHEN 2 THEN 'NUMBER|scale=2'
         WHEN 3 THEN 'NUMBER|scale=-' WHEN 4 THEN 'BINARY_DOUBLE|scale=-' WHEN 5 THEN 'TIMESTAMP|scale=-' ELSE 'no facts' END
    ELSE 'X1' END AS value,
  CASE WHEN o_custkey % 13 = 0 THEN FALSE WHEN o_custkey % 13 = 1 THEN NULL ELSE TRUE END AS value_interpretable,
  CASE WHEN o_custkey % 8 = 0 THEN NULL WHEN o_orderkey % 16 = 5 THEN -3172
    ELSE CASE o_custkey % 11 WHEN 0 THEN -942 WHEN 1 THEN -1031 WHEN 2 THEN -900 WHEN 3 THEN -904 WHEN 4 THEN -933 WHEN 5 THEN -2248
         WHEN 6 THEN -3113 WHEN 7 THEN -6550 WHEN 8 THEN -1722 WHEN 9 THEN -2003 ELSE -20001 END END AS ora,
  CASE WHEN o_custkey % 16 = 0 THEN 'failed with ORA-00923: FROM keyword not found' ELSE 'failed' END AS msg
FROM {orders} WHERE o_orderkey % 61 <> 0
"""

FIXTURES["fx_probe_runs"] = """
SELECT CAST(floor(o_orderkey / 20) AS BIGINT) AS source_id,
       'p' || CAST(CASE WHEN o_orderkey % 97 = 0 THEN 99 WHEN o_orderkey % 43 = 0 THEN 3 ELSE o_orderkey % 20 END AS VARCHAR(4)) AS probe
FROM {orders} WHERE o_orderkey % 31 <> 0
"""

FIXTURES["fx_probe_summaries"] = """
SELECT source_id, CASE WHEN source_id % 10 = 0 THEN 19 ELSE 20 END AS expected, COUNT(*) + CASE WHEN source_id % 7 = 0 THEN 1 ELSE 0 END AS emitted
FROM {fx_probe_runs} GROUP BY source_id
"""

# Log records of child runs: probes, one summary, one end line.
FIXTURES["fx_child_records"] = """
SELECT CAST(floor(o_orderkey / 12) AS BIGINT) AS child_id,
  CASE WHEN CAST(floor(o_orderkey / 12) AS BIGINT) % 50 = 7 OR o_custkey % 91 = 0 THEN 'UNPARSABLE' WHEN o_orderkey % 12 = 10 THEN 'SUMMARY' WHEN o_orderkey % 12 = 11 THEN 'END' ELSE 'PROBE' END AS record_kind,
  CASE WHEN o_orderkey % 12 < 10 THEN 'q' || CAST(o_orderkey % 12 AS VARCHAR(4)) END AS probe,
  CASE WHEN o_orderkey % 12 = 10 THEN o_custkey % 20 <> 0 END AS manifest_ok, o_custkey % 60 = 1 AS skipped
FROM {orders} WHERE CAST(floor(o_orderkey / 12) AS BIGINT) % 40 <> 3 AND o_custkey % 70 <> 5
"""

FIXTURES["fx_children"] = "SELECT DISTINCT CAST(floor(o_orderkey / 12) AS BIGINT) AS child_id FROM {orders}"

FIXTURES["fx_manifests"] = """
SELECT CAST(floor(o_orderkey / 5) AS BIGINT) AS set_id,
  CASE WHEN o_custkey % 120 = 0 THEN 'extra' ELSE 'child' || CAST(o_orderkey % 5 AS VARCHAR(4)) END AS child,
  CASE WHEN o_orderkey % 5 = 4 THEN 'COUNTEREXAMPLE' ELSE 'SOURCE' END AS scope,
  CASE WHEN o_custkey % 50 = 0 THEN 'other' WHEN o_custkey % 50 = 1 THEN 'MISSING' ELSE 'run' END AS run_id,
  CASE WHEN o_orderkey % 5 = 4 AND o_custkey % 9 <> 0 THEN 'SCRATCH' WHEN o_custkey % 80 = 3 THEN 'prod2' WHEN o_custkey % 2 = 0 THEN 'PROD' ELSE 'PROD' END AS source_id,
  CASE WHEN o_custkey % 60 = 2 THEN 'v2' ELSE 'v1' END AS versions_digest, CASE WHEN o_custkey % 70 = 4 THEN '' WHEN o_custkey % 70 = 5 THEN 'h2' ELSE 'h1' END AS harness_digest
FROM {orders}
"""

FIXTURES["fx_trace"] = """
SELECT event_id, user_id % 60 AS suite_id, user_id AS file,
  CASE event_id % 3 WHEN 0 THEN 'coverage' WHEN 1 THEN 'failclosed_schema' ELSE 'failclosed_task' END AS run,
  CASE event_type WHEN 'click' THEN 'schema_only' WHEN 'view' THEN 'partitioned_count' WHEN 'signup' THEN 'second_action' WHEN 'error' THEN 'BETWEEN_STEPS' END AS declared_phase,
  CASE WHEN value > 10 THEN 'SCHEMA' ELSE 'TASK' END AS path_guess,
  CASE WHEN event_id % 211 = 0 THEN FALSE WHEN event_id % 223 = 0 THEN NULL ELSE TRUE END AS preamble_ok, event_id % 97 AS sid,
  event_id % 5 = 2 AS injection_applied, event_id % 997 <> 0 AS is_json
FROM {events}
"""

FIXTURES["fx_trace_lines"] = """
SELECT suite_id, file, is_json, 'connection' AS event, CAST(NULL AS BIGINT) AS lines_written FROM {fx_trace}
UNION ALL
SELECT suite_id, file, TRUE AS is_json, 'trace_end' AS event,
       CASE WHEN file % 20 = 5 THEN NULL ELSE COUNT(*) + CASE WHEN file % 20 = 3 THEN 1 WHEN file % 20 = 4 THEN -1 ELSE 0 END END AS lines_written
FROM {fx_trace} WHERE file % 20 <> 9 GROUP BY suite_id, file
UNION ALL
SELECT suite_id, file, TRUE AS is_json, 'trace_end' AS event, COUNT(*) AS lines_written FROM {fx_trace} WHERE file % 20 = 11 GROUP BY suite_id, file
"""

FIXTURES["fx_terminals"] = """
SELECT suite_id, run, CASE WHEN suite_id % 13 = 0 AND run = 'failclosed_task' THEN 'COMPLETED' ELSE 'EXPECTED_FAILURE_OBSERVED' END AS status,
       CASE WHEN suite_id % 17 = 1 THEN COUNT(*) ELSE 0 END AS rows_read_total
FROM {fx_trace} WHERE run <> 'coverage' AND suite_id % 19 <> 2 GROUP BY suite_id, run
"""

FIXTURES["fx_failing_steps"] = """
SELECT suite_id, run, CASE WHEN suite_id % 23 = 4 THEN 'FAIL_CLOSED_PARTIAL' WHEN suite_id % 29 = 5 THEN 'FAIL_CLOSED_BROKEN' ELSE 'FAIL_CLOSED' END AS status
FROM {fx_trace} WHERE run <> 'coverage' AND suite_id % 15 <> 8 GROUP BY suite_id, run
"""

FIXTURES["fx_connections"] = """
SELECT user_id % 25 AS source_id, CASE WHEN event_id % 401 = 0 THEN 'OTHER' ELSE 'db_' || CAST(user_id % 25 AS VARCHAR(4)) END AS db_unique_name,
       CASE WHEN event_id % 503 = 0 THEN 'PRIMARY' ELSE 'PHYSICAL STANDBY' END AS database_role, event_id % 200 AS sid, user_id % 3 AS instance
FROM {events}
"""

FIXTURES["fx_identities"] = """
SELECT source_id, 'DB_' || CAST(source_id AS VARCHAR(4)) AS expected_db, 'physical standby' AS expected_role
FROM {fx_connections} GROUP BY source_id
"""

FIXTURES["fx_scenarios"] = """
SELECT CAST(floor(o_orderkey / 9) AS BIGINT) AS suite_id, 'CE0' || CAST(1 + o_orderkey % 9 AS VARCHAR(4)) AS scenario_id,
  CASE WHEN o_custkey % 30 = 0 THEN 'MITIGATION_FAIL' WHEN o_custkey % 30 = 1 THEN 'COUNTEREXAMPLE_REPRODUCED' WHEN o_custkey % 90 = 2 THEN 'INJECTION_NOT_OBSERVED'
       WHEN o_custkey % 90 = 3 THEN 'INCONCLUSIVE' ELSE 'MITIGATION_HOLDS' END AS outcome,
  CASE WHEN o_custkey % 100 = 4 THEN 1 ELSE 0 END AS leftover_objects, o_custkey % 110 <> 5 AS cleanup_attempted, o_custkey % 120 <> 6 AS cleanup_succeeded, o_custkey % 150 = 7 AS has_error
FROM {orders} WHERE o_orderkey % 83 <> 0
"""
