"""Commit-evidence audits over the sample tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import evidence as E
from tidemark.plans.registry import query
from tidemark.session import cut_lineage

# Rows per bin in some queries: few enough for large keys to be cut at the sample sizes.
FEW_ROWS = 20


@query("snapshot_ancestry", """
WITH RECURSIVE walk AS (
  SELECT h.table_id, h.snapshot_id, CAST(0 AS BIGINT) AS depth FROM fx_heads h
  UNION ALL
  SELECT s.table_id, s.parent_id, w.depth + 1 FROM walk w JOIN fx_snapshots s ON s.table_id = w.table_id AND s.snapshot_id = w.snapshot_id
  WHERE s.parent_id IS NOT NULL)
SELECT table_id, snapshot_id, depth FROM walk
""")
def _(t):
    return E.ancestry(t.fx_snapshots, t.fx_heads)


@query("snapshot_ancestry_to_base", """
WITH RECURSIVE walk AS (
  SELECT h.table_id, h.snapshot_id, CAST(0 AS BIGINT) AS depth FROM fx_heads h
  WHERE h.snapshot_id NOT IN (SELECT snapshot_id FROM fx_bases)
  UNION ALL
  SELECT s.table_id, s.parent_id, w.depth + 1 FROM walk w JOIN fx_snapshots s ON s.table_id = w.table_id AND s.snapshot_id = w.snapshot_id
  WHERE s.parent_id IS NOT NULL AND s.parent_id NOT IN (SELECT snapshot_id FROM fx_bases))
SELECT table_id, snapshot_id, depth FROM walk
""")
def _(t):
    return E.ancestry(t.fx_snapshots, t.fx_heads, t.fx_bases)


_ADJUDICATION = """ev AS (
  SELECT observed_contract_id AS cid, chunk_no AS c, TRUE AS ok FROM s
  WHERE COALESCE(contract_id = observed_contract_id AND writer_kind = 'ingest', FALSE)
  UNION ALL
  SELECT observed_contract_id, NULL, FALSE FROM s WHERE NOT COALESCE(contract_id = observed_contract_id AND writer_kind = 'ingest', FALSE)),
z AS (SELECT DISTINCT contract_id AS cid, chunk_no AS c FROM fx_adj_receipts WHERE extracted_rows = 0 AND NOT committed),
per AS (SELECT cid, c, SUM(n) AS n, SUM(sn) AS sn FROM (
   SELECT cid, c, 1 AS n, 1 AS sn FROM ev WHERE ok UNION ALL SELECT cid, c, 1, 0 FROM z) GROUP BY cid, c),
agg AS (SELECT cid, COUNT(*) AS k, MIN(c) AS lo, MAX(c) AS hi, MAX(n) AS most, SUM(sn) AS snaps FROM per GROUP BY cid),
j AS (SELECT f.*, a.*, EXISTS (SELECT 1 FROM ev WHERE NOT ok AND ev.cid = f.contract_id) AS foreign_seen
      FROM {contracts} f LEFT JOIN agg a ON a.cid = f.contract_id),
v AS (SELECT contract_id, expected_chunks, k, CASE WHEN {lost} OR foreign_seen OR most > 1 THEN 'RECONCILIATION_REQUIRED'
  WHEN k IS NULL THEN 'NO_COMMIT'
  WHEN lo <> 1 OR hi <> k OR hi > expected_chunks THEN 'RECONCILIATION_REQUIRED'
  WHEN k < expected_chunks THEN 'PARTIAL_COMMIT' WHEN snaps > 0 THEN 'COMMIT'
  WHEN load_mode <> 'FULL' OR on_empty_source = 'RETAIN_PREVIOUS' THEN 'FINALIZED_NO_DATA' ELSE 'NO_COMMIT(EMPTY_FULL)' END AS verdict FROM j)
SELECT contract_id, expected_chunks, verdict,
       CASE WHEN verdict IN ('COMMIT', 'PARTIAL_COMMIT', 'FINALIZED_NO_DATA') THEN k ELSE 0 END AS covered_chunks FROM v
"""


@query("commit_adjudication", """
WITH s AS (SELECT * FROM fx_adj_snapshots WHERE NOT (COALESCE(writer_kind, '') = 'maintenance' AND COALESCE(lease_id IN (SELECT lease_id FROM fx_leases), FALSE))),
""" + _ADJUDICATION.format(contracts="fx_adj_contracts", lost="FALSE"))
def _(t):
    return E.adjudicate(t.fx_adj_snapshots, t.fx_adj_receipts, t.fx_leases, t.fx_adj_contracts).select(
        "contract_id", "expected_chunks", "verdict", "covered_chunks")


@query("commit_adjudication_leases", """
WITH RECURSIVE up AS (
  SELECT r.table_id, h.head_id, r.snapshot_id, r.parent_id FROM fx_retained_snapshots r JOIN (
    SELECT reclaimed_head_id AS head_id FROM fx_reclaimed_leases UNION SELECT head_snapshot_id FROM fx_adj_based_contracts) h ON h.head_id = r.snapshot_id
  UNION ALL SELECT r.table_id, up.head_id, r.snapshot_id, r.parent_id FROM up JOIN fx_retained_snapshots r ON r.snapshot_id = up.parent_id),
s AS (SELECT * FROM fx_adj_snapshots a WHERE NOT (COALESCE(writer_kind, '') = 'maintenance' AND EXISTS (
  SELECT 1 FROM fx_reclaimed_leases l WHERE l.lease_id = a.lease_id AND (l.reclaimed_head_id IS NULL OR l.reclaimed_head_id = a.snapshot_id
    OR EXISTS (SELECT 1 FROM up WHERE up.head_id = l.reclaimed_head_id AND up.snapshot_id = a.snapshot_id))))),
""" + _ADJUDICATION.format(contracts="fx_adj_based_contracts", lost="""(base_snapshot_id IS NOT NULL AND NOT EXISTS (
    SELECT 1 FROM up WHERE up.head_id = j.head_snapshot_id AND up.snapshot_id = j.base_snapshot_id))"""))
def _(t):
    return E.adjudicate(
        t.fx_adj_snapshots, t.fx_adj_receipts, t.fx_reclaimed_leases, t.fx_adj_based_contracts, t.fx_retained_snapshots).select(
        "contract_id", "expected_chunks", "verdict", "covered_chunks")


@query("duplicate_commits", """
SELECT contract_id, attempt_no, chunk_no, COUNT(*) AS copies, 'DUPLICATE_SNAPSHOT' AS finding FROM fx_snapshots GROUP BY ALL HAVING COUNT(*) > 1
UNION ALL
SELECT contract_id, attempt_no, chunk_no, COUNT(*), 'DUPLICATE_LEDGER_ROW' FROM fx_ledger GROUP BY ALL HAVING COUNT(*) > 1
UNION ALL
SELECT contract_id, attempt_no, chunk_no, 1, 'LEDGER_WITHOUT_SNAPSHOT' FROM fx_ledger
WHERE cas_applied AND committed_snapshot_id NOT IN (SELECT snapshot_id FROM fx_snapshots)
UNION ALL
SELECT contract_id, attempt_no, chunk_no, 1, 'SNAPSHOT_WITHOUT_LEDGER' FROM fx_snapshots
WHERE snapshot_id NOT IN (SELECT committed_snapshot_id FROM fx_ledger WHERE cas_applied AND committed_snapshot_id IS NOT NULL)
""")
def _(t):
    return E.duplicate_commits(t.fx_snapshots, t.fx_ledger)


_OVERLAPPING = """
SELECT b.snapshot_id, b.job_id, b.lane, COUNT(*) AS overlap_count, arg_max(a.snapshot_id, (a.window_high, a.snapshot_id)) AS overlap_with
FROM fx_snapshots a JOIN fx_snapshots b ON a.job_id = b.job_id AND a.lane = b.lane
 AND a.window_low < b.window_high AND b.window_low < a.window_high
 AND (a.window_low < b.window_low OR (a.window_low = b.window_low AND a.snapshot_id < b.snapshot_id))
GROUP BY ALL
"""


@query("overlapping_windows", _OVERLAPPING)
def _(t):
    return E.overlapping_windows(t.fx_snapshots).select(
        "snapshot_id", "job_id", "lane", "overlap_count", "overlap_with")


@query("overlapping_windows_binned", _OVERLAPPING)
def _(t):
    return E.overlapping_windows(t.fx_snapshots, FEW_ROWS).select(
        "snapshot_id", "job_id", "lane", "overlap_count", "overlap_with")


_MERGED = """
WITH a AS (SELECT *, MAX(window_high) OVER (PARTITION BY job_id ORDER BY window_low, snapshot_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r
           FROM fx_snapshots),
b AS (SELECT *, SUM(CASE WHEN r IS NULL OR window_low > r THEN 1 ELSE 0 END) OVER (PARTITION BY job_id ORDER BY window_low, snapshot_id) AS g FROM a)
SELECT job_id, MIN(window_low) AS window_low, MAX(window_high) AS window_high, COUNT(DISTINCT window_low) AS merged_windows FROM b GROUP BY job_id, g
"""


@query("merged_windows", _MERGED)
def _(t):
    return E.merge_windows(t.fx_snapshots, ["job_id"])


@query("merged_windows_binned", _MERGED)
def _(t):
    return E.merge_windows(t.fx_snapshots, ["job_id"], bins=FEW_ROWS)


_MERGED_REPAIRS = """
a AS (SELECT *, MAX(window_high) OVER (PARTITION BY parent_contract_id ORDER BY window_low, window_high ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM fx_repairs),
b AS (SELECT *, SUM(CASE WHEN r IS NULL OR window_low > r THEN 1 ELSE 0 END) OVER (PARTITION BY parent_contract_id ORDER BY window_low, window_high ROWS UNBOUNDED PRECEDING) AS g FROM a),
m AS (SELECT parent_contract_id, MIN(window_low) AS lo, MAX(window_high) AS hi FROM b GROUP BY parent_contract_id, g)
"""


@query("window_containment", f"""
WITH {_MERGED_REPAIRS}
SELECT snapshot_id, EXISTS (SELECT 1 FROM m WHERE m.parent_contract_id = s.job_id AND m.lo <= s.window_low AND m.hi >= s.window_high) AS is_covered
FROM fx_snapshots s
""")
def _(t):
    union = cut_lineage(E.merge_windows(
        t.fx_repairs.withColumnRenamed("parent_contract_id", "job_id"), ["job_id"]))
    return E.covered_by(t.fx_snapshots, union, ["job_id"]).select("snapshot_id", "is_covered")


@query("unexplained_snapshots", f"""
WITH {_MERGED_REPAIRS},
u AS (SELECT s.* FROM fx_snapshots s WHERE writer_kind = 'ingest'
      AND NOT EXISTS (SELECT 1 FROM fx_ledger l WHERE l.cas_applied AND l.committed_snapshot_id = s.snapshot_id)),
x AS (SELECT u.snapshot_id, u.contract_id, u.attempt_no,
   EXISTS (SELECT 1 FROM fx_attempts t WHERE t.contract_id = u.contract_id AND t.attempt_no = u.attempt_no AND t.verdict = 'NO_COMMIT') AS is_decided,
   d.detected_by IS NOT NULL AS is_detected,
   EXISTS (SELECT 1 FROM m WHERE m.parent_contract_id = d.detected_by AND m.lo <= u.window_low AND m.hi >= u.window_high) AS is_repaired
   FROM u LEFT JOIN fx_detections d ON u.snapshot_id = d.snapshot_id)
SELECT *, is_decided AND is_detected AND is_repaired AS is_explained FROM x
""")
def _(t):
    return E.unexplained_snapshots(t.fx_snapshots, t.fx_ledger, t.fx_attempts, t.fx_detections, t.fx_repairs)


@query("ledger_gaps", """
WITH p AS (SELECT *, LAG(window_high) OVER (PARTITION BY job_id ORDER BY cas_at, ledger_id) AS ph FROM fx_ledger WHERE cas_applied)
SELECT ledger_id, job_id, ph AS previous_high, CASE WHEN window_high <= window_low THEN 'REGRESSION' WHEN window_low > ph THEN 'GAP' ELSE 'OVERLAP' END AS finding
FROM p WHERE operation_class NOT IN ('INITIAL_LOAD', 'REPAIR') AND (window_high <= window_low OR window_low <> ph)
""")
def _(t):
    return E.ledger_gaps(t.fx_ledger).select("ledger_id", "job_id", "previous_high", "finding")


@query("tag_coverage", """
SELECT table_id, COUNT(*) AS snapshot_count, COUNT(*) FILTER (ok) AS tagged_count, round(100.0 * COUNT(*) FILTER (ok) / COUNT(*), 4) AS coverage_pct
FROM (SELECT *, CASE WHEN writer_kind = 'maintenance' THEN lease_id IS NOT NULL ELSE writer_kind IS NOT NULL AND contract_id IS NOT NULL END AS ok
      FROM fx_snapshots WHERE snapshot_id % 422 <> 0) GROUP BY table_id
""")
def _(t):
    return E.tag_coverage(t.fx_snapshots, t.fx_snapshots.where("snapshot_id % 422 = 0"))


@query("exposure_p99", """
SELECT quantile_cont(date_diff('second', committed_at, repair_finalized_at), 0.99) AS exposure_p99_s,
       COUNT(*) AS bad_snapshots, COUNT(*) FILTER (repair_finalized_at IS NULL) AS unresolved FROM fx_exposure
""")
def _(t):
    return E.exposure_p99(t.fx_exposure)


@query("case_crosscheck", """
WITH e AS (SELECT o_custkey % 400 AS case_id, COUNT(*) AS n FROM orders WHERE o_orderkey % 17 <> 0 AND o_custkey % 40 <> 1 GROUP BY 1),
o AS (SELECT o_custkey % 400 AS case_id, COUNT(*) AS n FROM orders WHERE o_orderkey % 19 <> 0 AND o_custkey % 40 <> 2 GROUP BY 1)
SELECT case_id, COALESCE(e.n, 0) AS expected_count, COALESCE(o.n, 0) AS observed_count,
       CASE WHEN COALESCE(o.n, 0) > COALESCE(e.n, 0) THEN 'EXCESS' WHEN COALESCE(o.n, 0) < COALESCE(e.n, 0) THEN 'SHORTAGE' ELSE 'MATCH' END AS case_result
FROM e FULL JOIN o USING (case_id)
""")
def _(t):
    case = F.expr("o_custkey % 400").alias("case_id")
    e = t.orders.where("o_orderkey % 17 <> 0 AND o_custkey % 40 <> 1").groupBy(case).agg(F.count(F.lit(1)).alias("expected_count"))
    o = t.orders.where("o_orderkey % 19 <> 0 AND o_custkey % 40 <> 2").groupBy(case).agg(F.count(F.lit(1)).alias("observed_count"))
    return E.case_crosscheck(e, o)


@query("current_watermark", """
SELECT job_id, MAX(window_high) FILTER (cas_applied) AS current_watermark, COUNT(*) FILTER (cas_applied) AS applied_chunks,
       COUNT(*) FILTER (NOT cas_applied) AS rejected_chunks FROM fx_ledger GROUP BY job_id
""")
def _(t):
    return E.current_watermark(t.fx_ledger)


@query("resume_points", """
WITH RECURSIVE b AS (SELECT contract_id, MIN(window_low) AS lo, MAX(window_high) AS hi FROM fx_ledger GROUP BY contract_id),
r AS (SELECT contract_id, lo AS pos FROM b UNION
      SELECT a.contract_id, a.window_high FROM r JOIN fx_ledger a ON a.contract_id = r.contract_id AND a.cas_applied AND a.window_low <= r.pos AND a.window_high > r.pos)
SELECT contract_id, MAX(pos) AS resume_low, hi AS contract_high FROM r JOIN b USING (contract_id) GROUP BY contract_id, hi HAVING MAX(pos) < hi
""")
def _(t):
    return E.resume_points(t.fx_ledger)


@query("watermark_regressions", """
SELECT ledger_id, job_id, window_high, reached_high FROM (
  SELECT *, MAX(window_high) OVER (PARTITION BY job_id ORDER BY cas_at, ledger_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reached_high
  FROM fx_ledger WHERE cas_applied) WHERE window_high < reached_high
""")
def _(t):
    return E.watermark_regressions(t.fx_ledger).select("ledger_id", "job_id", "window_high", "reached_high")


@query("following_commit", """
SELECT ledger_id, LEAD(cas_at) OVER (PARTITION BY job_id ORDER BY cas_at, ledger_id) AS next_cas_at FROM fx_ledger WHERE cas_applied
""")
def _(t):
    return E.following_commit(t.fx_ledger).select("ledger_id", "next_cas_at")
