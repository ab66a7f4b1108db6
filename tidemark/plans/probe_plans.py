"""Probe and trace analysis over the sample tables."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tidemark.operators import probes as P
from tidemark.operators import traces as R
from tidemark.plans.registry import query, with_strangers

_CLASSIFIED = r"""(
WITH c AS (SELECT *, COALESCE(abs(ora), TRY_CAST(NULLIF(regexp_extract(msg, 'ORA-(\d+)', 1), '') AS INTEGER)) AS code FROM fx_probes),
k AS (SELECT *, probe IN ('dbms_flashback.get_scn', 'v$dataguard_stats', 'feat.standard_hash_sha256', 'nls.characterset', 'nls.nchar_characterset',
   'feat.rowdependencies_target', 'wm_column.type_facts', 'v$parameter.max_string') AS rv,
   CASE WHEN probe = 'dbms_flashback.get_scn' THEN '^\d+$' WHEN probe LIKE 'nls.%' THEN '^[A-Z0-9_]+$' WHEN probe = 'feat.rowdependencies_target' THEN '^(ENABLED|DISABLED)$'
        WHEN probe = 'wm_column.type_facts' THEN '^[A-Z][A-Z0-9_ ]*(\(\d+(\s*,\s*-?\d+)?\))?\|' END AS pat FROM c)
SELECT source_id, probe, code AS error_code, value, value_interpretable,
  CASE WHEN query_ok THEN CASE WHEN row_present = FALSE THEN 'EMPTY' WHEN value IS NULL AND (has_value OR rv) THEN 'EMPTY' WHEN rv AND trim(value) = '' THEN 'EMPTY'
      WHEN value_interpretable = FALSE THEN 'NOT_INTERPRETABLE' WHEN pat IS NOT NULL AND value IS NOT NULL AND NOT regexp_matches(value, pat) THEN 'GRAMMAR' ELSE 'OK' END
    WHEN code IS NULL THEN 'UNKNOWN' WHEN code = 3113 THEN 'TRANSIENT'
    WHEN code = 2248 AND probe LIKE 'alter.%' THEN 'UNSUPPORTED' WHEN code = 904 AND probe = 'feat.standard_hash_sha256' THEN 'UNSUPPORTED'
    WHEN code IN (900, 923, 933, 2003) THEN 'UNSUPPORTED' WHEN code = 1031 THEN 'DENIED' WHEN code = 942 THEN 'WRONG_TARGET' WHEN code = 1722 THEN 'PROBE_BUG'
    WHEN code IN (904, 6550) THEN 'AMBIGUOUS' ELSE 'UNKNOWN' END AS kind
FROM k)"""


def _classified(t):
    return P.classify_probes(t.fx_probes, P.probe_rules(t.spark))


@query("probe_classification", f"SELECT source_id, probe, error_code, kind FROM {_CLASSIFIED}")
def _(t):
    return _classified(t).select("source_id", "probe", "error_code", "kind")


_K = lambda p: f"COALESCE(MAX(kind) FILTER (probe = '{p}'), 'ABSENT')"
_V = lambda p: f"MAX(value) FILTER (probe = '{p}')"
_WIDE = f"""(SELECT source_id, {_K('dbms_flashback.get_scn')} AS scn, {_K('as_of_timestamp.target')} AS asf, {_K('v$dataguard_stats')} AS lag,
  {_K('alter.STANDBY_MAX_DATA_DELAY.D')} AS dly, MAX(error_code) FILTER (probe = 'max_delay_zero.touch_target') AS touch, {_K('feat.standard_hash_sha256')} AS hsh,
  bool_or(value_interpretable) FILTER (probe = 'feat.standard_hash_sha256') AS hok, {_K('feat.fetch_first')} AS ff, {_K('nls.characterset')} AS cs, {_V('nls.characterset')} AS csv,
  {_K('feat.rowdependencies_target')} AS dep, {_V('feat.rowdependencies_target')} AS depv, {_K('feat.ora_rowscn_target')} AS rs, {_K('timestamp_to_scn')} AS t2s,
  {_K('scn_to_timestamp.roundtrip')} AS s2t, {_K('wm_column.type_facts')} AS wm, {_V('wm_column.type_facts')} AS wmv FROM {_CLASSIFIED} GROUP BY source_id)"""
_ATOMIC_VALUES = {
    "snapshot_anchor": "CASE WHEN scn = 'OK' THEN 'SCN' WHEN asf = 'OK' THEN 'TIMESTAMP' WHEN scn = 'UNSUPPORTED' AND asf = 'UNSUPPORTED' THEN 'NONE' ELSE 'UNDETERMINED' END",
    "lag_observation": "CASE lag WHEN 'OK' THEN 'DG_STATS' WHEN 'UNSUPPORTED' THEN 'NONE' ELSE 'UNDETERMINED' END",
    "lag_admission": "CASE WHEN touch = 3172 THEN 'MAX_DELAY_ENFORCED' WHEN dly = 'UNSUPPORTED' THEN 'NONE' ELSE 'UNDETERMINED' END",
    "hash_function": "CASE WHEN hsh = 'OK' AND hok THEN 'SHA256' WHEN hsh IN ('UNSUPPORTED', 'NOT_INTERPRETABLE') THEN 'NONE' ELSE 'UNDETERMINED' END",
    "sql_dialect": "CASE ff WHEN 'OK' THEN '12C_PLUS' WHEN 'UNSUPPORTED' THEN '11G' ELSE 'UNDETERMINED' END",
    "db_charset": "CASE cs WHEN 'OK' THEN csv ELSE 'UNDETERMINED' END",
    "snapshot_object_coverage": "CASE asf WHEN 'OK' THEN 'PARTIAL' WHEN 'UNSUPPORTED' THEN 'NONE' ELSE 'UNDETERMINED' END",
    "row_change_scn": "CASE WHEN rs = 'UNSUPPORTED' THEN 'NONE' WHEN rs <> 'OK' OR dep <> 'OK' THEN 'UNDETERMINED' WHEN depv = 'ENABLED' THEN 'ROW_LEVEL' ELSE 'BLOCK_LEVEL' END",
    "watermark_commit_bound": "CASE WHEN NOT (rs IN ('OK', 'UNSUPPORTED') AND t2s IN ('OK', 'UNSUPPORTED') AND s2t IN ('OK', 'UNSUPPORTED')) THEN 'UNDETERMINED' "
                              "WHEN rs = 'OK' AND s2t = 'OK' THEN 'OBSERVED' ELSE 'NONE' END",
    "wm_successor": "CASE WHEN wm <> 'OK' THEN 'UNDETERMINED' WHEN wmv = 'TIMESTAMP(6)|scale=6' THEN 'TIMESTAMP(6)' WHEN wmv = 'DATE|scale=-' THEN 'DATE' "
                    "WHEN wmv = 'NUMBER|scale=2' THEN 'NUMBER(scale=2)' WHEN wmv LIKE 'BINARY%' THEN 'UNDEFINED' ELSE 'UNDETERMINED' END",
}
_ATOMIC = "(" + " UNION ALL ".join(
    f"SELECT source_id, '{a}' AS axis, {v} AS value FROM w" for a, v in _ATOMIC_VALUES.items()) + ")"
_SCOPE = """CASE WHEN a.value = 'UNDETERMINED' OR c.value = 'UNDETERMINED' THEN 'UNDETERMINED' WHEN a.value = 'NONE' THEN 'STATEMENT'
  WHEN c.value <> 'ALL' THEN 'CONNECTION' ELSE 'JOB' END"""
_COMPOSITE = f"""(SELECT a.source_id, 'snapshot_scope' AS axis, {_SCOPE} AS value FROM ax a JOIN ax c ON a.source_id = c.source_id
  AND a.axis = 'snapshot_anchor' AND c.axis = 'snapshot_object_coverage'
 UNION ALL SELECT source_id, 'canonical_row_compare', CASE value WHEN 'SHA256' THEN 'PARTIAL' ELSE value END FROM ax WHERE axis = 'hash_function'
 UNION ALL SELECT source_id, 'cross_source_comparable', 'UNDETERMINED' FROM ax WHERE axis = 'hash_function')"""


def _axes(t):
    return P.derive_axes(_classified(t))


@query("capability_axes", f"WITH w AS {_WIDE} SELECT * FROM {_ATOMIC}")
def _(t):
    return _axes(t)


@query("composite_axes", f"WITH w AS {_WIDE}, ax AS {_ATOMIC} SELECT * FROM {_COMPOSITE}")
def _(t):
    return P.compose_axes(_axes(t))


@query("effective_axes", f"""
WITH w AS {_WIDE}, ax AS {_ATOMIC}, al AS (SELECT * FROM ax UNION ALL SELECT * FROM {_COMPOSITE}),
m AS (SELECT *, CASE WHEN source_id % 5 <> 0 THEN TIMESTAMP '2024-01-01' + (source_id % 30) * INTERVAL 1 DAY END AS measured_at,
  source_id % 4 <> 0 AS is_bound, axis IN ('snapshot_object_coverage', 'row_change_scn', 'watermark_commit_bound', 'wm_successor') AS tabular FROM al),
r AS (SELECT *, measured_at + INTERVAL 10 DAY AS expires_at, COALESCE(measured_at + INTERVAL 10 DAY < TIMESTAMP '2024-01-20', FALSE) AS stale,
  list_filter([CASE WHEN source_id % 11 = 0 THEN 'CHILD_NOT_MEASURED' END, CASE WHEN measured_at + INTERVAL 10 DAY < TIMESTAMP '2024-01-20' THEN 'STALE' END,
   CASE WHEN value <> 'UNDETERMINED' AND measured_at IS NULL THEN 'NO_FRESHNESS_BASIS' END, CASE WHEN value <> 'UNDETERMINED' AND tabular AND NOT is_bound THEN 'UNBOUND' END], lambda x: x IS NOT NULL) AS reasons FROM m),
l AS (SELECT r.*, (axis = 'snapshot_scope' AND bool_or(axis IN ('snapshot_anchor', 'snapshot_object_coverage') AND len(reasons) > 0) OVER p)
   OR (axis = 'canonical_row_compare' AND bool_or(axis = 'hash_function' AND len(reasons) > 0) OVER p)
   OR (axis = 'cross_source_comparable' AND bool_or(axis = 'db_charset' AND len(reasons) > 0) OVER p) AS low FROM r WINDOW p AS (PARTITION BY source_id)),
f AS (SELECT *, array_to_string(CASE WHEN low THEN list_append(reasons, 'COMPOSITE_INPUT_FLOORED') ELSE reasons END, ',') AS floor_reasons FROM l)
SELECT source_id, axis, value, stale, expires_at, CASE WHEN measured_at IS NULL THEN 'NO_MEASUREMENT' ELSE 'OPERATOR_DECLARED_TTL' END AS freshness_basis, floor_reasons,
 CASE WHEN floor_reasons = '' OR value = 'UNDETERMINED' THEN value
   WHEN axis = 'sql_dialect' THEN '11G' WHEN axis = 'db_charset' THEN 'UNDETERMINED' WHEN axis = 'wm_successor' THEN 'UNDEFINED'
   WHEN axis = 'snapshot_scope' THEN CASE WHEN value = 'NONE' THEN 'NONE' ELSE 'STATEMENT' END WHEN axis = 'cross_source_comparable' THEN 'NO' ELSE 'NONE' END AS effective_value
FROM f
""")
def _(t):
    rows = P.derive_all_axes(_classified(t)).select(
        "*", F.expr("CASE WHEN source_id % 5 <> 0 THEN timestamp_ntz'2024-01-01' + (source_id % 30) * INTERVAL 1 DAY END").alias("measured_at"),
        F.expr("source_id % 4 <> 0").alias("is_bound"),
        F.expr("CASE WHEN source_id % 11 = 0 THEN array('CHILD_NOT_MEASURED') END").alias("extra_reasons"))
    out = P.apply_floors(rows, datetime(2024, 1, 20), timedelta(days=10))
    return out.select(
        "source_id", "axis", "value", "stale", "expires_at", "freshness_basis",
        F.array_join("floor_reasons", ",").alias("floor_reasons"), "effective_value")


@query("axis_distribution", f"""
WITH w AS {_WIDE} SELECT axis, value, COUNT(*) AS source_count, round(COUNT(*) / SUM(COUNT(*)) OVER (PARTITION BY axis), 6) AS share FROM {_ATOMIC} GROUP BY axis, value
""")
def _(t):
    return P.axis_distribution(_axes(t))


CONTRACT = [f"p{i}" for i in range(20)]


@query("probe_set_audit", """
WITH n AS (SELECT source_id, probe, COUNT(*) AS c FROM fx_probe_runs GROUP BY ALL),
want AS (SELECT s.source_id, 'p' || CAST(i AS VARCHAR) AS probe FROM (SELECT DISTINCT source_id FROM n) s, RANGE(20) r(i))
SELECT source_id, probe, 'MISSING' AS finding FROM want ANTI JOIN n USING (source_id, probe)
UNION ALL SELECT source_id, probe, 'UNKNOWN' FROM n WHERE probe = 'p99'
UNION ALL SELECT source_id, probe, 'DUPLICATE' FROM n WHERE c > 1
UNION ALL SELECT s.source_id, '(summary)', CASE WHEN expected <> 20 THEN 'EXPECTED_COUNT_WRONG' ELSE 'EMITTED_COUNT_WRONG' END
  FROM fx_probe_summaries s JOIN (SELECT source_id, SUM(c) AS k FROM n GROUP BY 1) p USING (source_id) WHERE expected <> 20 OR emitted <> k
""")
def _(t):
    return P.probe_set_audit(t.fx_probe_runs, CONTRACT, t.fx_probe_summaries)


@query("coverage_status", """
WITH p AS (SELECT child_id, COUNT(*) FILTER (record_kind <> 'UNPARSABLE') AS ok, COUNT(*) FILTER (record_kind = 'SUMMARY') AS s, COUNT(*) FILTER (record_kind = 'END') AS e,
  COUNT(*) FILTER (record_kind = 'SUMMARY' AND manifest_ok = FALSE) AS bad, COUNT(*) FILTER (record_kind = 'PROBE' AND skipped) AS sk, COUNT(DISTINCT probe) FILTER (record_kind = 'PROBE') AS k
  FROM fx_child_records GROUP BY child_id),
x AS (SELECT c.child_id, CASE WHEN p.child_id IS NULL THEN 'NOT_RUN:' WHEN ok = 0 THEN 'FAILED:NOTHING_PARSABLE' WHEN s = 0 THEN 'PARTIAL:NO_SUMMARY' WHEN bad > 0 THEN 'FAILED:MANIFEST_BROKEN'
  WHEN e = 0 THEN 'PARTIAL:NO_END_SENTINEL' WHEN k < 10 THEN 'PARTIAL:PROBES_MISSING' WHEN sk > 0 THEN 'PARTIAL:PROBES_SKIPPED' ELSE 'MEASURED:' END AS r, 10 - k AS missing_probes
  FROM fx_children c LEFT JOIN p ON c.child_id = p.child_id)
SELECT child_id, split_part(r, ':', 1) AS status, split_part(r, ':', 2) AS reason, missing_probes FROM x
""")
def _(t):
    return P.coverage_status(t.fx_children, t.fx_child_records, [f"q{i}" for i in range(10)])


@query("run_set_conflicts", """
SELECT set_id, 'MIXED_RUN' AS finding, '' AS detail FROM fx_manifests WHERE run_id <> 'MISSING' GROUP BY set_id HAVING COUNT(DISTINCT run_id) > 1
UNION ALL SELECT set_id, 'MIXED_VERSIONS', '' FROM fx_manifests GROUP BY set_id HAVING COUNT(DISTINCT versions_digest) > 1
UNION ALL SELECT set_id, 'MIXED_HARNESS', '' FROM fx_manifests WHERE harness_digest <> '' GROUP BY set_id HAVING COUNT(DISTINCT harness_digest) > 1
UNION ALL SELECT set_id, 'MIXED_SOURCE_IN_SCOPE', scope FROM fx_manifests GROUP BY set_id, scope HAVING COUNT(DISTINCT source_id) > 1
UNION ALL SELECT DISTINCT set_id, 'UNKNOWN_CHILD', child FROM fx_manifests WHERE child = 'extra'
UNION ALL SELECT DISTINCT a.set_id, 'SCOPES_SHARE_DATABASE', upper(a.source_id) FROM fx_manifests a JOIN fx_manifests b ON a.set_id = b.set_id
  AND a.scope = 'SOURCE' AND b.scope = 'COUNTEREXAMPLE' AND upper(a.source_id) = upper(b.source_id)
""")
def _(t):
    return P.run_set_conflicts(t.fx_manifests, [f"child{i}" for i in range(5)])


_STREAMS = """(WITH s AS (SELECT suite_id, file, COUNT(*) AS line_count, COUNT(*) FILTER (NOT is_json) AS unparsable, COUNT(*) FILTER (event = 'trace_end') AS sentinels, MAX(lines_written) AS lines_written
  FROM fx_trace_lines GROUP BY suite_id, file)
SELECT *, CASE WHEN sentinels = 0 THEN 'NO_SENTINEL' WHEN sentinels > 1 THEN 'MANY_SENTINELS' WHEN lines_written IS NULL THEN 'NO_LINE_COUNT' WHEN line_count <= lines_written THEN 'LINES_LOST'
  WHEN line_count > lines_written + 1 THEN 'FOREIGN_LINES' WHEN unparsable > 0 THEN 'UNPARSABLE_LINES' END AS why FROM s)"""


def _streams(t):
    return R.stream_status(t.fx_trace_lines, ("suite_id", "file"))


@query("trace_stream_status", f"SELECT *, why IS NULL AS is_complete FROM {_STREAMS}")
def _(t):
    return _streams(t)


@query("trace_run_complete", f"SELECT suite_id, COUNT(*) AS files, bool_and(why IS NULL) AS trace_complete FROM {_STREAMS} GROUP BY suite_id")
def _(t):
    return R.run_complete(_streams(t), "suite_id")


@query("trace_coverage", """
SELECT suite_id, COUNT(*) AS connections, COUNT(*) FILTER (declared_phase = 'schema_only') AS schema_connections,
  COUNT(*) FILTER (declared_phase IN ('partitioned_count', 'second_action')) AS task_connections, COUNT(*) FILTER (COALESCE(declared_phase, 'BETWEEN_STEPS') = 'BETWEEN_STEPS') AS undeclared_connections,
  COUNT(*) FILTER (preamble_ok) AS preamble_ok, COUNT(DISTINCT sid) AS distinct_sessions,
  COUNT(*) FILTER (declared_phase = 'schema_only') > 0 AND COUNT(*) FILTER (declared_phase IN ('partitioned_count', 'second_action')) > 0 AS paths_covered,
  COUNT(*) = COUNT(*) FILTER (preamble_ok) AS preamble_everywhere
FROM fx_trace WHERE run = 'coverage' GROUP BY suite_id
""")
def _(t):
    return R.trace_coverage(t.fx_trace.where("run = 'coverage'"), "suite_id")


@query("preamble_by_path", """
SELECT suite_id, path_guess, COUNT(*) AS connections, COUNT(*) FILTER (preamble_ok) AS preamble_ok FROM fx_trace GROUP BY ALL
""")
def _(t):
    return R.preamble_by_path(t.fx_trace, "suite_id")


@query("failclosed_status", """
WITH c AS (SELECT suite_id, suite_id % 7 <> 6 AS trace_complete FROM fx_trace GROUP BY suite_id),
s AS (SELECT suite_id, COUNT(*) FILTER (status IN ('FAIL_CLOSED_BROKEN', 'FAIL_CLOSED_PARTIAL')) AS b FROM fx_failing_steps GROUP BY 1),
p AS (SELECT a.suite_id, COUNT(*) AS n FROM (SELECT suite_id, run FROM fx_trace WHERE injection_applied AND run <> 'coverage' GROUP BY ALL) a
      JOIN fx_terminals t ON a.suite_id = t.suite_id AND a.run = t.run WHERE t.status = 'EXPECTED_FAILURE_OBSERVED' AND rows_read_total = 0 GROUP BY 1)
SELECT suite_id, CASE WHEN b IS NULL THEN 'NOT_TESTED' WHEN b > 0 THEN 'NO' WHEN NOT trace_complete THEN 'MEASUREMENT_FAILED' WHEN COALESCE(n, 0) < 2 THEN 'NOT_PROVEN' ELSE 'YES' END AS answer,
  COALESCE(n, 0) AS proven_runs, COALESCE(b, 0) AS broken_steps FROM c LEFT JOIN s USING (suite_id) LEFT JOIN p USING (suite_id)
""")
def _(t):
    done = t.fx_trace.groupBy("suite_id").agg(F.first(F.expr("suite_id % 7 <> 6")).alias("trace_complete"))
    return R.failclosed_status(t.fx_trace, t.fx_terminals, t.fx_failing_steps, done)


_WRONG = "(expected_db IS NULL OR upper(db_unique_name) <> expected_db OR database_role <> upper(expected_role))"


@query("connection_identity", f"""
SELECT source_id, COUNT(*) AS connections, COUNT(*) FILTER ({_WRONG}) AS wrong_identity,
  COUNT(DISTINCT sid) AS sessions, COUNT(DISTINCT instance) AS instances, COUNT(*) FILTER ({_WRONG}) = 0 AS identity_ok
FROM (SELECT * FROM fx_connections UNION ALL SELECT * REPLACE (source_id + 1000000 AS source_id) FROM fx_connections WHERE source_id % 5 = 3) LEFT JOIN fx_identities USING (source_id) GROUP BY source_id
""")
def _(t):
    return R.identity_audit(with_strangers(t.fx_connections, "source_id", "source_id % 5 = 3"), t.fx_identities)


@query("suite_verdict", """
WITH s AS (SELECT suite_id, COUNT(*) AS scenario_count, COUNT(*) FILTER (outcome = 'INJECTION_NOT_OBSERVED') AS not_observed, COUNT(*) FILTER (outcome = 'INCONCLUSIVE') AS inconclusive,
  COUNT(*) FILTER (outcome = 'COUNTEREXAMPLE_REPRODUCED') AS reproduced, COUNT(*) FILTER (outcome = 'MITIGATION_FAIL') AS mitigation_failed,
  COUNT(*) FILTER (leftover_objects > 0 OR NOT cleanup_attempted OR NOT cleanup_succeeded) AS unclean, COUNT(*) FILTER (has_error) AS errored, 9 - COUNT(DISTINCT scenario_id) AS missing
  FROM fx_scenarios GROUP BY suite_id)
SELECT *, missing + not_observed + inconclusive + unclean + errored = 0 AS execution_complete, missing + not_observed + inconclusive + reproduced + mitigation_failed = 0 AS mitigation_holds FROM s
""")
def _(t):
    return P.suite_verdict(t.fx_scenarios, [f"CE0{i}" for i in range(1, 10)])
