"""Run history and governance over the sample tables."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tidemark.operators import governance as G
from tidemark.operators import history as H
from tidemark.operators import quantiles as Q
from tidemark.plans.registry import query, with_strangers
from tidemark.session import materialised

NOW = datetime(2001, 8, 2)
# Rows per bin in some queries: few enough for large keys to be cut at the sample sizes.
FEW_ROWS = 20
DEFAULT_SLO = {1: 1200, 2: 1800, 4: 2400, 6: 3000, 12: 3600, 24: 3600}
_SECS = lambda a, b: f"(epoch_us({b}) - epoch_us({a})) / 1000000.0"

_HOURS = """
WITH h AS (SELECT j.*, UNNEST(generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-06', INTERVAL 1 HOUR)) AS local_at FROM fx_jobs j),
u AS (SELECT *, (local_at AT TIME ZONE timezone) AT TIME ZONE 'UTC' AS logical_at FROM h)
"""


@query("expected_runs", _HOURS + """
SELECT job_id, logical_at FROM u WHERE hour(local_at) % period_hours = 0
 AND logical_at >= TIMESTAMP '2024-01-02' AND logical_at < TIMESTAMP '2024-01-05'
""")
def _(t):
    return H.expand_schedule(
        t.fx_jobs.select("job_id", "period_hours", "timezone"), datetime(2024, 1, 2), datetime(2024, 1, 5),
    ).select("job_id", "logical_at")


# Two changes of the clock in two zones: local hours that are skipped have no instant, repeated ones have two.
_DST = """
WITH j AS (SELECT job_id, period_hours, CASE WHEN job_id % 2 = 0 THEN 'America/New_York' ELSE 'Europe/Berlin' END AS timezone FROM fx_jobs),
h AS (SELECT j.*, UNNEST(generate_series(TIMESTAMP '2024-03-09', TIMESTAMP '2024-04-01 23:00:00', INTERVAL 1 HOUR)
                      || generate_series(TIMESTAMP '2024-10-26', TIMESTAMP '2024-11-04 23:00:00', INTERVAL 1 HOUR)) AS logical_at FROM j),
u AS (SELECT *, (logical_at AT TIME ZONE 'UTC') AT TIME ZONE timezone AS local_at FROM h)
"""
_DST_SPANS = ((datetime(2024, 3, 9), datetime(2024, 4, 2)), (datetime(2024, 10, 26), datetime(2024, 11, 5)))


def _zoned_jobs(t):
    return t.fx_jobs.selectExpr(
        "job_id", "period_hours", "CASE WHEN job_id % 2 = 0 THEN 'America/New_York' ELSE 'Europe/Berlin' END AS timezone")


@query("expected_runs_dst", _DST + "SELECT job_id, logical_at FROM u WHERE hour(local_at) % period_hours = 0")
def _(t):
    a, b = (H.expand_schedule(_zoned_jobs(t), *span).select("job_id", "logical_at") for span in _DST_SPANS)
    return a.unionAll(b)


@query("expected_cron_runs_dst", _DST + """
SELECT job_id, logical_at + m * INTERVAL 1 MINUTE AS logical_at FROM u, (VALUES (0), (30)) v(m)
WHERE CASE WHEN job_id % 3 = 0 THEN m = 30 AND hour(local_at) IN (1, 2) ELSE m = 0 AND hour(local_at) BETWEEN 0 AND 3 AND dayofweek(local_at) = 0 END
""")
def _(t):
    jobs = _zoned_jobs(t).withColumn("cron", F.expr("CASE WHEN job_id % 3 = 0 THEN '30 1,2 * * *' ELSE '0 0-3 * * 0' END"))
    a, b = (H.expand_cron(jobs, *span).select("job_id", "logical_at") for span in _DST_SPANS)
    return a.unionAll(b)


@query("expected_cron_runs", _HOURS + """
SELECT job_id, logical_at + m * INTERVAL 1 MINUTE AS logical_at FROM u, (VALUES (0), (10), (30), (45), (50)) v(m)
WHERE logical_at + m * INTERVAL 1 MINUTE >= TIMESTAMP '2024-01-02' AND logical_at + m * INTERVAL 1 MINUTE < TIMESTAMP '2024-01-05'
  AND CASE job_id % 5 WHEN 0 THEN m = 0
      WHEN 1 THEN m = 30 AND hour(local_at) IN (6, 18) AND dayofweek(local_at) BETWEEN 1 AND 5
      WHEN 2 THEN m IN (10, 30, 50) AND hour(local_at) % 4 = 0 AND day(local_at) BETWEEN 1 AND 3
      WHEN 3 THEN m = 0 AND hour(local_at) = 0 AND (day(local_at) = 4 OR dayofweek(local_at) = 2)
      ELSE m = 45 AND hour(local_at) BETWEEN 8 AND 18 AND hour(local_at) % 2 = 0 AND month(local_at) = 1 END
""")
def _(t):
    jobs = t.fx_jobs.select("job_id", "timezone", F.expr(
        "CASE job_id % 5 WHEN 0 THEN '0 * * * *' WHEN 1 THEN '30 6,18 * * 1-5' WHEN 2 THEN '10-50/20 */4 1-3 * *' "
        "WHEN 3 THEN '0 0 4 * 2' ELSE '45 8-18/2 * 1 *' END").alias("cron"))
    return H.expand_cron(jobs, datetime(2024, 1, 2), datetime(2024, 1, 5)).select("job_id", "logical_at")


@query("sketched_percentiles", """
SELECT event_type, COUNT(value) AS n, TRUE AS p50_holds, TRUE AS p95_holds, TRUE AS p99_holds FROM events
WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-25' GROUP BY event_type
""")
def _(t):
    # Sketches are stored per hour; twenty days of them are merged, and each result's rank is looked up in the values.
    outputs = {"p50": 0.5, "p95": 0.95, "p99": 0.99}
    stored = materialised(Q.hourly_sketches(t.events, ["event_type"], "ts", "value"), "sketches")
    span = "{0} >= timestamp_ntz'2024-01-05' AND {0} < timestamp_ntz'2024-01-25'"
    found = Q.sketched_percentiles(stored.where(span.format("hour")), ["event_type"], outputs)
    rows = t.events.where(span.format("ts")).where("value IS NOT NULL").join(found, "event_type")
    ranks = [F.avg((F.col("value") < F.col(c)).cast("int")).alias(f"{c}_below") for c in outputs]
    ranks += [F.avg((F.col("value") <= F.col(c)).cast("int")).alias(f"{c}_upto") for c in outputs]
    held = rows.groupBy("event_type", "n").agg(*ranks)
    return held.select("event_type", "n", *[
        ((F.col(f"{c}_below") - Q.RANK_ERROR <= p) & (F.col(f"{c}_upto") + Q.RANK_ERROR >= p)).alias(f"{c}_holds") for c, p in outputs.items()])


_AUDIT = """
WITH a AS (SELECT job_id, logical_at, COUNT(*) AS n FROM fx_occurrences GROUP BY ALL)
SELECT job_id, logical_at, COALESCE(a.n, 0) AS occurrences,
  CASE WHEN e.m IS NULL THEN 'UNEXPECTED' WHEN a.n > 1 THEN 'DUPLICATE' WHEN a.n = 1 THEN 'OK' WHEN r.k IS NOT NULL THEN 'EXPLAINED' ELSE 'MISSING' END AS audit_state
FROM (SELECT *, 1 AS m FROM fx_expected) e FULL JOIN a USING (job_id, logical_at) LEFT JOIN (SELECT *, 1 AS k FROM fx_rejected) r USING (job_id, logical_at)
"""


@query("occurrence_audit", _AUDIT)
def _(t):
    return H.occurrence_audit(t.fx_expected, t.fx_occurrences, t.fx_rejected)


@query("missing_tick_rollup", f"""
WITH m AS (SELECT job_id, logical_at, 'S' || CAST(job_id % 700 AS VARCHAR) AS schedule_name FROM ({_AUDIT}) WHERE audit_state = 'MISSING'),
s AS (SELECT 'S' || CAST(c_custkey % 700 AS VARCHAR) AS schedule_name, COUNT(*) AS n FROM customer GROUP BY 1),
k AS (SELECT schedule_name, logical_at, COUNT(*) AS job_count FROM m GROUP BY ALL),
w AS (SELECT k.* FROM k JOIN s USING (schedule_name) WHERE job_count = n)
SELECT schedule_name, logical_at, NULL AS job_id, job_count, 'SCHEDULE' AS event_scope FROM w
UNION ALL SELECT m.schedule_name, m.logical_at, m.job_id, 1, 'JOB' FROM m ANTI JOIN w USING (schedule_name, logical_at)
""")
def _(t):
    missing = H.occurrence_audit(t.fx_expected, t.fx_occurrences, t.fx_rejected).where("audit_state = 'MISSING'")
    schedules = t.customer.selectExpr("c_custkey AS job_id", "concat('S', c_custkey % 700) AS schedule_name")
    return H.rollup_missing(missing.select("job_id", "logical_at"), schedules)


_LATE = f"""
SELECT o.occurrence_id, o.job_id, o.logical_at, c.finalized_at, {_SECS('o.logical_at', 'c.finalized_at')} AS lateness_s, c.period_band
FROM fx_occurrences o LEFT JOIN fx_contracts c ON o.contract_id = c.contract_id AND c.state IN ('FINALIZED', 'FINALIZED_NO_DATA', 'RESOLVED')
  AND o.disposition IN ('EXECUTED', 'COALESCED_INTO')
WHERE o.operation_class IN ('NORMAL', 'CATCHUP') AND o.disposition NOT IN ('SKIPPED_BY_HOLD', 'SUPERSEDED_BY')
"""


@query("lateness", _LATE)
def _(t):
    return H.lateness(t.fx_occurrences, t.fx_contracts).select(
        "occurrence_id", "job_id", "logical_at", "finalized_at", "lateness_s", "period_band")


@query("freshness_breaches", f"""
WITH x AS (SELECT l.*, COALESCE(j.freshness_slo_s, CASE j.period_hours WHEN 1 THEN 1200 WHEN 2 THEN 1800 WHEN 4 THEN 2400 WHEN 6 THEN 3000 ELSE 3600 END) AS slo_s
  FROM (SELECT * FROM ({_LATE}) UNION ALL SELECT * REPLACE (job_id + 1000000 AS job_id) FROM ({_LATE}) WHERE occurrence_id % 50 = 7) l LEFT JOIN fx_jobs j USING (job_id))
SELECT occurrence_id, job_id, logical_at, CASE WHEN job_id < 1000000 THEN slo_s END AS slo_s,
  CASE WHEN job_id >= 1000000 THEN 'UNKNOWN' WHEN finalized_at IS NULL THEN 'OVERDUE' ELSE 'LATE' END AS breach FROM x
WHERE job_id >= 1000000 OR (finalized_at IS NULL AND {_SECS('logical_at', "TIMESTAMP '2001-08-02'")} > slo_s) OR lateness_s > slo_s
""")
def _(t):
    late = H.lateness(t.fx_occurrences, t.fx_contracts)
    # Some runs belong to jobs that nobody registered.
    return H.freshness_breaches(with_strangers(late, "job_id", "occurrence_id % 50 = 7"), t.fx_jobs, NOW, DEFAULT_SLO)


@query("lateness_phases", f"""
SELECT contract_id, {_SECS('created_at', 'first_guard_ok_at')} AS wait_s, {_SECS('first_guard_ok_at', 'last_cas_at')} AS load_s,
       {_SECS('last_cas_at', 'finalized_at')} AS finalize_s FROM fx_contracts
""")
def _(t):
    return H.lateness_phases(t.fx_contracts).select("contract_id", "wait_s", "load_s", "finalize_s")


@query("lateness_phase_percentiles", f"""
SELECT period_band, quantile_cont({_SECS('first_guard_ok_at', 'last_cas_at')}, 0.5) AS p50, quantile_cont({_SECS('first_guard_ok_at', 'last_cas_at')}, 0.95) AS p95,
       quantile_cont({_SECS('first_guard_ok_at', 'last_cas_at')}, 0.99) AS p99 FROM fx_contracts GROUP BY period_band
""")
def _(t):
    return H.slo_percentiles(H.lateness_phases(t.fx_contracts), ["period_band"], "load_s")


@query("attempt_phases", f"""
SELECT attempt_id, {_SECS('t0', 't2')} AS platform_s, {_SECS('t2', 't3')} AS guard_s, {_SECS('t4', 't5')} AS submission_s, {_SECS('t6', 't7')} AS execution_s FROM fx_timeline
""")
def _(t):
    return H.attempt_phases(t.fx_timeline).select("attempt_id", "platform_s", "guard_s", "submission_s", "execution_s")


_PROTECT = """SELECT contract_id, SUM((epoch_us("at") - epoch_us(run_started_at) + COALESCE(epoch_us(next_eligible_at) - epoch_us("at"), 0)) / 1000000.0) AS protection_delay_s,
  COUNT(*) AS rejections FROM fx_guard WHERE result IN ('LEASE_BUSY', 'SOURCE_LAG_EXCEEDED', 'FENCE_UNAVAILABLE') GROUP BY contract_id"""


@query("protection_delay", _PROTECT)
def _(t):
    return H.protection_delay(t.fx_guard)


@query("queue_to_launch", f"""
WITH p AS ({_PROTECT})
SELECT attempt_id, {_SECS('t0', 't4')} - COALESCE(protection_delay_s, 0) AS queue_to_launch_s
FROM fx_timeline LEFT JOIN p USING (contract_id) WHERE contract_id IN (SELECT contract_id FROM fx_guard WHERE result = 'OK')
""")
def _(t):
    return H.queue_to_launch(t.fx_timeline, t.fx_guard).select("attempt_id", "queue_to_launch_s")


@query("state_intervals", """
SELECT seq, attempt_id, to_state, "at", LEAD("at") OVER (PARTITION BY attempt_id ORDER BY "at", seq) AS "until"
FROM fx_transitions WHERE from_state <> to_state
""")
def _(t):
    return H.state_intervals(t.fx_transitions, ["attempt_id"], "at", "seq").select(
        "seq", "attempt_id", "to_state", "at", "until")


@query("writer_overlaps", """
WITH w AS (SELECT * REPLACE (COALESCE(ended_at, TIMESTAMP '9999-12-31') AS ended_at) FROM fx_writers)
SELECT b.writer_id, b.job_id, b.lane, COUNT(*) AS overlap_count, arg_max(a.writer_id, (a.ended_at, a.writer_id)) AS overlap_with
FROM w a JOIN w b ON a.job_id = b.job_id AND a.lane = b.lane AND a.started_at < b.ended_at AND b.started_at < a.ended_at
 AND (a.started_at < b.started_at OR (a.started_at = b.started_at AND a.writer_id < b.writer_id)) GROUP BY ALL
""")
def _(t):
    return H.writer_overlaps(t.fx_writers).select("writer_id", "job_id", "lane", "overlap_count", "overlap_with")


@query("peak_concurrency", """
WITH d AS (SELECT source_id, "at", SUM(d) AS d FROM (SELECT source_id, started_at AS "at", tokens AS d FROM fx_writers
   UNION ALL SELECT source_id, ended_at, -tokens FROM fx_writers WHERE ended_at IS NOT NULL) GROUP BY source_id, "at"),
l AS (SELECT source_id, "at", SUM(d) OVER (PARTITION BY source_id ORDER BY "at") AS level FROM d)
SELECT source_id, CAST(MAX(level) AS BIGINT) AS peak, arg_min("at", (-level, "at")) AS peak_at, MIN(cap) AS cap, MAX(level) >= MIN(cap) AS cap_reached, MAX(level) > MIN(cap) AS cap_exceeded
FROM l JOIN fx_caps USING (source_id) GROUP BY source_id
""")
def _(t):
    return H.peak_concurrency(t.fx_writers, t.fx_caps, "source_id", "started_at", "ended_at", "tokens")


@query("early_regrants", """
WITH p AS (SELECT *, LAG(to_state) OVER w AS previous_state, LAG(lease_id) OVER w AS previous_lease FROM fx_lease_log
  WHERE to_state <> 'RECLAIMED' WINDOW w AS (PARTITION BY resource_id ORDER BY "at", seq))
SELECT seq, resource_id, lease_id, previous_lease FROM p WHERE to_state = 'GRANTED' AND previous_state = 'GRANTED' AND lease_id <> previous_lease
""")
def _(t):
    return H.early_regrants(t.fx_lease_log).select("seq", "resource_id", "lease_id", "previous_lease")


@query("release_lag", f"""
SELECT *, {_SECS('reclaimed_at', 'released_at')} AS release_lag_s FROM (
  SELECT lease_id, MIN("at") FILTER (to_state = 'RECLAIMED') AS reclaimed_at, MIN("at") FILTER (to_state = 'RELEASED') AS released_at
  FROM fx_lease_log GROUP BY lease_id) WHERE reclaimed_at IS NOT NULL
""")
def _(t):
    return H.release_lag(t.fx_lease_log)


_ASOF = """
SELECT o.occurrence_id, o.job_id, o.logical_at, r.release_id, r.effective_from
FROM fx_occurrences o ASOF LEFT JOIN (SELECT job_id, effective_from, MAX(release_id) AS release_id FROM fx_job_releases WHERE status = 'ACTIVE' GROUP BY ALL) r
  ON o.job_id = r.job_id AND o.logical_at >= r.effective_from
"""


def _pinned(t):
    return G.asof_release(t.fx_occurrences, t.fx_job_releases)


@query("asof_release_binned", _ASOF)
def _(t):
    return G.asof_release(t.fx_occurrences, t.fx_job_releases, bins=FEW_ROWS).select(
        "occurrence_id", "job_id", "logical_at", "release_id", "effective_from")


@query("asof_release", _ASOF)
def _(t):
    return _pinned(t).select("occurrence_id", "job_id", "logical_at", "release_id", "effective_from")


@query("asof_nation_release", """
SELECT c.c_custkey AS job_key, o.o_orderkey, r.release_id FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
ASOF LEFT JOIN (SELECT nation, effective_from, release_id FROM fx_releases WHERE status = 'ACTIVE') r ON c.c_nationkey = r.nation AND o.o_orderdate >= r.effective_from
""")
def _(t):
    occ = t.orders.join(t.customer, F.expr("o_custkey = c_custkey")).select(
        F.col("c_custkey").alias("job_key"), "o_orderkey", F.col("c_nationkey").alias("job_id"),
        F.col("o_orderdate").alias("logical_at"))
    releases = t.fx_releases.withColumnRenamed("nation", "job_id")
    return G.asof_release(occ, releases).select("job_key", "o_orderkey", "release_id")


_CAUSES = """(
WITH o AS (SELECT *, list_position(['HOLD_NEW', 'DRAIN', 'FORCE_STOP'], mode) AS rk FROM fx_holds
  WHERE starts_at <= TIMESTAMP '2024-02-05' AND (ends_at IS NULL OR ends_at > TIMESTAMP '2024-02-05'))
SELECT j.job_id, o.* FROM fx_jobs j JOIN o ON scope_kind = 'GLOBAL'
  UNION ALL SELECT j.job_id, o.* FROM fx_jobs j JOIN o ON scope_kind = 'SOURCE' AND scope_key = CAST(j.source_id AS VARCHAR)
  UNION ALL SELECT j.job_id, o.* FROM fx_jobs j JOIN o ON scope_kind = 'DOMAIN' AND scope_key = j.domain
  UNION ALL SELECT j.job_id, o.* FROM fx_jobs j JOIN o ON scope_kind = 'JOB' AND scope_key = CAST(j.job_id AS VARCHAR))"""


@query("effective_holds", f"""
SELECT job_id, arg_max(mode, rk) AS effective_mode, COUNT(*) AS hold_count, arg_min(hold_id, (starts_at, hold_id)) AS first_hold_id
FROM {_CAUSES} GROUP BY job_id
""")
def _(t):
    return G.effective_holds(t.fx_holds, t.fx_jobs, datetime(2024, 2, 5))


@query("hold_causes", f"""
SELECT job_id, scope_kind, CASE WHEN scope_kind = 'GLOBAL' THEN '*' ELSE scope_key END AS scope_key, arg_max(mode, rk) AS mode,
  COUNT(*) AS hold_count, arg_min(hold_id, (starts_at, hold_id)) AS first_hold_id
FROM {_CAUSES} GROUP BY ALL
""")
def _(t):
    return G.hold_causes(t.fx_holds, t.fx_jobs, datetime(2024, 2, 5))


_RHO = "SUM(duration_s * connections / (period_hours * 3600.0)) / MIN(pool_cap)"


@query("source_utilisation", f"""
SELECT source_id, COUNT(*) AS job_count, round({_RHO}, 9) AS rho,
  CASE WHEN MIN(pool_cap) IS NULL THEN 'UNKNOWN' WHEN {_RHO} > 1 THEN 'REJECT' WHEN {_RHO} > 0.7 THEN 'WARN' ELSE 'OK' END AS capacity_gate
FROM (SELECT * FROM fx_jobs UNION ALL SELECT * REPLACE (source_id + 1000000 AS source_id) FROM fx_jobs WHERE source_id % 6 = 5) LEFT JOIN fx_sources USING (source_id) GROUP BY source_id
""")
def _(t):
    return G.utilisation(with_strangers(t.fx_jobs, "source_id", "source_id % 6 = 5"), t.fx_sources)


@query("catchup_estimate", """
SELECT source_id, COUNT(*) AS impacted_jobs, SUM(duration_s * connections) / MIN(pool_cap) AS estimated_s, CAST(MIN(period_hours) * 3600 AS BIGINT) AS min_period_s,
  SUM(duration_s * connections) / MIN(pool_cap) > MIN(period_hours) * 3600 AS expires_before_completion
FROM fx_jobs JOIN fx_sources USING (source_id) GROUP BY source_id
""")
def _(t):
    return G.catchup_estimate(t.fx_jobs, t.fx_sources)


@query("backlog_classes", f"""
WITH h AS (SELECT DISTINCT c_custkey AS job_id FROM customer WHERE c_custkey % 9 = 0),
x AS (SELECT date_trunc('day', created_at) AS bucket_start, {_SECS('created_at', "TIMESTAMP '2001-08-02'")} AS age,
  CASE WHEN state = 'PLANNED' THEN CASE WHEN contract_id % 4 = 0 THEN 'submitted_queued' WHEN job_id IN (SELECT job_id FROM h) THEN 'held'
         WHEN created_at + INTERVAL 30 DAY <= TIMESTAMP '2001-08-02' THEN 'runnable' ELSE 'backoff' END
       WHEN state = 'ATTEMPT_ACTIVE' THEN 'executing' WHEN state IN ('ADJUDICATION_PENDING', 'DQ_FAILED', 'RECONCILIATION_REQUIRED') THEN 'safety_blocked' ELSE 'terminal' END AS backlog_class
  FROM fx_contracts)
SELECT bucket_start, backlog_class, COUNT(*) AS contract_count, MAX(age) AS oldest_age_s FROM x GROUP BY ALL
""")
def _(t):
    contracts = t.fx_contracts.withColumn("next_eligible_at", F.expr("created_at + INTERVAL 30 DAY"))
    runs = contracts.where("contract_id % 4 = 0").select("contract_id")
    held = t.customer.where("c_custkey % 9 = 0").selectExpr("c_custkey AS job_id")
    return H.backlog(contracts, runs, held, NOW)


@query("trend_tests", """
SELECT user_id, regr_slope(n, d) AS slope, AVG(n) FILTER (d >= 19738) / AVG(n) FILTER (d < 19738) AS average_ratio, stddev_samp(n) / AVG(n) AS variation, COUNT(*) AS points
FROM (SELECT user_id, date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS d, COUNT(*) AS n FROM events GROUP BY ALL) GROUP BY user_id
""")
def _(t):
    daily = t.events.groupBy("user_id", F.unix_date(F.col("ts").cast("date")).alias("d")).agg(F.count(F.lit(1)).alias("n"))
    return H.trends(daily, ["user_id"], "d", "n", 19738)


@query("publication_age", f"""
SELECT l.job_id, MAX(CASE WHEN committed_snapshot_id IS NOT NULL THEN CASE WHEN cas_applied THEN cas_at ELSE finalized_at END END) AS published_at,
  MAX(window_high) FILTER (cas_applied) AS coverage,
  {_SECS("MAX(CASE WHEN committed_snapshot_id IS NOT NULL THEN CASE WHEN cas_applied THEN cas_at ELSE finalized_at END END)", "TIMESTAMP '2024-03-01'")} AS publication_age_s
FROM fx_ledger l LEFT JOIN fx_contracts c ON l.contract_id = c.contract_id GROUP BY l.job_id
""")
def _(t):
    return G.publication_age(t.fx_ledger, t.fx_contracts, datetime(2024, 3, 1))


def _reconciles(t):
    return t.fx_contracts.where("contract_id % 5 = 0").selectExpr("job_id % 150 AS table_id", "finalized_at")


def _terms(t):
    return t.fx_jobs.withColumn("reconcile_interval_s", F.expr("86400 * (1 + job_id % 3)")).withColumn(
        "reconcile_slo_s", F.lit(3600))


_FACTS = """
SELECT job_id, grade AS upsert_consistency, CASE delete_semantics WHEN 'SOFT_DELETE' THEN 'SYNC' WHEN 'PK_RECONCILE' THEN 'BOUNDED_LAG' ELSE 'NONE' END AS delete_consistency,
  CASE delete_semantics WHEN 'SOFT_DELETE' THEN 0 WHEN 'PK_RECONCILE' THEN 86400 * (1 + job_id % 3) + 3600 END AS delete_lag_slo_s,
  (SELECT MAX(finalized_at) FROM fx_contracts c WHERE c.contract_id % 5 = 0 AND c.job_id % 150 = j.table_id) AS last_reconcile_at FROM fx_jobs j
"""


@query("contract_facts", _FACTS)
def _(t):
    return G.contract_facts(_terms(t), _reconciles(t))


@query("event_dedup", """
SELECT sha256(aggregate_id || '|' || transition || '|' || event_type) AS event_key, MIN(source_id) AS source_id, MIN("at") AS first_at, COUNT(*) AS deliveries
FROM fx_outbox GROUP BY aggregate_id, transition, event_type
""")
def _(t):
    return H.dedup_events(t.fx_outbox)


@query("event_rollup", """
SELECT source_id, COUNT(*) AS event_count, CAST(SUM(n - 1) AS BIGINT) AS repeat_deliveries FROM (
  SELECT MIN(source_id) AS source_id, COUNT(*) AS n FROM fx_outbox GROUP BY aggregate_id, transition, event_type) GROUP BY source_id
""")
def _(t):
    return H.event_rollup(H.dedup_events(t.fx_outbox))


_SENT = "SELECT aggregate_id, transition, event_type FROM fx_outbox"
_GOT = ("SELECT aggregate_id, transition, event_type FROM fx_outbox WHERE aggregate_id % 17 <> 0 "
        "UNION ALL SELECT aggregate_id, transition, event_type FROM fx_outbox WHERE aggregate_id % 19 = 0")


@query("event_loss", f"""
SELECT aggregate_id, transition, event_type, 'LOST' AS difference, COUNT(*) AS copies FROM (({_SENT}) EXCEPT ALL ({_GOT})) GROUP BY ALL
UNION ALL SELECT aggregate_id, transition, event_type, 'EXTRA', COUNT(*) FROM (({_GOT}) EXCEPT ALL ({_SENT})) GROUP BY ALL
""")
def _(t):
    got = t.fx_outbox.where("aggregate_id % 17 <> 0").unionByName(t.fx_outbox.where("aggregate_id % 19 = 0"))
    return H.event_loss(t.fx_outbox, got, ["aggregate_id", "transition", "event_type"])


@query("unchanged_streaks", """
WITH d AS (SELECT *, contract_id % 7 <> 0 AS same FROM fx_contracts WHERE finalized_at IS NOT NULL),
g AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY job_id ORDER BY finalized_at, contract_id)
              - ROW_NUMBER() OVER (PARTITION BY job_id, same ORDER BY finalized_at, contract_id) AS grp FROM d)
SELECT job_id, COUNT(*) AS streak, MIN(finalized_at) AS streak_from, MAX(finalized_at) AS streak_to FROM g WHERE same GROUP BY job_id, grp HAVING COUNT(*) >= 5
""")
def _(t):
    return H.unchanged_streaks(t.fx_contracts.withColumn("target_unchanged", F.expr("contract_id % 7 <> 0")), 5)


@query("guard_summary", """
SELECT source_id, result, COUNT(*) AS calls, round(COUNT(*) / SUM(COUNT(*)) OVER (PARTITION BY source_id), 6) AS share FROM fx_guard GROUP BY source_id, result
""")
def _(t):
    return H.guard_summary(t.fx_guard)


@query("slo_percentiles", f"""
SELECT band, quantile_cont({_SECS('t0', 't4')}, 0.5) AS p50, quantile_cont({_SECS('t0', 't4')}, 0.95) AS p95, quantile_cont({_SECS('t0', 't4')}, 0.99) AS p99
FROM fx_timeline GROUP BY band
""")
def _(t):
    return H.slo_percentiles(t.fx_timeline.select("band", H.seconds_between("t0", "t4").alias("s")), ["band"], "s")


@query("keyset_page", """
WITH f AS (SELECT contract_id, job_id, created_at, state FROM fx_contracts WHERE state NOT LIKE 'FINALIZED%'
  AND (created_at, contract_id) > (TIMESTAMP '1997-03-01', 5000)),
n AS (SELECT *, ROW_NUMBER() OVER (ORDER BY created_at, contract_id) AS rn FROM f)
SELECT contract_id, job_id, created_at, state, (SELECT COUNT(*) > 50 FROM f) AS has_more FROM n WHERE rn <= 50
""")
def _(t):
    rows = t.fx_contracts.select("contract_id", "job_id", "created_at", "state")
    return G.keyset_page(rows, "created_at", "contract_id", (datetime(1997, 3, 1), 5000), 50, "state NOT LIKE 'FINALIZED%'")


@query("awaiting_human", """
WITH f AS (SELECT * FROM fx_contracts WHERE state IN ('ADJUDICATION_PENDING', 'DQ_FAILED', 'RECONCILIATION_REQUIRED', 'EMPTY_FULL'))
SELECT contract_id, job_id, state, created_at, (SELECT COUNT(*) FROM f) AS awaiting_total, FALSE AS overflow FROM f
""")
def _(t):
    return G.awaiting(t.fx_contracts)


@query("view_source_list", """
SELECT source_id, COUNT(*) AS job_count, round(SUM(duration_s * connections / (period_hours * 3600.0)) / MIN(pool_cap), 9) AS rho,
  CASE WHEN SUM(duration_s * connections / (period_hours * 3600.0)) / MIN(pool_cap) > 1 THEN 'REJECT'
       WHEN SUM(duration_s * connections / (period_hours * 3600.0)) / MIN(pool_cap) > 0.7 THEN 'WARN' ELSE 'OK' END AS capacity_gate,
  (SELECT COUNT(*) FROM fx_holds h WHERE scope_kind = 'SOURCE' AND scope_key = CAST(source_id AS VARCHAR)
     AND starts_at <= TIMESTAMP '2024-02-05' AND COALESCE(ends_at > TIMESTAMP '2024-02-05', TRUE)) AS open_holds
FROM fx_jobs JOIN fx_sources USING (source_id) GROUP BY source_id
""")
def _(t):
    return G.source_list(t.fx_sources, t.fx_jobs, t.fx_holds, datetime(2024, 2, 5))


@query("view_job_list", f"""
SELECT f.*, (SELECT arg_max(release_id, (effective_from, release_id)) FROM fx_job_releases r WHERE r.job_id = f.job_id AND status = 'ACTIVE') AS active_release,
  (SELECT arg_max(state, (created_at, contract_id)) FROM fx_contracts c WHERE c.job_id = f.job_id) AS last_state
FROM ({_FACTS}) f
""")
def _(t):
    return G.job_list(_terms(t), t.fx_job_releases, t.fx_contracts, _reconciles(t))


@query("view_contract_detail", """
SELECT c.contract_id, c.job_id, c.state, COALESCE(h.n, 0) AS transitions, h.m AS last_transition_at, COALESCE(g.n, 0) AS guard_calls, COALESCE(g.r, 0) AS guard_rejections
FROM fx_contracts c LEFT JOIN (SELECT contract_id, COUNT(*) AS n, MAX("at") AS m FROM fx_transitions GROUP BY 1) h ON c.contract_id = h.contract_id
LEFT JOIN (SELECT contract_id, COUNT(*) AS n, COUNT(*) FILTER (result <> 'OK') AS r FROM fx_guard GROUP BY 1) g ON c.contract_id = g.contract_id
""")
def _(t):
    return G.contract_detail(t.fx_contracts, t.fx_transitions, t.fx_guard)


@query("view_evidence", """
SELECT l.job_id, COUNT(*) AS ledger_rows, COUNT(*) FILTER (cas_applied) AS applied_rows, MAX(window_high) FILTER (cas_applied) AS current_watermark,
  (SELECT COUNT(*) FROM (SELECT lease_id FROM fx_lease_log x WHERE x.job_id = l.job_id GROUP BY lease_id HAVING NOT bool_or(to_state = 'RELEASED'))) AS open_leases
FROM fx_ledger l GROUP BY l.job_id
""")
def _(t):
    return G.evidence_view(t.fx_ledger, t.fx_lease_log)


@query("view_release_usage", f"""
SELECT release_id, COUNT(DISTINCT job_id) AS job_count, COUNT(*) AS occurrence_count FROM ({_ASOF}) WHERE release_id IS NOT NULL GROUP BY release_id
""")
def _(t):
    return G.release_usage(_pinned(t))


@query("spec_violations", """
WITH c AS (SELECT o_custkey AS job_id, COUNT(*) AS n, COUNT(*) FILTER (o_orderkey % 300 = 0) AS lg FROM orders GROUP BY 1),
x AS (SELECT j.*, s.bound_kind, s.zero_gap_verified, s.max_commit_delay_s + s.safety_lag_s + s.clock_skew_s AS need, c.lg FROM fx_jobs j LEFT JOIN fx_sources s USING (source_id) LEFT JOIN c USING (job_id))
SELECT job_id, 'OVERLAP_BELOW_MINIMUM' AS rule, CASE WHEN grade = 'ZERO_GAP' THEN 'ERROR' ELSE 'WARNING' END AS severity FROM x WHERE overlap_s < need
UNION ALL SELECT job_id, 'ZERO_GAP_REQUIRES_ENFORCED_BOUND', 'ERROR' FROM x WHERE grade = 'ZERO_GAP' AND bound_kind <> 'ENFORCED'
UNION ALL SELECT job_id, 'ZERO_GAP_REQUIRES_VERIFIED_SOURCE', 'ERROR' FROM x WHERE grade = 'ZERO_GAP' AND NOT zero_gap_verified
UNION ALL SELECT job_id, 'ZERO_GAP_REQUIRES_DELETE_MODE', 'ERROR' FROM x WHERE grade = 'ZERO_GAP' AND delete_semantics IN ('NONE_DECLARED', 'CDC_LATER')
UNION ALL SELECT job_id, 'APPEND_REQUIRES_PARTITION_WATERMARK', 'ERROR' FROM x WHERE load_mode = 'APPEND' AND job_id % 4 <> 1
UNION ALL SELECT job_id, 'LONG_NOT_EXTRACTABLE', 'ERROR' FROM x WHERE lg > 0
""")
def _(t):
    columns = t.orders.selectExpr("o_custkey AS job_id", "CASE WHEN o_orderkey % 300 = 0 THEN 'LONG' ELSE 'VARCHAR2' END AS data_type")
    jobs = t.fx_jobs.withColumn("watermark_is_partition", F.expr("job_id % 4 = 1"))
    return G.spec_violations(jobs, t.fx_sources, columns)


@query("golden_jobs", """
SELECT o_custkey AS job_id, COUNT(*) AS runs, COUNT(*) FILTER (o_orderkey % 13 = 0) / COUNT(*) AS failure_rate, COUNT(*) FILTER (o_orderkey % 17 = 0) / COUNT(*) AS dq_rate,
  MAX((o_orderkey % 100) / 100.0) AS peak_share FROM orders GROUP BY o_custkey
HAVING COUNT(*) >= 5 AND COUNT(*) FILTER (o_orderkey % 13 = 0) / COUNT(*) <= 0.1 AND COUNT(*) FILTER (o_orderkey % 17 = 0) / COUNT(*) <= 0.05 AND MAX((o_orderkey % 100) / 100.0) <= 0.95
""")
def _(t):
    history = t.orders.selectExpr(
        "o_custkey AS job_id", "o_orderkey % 13 = 0 AS failed", "o_orderkey % 17 = 0 AS dq_failed",
        "CAST((o_orderkey % 100) / 100.0D AS DOUBLE) AS source_share")
    return G.golden_jobs(history, 5, 0.1, 0.05, 0.95)


RANKS = {"hash_function": ["SHA256", "UNDETERMINED", "NONE"], "lag_admission": ["MAX_DELAY_ENFORCED", "UNDETERMINED", "NONE"]}


@query("affected_jobs", """
SELECT o.o_orderkey AS job_id, a.source_id, a.axis, a.value AS old_value, b.value AS new_value,
  CASE WHEN o.o_orderkey % 4 = 0 THEN 'ZERO_GAP' ELSE 'BEST_EFFORT' END AS declared_grade, 'BEST_EFFORT' AS displayed_grade
FROM fx_axis_values a JOIN fx_axis_remeasured b USING (source_id, axis) JOIN orders o ON o.o_custkey = a.source_id
WHERE b.value = 'NONE' AND a.value <> 'NONE' AND o.o_orderkey % 3 <> 0
""")
def _(t):
    jobs = t.orders.selectExpr(
        "o_orderkey AS job_id", "o_custkey AS source_id", "CASE WHEN o_orderkey % 4 = 0 THEN 'ZERO_GAP' ELSE 'BEST_EFFORT' END AS grade",
        "o_orderkey % 3 <> 0 AS is_active")
    return G.affected_jobs(t.fx_axis_values, t.fx_axis_remeasured, jobs, RANKS)


@query("outcome_rates", """
SELECT 'v' || CAST(user_id % 9 AS VARCHAR) AS rule_version, COUNT(*) AS recommendations, COUNT(*) FILTER (event_type = 'purchase') / COUNT(*) AS applied_rate,
  COUNT(*) FILTER (event_type = 'click') / COUNT(*) AS edited_rate, COUNT(*) FILTER (event_type = 'error') / COUNT(*) AS rejected_rate,
  COUNT(*) FILTER (event_type IN ('view', 'signup')) / COUNT(*) AS not_applied_rate, COUNT(*) FILTER (event_id % 31 = 0) / COUNT(*) AS unsafe_rate
FROM events GROUP BY 1
""")
def _(t):
    recs = t.events.selectExpr(
        "concat('v', user_id % 9) AS rule_version",
        "CASE event_type WHEN 'purchase' THEN 'APPLIED' WHEN 'click' THEN 'EDITED' WHEN 'error' THEN 'REJECTED' ELSE 'NOT_APPLIED' END AS outcome",
        "event_id % 31 = 0 AS is_unsafe")
    return G.outcome_rates(recs)


@query("session_accounting", """
WITH ch AS (SELECT source_id, "at", SUM(d) AS d FROM (SELECT source_id, granted_at AS "at", tokens AS d FROM fx_bookings
   UNION ALL SELECT source_id, returned_at, -tokens FROM fx_bookings WHERE returned_at IS NOT NULL) GROUP BY 1, 2),
lv AS (SELECT source_id, "at", SUM(d) OVER (PARTITION BY source_id ORDER BY "at") AS booked, LEAD("at") OVER (PARTITION BY source_id ORDER BY "at") AS nx FROM ch),
fst AS (SELECT source_id, MIN("at") AS f FROM ch GROUP BY 1),
x AS (SELECT s.*, COALESCE(l.booked, 0) AS booked, l."at" AS pv, CASE WHEN l."at" IS NULL THEN fst.f ELSE l.nx END AS nx
  FROM fx_samples s ASOF LEFT JOIN lv l ON s.source_id = l.source_id AND s."at" >= l."at" LEFT JOIN fst ON fst.source_id = s.source_id)
SELECT source_id, sample_id, "at", observed, CAST(booked AS BIGINT) AS booked, CAST(observed - booked AS BIGINT) AS difference FROM x
WHERE observed <> booked AND NOT COALESCE("at" - pv <= INTERVAL 5 SECOND, FALSE) AND NOT COALESCE(nx - "at" <= INTERVAL 5 SECOND, FALSE)
""")
def _(t):
    return H.accounting_diff(t.fx_samples, t.fx_bookings, timedelta(seconds=5))


@query("local_time_labels", """
WITH z AS (SELECT e.event_id, e.ts, j.timezone, ((e.ts AT TIME ZONE 'UTC') AT TIME ZONE j.timezone) AS l FROM events e JOIN fx_jobs j ON e.user_id = j.job_id),
o AS (SELECT *, date_diff('minute', ts, l) AS off FROM z)
SELECT event_id, strftime(l, '%Y-%m-%d %H:%M:%S.%f') || ' ' || timezone || '(' || CASE WHEN off < 0 THEN '-' ELSE '+' END || printf('%02d', CAST(abs(off) // 60 AS INTEGER)) || ':' || printf('%02d', CAST(abs(off) % 60 AS INTEGER)) || ')' AS local_time FROM o
""")
def _(t):
    rows = t.events.join(t.fx_jobs.select("job_id", "timezone"), F.expr("user_id = job_id"))
    return G.with_local_time(rows, "ts", "timezone").select("event_id", "local_time")
