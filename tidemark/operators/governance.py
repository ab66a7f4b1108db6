"""Job and source facts: releases, holds, capacity, derived contract terms, rules and operator views."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.history import seconds_between, to_local
from tidemark.operators.ordered import Bins, asof_join
from tidemark.operators.windows import as_col

# Hold modes in rising order of force.
HOLD_MODES = ("HOLD_NEW", "DRAIN", "FORCE_STOP")
HUMAN_STATES = ("ADJUDICATION_PENDING", "DQ_FAILED", "RECONCILIATION_REQUIRED", "EMPTY_FULL")


def asof_release(occ: DataFrame, releases: DataFrame, statuses: Sequence[str] = ("ACTIVE",),
                 bins: Bins = None) -> DataFrame:
    """Release in force at each occurrence's logical time.

    ``occ``: job_id, logical_at. ``releases``: job_id, release_id, effective_from, status.
    """
    live = releases.where(F.col("status").isin(*statuses)).groupBy("job_id", "effective_from").agg(
        F.max("release_id").alias("release_id"))
    return asof_join(occ, live, ["job_id"], "logical_at", "effective_from", ["release_id", "effective_from"], bins)


def open_holds(holds: DataFrame, at) -> DataFrame:
    """Holds in force at ``at``, with their mode's rank."""
    t = as_col(at)
    rank = F.array_position(F.array(*[F.lit(m) for m in HOLD_MODES]), F.col("mode"))
    return holds.where((F.col("starts_at") <= t) & (F.col("ends_at").isNull() | (F.col("ends_at") > t))).withColumn(
        "mode_rank", rank)


_SCOPES = (("GLOBAL", None), ("SOURCE", "_s"), ("DOMAIN", "_d"), ("JOB", "_j"))


def _scoped_holds(holds: DataFrame, jobs: DataFrame, at) -> DataFrame:
    """Jobs with the folded holds (_rank, _n, _first) of each of their four scopes as _h0 to _h3, NULL without any."""
    folded = open_holds(holds, at).groupBy("scope_kind", "scope_key").agg(
        F.max("mode_rank").alias("_rank"), F.count(F.lit(1)).alias("_n"),
        F.min(F.struct("starts_at", "hold_id")).alias("_first"))
    fact = F.struct("_rank", "_n", "_first")
    everyone = folded.where(F.col("scope_kind") == "GLOBAL").select(fact).scalar()
    joined = jobs.select("job_id", F.col("source_id").cast("string").alias("_s"), F.col("domain").alias("_d"),
                         F.col("job_id").cast("string").alias("_j"), everyone.alias("_h0"))
    for i, (kind, col) in enumerate(_SCOPES[1:], start=1):
        part = folded.where(F.col("scope_kind") == kind).select(F.col("scope_key").alias(col), fact.alias(f"_h{i}"))
        joined = joined.join(part, col, "left")
    return joined


def _mode(rank: Column) -> Column:
    return F.element_at(F.array(*[F.lit(m) for m in HOLD_MODES]), rank.cast("int"))


def effective_holds(holds: DataFrame, jobs: DataFrame, at) -> DataFrame:
    """Held jobs with the strongest mode, the number of holds behind it and the oldest of them.

    ``holds``: hold_id, scope_kind (GLOBAL, SOURCE, DOMAIN, JOB), scope_key, mode, starts_at, ends_at.
    ``jobs``: job_id, source_id, domain. Holds are first folded to one row per scope, so a job meets
    at most four rows however many holds overlap. :func:`hold_causes` lists those scopes.
    """
    joined = _scoped_holds(holds, jobs, at)
    hs = [F.col(f"_h{i}") for i in range(4)]
    top = F.greatest(*[h["_rank"] for h in hs])
    total = sum((F.coalesce(h["_n"], F.lit(0)) for h in hs), F.lit(0))
    return joined.where(top.isNotNull()).select(
        "job_id", _mode(top).alias("effective_mode"),
        total.cast("bigint").alias("hold_count"), F.least(*[h["_first"] for h in hs])["hold_id"].alias("first_hold_id"))


def hold_causes(holds: DataFrame, jobs: DataFrame, at) -> DataFrame:
    """The scopes that hold a job: at most four rows per job, each with its strongest mode, count and oldest hold.

    The holds of a scope are the rows of :func:`open_holds` with that scope_kind and scope_key.
    """
    joined = _scoped_holds(holds, jobs, at)
    causes = F.array_compact(F.array(*[
        F.when(F.col(f"_h{i}").isNotNull(), F.struct(
            F.lit(kind).alias("scope_kind"), (F.lit("*") if col is None else F.col(col)).alias("scope_key"),
            _mode(F.col(f"_h{i}")["_rank"]).alias("mode"), F.col(f"_h{i}")["_n"].alias("hold_count"),
            F.col(f"_h{i}")["_first"]["hold_id"].alias("first_hold_id")))
        for i, (kind, col) in enumerate(_SCOPES)]))
    return joined.select("job_id", F.explode(causes).alias("_x")).select("job_id", "_x.*")


def utilisation(jobs: DataFrame, sources: DataFrame) -> DataFrame:
    """Source load: sum of duration x connections / period over the allowed concurrency.

    A source that is not registered has no known concurrency: its gate is UNKNOWN.
    """
    share = F.col("duration_s") * F.col("connections") / (F.col("period_hours") * 3600)
    load = jobs.groupBy("source_id").agg(
        F.sum(share.cast("decimal(30,15)")).cast("double").alias("_load"), F.count(F.lit(1)).alias("job_count"))
    rho = F.col("_load") / F.col("pool_cap")
    return load.join(sources.select("source_id", "pool_cap"), "source_id", "left").select(
        "source_id", "job_count", F.round(rho, 9).alias("rho"),
        F.when(rho.isNull(), "UNKNOWN").when(rho > 1.0, "REJECT").when(rho > 0.7, "WARN").otherwise("OK").alias("capacity_gate"))


def catchup_estimate(impacted: DataFrame, sources: DataFrame) -> DataFrame:
    """Seconds each source needs to catch up, and whether some run would expire before that."""
    per = impacted.groupBy("source_id").agg(
        F.sum(F.col("duration_s") * F.col("connections")).alias("_work"),
        F.min(F.col("period_hours") * 3600).cast("bigint").alias("min_period_s"),
        F.count(F.lit(1)).alias("impacted_jobs"))
    est = per.join(sources.select("source_id", "pool_cap"), "source_id").withColumn(
        "estimated_s", F.col("_work") / F.col("pool_cap"))
    return est.select(
        "source_id", "impacted_jobs", "estimated_s", "min_period_s",
        (F.col("estimated_s") > F.col("min_period_s")).alias("expires_before_completion"))


def publication_age(ledger: DataFrame, contracts: DataFrame, now) -> DataFrame:
    """Per job: seconds since the target last got a snapshot, and the covered watermark.

    A full load has no compare-and-set time, so its contract's finish counts.
    """
    done = contracts.select("contract_id", "finalized_at")
    rows = ledger.join(done, "contract_id", "left")
    shown = F.when(
        F.col("committed_snapshot_id").isNotNull(),
        F.coalesce(F.when(F.col("cas_applied"), F.col("cas_at")), F.col("finalized_at")))
    per_job = rows.groupBy("job_id").agg(
        F.max(shown).alias("published_at"),
        F.max(F.when(F.col("cas_applied"), F.col("window_high"))).alias("coverage"))
    return per_job.withColumn("publication_age_s", seconds_between(F.col("published_at"), as_col(now)))


def contract_facts(jobs: DataFrame, reconciles: DataFrame) -> DataFrame:
    """Derived contract terms of each job.

    ``reconciles``: table_id, finalized_at of key-reconcile runs. ``jobs`` may carry
    ``reconcile_interval_s`` and ``reconcile_slo_s``.
    """
    kind = F.col("delete_semantics")
    last = reconciles.groupBy("table_id").agg(F.max("finalized_at").alias("last_reconcile_at"))
    return jobs.join(last, "table_id", "left").select(
        "job_id", F.col("grade").alias("upsert_consistency"),
        F.when(kind == "SOFT_DELETE", "SYNC").when(kind == "PK_RECONCILE", "BOUNDED_LAG").otherwise("NONE")
        .alias("delete_consistency"),
        F.when(kind == "SOFT_DELETE", F.lit(0)).when(
            kind == "PK_RECONCILE", F.col("reconcile_interval_s") + F.col("reconcile_slo_s"))
        .cast("bigint").alias("delete_lag_slo_s"),
        "last_reconcile_at")


def keyset_page(df: DataFrame, at: str, ident: str, after: tuple | None, limit: int, where: str | None = None) -> DataFrame:
    """One page ordered by (time, id) after a cursor, with ``has_more`` in place of a total.

    The page is a top-k of at most ``limit`` + 1 rows; only those are numbered.
    """
    rows = df.where(where) if where else df
    if after is not None:
        t, i = as_col(after[0]), F.lit(after[1])
        rows = rows.where((F.col(at) >= t) & ((F.col(at) > t) | (F.col(ident) > i)))
    page = rows.orderBy(at, ident).limit(limit + 1)
    packed = page.agg(F.array_sort(F.collect_list(F.struct(F.col(at), F.col(ident), F.struct(*df.columns).alias("_row")))).alias("_p"))
    shown = F.slice("_p", 1, limit)
    return packed.select(F.explode(shown).alias("_x"), (F.size("_p") > limit).alias("has_more")).select(
        "_x._row.*", "has_more")


def awaiting(contracts: DataFrame, cap: int | None = None) -> DataFrame:
    """Contracts that need a person, oldest first; with ``cap`` only the first ones, and ``overflow`` warns of more."""
    need = contracts.where(F.col("state").isin(*HUMAN_STATES))
    total = need.agg(F.count(F.lit(1))).scalar()
    listed = need.orderBy("created_at", "contract_id")
    return (listed if cap is None else listed.limit(cap)).select(
        "contract_id", "job_id", "state", "created_at", total.alias("awaiting_total"),
        (F.lit(False) if cap is None else total > cap).alias("overflow"))


def spec_violations(jobs: DataFrame, sources: DataFrame, columns: DataFrame) -> DataFrame:
    """Rules a job definition breaks, one row each with its severity.

    ``columns``: job_id, data_type. ``jobs`` carries watermark_is_partition next to the usual columns.
    """
    facts = columns.groupBy("job_id").agg(
        F.count(F.lit(1)).alias("_cols"), F.count_if(F.col("data_type").isin("LONG", "LONG RAW")).alias("_long"))
    zero = F.col("grade") == "ZERO_GAP"
    need = F.col("max_commit_delay_s") + F.col("safety_lag_s") + F.col("clock_skew_s")
    rule = lambda cond, name, level="ERROR": F.when(
        cond, F.struct(F.lit(name).alias("rule"), F.lit(level).alias("severity")))
    broken = F.array_compact(F.array(
        rule(zero & (F.col("overlap_s") < need), "OVERLAP_BELOW_MINIMUM"),
        rule(~zero & (F.col("overlap_s") < need), "OVERLAP_BELOW_MINIMUM", "WARNING"),
        rule(zero & (F.col("bound_kind") != "ENFORCED"), "ZERO_GAP_REQUIRES_ENFORCED_BOUND"),
        rule(zero & ~F.col("zero_gap_verified"), "ZERO_GAP_REQUIRES_VERIFIED_SOURCE"),
        rule(zero & F.col("delete_semantics").isin("NONE_DECLARED", "CDC_LATER"), "ZERO_GAP_REQUIRES_DELETE_MODE"),
        rule((F.col("load_mode") == "APPEND") & ~F.col("watermark_is_partition"), "APPEND_REQUIRES_PARTITION_WATERMARK"),
        rule(F.col("period_hours") < 1, "PERIOD_BELOW_ONE_HOUR"),
        rule(F.col("_cols") > 1024, "TOO_MANY_COLUMNS"),
        rule(F.col("_long") > 0, "LONG_NOT_EXTRACTABLE")))
    return (
        jobs.join(sources, "source_id", "left").join(facts, "job_id", "left")
        .select("job_id", F.explode(broken).alias("_v")).select("job_id", "_v.*"))


def golden_jobs(history: DataFrame, min_runs: int, max_failure: float, max_dq: float, max_load: float) -> DataFrame:
    """Jobs fit as examples: enough runs, few failures and quality problems, light on the source.

    ``history``: job_id, failed, dq_failed, source_share.
    """
    per = history.groupBy("job_id").agg(
        F.count(F.lit(1)).alias("runs"), F.count_if("failed").alias("_f"), F.count_if("dq_failed").alias("_q"),
        F.max("source_share").alias("peak_share"))
    rated = per.select(
        "job_id", "runs", (F.col("_f") / F.col("runs")).alias("failure_rate"),
        (F.col("_q") / F.col("runs")).alias("dq_rate"), "peak_share")
    return rated.where(
        (F.col("runs") >= min_runs) & (F.col("failure_rate") <= max_failure)
        & (F.col("dq_rate") <= max_dq) & (F.col("peak_share") <= max_load))


def affected_jobs(axes_old: DataFrame, axes_new: DataFrame, jobs: DataFrame, ranks: dict[str, Sequence[str]]) -> DataFrame:
    """Active jobs of sources whose capability went down.

    ``ranks`` lists each axis's values from strongest to weakest. A rise is not applied on its own.
    """
    order = F.create_map(*[
        x for axis, values in ranks.items() for i, v in enumerate(values) for x in (F.lit(f"{axis}={v}"), F.lit(i))])
    rank = lambda v: F.element_at(order, F.concat_ws("=", "axis", F.col(v)))
    moved = axes_old.select("source_id", "axis", F.col("value").alias("old_value")).join(
        axes_new.select("source_id", "axis", F.col("value").alias("new_value")), ["source_id", "axis"])
    down = moved.where(rank("new_value") > rank("old_value"))
    active = jobs.where("is_active").select("job_id", "source_id", "grade")
    return down.join(active, "source_id").select(
        "job_id", "source_id", "axis", "old_value", "new_value", F.col("grade").alias("declared_grade"),
        F.lit("BEST_EFFORT").alias("displayed_grade"))


def outcome_rates(recs: DataFrame) -> DataFrame:
    """Shares of applied, edited, rejected and ignored recommendations per rule version."""
    n = F.count(F.lit(1))
    share = lambda o: (F.count_if(F.col("outcome") == o) / n).alias(f"{o.lower()}_rate")
    return recs.groupBy("rule_version").agg(
        n.alias("recommendations"), share("APPLIED"), share("EDITED"), share("REJECTED"), share("NOT_APPLIED"),
        (F.count_if("is_unsafe") / n).alias("unsafe_rate"))


def with_local_time(df: DataFrame, ts: str, zone: str) -> DataFrame:
    """Add ``local_time``: the zone's wall clock with microseconds and its offset. Sort by ``ts`` instead."""
    local = to_local(F.col(ts), F.col(zone))
    off = ((F.unix_micros(local.cast("timestamp")) - F.unix_micros(F.col(ts).cast("timestamp"))) / F.lit(60_000_000)).cast("int")
    label = F.concat(
        F.when(off < 0, "-").otherwise("+"), F.lpad((F.abs(off) / F.lit(60)).cast("int").cast("string"), 2, "0"),
        F.lit(":"), F.lpad((F.abs(off) % F.lit(60)).cast("string"), 2, "0"))
    return df.withColumn(
        "local_time", F.concat(F.date_format(local, "yyyy-MM-dd HH:mm:ss.SSSSSS"), F.lit(" "), F.col(zone), F.lit("("), label, F.lit(")")))


def source_list(sources: DataFrame, jobs: DataFrame, holds: DataFrame, at) -> DataFrame:
    """Sources with utilisation and the number of open holds on them."""
    t = as_col(at)
    open_ = holds.where(
        (F.col("scope_kind") == "SOURCE") & (F.col("starts_at") <= t)
        & (F.col("ends_at").isNull() | (F.col("ends_at") > t)))
    counts = open_.groupBy(F.col("scope_key").cast("int").alias("source_id")).agg(F.count(F.lit(1)).alias("_n"))
    return utilisation(jobs, sources).join(counts, "source_id", "left").select(
        "source_id", "job_count", "rho", "capacity_gate", F.coalesce("_n", F.lit(0)).cast("bigint").alias("open_holds"))


def job_list(jobs: DataFrame, releases: DataFrame, contracts: DataFrame, reconciles: DataFrame) -> DataFrame:
    """Jobs with active release, derived terms and the state of their newest contract."""
    active = releases.where(F.col("status") == "ACTIVE").groupBy("job_id").agg(
        F.max_by("release_id", F.struct("effective_from", "release_id")).alias("active_release"))
    newest = contracts.groupBy("job_id").agg(
        F.max_by("state", F.struct("created_at", "contract_id")).alias("last_state"))
    return contract_facts(jobs, reconciles).join(active, "job_id", "left").join(newest, "job_id", "left")


def contract_detail(contracts: DataFrame, history: DataFrame, guard: DataFrame) -> DataFrame:
    """One row per contract: state, number of transitions, guard calls and rejections."""
    h = history.groupBy("contract_id").agg(F.count(F.lit(1)).alias("transitions"), F.max("at").alias("last_transition_at"))
    g = guard.groupBy("contract_id").agg(
        F.count(F.lit(1)).alias("guard_calls"), F.count_if(F.col("result") != "OK").alias("guard_rejections"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    return contracts.join(h, "contract_id", "left").join(g, "contract_id", "left").select(
        "contract_id", "job_id", "state", zero("transitions"), "last_transition_at", zero("guard_calls"), zero("guard_rejections"))


def evidence_view(ledger: DataFrame, leases: DataFrame) -> DataFrame:
    """Per job: ledger rows, applied watermark and leases not yet released.

    ``leases``: job_id, lease_id, to_state.
    """
    rows = ledger.groupBy("job_id").agg(
        F.count(F.lit(1)).alias("ledger_rows"), F.count_if("cas_applied").alias("applied_rows"),
        F.max(F.when(F.col("cas_applied"), F.col("window_high"))).alias("current_watermark"))
    per_lease = leases.groupBy("job_id", "lease_id").agg(F.bool_or(F.col("to_state") == "RELEASED").alias("_done"))
    open_ = per_lease.groupBy("job_id").agg(F.count_if(~F.col("_done")).alias("open_leases"))
    return rows.join(open_, "job_id", "left").withColumn(
        "open_leases", F.coalesce("open_leases", F.lit(0)).cast("bigint"))


def release_usage(pinned: DataFrame) -> DataFrame:
    """How many occurrences and jobs a release serves: the reach of a rollback.

    ``pinned``: release_id, job_id per occurrence. Jobs are counted after folding to (release, job).
    """
    folded = pinned.where(F.col("release_id").isNotNull()).groupBy("release_id", "job_id").agg(F.count(F.lit(1)).alias("_n"))
    return folded.groupBy("release_id").agg(
        F.count(F.lit(1)).alias("job_count"), F.sum("_n").cast("bigint").alias("occurrence_count"))
