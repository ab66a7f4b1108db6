"""Run history: expected and actual runs, lateness, state intervals, concurrency, leases."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.evidence import overlap_counts_per_window
from tidemark.operators.ordered import BIN, Bins, next_values, previous_values, running, with_bins
from tidemark.operators.quantiles import exact_percentiles
from tidemark.operators.windows import as_col

# Rejections that protect the source, and outcomes that end without a finish time.
PROTECTIVE = ("LEASE_BUSY", "SOURCE_LAG_EXCEEDED", "FENCE_UNAVAILABLE")
SCHEDULED_CLASSES = ("NORMAL", "CATCHUP")
EXPLAINED_SKIPS = ("SKIPPED_BY_HOLD", "SUPERSEDED_BY")
FINISHED = ("FINALIZED", "FINALIZED_NO_DATA", "RESOLVED")


def seconds_between(start: Column | str, end: Column | str) -> Column:
    """Elapsed seconds of two timestamps, with microsecond fraction."""
    a = F.col(start) if isinstance(start, str) else start
    b = F.col(end) if isinstance(end, str) else end
    return (F.unix_micros(b.cast("timestamp")) - F.unix_micros(a.cast("timestamp"))) / F.lit(1_000_000.0)


def to_utc(local: Column, zone: Column) -> Column:
    """UTC wall clock of a local wall clock in ``zone``."""
    return F.to_utc_timestamp(local.cast("timestamp"), zone).cast("timestamp_ntz")


def to_local(utc: Column, zone: Column) -> Column:
    """Local wall clock in ``zone`` of a UTC wall clock."""
    return F.from_utc_timestamp(utc.cast("timestamp"), zone).cast("timestamp_ntz")


def instants_of(local: Column, zone: Column) -> Column:
    """UTC instants (array) whose wall clock in ``zone`` is ``local``: none where a clock change skips it, two where one repeats it.

    The offsets a day before and a day after are the only ones it can have.
    """
    near = to_utc(local, zone)
    beside = [near + F.expr(f"INTERVAL {days} DAY") for days in (-1, 1)]
    tried = F.array_distinct(F.array(*(local - (to_local(at, zone) - at) for at in beside)))
    return F.filter(tried, lambda at: to_local(at, zone) == local)


def _due(kinds: DataFrame, jobs: DataFrame, by: Sequence[str], start, end, date_fits: Callable[[Column], Column], hours: Column, minutes: Column) -> DataFrame:
    """``jobs`` with ``logical_at``: fitting local dates times hours times minutes, as UTC instants in ``[start, end)``.

    Each distinct schedule (``by``) makes one row per fitting date with the instants of that date, at most a day's minutes;
    its jobs only receive them. Nothing but due instants is generated.
    """
    lo, hi, zone = as_col(start), as_col(end), F.col("timezone")
    day = lambda at, by: F.date_add(to_local(at, zone).cast("date"), by)
    days = F.filter(F.sequence(day(lo, -1), day(hi, 1)), date_fits)
    kinds = kinds.select(*by, hours.alias("_hours"), minutes.alias("_minutes"), F.explode(days).alias("_day"))
    local = lambda h, m: F.col("_day").cast("timestamp_ntz") + F.make_dt_interval(hours=h, mins=m)
    times = F.flatten(F.transform("_hours", lambda h: F.flatten(F.transform("_minutes", lambda m: instants_of(local(h, m), zone)))))
    kinds = kinds.select(*by, F.filter(times, lambda at: (at >= lo) & (at < hi)).alias("_times")).where(F.size("_times") > 0)
    return jobs.join(kinds, list(by)).select(*jobs.columns, F.explode("_times").alias("logical_at"))


def expand_schedule(jobs: DataFrame, start, end) -> DataFrame:
    """UTC instants in ``[start, end)`` at which each job is due, every ``period_hours`` from local midnight.

    ``jobs``: job_id, period_hours (divides 24), timezone. A day of a clock change has 23 or 25 local hours.
    """
    hours = F.filter(F.sequence(F.lit(0), F.lit(23)), lambda h: h % F.col("period_hours") == 0)
    by = ["period_hours", "timezone"]
    return _due(jobs.select(*by).distinct(), jobs, by, start, end, lambda _: F.lit(True), hours, F.array(F.lit(0)))


def cron_field_matches(field: Column, value: Column, lowest: int) -> Column:
    """Does ``value`` satisfy a cron field made of ``*``, ``*/n``, ``a``, ``a-b``, ``a-b/n`` and lists?"""

    def one(part: Column) -> Column:
        span = F.split_part(part, F.lit("/"), F.lit(1))
        step = F.coalesce(F.nullif(F.split_part(part, F.lit("/"), F.lit(2)), F.lit("")).cast("int"), F.lit(1))
        any_ = span == "*"
        low = F.when(any_, F.lit(lowest)).otherwise(F.split_part(span, F.lit("-"), F.lit(1)).cast("int"))
        top = F.nullif(F.split_part(span, F.lit("-"), F.lit(2)), F.lit(""))
        high = F.when(any_, F.lit(99)).when(top.isNotNull(), top.cast("int")).otherwise(low)
        return (value >= low) & (value <= high) & ((value - low) % step == 0)

    return F.exists(F.split(field, ","), one)


def expand_cron(jobs: DataFrame, start, end) -> DataFrame:
    """Like :func:`expand_schedule` for five-field cron text in column ``cron`` (0 = Sunday).

    Each field becomes a list of allowed numbers. Day of month and day of week are alternatives when both are
    restricted, as in cron itself.
    """
    f = F.split("cron", r"\s+")

    def numbers(position: int, low: int, high: int) -> Column:
        return F.filter(
            F.sequence(F.lit(low), F.lit(high)), lambda n: cron_field_matches(f[position], n, low))

    def date_fits(day: Column) -> Column:
        dom, dow = cron_field_matches(f[2], F.dayofmonth(day), 1), cron_field_matches(f[4], F.dayofweek(day) - 1, 0)
        either = (f[2] != "*") & (f[4] != "*")
        return cron_field_matches(f[3], F.month(day), 1) & F.when(either, dom | dow).otherwise(dom & dow)

    by = ["cron", "timezone"]
    return _due(jobs.select(*by).distinct(), jobs, by, start, end, date_fits, numbers(1, 0, 23), numbers(0, 0, 59))


def occurrence_audit(expected: DataFrame, actual: DataFrame, rejected: DataFrame) -> DataFrame:
    """Exactly one occurrence per expected (job_id, logical_at)?

    OK, DUPLICATE, MISSING, EXPLAINED (a rejection event exists), or UNEXPECTED.
    """
    key = ["job_id", "logical_at"]
    counted = actual.groupBy(*key).agg(F.count(F.lit(1)).alias("occurrences"))
    e = expected.select(*key, F.lit(True).alias("_e")).dropDuplicates(key)
    r = rejected.select(*key, F.lit(True).alias("_r")).dropDuplicates(key)
    joined = e.join(counted, key, "full_outer").join(r, key, "left")
    state = (
        F.when(F.col("_e").isNull(), "UNEXPECTED")
        .when(F.col("occurrences") > 1, "DUPLICATE").when(F.col("occurrences") == 1, "OK")
        .when(F.col("_r").isNotNull(), "EXPLAINED").otherwise("MISSING"))
    return joined.select(
        *key, F.coalesce("occurrences", F.lit(0)).cast("bigint").alias("occurrences"), state.alias("audit_state"))


def rollup_missing(missing: DataFrame, schedules: DataFrame) -> DataFrame:
    """One event per tick that a whole schedule missed, one per job otherwise.

    ``missing``: job_id, logical_at. ``schedules``: job_id, schedule_name. A job without a schedule is
    reported on its own, under no schedule name.
    """
    members = schedules.groupBy("schedule_name").agg(F.count(F.lit(1)).alias("member_count"))
    named = missing.join(schedules, "job_id", "left")
    ticks = named.where("schedule_name IS NOT NULL").groupBy("schedule_name", "logical_at").agg(F.count(F.lit(1)).alias("job_count")).join(
        members, "schedule_name")
    whole = ticks.where(F.col("job_count") == F.col("member_count"))
    single = named.join(whole, ["schedule_name", "logical_at"], "left_anti")
    return whole.select(
        "schedule_name", "logical_at", F.lit(None).cast("bigint").alias("job_id"), "job_count",
        F.lit("SCHEDULE").alias("event_scope"),
    ).unionByName(single.select(
        "schedule_name", "logical_at", F.col("job_id").cast("bigint").alias("job_id"),
        F.lit(1).cast("bigint").alias("job_count"), F.lit("JOB").alias("event_scope")))


def lateness(occurrences: DataFrame, contracts: DataFrame) -> DataFrame:
    """Finish time and seconds of delay per scheduled occurrence.

    ``contract_id`` of a coalesced occurrence is the contract it was folded into. Holds and
    superseding releases explain themselves and are left out.
    """
    pop = occurrences.where(
        F.col("operation_class").isin(*SCHEDULED_CLASSES) & ~F.col("disposition").isin(*EXPLAINED_SKIPS))
    done = contracts.where(F.col("state").isin(*FINISHED)).select("contract_id", "finalized_at", "period_band")
    follows = F.col("disposition").isin("EXECUTED", "COALESCED_INTO")
    linked = pop.withColumn("_link", F.when(follows, F.col("contract_id")))
    joined = linked.join(done.withColumnRenamed("contract_id", "_link"), "_link", "left").drop("_link")
    return joined.withColumn("lateness_s", seconds_between("logical_at", "finalized_at"))


def freshness_breaches(late: DataFrame, jobs: DataFrame, now, default_slo_s: dict[int, int]) -> DataFrame:
    """Overdue unfinished and late finished occurrences; the job's SLO, else its period's default.

    An occurrence whose job is not registered, or has neither, cannot be judged and is UNKNOWN.
    """
    fallback = F.lit(None).cast("bigint")
    for period, slo in default_slo_s.items():
        fallback = F.when(F.col("period_hours") == period, F.lit(slo)).otherwise(fallback)
    slo = F.coalesce(F.col("freshness_slo_s"), fallback).cast("bigint")
    joined = late.join(jobs.select("job_id", "period_hours", "freshness_slo_s"), "job_id", "left").withColumn("slo_s", slo)
    overdue = F.col("finalized_at").isNull() & (
        seconds_between(F.col("logical_at"), as_col(now)) > F.col("slo_s"))
    kind = F.when(F.col("slo_s").isNull(), "UNKNOWN").when(overdue, "OVERDUE").when(F.col("lateness_s") > F.col("slo_s"), "LATE")
    return joined.withColumn("breach", kind).where(F.col("breach").isNotNull()).select(
        "occurrence_id", "job_id", "logical_at", "slo_s", "breach")


def lateness_phases(contracts: DataFrame) -> DataFrame:
    """Wait, load and finalize seconds per contract."""
    return contracts.select(
        "*",
        seconds_between("created_at", "first_guard_ok_at").alias("wait_s"),
        seconds_between("first_guard_ok_at", "last_cas_at").alias("load_s"),
        seconds_between("last_cas_at", "finalized_at").alias("finalize_s"))


def attempt_phases(timeline: DataFrame) -> DataFrame:
    """Platform, guard, submission and execution seconds of an attempt's points t0…t7."""
    return timeline.select(
        "*",
        seconds_between("t0", "t2").alias("platform_s"),
        seconds_between("t2", "t3").alias("guard_s"),
        seconds_between("t4", "t5").alias("submission_s"),
        seconds_between("t6", "t7").alias("execution_s"))


def protection_delay(guard: DataFrame) -> DataFrame:
    """Seconds each contract waited because a source was being protected."""
    held = guard.where(F.col("result").isin(*PROTECTIVE))
    wait = seconds_between("run_started_at", "at") + F.coalesce(seconds_between("at", "next_eligible_at"), F.lit(0.0))
    return held.groupBy("contract_id").agg(
        F.sum(wait.cast("decimal(20,6)")).cast("double").alias("protection_delay_s"),
        F.count(F.lit(1)).alias("rejections"))


def queue_to_launch(timeline: DataFrame, guard: DataFrame) -> DataFrame:
    """t0 to t4 without protection delay, for attempts the guard admitted."""
    admitted = guard.where(F.col("result") == "OK").select("contract_id").distinct()
    delay = protection_delay(guard)
    return (
        timeline.join(admitted, "contract_id", "left_semi").join(delay, "contract_id", "left")
        .withColumn("queue_to_launch_s", seconds_between("t0", "t4") - F.coalesce("protection_delay_s", F.lit(0.0))))


def real_transitions(history: DataFrame) -> DataFrame:
    """Transitions that bound an interval: rebinding (from = to) and reconstructed (from NULL) rows do not."""
    return history.where(F.col("from_state").isNotNull() & (F.col("from_state") != F.col("to_state")))


def state_intervals(history: DataFrame, keys: Sequence[str], at: str, tie: str,
                    bins: Bins = None) -> DataFrame:
    """``[at, until)`` per state; the last state of a key stays open (``until`` NULL)."""
    return next_values(real_transitions(history), keys, [at, tie], {"until": at}, bins)


def writer_overlaps(intervals: DataFrame, bins: Bins = None) -> DataFrame:
    """Writer intervals of one (job_id, lane) that start while an earlier one is still open.

    ``intervals``: job_id, lane, writer_id, started_at, ended_at (NULL while open).
    """
    return overlap_counts_per_window(intervals, ["job_id", "lane"], "started_at", "ended_at", "writer_id", bins)


def level_changes(intervals: DataFrame, keys: Sequence[str], start: str, end: str, weight: str) -> DataFrame:
    """Net change of the summed weight per key and instant (half-open intervals)."""
    up = intervals.select(*keys, F.col(start).alias("at"), F.col(weight).alias("_d"))
    down = intervals.where(F.col(end).isNotNull()).select(*keys, F.col(end).alias("at"), (-F.col(weight)).alias("_d"))
    return up.unionByName(down).groupBy(*keys, "at").agg(F.sum("_d").alias("delta"))


def peak_concurrency(intervals: DataFrame, caps: DataFrame, key: str, start: str, end: str, weight: str,
                     bins: Bins = None) -> DataFrame:
    """Highest summed weight per key, when it was first reached, and whether the cap was reached or passed."""
    levels = running(level_changes(intervals, [key], start, end, weight), [key], ["at"],
                     {"level": ("sum", "delta")}, bins)
    peaks = levels.groupBy(key).agg(
        F.max("level").cast("bigint").alias("peak"),
        F.max(F.struct(F.col("level"), -F.unix_micros(F.col("at").cast("timestamp")))).alias("_top"))
    first = F.timestamp_micros(-F.col("_top.col2")).cast("timestamp_ntz")
    return peaks.join(caps.select(key, "cap"), key, "left").select(
        key, "peak", first.alias("peak_at"), "cap",
        (F.col("peak") >= F.col("cap")).alias("cap_reached"), (F.col("peak") > F.col("cap")).alias("cap_exceeded"))


def early_regrants(leases: DataFrame, bins: Bins = None) -> DataFrame:
    """Leases granted on a resource before the previous one was released.

    ``leases``: resource_id, lease_id, to_state, at, seq (tie-break). Other states do not free it.
    """
    ends = leases.where(F.col("to_state").isin("GRANTED", "RELEASED"))
    seen = previous_values(
        ends, ["resource_id"], ["at", "seq"], {"previous_state": "to_state", "previous_lease": "lease_id"}, bins)
    return seen.where(
        (F.col("to_state") == "GRANTED") & (F.col("previous_state") == "GRANTED")
        & (F.col("previous_lease") != F.col("lease_id")))


def release_lag(leases: DataFrame) -> DataFrame:
    """Seconds from reclaiming to releasing a lease; NULL while it is not released."""
    at = lambda s: F.min(F.when(F.col("to_state") == s, F.col("at")))
    return leases.groupBy("lease_id").agg(at("RECLAIMED").alias("reclaimed_at"), at("RELEASED").alias("released_at")).where(
        F.col("reclaimed_at").isNotNull()).withColumn("release_lag_s", seconds_between("reclaimed_at", "released_at"))


def guard_summary(guard: DataFrame, by: Sequence[str] = ("source_id",)) -> DataFrame:
    """Guard calls per result, and their share within the group."""
    counts = guard.groupBy(*by, "result").agg(F.count(F.lit(1)).alias("calls"))
    totals = counts.groupBy(*by).agg(F.sum("calls").alias("_all"))
    return counts.join(totals, list(by)).select(
        *by, "result", "calls", F.round(F.col("calls") / F.col("_all"), 6).alias("share"))


def slo_percentiles(df: DataFrame, by: Sequence[str], value: str, approximate: bool = False) -> DataFrame:
    """p50, p95 and p99 per group. Exact by default; ``approximate`` keeps the sketch's answer."""
    wanted = {"p50": 0.5, "p95": 0.95, "p99": 0.99}
    if not approximate:
        return exact_percentiles(df, by, value, wanted)
    return df.groupBy(*by).agg(*[F.percentile_approx(value, p, 10_000).alias(n) for n, p in wanted.items()])


def trends(series: DataFrame, keys: Sequence[str], day: str, value: str, split_day) -> DataFrame:
    """Regression slope per day, average after against before ``split_day``, coefficient of variation."""
    x, y = F.col(day).cast("double"), F.col(value).cast("double")
    late = F.col(day) >= F.lit(split_day)
    return series.groupBy(*keys).agg(
        F.regr_slope(y, x).alias("slope"),
        (F.avg(F.when(late, y)) / F.avg(F.when(~late, y))).alias("average_ratio"),
        (F.stddev_samp(y) / F.avg(y)).alias("variation"),
        F.count(F.lit(1)).alias("points"))


def backlog(contracts: DataFrame, runs: DataFrame, held: DataFrame, at, bucket: str = "1 day") -> DataFrame:
    """Contracts by disjoint class and creation bucket, with the oldest age in seconds.

    ``contracts``: contract_id, job_id, state, created_at, next_eligible_at. ``runs``: contract_id of
    non-terminal runs. ``held``: job_id under an open hold.
    """
    running_ids = runs.select("contract_id", F.lit(True).alias("_run")).distinct()
    held_ids = held.select("job_id", F.lit(True).alias("_held")).distinct()
    planned = F.col("state") == "PLANNED"
    due = F.coalesce(F.col("next_eligible_at") <= as_col(at), F.lit(True))
    kind = (
        F.when(planned & F.col("_run").isNotNull(), "submitted_queued")
        .when(planned & F.col("_held").isNotNull(), "held")
        .when(planned & due, "runnable").when(planned, "backoff")
        .when(F.col("state").isin("ATTEMPT_ACTIVE", "COMMIT_OBSERVED"), "executing")
        .when(F.col("state").isin("ADJUDICATION_PENDING", "DQ_FAILED", "RECONCILIATION_REQUIRED"), "safety_blocked")
        .otherwise("terminal"))
    rows = contracts.join(running_ids, "contract_id", "left").join(held_ids, "job_id", "left").select(
        F.window("created_at", bucket)["start"].alias("bucket_start"), kind.alias("backlog_class"),
        seconds_between(F.col("created_at"), as_col(at)).alias("_age"))
    return rows.groupBy("bucket_start", "backlog_class").agg(
        F.count(F.lit(1)).alias("contract_count"), F.max("_age").alias("oldest_age_s"))


def unchanged_streaks(contracts: DataFrame, n: int, bins: Bins = None) -> DataFrame:
    """Runs of at least ``n`` consecutive finished contracts that left a job's target unchanged."""
    done = contracts.where(F.col("finalized_at").isNotNull()).withColumn(
        "_change", F.when(F.col("target_unchanged"), 0).otherwise(1))
    islands = running(done, ["job_id"], ["finalized_at", "contract_id"], {"_island": ("sum", "_change")}, bins)
    return (
        islands.where("target_unchanged").groupBy("job_id", "_island").agg(
            F.count(F.lit(1)).alias("streak"), F.min("finalized_at").alias("streak_from"),
            F.max("finalized_at").alias("streak_to"))
        .where(F.col("streak") >= n).drop("_island"))


def dedup_events(events: DataFrame) -> DataFrame:
    """At-least-once deliveries to one row per event identity.

    ``events``: aggregate_id, transition, event_type, source_id, at.
    """
    ident = F.sha2(F.concat_ws("|", F.col("aggregate_id").cast("string"), "transition", "event_type"), 256)
    return events.withColumn("event_key", ident).groupBy("event_key").agg(
        F.min("source_id").alias("source_id"), F.min("at").alias("first_at"),
        F.count(F.lit(1)).alias("deliveries"))


def event_rollup(unique_events: DataFrame) -> DataFrame:
    """Events and repeated deliveries per source."""
    return unique_events.groupBy("source_id").agg(
        F.count(F.lit(1)).alias("event_count"),
        F.sum(F.col("deliveries") - 1).cast("bigint").alias("repeat_deliveries"))


def event_loss(outbox: DataFrame, sink: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Multiset difference of sent and received events: LOST or EXTRA with the number of copies."""
    sides = outbox.select(*cols, F.lit(1).alias("_d")).unionByName(sink.select(*cols, F.lit(-1).alias("_d")))
    net = sides.groupBy(*cols).agg(F.sum("_d").alias("_net")).where("_net <> 0")
    return net.select(
        *cols, F.when(F.col("_net") > 0, "LOST").otherwise("EXTRA").alias("difference"),
        F.abs("_net").cast("bigint").alias("copies"))


def accounting_diff(samples: DataFrame, bookings: DataFrame, tolerance: timedelta,
                    bins: Bins = None) -> DataFrame:
    """Observed sessions against booked tokens, away from any grant or return.

    ``samples``: source_id, sample_id, at, observed. ``bookings``: source_id, granted_at, returned_at,
    tokens. Samples closer than ``tolerance`` to a booking change are not compared.
    """
    changes = level_changes(bookings, ["source_id"], "granted_at", "returned_at", "tokens")
    stream = samples.select(
        "source_id", "at", F.lit(1).alias("_kind"), "sample_id", "observed",
        F.lit(0).cast("bigint").alias("delta"), F.lit(None).cast("timestamp_ntz").alias("_change")
    ).unionByName(changes.select(
        "source_id", "at", F.lit(0).alias("_kind"), F.lit(-1).cast("bigint").alias("sample_id"),
        F.lit(None).cast("bigint").alias("observed"), "delta", F.col("at").alias("_change")))
    ahead = running(
        with_bins(stream, ["source_id"], "at", bins), ["source_id"], ["at", "_kind", "sample_id"],
        {"booked": ("sum", "delta"), "_last_change": ("last", "_change")}, bins)
    ahead = ahead.withColumn("_back", -F.unix_micros(F.col("at").cast("timestamp"))).withColumn("_kind_back", -F.col("_kind"))
    ahead = ahead.withColumn(BIN, -F.col(BIN))  # the same bins, read backwards
    both = running(
        ahead, ["source_id"], ["_back", "_kind_back", "sample_id"], {"_next_change": ("last", "_change")}, bins)
    tol = F.lit(tolerance)
    near = F.coalesce(F.col("at") - F.col("_last_change") <= tol, F.lit(False)) | F.coalesce(
        F.col("_next_change") - F.col("at") <= tol, F.lit(False))
    return both.where((F.col("_kind") == 1) & ~near & (F.col("observed") != F.col("booked"))).select(
        "source_id", "sample_id", "at", "observed", F.col("booked").cast("bigint").alias("booked"),
        (F.col("observed") - F.col("booked")).cast("bigint").alias("difference"))
