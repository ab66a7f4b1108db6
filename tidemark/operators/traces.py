"""Connection traces: completeness of trace files, path coverage, fail-closed proof, identity."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Driver phases by path, and the terminal status of a proven failing run.
SCHEMA_PHASES = ("schema_only",)
TASK_PHASES = ("partitioned_count", "second_action")
UNDECLARED_PHASES = ("", "UNDECLARED", "BETWEEN_STEPS")
REQUIRED_FAILING_RUNS = {"failclosed_schema": "SCHEMA", "failclosed_task": "TASK"}
EXPECTED_TERMINAL = "EXPECTED_FAILURE_OBSERVED"


def stream_status(lines: DataFrame, keys: tuple[str, ...] = ("file",)) -> DataFrame:
    """Is each trace file whole? One sentinel, and physical lines = lines_written + 1.

    ``lines``: keys, is_json, event, lines_written (of the sentinel).
    """
    end = F.col("event") == "trace_end"
    per = lines.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("line_count"), F.count_if(~F.col("is_json")).alias("unparsable"),
        F.count_if(end).alias("sentinels"), F.max(F.when(end, F.col("lines_written"))).alias("lines_written"))
    expected = F.col("lines_written") + 1
    why = (
        F.when(F.col("sentinels") == 0, "NO_SENTINEL").when(F.col("sentinels") > 1, "MANY_SENTINELS")
        .when(F.col("lines_written").isNull(), "NO_LINE_COUNT").when(F.col("line_count") < expected, "LINES_LOST")
        .when(F.col("line_count") > expected, "FOREIGN_LINES").when(F.col("unparsable") > 0, "UNPARSABLE_LINES"))
    return per.withColumn("why", why).withColumn("is_complete", F.col("why").isNull())


def run_complete(status: DataFrame, run: str) -> DataFrame:
    """A run is complete only when every one of its files is."""
    return status.groupBy(run).agg(
        F.count(F.lit(1)).alias("files"), F.bool_and("is_complete").alias("trace_complete"))


def trace_coverage(trace: DataFrame, run: str = "run") -> DataFrame:
    """Connections per declared phase, preamble success and distinct sessions of a run.

    ``trace``: run, declared_phase, path_guess, preamble_ok, sid. Paths are judged by the phase the
    driver declared, never by the guess.
    """
    phase = F.col("declared_phase")
    per = trace.groupBy(run).agg(
        F.count(F.lit(1)).alias("connections"),
        F.count_if(phase.isin(*SCHEMA_PHASES)).alias("schema_connections"),
        F.count_if(phase.isin(*TASK_PHASES)).alias("task_connections"),
        F.count_if(phase.isNull() | phase.isin(*UNDECLARED_PHASES)).alias("undeclared_connections"),
        F.count_if(F.coalesce(F.col("preamble_ok"), F.lit(False))).alias("preamble_ok"),
        F.count_distinct("sid").alias("distinct_sessions"))
    return per.withColumn(
        "paths_covered", (F.col("schema_connections") > 0) & (F.col("task_connections") > 0)
    ).withColumn("preamble_everywhere", F.col("preamble_ok") == F.col("connections"))


def preamble_by_path(trace: DataFrame, run: str = "run") -> DataFrame:
    """Preamble success per guessed path, for diagnosis."""
    return trace.groupBy(run, "path_guess").agg(
        F.count(F.lit(1)).alias("connections"),
        F.count_if(F.coalesce(F.col("preamble_ok"), F.lit(False))).alias("preamble_ok"))


def failclosed_status(trace: DataFrame, terminals: DataFrame, steps: DataFrame, completeness: DataFrame,
                      required: Mapping[str, str] = REQUIRED_FAILING_RUNS) -> DataFrame:
    """Does a failing preamble really stop the job? One answer per suite.

    ``trace``: suite_id, run, injection_applied. ``terminals``: suite_id, run, status,
    rows_read_total. ``steps``: suite_id, run, status of fail-closed runs. ``completeness``:
    suite_id, trace_complete. What was not tested is NOT_TESTED, never a pass.
    """
    applied = trace.groupBy("suite_id", "run").agg(
        F.count_if(F.coalesce(F.col("injection_applied"), F.lit(False))).alias("_applied"))
    tokens = terminals.groupBy("suite_id", "run").agg(
        F.bool_and(F.col("status") == EXPECTED_TERMINAL).alias("_status_ok"),
        F.max("rows_read_total").alias("_rows"))
    proof = applied.join(tokens, ["suite_id", "run"], "left").where(F.col("run").isin(*required))
    good = (F.col("_applied") > 0) & F.col("_status_ok") & (F.col("_rows") == 0)
    proven = proof.groupBy("suite_id").agg(
        F.count_if(F.coalesce(good, F.lit(False))).alias("proven_runs"))
    tested = steps.groupBy("suite_id").agg(
        F.count_if(F.col("status").isin("FAIL_CLOSED_BROKEN", "FAIL_CLOSED_PARTIAL")).alias("broken_steps"))
    joined = completeness.join(tested, "suite_id", "left").join(proven, "suite_id", "left")
    answer = (
        F.when(F.col("broken_steps").isNull(), "NOT_TESTED").when(F.col("broken_steps") > 0, "NO")
        .when(~F.col("trace_complete"), "MEASUREMENT_FAILED")
        .when(F.coalesce("proven_runs", F.lit(0)) < len(required), "NOT_PROVEN").otherwise("YES"))
    return joined.select(
        "suite_id", answer.alias("answer"), F.coalesce("proven_runs", F.lit(0)).cast("bigint").alias("proven_runs"),
        F.coalesce("broken_steps", F.lit(0)).cast("bigint").alias("broken_steps"))


def identity_audit(connections: DataFrame, expected: DataFrame, key: str = "source_id") -> DataFrame:
    """Connections that reached another database or role, and how many sessions and instances there were.

    ``connections``: key, db_unique_name, database_role, sid, instance. ``expected``: key,
    expected_db, expected_role. Nobody vouches for a source without an expected identity, so all its
    connections are wrong.
    """
    joined = connections.join(expected.withColumn("_known", F.lit(True)), key, "left")
    wrong = (
        F.col("_known").isNull() | ~F.upper("db_unique_name").eqNullSafe(F.upper("expected_db"))
        | ~F.upper("database_role").eqNullSafe(F.upper("expected_role")))
    return joined.groupBy(key).agg(
        F.count(F.lit(1)).alias("connections"), F.count_if(wrong).alias("wrong_identity"),
        F.count_distinct("sid").alias("sessions"), F.count_distinct("instance").alias("instances"),
    ).withColumn("identity_ok", F.col("wrong_identity") == 0)
