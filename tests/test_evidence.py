"""Verdicts case by case."""

import datetime as dt

import pytest

from tidemark.operators import evidence as E
from tidemark.operators import history as H
from tidemark.operators import load as L
from tidemark.operators import probes as P

T0 = dt.datetime(2024, 1, 1)
SNAP = ("snapshot_id INT, contract_id INT, attempt_no INT, chunk_no INT, writer_kind STRING, lease_id INT, "
        "observed_contract_id INT, observed_attempt_no INT")


def snap(i, chunk, kind="ingest", lease=None, contract=1):
    return (i, contract, 1, chunk, kind, lease, 1, 1)


@pytest.mark.parametrize("snaps,zero,expected,mode,policy,want", [
    ([1, 2, 3], [], 3, "APPEND", None, "COMMIT"),
    ([1, 3], [2], 3, "APPEND", None, "COMMIT"),
    ([1, 2], [], 3, "APPEND", None, "PARTIAL_COMMIT"),
    ([], [1], 3, "MERGE", None, "PARTIAL_COMMIT"),
    ([], [1, 2, 3], 3, "MERGE", None, "FINALIZED_NO_DATA"),
    ([], [1], 1, "FULL", "RETAIN_PREVIOUS", "FINALIZED_NO_DATA"),
    ([], [1], 1, "FULL", "FAIL", "NO_COMMIT(EMPTY_FULL)"),
    ([], [1], 1, "FULL", None, "NO_COMMIT(EMPTY_FULL)"),
    ([], [], 3, "APPEND", None, "NO_COMMIT"),
    ([1, 3], [], 3, "APPEND", None, "RECONCILIATION_REQUIRED"),
    ([2], [], 3, "APPEND", None, "RECONCILIATION_REQUIRED"),
    ([1, 1], [], 3, "APPEND", None, "RECONCILIATION_REQUIRED"),
])
def test_adjudication(spark, snaps, zero, expected, mode, policy, want):
    s = spark.createDataFrame([snap(i, c) for i, c in enumerate(snaps)], SNAP)
    r = spark.createDataFrame([(1, 1, c, 0, False) for c in zero], "contract_id INT, attempt_no INT, chunk_no INT, extracted_rows INT, committed BOOLEAN")
    leases = spark.createDataFrame([(9,)], "lease_id INT")
    c = spark.createDataFrame([(1, 1, expected, mode, policy)], "contract_id INT, attempt_no INT, expected_chunks INT, load_mode STRING, on_empty_source STRING")
    assert E.adjudicate(s, r, leases, c).collect()[0].verdict == want


@pytest.mark.parametrize("extra,want", [
    (snap(50, None, "maintenance", 9), "COMMIT"), (snap(50, None, "maintenance", 8), "RECONCILIATION_REQUIRED"),
    (snap(50, None, "maintenance", None), "RECONCILIATION_REQUIRED"), (snap(50, 1, "ingest", None, contract=2), "RECONCILIATION_REQUIRED"),
    ((50, None, None, None, None, None, 1, 1), "RECONCILIATION_REQUIRED")])
def test_foreign_snapshots(spark, extra, want):
    s = spark.createDataFrame([snap(1, 1), extra], SNAP)
    r = spark.createDataFrame([], "contract_id INT, attempt_no INT, chunk_no INT, extracted_rows INT, committed BOOLEAN")
    c = spark.createDataFrame([(1, 1, 1, "APPEND", None)], "contract_id INT, attempt_no INT, expected_chunks INT, load_mode STRING, on_empty_source STRING")
    assert E.adjudicate(s, r, spark.createDataFrame([(9,)], "lease_id INT"), c).collect()[0].verdict == want


def test_ancestor_pairs_in_a_forest(spark):
    import random

    rng = random.Random(4)
    parent = {(t, i): (rng.randrange(max(0, i - 4), i) if i and rng.random() > 0.03 else None) for t in (1, 2) for i in range(120)}
    gone = {(1, 40), (2, 7)}
    rows = [(t, i, p) for (t, i), p in parent.items() if (t, i) not in gone]
    asked = [(rng.choice((1, 2)), rng.randrange(125), rng.randrange(125)) for _ in range(1500)] + [(1, 40, 40), (1, None, 3)]
    kept = {(t, i) for t, i, _ in rows}

    def up(t, a, h):
        if a == h:
            return True
        while h is not None and (t, h) in kept:
            if h == a:
                return True
            h = parent[t, h]
        return False

    got = E.ancestor_pairs(spark.createDataFrame(rows, "table_id INT, snapshot_id INT, parent_id INT"),
                           spark.createDataFrame(asked, "table_id INT, snapshot_id INT, head_id INT"))
    assert {tuple(r) for r in got.collect()} == {q for q in asked if q[1] is not None and up(*q)}
    with pytest.raises(ValueError):
        E.ancestor_pairs(spark.createDataFrame([(1, 1, 2), (1, 2, 1)], "table_id INT, snapshot_id INT, parent_id INT"),
                         spark.createDataFrame([(1, 1, 2)], "table_id INT, snapshot_id INT, head_id INT"))


@pytest.mark.parametrize("head,base,want", [
    (None, None, "COMMIT"), (2, None, "COMMIT"), (3, None, "COMMIT"), (1, None, "RECONCILIATION_REQUIRED"), (3, 1, "COMMIT"), (3, 9, "RECONCILIATION_REQUIRED")])
def test_reclaimed_leases_and_expired_bases(spark, head, base, want):
    """Snapshot 2 is maintenance under a lease reclaimed at ``head``; the contract started from ``base``."""
    snaps = spark.createDataFrame([(7, *snap(1, 1)), (7, *snap(2, None, "maintenance", 9))], "table_id INT, " + SNAP)
    chain = spark.createDataFrame([(7, 1, 0), (7, 2, 1), (7, 3, 2)], "table_id INT, snapshot_id INT, parent_id INT")
    receipts = spark.createDataFrame([], "contract_id INT, attempt_no INT, chunk_no INT, extracted_rows INT, committed BOOLEAN")
    c = spark.createDataFrame([(1, 1, 1, "APPEND", None, 7, base, 3)], "contract_id INT, attempt_no INT, expected_chunks INT, load_mode STRING, "
                              "on_empty_source STRING, table_id INT, base_snapshot_id INT, head_snapshot_id INT")
    leases = spark.createDataFrame([(9, head)], "lease_id INT, reclaimed_head_id INT")
    assert E.adjudicate(snaps, receipts, leases, c, chain).collect()[0].verdict == want


def test_ancestry_of_a_long_chain(spark):
    s = spark.range(200).selectExpr("1 AS table_id", "id AS snapshot_id", "CASE WHEN id > 0 THEN id - 1 END AS parent_id")
    head = spark.sql("SELECT 1 AS table_id, 150L AS snapshot_id")
    base = spark.sql("SELECT 1 AS table_id, 20L AS snapshot_id")
    rows = E.ancestry(s, head, base).collect()
    assert sorted((r.snapshot_id, r.depth) for r in rows) == [(i, 150 - i) for i in range(21, 151)]


def test_rebinding_rows_do_not_split_an_interval(spark):
    h = spark.createDataFrame(
        [(1, 1, "NEW", "SUBMITTED", T0), (2, 1, "SUBMITTED", "SUBMITTED", T0 + dt.timedelta(1)),
         (3, 1, None, "SUBMITTED", T0 + dt.timedelta(2)), (4, 1, "SUBMITTED", "DONE", T0 + dt.timedelta(3))],
        "seq INT, attempt INT, from_state STRING, to_state STRING, at TIMESTAMP_NTZ")
    rows = {r.seq: r.until for r in H.state_intervals(h, ["attempt"], "at", "seq").collect()}
    assert rows == {1: T0 + dt.timedelta(3), 4: None}


def test_row_drift_window(spark):
    days = [(1, T0 + dt.timedelta(i), n) for i, n in enumerate([100, 100, 100, 40, 100])]
    s = spark.createDataFrame(days, "table_id INT, day TIMESTAMP_NTZ, row_count INT")
    rows = L.row_count_drift(s, ["table_id"], "day", 3, 0.5).collect()
    assert [(r.row_count, r.trailing_avg) for r in rows] == [(40, 100.0)]


PROBE = "source_id INT, probe STRING, query_ok BOOLEAN, row_present BOOLEAN, has_value BOOLEAN, value STRING, value_interpretable BOOLEAN, ora INT, msg STRING"


@pytest.mark.parametrize("probe,ora,want", [
    ("feat.standard_hash_sha256", -904, "UNSUPPORTED"), ("feat.fetch_first", -904, "AMBIGUOUS"), ("feat.fetch_first", -933, "UNSUPPORTED"),
    ("feat.fetch_first", -1031, "DENIED"), ("feat.fetch_first", -942, "WRONG_TARGET"), ("alter.STANDBY_MAX_DATA_DELAY.D", -2248, "UNSUPPORTED"),
    ("feat.fetch_first", -2248, "UNKNOWN"), ("feat.fetch_first", -3113, "TRANSIENT"), ("feat.fetch_first", -1722, "PROBE_BUG"), ("other", None, "UNKNOWN")])
def test_probe_errors(spark, probe, ora, want):
    p = spark.createDataFrame([(1, probe, False, None, False, None, None, ora, "x")], PROBE)
    assert P.classify_probes(p, P.probe_rules(spark)).collect()[0].kind == want


def test_denied_is_not_absent(spark):
    rows = [(1, "feat.standard_hash_sha256", False, None, False, None, None, -1031, ""), (2, "feat.standard_hash_sha256", False, None, False, None, None, -904, ""),
            (3, "feat.standard_hash_sha256", True, True, True, "ab", False, None, "")]
    axes = P.derive_axes(P.classify_probes(spark.createDataFrame(rows, PROBE), P.probe_rules(spark)))
    got = {r.source_id: r.value for r in axes.where("axis = 'hash_function'").collect()}
    assert got == {1: "UNDETERMINED", 2: "NONE", 3: "NONE"}


@pytest.mark.parametrize("axis,value,want", [
    ("sql_dialect", "12C_PLUS", "11G"), ("sql_dialect", "UNDETERMINED", "UNDETERMINED"), ("snapshot_scope", "NONE", "NONE"),
    ("snapshot_scope", "JOB", "STATEMENT"), ("db_charset", "AL32UTF8", "UNDETERMINED"), ("wm_successor", "DATE", "UNDEFINED")])
def test_floors_only_lower(spark, axis, value, want):
    df = spark.createDataFrame([(1, axis, value, None, True, None)], "source_id INT, axis STRING, value STRING, measured_at TIMESTAMP_NTZ, is_bound BOOLEAN, extra_reasons ARRAY<STRING>")
    row = P.apply_floors(df, T0, None, reasons_all=["SOURCE_UNVERIFIED"]).collect()[0]
    assert row.effective_value == want and row.value == value


def test_cycle_in_the_parent_chain(spark):
    s = spark.createDataFrame([(1, 1, 2), (1, 2, 3), (1, 3, 1)], "table_id INT, snapshot_id INT, parent_id INT")
    with pytest.raises(ValueError, match="cycle"):
        E.ancestry(s, spark.sql("SELECT 1 AS table_id, 1 AS snapshot_id"))
