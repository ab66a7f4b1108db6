"""Canonical text and row hash against an independent implementation in plain Python."""

import datetime as dt
import hashlib
import unicodedata
from decimal import ROUND_HALF_UP, Decimal

import pytest
from pyspark.sql import functions as F

from tidemark.functions import canon as K
from tidemark.functions.vectors import vector_checks
from tidemark.functions.watermark import successor, typed_literal
from tidemark.operators.load import CastRule

TEXTS = ["", None, "plain", "é", "é", "한", "\U0001F600", "ạ̇", "x" * 2000, "x" * 2001, "<<NULL>>"]


def frame(tag, content):
    if content is None:
        return bytes(5)
    return bytes([tag]) + len(content).to_bytes(4, "big") + content


def text_bytes(s):
    if not s:
        return frame(0, None)
    raw = unicodedata.normalize("NFC", s).encode()
    return frame(5, hashlib.sha256(raw).digest()) if len(raw) > 2000 else frame(1, raw)


def row_hash(frames):
    d = [hashlib.sha256(f).digest() for f in frames]
    groups = [d[i:i + 32] for i in range(0, len(d), 32)]
    g = [hashlib.sha256(b"\xfe" + len(x).to_bytes(4, "big") + b"".join(x)).digest() for x in groups]
    return hashlib.sha256(b"\xff" + len(d).to_bytes(4, "big") + b"".join(g)).hexdigest()


def test_row_hash_matches_python(spark):
    rows = [(i, t, Decimal(f"{i}.005"), dt.datetime(2024, 1, 1, 0, 0, i, 120), bytes([0, i])) for i, t in enumerate(TEXTS)]
    df = spark.createDataFrame(rows, "i INT, t STRING, n DECIMAL(20,3), at TIMESTAMP_NTZ, b BINARY")
    rules = [K.ColumnRule("t", "STRING"), K.ColumnRule("n", "NUMBER", 20, 2), K.ColumnRule("at", "TIMESTAMP"), K.ColumnRule("b", "BINARY")]
    got = {r.i: r.h for r in df.select("i", K.row_hash(rules).alias("h")).collect()}
    for i, t, n, at, b in rows:
        number = str(n.quantize(Decimal("0.01"), ROUND_HALF_UP)).encode()
        want = [text_bytes(t), frame(2, number), frame(3, at.strftime("%Y-%m-%dT%H:%M:%S.%fZ").encode()), frame(4, b)]
        assert got[i] == row_hash(want)


@pytest.mark.parametrize("n", [1, 32, 33, 64, 65, 300, 1024])
def test_group_boundaries(spark, n):
    rules = [K.ColumnRule("v", "NUMBER", 38, 0)] * n
    got = spark.sql("SELECT 7 AS v").select(K.row_hash(rules).alias("h")).collect()[0].h
    assert got == row_hash([frame(2, b"7")] * n)


def test_too_many_columns():
    with pytest.raises(ValueError):
        K.row_hash([K.ColumnRule("v", "NUMBER", 38, 0)] * 1025)
    with pytest.raises(ValueError):
        K.column_bytes(K.ColumnRule("v", "NUMBER"))


def test_vectors_hold_on_real_text(spark, tables):
    out = vector_checks(tables.customer, "c_name").collect()
    assert len(out) == 16 and all(r.rows_checked == r.rows_as_expected > 0 for r in out)


@pytest.mark.parametrize("value,scale,want", [
    ("0", 2, "0.00"), ("-0.004", 2, "0.00"), ("0.1", 2, "0.10"), ("100", 0, "100"), ("1234", -2, "1200"), ("1250", -2, "1300"),
    ("2.5", 0, "3"), ("-2.5", 0, "-3"), ("0.005", 2, "0.01"), ("12345678901234567890.12", 2, "12345678901234567890.12")])
def test_number_text(spark, value, scale, want):
    df = spark.sql(f"SELECT CAST('{value}' AS DECIMAL(38,10)) AS n")
    assert df.select(K.canon_number("n", 38, scale).alias("t")).collect()[0].t == want


def test_wall_clock_ignores_the_session_zone(spark):
    df = spark.sql("SELECT TIMESTAMP_NTZ '2024-03-10 02:30:00.000001' AS at")
    assert df.select(K.canon_timestamp("at").alias("t")).collect()[0].t == "2024-03-10T02:30:00.000001Z"


def test_successor_limits(spark):
    df = spark.sql("SELECT TIMESTAMP_NTZ '9999-12-31 23:59:59.999999' AS at, CAST(99.99 AS DECIMAL(4,2)) AS n")
    row = df.select(successor("at", "TIMESTAMP(6)").alias("a"), successor("n", "NUMBER(4,2)").alias("b")).collect()[0]
    assert row.a is None and row.b is None


def test_literals_are_typed():
    assert typed_literal(dt.datetime(2024, 1, 2), "DATE") == "TIMESTAMP '2024-01-02 00:00:00'"
    assert typed_literal("o'k", "VARCHAR2(9)") == "'o''k'"
    assert typed_literal(Decimal("1E+2"), "NUMBER(10,2)") == "100"
    with pytest.raises(TypeError):
        typed_literal("2024-01-02", "DATE")


def test_long_is_rejected():
    with pytest.raises(ValueError, match="LONG_NOT_EXTRACTABLE"):
        CastRule("c", "LONG RAW")


def test_nfc_matches_python_on_documents(spark, tables):
    rows = tables.documents.select("text", K.nfc(F.concat("text", F.lit("é"))).alias("n")).limit(200).collect()
    assert all(r.n == unicodedata.normalize("NFC", r.text + "é") for r in rows)


@pytest.mark.parametrize("a,b,difference", [
    ("1.001D", "1.004D", "HASH_MISMATCH"), ("double('NaN')", "NULL", "HASH_MISMATCH"), ("double('Infinity')", "NULL", "HASH_MISMATCH"),
    ("double('Infinity')", "double('NaN')", "HASH_MISMATCH"), ("double('Infinity')", "double('-Infinity')", "HASH_MISMATCH"),
    ("double('NaN')", "double('NaN')", None), ("0.1D", "0.1D", None), ("-0.0D", "0.0D", None)])
def test_compare_is_exact_on_doubles(spark, a, b, difference):
    from tidemark.operators.compare import compare_exact

    s, t = (spark.sql(f"SELECT 1 AS k, CAST({v} AS DOUBLE) AS v") for v in (a, b))
    rules = K.rules_from_schema(s.schema, scales={"v": 3})
    assert [r.difference for r in compare_exact(s, t, ["k"], rules).collect()] == [difference] * (difference is not None)


def test_doubles_need_a_scale(spark):
    with pytest.raises(ValueError, match="scale"):
        K.rules_from_schema(spark.sql("SELECT 1D AS v").schema)


def test_repeated_and_null_keys_are_findings(spark):
    from tidemark.operators.compare import compare_exact

    s = spark.createDataFrame([(1, "a"), (1, "b"), (2, "x"), (None, "n"), (3, "y")], "k INT, v STRING")
    t = spark.createDataFrame([(1, "a"), (1, "b"), (1, "c"), (2, "x"), (None, "n")], "k INT, v STRING")
    for buckets in (None, 4):
        got = sorted((str(r.k), r.difference, r.source_rows, r.target_rows) for r in compare_exact(s, t, ["k"], buckets=buckets).collect())
        keyed = [g for g in got if g[0] != "None"]
        assert keyed == [("1", "DUPLICATE_KEY", 2, 3), ("3", "MISSING", 1, 0)]
    assert {g[1] for g in sorted((str(r.k), r.difference) for r in compare_exact(s, t, ["k"]).collect()) if g[0] == "None"} == {"NULL_KEY"}


def test_zoned_watermarks(spark):
    zone = dt.timezone(dt.timedelta(hours=9))
    assert typed_literal(dt.datetime(2024, 1, 2, 9, tzinfo=zone), "TIMESTAMP(6) WITH TIME ZONE") == "TIMESTAMP '2024-01-02 09:00:00.000000 +09:00'"
    for value, kind in ((dt.datetime(2024, 1, 2), "TIMESTAMP(6) WITH LOCAL TIME ZONE"), (dt.datetime(2024, 1, 2, tzinfo=zone), "TIMESTAMP(6)")):
        with pytest.raises(TypeError):
            typed_literal(value, kind)
    row = spark.sql("SELECT TIMESTAMP '2024-01-02 09:00:00 +09:00' AS at").select(
        (successor("at", "TIMESTAMP(3) WITH TIME ZONE") == F.lit("2024-01-02T00:00:00.001Z").cast("timestamp")).alias("ok")).collect()[0]
    assert row.ok


@pytest.mark.parametrize("kind,text,value,warning", [
    ("NUMBER(5,-2)", "1234500", "1234500", None), ("NUMBER(5,-2)", "1234567", "1234600", "c:ROUNDED"), ("NUMBER(5,-2)", "123456789", None, "c:OUT_OF_RANGE"),
    ("NUMBER(2,5)", "0.00012", "0.00012", None), ("NUMBER(2,5)", "0.5", None, "c:OUT_OF_RANGE"), ("NUMBER(8,2)", "123.456", "123.46", "c:ROUNDED"),
    ("NUMBER(8,2)", "123.4500", "123.45", None), ("NUMBER(8,2)", "1.5e-1", "0.15", None), ("NUMBER(8,2)", "1.25e-1", "0.13", "c:ROUNDED"),
    ("NUMBER(38,-5)", "12345678901234567890123456789012345678900000", "12345678901234567890123456789012345678900000", None)])
def test_number_casts(spark, kind, text, value, warning):
    from tidemark.operators.load import cast_standard

    df = spark.createDataFrame([(text,)], "c STRING")
    row = cast_standard(df, [CastRule("c", kind)]).select(F.col("c").cast("string").alias("c"), "cast_warnings").collect()[0]
    assert row.c == value and row.cast_warnings == ([warning] if warning else [])
