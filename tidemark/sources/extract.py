"""Bounded and partitioned extraction from a relational source, and plain table and log scans."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.watermark import typed_literal


@dataclass(frozen=True)
class WindowBound:
    """A half-open range of one watermark column, with the column's source type."""

    column: str
    type_name: str
    low: object
    high: object


def extract_sql(
    table: str, columns: Sequence[str], window: WindowBound | None, where: str | None = None,
    identity: str | None = None, timestamp_word: str = "TIMESTAMP",
) -> str:
    """Complete SQL of one extract: window, business filter and identity predicate, all as literals.

    No bind variables and no session state: executors open their own connections.
    """
    tests = []
    if window is not None:
        low = typed_literal(window.low, window.type_name, timestamp_word)
        high = typed_literal(window.high, window.type_name, timestamp_word)
        tests.append(f"{window.column} >= {low} AND {window.column} < {high}")
    tests += [f"({t})" for t in (where, identity) if t]
    text = f"SELECT {', '.join(columns)} FROM {table}"
    return f"{text} WHERE {' AND '.join(tests)}" if tests else text


def jdbc_extract(
    spark: SparkSession, opts: Mapping[str, str], table: str, columns: Sequence[str], schema: str,
    window: WindowBound | None, where: str | None = None, identity: str | None = None,
    partition_column: str | None = None, bounds: tuple[int, int] | None = None, n: int = 1,
) -> DataFrame:
    """Read one bounded extract over JDBC; one connection per partition, one partition by default.

    ``schema`` is the explicit DDL of ``columns``, which saves a schema round trip. With
    ``partition_column`` the limited subquery is split by stride; the bounds alone would not limit it.
    """
    text = extract_sql(table, columns, window, where, identity)
    reader = spark.read.format("jdbc").options(**opts).option("customSchema", schema)
    if partition_column is None or n <= 1:
        return reader.option("query", text).load()
    low, high = bounds
    return (
        reader.option("dbtable", f"({text}) q").option("partitionColumn", partition_column)
        .option("lowerBound", low).option("upperBound", high).option("numPartitions", n).load())


def read_table(spark: SparkSession, path: str, schema: T.StructType | str, fmt: str = "parquet") -> DataFrame:
    """Scan staged files with an explicit schema; filters and column choice reach the reader."""
    return spark.read.format(fmt).schema(schema).load(path)


def read_jsonl_log(spark: SparkSession, path: str, schema: T.StructType, prefix: str | None = None) -> DataFrame:
    """Tolerant scan of JSON-line logs: (file, line, is_record, is_json, record).

    Every physical line is kept. ``is_record`` marks lines with the prefix, ``is_json`` those that
    parse; ``record`` is NULL otherwise.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("line"))
    body = F.col("line") if prefix is None else F.when(
        F.col("line").startswith(prefix), F.substring("line", len(prefix) + 1, 2**31 - 1))
    full = T.StructType([*schema.fields, T.StructField("_corrupt_record", T.StringType())])
    parsed = lines.withColumn("_body", body).withColumn(
        "_rec", F.from_json("_body", full, {"mode": "PERMISSIVE"}))
    good = F.col("_body").isNotNull() & F.col("_rec").isNotNull() & F.col("_rec._corrupt_record").isNull()
    record = F.struct(*[F.col(f"_rec.{f.name}").alias(f.name) for f in schema.fields])
    return parsed.select(
        "file", "line", F.col("_body").isNotNull().alias("is_record"), good.alias("is_json"),
        F.when(good, record).alias("record"))


def log_counts(lines: DataFrame) -> DataFrame:
    """Physical, record and unparsable line counts per file."""
    return lines.groupBy("file").agg(
        F.count(F.lit(1)).alias("line_count"), F.count_if("is_record").alias("record_count"),
        F.count_if(F.col("is_record") & ~F.col("is_json")).alias("unparsable"))
