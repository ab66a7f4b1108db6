"""Query registry: a Spark plan per name, and the SQL text another engine runs for the same answer."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.plans.fixtures import FIXTURES
from tidemark.session import configure

BASE_TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)

_QUERIES: dict[str, Callable[["Tables"], DataFrame]] = {}
_SQL: dict[str, str] = {}


class Tables:
    """Attribute access to the sample tables and to the inputs derived from them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = configure(spark)
        self.sf_dir = sf_dir.rstrip("/")
        self._seen: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self._seen:
            if name in BASE_TABLES:
                self._seen[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
            elif name in FIXTURES:
                text = FIXTURES[name].replace("TIMESTAMP '", "TIMESTAMP_NTZ '")
                text = text.replace("AS TIMESTAMP)", "AS TIMESTAMP_NTZ)")
                used = {n: getattr(self, n) for n in re.findall(r"\{(\w+)\}", text)}
                self._seen[name] = self.spark.sql(text, **used)
            else:
                raise AttributeError(name)
        return self._seen[name]


def with_strangers(df: DataFrame, column: str, where: str) -> DataFrame:
    """The rows and, for those that fit ``where``, a copy whose ``column`` is an id that no registry knows."""
    kind = df.schema[column].dataType
    copies = df.where(where).withColumn(column, (F.col(column) + 1_000_000).cast(kind))
    return df.unionByName(copies)


def query(name: str, sql: str | None = None):
    """Register ``fn(tables) -> DataFrame`` under ``name`` with its SQL twin."""

    def wrap(fn):
        if name in _QUERIES:
            raise ValueError(f"duplicate query {name}")
        _QUERIES[name] = fn
        if sql is not None:
            _SQL[name] = sql
        return fn

    return wrap


def _fixtures_used(text: str, seen: list[str]) -> list[str]:
    for token in re.findall(r"\bfx_\w+", text):
        if token not in FIXTURES:
            raise KeyError(f"no fixture named {token}")
        if token not in seen:
            _fixtures_used(FIXTURES[token], seen)
            if token not in seen:
                seen.append(token)
    return seen


def twin_sql(name: str) -> str:
    """SQL twin of a query with the derived inputs spelled out as common table expressions."""
    text = _SQL[name].strip()
    ctes = [f"{f} AS ({re.sub(r'[{}]', '', FIXTURES[f]).strip()})" for f in _fixtures_used(text, [])]
    if not ctes:
        return text
    head = re.match(r"WITH(\s+RECURSIVE)?\s", text, re.IGNORECASE)
    if head:
        return f"WITH{head.group(1) or ''} {', '.join(ctes)}, {text[head.end():]}"
    return f"WITH {', '.join(ctes)} {text}"


def load_all() -> None:
    """Import every module that registers queries."""
    from tidemark.plans import (  # noqa: F401
        compare_plans, cursor_plans, evidence_plans, history_plans, load_plans, probe_plans,
        quality_plans, source_plans, stream_plans, window_plans,
    )


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    load_all()

    def bind(fn):
        return lambda spark, sf_dir: fn(Tables(spark, sf_dir))

    return {name: bind(fn) for name, fn in _QUERIES.items()}


def all_twins() -> dict[str, str]:
    load_all()
    return {name: twin_sql(name) for name in _SQL}
