"""The corpus pipeline: language ID, exact and near deduplication, mixing to target weights, packing.

Each stage takes (spark, docs, sf_dir) and returns a table that is written and reread as the next one's ``docs``; all
but the last return the columns of ``docs``. Stages handle nulls, repeated rows and empty tables as their operators do.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.common import prepared, scratch_path, table
from tidemark.llm.exact_dedup import drop_copies
from tidemark.llm.language_id import keep_identified
from tidemark.llm.mixing import mixture
from tidemark.llm.near_dedup import drop_near_copies
from tidemark.llm.packing import pack


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter or without a clear language go."""
    prepared(spark)
    return keep_identified(docs)


def drop_exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each text stays."""
    prepared(spark)
    return drop_copies(docs)


def drop_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near-duplicates stays."""
    prepared(spark)
    return drop_near_copies(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mix takes them, shuffled within output shards."""
    prepared(spark)
    return mixture(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences, with their ids."""
    prepared(spark)
    return pack(docs, with_ids=True)


STAGES = [
    ("language id", identify_language),
    ("exact dedup", drop_exact),
    ("near dedup", drop_near),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Language labels come from a trained model and ids from a tokenizer, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each result but the last is written to the shared folder and reread."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, f"pipeline-{name.replace(' ', '-')}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
