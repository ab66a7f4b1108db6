"""Helpers shared by the operators: row keys, shared tables, worker imports, the public tokenizer."""

from __future__ import annotations

import functools
import os
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import configure, scratch_path

#: Internal row key. Columns of the caller never meet it: operators project what they need first.
ROW = "__row"
TOKENIZER_FILE = "byte_bpe_50k.json"
RANKS_FILE = "byte_bpe_50k.tiktoken"
BATCH_BYTES = 8 << 20
#: Fixed value: the special string of the vocabulary and its id.
SPECIAL, SPECIAL_ID = "<|endoftext|>", 50256


def prepared(spark: SparkSession) -> SparkSession:
    """Session settings of the library; Python workers can import it from where the driver did."""
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    paths = (env.get("PYTHONPATH") or os.environ.get("PYTHONPATH") or "").split(os.pathsep)
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *filter(None, paths)])
    # Long texts: an Arrow batch is bounded by bytes, not only by rows, since workers hold several copies of it.
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    # An operator is many executions, each of which leaves a stored table: shuffle files go when their execution ends, and
    # not when the driver happens to collect garbage. A frame that is run again would make its shuffles again.
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
    return configure(spark)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepared(spark).read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def with_row(df: DataFrame) -> DataFrame:
    """Add the row key: the place of the row in its input split.

    Every branch of a plan over a table read from files sees the same keys. A frame that has been shuffled since
    must be written or checkpointed first, since its order may differ from one branch to the next.
    """
    return df.withColumn(ROW, F.monotonically_increasing_id())


def shared_table(df: DataFrame, label: str) -> DataFrame:
    """Write once to the folder that all executors share and read it back: lost executors cost no rework."""
    path = scratch_path(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_or_empty(column: str | Column) -> Column:
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


@functools.cache
def library(path: str):
    """The public tokenizer, one per worker process."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def tokenizer_path(name: str = TOKENIZER_FILE) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
