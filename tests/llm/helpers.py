"""Small tables and the sample tables for the tests of the training-data operators."""

from __future__ import annotations

from pathlib import Path

from tidemark.session import scratch_path

SMALL = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def stored(df):
    """The table as three files: operators take tables that are read from files."""
    path = scratch_path(df.sparkSession, "test-table")
    df.repartition(3).write.parquet(path)
    return df.sparkSession.read.parquet(path)


def docs(spark, texts, **columns):
    """A documents table: ids count from 0; other columns are lists of the same length."""
    n = len(texts)
    get = {"doc_id": list(range(n)), "lang": ["en"] * n, "source": ["s"] * n} | columns
    rows = [(get["doc_id"][i], t, get["lang"][i], get["source"][i], len(t or "")) for i, t in enumerate(texts)]
    return stored(spark.createDataFrame(rows, DOCS))


def clashing(df):
    """The same table with extra columns that are named like internal ones."""
    from pyspark.sql import functions as F

    for name in ("id", "body", "n", "kept", "shard", "block", "draw", "extra", "size", "node", "place"):
        df = df.withColumn(name, F.lit(name))
    return df


def sample(spark, name):
    return spark.read.parquet(str(Path(SMALL) / f"{name}.parquet"))


def under_splits(spark, df, run):
    """Results of ``run`` over the same rows in the same eight files, read as one, as few and as many partitions."""
    path = scratch_path(spark, "test-splits")
    df.repartition(8).write.parquet(path)
    keys = {"spark.sql.files.maxPartitionBytes": ("1g", "24k", "8k"), "spark.sql.files.openCostInBytes": ("0", "0", "64k"),
            "spark.sql.files.minPartitionNum": ("1", "3", "16"), "spark.sql.shuffle.partitions": ("4", "3", "7")}
    before, out, sizes = {k: spark.conf.get(k, None) for k in keys}, [], set()
    try:
        for i in range(3):
            for k, v in keys.items():
                spark.conf.set(k, v[i])
            rows = spark.read.parquet(path)
            sizes.add(rows.rdd.getNumPartitions())
            out.append(run(rows))
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert len(sizes) == 3
    return out
