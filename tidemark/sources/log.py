"""A commit log that stays readable at any number of commits.

An append writes one small entry to the log's tail. A fold merges the tail, and older runs that are no longer much
larger than it, into one run and publishes the list of live runs as the next state: each row is rewritten a
logarithmic number of times and the number of runs stays logarithmic. The tail is folded by folder: an entry appended alone has
a folder of its own, entries appended in bulk share one folder, with one file, per task. Rows have an identity; of several with
the same identity, the newest one counts, wherever it lies, so a repeated commit is one row and a reader sees every
row once before, during and after a fold. Entries and runs that the newest state has absorbed are deleted by ``purge``.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.session import remove_path

#: A run is merged into the new one unless it has at least so many times its rows.
FANOUT = 4
#: ``_unit`` is the folder of the tail that an entry lies in; NULL if the folder is named like the entry.
MARKS_DDL = "_stamp BIGINT, _entry STRING, _unit STRING"
#: Folders of the tail that a fold has absorbed, with the number of their entries (NULL: one).
FOLDED_DDL = "entry STRING, entries BIGINT"
STATE_DDL = "run STRING, run_rows BIGINT, seq BIGINT"


def read_if_there(spark: SparkSession, path: str, ddl: str, **options) -> DataFrame:
    """The table at ``path``, or no rows where nothing has been written yet."""
    try:
        return spark.read.options(**options).schema(ddl).parquet(path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return spark.createDataFrame([], ddl)
        raise


class TieredLog:
    """Rows of ``ddl`` under ``root``; ``identity`` names the columns that tell whether two rows are the same commit."""

    def __init__(self, spark: SparkSession, root: str, ddl: str, identity: Sequence[str], fanout: int = FANOUT):
        self.spark, self.root, self.ddl, self.identity, self.fanout = spark, root.rstrip("/"), ddl, list(identity), fanout

    def append(self, rows: Sequence[dict], entry: str | None = None) -> None:
        """Add rows that become visible together. A named ``entry`` that exists already is an error."""
        schema = self.spark.createDataFrame([], self.ddl).schema
        df = self.spark.createDataFrame([tuple(r.get(f.name) for f in schema.fields) for r in rows], schema)
        name = entry or uuid.uuid4().hex
        df.coalesce(1).withColumns({"_stamp": F.lit(time.time_ns()), "_entry": F.lit(name), "_unit": F.lit(name)}).write.mode("errorifexists").parquet(f"{self.root}/tail/entry={name}")

    def append_each(self, rows: DataFrame) -> None:
        """Add every row of a table as an entry of its own. The entries of one task become visible together, as one file."""
        unit = F.concat(F.lit(f"{uuid.uuid4().hex}-"), F.spark_partition_id())
        marked = rows.withColumns({"_stamp": F.lit(time.time_ns()), "_entry": F.expr("uuid()"), "_unit": unit}).withColumn("entry", F.col("_unit"))
        marked.write.mode("append").option("maxRecordsPerFile", 0).partitionBy("entry").parquet(f"{self.root}/tail")

    def state(self) -> tuple[int, list]:
        """(number of the newest state, its runs from old to new)."""
        states = read_if_there(self.spark, f"{self.root}/state", STATE_DDL)
        newest = states.agg(F.max("seq")).first()[0]
        if newest is None:
            return 0, []
        return newest, states.where(F.col("seq") == newest).orderBy(F.desc("run_rows")).collect()

    def _tail(self) -> DataFrame:
        return read_if_there(self.spark, f"{self.root}/tail", f"{self.ddl}, {MARKS_DDL}", recursiveFileLookup="true")

    def _runs(self, names: Sequence[str]) -> DataFrame:
        ddl = f"{self.ddl}, {MARKS_DDL}"
        if not names:
            return self.spark.createDataFrame([], ddl)
        return self.spark.read.schema(ddl).parquet(*(f"{self.root}/runs/{n}" for n in names))

    def _newest(self, rows: DataFrame) -> DataFrame:
        w = Window.partitionBy(*self.identity).orderBy(F.desc("_stamp"), F.desc("_entry"))
        return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")

    def read(self) -> DataFrame:
        """One row per identity, the newest one."""
        runs = self._runs([r.run for r in self.state()[1]])
        return self._newest(runs.unionAll(self._tail())).drop("_stamp", "_entry", "_unit")

    def fold(self) -> dict:
        """Absorb the tail. Readers and writers may go on meanwhile; of two folds at once, one fails."""
        seq, runs = self.state()
        folded = read_if_there(self.spark, f"{self.root}/folded", FOLDED_DDL, recursiveFileLookup="true")
        unit = F.coalesce("_unit", "_entry")
        name = f"{seq + 1:08d}-{uuid.uuid4().hex}"
        # The tail is listed once: what arrives later stays in it.
        entries = f"{self.root}/folded/{name}"
        listed = self._tail().groupBy(unit.alias("entry")).agg(F.count_distinct("_entry").alias("entries"))
        listed.join(folded, "entry", "left_anti").coalesce(1).write.parquet(entries)
        new = self.spark.read.schema(FOLDED_DDL).parquet(entries).select("entry")
        rows = self._tail().withColumn("entry", unit).join(new, "entry", "left_semi").drop("entry")
        n = rows.count()
        if not n:
            remove_path(self.spark, entries)
            return dict(seq=seq, runs=len(runs), folded_rows=0)
        merged = []
        while runs and runs[-1].run_rows < self.fanout * n:
            merged.append(runs.pop().run)
            n += self._runs(merged[-1:]).count()
        self._newest(self._runs(merged).unionAll(rows.select(*self._runs([]).columns))).coalesce(1 + n // 1_000_000).write.parquet(f"{self.root}/runs/{name}")
        size = self._runs([name]).count()
        live = [(r.run, r.run_rows) for r in runs] + [(name, size)]
        self.spark.createDataFrame(live, "run STRING, run_rows BIGINT").coalesce(1).write.mode("errorifexists").parquet(f"{self.root}/state/seq={seq + 1}")
        return dict(seq=seq + 1, runs=len(live), folded_rows=size)

    def purge(self) -> int:
        """Delete what the newest state has absorbed. Call it when no reader is older than the last fold."""
        seq, runs = self.state()
        live = {r.run for r in runs}
        folds = read_if_there(self.spark, f"{self.root}/folded", FOLDED_DDL, recursiveFileLookup="true").select(
            "entry", "entries", F.element_at(F.split("_metadata.file_path", "/"), -2).alias("fold"))
        gone = folds.where(F.substring("fold", 1, 8) <= f"{seq:08d}")
        # As many names as there were single and bulk appends (and tasks of these) since the last purge.
        units = gone.groupBy("entry").agg(F.max(F.coalesce("entries", F.lit(1))).alias("entries")).collect()
        for r in units:
            remove_path(self.spark, f"{self.root}/tail/entry={r.entry}")
        for r in gone.select("fold").distinct().collect():
            remove_path(self.spark, f"{self.root}/folded/{r.fold}")
            if r.fold not in live:
                remove_path(self.spark, f"{self.root}/runs/{r.fold}")
        for r in read_if_there(self.spark, f"{self.root}/state", STATE_DDL).where(F.col("seq") < seq).select("seq").distinct().collect():
            remove_path(self.spark, f"{self.root}/state/seq={r.seq}")
        for n in self._absorbed(live):
            remove_path(self.spark, f"{self.root}/runs/{n}")
        return sum(r.entries for r in units)

    def _absorbed(self, live: set[str]) -> list[str]:
        files = self.spark.read.schema("_stamp BIGINT").option("recursiveFileLookup", "true").parquet(f"{self.root}/runs") if live else None
        if files is None:
            return []
        seq = self.state()[0]
        found = files.select(F.element_at(F.split("_metadata.file_path", "/"), -2).alias("run")).distinct()
        return [r.run for r in found.collect() if r.run not in live and r.run[:8] <= f"{seq:08d}"]
