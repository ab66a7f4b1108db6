"""Tables whose versions are lists of files.

A version names its data files and its masks; one row of the version log makes it readable. A write adds files
and inherits the others by reference, so it touches only what it changes: a merge rewrites the partitions that its
keys lie in, a delta masks old rows by their position in a file, compaction rewrites files that are small or masked.
Until its row is in the log, a write has changed nothing that a reader sees.

A list has a row of about 100 bytes per file. Writers collect what they change: paths of files, partition slots.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.load import merge_cow, touched_partitions
from tidemark.sources.log import TieredLog
from tidemark.sources.storage import content_checksum, list_files, measured_write

VERSIONS_DDL = "seq BIGINT, operation STRING, files STRING, written_rows BIGINT"
FILES_DDL = "kind STRING, slot STRING, part STRING, path STRING, bytes BIGINT, filled BOOLEAN"
MASKS_DDL = "file STRING, bucket BIGINT, bits BINARY"
#: Positions of one bitmap: fixed by Spark's bitmap functions.
BUCKET = 32_768
#: Bytes that tell files apart: name (67, with five digits of a task), bin (25) and slot (22).
TAIL = 120


def slot_of(part: str) -> Column:
    """Folder name of a partition value: plain characters whatever the value holds, NULL included."""
    return F.substring(F.sha2(F.coalesce(F.concat(F.lit("v"), F.col(part).cast("string")), F.lit("null")), 256), 1, 16)


def _same_file(path: Column) -> Column:
    """Paths to one form: listings and row metadata write schemes and special characters differently.

    The last bytes hold the file's name, with the id of its write, and the folders of its partition and bin; no other
    file of the table ends like that. Every row that is read with its position passes here: bytes are cut faster than text.
    """
    return F.substring(path.cast("binary"), -TAIL, TAIL)


class FileTable:
    """A table of ``schema`` under ``root``, partitioned by one column."""

    def __init__(self, spark: SparkSession, root: str, schema: T.StructType, part: str):
        self.spark, self.root, self.schema, self.part = spark, root.rstrip("/"), schema, part
        self.log = TieredLog(spark, f"{self.root}/versions", VERSIONS_DDL, ["seq"])
        self._known: dict = {}

    # Versions

    def version(self, seq: int | None = None):
        """Row of a version, the newest one by default; None before the first. A version never changes: its row is read once."""
        if seq in self._known:
            return self._known[seq]
        rows = self.log.read()
        rows = rows.where(F.col("seq") == seq) if seq is not None else rows.orderBy(F.desc("seq")).limit(1)
        for found in rows.collect():
            self._known[found.seq] = found
            return found
        return None

    def files(self, seq: int | None = None) -> DataFrame:
        """Files of a version: kind (DATA or MASK), slot, part, path, bytes, filled."""
        v = self.version(seq)
        if v is None:
            return self.spark.createDataFrame([], FILES_DDL)
        return self.spark.read.schema(FILES_DDL).parquet(f"{self.root}/files/{v.files}")

    def _publish(self, files: DataFrame, operation: str, base: int, rows: int) -> int:
        """Write the list, then its row. A version that somebody else has published meanwhile is an error."""
        name = uuid.uuid4().hex
        files.coalesce(1).write.parquet(f"{self.root}/files/{name}")
        self.log.append([dict(seq=base + 1, operation=operation, files=name, written_rows=rows)], entry=f"v{base + 1}")
        return base + 1

    def _base(self) -> int:
        v = self.version()
        return v.seq if v else 0

    # Reading

    def read(self, seq: int | None = None, where: str | None = None) -> DataFrame:
        """Rows of a version. ``where`` is a condition on ``part`` (text) that picks partitions by the list alone."""
        files = self.files(seq)
        return self._rows(files.where(where) if where else files, files).drop("_file", "_row")

    def _rows(self, files: DataFrame, every: DataFrame | None = None) -> DataFrame:
        """Unmasked rows of the listed data files with their position (_file, _row)."""
        paths = [r.path for r in files.where("kind = 'DATA'").select("path").collect()]
        if not paths:
            return self.spark.createDataFrame([], self.schema).select("*", F.lit(b"").alias("_file"), F.lit(0).cast("bigint").alias("_row"))
        rows = self.spark.read.schema(self.schema).parquet(*paths).select(
            *self.schema.names, _same_file(F.col("_metadata.file_path")).alias("_file"), F.col("_metadata.row_index").alias("_row"))
        masks = [r.path for r in (every or files).where("kind = 'MASK'").select("path").collect()]
        if not masks:
            return rows
        return unmasked(rows, self.spark.read.schema(MASKS_DDL).parquet(*masks))

    # Writing

    def _write(self, df: DataFrame, filled: Column | None = None, by: Sequence[str] = (),
               parts: DataFrame | None = None) -> tuple[DataFrame, int, str | None]:
        """(list of new files, rows, checksum). Large partitions are split, small ones share no file.

        Where ``parts`` (slot, part) are known, ``df`` has its slots and no row is asked for its partition again.
        """
        folder = f"{self.root}/data/{uuid.uuid4().hex}"
        if parts is None:
            df = df.withColumn("slot", slot_of(self.part))
        spread = df.repartition(*by) if by else df.hint("rebalance", "slot")
        facts = measured_write(spread, folder, "errorifexists", columns=self.schema.names, partition_by=["slot", *by])
        if not facts["rows"]:
            return self.spark.createDataFrame([], FILES_DDL), 0, None
        if parts is None:
            # The slot is a digest: once per value, not per row.
            values = self.spark.read.schema(self.schema).parquet(folder).select(F.col(self.part).cast("string").alias("part")).distinct()
            # Never NULL, which the join would otherwise test on every row.
            parts = values.select(F.coalesce(slot_of("part"), F.lit("")).alias("slot"), "part")
        listed = list_files(self.spark, folder).select(
            "path", "bytes", F.regexp_extract("path", "/slot=([^/]+)/", 1).alias("slot"), F.regexp_extract("path", "/bin=([^/]+)/", 1).alias("bin"))
        listed = listed.join(parts, "slot")
        flag = filled if filled is not None else F.lit(False)
        return listed.select(F.lit("DATA").alias("kind"), "slot", "part", "path", "bytes", flag.alias("filled")), facts["rows"], facts["checksum"]

    def create(self, df: DataFrame, operation: str = "FULL") -> int:
        """A new version that holds the rows of ``df`` only."""
        base = self._base()
        files, rows, _ = self._write(df.select(*self.schema.names))
        return self._publish(files, operation, base, rows)

    def merge(self, batch: DataFrame, pk: Sequence[str], when: str | None = None) -> dict:
        """Copy-on-write upsert that rewrites only the partitions its keys lie in or go to.

        ``batch`` has one row per key. A key whose partition changes leaves the old one. Other partitions keep their files.
        """
        base, batch = self._base(), batch.select(*self.schema.names)
        every = self.files(base or None)
        keys = self._rows(every).select(*dict.fromkeys([*pk, self.part]))
        touched = touched_partitions(batch, keys, pk, self.part).select(slot_of(self.part).alias("slot"))
        slots = [r.slot for r in touched.collect()]
        hit = F.col("slot").isin(slots) & (F.col("kind") == "DATA")
        old = self._rows(every.where(hit), every).select(*self.schema.names)
        new, rows, _ = self._write(merge_cow(old, batch, pk, when))
        seq = self._publish(every.where(~hit).unionByName(new), "MERGE", base, rows)
        return dict(seq=seq, partitions=len(slots), written_rows=rows)

    def merge_delta(self, batch: DataFrame, pk: Sequence[str], deletes: DataFrame | None = None) -> dict:
        """Merge-on-read upsert: write the rows of ``batch`` and mask the older rows of their keys by position.

        ``deletes`` holds further keys to mask. Keys are looked up once, here; reads only compare positions.
        """
        base, batch = self._base(), batch.select(*self.schema.names)
        every = self.files(base or None)
        keys = batch.select(*pk) if deletes is None else batch.select(*pk).unionByName(deletes.select(*pk))
        gone = self._rows(every).select(*pk, "_file", "_row").join(keys, list(pk), "left_semi")
        # Sorted by bucket first: a number, where the names of files begin alike.
        bits = gone.groupBy(F.floor(F.col("_row") / BUCKET).alias("bucket"), "_file").agg(
            F.bitmap_construct_agg(F.col("_row") % BUCKET).alias("bits")).select(F.col("_file").cast("string").alias("file"), "bucket", "bits")
        folder = f"{self.root}/masks/{uuid.uuid4().hex}"
        bits.write.parquet(folder)
        mask = list_files(self.spark, folder).select(
            F.lit("MASK").alias("kind"), F.lit(None).cast("string").alias("slot"), F.lit(None).cast("string").alias("part"), "path", "bytes",
            F.lit(False).alias("filled"))
        new, rows, _ = self._write(batch)
        seq = self._publish(every.unionByName(new).unionByName(mask), "DELTA", base, rows)
        return dict(seq=seq, written_rows=rows)

    def compact(self, target_bytes: int = 512 << 20, smallest: float = 0.75) -> dict:
        """Rewrite files that are small or have masked rows; all others keep their paths.

        Without anything to do, no version is written. The rows are checked against what was read.
        """
        base = self._base()
        every = self.files(base or None)
        masks = [r.path for r in every.where("kind = 'MASK'").select("path").collect()]
        masked = self.spark.read.schema(MASKS_DDL).parquet(*masks).select("file").distinct() if masks else self.spark.createDataFrame([], "file STRING")
        plan = compaction_plan(every.where("kind = 'DATA'"), masked, target_bytes, smallest)
        folder = f"{self.root}/plans/{uuid.uuid4().hex}"
        plan.coalesce(1).write.parquet(folder)
        plan = self.spark.read.schema(plan.schema).parquet(folder)
        if plan.isEmpty():
            return dict(seq=base, files_before=0, files_after=0)
        rows = self._rows(every.join(plan.select("path"), "path", "left_semi"), every)
        bins = plan.select(_same_file(F.col("path")).alias("_file"), "slot", "bin")
        parts = every.where("kind = 'DATA'").select("slot", "part").distinct()
        before = rows.agg(F.count("*").alias("rows"), content_checksum(self.schema.names).alias("checksum")).first()
        sizes = plan.groupBy("bin").agg(F.first("bin_bytes").alias("bin_bytes"))
        filled = F.col("bin").cast("bigint").isin([r.bin for r in sizes.where(F.col("bin_bytes") >= target_bytes).collect()])
        new, n, checksum = self._write(rows.join(bins, "_file").drop("_file", "_row"), filled, ["bin"], parts)
        if (n, checksum) != (before.rows, before.checksum):
            raise RuntimeError("compaction did not keep the rows")
        kept = every.where("kind = 'DATA'").join(plan.select("path"), "path", "left_anti").select(*every.columns)
        seq = self._publish(kept.unionByName(new.select(*every.columns)), "COMPACT", base, n)
        after = self.files(seq).where("kind = 'DATA'").join(every.select("path"), "path", "left_anti").count()
        return dict(seq=seq, files_before=plan.count(), files_after=after)


def compaction_plan(files: DataFrame, masked: DataFrame, target_bytes: int, smallest: float = 0.75) -> DataFrame:
    """(path, slot, bin, bin_bytes): files to rewrite and the new file that each goes to.

    Candidates are files with masked rows, and files below ``smallest`` of the target that no earlier compaction has
    filled. In order of size they fill bins of the target size within their partition. A bin of one file without
    masked rows is left as it is.
    """
    mark = masked.select(_same_file(F.col("file")).alias("_file"), F.lit(True).alias("_masked"))
    rows = files.withColumn("_file", _same_file(F.col("path"))).join(mark, "_file", "left")
    has = F.coalesce("_masked", F.lit(False))
    rows = rows.where(has | ((F.col("bytes") < F.lit(smallest * target_bytes)) & ~F.col("filled")))
    order = Window.partitionBy("slot").orderBy("bytes", "path")
    rows = rows.withColumn("_nth", F.floor((F.sum("bytes").over(order) - F.col("bytes")) / F.lit(target_bytes)))
    bin_ = Window.partitionBy("slot", "_nth")
    rows = rows.withColumn("bin_bytes", F.sum("bytes").over(bin_)).withColumn("_work", (F.count("*").over(bin_) > 1) | F.bool_or(has).over(bin_))
    return rows.where("_work").select("path", "slot", F.xxhash64("slot", "_nth").alias("bin"), "bin_bytes")


def unmasked(rows: DataFrame, masks: DataFrame) -> DataFrame:
    """Rows (with _file, _row) whose position no mask names. Masks are one bitmap per file and 32,768 rows.

    A bitmap takes four kilobytes, so Spark broadcasts masks of usual size and the rows stay where they are. It is turned
    into 512 numbers first, one per eight bytes, so that a row looks at one number and no text is made per row.
    """
    bits = masks.groupBy(_same_file(F.col("file")).alias("_file"), F.col("bucket").alias("_bucket")).agg(F.bitmap_or_agg("bits").alias("_bits"))
    words = F.transform(F.sequence(F.lit(0), F.lit(BUCKET // 64 - 1)), lambda n: F.conv(
        F.hex(F.substring("_bits", n * 8 + 1, F.lit(8))), 16, -10).cast("bigint"))
    bits = bits.select("_file", "_bucket", words.alias("_words"))
    at = F.col("_row").bitwiseAND(F.lit(BUCKET - 1)).cast("int")
    # Within a number the first byte is the highest.
    bit = F.lit(56) - F.shiftleft(F.shiftright(at, 3).bitwiseAND(F.lit(7)), 3) + at.bitwiseAND(F.lit(7))
    hit = F.coalesce(F.getbit(F.get("_words", F.shiftright(at, 6)), bit) == 1, F.lit(False))
    joined = rows.withColumn("_bucket", F.shiftright("_row", 15)).join(bits, ["_file", "_bucket"], "left")
    return joined.where(~hit).select(*rows.columns)
