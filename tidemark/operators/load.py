"""Full, append and merge load semantics."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import timedelta
from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.canon import ColumnRule, row_hash, rules_from_schema
from tidemark.operators.ordered import BIN, HEAVY, Bins, with_bins
from tidemark.operators.windows import as_col, inside
from tidemark.session import materialised


def latest_first(df: DataFrame, order: str, rules: Sequence[ColumnRule] | None = None) -> list[Column]:
    """The standard dedup order: newest first, NULLs last, row hash as tie-break."""
    return [F.col(order).desc_nulls_last(), row_hash(rules or rules_from_schema(df.schema)).desc()]


def dedup_latest(df: DataFrame, pk: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """First row per key in ``order``. Spark keeps one row per key before the shuffle already."""
    w = Window.partitionBy(*pk).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def _newest(df: DataFrame, keys: Sequence[str], updated: str, digest: Column) -> DataFrame:
    """Newest row per key; only rows that tie on ``updated`` are hashed."""
    w = Window.partitionBy(*keys)
    top = df.withColumn("_rk", F.rank().over(w.orderBy(F.col(updated).desc_nulls_last()))).where("_rk = 1")
    tied = top.drop("_rk").withColumn("_n", F.count(F.lit(1)).over(w))
    order = w.orderBy(F.when(F.col("_n") > 1, digest).desc())
    return tied.withColumn("_rn", F.row_number().over(order)).where("_rn = 1").drop("_rn", "_n")


def dedup_standard(df: DataFrame, pk: Sequence[str], updated: str,
                   rules: Sequence[ColumnRule] | None = None) -> DataFrame:
    """One row per key by ``updated DESC NULLS LAST, row_hash DESC``, hashing as little as possible.

    The row hash costs far more than a shuffle and is only needed to break ties. A first pass works
    per (key, input partition), so even a key whose copies fill a third of the table is reduced in
    pieces no larger than one partition; the second pass then sees at most one row per partition.
    """
    digest = row_hash(rules or rules_from_schema(df.schema))
    pieces = df.withColumn("_part", F.spark_partition_id())
    local = _newest(pieces, [*pk, "_part"], updated, digest).drop("_part")
    return _newest(local, pk, updated, digest)


def pk_cardinality(df: DataFrame, pk: Sequence[str]) -> DataFrame:
    """Rows and distinct keys, which must be equal after a dedup."""
    per_key = df.groupBy(*pk).agg(F.count(F.lit(1)).alias("_n"))
    return per_key.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).cast("bigint").alias("row_count"),
        F.count(F.lit(1)).alias("pk_count"),
    ).withColumn("is_unique", F.col("row_count") == F.col("pk_count"))


def overlap_anti_join(
    batch: DataFrame, target: DataFrame, pk: Sequence[str], wm: str, original_low, overlap: timedelta,
) -> DataFrame:
    """Batch rows not yet in the target's overlap slice ``[original_low - overlap, original_low)``.

    Only that slice of the target is read. ``overlap_recovered`` marks rows below ``original_low``.
    """
    low = as_col(original_low)
    slice_ = target.where(inside(wm, low - F.lit(overlap), low)).select(*pk)
    return batch.join(slice_, list(pk), "left_anti").withColumn(
        "overlap_recovered", F.col(wm) < low)


def overlap_counts(
    batch: DataFrame, target: DataFrame, pk: Sequence[str], wm: str, original_low, overlap: timedelta,
) -> DataFrame:
    """Rows in, kept, dropped as already loaded, and recovered late rows, of one overlap anti join."""
    low = as_col(original_low)
    slice_ = target.where(inside(wm, low - F.lit(overlap), low)).select(*pk, F.lit(1).alias("_hit"))
    tagged = batch.select(*pk, wm).join(slice_.dropDuplicates(list(pk)), list(pk), "left")
    new = F.col("_hit").isNull()
    return tagged.agg(
        F.count(F.lit(1)).alias("extracted_rows"),
        F.count_if(~new).alias("anti_join_dropped_rows"),
        F.count_if(new).alias("written_rows"),
        F.count_if(new & (F.col(wm) < low)).alias("overlap_recovered_rows"))


def _same_keys(pk: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(f"t.{k}") == F.col(f"b.{k}") for k in pk])


def merge_cow(target: DataFrame, batch: DataFrame, pk: Sequence[str], when: str | None = None) -> DataFrame:
    """Copy-on-write upsert: matched rows replaced, the rest inserted, unmatched target rows kept.

    Written as joins of the target with the batch plus a union, so that a small batch is broadcast and the
    target is never shuffled. ``when`` is the update condition over ``t`` and ``b``; target rows whose match
    fails it are kept and the match ignored. It is evaluated once per matched pair, and both the rows kept
    and the rows taken follow from the keys that this one evaluation names.
    """
    if when is None:
        kept = target.join(batch.select(*pk), list(pk), "left_anti")
        return kept.unionByName(batch.select(*target.columns))
    batch = materialised(batch)  # one evaluation, so that a tie in its dedup cannot be decided twice
    take = F.coalesce(F.expr(when), F.lit(False))
    refused = materialised(target.alias("t").join(batch.alias("b"), _same_keys(pk)).where(~take).select(
        *[F.col(f"b.{k}").alias(k) for k in pk]).distinct())
    taken = batch.join(refused, list(pk), "left_anti")
    kept = target.join(taken.select(*pk), list(pk), "left_anti")
    return kept.unionByName(taken.select(*target.columns))


def merge_into(table: str, batch: DataFrame, pk: Sequence[str], when: str | None = None) -> None:
    """The same upsert through ``MERGE INTO`` for catalogs whose tables support it."""
    on = reduce(lambda a, b: a & b, [F.col(f"{table}.{k}") == F.col(f"b.{k}") for k in pk])
    writer = batch.alias("b").mergeInto(table, on)
    matched = writer.whenMatched(F.expr(when)) if when else writer.whenMatched()
    matched.updateAll().whenNotMatched().insertAll().merge()


def read_mor(base: DataFrame, deltas: DataFrame, pk: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Merge-on-read: the newest delta per key wins over the base.

    Only the deltas are shuffled by key; the base meets their keys in an anti join, whose small side is broadcast.
    """
    newest = materialised(dedup_latest(deltas.select(*base.columns), pk, order))  # read twice, ranked once
    return base.join(newest.select(*pk), list(pk), "left_anti").unionByName(newest)


def apply_soft_delete(df: DataFrame, col: str, value, action: str = "FLAG") -> DataFrame:
    """Mark (``FLAG``) or remove (``DELETE``) rows whose flag column holds ``value``."""
    gone = F.coalesce(F.col(col) == F.lit(value), F.lit(False))
    if action == "FLAG":
        return df.withColumn("is_deleted", gone)
    if action == "DELETE":
        return df.where(~gone)
    raise ValueError(f"unknown action {action!r}")


def pk_reconcile(src_pks: DataFrame, target: DataFrame, pk: Sequence[str]) -> DataFrame:
    """Keys to delete (only in the target) and keys missing there, with ``pk_action``."""
    src, tgt = src_pks.select(*pk), target.select(*pk)
    gone = tgt.join(src, list(pk), "left_anti").withColumn("pk_action", F.lit("DELETE"))
    new = src.join(tgt, list(pk), "left_anti").withColumn("pk_action", F.lit("MISSING"))
    return gone.unionByName(new)


def delete_reconciled(target: DataFrame, src_pks: DataFrame, pk: Sequence[str]) -> DataFrame:
    """Target without the rows whose key the source no longer has."""
    return target.join(src_pks.select(*pk), list(pk), "left_semi")


def audit(src: DataFrame, tgt: DataFrame, pk: Sequence[str], updated: str, low, high) -> DataFrame:
    """Keys of a rolling horizon that are missing or stale in the target.

    The horizon applies to the source only: a stale target row may still carry an older time.
    Rows committed later than the horizon are not seen; use a census for a full claim.
    """
    s = src.where(inside(updated, low, high)).select(*pk, F.col(updated).alias("source_updated"))
    # The target side of the horizon's keys first: an inner join, in which the small side is broadcast.
    t = tgt.select(*pk, F.col(updated).alias("target_updated")).join(s.select(*pk).distinct(), list(pk), "left_semi")
    t = t.withColumn("_in_target", F.lit(True))
    state = F.when(F.col("_in_target").isNull(), "MISSING").when(
        F.coalesce(F.col("target_updated") < F.col("source_updated"), F.lit(True)), "STALE")
    return (
        s.join(t, list(pk), "left").withColumn("audit_state", state)
        .where(F.col("audit_state").isNotNull()).drop("_in_target")
    )


def repair(src: DataFrame, tgt: DataFrame, pk: Sequence[str], findings: DataFrame) -> DataFrame:
    """Merge the source rows behind the audit's findings into the target."""
    rows = src.join(findings.select(*pk), list(pk), "left_semi")
    return merge_cow(tgt, rows, pk)


def empty_policy(counts: DataFrame, policy_col: str = "on_empty_source") -> DataFrame:
    """Outcome of a full load. Zero rows never replace the target; NULL policy means FAIL."""
    keep = F.col(policy_col) == "RETAIN_PREVIOUS"
    empty = F.col("extracted_rows") == 0
    return (
        counts.withColumn("write_target", ~empty)
        .withColumn(
            "outcome",
            F.when(~empty, "COMMIT").when(keep, "FINALIZED_NO_DATA").otherwise("NO_COMMIT(EMPTY_FULL)"))
        .withColumn("target_unchanged", empty)
    )


class CastRule:
    """Standard type of one source column.

    ``source_type`` is the source's type text: NUMBER, NUMBER(p,s), DATE, TIMESTAMP(n),
    TIMESTAMP WITH TIME ZONE, VARCHAR2(n), CHAR(n), CLOB, RAW, BLOB, BINARY_DOUBLE. A NUMBER that needs more
    than 38 digits stays text.
    """

    def __init__(self, name: str, source_type: str, output: str | None = None):
        self.name, self.output = name, output or name
        text = source_type.upper().strip()
        self.base, _, rest = text.partition("(")
        self.base = self.base.strip()
        inner, _, tail = rest.partition(")")
        self.args = [int(a) for a in inner.split(",") if a.strip()]
        self.zoned = "TIME ZONE" in text
        if self.base in ("LONG", "LONG RAW"):
            raise ValueError(f"LONG_NOT_EXTRACTABLE: {name}")

    @property
    def scale(self) -> int:
        return self.args[1] if len(self.args) > 1 else 0

    def spark_type(self) -> T.DataType:
        if self.base == "NUMBER":
            if not self.args:
                return T.DecimalType(38, 10)
            precision, scale = self.args[0], self.scale
            # A negative scale adds digits before the point; one above the precision leaves only a fraction.
            width = precision - scale if scale < 0 else max(precision, scale)
            return T.DecimalType(width, max(scale, 0)) if width <= 38 else T.StringType()
        if self.base == "DATE":
            return T.TimestampNTZType()
        if self.base.startswith("TIMESTAMP"):
            return T.TimestampType() if self.zoned else T.TimestampNTZType()
        if self.base in ("RAW", "BLOB"):
            return T.BinaryType()
        if self.base == "BINARY_DOUBLE":
            return T.DoubleType()
        return T.StringType()

    def value(self) -> Column:
        raw = F.col(self.name)
        kind = self.spark_type()
        if isinstance(kind, T.StringType):
            text = raw.cast("string")
            return F.when(text != "", text)
        if isinstance(kind, T.DecimalType):
            number = raw.cast("string").try_cast(kind)
            if self.args and self.scale < 0:
                return F.round(number, self.scale).try_cast(kind)
            if self.args and self.scale > self.args[0]:
                top = Decimal(10) ** (self.args[0] - self.scale)
                return F.when(F.abs(number) < F.lit(top), number)
            return number
        if isinstance(kind, T.BinaryType):
            return raw.cast("binary")
        return raw.try_cast(kind)

    def warning(self) -> Column:
        """Text of what the standard type cannot hold as is, or NULL."""
        raw, out = F.col(self.name), self.value()
        label = F.lit(self.output + ":")
        lost = F.when(raw.isNotNull() & (raw.cast("string") != "") & out.isNull(),
                      F.concat(label, F.lit("OUT_OF_RANGE")))
        kind = self.spark_type()
        if isinstance(kind, T.StringType) and self.base in ("VARCHAR2", "VARCHAR", "CHAR") and self.args:
            return F.when(F.char_length(out) > self.args[0], F.concat(label, F.lit("TOO_LONG")))
        if isinstance(kind, (T.TimestampNTZType, T.TimestampType)):
            return F.coalesce(lost, F.when(F.year(out) >= 9999, F.concat(label, F.lit("SENTINEL_DATE"))))
        if isinstance(kind, (T.StringType, T.BinaryType)):
            return F.lit(None).cast("string")
        if isinstance(kind, T.DecimalType):
            return F.coalesce(lost, F.when(self._rounded(raw.cast("string"), out), F.concat(label, F.lit("ROUNDED"))))
        return lost

    def _rounded(self, text: Column, out: Column) -> Column:
        """Whether the number differs from its text: by its digits, or as a double if written with an exponent."""
        digits = F.length(F.regexp_extract(text, r"\.(\d*?)0*\s*$", 1)) > max(self.scale if self.args else 10, 0)
        if self.args and self.scale < 0:
            digits = digits | (out != text.try_cast(T.DecimalType(38, 0)))
        return out.isNotNull() & F.when(text.rlike("[eE]"), out.cast("double") != text.try_cast("double")).otherwise(digits)


def cast_standard(df: DataFrame, rules: Sequence[CastRule]) -> DataFrame:
    """Cast to the standard types; ``cast_warnings`` lists what did not fit, per row."""
    warnings = F.array_compact(F.array(*[r.warning() for r in rules]))
    return df.select(*[r.value().alias(r.output) for r in rules], warnings.alias("cast_warnings"))


def apply_mapping(df: DataFrame, mapping: dict[str, str], where: str | None = None) -> DataFrame:
    """Business filter, then target columns as simple expressions over source columns."""
    rows = df.where(where) if where else df
    return rows.select(*[F.expr(e).alias(name) for name, e in mapping.items()])


def schema_drift(registered: DataFrame, observed: DataFrame) -> DataFrame:
    """Column changes per table: ADDED, REMOVED, TYPE_CHANGED, NARROWED.

    Both sides: table_id, column_name, data_type, length.
    """
    r = registered.select("table_id", "column_name", F.col("data_type").alias("registered_type"),
                          F.col("length").alias("registered_length"), F.lit(True).alias("_r"))
    o = observed.select("table_id", "column_name", F.col("data_type").alias("observed_type"),
                        F.col("length").alias("observed_length"), F.lit(True).alias("_o"))
    change = (
        F.when(F.col("_r").isNull(), "ADDED").when(F.col("_o").isNull(), "REMOVED")
        .when(F.col("registered_type") != F.col("observed_type"), "TYPE_CHANGED")
        .when(F.col("observed_length") < F.col("registered_length"), "NARROWED"))
    return (
        r.join(o, ["table_id", "column_name"], "full_outer").withColumn("drift", change)
        .where(F.col("drift").isNotNull()).drop("_r", "_o")
    )


def schema_digest(columns: DataFrame) -> DataFrame:
    """Digest of a table's column set, in no particular order.

    The SHA-256 of every column line is cut into eight 32-bit words that are summed, so columns are
    never gathered; count and sums are hashed again.
    """
    line = F.concat_ws(":", "column_name", "data_type", F.col("length").cast("string"))
    hashed = columns.select("table_id", F.sha2(line, 256).alias("_d"))
    words = [F.sum(F.conv(F.substring("_d", 1 + 8 * i, 8), 16, 10).cast("bigint")).alias(f"_w{i}") for i in range(8)]
    sums = hashed.groupBy("table_id").agg(F.count(F.lit(1)).alias("column_count"), *words)
    text = F.concat_ws("|", "column_count", *[f"_w{i}" for i in range(8)])
    return sums.select("table_id", "column_count", F.sha2(text, 256).alias("schema_digest"))


def replay_append(
    target: DataFrame, rows: DataFrame, mode: str, pk: Sequence[str] = (), part: str | None = None,
) -> DataFrame:
    """Replay of an append table: ``MERGE_REPAIR`` by key, or ``REPLACE_PARTITIONS``. Never a blind insert."""
    if mode == "MERGE_REPAIR":
        return merge_cow(target, rows, pk)
    if mode == "REPLACE_PARTITIONS":
        touched = rows.select(part).distinct()
        return target.join(touched, part, "left_anti").unionByName(rows.select(*target.columns))
    raise ValueError(f"unknown replay mode {mode!r}")


def touched_partitions(batch: DataFrame, target: DataFrame, pk: Sequence[str], part: str) -> DataFrame:
    """Partitions a merge rewrites: where the batch rows go, and where their old versions are."""
    old = target.select(*pk, part).join(batch.select(*pk), list(pk), "left_semi").select(part).distinct()
    new = batch.select(part).distinct()
    flagged = new.withColumn("_new", F.lit(True)).unionByName(old.withColumn("_new", F.lit(False)))
    return flagged.groupBy(part).agg(
        F.bool_or(F.col("_new")).alias("receives_rows"), F.bool_or(~F.col("_new")).alias("loses_rows"))


def row_count_drift(stats: DataFrame, keys: Sequence[str], at: str, n: int, ratio: float, bins: Bins = None) -> DataFrame:
    """Tables whose row count fell below ``ratio`` of the average of the ``n`` earlier observations.

    A frame of ``n`` rows per (key, bin); the first rows of a bin also see the last ``n`` of the bins before.
    """
    keys = list(keys)
    binned = with_bins(stats, keys, at, bins)
    inside = Window.partitionBy(*keys, BIN).orderBy(at)
    frame = inside.rowsBetween(-n, -1)
    local = binned.withColumns({
        "_sum": F.coalesce(F.sum("row_count").over(frame), F.lit(0)), "_seen": F.row_number().over(inside) - 1,
        "_known": F.count("row_count").over(frame)})
    place = Window.partitionBy(*keys, BIN).orderBy(F.desc(at))
    tails = binned.where(HEAVY).withColumn("_rn", F.row_number().over(place)).where(F.col("_rn") <= n)
    tails = tails.groupBy(*keys, BIN).agg(F.array_sort(F.collect_list(F.struct(F.col(at), "row_count"))).alias("_tail"))
    before = Window.partitionBy(*keys).orderBy(BIN).rowsBetween(-n, -1)  # every bin holds a row at least
    carried = tails.select(*keys, BIN, F.flatten(F.collect_list("_tail").over(before)).alias("_carried"))
    joined = local.join(carried, [*keys, BIN], "left")
    missing = F.greatest(F.lit(0), F.lit(n) - F.col("_seen"))
    far = F.coalesce(F.transform(F.col("_carried"), lambda x: x["row_count"]), F.array().cast("array<bigint>"))
    far = F.filter(F.slice(far, F.greatest(F.lit(1), F.size(far) - missing + 1), missing), lambda x: x.isNotNull())
    total = F.col("_sum") + F.aggregate(far, F.lit(0).cast("bigint"), lambda a, x: a + x)
    average = total / F.nullif(F.col("_known") + F.size(far), F.lit(0))
    return (
        joined.withColumn("trailing_avg", average)
        .where(F.col("row_count") < F.col("trailing_avg") * F.lit(ratio))
        .select(*stats.columns, "trailing_avg", (F.col("row_count") / F.col("trailing_avg")).alias("drift_ratio"))
    )
