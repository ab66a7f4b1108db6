"""Ordered per-key scans that stay parallel when one key owns most of the rows.

``Window.partitionBy(key)`` sends a whole key to one task. That is fine for ordinary keys. A count finds keys too
large for one task; quantiles of their rows cut their order into bins of about equal row counts, the window runs per
(key, bin), and one summary row per bin carries across bins. Without such keys the plan is the plain window.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.session import cut_lineage

BIN, HEAVY = "_bin", "_heavy"
#: Rows of a key that one task handles, and of a bin of a larger key.
ROWS_PER_BIN = 250_000
#: Bins of one key at most. Sub-bins split ties of the first order column.
MOST_BINS, SUB_BINS = 10_000, 1 << 20
#: Bin bounds (8 bytes each) are broadcast up to this number of keys, and joined by a shuffle beyond it.
MOST_BROADCAST = 2_000

# How the ``bins`` argument of the functions below is read: rows per bin, ROWS_PER_BIN if None.
Bins = int | None


def epoch_us(column: Column | str) -> Column:
    """Microseconds since the epoch of a timestamp column (wall-clock values read as UTC)."""
    c = F.col(column) if isinstance(column, str) else column
    return F.unix_micros(c.cast("timestamp"))


def _position(df: DataFrame, column: str) -> Column:
    kind = df.schema[column].dataType.typeName()
    if kind.startswith("timestamp"):
        return epoch_us(column)
    if kind == "date":
        return F.unix_date(column).cast("bigint")
    return F.col(column)


def heavy_keys(df: DataFrame, keys: Sequence[str], column: str, rows_per_bin: int) -> DataFrame:
    """Keys with more than ``rows_per_bin`` rows and the upper bounds of their bins, by quantiles of their rows."""
    large = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > rows_per_bin)
    large = large.withColumn("_bins", F.least(F.lit(MOST_BINS), F.ceil(F.col("_n") * 2 / rows_per_bin)).cast("int"))
    return large


def _bounds(rows: DataFrame, keys: Sequence[str], pos: Column, sizes: DataFrame, name: str) -> DataFrame:
    """(keys, bounds): distinct quantiles of ``pos`` per key, as many as the key's bins ask for."""
    most = sizes.agg(F.max("_bins")).first()[0]
    steps = [i / most for i in range(1, most)]
    found = rows.groupBy(*keys).agg(F.percentile_approx(pos, steps or [0.5], 20 * most).alias("_grid"))
    # Every key gets the finest grid; a smaller one keeps every so many of its bounds.
    pick = found.join(sizes.select(*keys, "_bins"), list(keys))
    stride = F.greatest(F.lit(1), F.floor(F.lit(most) / F.col("_bins"))).cast("int")
    return pick.select(*keys, F.array_distinct(F.filter("_grid", lambda x, i: (i + 1) % stride == 0)).alias(name))


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= MOST_BROADCAST else df


def with_bins(df: DataFrame, keys: Sequence[str], column: str, bins: Bins = None, then: str | None = None) -> DataFrame:
    """Add the bin of each row; rows that have one keep it, so chained scans bin once.

    One aggregation counts the keys first. ``then`` is the second order column: where a single value of the first
    fills more than a bin, its rows are cut by the second one.
    """
    if BIN in df.columns:
        return df
    keys, limit = list(keys), bins or ROWS_PER_BIN
    large = cut_lineage(heavy_keys(df, keys, column, limit))
    n = large.count()
    if not n:
        return df.withColumn(BIN, F.lit(0).cast("bigint")).withColumn(HEAVY, F.lit(False))
    pos = _position(df, column)
    heavy = df.join(_small(large.select(*keys), n), keys, "left_semi")
    bounds = cut_lineage(_bounds(heavy, keys, pos, large, "_bounds"))
    out = df.join(_small(bounds, n), keys, "left")
    first = F.when(F.col("_bounds").isNotNull(), _place(pos, F.col("_bounds"))).otherwise(F.lit(0))
    out = out.withColumn(BIN, first.cast("bigint") * SUB_BINS).withColumn(HEAVY, F.col("_bounds").isNotNull()).drop("_bounds")
    sortable = then is not None and isinstance(df.schema[then].dataType, (T.NumericType, T.TimestampType, T.TimestampNTZType, T.DateType))
    if not sortable:
        return out
    tie = [*keys, column]
    tied = cut_lineage(heavy_keys(heavy, tie, then, limit))
    n = tied.count()
    if not n:
        return out
    pos = _position(df, then)
    cuts = cut_lineage(_bounds(heavy.join(_small(tied.select(*tie), n), tie, "left_semi"), tie, pos, tied, "_cuts"))
    # A value that fills a bin is a bin of its own, so its cuts are ordered within it.
    return out.join(_small(cuts, n), tie, "left").withColumn(
        BIN, F.col(BIN) + F.when(F.col("_cuts").isNotNull(), 1 + _place(pos, F.col("_cuts"))).otherwise(0)).select(*df.columns, BIN, HEAVY)


def _place(pos: Column, bounds: Column) -> Column:
    """Number of bounds below ``pos``: a value that is a bound ends its bin."""
    return F.size(F.filter(bounds, lambda b: b < pos)).cast("bigint")


def _cols(names: Sequence[str]) -> list[Column]:
    return [F.col(n) for n in names]


def _join_carry(local: DataFrame, edges: Callable[[DataFrame], DataFrame], binned: DataFrame,
                keys: Sequence[str], bins: Bins) -> DataFrame:
    # The rows are dealt by (keys, bin) already; only the few summary rows are shuffled to them.
    return local.join(edges(binned.where(HEAVY)), [*keys, BIN], "left")


def _neighbour(df, keys, order, outputs, bins, forward):
    binned = with_bins(df, keys, order[0], bins, *order[1:2])
    ordering = _cols(order)
    w = Window.partitionBy(*keys, BIN).orderBy(*ordering)
    across = Window.partitionBy(*keys).orderBy(BIN)
    shift = F.lead if forward else F.lag
    pick = F.min_by if forward else F.max_by
    packed = F.struct(*[F.col(src).alias(out) for out, src in outputs.items()])

    def edges(rows):
        edge = rows.groupBy(*keys, BIN).agg(pick(packed, F.struct(*ordering)).alias("_edge"))
        return edge.select(*keys, BIN, shift("_edge").over(across).alias("_far"))

    local = binned.withColumn("_near", shift(packed).over(w))
    found = F.coalesce(F.col("_near"), F.col("_far"))
    return _join_carry(local, edges, binned, keys, bins).select(
        *df.columns, *[found[out].alias(out) for out in outputs])


def previous_values(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], outputs: dict[str, str],
    bins: Bins = None,
) -> DataFrame:
    """``lag`` per key: add ``outputs`` = {new column: source column of the previous row}.

    ``order`` must be non-NULL and unique within a key.
    """
    return _neighbour(df, keys, order, outputs, bins, forward=False)


def next_values(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], outputs: dict[str, str],
    bins: Bins = None,
) -> DataFrame:
    """``lead`` per key, see :func:`previous_values`."""
    return _neighbour(df, keys, order, outputs, bins, forward=True)


def running(
    df: DataFrame, keys: Sequence[str], order: Sequence[str],
    outputs: dict[str, tuple[str, str]], bins: Bins = None, inclusive: bool = True,
) -> DataFrame:
    """Running ``sum`` / ``max`` / ``last`` (last non-NULL) per key.

    ``outputs`` maps a new column to (function, source column). With ``inclusive=False`` the
    current row is left out. Sums start at 0, the others at NULL.
    """
    binned = with_bins(df, keys, order[0], bins, *order[1:2])
    ordering = _cols(order)
    end = Window.currentRow if inclusive else -1
    w = Window.partitionBy(*keys, BIN).orderBy(*ordering).rowsBetween(Window.unboundedPreceding, end)
    across = Window.partitionBy(*keys).orderBy(BIN).rowsBetween(Window.unboundedPreceding, -1)
    local_cols, edge_aggs, carry_cols, final = [], [], [], []
    for out, (fn, src) in outputs.items():
        near, edge, far = f"_n_{out}", f"_e_{out}", f"_f_{out}"
        if fn == "sum":
            local_cols.append(F.sum(src).over(w).alias(near))
            edge_aggs.append(F.sum(src).alias(edge))
            carry_cols.append(F.sum(edge).over(across).alias(far))
            zero = F.lit(0)
            final.append((F.coalesce(F.col(near), zero) + F.coalesce(F.col(far), zero)).alias(out))
        elif fn == "max":
            local_cols.append(F.max(src).over(w).alias(near))
            edge_aggs.append(F.max(src).alias(edge))
            carry_cols.append(F.max(edge).over(across).alias(far))
            final.append(F.greatest(near, far).alias(out))
        elif fn == "last":
            local_cols.append(F.last(src, ignorenulls=True).over(w).alias(near))
            ranked = F.when(F.col(src).isNotNull(), F.struct(*ordering))
            edge_aggs.append(F.max_by(src, ranked).alias(edge))
            carry_cols.append(F.last(edge, ignorenulls=True).over(across).alias(far))
            final.append(F.coalesce(near, far).alias(out))
        else:
            raise ValueError(f"unknown running function {fn!r}")

    def edges(rows):
        return rows.groupBy(*keys, BIN).agg(*edge_aggs).select(*keys, BIN, *carry_cols)

    local = binned.select("*", *local_cols)
    return _join_carry(local, edges, binned, keys, bins).select(*df.columns, *final)


def asof_join(
    left: DataFrame, right: DataFrame, keys: Sequence[str], left_at: str, right_at: str,
    values: Sequence[str], bins: Bins = None,
) -> DataFrame:
    """For each left row, ``values`` of the latest right row with ``right_at <= left_at``.

    Both sides are unioned into one ordered stream per key, so there is no range join. Right rows
    must be unique on (keys, right_at). Left rows without a match keep NULL.
    """
    at, side, pay = "_at", "_side", "_payload"
    row = F.struct(*[F.col(c) for c in left.columns])
    payload = F.struct(*[F.col(v) for v in values])
    l_rows = left.where(F.col(left_at).isNotNull()).select(
        *keys, F.col(left_at).alias(at), F.lit(1).alias(side), row.alias("_row"))
    r_rows = right.select(
        *keys, F.col(right_at).alias(at), F.lit(0).alias(side), payload.alias(pay))
    both = l_rows.unionByName(r_rows, allowMissingColumns=True)
    # Left rows tie with each other on (at, side); that is harmless, they only look back at right rows.
    seen = running(both, keys, [at, side], {"_found": ("last", pay)}, bins)
    matched = seen.where(F.col(side) == 1).select(
        "_row.*", *[F.col(f"_found.{v}").alias(v) for v in values])
    no_time = left.where(F.col(left_at).isNull())
    return matched.unionByName(no_time, allowMissingColumns=True)
