"""Percentiles of groups of any size: exact ones, and stored sketches that merge over any range."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.ordered import Bins, running
from tidemark.session import cut_lineage


def exact_percentiles(
    df: DataFrame, by: Sequence[str], value: str, outputs: dict[str, float], bins: Bins = None,
) -> DataFrame:
    """Interpolated percentiles per group, as SQL ``percentile_cont`` gives them; NULL for a group of NULLs only.

    One way for every size: rows are counted per value, which combines before the shuffle; a running count over a
    group's values, cut into bins where it has many, gives each value its ranks, and the two values around each
    wanted rank are picked by an aggregate. The input is read once.
    """
    keys = list(by) or ["_all"]
    rows = df.select(*by, F.col(value).cast("double").alias("_v"))
    if not by:
        rows = rows.withColumn("_all", F.lit(0))
    freq = cut_lineage(rows.groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_f")))
    groups = freq.groupBy(*keys).agg(F.sum(F.when(F.col("_v").isNotNull(), F.col("_f"))).alias("_n"))
    ranked = running(freq.where("_v IS NOT NULL"), keys, ["_v"], {"_end": ("sum", "_f")}, bins).join(groups, keys)
    picks = []
    for name, p in outputs.items():
        # The value at 0-based rank r is the smallest one whose cumulative count exceeds r.
        at = F.lit(p) * (F.col("_n") - 1)
        picks += [
            F.min(F.when(F.col("_end") > F.floor(at), F.col("_v"))).alias(f"_lo_{name}"),
            F.min(F.when(F.col("_end") > F.ceil(at), F.col("_v"))).alias(f"_hi_{name}"),
            F.max(at - F.floor(at)).alias(f"_part_{name}")]
    solved = ranked.groupBy(*keys).agg(*picks)
    found = groups.select(*keys).join(solved, keys, "left")
    return found.select(*by, *[
        (F.col(f"_lo_{n}") + (F.col(f"_hi_{n}") - F.col(f"_lo_{n}")) * F.col(f"_part_{n}")).alias(n) for n in outputs])


#: Size parameter of the sketches, and the error of a rank (as a share of the rows) that they keep with it.
SKETCH_K, RANK_ERROR = 800, 0.01


def hourly_sketches(df: DataFrame, by: Sequence[str], at: str, value: str, k: int = SKETCH_K) -> DataFrame:
    """(by…, hour, sketch): one KLL sketch of ``value`` per group and hour, a few kilobytes each; NULLs are left out."""
    rows = df.where(F.col(value).isNotNull()).select(*by, F.date_trunc("hour", at).alias("hour"), F.col(value).cast("double").alias("_v"))
    return rows.groupBy(*by, "hour").agg(F.kll_sketch_agg_double("_v", k).alias("sketch"))


def sketched_percentiles(sketches: DataFrame, by: Sequence[str], outputs: dict[str, float], k: int = SKETCH_K) -> DataFrame:
    """(by…, n, one column per output): percentiles of stored sketches, merged per group over whatever hours are given.

    The rank of a result is within ``RANK_ERROR`` of the wanted one; n is exact. The values behind the sketches are not read.
    """
    merged = sketches.groupBy(*by).agg(F.kll_merge_agg_double("sketch", k).alias("_s"))
    return merged.select(*by, F.kll_sketch_get_n_double("_s").alias("n"), *[
        F.kll_sketch_get_quantile_double("_s", F.lit(float(p))).alias(name) for name, p in outputs.items()])
