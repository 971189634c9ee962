"""Distributions: summaries, histograms, survival curves."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import stats
from .numbering import running_sums
from .quantiles import grouped_quantiles
from .small import join_small

QUANTILES = (0.0, 0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99, 1.0)
# 0, 151 edges in constant ratio from 0.3 to 300, infinity: 152 bins.
RATIO_EDGES = [0.0, *stats.geometric_edges(0.3, 300.0, 151)]


def _count_bins(binned: DataFrame, by: list[str], bin_name: str) -> DataFrame:
    """Rows per bin with undefined and negative bins left out.

    The test is on an aggregate of the bin: a test on the bin itself would be
    pushed below the projection and repeat the whole bin expression."""
    counts = binned.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.max(bin_name).alias("_top"))
    return counts.where(F.col("_top") >= 0).drop("_top")


def distribution_summary(df: DataFrame, keys: Sequence[str], value: Column,
                         max_rows: int | None = None) -> DataFrame:
    """Counts, mean, population SD and nine quantiles of the finite values."""
    fin = value.isNotNull() & ~F.isnan(value)
    x = F.when(fin, value)
    total, ok = F.count(F.lit(1)), F.count(x)
    return grouped_quantiles(
        df, keys, {f"p{round(q * 100):02d}": (x, q) for q in QUANTILES},
        [total.alias("count_total"), ok.alias("count_finite"), (total - ok).alias("count_nonfinite"),
         F.avg(x).alias("mean"), F.stddev_pop(x).alias("standard_deviation")], max_rows=max_rows)


def histogram_in_range(df: DataFrame, keys: Sequence[str], value: Column, bins: int = 64) -> DataFrame:
    """Equal bins over each group's own range, all bins present; the range of
    a constant group is widened."""
    ranges = df.groupBy(*keys).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    pad = F.greatest(F.abs(F.col("_lo")) * 1e-6, F.lit(1e-12))
    same = F.col("_lo") == F.col("_hi")
    ranges = ranges.where(F.col("_lo").isNotNull()).select(
        *keys, F.when(same, F.col("_lo") - pad).otherwise(F.col("_lo")).alias("lo"),
        F.when(same, F.col("_hi") + pad).otherwise(F.col("_hi")).alias("hi"))
    binned = join_small(df.select(*keys, value.alias("_v")), ranges, keys).withColumn(
        "bin", stats.uniform_bin(F.col("_v"), F.col("lo"), F.col("hi"), bins))
    counts = _count_bins(binned, [*keys, "bin"], "bin")
    grid = ranges.select(*keys, "lo", "hi", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    w = (F.col("hi") - F.col("lo")) / bins
    return grid.join(counts, [*keys, "bin"], "left").select(
        *keys, "bin", (F.col("lo") + F.col("bin") * w).alias("edge_lo"),
        (F.col("lo") + (F.col("bin") + 1) * w).alias("edge_hi"), F.coalesce("n", F.lit(0)).alias("n"))


def fixed_histogram(df: DataFrame, keys: Sequence[str], value: Column, lo: float, hi: float, bins: int,
                    clip: bool = False) -> DataFrame:
    """Counts and density in fixed equal bins; ``clip`` moves outside values
    into the end bins, otherwise they are left out as NumPy does."""
    x = F.least(F.greatest(value, F.lit(lo)), F.lit(hi)) if clip else value
    binned = df.where(value.isNotNull()).select(*keys, stats.uniform_bin(x, F.lit(lo), F.lit(hi), bins).alias("bin"))
    counts = _count_bins(binned, [*keys, "bin"], "bin")
    w = W.partitionBy(*keys)
    return counts.withColumn("density", F.col("n") / (F.sum("n").over(w) * F.lit((hi - lo) / bins)))


def edge_histogram(df: DataFrame, keys: Sequence[str], value: Column, edges: Sequence[float],
                   zero_fill: bool = True) -> DataFrame:
    """Counts per bin of fixed ascending edges; every bin of a present group."""
    binned = stats.with_edge_bin(df.where(value.isNotNull()), "bin", value, edges).select(*keys, "bin")
    counts = _count_bins(binned, [*keys, "bin"], "bin")
    if not zero_fill:
        return counts
    grid = counts.select(*keys).distinct().select(
        *keys, F.explode(F.sequence(F.lit(0), F.lit(len(edges) - 1))).alias("bin"))
    return grid.join(counts, [*keys, "bin"], "left").select(*keys, "bin", F.coalesce("n", F.lit(0)).alias("n"))


def joint_histogram(df: DataFrame, keys: Sequence[str], x: Column, y: Column,
                    x_edges: Sequence[float], y_bins: int = 39) -> DataFrame:
    """Non-zero cells of two-dimensional counts.

    The second axis has ``y_bins`` edges in constant ratio over each group's
    own positive range, between a bin from zero and one to infinity."""
    held = stats.with_edge_bin(df.withColumn("_y", F.log10(F.greatest(y, F.lit(1e-300)))), "x_bin", x, x_edges)
    span = df.groupBy(*keys).agg(F.min(y).alias("_lo"), F.max(y).alias("_hi"))
    span = span.select(*keys, F.log10(F.greatest(F.greatest("_lo", F.lit(1e-300)) * 0.99, F.lit(1e-12))).alias("_a"),
                       F.log10(F.greatest("_hi", F.lit(1e-300)) * 1.01).alias("_b"))
    placed = join_small(held.select(*keys, "x_bin", "_y"), span, keys).withColumn(
        "_r", F.floor((F.col("_y") - F.col("_a")) / ((F.col("_b") - F.col("_a")) / (y_bins - 1))) + 1)
    placed = placed.withColumn("y_bin", F.least(F.greatest("_r", F.lit(0)), F.lit(y_bins)).cast("int"))
    return _count_bins(placed, [*keys, "x_bin", "y_bin"], "x_bin")


def survival(df: DataFrame, keys: Sequence[str], value: Column, grid: Sequence[float]) -> DataFrame:
    """``P(x >= g)`` on an ascending grid.

    Each value is counted once in its grid cell; the curve is a running sum
    from the top over at most one row per cell."""
    cells = edge_histogram(df, keys, value, [float("-inf"), *grid])
    w = W.partitionBy(*keys).orderBy(F.col("bin").desc())
    upto = cells.withColumn("above", F.sum("n").over(w)).withColumn("total", F.sum("n").over(W.partitionBy(*keys)))
    g = F.array(*[F.lit(float(x)) for x in grid])
    return upto.where("bin > 0").select(
        *keys, F.element_at(g, F.col("bin")).alias("g"), F.col("above").alias("n_at_least"),
        (F.col("above") / F.col("total")).alias("survival"))


def tail_ccdf(df: DataFrame, keys: Sequence[str], value: Column, max_rows: int | None = None) -> DataFrame:
    """Share of values at or beyond each distinct value; equal values are
    counted before the running sum."""
    v = df.select(*keys, value.alias("x")).where("x IS NOT NULL").groupBy(*keys, "x").agg(F.count(F.lit(1)).alias("n"))
    r = running_sums(v, keys, "x", ["n"], descending=True, max_rows=max_rows)
    return r.select(*keys, "x", F.col("cum_n").alias("n_at_least"), (F.col("cum_n") / F.col("all_n")).alias("ccdf"))
