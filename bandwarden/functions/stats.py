"""Interval, normal-law and histogram-bin column functions."""
from __future__ import annotations

import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import constants as C


def fraction(k: Column, n: Column) -> Column:
    return F.when(n > 0, k.cast("double") / n.cast("double"))


def standard_error(k: Column, n: Column) -> Column:
    p = fraction(k, n)
    return F.sqrt(p * (1.0 - p) / n.cast("double"))


def wilson(k: Column, n: Column, z: float = C.WILSON_Z) -> tuple[Column, Column]:
    """Lower and upper Wilson bounds, clipped to [0, 1], undefined at n = 0."""
    nd = F.when(n > 0, n.cast("double"))
    p = k.cast("double") / nd
    z2 = F.lit(z * z)
    den = 1.0 + z2 / nd
    mid = (p + z2 / (2.0 * nd)) / den
    half = F.lit(z) * F.sqrt(p * (1.0 - p) / nd + z2 / (4.0 * nd * nd)) / den
    low = F.when(k == 0, F.when(n > 0, F.lit(0.0))).otherwise(F.greatest(F.lit(0.0), mid - half))
    high = F.when(k == n, F.when(n > 0, F.lit(1.0))).otherwise(F.least(F.lit(1.0), mid + half))
    return F.when(n > 0, low), F.when(n > 0, high)


@F.pandas_udf(T.DoubleType())
def normal_cdf(x: pd.Series) -> pd.Series:
    """Standard normal law; used on summary rows only."""
    return x.map(lambda v: None if v is None or v != v else 0.5 * math.erfc(-v / math.sqrt(2.0)))


def uniform_bin(x: Column, lo: Column, hi: Column, bins: int) -> Column:
    """Half-open equal bins with the last one closed; -1 outside.

    The result is never NULL: a nullable key of a later join would make the
    optimizer copy this expression into a not-null filter at the scan."""
    raw = F.floor((x - lo) / ((hi - lo) / F.lit(float(bins))))
    inside = (x >= lo) & (x <= hi)
    return F.coalesce(F.when(inside, F.least(F.greatest(raw, F.lit(0)), F.lit(bins - 1)).cast("int")), F.lit(-1))


def geometric_edges(lo: float, hi: float, n: int) -> list[float]:
    """n edges in constant ratio, ends exact."""
    step = (math.log10(hi) - math.log10(lo)) / (n - 1)
    mid = [10.0 ** (math.log10(lo) + i * step) for i in range(1, n - 1)]
    return [lo, *mid, hi]


def with_edge_bin(df: DataFrame, name: str, x: Column, edges: Sequence[float]) -> DataFrame:
    """Adds the index of the bin ``edges[i] <= x < edges[i+1]`` for ascending
    edges; -1 below the first and for NULL, the last index from the last edge on.

    Long lists must be in constant ratio (after a leading zero): the index is
    then arithmetic, moved by one where rounding put it beside its edge.  Each
    step is its own column so that none is repeated in generated code."""
    edges = [float(e) for e in edges]
    keep = [c for c in df.columns if c != name]
    held = df.withColumn("_x", x)
    v = F.col("_x")
    if len(edges) <= 48:
        total = F.lit(-1)
        for e in edges:
            total = total + (v >= F.lit(e)).cast("int")
        return held.withColumn(name, F.coalesce(total, F.lit(-1))).select(*keep, name)
    lead = next(i for i, e in enumerate(edges) if e > 0)
    first, n = math.log10(edges[lead]), len(edges) - lead
    step = (math.log10(edges[-1]) - first) / (n - 1)
    if any(abs((math.log10(e) - first) / step - i) > 0.25 for i, e in enumerate(edges[lead:])):
        raise ValueError("more than 48 edges must be in constant ratio")
    table = F.array(*[F.lit(e) for e in edges])
    raw = F.floor((F.log10(v) - F.lit(first)) / F.lit(step)).cast("int") + lead
    guess = F.when(v > 0, F.least(F.greatest(raw, F.lit(lead - 1)), F.lit(len(edges) - 1))).otherwise(F.lit(lead - 1))
    g = F.col("_g")
    moved = (g + F.when(F.get(table, g + 1) <= v, 1).otherwise(0) - F.when(F.get(table, g) > v, 1).otherwise(0))
    return held.withColumn("_g", guess).withColumn(name, F.coalesce(moved, F.lit(-1))).select(*keep, name)
