"""Null centre, null scale and the threshold ladder per channel."""
from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import stats
from ..session import materialize
from .numbering import hot_groups, number_within, running_sums
from .quantiles import grouped_quantiles
from .small import join_small


def h0_table(df: DataFrame) -> DataFrame:
    """Mean ratio against the null ratio per channel over all valid frames."""
    f, mu0, v = F.col("f"), F.col("mu0"), F.col("valid")
    g = df.groupBy("physical_channel").agg(
        F.count(F.when(v, f)).alias("n_valid"), F.avg(F.when(v, f)).alias("mean_f"),
        F.stddev_samp(F.when(v, f)).alias("_sd"), F.min(mu0).alias("mu0"),
        F.when(F.count_if(v) > 0, F.count_if(v & F.col("reject")) / F.count_if(v)).alias("mask_fraction"))
    gap, bound = F.abs(F.col("mean_f") - F.col("mu0")), F.abs(F.col("mu0") - 1.0) / 3.0
    return g.select("physical_channel", "n_valid", "mean_f",
                    F.when(F.col("n_valid") > 1, F.col("_sd") / F.sqrt("n_valid")).alias("sem_f"), "mu0",
                    gap.alias("gap"), bound.alias("bound"), F.coalesce(gap < bound, F.lit(False)).alias("tracks"),
                    "mask_fraction")


def mask_class(mask_fraction: Column, suppressed: float = 0.45, elevated: float = 0.55) -> Column:
    return (F.when(mask_fraction < suppressed, "suppressed").when(mask_fraction > elevated, "elevated")
            .otherwise("nominal"))


def distribution_mode(df: DataFrame, bins: int = 512, max_rows: int | None = None) -> DataFrame:
    """Centre of the fullest of ``bins`` equal bins between p0.5 and p99.5."""
    span = grouped_quantiles(df, ["physical_channel"], {"lo": ("f", 0.005), "hi": ("f", 0.995)},
                             [F.min("mu0").alias("mu0")], max_rows=max_rows)
    placed = join_small(df.select("physical_channel", "f"), span, ["physical_channel"]).withColumn(
        "bin", stats.uniform_bin(F.col("f"), F.col("lo"), F.col("hi"), bins))
    counts = placed.groupBy("physical_channel", "bin").agg(
        F.count(F.lit(1)).alias("n"), F.min("lo").alias("lo"), F.min("hi").alias("hi"), F.min("mu0").alias("mu0"),
        F.max("bin").alias("_t")).where("_t >= 0")
    top = F.max_by(F.struct("bin", "lo", "hi", "mu0"), F.struct(F.col("n"), -F.col("bin")))
    w = (F.col("t.hi") - F.col("t.lo")) / bins
    return counts.groupBy("physical_channel").agg(top.alias("t")).select(
        "physical_channel", "t.mu0", (F.col("t.lo") + (F.col("t.bin") + 0.5) * w).alias("centre"))


def _settle_bounded(data: DataFrame, start: DataFrame, rounds: int) -> DataFrame:
    """Settled centres where every channel fits one bounded pandas call."""
    def settle(pdf: pd.DataFrame) -> pd.DataFrame:
        x, m, mu0 = pdf["f"].to_numpy(), pdf["centre"].iloc[0], pdf["mu0"].iloc[0]
        for _ in range(rounds):
            near = x[np.abs(x - m) <= C.CORE_WINDOW * mu0]
            if len(near) < 100:
                break
            last, m = m, float(np.median(near))
            if abs(m - last) < 1e-7:
                break
        return pd.DataFrame({"physical_channel": [pdf["physical_channel"].iloc[0]], "centre": [m], "mu0": [mu0]})

    j = join_small(data.select("physical_channel", "f"), start, ["physical_channel"])
    return j.groupBy("physical_channel").applyInPandas(settle, "physical_channel int, centre double, mu0 double")


def _settle_rounds(data: DataFrame, start: DataFrame, rounds: int, max_rows: int | None) -> DataFrame:
    """Settled centres by rounds over the distinct values of all channels.

    A window about a centre is a run of the sorted values, so its median is found by its rank among the running counts,
    which are made once."""
    values = materialize(data.groupBy("physical_channel", "f").agg(F.count(F.lit(1)).alias("n")))
    counted = materialize(running_sums(values, ["physical_channel"], "f", ["n"], max_rows=max_rows).select("physical_channel", "f", "n", "cum_n"))
    rows = {r["physical_channel"]: (r["centre"], r["mu0"]) for r in start.collect()}
    active = set(rows)

    def centred(df, which):
        """``df`` of some channels with their centre and null ratio as literals; there are few channels."""
        own = F.col("physical_channel")
        put = lambda i: F.coalesce(*[F.when(own == ch, F.lit(rows[ch][i])) for ch in sorted(which)], F.lit(None).cast("double"))
        return df.where(own.isin(sorted(which))).select("*", put(0).alias("centre"), put(1).alias("mu0"))

    for _ in range(rounds):
        if not active:
            break
        near = centred(counted, active).where(
            F.abs(F.col("f") - F.col("centre")) <= F.lit(C.CORE_WINDOW) * F.col("mu0"))
        size = near.groupBy("physical_channel").agg(F.sum("n").alias("all"), F.min(F.col("cum_n") - F.col("n")).alias("first"))
        at = (F.col("all") - 1) / 2
        holds = lambda rank: (F.col("cum_n") - F.col("n") <= F.col("first") + rank) & (F.col("first") + rank < F.col("cum_n"))
        ends = join_small(near, size, ["physical_channel"]).groupBy("physical_channel").agg(
            F.min("all").alias("n"), F.min(F.when(holds(F.floor(at)), F.col("f"))).alias("a"), F.min(F.when(holds(F.ceil(at)), F.col("f"))).alias("b"))
        found = {r["physical_channel"]: r for r in ends.select(
            "physical_channel", "n", F.when(F.col("a") == F.col("b"), F.col("a")).otherwise(0.5 * F.col("a") + 0.5 * F.col("b")).alias("m")).collect()}
        for ch in sorted(active):
            r = found.get(ch)
            if r is None or r["n"] < 100:
                active.discard(ch)
                continue
            if abs(r["m"] - rows[ch][0]) < 1e-7:
                active.discard(ch)
            rows[ch] = (r["m"], rows[ch][1])
    return centred(start.select("physical_channel"), rows)


def core_zero_point(df: DataFrame, max_rows: int | None = None, rounds: int = 20) -> DataFrame:
    """Mode-anchored centre of the null core per channel.

    The median inside a fixed window is moved until it settles: in one bounded
    pandas call per channel where the input is known to be small, else by one
    aggregation per round for all channels, with only the centres (one row per
    channel) reaching the driver.
    """
    data = materialize(df.where(F.col("valid") & F.col("f").isNotNull()).select("physical_channel", "f", "mu0", "reject"))
    start = distribution_mode(data, max_rows=max_rows)
    if max_rows is not None and max_rows <= C.HOT_GROUP_ROWS:
        centre = _settle_bounded(data, start, rounds)
    else:
        centre = _settle_rounds(data, start, rounds, max_rows)
    j = join_small(data.drop("mu0"), centre, ["physical_channel"])
    near = F.abs(F.col("f") - F.col("centre")) <= F.lit(C.CORE_WINDOW) * F.col("mu0")
    core = F.when(near, F.col("f"))
    n = F.count(F.lit(1))
    first = j.groupBy("physical_channel").agg(
        n.alias("n_valid"), F.min("mu0").alias("mu0"), F.avg(core).alias("mu_hat"),
        (F.stddev_samp(core) / F.sqrt(F.count(core))).alias("mu_err"), (F.count(core) / n).alias("core_fraction"),
        (F.count_if("reject") / n).alias("mask_fraction"))
    k = join_small(data.drop("mu0"), first.select("physical_channel", "mu0", "mu_hat"), ["physical_channel"])
    f, mu, mu0 = F.col("f"), F.col("mu_hat"), F.col("mu0")
    tails = k.groupBy("physical_channel").agg(
        (F.count_if(f < mu - F.lit(C.TAIL_EDGE) * mu0) / n).alias("low_fraction"),
        (F.count_if(f > mu + F.lit(C.TAIL_EDGE) * mu0) / n).alias("high_fraction"),
        (F.count_if(f <= mu) / n).alias("kept_one_sided"),
        (F.count_if((f <= mu) & (f >= mu - F.lit(C.TAIL_EDGE) * mu0)) / n).alias("kept_two_sided"))
    distrust = ((2.0 * (1.0 - F.col("mask_fraction")) < C.MIN_NULL_FROM_MASK)
                | (F.col("core_fraction") < C.MIN_CORE_FRACTION)
                | (F.abs(F.col("mu_hat") - F.col("mu0")) / F.col("mu0") > C.GEOMETRY_BOUND))
    return first.join(F.broadcast(tails), "physical_channel").withColumn("trusted", ~distrust)


def diurnal_mask_profile(df: DataFrame, hour: Column, min_n: int = 50) -> DataFrame:
    """Mask fraction per solar hour with more than ``min_n`` valid frames."""
    n = F.count(F.lit(1))
    g = df.where("valid").groupBy("physical_channel", hour.alias("hour")).agg(
        n.alias("n"), (F.count_if("reject") / n).alias("mask_fraction"))
    return g.where(F.col("n") > min_n)


# --- half-sample mode --------------------------------------------------------

def _let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` worked out once."""
    return F.transform(F.array(value), use)[0]


def _densest_half(values: Column) -> Column:
    """The narrowest run of half of a sorted array, the first of equals."""
    half = F.ceil(F.size(values) / 2).cast("int")
    width = F.zip_with(F.slice(values, half, F.size(values) - half + 1), F.slice(values, F.lit(1), F.size(values) - half + 1),
                       lambda last, first: last - first)
    return F.slice(values, _let(width, lambda w: F.array_position(w, F.array_min(w)).cast("int")), half)


def _mode_of_few(values: Column) -> Column:
    """Mean of one or two values; of three, the middle of the closer pair, or the middle one if both are as close."""
    low, mid, high = (F.get(values, i) for i in range(3))
    lean = F.signum((high - mid) - (mid - low))
    of_three = F.when(lean == 0, mid).when(lean > 0, (low + mid) / 2).otherwise((mid + high) / 2)
    return F.when(F.size(values) == 3, of_three).when(F.size(values) == 2, (low + mid) / 2).otherwise(low)


def half_sample_mode(df: DataFrame, keys: Sequence[str], value: str, max_rows: int | None = None,
                     limit: int = C.MODE_ROWS) -> DataFrame:
    """Half-sample mode per group.

    While a group has more than ``limit`` rows, a halving joins ranks r and r+h-1 over all tasks and drops half of the
    rows.  What is left of each group is one sorted array, halved by array functions until three values remain.
    """
    keys = list(keys)
    data = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_x"))

    def finish(d: DataFrame) -> DataFrame:
        halvings = F.ceil(F.log2(F.size("_v"))).cast("int")
        left = F.aggregate(F.sequence(F.lit(0), halvings), F.col("_v"),
                           lambda v, _: F.when(F.size(v) > 3, _densest_half(v)).otherwise(v))
        few = d.groupBy(*keys).agg(F.sort_array(F.collect_list("_x")).alias("_v")).select(*keys, left.alias("_v"))
        return few.select(*keys, _mode_of_few(F.col("_v")).alias("mode"))

    if max_rows is not None and max_rows <= limit:
        return finish(data)
    hot = hot_groups(data, keys, limit).select(*keys)
    if hot.isEmpty():
        return finish(data)
    n_hot = hot.count()
    cold = join_small(data, hot, keys, rows=n_hot, how="left_anti")
    big = number_within(join_small(data, hot, keys, rows=n_hot, how="left_semi"), keys, ["_x"], "_r", limit=limit)
    big = materialize(big)
    while True:
        size = big.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
        wide = size.where(F.col("_n") > limit).withColumn("_h", F.floor((F.col("_n") + 1) / 2))
        if wide.isEmpty():
            break
        ends = join_small(big, wide, keys, rows=n_hot).select(
            *keys, F.col("_r").alias("_s"), F.col("_x").alias("_xs"), (F.col("_r") + F.col("_h") - 1).alias("_r"), "_h")
        pairs = ends.join(big.withColumnRenamed("_x", "_xe"), [*keys, "_r"])
        width = F.col("_xe") - F.col("_xs")
        best = pairs.groupBy(*keys).agg(F.min(F.struct(width.alias("w"), F.col("_s"))).alias("b"), F.min("_h").alias("_h"))
        keep = best.select(*keys, F.col("b._s").alias("_lo"), (F.col("b._s") + F.col("_h") - 1).alias("_hi"))
        j = join_small(big, keep, keys, rows=n_hot, how="left")
        inside = F.col("_lo").isNull() | F.col("_r").between(F.col("_lo"), F.col("_hi"))
        big = materialize(j.where(inside).select(*keys, "_x", "_r"))
    return finish(cold).unionByName(finish(big.select(*keys, "_x")))


def null_scale_about(df: DataFrame, centre: str = "mu", max_rows: int | None = None) -> DataFrame:
    """Median of three scale probes of the frames at or below the centre, and
    the ratio of the largest to the smallest probe."""
    c = F.col(centre)
    lower = F.when(F.col("f") <= c, F.col("f"))
    specs = {f"_q{i}": (lower, p) for i, (p, _) in enumerate(C.NULL_PROBES)}
    g = grouped_quantiles(df, ["physical_channel"], specs,
                          [F.count(lower).alias("n_lower"), F.min(centre).alias(centre)], max_rows=max_rows)
    probes = F.array_sort(F.filter(F.array(*[(F.col(centre) - F.col(f"_q{i}")) / z for i, (_, z) in enumerate(C.NULL_PROBES)]),
                                   lambda e: e > 0))
    g = g.withColumn("_e", F.when(F.col("n_lower") >= 20, probes))
    k = F.size("_e")
    mid = F.when(k > 0, (F.get("_e", F.floor((k - 1) / 2).cast("int")) + F.get("_e", F.floor(k / 2).cast("int"))) / 2)
    return g.select("physical_channel", centre, "n_lower", mid.alias("sigma"),
                    F.when(k > 0, F.array_max("_e") / F.array_min("_e")).alias("spread"))


def calibrate_ladder(df: DataFrame, mu: DataFrame, etas: Sequence[float] = C.ETA_LADDER,
                     max_rows: int | None = None, leak: bool = True) -> DataFrame:
    """Occupancy and, unless ``leak`` is false, kept leakage for each factor of the ladder.

    ``mu`` has one row per channel; all factors are conditional aggregates of
    one pass, turned into rows afterwards."""
    j = join_small(df, mu.select("physical_channel", "mu"), ["physical_channel"])
    f, m, n = F.col("f"), F.col("mu"), F.count(F.lit(1))
    over = [(F.count_if(f > F.lit(e) * m) / n).alias(f"occ{i}") for i, e in enumerate(etas)]
    specs = {f"p{i}": (F.when(f <= F.lit(e) * m, f), 0.99) for i, e in enumerate(etas)}
    aggs = [n.alias("n_frames"), F.min("mu").alias("mu"), F.min("mu0").alias("mu0"),
            (F.count_if(f > F.col("mu0")) / n).alias("occupancy_provisional"), *over]
    if leak:
        g = grouped_quantiles(j, ["physical_channel"], specs, aggs, max_rows=max_rows)
    else:
        g = j.groupBy("physical_channel").agg(*aggs, *[F.lit(None).cast("double").alias(p) for p in specs])
    shift = 10.0 * F.log10(F.col("mu") / F.col("mu0"))
    steps = F.array(*[F.struct(F.lit(float(e)).alias("eta"), F.col(f"occ{i}").alias("occupancy"),
                               (10.0 * F.log10(F.col(f"p{i}") / F.col("mu"))).alias("leak_p99_db"))
                      for i, e in enumerate(etas)])
    return g.select("physical_channel", "n_frames", "mu", shift.alias("mu_shift_db"),
                    (F.abs(shift) <= C.NULL_TOLERANCE_DB).alias("null_available"), "occupancy_provisional",
                    F.explode(steps).alias("s")).select("*", "s.*").drop("s")


def detection_floor(scale: DataFrame) -> DataFrame:
    """Smallest resolvable factor ``(mu + 3.09 sigma)/mu``."""
    eta = (F.col("mu") + F.lit(C.FLOOR_SIGMAS) * F.col("sigma")) / F.col("mu")
    return scale.withColumn("floor_eta", eta).withColumn("floor_db", 10.0 * F.log10("floor_eta"))
