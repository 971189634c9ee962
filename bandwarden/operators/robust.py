"""Unit baselines, power veto, tail composition and unit classes."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import constants as C
from ..session import materialize
from .bootstrap import resampled_sums
from .numbering import hot_groups
from .quantiles import grouped_quantiles
from .small import join_scalar, join_small

UNIT = ["physical_channel", "event_id"]


def unit_medians(df: DataFrame, columns: list[str], max_rows: int | None = None, limit: int = C.HOT_GROUP_ROWS) -> DataFrame:
    """``n_core`` and the medians of the core frames of each unit.

    Units are many and short, for which a value map each is dear: their rows are sorted and the middle ones picked.  With a
    unit beyond ``limit`` the quantiles of hot groups are used."""
    core = F.col("core")
    small = max_rows is not None and max_rows <= limit
    if not small and not hot_groups(df, UNIT, limit).isEmpty():
        return grouped_quantiles(df, UNIT, {f"base_{c}": (F.when(core, F.col(c)), 0.5) for c in columns},
                                 [F.count_if(core).alias("n_core")], max_rows=max_rows, limit=limit)
    held = df.select(*UNIT, "core", *[F.when(core, F.col(c)).cast("double").alias(f"_v_{c}") for c in columns])
    for c in columns:
        w = W.partitionBy(*UNIT)
        held = held.withColumns({f"_r_{c}": F.row_number().over(w.orderBy(F.asc_nulls_last(f"_v_{c}"))) - 1, f"_n_{c}": F.count(f"_v_{c}").over(w)})
    picked = [F.max(F.when(F.col(f"_r_{c}") == end((F.col(f"_n_{c}") - 1) / 2), F.col(f"_v_{c}"))).alias(f"_{k}_{c}")
              for c in columns for k, end in (("a", F.floor), ("b", F.ceil))]
    g = held.groupBy(*UNIT).agg(F.count_if(core).alias("n_core"), *picked)
    middle = lambda a, b: F.when(a == b, a).otherwise(0.5 * a + 0.5 * b)
    return g.select(*UNIT, "n_core", *[middle(F.col(f"_a_{c}"), F.col(f"_b_{c}")).alias(f"base_{c}") for c in columns])


def unit_baseline(df: DataFrame, columns: list[str], max_rows: int | None = None, min_core: int = 2) -> DataFrame:
    """Median of core frames per unit, else the median of the channel's unit
    medians.  Needs a ``core`` flag."""
    ok = F.col("n_core") >= min_core
    per = materialize(unit_medians(df, columns, max_rows).select(*UNIT, *[F.when(ok, F.col(f"base_{c}")).alias(f"base_{c}") for c in columns]))
    fallback = grouped_quantiles(per, ["physical_channel"], {f"_fb_{c}": (f"base_{c}", 0.5) for c in columns},
                                 max_rows=max_rows)
    j = join_small(per, fallback, ["physical_channel"])
    return j.select(*UNIT, F.col(f"base_{columns[0]}").isNull().alias("fallback"),
                    *[F.coalesce(f"base_{c}", f"_fb_{c}").alias(f"base_{c}") for c in columns])


def three_arm_mask(df: DataFrame, max_rows: int | None = None, sigmas: float = 5.0) -> DataFrame:
    """Kept shares after the ceiling, the floor and the power veto.

    Needs ``mu`` and a ``core`` flag per frame.  The veto compares power over
    the unit baseline with 1 + 5 robust deviations of the core frames."""
    df = materialize(df.select(*UNIT, "f", "mu", "mu0", "core", "baseband_power"))
    base = materialize(unit_baseline(df, ["baseband_power"], max_rows))
    j = df.join(base, UNIT).withColumn("pn", F.col("baseband_power") / F.col("base_baseband_power"))
    j = materialize(j.select("physical_channel", "f", "mu", "mu0", "core", "pn"))
    core_pn = F.when(F.col("core"), F.col("pn"))
    med = grouped_quantiles(j, ["physical_channel"], {"_m": (core_pn, 0.5)}, max_rows=max_rows)
    j = join_small(j, med, ["physical_channel"])
    mad = grouped_quantiles(j, ["physical_channel"], {"_d": (F.abs(F.when(F.col("core"), F.col("pn")) - F.col("_m")), 0.5)},
                            max_rows=max_rows)
    mad = mad.select("physical_channel", (F.lit(C.MAD_SCALE) * F.col("_d")).alias("sigma"))
    j = join_small(j, mad, ["physical_channel"])
    ceiling = F.col("f") <= F.col("mu")
    floor = ceiling & (F.col("f") >= F.col("mu") - F.lit(C.TAIL_EDGE) * F.col("mu0"))
    kept = floor & ~(F.col("pn") > 1.0 + sigmas * F.col("sigma"))
    db = 10.0 * F.log10(F.greatest("pn", F.lit(1e-12)))
    n = F.count(F.lit(1))
    g = grouped_quantiles(
        j, ["physical_channel"],
        {"band_p50_db": (F.when(floor, db), 0.5), "band_p999_db": (F.when(floor, db), 0.999),
         "kept_p50_db": (F.when(kept, db), 0.5), "kept_p999_db": (F.when(kept, db), 0.999)},
        [n.alias("n"), (F.count_if(ceiling) / n).alias("kept_ceiling"), (F.count_if(floor) / n).alias("kept_band"),
         (F.count_if(kept) / n).alias("kept_final"), F.min("sigma").alias("sigma")], max_rows=max_rows)
    units = base.groupBy("physical_channel").agg(F.count_if("fallback").alias("n_fallback_units"))
    return join_small(g, units, ["physical_channel"]).withColumn(
        "veto_increment", F.when(F.col("kept_band") > 0, 1.0 - F.col("kept_final") / F.col("kept_band")).otherwise(0.0))


def tail_decomposition(df: DataFrame, max_rows: int | None = None) -> DataFrame:
    """Median target and reference power over the unit core baseline for the
    low tail, the core and the high tail.  Needs ``lo``, ``core``, ``hi``."""
    df = materialize(df.select(*UNIT, "lo", "core", "hi", "p_target", "p_ref_sum"))
    base = unit_baseline(df, ["p_target", "p_ref_sum"], max_rows)
    part = F.when(F.col("lo"), "low").when(F.col("hi"), "high").when(F.col("core"), "core")
    ratio = lambda c: F.col(c) / F.col(f"base_{c}")
    j = materialize(df.join(base, UNIT).where(part.isNotNull()).select(
        "physical_channel", part.alias("part"), ratio("p_target").alias("target"), ratio("p_ref_sum").alias("reference")))
    return grouped_quantiles(
        j, ["physical_channel", "part"], {"target_ratio": ("target", 0.5), "reference_ratio": ("reference", 0.5)},
        [F.count(F.lit(1)).alias("n")], max_rows=max_rows)


def tail_coincidence(df: DataFrame) -> DataFrame:
    """Share of units with a low tail, and among units with a high tail."""
    u = df.groupBy(*UNIT).agg(F.max(F.col("lo").cast("int")).alias("lo"), F.max(F.col("hi").cast("int")).alias("hi"))
    return u.groupBy("physical_channel").agg(
        F.count(F.lit(1)).alias("n_units"), F.avg("lo").alias("p_low"),
        F.avg(F.when(F.col("hi") == 1, F.col("lo"))).alias("p_low_given_high"))


def hourly_tail_rates(df: DataFrame, hour: Column, min_n: int = 100) -> DataFrame:
    n = F.count(F.lit(1))
    g = df.groupBy("physical_channel", hour.alias("hour")).agg(
        n.alias("n"), (F.count_if("lo") / n).alias("low_rate"), (F.count_if("hi") / n).alias("high_rate"))
    return g.where(F.col("n") > min_n)


def hourly_tail_bands(df: DataFrame, hour: Column, min_n: int = 100, replicates: int = 300, seed: int = 41, max_rows: int | None = None) -> DataFrame:
    """Rates of hourly low and high tails with their 16 to 84 % bands over resampled units; hours with few frames are left out."""
    keys, n = ["physical_channel", "hour"], F.count(F.lit(1))
    units = df.groupBy("physical_channel", hour.alias("hour"), "event_id").agg(n.alias("n"), F.count_if("lo").alias("lo"), F.count_if("hi").alias("hi"))
    rates = units.groupBy(*keys).agg(F.sum("n").alias("n"), (F.sum("lo") / F.sum("n")).alias("low_rate"), (F.sum("hi") / F.sum("n")).alias("high_rate")).where(F.col("n") > min_n)
    kept = join_small(units, rates.select(*keys), keys)
    sums = resampled_sums(kept, keys, "event_id", ["n", "lo", "hi"], replicates, seed, max_rows)
    size = F.greatest(F.col("n"), F.lit(1))
    low, high = F.col("lo") / size, F.col("hi") / size
    bands = grouped_quantiles(sums, keys, {"low_16": (low, 0.16), "low_84": (low, 0.84), "high_16": (high, 0.16), "high_84": (high, 0.84)}, max_rows=replicates)
    return rates.join(bands, keys)


def sub_null_tail(df: DataFrame, scale: DataFrame, k: float = 5.0, max_rows: int | None = None) -> DataFrame:
    """Frames below ``mu - k*sigma``: share, depth, power against the bulk,
    units hit and the share of the most affected unit."""
    j = join_small(df, scale.select("physical_channel", "mu", "sigma"), ["physical_channel"])
    j = materialize(j.select(*UNIT, "f", "mu", "sigma", "baseband_power"))
    f, mu, s = F.col("f"), F.col("mu"), F.col("sigma")
    sub, bulk = f < mu - k * s, F.abs(f - mu) <= s
    p = F.col("baseband_power")
    n = F.count(F.lit(1))
    g = grouped_quantiles(
        j, ["physical_channel"],
        {"_fs": (F.when(sub, f), 0.5), "_ps": (F.when(sub, p), 0.5), "_pb": (F.when(bulk, p), 0.5)},
        [n.alias("n"), F.count_if(sub).alias("n_sub"), F.min("mu").alias("mu")], max_rows=max_rows)
    units = j.where(sub).groupBy(*UNIT).agg(n.alias("c")).groupBy("physical_channel").agg(
        n.alias("units_hit"), (F.max("c") / F.sum("c")).alias("top_unit_share"))
    return join_small(g.where("n_sub > 0"), units, ["physical_channel"]).select(
        "physical_channel", "n", "n_sub", (F.col("n_sub") / F.col("n")).alias("fraction"),
        (F.col("_fs") / F.col("mu")).alias("median_over_mu"), (F.col("_ps") / F.col("_pb")).alias("power_ratio"),
        "units_hit", "top_unit_share")


def unit_classes(df: DataFrame, split: float = 2.0, pure: float = 0.99) -> DataFrame:
    """Units all below the split, all above, or mixed, with mean and width of
    the normalised ratio."""
    x = F.col("f") / F.col("mu0")
    g = df.groupBy(*UNIT).agg(F.count(F.lit(1)).alias("n"), F.avg((x < split).cast("int")).alias("low_share"),
                              F.avg(x).alias("mean"), F.stddev_samp(x).alias("width"))
    kind = (F.when(F.col("low_share") >= pure, "all_low").when(F.col("low_share") <= 1 - pure, "all_high").otherwise("mixed"))
    return g.withColumn("kind", kind)


def unit_class_summary(df: DataFrame, split: float = 2.0, max_rows: int | None = None) -> DataFrame:
    u = unit_classes(df, split)
    g = grouped_quantiles(u, ["physical_channel", "kind"],
                          {"mean_median": ("mean", 0.5), "width_median": (F.when(F.col("n") >= 3, F.col("width")), 0.5)},
                          [F.count(F.lit(1)).alias("units"), F.sum("n").alias("frames")], max_rows=max_rows)
    return g


def occupied_share(df: DataFrame, split: float = 2.0) -> DataFrame:
    x, n = F.col("f") / F.col("mu0"), F.count(F.lit(1))
    return df.groupBy("physical_channel").agg(
        n.alias("n"), (F.count_if(x < split) / n).alias("low_share"), (F.count_if((x >= 1.5) & (x < 10)) / n).alias("gap_share"),
        (F.count_if((x >= 10) & (x < 14)) / n).alias("high_share"))
