"""Summaries of trial tables: rates, order statistics, crossings, KS, recovery."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import stats
from ..session import materialize
from .bootstrap import resampled_sums
from .numbering import running_sums
from .quantiles import grouped_quantiles
from .small import join_scalar, join_small

CONTROL_FRAMES_PER_FALSE_ALARM = 10.0


def paired_trials(df: DataFrame, trial: str, grid: str, strict: bool = False) -> DataFrame:
    """Trials present at every grid value; ``strict`` refuses duplicates."""
    if strict and not df.groupBy(trial, grid).count().where("count > 1").isEmpty():
        raise ValueError("a trial is repeated at one grid value")
    total = df.agg(F.count_distinct(grid).alias("_g"))
    full = df.groupBy(trial).agg(F.count_distinct(grid).alias("_n")).join(F.broadcast(total), F.col("_n") == F.col("_g"))
    return df.join(full.select(trial), trial, "left_semi")


def sweep_summary(df: DataFrame, keys: Sequence[str], value: str, detected: Column) -> DataFrame:
    """Mean, SD and largest value with the detection rate and its bounds."""
    n = F.count(F.lit(1))
    g = df.groupBy(*keys).agg(n.alias("trials"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"),
                              F.max(value).alias("max"), F.count_if(detected).alias("detected"))
    low, high = stats.wilson(F.col("detected"), F.col("trials"))
    return g.select("*", stats.fraction(F.col("detected"), F.col("trials")).alias("rate"), low.alias("rate_lo"), high.alias("rate_hi"))


def order_statistic_threshold(null: DataFrame, keys: Sequence[str], value: str, p_fa: float,
                              max_rows: int | None = None) -> DataFrame:
    """Observed order statistic at ``ceil((1-p)*n) - 1`` and its strict
    exceedances; equal values are counted before ranking."""
    v = null.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    r = running_sums(v, keys, value, ["n"], max_rows=max_rows)
    index = F.least(F.col("all_n") - 1, F.greatest(F.lit(0), F.ceil(F.lit(1.0 - p_fa) * F.col("all_n")) - 1))
    hit = r.where((F.col("cum_n") - F.col("n") <= index) & (index < F.col("cum_n")))
    over = F.col("all_n") - F.col("cum_n")
    return hit.select(
        *keys, F.col(value).alias("threshold"), index.cast("long").alias("order_index"), F.col("all_n").alias("null_trials"),
        over.alias("null_exceedances"), (over / F.col("all_n")).alias("empirical_p_fa"),
        (F.col("all_n") * F.lit(p_fa) >= 1.0).alias("resolved"), q16_multiplier(F.col(value)).alias("multiplier_q16"))


def q16_multiplier(x: Column) -> Column:
    """Positive threshold rounded up to 1/65536."""
    return F.ceil(x * F.lit(float(C.Q16_ONE))).cast("long")


def decision_rates(df: DataFrame, thresholds: DataFrame, keys: Sequence[str], by: Sequence[str], value: str) -> DataFrame:
    """Rates of strict exceedance of the raw and of the Q16 threshold."""
    j = join_small(df, thresholds.select(*keys, "threshold", "multiplier_q16"), keys)
    n, x = F.count(F.lit(1)), F.col(value)
    return j.groupBy(*keys, *by).agg(
        n.alias("trials"), (F.count_if(x > F.col("threshold")) / n).alias("rate"),
        (F.count_if(x * float(C.Q16_ONE) > F.col("multiplier_q16")) / n).alias("rate_q16"))


def crossing(rates: DataFrame, keys: Sequence[str], x: str, rate: str, target: float) -> DataFrame:
    """First bracket of the running-max rate around the target with the linear
    crossing; undefined when no bracket exists (never extrapolated).

    A rate table has one row per grid value."""
    w = W.partitionBy(*keys).orderBy(x)
    y = rates.withColumn("_y", F.max(rate).over(w))
    y = y.select(*keys, x, rate, "_y", F.lag("_y").over(w).alias("_y0"), F.lag(x).over(w).alias("_x0"))
    inside = (F.col("_y0") < target) & (F.col("_y") >= target)
    est = F.col("_x0") + (F.col(x) - F.col("_x0")) * (target - F.col("_y0")) / (F.col("_y") - F.col("_y0"))
    hit = F.min(F.when(inside, F.struct(F.col(x).cast("double").alias("x"), F.col("_x0").cast("double").alias("x0"), "_y0", "_y", est.alias("e"))))
    g = y.groupBy(*keys).agg(hit.alias("h"), F.max(F.col("_y") - F.col(rate)).alias("adjustment"))
    return g.select(*keys, F.col("h").isNotNull().alias("bracketed"), F.col("h.x0").alias("snr_lo"), F.col("h.x").alias("snr_hi"),
                    F.col("h._y0").alias("pd_lo"), F.col("h._y").alias("pd_hi"), F.col("h.e").alias("estimate"), "adjustment")


def ks_distance(df: DataFrame, keys: Sequence[str], value: str, second: Column, max_rows: int | None = None) -> DataFrame:
    """Largest distance of two empirical laws against ``1.36*sqrt((n+m)/nm)``."""
    v = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(
        F.count_if(~second).alias("a"), F.count_if(second).alias("b"))
    r = running_sums(v, keys, value, ["a", "b"], max_rows=max_rows)
    gap = F.abs(F.col("cum_a") / F.col("all_a") - F.col("cum_b") / F.col("all_b"))
    g = r.where("all_a > 0 AND all_b > 0").groupBy(*keys).agg(
        F.max(gap).alias("distance"), F.first("all_a").alias("n_first"), F.first("all_b").alias("n_second"))
    crit = F.lit(1.36) * F.sqrt((F.col("n_first") + F.col("n_second")) / (F.col("n_first") * F.col("n_second")))
    return g.withColumn("critical", crit).withColumn("passes", F.col("distance") <= F.col("critical"))


def paired_crossing_bootstrap(df: DataFrame, trial: str, x: str, value: str, threshold: float, target: float,
                              replicates: int, seed: int, max_rows: int | None = None) -> DataFrame:
    """Crossing of resampled trials, one resample shared by all grid values.

    ``df`` is paired.  Each trial becomes one row with its outcome at every grid value, of which there are few; a replicate's
    draws are counted where they are made, and blocks of counts meet the outcomes once."""
    hits = materialize(df.groupBy(trial, x).agg(F.max((F.col(value) > threshold).cast("int")).alias("hit")))
    grid = sorted(r[0] for r in hits.where(F.col(x).isNotNull()).select(x).distinct().collect()) or [0]
    at = [F.col(x) == F.lit(g) for g in grid]
    wide = hits.groupBy(trial).agg(*[F.max(F.when(a, F.col("hit"))).alias(f"_h{i}") for i, a in enumerate(at)],
                                   *[F.count_if(a).alias(f"_n{i}") for i, a in enumerate(at)])
    sums = [f"_{k}{i}" for i in range(len(grid)) for k in "hn"]
    drawn = resampled_sums(wide.withColumn("_g", F.lit(0)), ["_g"], trial, sums, replicates, seed, max_rows)
    cells = F.array(*[F.struct(F.lit(g).cast(df.schema[x].dataType).alias(x), F.col(f"_h{i}").alias("h"), F.col(f"_n{i}").alias("n")) for i, g in enumerate(grid)])
    rates = drawn.select("replicate", F.explode(cells).alias("c")).where("c.n > 0").select(
        "replicate", f"c.{x}", (F.col("c.h") / F.col("c.n")).alias("rate"))
    cross = crossing(rates, ["replicate"], x, "rate", target)
    ok = cross.where("bracketed").withColumn("_g", F.lit(0))
    return grouped_quantiles(ok, ["_g"], {"low": ("estimate", 0.025), "median": ("estimate", 0.5), "high": ("estimate", 0.975)},
                             [F.count(F.lit(1)).alias("valid_replicates")], max_rows=replicates).drop("_g")


def injection_points(df: DataFrame, amplitude: str, excess: str) -> DataFrame:
    """Mean excess and its standard error per amplitude."""
    return df.groupBy(amplitude).agg(
        F.count(F.lit(1)).alias("n_valid"), F.avg(excess).alias("rho_hat"),
        (F.stddev_samp(excess) / F.sqrt(F.count(F.lit(1)))).alias("rho_sem")).withColumn(
        "injected_power", F.col(amplitude) * F.col(amplitude))


def injection_detection(df: DataFrame, amplitude: str, statistics: Sequence[str], rates: Sequence[float],
                        max_rows: int | None = None) -> DataFrame:
    """Detection rate with bounds per amplitude, statistic and false-alarm rate.

    Thresholds are quantiles of the zero-amplitude control, kept only where the
    control has at least ten frames per false alarm."""
    control = df.where(F.col(amplitude) == 0)
    names = [(s, p, f"t_{i}_{j}") for i, s in enumerate(statistics) for j, p in enumerate(rates)]
    th = grouped_quantiles(control.withColumn("_g", F.lit(0)), ["_g"], {n: (s, 1 - p) for s, p, n in names},
                           [F.count(F.lit(1)).alias("n_control")], max_rows=max_rows).drop("_g")
    j = join_scalar(df, th)
    n = F.count(F.lit(1))
    g = j.groupBy(amplitude).agg(n.alias("n_valid"), F.first("n_control").alias("n_control"),
                                 *[F.count_if(F.col(s) > F.col(t)).alias(t) for s, _, t in names])
    rows = F.array(*[F.struct(F.lit(s).alias("statistic"), F.lit(float(p)).alias("p_fa"), F.col(t).alias("detected")) for s, p, t in names])
    long = g.select(amplitude, "n_valid", "n_control", F.explode(rows).alias("r")).select(amplitude, "n_valid", "n_control", "r.*")
    long = long.where(F.col("n_control") >= F.lit(CONTROL_FRAMES_PER_FALSE_ALARM) / F.col("p_fa"))
    low, high = stats.wilson(F.col("detected"), F.col("n_valid"))
    return long.select("*", stats.fraction(F.col("detected"), F.col("n_valid")).alias("p_d"), low.alias("p_d_lo"), high.alias("p_d_hi"))


def recovery_fit(points: DataFrame) -> DataFrame:
    """Weighted line ``rho = floor + gain*power`` from five weighted sums, and
    the log-log slope over signal-dominated points."""
    w = 1.0 / (F.col("rho_sem") * F.col("rho_sem"))
    x, y = F.col("injected_power").cast("double"), F.col("rho_hat")
    s = points.agg(F.sum(w).alias("s0"), F.sum(w * x).alias("s1"), F.sum(w * x * x).alias("s2"),
                   F.sum(w * y).alias("t0"), F.sum(w * x * y).alias("t1"))
    det = F.col("s0") * F.col("s2") - F.col("s1") * F.col("s1")
    fit = s.select(((F.col("s2") * F.col("t0") - F.col("s1") * F.col("t1")) / det).alias("floor"),
                   ((F.col("s0") * F.col("t1") - F.col("s1") * F.col("t0")) / det).alias("gain"),
                   F.sqrt(F.col("s2") / det).alias("floor_err"), F.sqrt(F.col("s0") / det).alias("gain_err"))
    j = join_scalar(points, fit)
    strong = (x * F.col("gain") > 3.0 * F.abs("floor")) & (y > F.col("floor"))
    lx, ly = F.when(strong, F.log10(x)), F.when(strong, F.log10(y - F.col("floor")))
    slope = j.agg(F.when(F.count(lx) >= 2, F.regr_slope(ly, lx)).alias("log_slope"))
    return join_scalar(fit, slope)
