"""Threshold sweeps, leakage, rational thresholds and ROC summaries."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import exact, stats, units
from .numbering import running_sums
from .small import join_small


def threshold_sweep(df: DataFrame, grid_db: Sequence[float], control_floor_db: float | None = None) -> DataFrame:
    """Masked and kept share and cleaned power for each excess threshold.

    A frame is placed once on the ascending grid (how many thresholds it
    exceeds); counts and power sums per place are then accumulated over at
    most one row per grid value, so frames are never multiplied by the grid.
    """
    grid = sorted({0.0, *[round(float(x), 6) for x in grid_db]})
    factors = [10.0 ** (x / 10.0) for x in grid]
    q = F.col("f") / F.col("mu0")
    tests = F.lit(0)
    held = df.where("valid").select("physical_channel", "baseband_power", "f", "mu0")
    for k in factors:
        tests = tests + (F.col("f") > F.col("mu0") * F.lit(k)).cast("int")
    cells = held.withColumn("_i", F.coalesce(tests, F.lit(0))).groupBy("physical_channel", "_i").agg(
        F.count(F.lit(1)).alias("n"), F.sum("baseband_power").alias("p"))
    grid_of = F.explode(F.array(*[F.struct(F.lit(i).alias("_i"), F.lit(x).alias("excess_db")) for i, x in enumerate(grid)]
                                + [F.struct(F.lit(len(grid)).alias("_i"), F.lit(None).cast("double").alias("excess_db"))]))
    full = cells.select("physical_channel").distinct().select("physical_channel", grid_of.alias("g")).select("physical_channel", "g.*")
    full = full.join(cells, ["physical_channel", "_i"], "left").fillna(0, ["n", "p"])
    # kept at grid value i: frames that exceed at most i thresholds
    kept = W.partitionBy("physical_channel").orderBy("_i")
    everything = W.partitionBy("physical_channel")
    t = full.select("physical_channel", "excess_db", F.sum("n").over(kept).alias("k"), F.sum("p").over(kept).alias("pk"),
                    F.sum("n").over(everything).alias("nv"), F.sum("p").over(everything).alias("pv"))
    cleaned = F.when(F.col("k") > 0, 10.0 * F.log10(F.col("pk") / F.col("k")))
    out = t.where(F.col("excess_db").isNotNull()).select(
        "physical_channel", "excess_db", F.col("nv").cast("long").alias("n_valid"),
        (1.0 - F.col("k") / F.col("nv")).alias("masked_fraction"), (F.col("k") / F.col("nv")).alias("kept_fraction"),
        (10.0 * F.log10(F.col("pv") / F.col("nv"))).alias("input_power_db"), cleaned.alias("cleaned_power_db"))
    if control_floor_db is not None:
        out = out.withColumn("residual_db", F.col("cleaned_power_db") - F.lit(float(control_floor_db)))
    return out


def sweep_anchor_mismatches(df: DataFrame) -> DataFrame:
    """Frames where the 0 dB threshold does not reproduce the stored mask."""
    return df.where(F.col("valid") & ((F.col("f") > F.col("mu0")) != F.col("reject")))


def recovered_mhz(sweep: DataFrame) -> DataFrame:
    return sweep.groupBy("excess_db").agg((F.sum("kept_fraction") * F.lit(C.COARSE_MHZ)).alias("recovered_mhz"),
                                          (F.count(F.lit(1)) * F.lit(C.COARSE_MHZ)).alias("affected_mhz"))


def band_sweep(df: DataFrame, centre: DataFrame, k0: float = -1.5, step: float = 0.05, steps: int = 91,
               band: float = 3.0) -> DataFrame:
    """Kept share below ``c - k*sigma`` and inside a band of ``band`` sigma
    under it, on an even grid of k.  ``centre`` has ``c`` and ``sigma`` per
    channel.  Places on the grid are arithmetic, so one count per frame."""
    j = join_small(df, centre, ["physical_channel"]).withColumn("_x", (F.col("c") - F.col("f")) / F.col("sigma"))
    top = lambda x: F.least(F.greatest(F.floor((x - k0) / step), F.lit(-1)), F.lit(steps - 1)).cast("int")
    past = F.least(F.greatest(F.ceil((F.col("_x") - band - k0) / step) - 1, F.lit(-1)), F.lit(steps - 1)).cast("int")
    placed = j.select("physical_channel", F.array(F.struct(top(F.col("_x")).alias("i"), F.lit(1).alias("a"), F.lit(0).alias("b")),
                                                  F.struct(past.alias("i"), F.lit(0).alias("a"), F.lit(1).alias("b"))).alias("s"))
    cells = placed.select("physical_channel", F.explode("s").alias("s")).groupBy("physical_channel", "s.i").agg(
        F.sum("s.a").alias("a"), F.sum("s.b").alias("b"))
    grid = cells.select("physical_channel").distinct().select(
        "physical_channel", F.explode(F.sequence(F.lit(-1), F.lit(steps - 1))).alias("i"))
    full = grid.join(cells, ["physical_channel", "i"], "left").fillna(0, ["a", "b"])
    w = W.partitionBy("physical_channel").orderBy(F.col("i").desc())
    n = F.sum("a").over(W.partitionBy("physical_channel"))
    t = full.select("physical_channel", "i", (F.sum("a").over(w) / n).alias("kept_one_sided"),
                    ((F.sum("a").over(w) - F.sum("b").over(w)) / n).alias("kept_band"))
    return t.where("i >= 0").select("physical_channel", "i", (F.lit(k0) + F.col("i") * F.lit(step)).alias("k"),
                                    "kept_one_sided", "kept_band")


def band_sweep_excess(sweep: DataFrame, band: float = 3.0) -> DataFrame:
    """Share of the kept frames beyond a Gaussian null for both rules."""
    h1 = stats.normal_cdf(-F.col("k"))
    hb = stats.normal_cdf(-F.col("k")) - stats.normal_cdf(-F.col("k") - band)
    over = lambda kept, h: F.when(kept > 0, F.greatest(kept - h, F.lit(0.0)) / kept).otherwise(0.0)
    return sweep.withColumns({"excess_one_sided": over(F.col("kept_one_sided"), h1),
                              "excess_band": over(F.col("kept_band"), hb)})


def leak_estimate(df: DataFrame, x: Column, c: DataFrame, span: float, width: float) -> DataFrame:
    """Signal share kept below a threshold: the histogram above the centre in
    excess of the mirrored histogram below it (linear between bin middles).

    ``c`` has ``centre`` and ``tau`` per channel.  The histogram of a channel
    is one bounded array."""
    bins = round(2 * span / width)
    placed = df.select("physical_channel", stats.uniform_bin(x, F.lit(-span), F.lit(-span + bins * width), bins).alias("bin"))
    counts = placed.groupBy("physical_channel", "bin").agg(F.count(F.lit(1)).alias("n"))
    grid = counts.select("physical_channel").distinct().select(
        "physical_channel", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    full = grid.join(counts, ["physical_channel", "bin"], "left").fillna(0, ["n"])
    arrays = full.groupBy("physical_channel").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("bin", "n"))), lambda s: s["n"].cast("double")).alias("ns"))
    total = counts.groupBy("physical_channel").agg(F.sum("n").alias("total"))
    t = arrays.join(c, "physical_channel").join(total, "physical_channel")
    one = t.select("physical_channel", "centre", "tau", "total", "ns", F.posexplode("ns").alias("bin", "n"))
    mid = F.lit(-span) + (F.col("bin") + 0.5) * width
    pos = (2 * F.col("centre") - mid - (-span + 0.5 * width)) / width
    one = one.withColumn("mid", mid).withColumn("pos", pos).withColumn("j", F.floor("pos").cast("int"))
    at = lambda j: F.get("ns", j)
    inside = (F.col("pos") >= 0) & (F.col("pos") <= bins - 1)
    mirror = F.when(inside, at(F.col("j")) + (F.col("pos") - F.col("j")) * (F.coalesce(at(F.col("j") + 1), at(F.col("j"))) - at(F.col("j")))).otherwise(0.0)
    one = one.withColumn("excess", F.greatest(F.col("n") - mirror, F.lit(0.0)))
    above = F.col("mid") > F.col("centre")
    leak = F.sum(F.when(above & (F.col("mid") <= F.col("tau")), F.col("excess")).otherwise(0.0))
    every = F.sum(F.when(above, F.col("excess")).otherwise(0.0))
    open_ = F.min("tau") > F.min("centre")
    return one.groupBy("physical_channel").agg(
        F.when(open_, leak / F.min("total")).otherwise(0.0).alias("leak_fraction"),
        F.when(open_ & (every > 0), leak / every).otherwise(0.0).alias("leak_of_excess"))


def rational_thresholds(df: DataFrame, mu: DataFrame, limit: int = C.EMPIRICAL_MAX_DENOMINATOR) -> DataFrame:
    """Ceiling and floor as P/Q with a bounded Q, and the frames on which the
    integer masks differ from the float masks."""
    t = mu.select("physical_channel", "mu_hat", "mu0", (F.col("mu_hat") / 2).alias("_hi"),
                  ((F.col("mu_hat") - F.lit(C.TAIL_EDGE) * F.col("mu0")) / 2).alias("_lo"))
    hi = units.with_half_rational(t, "_hi", limit).withColumnRenamed("half_num", "p").withColumnRenamed("half_den", "q")
    both = units.with_half_rational(hi, "_lo", limit).withColumnRenamed("half_num", "p_lo").withColumnRenamed("half_den", "q_lo")
    j = join_small(df.where(F.col("valid")).drop("mu0"), both, ["physical_channel"])
    pt, pr, f = F.col("p_target"), F.col("p_ref_sum"), F.col("f")
    above = exact.exact_greater(pt, F.col("q"), pr, F.col("p"), right_digits=17)
    below = exact.exact_greater(pr, F.col("p_lo"), pt, F.col("q_lo"), right_digits=17)
    top = F.greatest(F.max(pt.cast("double") * F.greatest("q", "q_lo").cast("double")),
                     F.max(pr.cast("double") * F.greatest("p", "p_lo").cast("double")))
    return j.groupBy("physical_channel", "p", "q", "p_lo", "q_lo", "mu_hat").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(above != (f > F.col("mu_hat"))).alias("mismatch_ceiling"),
        F.count_if(below != (f < 2 * F.col("_lo"))).alias("mismatch_floor"),
        (F.floor(F.log2(top)) + 1).cast("int").alias("product_bits"),
        F.abs(2.0 * F.first("p").cast("double") / F.first("q").cast("double") - F.first("mu_hat")).alias("error_ceiling"))


def _roc(scores: DataFrame, keys: Sequence[str], max_rows: int | None) -> DataFrame:
    """False-alarm and detection rate strictly above each distinct null score."""
    v = scores.groupBy(*keys, "score").agg(F.count_if(~F.col("signal")).alias("nn"), F.count_if("signal").alias("ns"))
    r = running_sums(v, keys, "score", ["nn", "ns"], descending=True, max_rows=max_rows)
    return r.where("nn > 0").select(
        *keys, "score", ((F.col("cum_nn") - F.col("nn")) / F.col("all_nn")).alias("p_fa"),
        ((F.col("cum_ns") - F.col("ns")) / F.when(F.col("all_ns") > 0, F.col("all_ns"))).alias("p_d"))


def roc_youden(scores: DataFrame, keys: Sequence[str], targets: Sequence[float] = (0.1, 0.01, 0.001),
               max_rows: int | None = None) -> DataFrame:
    """Largest ``P_d - P_fa`` over distinct null scores and P_d at the score
    whose P_fa is nearest to each target; ties take the smaller score.

    ``scores``: keys, ``score``, ``signal`` flag."""
    r = _roc(scores, keys, max_rows)
    pick = F.struct("score", "p_fa", "p_d")
    j = F.col("p_d") - F.col("p_fa")
    at = [F.min_by(pick, F.struct(F.abs(F.col("p_fa") - t), F.col("score"))).alias(f"t{i}") for i, t in enumerate(targets)]
    g = r.groupBy(*keys).agg(F.max_by(pick, F.struct(j, -F.col("score"))).alias("b"), *at)
    out = [F.col("b.score").alias("threshold"), (F.col("b.p_d") - F.col("b.p_fa")).alias("youden_j"),
           F.col("b.p_fa").alias("p_fa"), F.col("b.p_d").alias("p_d")]
    out += [F.col(f"t{i}.p_d").alias(f"p_d_at_{t:g}".replace(".", "_")) for i, t in enumerate(targets)]
    return g.select(*keys, *out)
