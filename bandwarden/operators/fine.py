"""Fine-bin spectra: null bulk, CFAR, exact decisions, anchors, lines."""
from __future__ import annotations

from collections.abc import Sequence
from functools import cmp_to_key
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import constants as C
from ..functions import clock, geometry as G
from .quantiles import grouped_quantiles
from .small import CHANNEL_ROWS, join_small


def false_alarm_factor(p_fa: float) -> float:
    """One-sided Gaussian multiplier of a false-alarm probability."""
    if not 0.0 < p_fa < 0.5:
        raise ValueError("the false-alarm probability must lie in (0, 0.5)")
    return NormalDist().inv_cdf(1.0 - p_fa)


def in_null_bulk(b: Column, anchor: Column, half_width: int, n: int, pad: int = C.FINE_PAD,
                 guard: int = C.CFAR_GUARD_BINS, excluded: Sequence[int] = ()) -> Column:
    """Every ``pad``-th bin outside the guarded window and the census bins."""
    ok = (F.pmod(b, F.lit(pad)) == 0) & ~G.in_circular_window(b, anchor, half_width + guard * pad, n)
    return ok & ~b.isin(*[int(e) % n for e in excluded]) if excluded else ok


def null_bulk_bins(anchor: Column, half_width: int, n: int, **kw) -> Column:
    return F.filter(F.sequence(F.lit(0), F.lit(n - 1)), lambda b: in_null_bulk(b, anchor, half_width, n, **kw))


def bulk_mask_words(df: DataFrame, keys: Sequence[str], bins: str) -> DataFrame:
    """Set bins packed into 64-bit words, one row per word."""
    from ..functions.samples import mask_bit, mask_word
    b = df.select(*keys, F.explode(bins).alias("_b"))
    return b.groupBy(*keys, mask_word(F.col("_b")).alias("word")).agg(F.bit_or(mask_bit(F.col("_b"))).alias("bits"))


def unpack_mask_words(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    b = df.select(*keys, "word", "bits", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("_i"))
    return b.where(F.bit_get(F.col("bits"), F.col("_i")) == 1).select(*keys, (F.col("word") * 64 + F.col("_i")).alias("bin"))


_CFAR = T.StructType([T.StructField(n, t) for n, t in (
    ("location", T.DoubleType()), ("scale", T.DoubleType()), ("threshold", T.DoubleType()), ("null_fraction", T.DoubleType()),
    ("fallback", T.BooleanType()), ("detected", T.ArrayType(T.IntegerType())))])


def with_cfar(df: DataFrame, bulk: str, fine: str = "fine_ratio", p_fa: float = C.CFAR_P_FA) -> DataFrame:
    """Adds the null calibration of each frame and its bins above threshold.

    One Arrow batch is one matrix: medians and quantiles are taken for all of
    its frames at once.  ``bulk`` is an array of null bin numbers."""
    k = false_alarm_factor(p_fa)

    def calibrate(x: np.ndarray, null: np.ndarray) -> dict[str, np.ndarray]:
        q = lambda p: np.quantile(null, p, axis=1)
        loc = q(0.5)
        scale = loc - q(C.CFAR_LEFT_QUANTILE)
        sd = null.std(axis=1)
        scale = np.where(scale > 0, scale, np.where(sd > 0, sd, 1.0))
        thr = loc + k * scale
        share = (null > thr[:, None]).mean(axis=1)
        bad = share > C.CFAR_FALLBACK_FRACTION
        loc2 = q(C.CFAR_FALLBACK_LOCATION)
        scale2 = np.maximum((loc2 - q(C.CFAR_FALLBACK_LEFT)) / 2, 1e-12)
        loc, scale = np.where(bad, loc2, loc), np.where(bad, scale2, scale)
        thr = loc + k * scale
        return {"location": loc, "scale": scale, "threshold": thr,
                "null_fraction": (null > thr[:, None]).mean(axis=1), "fallback": bad,
                "detected": [np.flatnonzero(r).tolist() for r in x > thr[:, None]]}

    @F.pandas_udf(_CFAR)
    def cfar(ratio: pd.Series, bins: pd.Series) -> pd.DataFrame:
        parts = []
        for chosen, rows in bins.groupby(bins.map(tuple)).groups.items():
            if len(chosen) < 8:
                raise ValueError("fewer than eight null bins")
            x = np.stack(ratio.loc[rows].to_list()).astype(float)
            parts.append(pd.DataFrame(calibrate(x, x[:, list(chosen)]), index=rows))
        return pd.concat(parts).reindex(ratio.index)

    return df.withColumn("_c", cfar(F.col(fine), F.col(bulk))).select("*", "_c.*").drop("_c")


def detections(calibrated: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per (frame, bin) above threshold, in bin order."""
    return calibrated.select(*keys, F.posexplode("detected").alias("order", "bin"))


_DECISION = T.StructType([T.StructField(n, t) for n, t in (
    ("mask", T.IntegerType()), ("usable", T.BooleanType()), ("n_bulk", T.IntegerType()), ("rank_bin", T.IntegerType()),
    ("fired_bin", T.IntegerType()))])


_SURE = 2.0 ** -49  # two rounded operands, their quotient and a product by a constant stay within a fifth of this


def _integers(rows: list) -> np.ndarray:
    """Rows of whole numbers, as Python integers where twice a value could leave 64 bits."""
    a = np.asarray(rows)
    if a.dtype == object:
        return np.array([[int(x) for x in row] for row in rows], object)
    return a.astype(object if int(a.max(initial=0)) >= 1 << 61 else np.int64)


def _smaller(p: tuple[int, int], q: tuple[int, int]) -> int:
    """Order of two fractions, each a numerator and a positive denominator."""
    left, right = p[0] * q[1], q[0] * p[1]
    return (left > right) - (left < right)


def rational_decisions(t: list, lower: list, upper: list, anchor: np.ndarray, null: list, rank: int, multiplier_q16: int,
                       half_width: int) -> np.ndarray:
    """Columns mask, usable, n_bulk, rank_bin, fired_bin for frames whose arrays have one length.

    Doubles order the ratios ``2 t / (lower + upper)`` wherever they differ by more than the error of their division;
    only ratios closer than that are compared as integers, products of any length."""
    n = len(t[0])
    exact_t, exact_d = 2 * _integers(t), _integers(lower) + _integers(upper)
    good = (exact_d > 0).astype(bool)
    ratio = np.where(good, exact_t.astype(float) / np.where(good, exact_d, 1).astype(float), np.inf)
    bulk = np.zeros(good.shape, bool)
    row = np.repeat(np.arange(len(null)), [len(x) for x in null])
    bulk[row, np.concatenate([np.asarray(x, np.int64) for x in null]) if len(row) else row] = True
    bulk &= good
    n_bulk = bulk.sum(1)
    out = np.zeros((len(t), 5), np.int64)
    out[:, 2], out[:, 3], out[:, 4] = n_bulk, -1, -1
    rows = np.flatnonzero(n_bulk > rank)
    if not len(rows):
        return out
    held = np.where(bulk[rows], ratio[rows], np.inf)
    place = np.argsort(held, axis=1, kind="stable")[:, rank]
    level = held[np.arange(len(rows)), place]
    close = bulk[rows] & (np.abs(ratio[rows] - level[:, None]) <= level[:, None] * _SURE)
    below = (bulk[rows] & (ratio[rows] < level[:, None]) & ~close).sum(1)
    rank_bin, level_bin = place.copy(), place.copy()
    for i in np.flatnonzero(close.sum(1) > 1):
        fraction = lambda b, r=rows[i]: (int(exact_t[r, b]), int(exact_d[r, b]))
        near = sorted(np.flatnonzero(close[i]).tolist(), key=cmp_to_key(lambda p, q: _smaller(fraction(p), fraction(q)) or p - q))
        level_bin[i] = near[rank - below[i]]
        rank_bin[i] = next(b for b in near if not _smaller(fraction(b), fraction(level_bin[i])))
    window = (anchor[rows][:, None] + np.arange(-half_width, half_width + 1)) % n
    mine = (np.arange(len(rows))[:, None], window)
    value, limit = ratio[rows][mine] * C.Q16_ONE, ratio[rows, level_bin] * multiplier_q16
    open_ = good[rows][mine]
    over = open_ & (value > limit[:, None] * (1 + _SURE))
    unsure = open_ & ~over & (value >= limit[:, None] * (1 - _SURE))
    for i, k in zip(*np.nonzero(unsure)):
        r, b, base = rows[i], window[i, k], level_bin[i]
        over[i, k] = int(exact_t[r, b]) * C.Q16_ONE * int(exact_d[r, base]) > int(exact_t[r, base]) * multiplier_q16 * int(exact_d[r, b])
    fired = over.any(1)
    out[rows, 0], out[rows, 1], out[rows, 3] = fired, 1, rank_bin
    out[rows, 4] = np.where(fired, window[np.arange(len(rows)), over.argmax(1)], -1)
    return out


def with_fine_decision(df: DataFrame, target: str, lower: str, upper: str, anchor: str, bulk: str, rank: int,
                       multiplier_q16: int, half_width: int) -> DataFrame:
    """Adds the exact order-statistic decision of each frame.

    Ratios are ordered as rationals: the rank value is the ``rank``-th smallest null ratio; the first window bin above
    it times the multiplier fires."""
    if multiplier_q16 <= 0 or rank < 0:
        raise ValueError("rank must be non-negative and the multiplier positive")

    @F.pandas_udf(_DECISION)
    def decision(t: pd.Series, lo: pd.Series, up: pd.Series, a: pd.Series, null: pd.Series) -> pd.DataFrame:
        out = np.zeros((len(t), 5), np.int64)
        length = t.map(len).to_numpy()
        out[:, 3:] = -1
        for n in np.unique(length[length > 0]):
            at = np.flatnonzero(length == n)
            pick = lambda s: [s.iloc[i] for i in at]
            out[at] = rational_decisions(pick(t), pick(lo), pick(up), a.to_numpy(np.int64)[at], pick(null), rank, multiplier_q16, half_width)
        return pd.DataFrame({"mask": out[:, 0], "usable": out[:, 1].astype(bool), "n_bulk": out[:, 2], "rank_bin": out[:, 3], "fired_bin": out[:, 4]})

    return df.withColumn("_d", decision(target, lower, upper, anchor, bulk)).select("*", "_d.*").drop("_d")


def array_median(a: Column) -> Column:
    """Median of an array of values."""
    s, n = F.array_sort(a), F.size(a)
    low, high = F.floor((n - 1) / 2).cast("int"), F.floor(n / 2).cast("int")
    return F.when(n > 0, (F.get(s, low).cast("double") + F.get(s, high).cast("double")) / 2)


def normalized_bins(df: DataFrame, keys: Sequence[str], fine: str = "fine_ratio") -> DataFrame:
    """Bins over the median of their own frame; frames without a positive
    median are left out."""
    held = df.select(*keys, fine, array_median(F.col(fine)).alias("_m")).where(F.col("_m") > 0)
    return held.select(*keys, "_m", F.posexplode(fine).alias("bin", "_x")).select(
        *keys, "bin", (F.col("_x").cast("double") / F.col("_m")).alias("x"))


def line_map(df: DataFrame, keys: Sequence[str], line_ratio: float = C.LINE_RATIO, max_rows: int | None = None) -> DataFrame:
    """Per bin: share of frames at or above the line ratio and median."""
    x = normalized_bins(df, keys)
    n = F.count(F.lit(1))
    return grouped_quantiles(x, [*keys, "bin"], {"line_ratio": ("x", 0.5)},
                             [n.alias("n"), (F.count_if(F.col("x") >= line_ratio) / n).alias("persistence")], max_rows=max_rows)


def epoch_line_anchor(df: DataFrame, predicted: DataFrame, n_bins: int, half_width: int = C.ANCHOR_HALF_WIDTH,
                      line_ratio: float = C.LINE_RATIO, line_half_width: int = C.LINE_HALF_WIDTH,
                      min_frames: int = C.ANCHOR_MIN_FRAMES, min_persistence: float = C.ANCHOR_MIN_PERSISTENCE,
                      min_margin: float = C.ANCHOR_MIN_MARGIN, clear: int = C.ANCHOR_CLEAR_HALF_WIDTH,
                      max_rows: int | None = None) -> DataFrame:
    """Persistent narrow line per (channel, quarter) near the predicted bin.

    A candidate is refused for few frames, low persistence, a close competitor
    in the window, or an edge place beside a stronger outside line; the window
    then falls back to the prediction.  ``predicted``: channel, predicted."""
    q = ["physical_channel", "quarter"]
    held = df.withColumn("quarter", clock.quarter_label(F.col("frame_time")))
    bins = join_small(line_map(held, q, line_ratio, max_rows), predicted, ["physical_channel"])
    inside = G.in_circular_window(F.col("bin"), F.col("predicted"), half_width, n_bins)
    value = F.struct("bin", "persistence", "line_ratio")
    order = F.struct("persistence", "line_ratio", -F.col("bin"))
    bins = bins.withColumn("inside", inside)
    best = bins.groupBy(*q, "predicted").agg(
        F.max("n").alias("usable_frames"),
        F.max_by(F.when(F.col("inside"), value), F.when(F.col("inside"), order)).alias("c"),
        F.max_by(F.when(~F.col("inside"), value), F.when(~F.col("inside"), order)).alias("o"))
    j = bins.join(best.select(*q, F.col("c.bin").alias("_cb")), q)
    far = F.col("inside") & ~G.in_circular_window(F.col("bin"), F.col("_cb"), clear, n_bins)
    rival = j.groupBy(*q).agg(F.coalesce(F.max(F.when(far, F.col("persistence"))), F.lit(0.0)).alias("competitor"))
    t = best.join(rival, q)
    delta = G.circular_delta(F.col("c.bin"), F.col("predicted"), n_bins)
    margin = F.col("c.persistence") - F.col("competitor")
    edge = (half_width - F.abs(delta) <= line_half_width) & (F.col("o.persistence") > F.col("c.persistence"))
    why = F.array_compact(F.array(
        F.when(F.col("usable_frames") < min_frames, F.lit("few_frames")),
        F.when(F.col("c.persistence") < min_persistence, F.lit("low_persistence")),
        F.when(margin < min_margin, F.lit("close_competitor")),
        F.when(edge, F.lit("edge_beside_outside_line"))))
    t = t.withColumn("refusals", why)
    ok = F.size("refusals") == 0
    return t.select(*q, "usable_frames", F.col("c.bin").alias("candidate_bin"), delta.alias("candidate_delta"),
                    F.col("c.persistence").alias("persistence"), F.col("c.line_ratio").alias("line_ratio"), "competitor",
                    margin.alias("margin"), F.col("o.bin").alias("outside_bin"), F.concat_ws("+", "refusals").alias("refusals"),
                    F.when(ok, F.col("c.bin")).otherwise(F.col("predicted")).alias("selected_bin"),
                    F.when(ok, line_half_width).otherwise(half_width).alias("selected_half_width"))


def detected_anchor(found: DataFrame, frames: DataFrame, min_share: float = 0.10) -> DataFrame:
    """Bin detected in the largest share of frames, or bin 0 below the share."""
    n = frames.groupBy("physical_channel").agg(F.count(F.lit(1)).alias("n_frames"))
    hits = found.groupBy("physical_channel", "bin").agg(F.count(F.lit(1)).alias("hits"))
    top = hits.groupBy("physical_channel").agg(F.max(F.struct(F.col("hits"), (-F.col("bin")).alias("nb"))).alias("t"))
    j = n.join(top, "physical_channel", "left")
    share = F.coalesce(F.col("t.hits"), F.lit(0)) / F.col("n_frames")
    ok = share >= min_share
    peak = -F.col("t.nb")
    return j.select("physical_channel", "n_frames", share.alias("share"), ok.alias("anchored"),
                    F.when(ok, peak).otherwise(F.lit(0)).cast("int").alias("anchor"))


def null_tiles(lines: DataFrame, anchors: DataFrame, n_bins: int, half_width: int, clear_bins: int,
               line_ratio: float = C.LINE_RATIO) -> DataFrame:
    """Disjoint windows of the designated width away from anchor and lines.

    A channel has at most ``n_bins`` rows here.  Free bins form runs; each run
    is cut into whole windows from its start."""
    j = join_small(lines.select("physical_channel", "bin", (F.col("line_ratio") >= line_ratio).alias("line")), anchors.select(
        "physical_channel", "anchor"), ["physical_channel"])
    spread = j.where("line").select("physical_channel", F.explode(G.circular_window(F.col("bin"), half_width + 2, n_bins)).alias("bin"))
    near = G.in_circular_window(F.col("bin"), F.col("anchor"), half_width + clear_bins, n_bins)
    free = j.where(~near).select("physical_channel", "bin").join(spread.distinct(), ["physical_channel", "bin"], "left_anti")
    w = W.partitionBy("physical_channel").orderBy("bin")
    run = free.withColumn("_run", F.col("bin") - F.row_number().over(w))
    inside = W.partitionBy("physical_channel", "_run").orderBy("bin")
    cut = run.withColumn("_t", F.floor((F.row_number().over(inside) - 1) / (2 * half_width + 1)))
    return cut.groupBy("physical_channel", "_run", "_t").agg(F.min("bin").alias("first"), F.max("bin").alias("last"), F.count(
        F.lit(1)).alias("n")).where(F.col("n") == 2 * half_width + 1).select("physical_channel", "first", "last")


def window_max(fine: Column, anchor: Column, half_width: int, n_bins: int) -> Column:
    """Largest value of a circular window of an array."""
    return F.array_max(F.transform(G.circular_window(anchor, half_width, n_bins), lambda b: F.get(fine, b.cast("int")))).cast("double")


def null_populations(df: DataFrame, tiles: DataFrame, off: DataFrame, fine: str = "fine_ratio", stat: str = "stat") -> DataFrame:
    """``physical_channel``, ``quarter``, ``population``, ``value``: what the edge histograms count, in one pass over the frames.

    ``on_sky``: the window statistic of every frame; ``off_epoch``: that of frames in ``off`` quarters; ``off_pilot``: the
    largest bin of every null tile of the channel.  ``tiles`` and ``off`` hold at most one row per bin and quarter of a channel."""
    spans = tiles.groupBy("physical_channel").agg(F.array_sort(F.collect_list(F.struct("first", "last"))).alias("_tiles"))
    quiet = off.select("physical_channel", "quarter", F.lit(True).alias("_off"))
    j = join_small(join_small(df, spans, ["physical_channel"], how="left"), quiet, ["physical_channel", "quarter"], how="left")
    one = lambda name, value: F.struct(F.lit(name).alias("population"), value.cast("double").alias("value"))
    windows = F.transform(F.coalesce("_tiles", F.array().cast("array<struct<first:int,last:int>>")), lambda t: one(
        "off_pilot", F.array_max(F.slice(F.col(fine), t["first"] + 1, t["last"] - t["first"] + 1))))
    plain = F.array(one("on_sky", F.col(stat)))
    return j.select("physical_channel", "quarter", F.explode(F.concat(
        plain, windows, F.when(F.col("_off"), F.array(one("off_epoch", F.col(stat)))).otherwise(
            F.array().cast("array<struct<population:string,value:double>>")))).alias("p")).select("physical_channel", "quarter", "p.*")


def population_sums(counts: DataFrame, frames: DataFrame, tiles: DataFrame, off: DataFrame) -> DataFrame:
    """Histogram sums beside what the frames demand: one count a frame on sky and off epoch, one a tile off pilot."""
    keys = ["physical_channel", "quarter"]
    have = counts.groupBy(*keys, "population").agg(F.sum("n").alias("counted"))
    n = frames.groupBy(*keys).agg(F.count(F.lit(1)).alias("frames"))
    per = tiles.groupBy("physical_channel").agg(F.count(F.lit(1)).alias("tiles"))
    want = n.select(*keys, F.lit("on_sky").alias("population"), F.col("frames").alias("expected"))
    want = want.unionByName(n.join(off.select(*keys), keys).select(*keys, F.lit("off_epoch").alias("population"), F.col("frames").alias("expected")))
    want = want.unionByName(n.join(per, "physical_channel").select(*keys, F.lit("off_pilot").alias("population"), (F.col("frames") * F.col("tiles")).alias("expected")))
    return want.join(have, [*keys, "population"], "full").select(
        *keys, "population", F.coalesce("counted", F.lit(0)).alias("counted"), F.coalesce("expected", F.lit(0)).alias("expected"),
        F.col("counted").eqNullSafe(F.col("expected")).alias("agrees"))


def off_quarters(df: DataFrame, stat: str, limit: float = 1.5, min_n: int = 30, max_rows: int | None = None) -> DataFrame:
    """(channel, quarter) whose median window statistic sits at the null."""
    g = grouped_quantiles(df, ["physical_channel", "quarter"], {"median": (stat, 0.5)}, [F.count(F.lit(1)).alias("n")], max_rows=max_rows)
    return g.where((F.col("n") >= min_n) & (F.col("median") < limit))


def unit_maxima(df: DataFrame, stat: str, unit: str = "unit_id") -> DataFrame:
    """Largest window statistic, first time and frames per unit."""
    return df.groupBy("physical_channel", unit).agg(F.max(stat).alias("unit_max"), F.min("frame_time").alias("unit_time0"),
                                                    F.count(F.lit(1)).alias("n_frames"))


def integrated_unit_maxima(df: DataFrame, anchors: DataFrame, n_bins: int, half_width: int, unit: str = "unit_id") -> DataFrame:
    """Window maximum of the spectrum averaged over the frames of a unit.

    Only window bins are exploded, and the average is a partial aggregation."""
    j = join_small(df, anchors.select("physical_channel", "anchor"), ["physical_channel"])
    b = j.select("physical_channel", unit, "fine_ratio", F.explode(G.circular_window(F.col("anchor"), half_width, n_bins)).alias("bin"))
    m = b.groupBy("physical_channel", unit, "bin").agg(F.avg(F.get("fine_ratio", F.col("bin").cast("int")).cast("double")).alias("x"))
    return m.groupBy("physical_channel", unit).agg(F.max("x").alias("integrated_max"))


def fine_spectrum(df: DataFrame, keys: Sequence[str], mu0: float = 1.0, max_rows: int | None = None) -> DataFrame:
    """Median, p90 and mean of each bin in decibels over the null ratio."""
    bins = df.select(*keys, F.posexplode("fine_ratio").alias("bin", "_x")).withColumn("x", F.col("_x").cast("double"))
    g = grouped_quantiles(bins, [*keys, "bin"], {"median": ("x", 0.5), "p90": ("x", 0.9)},
                          [F.avg("x").alias("mean"), F.count(F.lit(1)).alias("n")], max_rows=max_rows)
    db = lambda c, floor: 10.0 * F.log10(F.greatest(F.col(c), F.lit(floor)) / mu0)
    return g.select(*keys, "bin", "n", db("median", 1e-6).alias("median_db"), db("p90", 1e-6).alias("p90_db"), db("mean", 1e-12).alias("mean_db"))


def spectrum_before_after(df: DataFrame, keep: Column, keys: Sequence[str] = ("physical_channel",), mu0: float = 1.0) -> DataFrame:
    """Mean bin powers over all and over kept frames in decibels."""
    bins = df.select(*keys, keep.alias("_k"), F.posexplode("fine_ratio").alias("bin", "_x"))
    x = F.col("_x").cast("double")
    g = bins.groupBy(*keys, "bin").agg(F.avg(x).alias("before"), F.avg(F.when(F.col("_k"), x)).alias("after"))
    db = lambda c: 10.0 * F.log10(F.greatest(F.col(c), F.lit(1e-12)) / mu0)
    return g.select(*keys, "bin", "before", "after", db("before").alias("before_db"),
                    F.when(F.col("after").isNotNull(), db("after")).alias("after_db"))


def suppression(before_after: DataFrame, keys: Sequence[str] = ("physical_channel",)) -> DataFrame:
    """Suppression at the strongest bin and over the band."""
    floor = lambda c: F.greatest(c, F.lit(1e-12))
    p = F.max_by(F.struct("bin", "before", "after"), F.struct(F.col("before"), -F.col("bin")))
    g = before_after.groupBy(*keys).agg(p.alias("p"), F.avg("before").alias("b"), F.avg("after").alias("a"))
    return g.select(*keys, F.col("p.bin").alias("peak_bin"), (10.0 * F.log10(F.col("p.before") / floor(F.col("p.after")))).alias("peak_suppression_db"),
                    (10.0 * F.log10(F.col("b") / floor(F.col("a")))).alias("band_suppression_db"))


def peaks(y: np.ndarray, height: float, prominence: float, distance: int) -> list[int]:
    """Local maxima by height, then spacing (taller first), then prominence."""
    found, i, n = [], 1, len(y)
    while i < n - 1:
        if y[i - 1] < y[i]:
            j = i
            while j + 1 < n and y[j + 1] == y[i]:
                j += 1
            if j + 1 < n and y[j + 1] < y[i]:
                found.append((i + j) // 2)
            i = j
        i += 1
    found = [p for p in found if y[p] >= height]
    kept: list[int] = []
    for p in sorted(found, key=lambda p: (y[p], p), reverse=True):
        if all(abs(p - o) >= distance for o in kept):
            kept.append(p)
    return sorted(p for p in kept if rise(y, p) >= prominence)


def rise(y: np.ndarray, p: int) -> float:
    """Height of a peak over the higher of its two saddles."""
    left = y[:p][::-1]
    right = y[p + 1:]
    def saddle(side: np.ndarray) -> float:
        taller = np.flatnonzero(side > y[p])
        part = side[: taller[0]] if len(taller) else side
        return float(min(part.min(), y[p])) if len(part) else float(y[p])
    return float(y[p] - max(saddle(left), saddle(right)))


def line_census(spectrum: DataFrame, n_bins: int, sense: int = -1, min_db: float = 1.5, min_prominence: float = 1.5,
                distance: int = 4, max_lines: int = 6) -> DataFrame:
    """Resolved lines of a channel's median spectrum, most prominent first
    kept; one channel is at most ``n_bins`` rows."""
    def census(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.assign(rf=sense * ((pdf["bin"] + n_bins // 2) % n_bins - n_bins // 2)).sort_values("rf")
        med, p90 = pdf["median_db"].to_numpy(), pdf["p90_db"].to_numpy()
        base = np.median(med)
        y = med - base
        at = peaks(y, min_db, min_prominence, distance)
        at = sorted(sorted(at, key=lambda p: rise(y, p), reverse=True)[:max_lines])
        return pd.DataFrame({"physical_channel": pdf["physical_channel"].iloc[0], "rf_bin": pdf["rf"].to_numpy()[at],
                             "excess_db": y[at], "p90_excess_db": p90[at] - base})
    return spectrum.groupBy("physical_channel").applyInPandas(
        census, "physical_channel int, rf_bin int, excess_db double, p90_excess_db double")


def carrier_track(monthly: DataFrame, n_bins: int, step_hz: float, sense: int = -1, min_db: float = 3.0) -> DataFrame:
    """Strongest interior bin per month with a parabolic sub-bin offset.

    ``monthly``: channel, month, bin, median_db."""
    rf = F.lit(sense) * G.centered_bin(F.col("bin"), n_bins)
    keys = ["physical_channel", "month"]
    w = W.partitionBy(*keys).orderBy("rf")
    m = monthly.withColumn("rf", rf)
    m = m.select(*keys, "rf", F.col("median_db").alias("y"), F.lag("median_db").over(w).alias("y0"), F.lead("median_db").over(w).alias("y2"))
    best = m.groupBy(*keys).agg(F.percentile("y", F.lit(0.5)).alias("base"),
                                F.max_by(F.struct("rf", "y", "y0", "y2"), F.struct(F.col("y"), -F.col("rf"))).alias("b"))
    den = F.col("b.y0") - 2 * F.col("b.y") + F.col("b.y2")
    delta = F.when(den != 0, 0.5 * (F.col("b.y0") - F.col("b.y2")) / den).otherwise(0.0)
    delta = F.least(F.greatest(delta, F.lit(-1.0)), F.lit(1.0))
    height = F.col("b.y") - F.col("base")
    return best.where((height >= min_db) & F.col("b.y0").isNotNull() & F.col("b.y2").isNotNull()).select(
        *keys, ((F.col("b.rf") + delta) * step_hz).alias("offset_hz"), height.alias("height_db"))


def carrier_drift_latest_era(track: DataFrame, eras: DataFrame, min_months: int = 8) -> DataFrame:
    """The drift of each channel within the last of its eras, where the whole track and that part have enough months.

    ``eras``: physical_channel, month_start."""
    last = eras.groupBy("physical_channel").agg(F.max("month_start").alias("era_start"))
    long = track.groupBy("physical_channel").agg(F.count(F.lit(1)).alias("_m")).where(F.col("_m") >= min_months).select("physical_channel")
    part = join_small(join_small(track, last, ["physical_channel"]), long, ["physical_channel"]).where(F.col("month") >= F.col("era_start"))
    spread = part.groupBy("physical_channel", "era_start").agg(F.stddev_pop("offset_hz").alias("track_sd_hz"))
    return join_small(carrier_drift(part, min_months), spread, ["physical_channel"])


def carrier_drift(track: DataFrame, min_months: int = 8) -> DataFrame:
    """Straight drift of a track with enough months: slope, scatter, swing and
    whether the line explains the track."""
    x, y = F.col("month").cast("double"), F.col("offset_hz")
    g = track.groupBy("physical_channel").agg(
        F.count(F.lit(1)).alias("n_months"), F.covar_pop(x, y).alias("_c"), F.var_pop(x).alias("_vx"), F.var_pop(y).alias("_vy"),
        (F.max(x) - F.min(x)).alias("_sx"), (F.max(y) - F.min(y)).alias("span_hz")).where(
        (F.col("n_months") >= min_months) & (F.col("_vx") > 0))
    slope = F.col("_c") / F.col("_vx")
    left = F.greatest(F.col("_vy") - slope * F.col("_c"), F.lit(0.0))
    r2 = F.when(F.col("_vy") > 0, 1.0 - left / F.col("_vy")).otherwise(0.0)
    swing = F.abs(slope) * F.col("_sx")
    return g.select("physical_channel", "n_months", (slope * 12).alias("slope_hz_per_year"), swing.alias("swing_hz"), "span_hz",
                    F.sqrt(left).alias("scatter_hz"), r2.alias("r2"), ((swing > 3 * F.sqrt(left)) & (r2 > 0.7)).alias("coherent"))
