"""Checks over the products: each rule is one count, all in one pass."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import exact, geometry as G, keys as K
from .gate import SurveyRefused


def _unpivot(df: DataFrame, checks: Sequence[str]) -> DataFrame:
    rows = F.array(*[F.struct(F.lit(c).alias("check"), F.col(c).cast("long").alias("n")) for c in checks])
    return df.select(F.explode(rows).alias("r")).select("r.*")


def count_rules(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """(check, violations) for row rules; an undefined rule is a violation."""
    return _unpivot(df.agg(*[F.count_if(F.coalesce(v, F.lit(True))).alias(k) for k, v in rules.items()]), list(rules))


def require_clean(report: DataFrame) -> None:
    bad = report.where("n > 0").collect()  # one row per rule
    if bad:
        raise SurveyRefused("; ".join(f"{r['check']}: {r['n']}" for r in bad))


def frame_rules() -> dict[str, Column]:
    c = F.col
    pt, pr, v, m = c("p_target"), c("p_ref_sum"), c("valid"), c("reject")
    want = exact.reject_mask(pt, pr, c("target_norm_sq"), c("reference_norm_sum_sq"))
    return {
        "mask_null": m.isNull(), "valid_null": v.isNull(), "masked_invalid": m & ~v, "valid_denominator": v != (pr > 0),
        "mask_rule": m != want, "negative_power": (pt < 0) | (pr < 0), "norms_positive": (c("target_norm_sq") <= 0) | (c("reference_norm_sum_sq") <= 0),
    }


def validate_frames(df: DataFrame) -> DataFrame:
    return count_rules(df, frame_rules())


def chunk_count_mismatches(frames: DataFrame, chunks: DataFrame) -> DataFrame:
    """Channels whose chunk counts do not add up to their frames."""
    a = frames.groupBy("physical_channel").agg(F.count(F.lit(1)).alias("n"), F.count_if("valid").alias("nv"),
                                               F.count_if(F.col("valid") & F.col("reject")).alias("nm"))
    b = chunks.groupBy("physical_channel").agg(F.sum("total_count").alias("cn"), F.sum("valid_count").alias("cv"),
                                               F.sum("masked_count_valid").alias("cm"))
    j = a.join(b, "physical_channel", "full")
    return j.where(~(F.col("n").eqNullSafe(F.col("cn")) & F.col("nv").eqNullSafe(F.col("cv")) & F.col("nm").eqNullSafe(F.col("cm"))))


def _close(a: Column, b: Column, rtol: float, atol: float = 0.0) -> Column:
    return F.abs(a - b) <= F.lit(atol) + F.lit(rtol) * F.abs(b)


def audit_frames(df: DataFrame) -> DataFrame:
    """Identity formulae and recomputed scalars of a per-channel product.

    Needs the detector columns, ``freq_id`` and ``rho``."""
    c = F.col
    f, mu0, v = c("f"), c("mu0"), c("valid")
    pilot, center = G.pilot_hz(c("physical_channel")), G.coarse_center_hz(c("freq_id"))
    return count_rules(df, {
        **frame_rules(),
        "channel_freq_id": c("freq_id") != G.freq_id_of(pilot),
        "pilot_in_band": F.abs(pilot - center) > C.SAMPLE_RATE_HZ / 2,
        "null_ratio": ~_close(mu0, exact.null_ratio(c("target_norm_sq"), c("reference_norm_sum_sq")), 0.0, 1e-12),
        "ratio_recomputed": F.when(v, ~_close(f, exact.coarse_ratio(c("p_target"), c("p_ref_sum")), 1e-9)).otherwise(F.lit(False)),
        "excess_recomputed": F.when(v, ~_close(c("rho"), f / mu0 - 1, 1e-9, 1e-12)).otherwise(F.lit(False)),
        "excess_undefined_when_invalid": ~v & c("rho").isNotNull(),
        "ratio_undefined_when_invalid": ~v & f.isNotNull(),
        "frame_in_unit": c("frame_in_unit") < 0,
        "unit_time_plausible": ~c("unit_time0").between(0.0, 1.9e9),
    })


def audit_ragged(calibrated: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rules of the exceedance list and the null calibration of each frame."""
    d, n = F.col("detected"), F.size("detected")
    ordered = F.forall(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: (i >= n) | (F.get(d, i - 1) < F.get(d, i)))
    return count_rules(calibrated, {
        "bins_ordered": ~ordered, "bins_in_range": F.exists(d, lambda b: (b < 0) | (b >= F.size("fine_ratio"))),
        "threshold_above_location": ~(F.col("threshold") > F.col("location")),
        "null_fraction_range": ~F.col("null_fraction").between(0.0, 1.0)})


def audit_spectra(df: DataFrame) -> DataFrame:
    return count_rules(df, {"non_negative": (F.col("before") < 0) | (F.col("after") < 0),
                            "after_not_above_before": F.col("after") > F.col("before") * (1 + 1e-12) + 1e-6})


def audit_units(units: DataFrame, frames: DataFrame) -> DataFrame:
    """Unit keys once each, frames of known units only, contiguous frames."""
    from .align import frame_numbering_violations
    n = F.count(F.lit(1)).alias("n")
    twice = units.groupBy("unit_key").agg(n).where("n > 1").agg(n)
    lost = frames.join(units, ["physical_channel", "event_id"], "left_anti").agg(n)
    gaps = frame_numbering_violations(frames).agg(n)
    named = lambda df, name: df.select(F.lit(name).alias("check"), "n")
    return named(twice, "unit_key_repeated").unionByName(named(lost, "frame_without_unit")).unionByName(named(gaps, "frame_in_unit_gaps"))


def invariants(products: DataFrame, fields: Sequence[str], rate: str | None = "sample_rate_hz", version: str | None = "detector_version") -> DataFrame:
    """Distinct values per shared field over the products, more than one being
    a violation; versions compare without build tokens, rates within 1e-12."""
    aggs = [F.count_distinct(f).alias(f) for f in fields]
    if version:
        aggs.append(F.count_distinct(K.version_geometry(F.col(version))).alias(version))
    if rate:
        aggs.append(F.when(F.max(rate) - F.min(rate) <= 1e-12 * F.max(rate), 1).otherwise(2).alias(rate))
    return _unpivot(products.agg(*aggs), [*fields, *([version] if version else []), *([rate] if rate else [])]).withColumnRenamed("n", "distinct_values")


def contract_rules(ranges: dict[str, tuple[float | None, float | None]]) -> dict[str, Column]:
    """Range rules by column; an open end is None and NULL is a violation."""
    rules = {}
    for name, (lo, hi) in ranges.items():
        bad = F.col(name).isNull()
        if lo is not None:
            bad = bad | (F.col(name) < lo)
        if hi is not None:
            bad = bad | (F.col(name) > hi)
        rules[f"{name}_range"] = bad
    return rules


def key_derivation_violations(units: DataFrame) -> DataFrame:
    """Units whose event key is not the one their unit key implies."""
    return units.where(~F.col("source_event_key").eqNullSafe(K.source_event_key(F.col("unit_key"), F.col("freq_id"))))


def compare_runs(a: DataFrame, b: DataFrame, exact_columns: Sequence[str], key: str = "physical_channel") -> DataFrame:
    """Per channel: rows and units of both runs and rows only one of them has.

    Rows are counted with multiplicity by one aggregation over both runs, so
    repeated rows count too."""
    cols = list(dict.fromkeys([key, *exact_columns]))
    both = a.select(*cols, F.lit(1).alias("_a"), F.lit(0).alias("_b")).unionByName(
        b.select(*cols, F.lit(0).alias("_a"), F.lit(1).alias("_b")))
    g = both.groupBy(*cols).agg(F.sum("_a").alias("_a"), F.sum("_b").alias("_b"))
    return g.groupBy(key).agg(
        F.sum("_a").alias("rows_first"), F.sum("_b").alias("rows_second"),
        F.sum(F.greatest(F.col("_a") - F.col("_b"), F.lit(0))).alias("only_first"),
        F.sum(F.greatest(F.col("_b") - F.col("_a"), F.lit(0))).alias("only_second"))


def compare_spectra(a: DataFrame, b: DataFrame, keys: Sequence[str], tolerance: float = 1e-6) -> DataFrame:
    """Largest difference of two runs' spectra against the peak, per group."""
    k = list(keys)
    j = a.select(*k, "bin", "before", "after").join(
        b.select(*k, "bin", F.col("before").alias("b2"), F.col("after").alias("a2")), [*k, "bin"], "full")
    gap = F.greatest(F.abs(F.col("before") - F.col("b2")), F.abs(F.col("after") - F.col("a2")))
    missing = F.col("before").isNull() | F.col("b2").isNull()
    g = j.groupBy(*k).agg(F.max(gap).alias("gap"), F.max("before").alias("peak"), F.count_if(missing).alias("missing_bins"))
    return g.withColumn("same", (F.col("gap") <= tolerance * F.col("peak")) & (F.col("missing_bins") == 0))


def run_totals(df: DataFrame) -> DataFrame:
    return df.groupBy("physical_channel").agg(F.count(F.lit(1)).alias("frames"), F.count_distinct("event_id").alias("units"))
