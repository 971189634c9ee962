"""Transmitter census: filters, ranked association, line dispersion."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import keys
from .numbering import number_within, running_sums
from .quantiles import grouped_quantiles
from .small import join_scalar, join_small


def score(erp_kw: Column, distance_km: Column) -> Column:
    """Detectability of an unscored census row."""
    return erp_kw / (distance_km * distance_km)


def census_violations(df: DataFrame) -> DataFrame:
    """Rows without a usable distance or channel; any row refuses the census."""
    d = F.col("distance_km")
    return df.where(d.isNull() | F.isnan(d) | (d <= 0) | F.col("rf_channel").isNull())


def within_radius(df: DataFrame, radius_km: float) -> DataFrame:
    """Census rows inside the radius in display order."""
    return df.where(F.col("distance_km") <= radius_km + 1e-9).orderBy("distance_km", "rf_channel", F.lower("callsign"))


def _ranked(lines: DataFrame, census: DataFrame, max_rows: int | None) -> tuple[DataFrame, DataFrame]:
    ln = number_within(lines, ["rf_channel"], [F.col("snr_db").desc(), F.col("line_id")], "line_rank", max_rows=max_rows)
    cn = census.select("rf_channel", "callsign", keys.service_class(F.col("service_class")).alias("service_class"),
                       "detectability_db", "distance_km")
    cn = number_within(cn, ["rf_channel"], [F.col("detectability_db").desc(), F.col("distance_km")], "line_rank", max_rows=max_rows)
    return ln, cn.select("rf_channel", "line_rank", "callsign", "service_class")


def associate_lines(lines: DataFrame, census: DataFrame, strategy: str = "ranked", max_rows: int | None = None) -> DataFrame:
    """Lines with transmitters of the same rank, or with the dominant one only.

    Both sides are numbered inside the channel and met on (channel, rank)."""
    ln, cn = _ranked(lines, census, max_rows)
    none = lambda col, text: F.coalesce(col, F.lit(text))
    if strategy == "ranked":
        j = ln.join(cn, ["rf_channel", "line_rank"], "left")
        top = (F.col("line_rank") == 0) & (F.col("service_class") == "primary")
        tier = F.when(F.col("callsign").isNull(), "unassociated").when(top, "dominant").otherwise("ranked")
        return j.select("rf_channel", "line_id", "offset_hz", "snr_db", "line_rank", none(F.col("callsign"), "").alias("callsign"),
                        tier.alias("tier"), none(F.col("service_class"), "unassociated").alias("service_class"))
    if strategy != "dominant_secondary":
        raise ValueError(f"unknown association strategy {strategy}")
    first = cn.where("line_rank = 0").drop("line_rank")
    j = join_small(ln, first, ["rf_channel"], rows=C.COARSE_CHANNELS, how="left")
    any_, rank0 = F.col("callsign").isNotNull(), F.col("line_rank") == 0
    return j.select("rf_channel", "line_id", "offset_hz", "snr_db", "line_rank",
                    F.when(any_ & rank0, F.col("callsign")).otherwise("").alias("callsign"),
                    F.when(~any_, "unassociated").when(rank0, "dominant").otherwise("pooled").alias("tier"),
                    F.when(~any_, "unassociated").when(rank0, F.col("service_class")).otherwise("non_primary").alias("service_class"))


def best_candidate(census: DataFrame) -> DataFrame:
    """Strongest census row per channel; ties take the first callsign."""
    best = F.max_by(F.struct("callsign", "service_class", "detectability_db"),
                    F.struct(F.col("detectability_db"), -F.col("distance_km")))
    return census.groupBy("rf_channel").agg(best.alias("b")).select("rf_channel", "b.*")


def with_absent_channels(present: DataFrame, census: DataFrame) -> DataFrame:
    """Channels with data, then census channels without any."""
    best = best_candidate(census).select(F.col("rf_channel").alias("physical_channel"), "callsign")
    have = present.join(F.broadcast(best), "physical_channel", "left").withColumn("status", F.lit("scanned"))
    gone = best.join(present, "physical_channel", "left_anti").select(
        "physical_channel", F.lit(0).cast("long").alias("n_frames"), "callsign", F.lit("not scanned").alias("status"))
    return have.unionByName(gone.select(have.columns))


def offset_dispersion(records: DataFrame, max_rows: int | None = None) -> DataFrame:
    """Robust and plain spread of line offsets and the non-primary share."""
    x, cls = F.col("offset_hz"), F.col("service_class")
    j = _with_median(records, ["rf_channel"], max_rows)
    paired = F.count_if(cls != "unassociated")
    g = grouped_quantiles(j, ["rf_channel"], {"_d": (F.abs(x - F.col("_m")), 0.5)}, [
        F.count(F.lit(1)).alias("n_lines"), F.count_if(cls == "unassociated").alias("n_unassociated"),
        F.sqrt(F.avg(x * x)).alias("rms_hz"), (F.max(x) - F.min(x)).alias("span_hz"),
        F.when(paired > 0, F.count_if(cls == "non_primary") / paired).alias("non_primary_fraction")], max_rows=max_rows)
    return g.select("rf_channel", "n_lines", "n_unassociated", (F.lit(C.MAD_SCALE) * F.col("_d")).alias("mad_hz"), "rms_hz",
                    "span_hz", "non_primary_fraction")


def _with_median(df: DataFrame, by: list[str], max_rows: int | None) -> DataFrame:
    med = grouped_quantiles(df, by, {"_m": ("offset_hz", 0.5)}, max_rows=max_rows)
    return join_small(df, med, by, rows=C.COARSE_CHANNELS * 64)


def dispersion_by_threshold(records: DataFrame, thresholds: list[float], max_rows: int | None = None) -> DataFrame:
    """Line count and robust spread per channel at each SNR threshold.

    One conditional median per threshold, twice; lines are not multiplied."""
    x, s = F.col("offset_hz"), F.col("snr_db")
    keep = [s >= t for t in thresholds]
    med = grouped_quantiles(records, ["rf_channel"], {f"m{i}": (F.when(k, x), 0.5) for i, k in enumerate(keep)},
                            [F.count_if(k).alias(f"n{i}") for i, k in enumerate(keep)], max_rows=max_rows)
    j = join_small(records, med.drop(*[f"n{i}" for i in range(len(keep))]), ["rf_channel"], rows=C.COARSE_CHANNELS)
    mad = grouped_quantiles(j, ["rf_channel"], {f"d{i}": (F.when(k, F.abs(x - F.col(f"m{i}"))), 0.5) for i, k in enumerate(keep)},
                            max_rows=max_rows)
    rows = F.array(*[F.struct(F.lit(float(t)).alias("snr_threshold_db"), F.col(f"n{i}").alias("n_lines"),
                              (F.lit(C.MAD_SCALE) * F.col(f"d{i}")).alias("mad_hz")) for i, t in enumerate(thresholds)])
    return med.join(mad, "rf_channel").select("rf_channel", F.explode(rows).alias("r")).select("rf_channel", "r.*")


def average_ranks(df: DataFrame, column: str, name: str, max_rows: int | None = None) -> DataFrame:
    """Rank of each value with ties at their mean rank."""
    v = df.groupBy(F.lit(0).alias("_g"), column).agg(F.count(F.lit(1)).alias("n"))
    r = running_sums(v, ["_g"], column, ["n"], max_rows=max_rows)
    ranks = r.select(column, (F.col("cum_n") - (F.col("n") - 1) / 2).alias(name))
    return df.join(ranks, column)


def correlation(x: str, y: str) -> Column:
    """Linear correlation, undefined for a constant side."""
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def spearman(df: DataFrame, x: str, y: str, max_rows: int | None = None) -> DataFrame:
    """Rank correlation; undefined below three rows or for a constant side."""
    ok = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    r = average_ranks(average_ranks(ok, x, "_rx", max_rows), y, "_ry", max_rows)
    n = F.count(F.lit(1))
    return r.agg(n.alias("n"), F.when(n >= 3, correlation("_rx", "_ry")).alias("rho"))


def spearman_bootstrap(df: DataFrame, x: str, y: str, replicates: int = 200, seed: int = 0) -> DataFrame:
    """Interval of the rank correlation under resampling of rows.

    Meant for per-channel summaries (at most one row a channel): ranks are
    taken inside each replicate."""
    ids = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(x, y).withColumn("_g", F.lit(0))
    ids = number_within(ids, ["_g"], [x, y], "_rank")
    size = ids.agg(F.count(F.lit(1)).alias("_n"))
    draws = join_scalar(ids.select(F.col("_rank").alias("_d")), size).select(
        "_n", "_d", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("replicate"))
    pick = draws.select("replicate", F.pmod(F.xxhash64(F.lit(seed), "replicate", "_d"), F.col("_n")).alias("_rank"))
    s = pick.join(F.broadcast(ids), "_rank")
    def rank(col: str) -> Column:
        w = W.partitionBy("replicate").orderBy(col)
        ties = F.count(F.lit(1)).over(W.partitionBy("replicate", col))
        return F.rank().over(w) + (ties - 1) / 2
    r = s.select("replicate", rank(x).alias("rx"), rank(y).alias("ry")).groupBy("replicate").agg(correlation("rx", "ry").alias("rho"))
    return r.where(F.col("rho").isNotNull() & ~F.isnan("rho")).agg(
        F.percentile("rho", F.lit(0.025)).alias("low"), F.percentile("rho", F.lit(0.975)).alias("high"), F.count(F.lit(1)).alias("replicates"))
