"""Exposure tables, unit statistics, rates by quarter, month and hour."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import clock, units
from .quantiles import grouped_quantiles


def exposure_labels(t: Column) -> Column:
    """(coordinate, label) pairs of a frame time for six coordinates."""
    civil = clock.civil_ntz(t)
    date = clock.utc_date(t)
    lst = F.pmod(F.floor(clock.lmst_hours(t)).cast("int"), F.lit(24))
    pair = lambda name, label: F.struct(F.lit(name).alias("coordinate"), label.alias("label"))
    return F.array(
        pair("utc_calendar_month", clock.month_label(date)),
        pair("utc_hour_of_day", clock.hour_label(clock.utc_hour(t))),
        pair("local_civil_calendar_month", clock.month_label(civil)),
        pair("local_civil_hour_of_day", clock.hour_label(F.hour(civil))),
        pair("local_meteorological_season", clock.season(F.month(civil))),
        pair("local_mean_sidereal_hour", clock.hour_label(lst)))


def _declared(df: DataFrame, keys: list[str]) -> DataFrame:
    """All labels of the closed coordinates for each group."""
    hours = F.transform(F.sequence(F.lit(0), F.lit(23)), clock.hour_label)
    seasons = F.array(*[F.lit(s) for s in C.SEASONS])
    sets = F.array(*[F.struct(F.lit(n).alias("coordinate"), labels.alias("labels")) for n, labels in (
        ("utc_hour_of_day", hours), ("local_civil_hour_of_day", hours),
        ("local_mean_sidereal_hour", hours), ("local_meteorological_season", seasons))])
    one = df.select(*keys).distinct().select(*keys, F.explode(sets).alias("s"))
    return one.select(*keys, "s.coordinate", F.explode("s.labels").alias("label"))


def exposure_bins(df: DataFrame, include: Column, duration: Column | None = None) -> DataFrame:
    """Frames and seconds per (channel, coordinate, label); declared labels are
    all present.  Each task fans its frames out to their few labels and adds them
    up, so what is shuffled is one row per label and task."""
    dur = C.FRAME_SECONDS if duration is None else duration
    dur = F.lit(dur) if isinstance(dur, float) else dur
    timed = dur.isNotNull() & (dur > 0)
    n, k = F.count(F.lit(1)), F.count_if
    out = (
        df.where(F.col("frame_time").isNotNull())
        .select("physical_channel", include.alias("_in"), timed.alias("_timed"), dur.alias("_dur"),
                F.explode(exposure_labels(F.col("frame_time"))).alias("l"))
        .groupBy("physical_channel", "l.coordinate", "l.label")
        .agg(n.alias("stored_frames"), k("_in").alias("included_frames"),
             k("_timed").alias("stored_with_duration"), k(F.col("_timed") & F.col("_in")).alias("included_with_duration"),
             F.sum(F.when(F.col("_timed"), F.col("_dur")).otherwise(0.0)).alias("stored_seconds"),
             F.sum(F.when(F.col("_timed") & F.col("_in"), F.col("_dur")).otherwise(0.0)).alias("included_seconds")))
    full = out.join(_declared(df, ["physical_channel"]), ["physical_channel", "coordinate", "label"], "full")
    full = full.fillna(0).withColumn("excluded_frames", F.col("stored_frames") - F.col("included_frames"))
    return full.withColumn("excluded_seconds", F.col("stored_seconds") - F.col("included_seconds"))


def coverage(df: DataFrame, include: Column, duration: Column) -> DataFrame:
    """Counters of frames with a time, a duration and both."""
    t, dn = F.col("frame_time").isNotNull(), duration.isNotNull() & (duration > 0)
    k = F.count_if
    return df.groupBy("physical_channel").agg(
        F.count(F.lit(1)).alias("stored"), k(include).alias("included"), k(t).alias("timed"),
        k(include & t).alias("included_timed"), k(dn).alias("with_duration"), k(t & dn).alias("complete"),
        k(include & t & dn).alias("included_complete"))


def unit_stats(df: DataFrame) -> DataFrame:
    """Mean and largest ratio, frames and level of units with a healthy frame."""
    g = df.where("healthy").groupBy("physical_channel", "event_id").agg(
        F.avg("f").alias("mean_f"), F.max("f").alias("max_f"), F.count(F.lit(1)).alias("n"),
        F.min("unit_time0").alias("unit_time0"), F.min("mu0").alias("mu0"))
    return g.withColumn("level_db", units.level_db(F.col("mean_f"), F.col("mu0")))


def monthly_profile(df: DataFrame, hot_factor: float = 1.4, max_rows: int | None = None) -> DataFrame:
    """Per month: median, p90, count and share of hot frames."""
    m = clock.month_index(F.col("unit_time0")).alias("month")
    ok = df.where("healthy").select("physical_channel", m, "f", "mu0")
    n = F.count(F.lit(1))
    return grouped_quantiles(
        ok, ["physical_channel", "month"], {"median_f": ("f", 0.5), "p90_f": ("f", 0.9)},
        [n.alias("n"), (F.count_if(F.col("f") > F.col("mu0") * hot_factor) / n).alias("hot_fraction")], max_rows=max_rows)


def cyclic_profile(df: DataFrame, coordinate: Column, min_n: int = 20, max_rows: int | None = None) -> DataFrame:
    """Masked share and median per cyclic coordinate; undefined below ``min_n``."""
    ok = df.where("healthy").select("physical_channel", coordinate.alias("slot"), "f", "reject")
    n = F.count(F.lit(1))
    out = grouped_quantiles(ok, ["physical_channel", "slot"], {"median_f": ("f", 0.5)},
                            [n.alias("n"), (F.count_if("reject") / n).alias("masked_fraction")], max_rows=max_rows)
    enough = F.col("n") >= min_n
    return out.withColumns({k: F.when(enough, F.col(k)) for k in ("median_f", "masked_fraction")})


def with_tails(df: DataFrame, mu: Column) -> DataFrame:
    """Valid frames with flags for both tails and the core about ``mu``."""
    f, mu0 = F.col("f"), F.col("mu0")
    return df.where(F.col("valid") & f.isNotNull()).withColumns({
        "hi": f > mu + F.lit(C.TAIL_EDGE) * mu0, "lo": f < mu - F.lit(C.TAIL_EDGE) * mu0,
        "core": F.abs(f - mu) <= F.lit(C.CORE_WINDOW) * mu0})


def quarterly_rates(tails: DataFrame, stratum: Column, min_n: int = 40) -> DataFrame:
    """Tail rates per quarter for all frames and for one stratum."""
    n, ns = F.count(F.lit(1)), F.count_if(stratum)
    g = tails.groupBy("physical_channel", clock.quarter_label(F.col("unit_time0")).alias("quarter")).agg(
        n.alias("n"), (F.count_if("hi") / n).alias("hi_rate"), (F.count_if("lo") / n).alias("lo_rate"),
        ns.alias("n_stratum"), F.when(ns >= min_n, F.count_if(F.col("hi") & stratum) / F.when(ns > 0, ns)).alias("hi_rate_stratum"))
    return g.where(F.col("n") >= min_n)


def quarterly_exposure(units_: DataFrame, stratum: Column) -> DataFrame:
    return units_.groupBy("physical_channel", clock.quarter_label(F.col("unit_time0")).alias("quarter")).agg(
        F.count(F.lit(1)).alias("n_units"), F.count_if(stratum).alias("n_stratum_units"))


def seasonal_anomaly(tails: DataFrame, min_year: int = 1200, min_rate: float = 0.02, min_month: int = 200,
                     swing: float = 4.0, floor: float = 0.005) -> DataFrame:
    """Monthly rate over its own year's rate, frame-weighted over years.

    Years with few frames, a low rate or a step between months are left out."""
    date = clock.utc_date(F.col("unit_time0"))
    ym = tails.groupBy("physical_channel", F.year(date).alias("y"), F.month(date).alias("month")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if("hi").alias("h"))
    big = F.col("n") >= min_month
    rate = F.when(big, F.col("h") / F.col("n"))
    years = ym.groupBy("physical_channel", "y").agg(
        F.sum("n").alias("ny"), F.sum("h").alias("hy"), F.count(rate).alias("k"),
        F.max(rate).alias("rmax"), F.min(rate).alias("rmin"))
    step = (F.col("k") >= 3) & (F.col("rmax") > swing * F.greatest(F.col("rmin"), F.lit(floor)))
    ok = years.where((F.col("ny") >= min_year) & (F.col("hy") / F.col("ny") >= min_rate) & ~F.coalesce(step, F.lit(False)))
    j = ym.where(big).join(ok, ["physical_channel", "y"])
    return j.groupBy("physical_channel", "month").agg(
        (F.sum(F.col("h") / (F.col("hy") / F.col("ny"))) / F.sum("n")).alias("anomaly"),
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("years"))
