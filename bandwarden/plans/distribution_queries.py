"""Distributions, exposure and rates."""
from __future__ import annotations

from pyspark.sql import functions as F

from .. import constants as C
from ..functions import clock
from ..operators import exposure, histograms as H
from ..sources import views as V
from .frame_queries import CIVIL, FT, LMST, SEASON, UTC
from .oracle_views import FRAMES, UNITS, with_
from .registry import query

c = F.col
R = lambda col, n=9: F.round(col, n)


def rounded(df, *names, digits=9):
    return df.withColumns({n: R(c(n), digits) for n in names})


_Q = ", ".join(f"round(quantile_cont(f, {q}), 9) AS p{round(q*100):02d}" for q in H.QUANTILES)


@query("distribution_summary", with_(FRAMES) + f"""
SELECT physical_channel, count(*) AS count_total, count(f) AS count_finite, count(*)-count(f) AS count_nonfinite,
 round(avg(f), 9) AS mean, round(stddev_pop(f), 9) AS standard_deviation, {_Q} FROM v GROUP BY 1""")
def distribution(spark, d):
    out = H.distribution_summary(V.detector_frames(spark, d), ["physical_channel"], c("f"), max_rows=V.frame_bound(spark, d))
    return rounded(out, "mean", "standard_deviation", *[f"p{round(q * 100):02d}" for q in H.QUANTILES])


@query("range_histogram", with_(FRAMES) + """
, r AS (SELECT physical_channel, min(f) AS lo, max(f) AS hi FROM v GROUP BY 1),
b AS (SELECT v.physical_channel, CAST(least(greatest(floor((f-lo)/((hi-lo)/64.0::DOUBLE)), 0), 63) AS INT) AS bin FROM v JOIN r USING (physical_channel) WHERE f IS NOT NULL),
k AS (SELECT physical_channel, bin, count(*) AS n FROM b GROUP BY 1, 2),
g AS (SELECT physical_channel, lo, hi, CAST(unnest(range(64)) AS INT) AS bin FROM r)
SELECT g.physical_channel, g.bin, lo + bin*((hi-lo)/64) AS edge_lo, lo + (bin+1)*((hi-lo)/64) AS edge_hi, coalesce(k.n, 0) AS n
FROM g LEFT JOIN k USING (physical_channel, bin)""")
def range_histogram(spark, d):
    return H.histogram_in_range(V.detector_frames(spark, d), ["physical_channel"], c("f"))


@query("density_histogram", with_(FRAMES) + """
, b AS (SELECT physical_channel, CAST(least(greatest(floor((least(greatest(f, 0.9900005::DOUBLE), 1.0100005::DOUBLE) - 0.9900005::DOUBLE)/((1.0100005::DOUBLE-0.9900005::DOUBLE)/40.0::DOUBLE)), 0), 39) AS INT) AS bin FROM v WHERE f IS NOT NULL)
SELECT physical_channel, bin, count(*) AS n, round(count(*)/(sum(count(*)) OVER (PARTITION BY physical_channel) * ((1.0100005::DOUBLE-0.9900005::DOUBLE)/40)), 6) AS density FROM b GROUP BY 1, 2""")
def density(spark, d):
    out = H.fixed_histogram(V.detector_frames(spark, d), ["physical_channel"], c("f"), 0.9900005, 1.0100005, 40, clip=True)
    return rounded(out, "density", digits=6)


def edges_sql(edges) -> str:
    return "[" + ", ".join(f"{e!r}::DOUBLE" for e in edges) + "]"


def edge_bin_sql(x: str, edges) -> str:
    return f"CAST(len(list_filter({edges_sql(edges)}, lambda e: e <= {x})) - 1 AS INT)"


_Y = f"year({UTC.replace('floor(t)', 'floor(unit_time0)')})"
QUARTER = f"{_Y}::VARCHAR || 'Q' || quarter({UTC.replace('floor(t)', 'floor(unit_time0)')})::VARCHAR"


@query("edge_histogram_by_epoch", with_(FRAMES) + f"""
, b AS (SELECT physical_channel, {QUARTER} AS epoch, {edge_bin_sql('f', H.RATIO_EDGES)} AS bin FROM v WHERE valid),
k AS (SELECT physical_channel, epoch, bin, count(*) AS n FROM b GROUP BY ALL),
g AS (SELECT DISTINCT physical_channel, epoch FROM b),
gg AS (SELECT physical_channel, epoch, CAST(unnest(range(152)) AS INT) AS bin FROM g)
SELECT gg.physical_channel, gg.epoch, gg.bin, coalesce(k.n, 0) AS n FROM gg LEFT JOIN k USING (physical_channel, epoch, bin)""")
def edge_histogram(spark, d):
    df = V.detector_frames(spark, d).where("valid").withColumn("epoch", clock.quarter_label(c("unit_time0")))
    return H.edge_histogram(df, ["physical_channel", "epoch"], c("f"), H.RATIO_EDGES)


@query("joint_ratio_power_histogram", with_(FRAMES) + f"""
, w AS (SELECT physical_channel, f, greatest(baseband_power, 1e-300::DOUBLE) AS y FROM v WHERE valid),
s AS (SELECT physical_channel, log10(greatest(min(y)*0.99::DOUBLE, 1e-12::DOUBLE)) AS a, log10(max(y)*1.01::DOUBLE) AS b FROM w GROUP BY 1)
SELECT physical_channel, {edge_bin_sql('f', H.RATIO_EDGES[::4])} AS x_bin, CAST(least(greatest(floor((log10(y)-a)/((b-a)/38))+1, 0), 39) AS INT) AS y_bin, count(*) AS n
FROM w JOIN s USING (physical_channel) GROUP BY ALL""")
def joint(spark, d):
    return H.joint_histogram(V.detector_frames(spark, d).where("valid"), ["physical_channel"], c("f"),
                             c("baseband_power"), H.RATIO_EDGES[::4])


_GRID = [0.99 + 0.001 * i for i in range(21)] + [1.1, 1.5, 2.0]


@query("survival_on_grid", with_(FRAMES) + f"""
, g AS (SELECT unnest({edges_sql(_GRID)}) AS g)
SELECT physical_channel, g, count(*) FILTER (f >= g) AS n_at_least, round(count(*) FILTER (f >= g)/count(f), 9) AS survival FROM v, g GROUP BY 1, 2""")
def survival(spark, d):
    return rounded(H.survival(V.detector_frames(spark, d), ["physical_channel"], c("f"), _GRID), "survival")


@query("tail_ccdf", with_(FRAMES) + """
, t AS (SELECT physical_channel, round(1000*(f - mu0)/mu0, 3) AS x FROM v WHERE f > mu0 + 0.012::DOUBLE*mu0),
k AS (SELECT physical_channel, x, count(*) AS n FROM t GROUP BY 1, 2)
SELECT physical_channel, x, CAST(sum(n) OVER w AS BIGINT) AS n_at_least, round(sum(n) OVER w / sum(n) OVER (PARTITION BY physical_channel), 9) AS ccdf
FROM k WINDOW w AS (PARTITION BY physical_channel ORDER BY x DESC)""")
def tail_ccdf(spark, d):
    df = V.detector_frames(spark, d).where(c("f") > c("mu0") + 0.012 * c("mu0"))
    x = F.round(1000 * (c("f") - c("mu0")) / c("mu0"), 3)
    return rounded(H.tail_ccdf(df, ["physical_channel"], x, max_rows=V.frame_bound(spark, d)), "ccdf")


_HL = lambda h: f"lpad(({h})::VARCHAR, 2, '0') || ':00-' || lpad((({h})+1)::VARCHAR, 2, '0') || ':00'"
_ALL_HOURS = "(SELECT " + _HL("h") + " AS label FROM (SELECT unnest(range(24)) AS h))"


@query("exposure_bins", with_(FRAMES) + f"""
, x AS (SELECT physical_channel, healthy, {FT} AS t FROM v),
l AS (SELECT physical_channel, healthy, unnest([
  {{'coordinate': 'utc_calendar_month', 'label': strftime({UTC}, '%Y-%m')}},
  {{'coordinate': 'utc_hour_of_day', 'label': {_HL(f'hour({UTC})')}}},
  {{'coordinate': 'local_civil_calendar_month', 'label': strftime({CIVIL}, '%Y-%m')}},
  {{'coordinate': 'local_civil_hour_of_day', 'label': {_HL(f'hour({CIVIL})')}}},
  {{'coordinate': 'local_meteorological_season', 'label': {SEASON(f'month({CIVIL})')}}},
  {{'coordinate': 'local_mean_sidereal_hour', 'label': {_HL(f'CAST(floor({LMST}) AS INT) % 24')}}}]) AS l FROM x),
a AS (SELECT physical_channel, l.coordinate AS coordinate, l.label AS label, count(*) AS stored_frames, count(*) FILTER (healthy) AS included_frames FROM l GROUP BY ALL),
dl AS (SELECT c.physical_channel, k.coordinate, h.label FROM (SELECT DISTINCT physical_channel FROM v) c,
  (SELECT unnest(['utc_hour_of_day', 'local_civil_hour_of_day', 'local_mean_sidereal_hour']) AS coordinate) k, {_ALL_HOURS} h
  UNION ALL SELECT c.physical_channel, 'local_meteorological_season', s.label FROM (SELECT DISTINCT physical_channel FROM v) c, (SELECT unnest(['DJF','MAM','JJA','SON']) AS label) s),
j AS (SELECT physical_channel, coordinate, label, coalesce(stored_frames, 0) AS stored_frames, coalesce(included_frames, 0) AS included_frames FROM a FULL JOIN dl USING (physical_channel, coordinate, label))
SELECT *, stored_frames AS stored_with_duration, included_frames AS included_with_duration, round(stored_frames*(16384*2.56e-6::DOUBLE), 6) AS stored_seconds,
 round(included_frames*(16384*2.56e-6::DOUBLE), 6) AS included_seconds, stored_frames-included_frames AS excluded_frames,
 round((stored_frames-included_frames)*(16384*2.56e-6::DOUBLE), 6) AS excluded_seconds FROM j""")
def exposure_query(spark, d):
    df = V.detector_frames(spark, d).withColumn("frame_time", clock.frame_time(c("unit_time0"), c("frame_in_unit")))
    out = exposure.exposure_bins(df, c("healthy"))
    return rounded(out, "stored_seconds", "included_seconds", "excluded_seconds", digits=6)


@query("exposure_coverage", with_(FRAMES) + """
SELECT physical_channel, count(*) AS stored, count(*) FILTER (healthy) AS included, count(*) FILTER (frame_in_unit < 3) AS timed,
 count(*) FILTER (healthy AND frame_in_unit < 3) AS included_timed, count(*) FILTER (event_id % 2 = 0) AS with_duration,
 count(*) FILTER (frame_in_unit < 3 AND event_id % 2 = 0) AS complete, count(*) FILTER (healthy AND frame_in_unit < 3 AND event_id % 2 = 0) AS included_complete FROM v GROUP BY 1""")
def coverage(spark, d):
    t = F.when(c("frame_in_unit") < 3, clock.frame_time(c("unit_time0"), c("frame_in_unit")))
    dur = F.when(c("event_id") % 2 == 0, F.lit(C.FRAME_SECONDS))
    return exposure.coverage(V.detector_frames(spark, d).withColumn("frame_time", t), c("healthy"), dur)


UNIT_STATS = """, us AS (SELECT physical_channel, event_id, avg(f) AS mean_f, max(f) AS max_f, count(*) AS n, min(unit_time0) AS unit_time0, min(mu0) AS mu0,
 10*log10(greatest(avg(f), 1e-9::DOUBLE)/min(mu0)) AS level_db FROM v WHERE healthy GROUP BY 1, 2)"""


@query("unit_statistics", with_(FRAMES) + UNIT_STATS + """
SELECT physical_channel, event_id, round(mean_f, 9) AS mean_f, max_f, n, unit_time0, round(level_db, 6) AS level_db FROM us""")
def unit_statistics(spark, d):
    out = exposure.unit_stats(V.detector_frames(spark, d)).drop("mu0")
    return rounded(rounded(out, "mean_f"), "level_db", digits=6)


MONTH = f"CAST({_Y}*12 + month({UTC.replace('floor(t)', 'floor(unit_time0)')}) - 1 - (2018*12+11) AS INT)"


@query("monthly_profile", with_(FRAMES) + f"""
SELECT physical_channel, {MONTH} AS month, count(*) AS n, round(count(*) FILTER (f > mu0*1.4::DOUBLE)/count(*), 9) AS hot_fraction,
 round(quantile_cont(f, 0.5), 9) AS median_f, round(quantile_cont(f, 0.9), 9) AS p90_f FROM v WHERE healthy GROUP BY 1, 2""")
def monthly(spark, d):
    out = exposure.monthly_profile(V.detector_frames(spark, d), max_rows=V.frame_bound(spark, d))
    return rounded(out, "hot_fraction", "median_f", "p90_f")


_MOY = f"CAST(month({CIVIL.replace('floor(t)', 'floor(unit_time0)')}) AS INT)"


@query("month_of_year_profile", with_(FRAMES) + f"""
, g AS (SELECT physical_channel, {_MOY} AS slot, count(*) AS n, count(*) FILTER (reject)/count(*) AS masked_fraction, quantile_cont(f, 0.5) AS median_f FROM v WHERE healthy GROUP BY 1, 2)
SELECT physical_channel, slot, n, round(CASE WHEN n>=20 THEN masked_fraction END, 9) AS masked_fraction, round(CASE WHEN n>=20 THEN median_f END, 9) AS median_f FROM g""")
def month_of_year(spark, d):
    slot = F.month(clock.civil_ntz(c("unit_time0")))
    out = exposure.cyclic_profile(V.detector_frames(spark, d), slot, max_rows=V.frame_bound(spark, d))
    return rounded(out, "masked_fraction", "median_f")


TAILS = """, tl AS (SELECT *, f > mu0 + 0.012::DOUBLE*mu0 AS hi, f < mu0 - 0.012::DOUBLE*mu0 AS lo, abs(f-mu0) <= 0.006::DOUBLE*mu0 AS core FROM v WHERE valid)"""


def tails(spark, d):
    return exposure.with_tails(V.detector_frames(spark, d), c("mu0"))


@query("quarterly_tail_rates", with_(FRAMES) + TAILS + f"""
SELECT physical_channel, {QUARTER} AS quarter, count(*) AS n, round(count(*) FILTER (hi)/count(*), 9) AS hi_rate, round(count(*) FILTER (lo)/count(*), 9) AS lo_rate,
 count(*) FILTER (event_id % 5 = 0) AS n_stratum,
 round(CASE WHEN count(*) FILTER (event_id % 5 = 0) >= 40 THEN count(*) FILTER (hi AND event_id % 5 = 0)/nullif(count(*) FILTER (event_id % 5 = 0), 0) END, 9) AS hi_rate_stratum
FROM tl GROUP BY 1, 2 HAVING count(*) >= 40""")
def quarterly_rates(spark, d):
    out = exposure.quarterly_rates(tails(spark, d), c("event_id") % 5 == 0)
    return rounded(out, "hi_rate", "lo_rate", "hi_rate_stratum")


@query("quarterly_exposure", with_(UNITS) + f"""
SELECT physical_channel, {QUARTER} AS quarter, count(*) AS n_units, count(*) FILTER (scope='scheduled') AS n_stratum_units FROM u GROUP BY 1, 2""")
def quarterly_exposure(spark, d):
    return exposure.quarterly_exposure(V.units(spark, d), c("scope") == "scheduled")


_YR, _MO = _Y, f"month({UTC.replace('floor(t)', 'floor(unit_time0)')})"


@query("seasonal_anomaly", with_(FRAMES) + TAILS + f"""
, ym AS (SELECT physical_channel, {_YR} AS y, CAST({_MO} AS INT) AS month, count(*) AS n, count(*) FILTER (hi) AS h FROM tl GROUP BY ALL),
yr AS (SELECT physical_channel, y, sum(n) AS ny, sum(h) AS hy, count(*) FILTER (n >= 100) AS k, max(h/n) FILTER (n >= 100) AS rmax, min(h/n) FILTER (n >= 100) AS rmin FROM ym GROUP BY 1, 2),
ok AS (SELECT * FROM yr WHERE ny >= 1200 AND hy/ny >= 0.02 AND NOT coalesce(k >= 3 AND rmax > 4*greatest(rmin, 0.005::DOUBLE), FALSE))
SELECT physical_channel, month, round(sum(h/(hy/ny))/sum(n), 9) AS anomaly, CAST(sum(n) AS BIGINT) AS n, count(*) AS years FROM ym JOIN ok USING (physical_channel, y) WHERE n >= 100 GROUP BY 1, 2""")
def seasonal(spark, d):
    return rounded(exposure.seasonal_anomaly(tails(spark, d), min_month=100), "anomaly")
