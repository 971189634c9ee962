"""Zero points, ladders, sweeps, baselines, eras, policies."""
from __future__ import annotations

from pyspark.sql import functions as F

from .. import constants as C
from ..functions import clock, geometry, units
from ..operators import bootstrap, eras, exposure, policy, robust, thresholds, zeropoint as Z
from ..operators.quantiles import grouped_quantiles
from ..operators.small import join_small
from ..session import materialize
from ..sources import views as V
from .distribution_queries import MONTH, TAILS, UNIT_STATS, rounded
from .oracle_views import FRAMES, with_
from .registry import query

c = F.col
FV = FRAMES + ",\nfv AS MATERIALIZED (SELECT * FROM v WHERE valid)"
SOLAR = "CAST(floor((((unit_time0/3600.0::DOUBLE - 119.6175::DOUBLE/15.0) % 24.0::DOUBLE) + 24.0::DOUBLE) % 24.0::DOUBLE) AS INT)"


_ETAS = ", ".join(f"{e}::DOUBLE" for e in C.ETA_LADDER)


def bound(spark, d):
    return V.frame_bound(spark, d)


def valid(spark, d):
    return V.detector_frames(spark, d).where("valid")


def slim(spark, d, *columns):
    """Columns of the valid frames beside channel, ratio and null ratio, joined and numbered once for all passes over them."""
    return materialize(valid(spark, d).select("physical_channel", *columns, "f", "mu0"))


def median_mu(spark, d, df=None):
    df = slim(spark, d) if df is None else df
    return grouped_quantiles(df, ["physical_channel"], {"mu": ("f", 0.5)}, [F.min("mu0").alias("mu0")], max_rows=bound(spark, d))


@query("h0_table", with_(FRAMES) + """
SELECT physical_channel, count(f) AS n_valid, round(avg(f), 9) AS mean_f, round(stddev_samp(f)/sqrt(count(f)), 9) AS sem_f, round(min(mu0), 9) AS mu0,
 round(abs(avg(f)-min(mu0)), 9) AS gap, round(abs(min(mu0)-1)/3, 9) AS bound, abs(avg(f)-min(mu0)) < abs(min(mu0)-1)/3 AS tracks,
 round(count(*) FILTER (reject)/count(*) FILTER (valid), 9) AS mask_fraction,
 CASE WHEN count(*) FILTER (reject)/count(*) FILTER (valid) < 0.45 THEN 'suppressed' WHEN count(*) FILTER (reject)/count(*) FILTER (valid) > 0.55 THEN 'elevated' ELSE 'nominal' END AS class,
 round((1-count(*) FILTER (reject)/count(*) FILTER (valid))*390.625, 6) AS recovered_khz FROM v GROUP BY 1""")
def h0(spark, d):
    out = Z.h0_table(V.detector_frames(spark, d))
    out = out.withColumn("class", Z.mask_class(c("mask_fraction"))).withColumn(
        "recovered_khz", F.round((1 - c("mask_fraction")) * C.COARSE_MHZ * 1000, 6))
    return rounded(out, "mean_f", "sem_f", "mu0", "gap", "bound", "mask_fraction")


def _core_sql() -> str:
    text = """, sp AS (SELECT physical_channel, quantile_cont(f, 0.005) AS lo, quantile_cont(f, 0.995) AS hi, min(mu0) AS mu0 FROM fv GROUP BY 1),
hb AS (SELECT physical_channel, least(greatest(floor((f-lo)/((hi-lo)/512.0::DOUBLE)), 0), 511) AS bin, count(*) AS n, min(lo) AS lo, min(hi) AS hi, min(sp.mu0) AS mu0 FROM fv JOIN sp USING (physical_channel) WHERE f >= lo AND f <= hi GROUP BY 1, 2),
m0 AS MATERIALIZED (SELECT physical_channel, mu0, lo + (bin+0.5)*((hi-lo)/512) AS m, FALSE AS stop FROM hb QUALIFY row_number() OVER (PARTITION BY physical_channel ORDER BY n DESC, bin) = 1)"""
    for i in range(20):
        text += f""",
w{i} AS (SELECT m{i}.physical_channel, count(fv.f) AS n, quantile_cont(fv.f, 0.5) AS med FROM m{i} JOIN fv ON fv.physical_channel = m{i}.physical_channel AND abs(fv.f - m) <= 0.006::DOUBLE*m{i}.mu0 WHERE NOT stop GROUP BY 1),
m{i+1} AS MATERIALIZED (SELECT m{i}.physical_channel, mu0, CASE WHEN stop OR coalesce(n, 0) < 100 THEN m ELSE med END AS m, stop OR coalesce(n, 0) < 100 OR abs(med - m) < 1e-7 AS stop FROM m{i} LEFT JOIN w{i} USING (physical_channel))"""
    return text + """,
s1 AS (SELECT fv.physical_channel, count(*) AS n_valid, min(m20.mu0) AS mu0, avg(f) FILTER (abs(f-m) <= 0.006::DOUBLE*m20.mu0) AS mu_hat,
 stddev_samp(f) FILTER (abs(f-m) <= 0.006::DOUBLE*m20.mu0)/sqrt(count(*) FILTER (abs(f-m) <= 0.006::DOUBLE*m20.mu0)) AS mu_err,
 count(*) FILTER (abs(f-m) <= 0.006::DOUBLE*m20.mu0)/count(*) AS core_fraction, count(*) FILTER (reject)/count(*) AS mask_fraction FROM fv JOIN m20 USING (physical_channel) GROUP BY 1)
SELECT physical_channel, any_value(n_valid) AS n_valid, round(any_value(s1.mu0), 9) AS mu0, round(any_value(mu_hat), 9) AS mu_hat, round(any_value(mu_err), 9) AS mu_err,
 round(any_value(core_fraction), 9) AS core_fraction, round(any_value(mask_fraction), 9) AS mask_fraction,
 round(count(*) FILTER (f < mu_hat - 0.012::DOUBLE*s1.mu0)/count(*), 6) AS low_fraction, round(count(*) FILTER (f > mu_hat + 0.012::DOUBLE*s1.mu0)/count(*), 6) AS high_fraction,
 round(count(*) FILTER (f <= mu_hat)/count(*), 6) AS kept_one_sided, round(count(*) FILTER (f <= mu_hat AND f >= mu_hat - 0.012::DOUBLE*s1.mu0)/count(*), 6) AS kept_two_sided,
 NOT (2*(1-any_value(mask_fraction)) < 0.20 OR any_value(core_fraction) < 0.15 OR abs(any_value(mu_hat)-any_value(s1.mu0))/any_value(s1.mu0) > 0.020) AS trusted
FROM fv JOIN s1 USING (physical_channel) GROUP BY 1"""


@query("core_zero_point", with_(FV) + _core_sql())
def core_zero(spark, d):
    out = Z.core_zero_point(V.detector_frames(spark, d), max_rows=bound(spark, d))
    out = rounded(out, "mu0", "mu_hat", "mu_err", "core_fraction", "mask_fraction")
    return rounded(out, "low_fraction", "high_fraction", "kept_one_sided", "kept_two_sided", digits=6)


@query("diurnal_mask_profile", with_(FRAMES) + f"""
SELECT physical_channel, {SOLAR.replace('unit_time0', '(unit_time0 + event_id % 86400)')} AS hour, count(*) AS n, round(count(*) FILTER (reject)/count(*), 9) AS mask_fraction
FROM v WHERE valid GROUP BY 1, 2 HAVING count(*) > 50""")
def diurnal(spark, d):
    hour = clock.solar_hour(c("unit_time0") + c("event_id") % 86400)
    return rounded(Z.diurnal_mask_profile(V.detector_frames(spark, d), hour), "mask_fraction")


# The mode by halving sorted lists until three values remain.
_MODE = """, RECURSIVE_MARK hv AS (
 SELECT physical_channel, list(f ORDER BY f) AS v FROM v WHERE healthy GROUP BY 1
 UNION ALL
 SELECT physical_channel, v[p:p + k - 1] FROM (
  SELECT physical_channel, v, k, list_position(w, list_min(w)) AS p FROM (
   SELECT physical_channel, v, k, list_transform(list_zip(v[k:], v[:len(v) - k + 1]), lambda z: z[1] - z[2]) AS w
   FROM (SELECT *, (len(v) + 1) // 2 AS k FROM hv WHERE len(v) > 3)))),
hm AS (SELECT physical_channel, CASE WHEN len(v) < 3 THEN list_avg(v) WHEN v[3]-v[2] = v[2]-v[1] THEN v[2] WHEN v[3]-v[2] > v[2]-v[1] THEN (v[1]+v[2])/2 ELSE (v[2]+v[3])/2 END AS mode
 FROM hv WHERE len(v) <= 3)"""


def with_mode(sql: str) -> str:
    return with_(FV).replace("WITH ", "WITH RECURSIVE ", 1) + _MODE.replace("RECURSIVE_MARK ", "") + sql


@query("half_sample_mode", with_mode("SELECT physical_channel, mode FROM hm"))
def hsm(spark, d):
    return Z.half_sample_mode(V.detector_frames(spark, d).where("healthy"), ["physical_channel"], "f", max_rows=bound(spark, d))


@query("null_scale_about_centre", with_(FV) + """
, m AS (SELECT physical_channel, quantile_cont(f, 0.5) AS mu FROM fv GROUP BY 1),
q AS (SELECT physical_channel, min(mu) AS mu, count(*) AS n_lower, quantile_cont(f, 0.32) AS a, quantile_cont(f, 0.05) AS b, quantile_cont(f, 0.003) AS c FROM fv JOIN m USING (physical_channel) WHERE f <= mu GROUP BY 1),
e AS (SELECT *, list_sort(list_filter([(mu-a)/1.0::DOUBLE, (mu-b)/1.96::DOUBLE, (mu-c)/2.9677::DOUBLE], lambda x: x > 0)) AS es FROM q)
SELECT physical_channel, round(mu, 9) AS mu, n_lower, round(list_median(es), 9) AS sigma, round(list_max(es)/list_min(es), 6) AS spread,
 round((mu + 3.0902::DOUBLE*list_median(es))/mu, 9) AS floor_eta, round(10*log10((mu + 3.0902::DOUBLE*list_median(es))/mu), 9) AS floor_db FROM e WHERE n_lower >= 20""")
def null_scale(spark, d):
    df = slim(spark, d)
    df = join_small(df, materialize(median_mu(spark, d, df).drop("mu0")), ["physical_channel"])
    out = Z.detection_floor(Z.null_scale_about(df, "mu", max_rows=bound(spark, d)))
    return rounded(rounded(out, "mu", "sigma", "floor_eta", "floor_db"), "spread", digits=6)


@query("threshold_ladder_about_median", with_(FV) + f"""
, m AS (SELECT physical_channel, quantile_cont(f, 0.5) AS mu, min(mu0) AS mu0, count(*) AS n_frames, count(*) FILTER (f > mu0)/count(*) AS occupancy_provisional FROM fv GROUP BY 1),
x AS (SELECT *, unnest([{_ETAS}]) AS eta FROM m)
SELECT x.physical_channel, any_value(n_frames) AS n_frames, round(any_value(mu), 9) AS mu, round(10*log10(any_value(mu)/any_value(x.mu0)), 9) AS mu_shift_db,
 abs(10*log10(any_value(mu)/any_value(x.mu0))) <= 0.2 AS null_available, round(any_value(occupancy_provisional), 9) AS occupancy_provisional, eta,
 round(count(*) FILTER (f > eta*mu)/count(*), 9) AS occupancy, round(10*log10(quantile_cont(f, 0.99) FILTER (f <= eta*mu)/any_value(mu)), 9) AS leak_p99_db
FROM x JOIN fv ON fv.physical_channel = x.physical_channel GROUP BY x.physical_channel, eta""")
def ladder(spark, d):
    df = slim(spark, d)
    out = Z.calibrate_ladder(df, materialize(median_mu(spark, d, df)), max_rows=bound(spark, d))
    return rounded(out, "mu", "mu_shift_db", "occupancy_provisional", "occupancy", "leak_p99_db")


@query("calibration_ladder", with_mode(f"""
, fh AS (SELECT * FROM v WHERE healthy), m AS (SELECT physical_channel, any_value(mode) AS mu, min(mu0) AS mu0, count(*) AS n_frames, count(*) FILTER (f > mu0)/count(*) AS occupancy_provisional FROM fh JOIN hm USING (physical_channel) GROUP BY 1),
x AS (SELECT *, unnest([{_ETAS}]) AS eta FROM m)
SELECT x.physical_channel, any_value(n_frames) AS n_frames, round(any_value(mu), 9) AS mu, round(10*log10(any_value(mu)/any_value(x.mu0)), 9) AS mu_shift_db,
 abs(10*log10(any_value(mu)/any_value(x.mu0))) <= 0.2 AS null_available, round(any_value(occupancy_provisional), 9) AS occupancy_provisional, eta,
 round(count(*) FILTER (f > eta*mu)/count(*), 9) AS occupancy, round(10*log10(quantile_cont(f, 0.99) FILTER (f <= eta*mu)/any_value(mu)), 9) AS leak_p99_db
FROM x JOIN fh ON fh.physical_channel = x.physical_channel GROUP BY x.physical_channel, eta"""))
def calibration(spark, d):
    """Ladder about the half-sample mode."""
    df = materialize(V.detector_frames(spark, d).where("healthy").select("physical_channel", "f", "mu0"))
    mu = materialize(Z.half_sample_mode(df, ["physical_channel"], "f", max_rows=bound(spark, d)).withColumnRenamed("mode", "mu"))
    return rounded(Z.calibrate_ladder(df, mu, max_rows=bound(spark, d)), "mu", "mu_shift_db", "occupancy_provisional", "occupancy", "leak_p99_db")


_DB = (0.0, 0.01, 0.02, 0.03, 0.05, 0.1, 0.5, 1.0, 2.0, 3.0)
_FACT = "[" + ", ".join(f"{{'x': {x}::DOUBLE, 'k': {10.0 ** (x / 10.0)!r}::DOUBLE}}" for x in _DB) + "]"
_SWEEP = f""", g AS (SELECT unnest({_FACT}) AS g),
sw AS (SELECT physical_channel, g.x AS excess_db, count(*) AS n_valid, count(*) FILTER (f > mu0*g.k)/count(*) AS masked, avg(baseband_power) AS pin, avg(baseband_power) FILTER (NOT f > mu0*g.k) AS pc FROM fv, g GROUP BY 1, 2)"""


@query("threshold_sweep", with_(FV) + _SWEEP + """
SELECT physical_channel, excess_db, n_valid, round(masked, 9) AS masked_fraction, round(1-masked, 9) AS kept_fraction, round(10*log10(pin), 9) AS input_power_db,
 round(10*log10(pc), 9) AS cleaned_power_db, round(10*log10(pc) - 18.0, 9) AS residual_db FROM sw""")
def sweep(spark, d):
    out = thresholds.threshold_sweep(V.detector_frames(spark, d), _DB, control_floor_db=18.0)
    return rounded(out, "masked_fraction", "kept_fraction", "input_power_db", "cleaned_power_db", "residual_db")


@query("recovered_bandwidth", with_(FV) + _SWEEP + """
SELECT excess_db, round(sum(1-masked)*0.390625::DOUBLE, 9) AS recovered_mhz, round(count(*)*0.390625::DOUBLE, 9) AS affected_mhz FROM sw GROUP BY 1""")
def recovered(spark, d):
    return rounded(thresholds.recovered_mhz(thresholds.threshold_sweep(V.detector_frames(spark, d), _DB)), "recovered_mhz", "affected_mhz")


@query("sweep_anchor_mismatches", with_(FV) + "SELECT count(*) AS mismatches, (SELECT count(*) FROM fv) AS checked FROM fv WHERE (f > mu0) <> reject")
def anchor(spark, d):
    df = V.detector_frames(spark, d)
    return df.agg(F.count_if(c("valid") & ((c("f") > c("mu0")) != c("reject"))).alias("mismatches"), F.count_if("valid").alias("checked"))


def _centre(spark, d):
    df = slim(spark, d)
    df = join_small(df.drop("mu0"), materialize(median_mu(spark, d, df)), ["physical_channel"])
    near = F.when(F.abs(c("f") - c("mu")) <= C.CORE_WINDOW * c("mu0"), c("f"))
    return df.groupBy("physical_channel").agg(F.min("mu").alias("c"), (F.stddev_samp(near) / C.TRUNCATED_WINDOW_SD).alias("sigma"))


@query("band_keep_sweep", with_(FV) + """
, m AS (SELECT physical_channel, quantile_cont(f, 0.5) AS c, min(mu0) AS mu0 FROM fv GROUP BY 1),
s AS (SELECT physical_channel, min(c) AS c, round(stddev_samp(f) FILTER (abs(f-c) <= 0.006::DOUBLE*m.mu0)/0.8796::DOUBLE, 9) AS sigma FROM fv JOIN m USING (physical_channel) GROUP BY 1),
x AS (SELECT physical_channel, (c-f)/sigma AS x FROM fv JOIN s USING (physical_channel)),
g AS (SELECT CAST(unnest(range(91)) AS INT) AS i)
SELECT physical_channel, i, round(-1.5::DOUBLE + i*0.05::DOUBLE, 6) AS k, round(count(*) FILTER (floor((x + 1.5)/0.05::DOUBLE) >= i)/count(*), 9) AS kept_one_sided,
 round((count(*) FILTER (floor((x + 1.5)/0.05::DOUBLE) >= i) - count(*) FILTER (ceil((x - 3.0::DOUBLE + 1.5)/0.05::DOUBLE) - 1 >= i))/count(*), 9) AS kept_band FROM x, g GROUP BY 1, 2""")
def band_sweep(spark, d):
    centre = _centre(spark, d).withColumn("sigma", F.round("sigma", 9))
    return rounded(rounded(thresholds.band_sweep(valid(spark, d), centre), "kept_one_sided", "kept_band"), "k", digits=6)


@query("band_keep_excess")
def band_excess(spark, d):
    return thresholds.band_sweep_excess(thresholds.band_sweep(valid(spark, d), _centre(spark, d)))


@query("three_arm_mask", with_(FV) + """
, m AS (SELECT physical_channel, quantile_cont(f, 0.5) AS mu FROM fv GROUP BY 1),
t AS (SELECT fv.*, mu, abs(f-mu) <= 0.006::DOUBLE*mu0 AS core FROM fv JOIN m USING (physical_channel)),
ub AS (SELECT physical_channel, event_id, CASE WHEN count(*) FILTER (core) >= 2 THEN quantile_cont(baseband_power, 0.5) FILTER (core) END AS b FROM t GROUP BY 1, 2),
fb AS (SELECT physical_channel, quantile_cont(b, 0.5) AS fb, count(*) FILTER (b IS NULL) AS n_fallback_units FROM ub GROUP BY 1),
p AS (SELECT t.*, baseband_power/coalesce(b, fb) AS pn FROM t JOIN ub USING (physical_channel, event_id) JOIN fb USING (physical_channel)),
p1 AS (SELECT physical_channel, quantile_cont(pn, 0.5) FILTER (core) AS m1 FROM p GROUP BY 1),
p2 AS (SELECT physical_channel, 1.4826::DOUBLE*quantile_cont(abs(pn-m1), 0.5) FILTER (core) AS sigma FROM p JOIN p1 USING (physical_channel) GROUP BY 1),
k AS (SELECT p.*, sigma, f <= mu AS ce, f <= mu AND f >= mu - 0.012::DOUBLE*mu0 AS fl, f <= mu AND f >= mu - 0.012::DOUBLE*mu0 AND NOT pn > 1 + 5*sigma AS kp, 10*log10(greatest(pn, 1e-12::DOUBLE)) AS db FROM p JOIN p2 USING (physical_channel))
SELECT physical_channel, count(*) AS n, round(count(*) FILTER (ce)/count(*), 9) AS kept_ceiling, round(count(*) FILTER (fl)/count(*), 9) AS kept_band, round(count(*) FILTER (kp)/count(*), 9) AS kept_final,
 round(min(sigma), 9) AS sigma, any_value(n_fallback_units) AS n_fallback_units, round(1 - (count(*) FILTER (kp)/count(*))/(count(*) FILTER (fl)/count(*)), 6) AS veto_increment,
 round(quantile_cont(db, 0.5) FILTER (fl), 6) AS band_p50_db, round(quantile_cont(db, 0.999) FILTER (fl), 6) AS band_p999_db, round(quantile_cont(db, 0.5) FILTER (kp), 6) AS kept_p50_db, round(quantile_cont(db, 0.999) FILTER (kp), 6) AS kept_p999_db
FROM k JOIN fb USING (physical_channel) GROUP BY 1""")
def three_arm(spark, d):
    df = slim(spark, d, "event_id", "baseband_power")
    df = join_small(df, materialize(median_mu(spark, d, df).drop("mu0")), ["physical_channel"])
    df = df.withColumn("core", F.abs(c("f") - c("mu")) <= C.CORE_WINDOW * c("mu0"))
    out = robust.three_arm_mask(df, max_rows=bound(spark, d))
    out = rounded(out, "kept_ceiling", "kept_band", "kept_final", "sigma")
    return rounded(out, "veto_increment", "band_p50_db", "band_p999_db", "kept_p50_db", "kept_p999_db", digits=6)


@query("tail_decomposition", with_(FRAMES) + TAILS + """
, ub AS (SELECT physical_channel, event_id, CASE WHEN count(*) FILTER (core) >= 2 THEN quantile_cont(p_target, 0.5) FILTER (core) END AS bt, CASE WHEN count(*) FILTER (core) >= 2 THEN quantile_cont(p_ref_sum, 0.5) FILTER (core) END AS br FROM tl GROUP BY 1, 2),
fb AS (SELECT physical_channel, quantile_cont(bt, 0.5) AS ft, quantile_cont(br, 0.5) AS fr FROM ub GROUP BY 1),
k AS (SELECT tl.physical_channel, CASE WHEN lo THEN 'low' WHEN hi THEN 'high' WHEN core THEN 'core' END AS part, p_target/coalesce(bt, ft) AS nt, p_ref_sum/coalesce(br, fr) AS nr FROM tl JOIN ub USING (physical_channel, event_id) JOIN fb USING (physical_channel))
SELECT physical_channel, part, count(*) AS n, round(quantile_cont(nt, 0.5), 9) AS target_ratio, round(quantile_cont(nr, 0.5), 9) AS reference_ratio FROM k WHERE part IS NOT NULL GROUP BY 1, 2""")
def tail_parts(spark, d):
    out = robust.tail_decomposition(exposure.with_tails(V.detector_frames(spark, d), c("mu0")), max_rows=bound(spark, d))
    return rounded(out, "target_ratio", "reference_ratio")


@query("tail_unit_coincidence", with_(FRAMES) + TAILS + """
, k AS (SELECT physical_channel, event_id, max(lo::INT) AS lo, max(hi::INT) AS hi FROM tl GROUP BY 1, 2)
SELECT physical_channel, count(*) AS n_units, round(avg(lo), 9) AS p_low, round(avg(lo) FILTER (hi=1), 9) AS p_low_given_high FROM k GROUP BY 1""")
def coincidence(spark, d):
    out = robust.tail_coincidence(exposure.with_tails(V.detector_frames(spark, d), c("mu0")))
    return rounded(out, "p_low", "p_low_given_high")


@query("hourly_tail_rates", with_(FRAMES) + TAILS + f"""
SELECT physical_channel, {SOLAR.replace('unit_time0', '(unit_time0 + event_id % 86400)')} AS hour, count(*) AS n, round(count(*) FILTER (lo)/count(*), 9) AS low_rate, round(count(*) FILTER (hi)/count(*), 9) AS high_rate FROM tl GROUP BY 1, 2 HAVING count(*) > 100""")
def hourly_tails(spark, d):
    df = exposure.with_tails(V.detector_frames(spark, d), c("mu0"))
    out = robust.hourly_tail_rates(df, clock.solar_hour(c("unit_time0") + c("event_id") % 86400))
    return rounded(out, "low_rate", "high_rate")


@query("hourly_tail_bands", with_(FRAMES) + TAILS + f"""
, us AS (SELECT physical_channel, {SOLAR.replace('unit_time0', '(unit_time0 + event_id % 86400)')} AS hour, event_id, count(*) AS n, count(*) FILTER (lo) AS lo, count(*) FILTER (hi) AS hi FROM tl GROUP BY 1, 2, 3),
big AS (SELECT physical_channel, hour, CAST(sum(n) AS BIGINT) AS n, sum(lo)/sum(n) AS low_rate, sum(hi)/sum(n) AS high_rate FROM us GROUP BY 1, 2 HAVING sum(n) > 100),
rk AS (SELECT us.*, row_number() OVER (PARTITION BY physical_channel, hour ORDER BY event_id) - 1 AS d, count(*) OVER (PARTITION BY physical_channel, hour) AS u FROM us SEMI JOIN big USING (physical_channel, hour)),
dr AS ({bootstrap.draw_sql(41, "(SELECT physical_channel, hour, d, u FROM rk), (SELECT unnest(range(300)) AS replicate)")}),
tm AS (SELECT physical_channel, hour, replicate, pick AS d, count(*) AS w FROM dr GROUP BY ALL),
rs AS (SELECT physical_channel, hour, replicate, sum(lo*w)/greatest(sum(n*w), 1) AS l, sum(hi*w)/greatest(sum(n*w), 1) AS h FROM tm JOIN rk USING (physical_channel, hour, d) GROUP BY 1, 2, 3)
SELECT physical_channel, hour, any_value(n) AS n, round(any_value(low_rate), 9) AS low_rate, round(any_value(high_rate), 9) AS high_rate, round(quantile_cont(l, 0.16), 9) AS low_16, round(quantile_cont(l, 0.84), 9) AS low_84,
 round(quantile_cont(h, 0.16), 9) AS high_16, round(quantile_cont(h, 0.84), 9) AS high_84 FROM rs JOIN big USING (physical_channel, hour) GROUP BY 1, 2""")
def hourly_bands(spark, d):
    df = exposure.with_tails(V.detector_frames(spark, d), c("mu0"))
    out = robust.hourly_tail_bands(df, clock.solar_hour(c("unit_time0") + c("event_id") % 86400), max_rows=bound(spark, d))
    return rounded(out, "low_rate", "high_rate", "low_16", "low_84", "high_16", "high_84")


@query("sub_null_tail", with_(FV) + """
, m AS (SELECT physical_channel, quantile_cont(f, 0.5) AS mu FROM fv GROUP BY 1),
s AS (SELECT physical_channel, min(mu) AS mu, (min(mu) - quantile_cont(f, 0.05))/10 AS sigma FROM fv JOIN m USING (physical_channel) WHERE f <= mu GROUP BY 1),
j AS (SELECT fv.*, mu, sigma, f < mu - 5*sigma AS sub, abs(f-mu) <= sigma AS bulk FROM fv JOIN s USING (physical_channel)),
n AS (SELECT physical_channel, count(*) AS units_hit, max(c)/sum(c) AS top FROM (SELECT physical_channel, event_id, count(*) AS c FROM j WHERE sub GROUP BY 1, 2) GROUP BY 1)
SELECT physical_channel, count(*) AS n, count(*) FILTER (sub) AS n_sub, round(count(*) FILTER (sub)/count(*), 9) AS fraction, round(quantile_cont(f, 0.5) FILTER (sub)/min(mu), 9) AS median_over_mu,
 round(quantile_cont(baseband_power, 0.5) FILTER (sub)/quantile_cont(baseband_power, 0.5) FILTER (bulk), 9) AS power_ratio, any_value(units_hit) AS units_hit, round(any_value(top), 9) AS top_unit_share
FROM j JOIN n USING (physical_channel) GROUP BY 1""")
def sub_null(spark, d):
    df = slim(spark, d, "event_id", "baseband_power")
    mu = materialize(median_mu(spark, d, df).drop("mu0"))
    j = join_small(df, mu, ["physical_channel"])
    scale = grouped_quantiles(j, ["physical_channel"], {"_q": (F.when(c("f") <= c("mu"), c("f")), 0.05)}, [F.min("mu").alias("mu")],
                              max_rows=bound(spark, d)).withColumn("sigma", (c("mu") - c("_q")) / 10)
    scale = materialize(scale)
    return rounded(robust.sub_null_tail(df, scale, max_rows=bound(spark, d)), "fraction", "median_over_mu", "power_ratio", "top_unit_share")


_SPLIT = "1.02::DOUBLE"


@query("unit_homogeneity_classes", with_(FV) + f"""
, k AS (SELECT physical_channel, event_id, count(*) AS n, avg((f/mu0 < {_SPLIT})::INT) AS ls, avg(f/mu0) AS mean, stddev_samp(f/mu0) AS width FROM fv GROUP BY 1, 2),
z AS (SELECT *, CASE WHEN ls >= 0.99 THEN 'all_low' WHEN ls <= 0.01 THEN 'all_high' ELSE 'mixed' END AS kind FROM k)
SELECT physical_channel, kind, count(*) AS units, CAST(sum(n) AS BIGINT) AS frames, round(quantile_cont(mean, 0.5), 9) AS mean_median, round(quantile_cont(width, 0.5) FILTER (n >= 3), 9) AS width_median FROM z GROUP BY 1, 2""")
def unit_classes(spark, d):
    return rounded(robust.unit_class_summary(valid(spark, d), 1.02, max_rows=bound(spark, d)), "mean_median", "width_median")


@query("occupied_share", with_(FV) + """
SELECT physical_channel, count(*) AS n, round(count(*) FILTER (f/mu0 < 2)/count(*), 9) AS low_share, round(count(*) FILTER (f/mu0 >= 1.5 AND f/mu0 < 10)/count(*), 9) AS gap_share,
 round(count(*) FILTER (f/mu0 >= 10 AND f/mu0 < 14)/count(*), 9) AS high_share FROM fv GROUP BY 1""")
def occupied(spark, d):
    return rounded(robust.occupied_share(valid(spark, d)), "low_share", "gap_share", "high_share")


@query("mirrored_leak_estimate", with_(FV) + """
, x AS (SELECT physical_channel, CASE WHEN 1000*(f/mu0-1) BETWEEN -20.0001::DOUBLE AND -20.0001::DOUBLE + 100*0.4::DOUBLE THEN CAST(least(greatest(floor((1000*(f/mu0-1) - -20.0001::DOUBLE)/((-20.0001::DOUBLE + 100*0.4::DOUBLE - -20.0001::DOUBLE)/100.0::DOUBLE)), 0), 99) AS INT) END AS bin FROM fv),
h AS (SELECT physical_channel, bin, count(*) AS n FROM x WHERE bin IS NOT NULL GROUP BY 1, 2), tot AS (SELECT physical_channel, count(*) AS total FROM x GROUP BY 1),
g AS (SELECT physical_channel, CAST(unnest(range(100)) AS INT) AS bin FROM tot), a AS (SELECT g.physical_channel, g.bin, coalesce(n, 0)::DOUBLE AS n FROM g LEFT JOIN h USING (physical_channel, bin)),
p AS (SELECT *, -20.0001::DOUBLE + (bin+0.5)*0.4::DOUBLE AS mid, (2*0.25::DOUBLE - (-20.0001::DOUBLE + (bin+0.5)*0.4::DOUBLE) - (-20.0001::DOUBLE + 0.5*0.4::DOUBLE))/0.4::DOUBLE AS pos FROM a),
q AS (SELECT p.*, CASE WHEN pos >= 0 AND pos <= 99 THEN l.n + (pos - floor(pos))*(coalesce(r.n, l.n) - l.n) ELSE 0 END AS mirror FROM p LEFT JOIN a l ON l.physical_channel=p.physical_channel AND l.bin = floor(pos) LEFT JOIN a r ON r.physical_channel=p.physical_channel AND r.bin = floor(pos)+1),
e AS (SELECT *, greatest(n - mirror, 0) AS ex FROM q)
SELECT physical_channel, round(coalesce(sum(ex) FILTER (mid > 0.25 AND mid <= 6), 0)/any_value(total), 9) AS leak_fraction, round(coalesce(sum(ex) FILTER (mid > 0.25 AND mid <= 6), 0)/sum(ex) FILTER (mid > 0.25), 9) AS leak_of_excess
FROM e JOIN tot USING (physical_channel) GROUP BY 1""")
def leak(spark, d):
    df = valid(spark, d)
    centre = df.groupBy("physical_channel").agg(F.lit(0.25).alias("centre"), F.lit(6.0).alias("tau"))
    out = thresholds.leak_estimate(df, 1000 * (c("f") / c("mu0") - 1), centre, 20.0001, 0.4)
    return rounded(out, "leak_fraction", "leak_of_excess")


@query("rational_thresholds")
def rational(spark, d):
    df = V.detector_frames(spark, d)
    mu = median_mu(spark, d).withColumnRenamed("mu", "mu_hat")
    out = thresholds.rational_thresholds(df, mu)
    return out.withColumns({k: c(k).cast("long") for k in ("p", "q", "p_lo", "q_lo")})


@query("roc_youden", with_(FV) + """
, s AS (SELECT physical_channel, f AS score, event_id % 2 = 0 AS signal FROM (SELECT physical_channel, event_id, CASE WHEN event_id % 2 = 0 THEN f + 0.002::DOUBLE ELSE f END AS f FROM fv)),
k AS (SELECT physical_channel, score, count(*) FILTER (NOT signal) AS nn, count(*) FILTER (signal) AS ns FROM s GROUP BY 1, 2),
r AS (SELECT physical_channel, score, nn, (sum(nn) OVER w - nn)/sum(nn) OVER (PARTITION BY physical_channel) AS p_fa, (sum(ns) OVER w - ns)/sum(ns) OVER (PARTITION BY physical_channel) AS p_d FROM k WINDOW w AS (PARTITION BY physical_channel ORDER BY score DESC)),
z AS (SELECT * FROM r WHERE nn > 0),
b AS (SELECT * FROM z QUALIFY row_number() OVER (PARTITION BY physical_channel ORDER BY p_d - p_fa DESC, score) = 1),
t1 AS (SELECT * FROM z QUALIFY row_number() OVER (PARTITION BY physical_channel ORDER BY abs(p_fa - 0.1::DOUBLE), score) = 1),
t2 AS (SELECT * FROM z QUALIFY row_number() OVER (PARTITION BY physical_channel ORDER BY abs(p_fa - 0.01::DOUBLE), score) = 1),
t3 AS (SELECT * FROM z QUALIFY row_number() OVER (PARTITION BY physical_channel ORDER BY abs(p_fa - 0.001::DOUBLE), score) = 1)
SELECT b.physical_channel, b.score AS threshold, round(b.p_d - b.p_fa, 9) AS youden_j, round(b.p_fa, 9) AS p_fa, round(b.p_d, 9) AS p_d, round(t1.p_d, 9) AS p_d_at_0_1, round(t2.p_d, 9) AS p_d_at_0_01, round(t3.p_d, 9) AS p_d_at_0_001
FROM b JOIN t1 USING (physical_channel) JOIN t2 USING (physical_channel) JOIN t3 USING (physical_channel)""")
def youden(spark, d):
    signal = c("event_id") % 2 == 0
    s = valid(spark, d).select("physical_channel", (c("f") + F.when(signal, 0.002).otherwise(0.0)).alias("score"), signal.alias("signal"))
    out = thresholds.roc_youden(s, ["physical_channel"], max_rows=bound(spark, d))
    return rounded(out, "youden_j", "p_fa", "p_d", "p_d_at_0_1", "p_d_at_0_01", "p_d_at_0_001")


@query("policy_monthly_masks", with_(FRAMES) + f"""
, k AS (SELECT physical_channel, {MONTH} AS month, count(*) AS n, count(*) FILTER (f > mu0)/count(*) AS a, count(*) FILTER (f > mu0*1.4::DOUBLE)/count(*) AS b FROM v WHERE healthy GROUP BY 1, 2)
SELECT physical_channel, month, n, round(CASE WHEN n >= 5 THEN a END, 9) AS masked_stored, round(CASE WHEN n >= 5 THEN b END, 9) AS masked_policy FROM k""")
def policy_months(spark, d):
    return rounded(policy.apply_policy(V.detector_frames(spark, d)), "masked_stored", "masked_policy")


@query("policy_kept_excess", with_(FRAMES) + """
, k AS (SELECT physical_channel, 10*log10(greatest(f, 1e-9::DOUBLE)/mu0) AS x FROM v WHERE healthy AND f <= mu0*1.4::DOUBLE)
SELECT physical_channel, round(quantile_cont(x, 0.5), 9) AS median_db, round(quantile_cont(x, 0.99), 9) AS p99_db, round(max(x), 9) AS max_db, count(*) AS n FROM k GROUP BY 1""")
def kept_excess(spark, d):
    return rounded(policy.kept_excess(V.detector_frames(spark, d), max_rows=bound(spark, d)), "median_db", "p99_db", "max_db")


@query("channel_verdicts", with_(FV) + """
, m AS (SELECT physical_channel, quantile_cont(f, 0.5) AS mu, min(mu0) AS mu0 FROM fv GROUP BY 1),
k AS (SELECT physical_channel, 10*log10(min(mu)/min(m.mu0)) AS shift, count(*) FILTER (f > 1.2::DOUBLE*mu)/count(*) AS occ FROM fv JOIN m USING (physical_channel) GROUP BY 1)
SELECT physical_channel, round(shift, 9) AS mu_shift_db, round(occ, 9) AS occupancy, CASE WHEN shift > 3 OR occ >= 0.5 THEN 'excise' WHEN occ <= 0.1 THEN 'keep, light masking' ELSE 'keep, heavy masking' END AS disposition FROM k""")
def verdicts(spark, d):
    df = slim(spark, d)
    ladder_ = Z.calibrate_ladder(df, materialize(median_mu(spark, d, df)), etas=[1.2], leak=False)
    out = ladder_.select("physical_channel", "mu_shift_db", "occupancy", policy.disposition(c("mu_shift_db"), c("occupancy")).alias("disposition"))
    return rounded(out, "mu_shift_db", "occupancy")


_DISP = """
, vd AS (SELECT physical_channel, count(*) FILTER (reject)/count(*) < 0.55 AS kept FROM fv GROUP BY 1),
fids AS (SELECT unnest(range(492, 846)) AS freq_id),
fe AS (SELECT freq_id, 800e6::DOUBLE - freq_id*390625.0::DOUBLE - 195312.5 AS f_lo, 800e6::DOUBLE - freq_id*390625.0::DOUBLE + 195312.5 AS f_hi FROM fids),
al AS (SELECT unnest(range(14, 37)) AS physical_channel),
to_ AS (SELECT fe.*, al.physical_channel, coalesce(kept, FALSE) AS kept, kept IS NOT NULL AND NOT kept AND CAST(round_even((800e6 - (470e6 + (al.physical_channel-14)*6e6 + 309441.0))/390625.0, 0) AS BIGINT) = freq_id AS p
 FROM fe JOIN al ON f_lo < 470e6 + (al.physical_channel-13)*6e6 AND f_hi > 470e6 + (al.physical_channel-14)*6e6 LEFT JOIN vd ON vd.physical_channel = al.physical_channel),
ds AS (SELECT freq_id, f_lo, f_hi, count(*) AS n, bool_or(kept) AS k, bool_or(p) AS p, min(physical_channel) AS a, max(physical_channel) AS b FROM to_ GROUP BY 1, 2, 3),
dr AS (SELECT freq_id, f_lo, f_hi, CASE WHEN k OR p THEN 'keep' WHEN n = 1 AND (f_hi > 608e6 OR f_lo < 470e6) THEN 'keep' ELSE 'discard' END AS disposition,
 CASE WHEN k AND n=2 THEN 'edge shared: ch' || a || '/ch' || b WHEN k THEN 'kept allocation ch' || a WHEN p THEN 'pilot monitor, excised ch' || a WHEN n=2 THEN 'edge shared: ch' || a || '/ch' || b || ', both excised'
  WHEN f_hi > 608e6 OR f_lo < 470e6 THEN 'band edge (shares non-DTV spectrum)' ELSE 'interior of excised ch' || a END AS reason FROM ds)"""


def _dispositions(spark, d):
    df = valid(spark, d)
    kept = df.groupBy("physical_channel").agg((F.count_if("reject") / F.count(F.lit(1)) < 0.55).alias("kept"))
    return policy.channel_dispositions(spark.range(492, 846).withColumnRenamed("id", "freq_id"), kept)


@query("channel_dispositions", with_(FV) + _DISP + "SELECT * FROM dr")
def dispositions(spark, d):
    return _dispositions(spark, d)


@query("disposition_ranges", with_(FV) + _DISP + """
, gi AS (SELECT disposition, freq_id, freq_id - row_number() OVER (PARTITION BY disposition ORDER BY freq_id) AS g FROM dr)
SELECT disposition, min(freq_id) AS first, max(freq_id) AS last FROM gi GROUP BY disposition, g""")
def ranges(spark, d):
    return policy.contiguous_ranges(_dispositions(spark, d), ["disposition"])


def _band_sql(num: str, where: str, seed: int) -> str:
    return with_(FRAMES) + TAILS + f"""
, u AS (SELECT physical_channel, event_id, {num} AS a, count(*) AS b, row_number() OVER (PARTITION BY physical_channel ORDER BY event_id) - 1 AS d,
  count(*) OVER (PARTITION BY physical_channel) AS u FROM tl WHERE {where} GROUP BY 1, 2),
dr AS ({bootstrap.draw_sql(seed, "u, (SELECT unnest(range(300)) AS replicate)")}),
rp AS (SELECT dr.physical_channel, replicate, sum(u.a)/greatest(sum(u.b), 1.0::DOUBLE) AS r FROM dr JOIN u ON u.physical_channel = dr.physical_channel AND u.d = dr.pick GROUP BY 1, 2)
SELECT physical_channel, round(stddev_samp(r), 9) AS error, count(*) AS replicates, round(quantile_cont(r, 0.16), 9) AS low, round(quantile_cont(r, 0.84), 9) AS high FROM rp GROUP BY 1"""


@query("bootstrap_rate_band", _band_sql("count(*) FILTER (hi)", "TRUE", 31))
def rate_band(spark, d):
    df = exposure.with_tails(V.detector_frames(spark, d), c("mu0"))
    u = bootstrap.unit_sums(df, ["physical_channel"], "event_id", {"h": c("hi").cast("int"), "n": F.lit(1)})
    return rounded(bootstrap.ratio_band(u, ["physical_channel"], "event_id", "h", "n", replicates=300, max_rows=bound(spark, d)), "low", "high", "error")


@query("bootstrap_core_mean_error", _band_sql("sum(f)", "core", 11))
def core_error(spark, d):
    df = exposure.with_tails(V.detector_frames(spark, d), c("mu0")).where("core")
    u = bootstrap.unit_sums(df, ["physical_channel"], "event_id", {"s": c("f"), "n": F.lit(1)})
    out = bootstrap.ratio_band(u, ["physical_channel"], "event_id", "s", "n", replicates=300, seed=11, max_rows=bound(spark, d))
    return rounded(out, "low", "high", "error")


@query("bootstrap_high_quantile", with_(FV) + f"""
, u AS (SELECT physical_channel, event_id, count(*) AS n, row_number() OVER (PARTITION BY physical_channel ORDER BY event_id) - 1 AS d,
  count(*) OVER (PARTITION BY physical_channel) AS u FROM fv GROUP BY 1, 2),
dr AS ({bootstrap.draw_sql(5, "u, (SELECT unnest(range(300)) AS replicate)")}),
w AS (SELECT u.physical_channel, replicate, u.event_id, count(*) AS w, any_value(u.n) AS n FROM dr JOIN u ON u.physical_channel = dr.physical_channel AND u.d = dr.pick GROUP BY 1, 2, 3),
t AS (SELECT physical_channel, replicate, sum(w*n) AS total FROM w GROUP BY 1, 2),
x AS (SELECT physical_channel, replicate, f, sum(w) AS w FROM w JOIN fv USING (physical_channel, event_id) GROUP BY 1, 2, 3),
c AS (SELECT physical_channel, replicate, f, sum(w) OVER (PARTITION BY physical_channel, replicate ORDER BY f) AS upto FROM x),
rp AS (SELECT physical_channel, replicate, min(f) AS r FROM c JOIN t USING (physical_channel, replicate) WHERE upto >= 0.999::DOUBLE*total GROUP BY 1, 2)
SELECT physical_channel, count(*) AS replicates, round(quantile_cont(r, 0.16), 9) AS low, round(quantile_cont(r, 0.84), 9) AS high FROM rp GROUP BY 1""")
def high_quantile(spark, d):
    return rounded(bootstrap.weighted_high_quantile(valid(spark, d), ["physical_channel"], "event_id", "f", max_rows=bound(spark, d)), "low", "high")


def _stepped(spark, d):
    """Frames with a step of 10 dB on one channel from 1998-06 on."""
    up = (c("physical_channel") == 16) & (c("unit_time0") >= 896659200.0)
    df = V.frames(spark, d)
    return V.with_detector(df.withColumn("p_target", F.when(up, c("p_target") * 10).otherwise(c("p_target"))))


def _eras(spark, d, df=None):
    """Eras of the stepped frames, or of ``df``, which holds them; every table is written once and read by what follows."""
    levels = materialize(eras.unit_levels(_stepped(spark, d) if df is None else df))
    return materialize(eras.segment(levels, max_rows=bound(spark, d)))


@query("era_segmentation")
def era_segmentation(spark, d):
    return _eras(spark, d)


@query("monthly_unit_levels", with_(FRAMES) + UNIT_STATS + f"""
SELECT physical_channel, {MONTH} AS month, count(*) AS n_units, round(quantile_cont(level_db, 0.5), 9) AS level_db FROM us GROUP BY 1, 2""")
def monthly_levels(spark, d):
    return rounded(eras.monthly_levels(eras.unit_levels(V.detector_frames(spark, d)), max_rows=bound(spark, d)), "level_db")


@query("latest_era_frames")
def latest_era(spark, d):
    df = _stepped(spark, d).where("healthy").withColumn("month", clock.month_index(c("unit_time0")))
    return eras.latest_era(df, _eras(spark, d)).groupBy("physical_channel", "era").agg(F.count(F.lit(1)).alias("n"), F.avg("f").alias("mean_f"))


@query("quiet_era_floor")
def quiet_floor(spark, d):
    df = materialize(_stepped(spark, d).where("healthy").select("physical_channel", "event_id", "unit_time0", "f", "mu0", "healthy"))
    found = _eras(spark, d, df)
    df = df.withColumn("month", clock.month_index(c("unit_time0")))
    df = df.withColumn("shelf_db", units.excess_to_shelf_db(units.to_db(c("f") / c("mu0") - 1)))
    return eras.quiet_era_floor(df, found, max_rows=bound(spark, d))


@query("era_agreement")
def agreement(spark, d):
    e = _eras(spark, d)
    return eras.era_agreement(e, spark.createDataFrame([(16,), (17,)], "physical_channel int"))
