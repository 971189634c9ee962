"""Frame-level queries: scalars, gate, summaries, ledger."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import clock, exact, geometry, keys, stats, units
from ..operators import gate, reduce
from ..sources import views as V
from .oracle_views import FRAMES, FREQ_ID, UNITS, with_, wilson
from .registry import query

c = F.col
R9 = lambda col, n=9: F.round(col, n)


@query("mask_summary_by_channel", with_(FRAMES) + """
SELECT physical_channel, count(*) AS total_count, count(*) FILTER (valid) AS valid_count,
  count(*) FILTER (NOT valid) AS invalid_count, count(*) FILTER (valid AND reject) AS masked_count_valid,
  count(*) FILTER (valid AND NOT reject) AS unmasked_count_valid,
  round(count(*) FILTER (valid AND reject)/count(*) FILTER (valid), 9) AS mask_fraction_valid,
  round(count(*) FILTER (valid AND reject)/count(*), 9) AS mask_fraction_total
FROM v GROUP BY 1""")
def mask_summary(spark, d) -> DataFrame:
    out = reduce.mask_summary(V.detector_frames(spark, d))
    return out.withColumns({k: R9(c(k)) for k in ("mask_fraction_valid", "mask_fraction_total")})


ID = "physical_channel, event_id, frame_in_unit"
IDS = ("physical_channel", "event_id", "frame_in_unit")


@query("exact_reject_mask", with_(FRAMES) + f"SELECT {ID}, CAST(reject AS INT) AS reject_mask FROM v")
def exact_reject(spark, d):
    return V.detector_frames(spark, d).select(*IDS, c("reject").cast("int").alias("reject_mask"))


@query("coarse_power_ratio", with_(FRAMES) + f"SELECT {ID}, f FROM v")
def coarse_ratio(spark, d):
    return V.detector_frames(spark, d).select(*IDS, "f")


@query("normalized_ratio_excess_db", with_(FRAMES) + f""", n AS (SELECT *, CASE WHEN valid THEN p_target::DOUBLE*reference_norm_sum_sq/(p_ref_sum::DOUBLE*target_norm_sq) END AS q FROM v)
SELECT {ID}, round(q, 12) AS q, round(q-1, 12) AS rho, round(CASE WHEN q>0 THEN 10*log10(q) END, 9) AS q_db,
  round(CASE WHEN q-1>0 THEN 10*log10(q-1) END, 6) AS excess_db, round(f-1, 12) AS raw_excess FROM n""")
def normalized(spark, d):
    q = exact.normalized_ratio(c("p_target"), c("p_ref_sum"), c("target_norm_sq"), c("reference_norm_sum_sq"))
    return V.detector_frames(spark, d).withColumn("q", q).select(
        *IDS, R9(c("q"), 12).alias("q"), R9(c("q") - 1, 12).alias("rho"), R9(units.to_db(c("q"))).alias("q_db"),
        R9(units.to_db(c("q") - 1), 6).alias("excess_db"), R9(c("f") - 1, 12).alias("raw_excess"))


SHELF = "(11.3::DOUBLE - 10*log10(6e6::DOUBLE/(390625.0::DOUBLE/128)))"


@query("excess_to_shelf_snr", with_(FRAMES) + f""", n AS (SELECT *, CASE WHEN valid AND f/mu0-1>0 THEN 10*log10(f/mu0-1) END AS e FROM v)
SELECT {ID}, round(e + {SHELF}, 6) AS shelf_db, round((e + {SHELF}) - {SHELF}, 6) AS back_db,
  round(e + {SHELF} - 10*log10(1 + pow(10.0::DOUBLE, -1.13::DOUBLE)), 6) AS composite_db FROM n""")
def shelf(spark, d):
    e = units.to_db(c("f") / c("mu0") - 1)
    s = units.excess_to_shelf_db(c("e"))
    return V.detector_frames(spark, d).withColumn("e", e).select(
        *IDS, R9(s, 6).alias("shelf_db"), R9(units.shelf_to_excess_db(s), 6).alias("back_db"),
        R9(s + units.composite_to_shelf_db(), 6).alias("composite_db"))


@query("threshold_conversions", with_(FRAMES) + f""", x AS (SELECT DISTINCT physical_channel, mu0, unnest(range(-30, 1, 5))::DOUBLE AS snr_db FROM v),
t AS (SELECT *, 1 + pow(10.0::DOUBLE, (snr_db - {SHELF})/10) AS q_thr FROM x)
SELECT t.physical_channel, t.snr_db, round(q_thr, 9) AS q_thr, round(q_thr*t.mu0, 9) AS f_thr,
 round(q_thr*t.mu0/2, 9) AS half_ratio, count(*) FILTER (v.valid) AS n_valid,
 count(*) FILTER (v.valid AND v.f > q_thr*t.mu0) AS n_over
FROM t JOIN v USING (physical_channel) GROUP BY ALL""")
def threshold_conversions(spark, d):
    """Threshold table with exact rationals, then one conditional count each."""
    det = V.detector_frames(spark, d)
    grid = list(range(-30, 1, 5))
    table = (det.select("physical_channel", "mu0").distinct()
             .select("*", F.explode(F.array(*[F.lit(float(x)) for x in grid])).alias("snr_db"))
             .withColumn("q_thr", units.shelf_db_to_threshold(c("snr_db")))
             .withColumn("f_thr", c("q_thr") * c("mu0")))
    rational = units.with_half_rational(table.withColumn("half", c("f_thr") / 2), "half")
    ladder = rational.groupBy("physical_channel").agg(F.array_sort(F.collect_list(
        F.struct("snr_db", "half_num", "half_den"))).alias("ladder"))
    over = [F.count_if(exact.rational_mask(c("p_target"), c("p_ref_sum"), c("ladder")[i]["half_num"],
                                           c("ladder")[i]["half_den"])).alias(f"o{i}") for i in range(len(grid))]
    counts = det.join(F.broadcast(ladder), "physical_channel").groupBy("physical_channel").agg(
        F.count_if("valid").alias("n_valid"), *over)
    long = counts.select("physical_channel", "n_valid", F.explode(F.array(*[
        F.struct(F.lit(float(x)).alias("snr_db"), c(f"o{i}").alias("n_over")) for i, x in enumerate(grid)])).alias("s")
    ).select("physical_channel", "n_valid", "s.*")
    return rational.join(long, ["physical_channel", "snr_db"]).select(
        "physical_channel", "snr_db", R9(c("q_thr")).alias("q_thr"), R9(c("f_thr")).alias("f_thr"),
        R9(c("half_num").cast("double") / c("half_den").cast("double")).alias("half_ratio"), "n_valid", "n_over")


@query("rational_threshold_mask", with_(FRAMES) + f"""
SELECT {ID}, CAST(valid AND p_target::HUGEINT*1000003 > 502511::HUGEINT*p_ref_sum AS INT) AS mask,
 CAST(FALSE AS INT) AS overflow FROM v""")
def rational_mask(spark, d):
    num, den = F.lit(502511).cast("long"), F.lit(1000003).cast("long")
    return V.frames(spark, d).select(
        *IDS, exact.rational_mask(c("p_target"), c("p_ref_sum"), num, den).cast("int").alias("mask"),
        exact.rational_overflow(num, den).cast("int").alias("overflow"))


@query("rational_threshold_mask_wide", with_(FRAMES) + f"""
, s AS (SELECT *, p_target::HUGEINT*34359738368 AS p, p_ref_sum::HUGEINT*34359738368 AS r, CAST(4611686018427387904 // greatest(p_target, p_ref_sum, 1) AS BIGINT) AS k FROM v),
t AS (SELECT *, CASE event_id % 5 WHEN 0 THEN p_target*k WHEN 1 THEN p_target*k + 1 WHEN 2 THEN p_target*k - 1 ELSE 2317467823947239423 END AS num,
 CASE WHEN event_id % 5 < 3 THEN p_ref_sum*k ELSE 4611868127894829113 END AS den FROM s)
SELECT {ID}, CAST(valid AND p*den > num::HUGEINT*r AS INT) AS mask, CAST(FALSE AS INT) AS overflow FROM t""")
def rational_mask_wide(spark, d):
    """Powers of 63 bits and more against thresholds of 62; on three of five events the threshold is the ratio itself or one step beside it.

    A power grows with the part keys, so scaled ones are decimals."""
    df = V.frames(spark, d)
    k = F.floor(F.lit(1 << 62).cast("decimal(20,0)") / F.greatest("p_target", "p_ref_sum", F.lit(1).cast("long")).cast("decimal(20,0)")).cast("long")
    step = c("event_id") % 5
    num = F.when(step < 3, c("p_target") * k + F.element_at(F.array(F.lit(0), F.lit(1), F.lit(-1)), (step + 1).cast("int"))).otherwise(2317467823947239423)
    den = F.when(step < 3, c("p_ref_sum") * k).otherwise(4611868127894829113)
    wide = lambda k: (c(k).cast("decimal(20,0)") * F.lit(1 << 35).cast("decimal(11,0)")).cast("decimal(24,0)")
    return df.withColumn("num", num).withColumn("den", den).select(
        *IDS, exact.rational_mask(wide("p_target"), wide("p_ref_sum"), c("num"), c("den")).cast("int").alias("mask"),
        exact.rational_overflow(c("num"), c("den")).cast("int").alias("overflow"))


@query("null_power_ratio_and_norms", with_(FRAMES) + ", " + "wgt AS (SELECT * FROM (VALUES " + ", ".join(map(str, V.WEIGHTS)) + """) AS t(term, k, wr, wi)),
n AS (SELECT CAST(sum(wr*wr+wi*wi) FILTER (term=0) AS BIGINT) AS t_norm, CAST(sum(wr*wr+wi*wi) FILTER (term>0) AS BIGINT) AS r_norm FROM wgt)
SELECT physical_channel, round(mu0, 12) AS mu0, count(*) AS n_frames, any_value(t_norm) AS bank_target_norm,
 any_value(r_norm) AS bank_reference_norm, round(any_value(2.0::DOUBLE*t_norm/r_norm), 12) AS bank_mu0
FROM v, n GROUP BY 1, 2""")
def null_ratio(spark, d):
    w = V.weights(spark)
    e = c("wr") * c("wr") + c("wi") * c("wi")
    norms = w.agg(F.sum(F.when(c("term") == 0, e)).alias("bank_target_norm"),
                  F.sum(F.when(c("term") > 0, e)).alias("bank_reference_norm"))
    per = V.detector_frames(spark, d).groupBy("physical_channel", R9(c("mu0"), 12).alias("mu0")).agg(
        F.count(F.lit(1)).alias("n_frames"))
    return per.join(F.broadcast(norms), F.lit(True)).withColumn("bank_mu0", R9(exact.null_ratio(
        c("bank_target_norm"), c("bank_reference_norm")), 12))


@query("channel_geometry", with_(FRAMES) + f""", g AS (SELECT *, 470e6 + (physical_channel-14)*6e6 AS lo FROM v)
SELECT physical_channel, lo AS lower_edge_hz, lo+3e6 AS center_hz, lo+309441.0 AS pilot_hz, {FREQ_ID} AS freq_id,
 800e6 - {FREQ_ID}*390625.0::DOUBLE AS coarse_center_hz,
 CASE WHEN abs(lo+309441.0 - (800e6 - {FREQ_ID}*390625.0::DOUBLE)) <= 195312.5 THEN physical_channel END AS matched_channel,
 CAST(abs(lo+309441.0 - (800e6 - {FREQ_ID}*390625.0::DOUBLE)) <= 195312.5 AS INT) AS pilot_in_band, count(*) AS n
FROM g GROUP BY ALL""")
def channel_geometry(spark, d):
    ch, fid = c("physical_channel"), c("freq_id")
    per = V.frames(spark, d).groupBy("physical_channel").agg(F.count(F.lit(1)).alias("n"))
    g = per.withColumn("pilot_hz", geometry.pilot_hz(ch)).withColumn("freq_id", geometry.freq_id_of(c("pilot_hz")))
    center = geometry.coarse_center_hz(fid)
    return g.select("physical_channel", geometry.lower_edge_hz(ch).alias("lower_edge_hz"),
                    geometry.center_hz(ch).alias("center_hz"), "pilot_hz", "freq_id", center.alias("coarse_center_hz"),
                    geometry.nearest_channel(center).alias("matched_channel"),
                    geometry.pilot_in_channel(ch, fid).cast("int").alias("pilot_in_band"), "n")


@query("source_event_key", with_(UNITS) + """
SELECT unit_key, 'ns/' || status || '/baseband_' || event_id || '.h5' AS source_event_key FROM u""")
def source_event_key(spark, d):
    return V.units(spark, d).select("unit_key", keys.source_event_key(c("unit_key"), c("freq_id")).alias("source_event_key"))


LMST_DAYS = "(t/86400.0::DOUBLE + 2440587.5::DOUBLE - 2451545.0::DOUBLE)"
LMST_DEG = f"(280.46061837::DOUBLE + 360.98564736629::DOUBLE*{LMST_DAYS} + 0.000387933::DOUBLE*({LMST_DAYS}/36525.0)*({LMST_DAYS}/36525.0) - ({LMST_DAYS}/36525.0)*({LMST_DAYS}/36525.0)*({LMST_DAYS}/36525.0)/38710000.0::DOUBLE + -119.6175::DOUBLE)"
LMST = f"(((({LMST_DEG}) % 360.0::DOUBLE) + 360.0::DOUBLE) % 360.0::DOUBLE)/15.0::DOUBLE"
FT = "unit_time0 + frame_in_unit * 16384.0::DOUBLE * 2.56e-6::DOUBLE"


@query("frame_time_and_duration", with_(FRAMES) + f"""
SELECT {ID}, round({FT}, 6) AS frame_time, round(16384.0::DOUBLE*2.56e-6::DOUBLE, 9) AS duration_s FROM v""")
def frame_time(spark, d):
    return V.frames(spark, d).select(
        *IDS, R9(clock.frame_time(c("unit_time0"), c("frame_in_unit")), 6).alias("frame_time"),
        R9(clock.frame_duration()).alias("duration_s"))


@query("local_mean_sidereal_hours", with_(FRAMES) + f""", x AS (SELECT {ID}, {FT} AS t FROM v)
SELECT {ID}, round({LMST}, 5) AS lmst_hours FROM x""")
def lmst(spark, d):
    t = clock.frame_time(c("unit_time0"), c("frame_in_unit"))
    return V.frames(spark, d).select(*IDS, R9(clock.lmst_hours(t), 5).alias("lmst_hours"))


CIVIL = "((make_timestamp(CAST(floor(t) AS BIGINT)*1000000) AT TIME ZONE 'UTC') AT TIME ZONE 'America/Vancouver')"
UTC = "make_timestamp(CAST(floor(t) AS BIGINT)*1000000)"
SEASON = lambda m: f"CASE WHEN {m} IN (12,1,2) THEN 'DJF' WHEN {m} IN (3,4,5) THEN 'MAM' WHEN {m} IN (6,7,8) THEN 'JJA' ELSE 'SON' END"


@query("calendar_coordinates", with_(UNITS) + f""", x AS (SELECT physical_channel, event_id, unit_time0 + (event_id % 86400) AS t FROM u)
SELECT physical_channel, event_id, strftime({UTC}, '%Y-%m') AS utc_month, CAST(hour({UTC}) AS INT) AS utc_hour,
 strftime({CIVIL}, '%Y-%m') AS civil_month, CAST(hour({CIVIL}) AS INT) AS civil_hour, {SEASON(f"month({CIVIL})")} AS season,
 CAST(year({UTC})*12 + month({UTC}) - 1 - (2018*12+11) AS INT) AS month_index,
 year({UTC})::VARCHAR || 'Q' || quarter({UTC})::VARCHAR AS quarter_label,
 CAST(floor((((t/3600.0::DOUBLE - 119.6175::DOUBLE/15.0) % 24.0::DOUBLE) + 24.0::DOUBLE) % 24.0::DOUBLE) AS INT) AS solar_hour
FROM x""")
def calendar(spark, d):
    t = c("unit_time0") + c("event_id") % 86400
    civil = clock.civil_ntz(c("t"))
    date = clock.utc_date(c("t"))
    return V.units(spark, d).withColumn("t", t).select(
        "physical_channel", "event_id", clock.month_label(date).alias("utc_month"), clock.utc_hour(c("t")).alias("utc_hour"),
        clock.month_label(civil).alias("civil_month"), F.hour(civil).alias("civil_hour"),
        clock.season(F.month(civil)).alias("season"), clock.month_index(c("t")).alias("month_index"),
        clock.quarter_label(c("t")).alias("quarter_label"), clock.solar_hour(c("t")).alias("solar_hour"))


@query("power_and_level_db", with_(FRAMES) + f"""
SELECT {ID}, round(CASE WHEN baseband_power>0 THEN 10*log10(baseband_power) END, 9) AS power_db,
 round(10*log10(greatest(f, 1e-9::DOUBLE)/mu0), 9) AS level_db FROM v""")
def level(spark, d):
    lv = F.when(c("f").isNotNull(), units.level_db(c("f"), c("mu0")))
    return V.detector_frames(spark, d).select(
        *IDS, R9(units.to_db(c("baseband_power"))).alias("power_db"),
        R9(F.coalesce(lv, units.level_db(F.lit(0.0), c("mu0")))).alias("level_db"))


GATE = """, g AS (SELECT *, list_filter([CASE WHEN NOT valid THEN 'detector_invalid' END,
  CASE WHEN p_target=0 AND p_ref_sum=0 THEN 'detector_powers_all_zero' END,
  CASE WHEN baseband_power IS NULL OR NOT isfinite(baseband_power) THEN 'baseband_power_nonfinite' END,
  CASE WHEN baseband_power<0 OR baseband_power>128 THEN 'baseband_power_out_of_complex_int4_bounds' END,
  CASE WHEN baseband_power=128 THEN 'baseband_power_at_negative_full_scale_ceiling' END,
  CASE WHEN valid AND f IS NULL THEN 'coarse_power_ratio_nonfinite' END], lambda x: x IS NOT NULL) AS reasons FROM v)
"""


@query("frame_health_gate", with_(FRAMES) + GATE + f"SELECT {ID}, array_to_string(reasons, '+') AS reason_codes, CAST(len(reasons)=0 AS INT) AS include FROM g")
def health_gate(spark, d):
    return gate.with_reasons(V.detector_frames(spark, d)).select(
        *IDS, F.concat_ws("+", "reasons").alias("reason_codes"), c("include").cast("int").alias("include"))


@query("gate_reason_summary", with_(FRAMES) + GATE + """, r AS (SELECT physical_channel, unnest(reasons) AS reason FROM g)
SELECT physical_channel, reason, count(*) AS n FROM r GROUP BY 1, 2
UNION ALL SELECT NULL, reason, count(*) FROM r GROUP BY 2
UNION ALL SELECT physical_channel, NULL, count(*) FROM g WHERE len(reasons)>0 GROUP BY 1
UNION ALL SELECT NULL, NULL, count(*) FROM g WHERE len(reasons)>0""")
def gate_summary(spark, d):
    return gate.reason_summary(gate.with_reasons(V.detector_frames(spark, d)))


@query("health_summary", with_(FRAMES) + GATE + """, h AS (SELECT *, len(reasons) = 0 AS inc FROM g)
SELECT physical_channel, count(*) AS stored_frames, round(2.0::DOUBLE*CAST(sum(p_target) FILTER (valid) AS DOUBLE)/CAST(sum(p_ref_sum) FILTER (valid) AS DOUBLE), 12) AS stored_ratio, round(count(*) FILTER (valid AND reject)/count(*) FILTER (valid), 9) AS stored_masked,
 count(*) FILTER (inc) AS corrected_frames, round(2.0::DOUBLE*CAST(sum(p_target) FILTER (valid AND inc) AS DOUBLE)/CAST(sum(p_ref_sum) FILTER (valid AND inc) AS DOUBLE), 12) AS corrected_ratio, round(count(*) FILTER (valid AND inc AND reject)/count(*) FILTER (valid AND inc), 9) AS corrected_masked,
 count(*) FILTER (NOT inc) AS excluded FROM h GROUP BY ROLLUP (physical_channel)""")
def health_summary(spark, d):
    out = gate.health_summary(gate.with_reasons(V.detector_frames(spark, d)))
    for name, digits in (("stored_ratio", 12), ("corrected_ratio", 12), ("stored_masked", 9), ("corrected_masked", 9)):
        out = out.withColumn(name, F.round(name, digits))
    return out


@query("detector_version_counts", with_(FRAMES) + """
, ch AS (SELECT DISTINCT physical_channel AS k FROM v)
SELECT 'version' AS token, 'det/1.' || k || ' kernel=2.' || k % 2 || '.0 K=128 source=a=' || k AS value, CAST(1 AS BIGINT) AS channels FROM ch
UNION ALL SELECT 'kernel', '2.' || k % 2 || '.0', count(*) FROM ch GROUP BY k % 2 UNION ALL SELECT 'K', '128', count(*) FROM ch UNION ALL SELECT 'source', 'a=' || k, 1 FROM ch""")
def version_counts(spark, d):
    k = c("physical_channel")
    text = F.concat(F.lit("det/1."), k.cast("string"), F.lit(" kernel=2."), (k % 2).cast("string"), F.lit(".0 K=128 source=a="), k.cast("string"))
    return gate.version_counts(V.frames(spark, d).select(k).distinct().withColumn("detector_version", text))


@query("exclusion_ledger", with_(UNITS) + GATE + f""", e AS (SELECT *, {FREQ_ID} AS freq_id FROM g WHERE len(reasons)>0)
SELECT 'frame_gate_v1/fid-' || freq_id || '/source-ns/baseband_' || event_id || '.h5/frame-' || frame_in_unit || '/reasons-' || array_to_string(reasons,'+') AS ledger_key,
 array_to_string(reasons,'+') AS reason_codes, freq_id, physical_channel, 'ns/baseband_' || event_id || '.h5' AS source_event_key, event_id, frame_in_unit,
 round({FT}, 6) AS frame_time, valid, reject AS reject_mask, baseband_power, p_target, p_ref_sum FROM e""")
def ledger(spark, d):
    fid = V.freq_id(c("physical_channel"))
    unit_key = F.concat(F.lit("ns/baseband_"), c("event_id").cast("string"), F.lit("_"), fid.cast("string"), F.lit(".h5"))
    df = gate.with_reasons(V.detector_frames(spark, d))
    out = gate.exclusion_ledger(df, keys.source_event_key(unit_key, fid), fid)
    return out.withColumn("frame_time", R9(c("frame_time"), 6))


@query("drop_channels", with_(FRAMES) + "SELECT physical_channel, count(*) AS n FROM v WHERE physical_channel NOT IN (15) GROUP BY 1")
def drop_channels(spark, d):
    return gate.drop_channels(V.frames(spark, d), [15]).groupBy("physical_channel").agg(F.count(F.lit(1)).alias("n"))


@query("since_window_filter", with_(FRAMES) + "SELECT physical_channel, count(*) AS n, max(unit_time0) AS last_start FROM v WHERE unit_time0 >= 946684800 AND healthy GROUP BY 1")
def since_window(spark, d):
    return gate.since(V.detector_frames(spark, d), 946684800.0).where("healthy").groupBy("physical_channel").agg(
        F.count(F.lit(1)).alias("n"), F.max("unit_time0").alias("last_start"))


@query("baseband_power_masked_mean", with_(FRAMES) + """
SELECT physical_channel, round(avg(baseband_power) FILTER (valid), 9) AS valid_mean,
 round(avg(baseband_power) FILTER (healthy), 9) AS healthy_mean, avg(baseband_power) FILTER (baseband_power < 0) AS none_mean
FROM v GROUP BY 1""")
def masked_mean(spark, d):
    p = c("baseband_power")
    return V.detector_frames(spark, d).groupBy("physical_channel").agg(
        R9(reduce.masked_mean(p, c("valid"))).alias("valid_mean"),
        R9(reduce.masked_mean(p, c("healthy"))).alias("healthy_mean"), reduce.masked_mean(p, p < 0).alias("none_mean"))


@query("spectrum_before_after_power", with_(FRAMES) + """
SELECT physical_channel, round(avg(baseband_power) FILTER (valid), 9) AS before_linear,
 round(avg(baseband_power) FILTER (valid AND NOT reject), 9) AS after_linear, count(*) FILTER (valid) AS n_before,
 count(*) FILTER (valid AND NOT reject) AS n_after, round(10*log10(avg(baseband_power) FILTER (valid)), 9) AS before_db,
 round(10*log10(avg(baseband_power) FILTER (valid AND NOT reject)), 9) AS after_db FROM v GROUP BY 1""")
def before_after(spark, d):
    out = reduce.power_before_after(V.detector_frames(spark, d))
    return out.withColumns({k: R9(c(k)) for k in ("before_linear", "after_linear", "before_db", "after_db")})


@query("channel_ratio_summary", with_(FRAMES) + """
SELECT physical_channel, count(*) AS n, count(f) AS n_finite, round(avg(f), 9) AS mean_f, max(f) AS max_f,
 round(count(*) FILTER (valid)/count(*), 9) AS valid_fraction,
 round(count(*) FILTER (valid AND reject)/count(*) FILTER (valid), 9) AS mask_fraction FROM v GROUP BY 1""")
def channel_summary(spark, d):
    out = reduce.channel_summary(V.detector_frames(spark, d))
    return out.withColumns({k: R9(c(k)) for k in ("mean_f", "valid_fraction", "mask_fraction")})


_LO, _HI = wilson("k", "n")


@query("wilson_interval", with_(FRAMES) + f""", s AS (SELECT physical_channel, frame_in_unit, count(*) FILTER (valid AND reject) AS k, count(*) FILTER (valid) AS n FROM v GROUP BY 1, 2)
SELECT physical_channel, frame_in_unit, k, n, round(k/nullif(n,0), 9) AS fraction,
 round(sqrt((k::DOUBLE/nullif(n,0))*(1-k::DOUBLE/nullif(n,0))/nullif(n,0)), 9) AS se, round({_LO}, 9) AS low, round({_HI}, 9) AS high FROM s""")
def wilson_query(spark, d):
    s = V.detector_frames(spark, d).groupBy("physical_channel", "frame_in_unit").agg(
        F.count_if(c("valid") & c("reject")).alias("k"), F.count_if("valid").alias("n"))
    low, high = stats.wilson(c("k"), c("n"))
    return s.select("*", R9(stats.fraction(c("k"), c("n"))).alias("fraction"),
                    R9(stats.standard_error(c("k"), c("n"))).alias("se"), R9(low).alias("low"), R9(high).alias("high"))


@query("unity_crossings", with_(FRAMES) + """
SELECT physical_channel, count(*) FILTER (valid) AS n_valid,
 count(*) FILTER (valid AND p_target*reference_norm_sum_sq > target_norm_sq*p_ref_sum) AS n_crossing,
 count(*) FILTER (valid AND p_target*reference_norm_sum_sq = target_norm_sq*p_ref_sum) AS n_equal,
 round(count(*) FILTER (reject)/count(*) FILTER (valid), 9) AS crossing_fraction FROM v GROUP BY 1""")
def unity_crossings(spark, d):
    equal = exact.exact_equal(c("p_target"), c("reference_norm_sum_sq"), c("p_ref_sum"), c("target_norm_sq"))
    return V.detector_frames(spark, d).groupBy("physical_channel").agg(
        F.count_if("valid").alias("n_valid"), F.count_if("reject").alias("n_crossing"),
        F.count_if(c("valid") & equal).alias("n_equal"),
        R9(F.when(F.count_if("valid") > 0, F.count_if("reject") / F.count_if("valid"))).alias("crossing_fraction"))
