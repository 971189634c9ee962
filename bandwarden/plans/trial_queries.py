"""Trial tables and the transmitter census."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import keys
from ..operators.bootstrap import draw_sql
from ..operators.numbering import number_within
from ..operators import census as S, trials as T
from ..session import materialize
from ..sources import views as V
from ..sources.tables import row_bound
from .distribution_queries import rounded
from .oracle_views import CENSUS, FRAMES, TRIALS, with_, wilson
from .registry import query

c = F.col


def paired_grid(spark, d):
    """Trials numbered within each grid value: a trial has one row at each, and their number grows with the table."""
    rows = V.trials(spark, d).withColumnRenamed("trial", "source")
    return number_within(rows, ["snr_db"], ["source", "offset_bin", "ratio", "power"], "trial", max_rows=bound(spark, d))


def bound(spark, d):
    return row_bound(spark, d, "lineitem")


@query("paired_trials", with_(TRIALS) + """
, tt AS (SELECT row_number() OVER (PARTITION BY snr_db ORDER BY trial, offset_bin, ratio, power) - 1 AS trial, snr_db FROM trials),
p AS (SELECT trial FROM tt GROUP BY 1 HAVING count(DISTINCT snr_db) = (SELECT count(DISTINCT snr_db) FROM tt))
SELECT trial, snr_db, count(*) AS n FROM tt SEMI JOIN p USING (trial) GROUP BY 1, 2""")
def paired(spark, d):
    t = paired_grid(spark, d)
    return T.paired_trials(t, "trial", "snr_db").groupBy("trial", "snr_db").agg(F.count(F.lit(1)).alias("n"))


_LO, _HI = wilson("k", "n")


@query("sweep_summary", with_(TRIALS) + f"""
, s AS (SELECT snr_db, offset_bin, count(*) AS n, avg(ratio) AS mean, stddev_pop(ratio) AS std, max(ratio) AS max, count(*) FILTER (ratio > 1.005::DOUBLE) AS k FROM trials GROUP BY 1, 2)
SELECT snr_db, offset_bin, n AS trials, round(mean, 12) AS mean, round(std, 9) AS std, round(max, 9) AS max, k AS detected, round(k/n, 9) AS rate, round({_LO}, 9) AS rate_lo, round({_HI}, 9) AS rate_hi FROM s""")
def sweep_summary(spark, d):
    out = T.sweep_summary(V.trials(spark, d), ["snr_db", "offset_bin"], "ratio", c("ratio") > 1.005)
    return rounded(rounded(out, "std", "max", "rate", "rate_lo", "rate_hi"), "mean", digits=12)


_ORD = """, nu AS (SELECT offset_bin, ratio, row_number() OVER (PARTITION BY offset_bin ORDER BY ratio) - 1 AS i, count(*) OVER (PARTITION BY offset_bin) AS n FROM trials WHERE snr_db = 0),
th AS (SELECT offset_bin, ratio AS threshold, i AS order_index, n AS null_trials FROM nu WHERE i = least(n-1, greatest(0, CAST(ceil(0.99::DOUBLE*n) AS BIGINT)-1))),
tq AS (SELECT *, CAST(ceil(threshold*65536.0::DOUBLE) AS BIGINT) AS multiplier_q16 FROM th)"""


@query("order_statistic_threshold", with_(TRIALS) + _ORD + """
SELECT tq.offset_bin, round(any_value(threshold), 9) AS threshold, any_value(order_index) AS order_index, any_value(null_trials) AS null_trials, count(*) FILTER (nu.ratio > threshold) AS null_exceedances,
 round(count(*) FILTER (nu.ratio > threshold)/any_value(null_trials), 9) AS empirical_p_fa, any_value(null_trials)*0.01 >= 1 AS resolved, any_value(multiplier_q16) AS multiplier_q16 FROM tq JOIN nu USING (offset_bin) GROUP BY 1""")
def order_threshold(spark, d):
    null = V.trials(spark, d).where("snr_db = 0")
    out = T.order_statistic_threshold(null, ["offset_bin"], "ratio", 0.01, max_rows=bound(spark, d))
    return rounded(out, "threshold", "empirical_p_fa")


_RATE = """, rt AS (SELECT offset_bin, snr_db, count(*) AS trials, count(*) FILTER (ratio > threshold)/count(*) AS rate, count(*) FILTER (ratio*65536.0::DOUBLE > multiplier_q16)/count(*) AS rate_q16 FROM trials JOIN tq USING (offset_bin) GROUP BY 1, 2)"""


def _rates(spark, d):
    t = V.trials(spark, d)
    th = T.order_statistic_threshold(t.where("snr_db = 0"), ["offset_bin"], "ratio", 0.01, max_rows=bound(spark, d))
    return T.decision_rates(t, th, ["offset_bin"], ["snr_db"], "ratio")


@query("decision_rates", with_(TRIALS) + _ORD + _RATE + "SELECT offset_bin, snr_db, trials, round(rate, 9) AS rate, round(rate_q16, 9) AS rate_q16 FROM rt")
def decision_rates(spark, d):
    return rounded(_rates(spark, d), "rate", "rate_q16")


_MONO = ", mo AS (SELECT offset_bin, snr_db, rate, max(rate) OVER (PARTITION BY offset_bin ORDER BY snr_db) AS y FROM rt)"


@query("monotone_detection_rates", with_(TRIALS) + _ORD + _RATE + _MONO + "SELECT offset_bin, snr_db, round(rate, 9) AS rate, round(y, 9) AS monotone FROM mo")
def monotone(spark, d):
    from pyspark.sql import Window as W
    w = W.partitionBy("offset_bin").orderBy("snr_db")
    out = _rates(spark, d).select("offset_bin", "snr_db", "rate", F.max("rate").over(w).alias("monotone"))
    return rounded(out, "rate", "monotone")


@query("crossing_bracket", with_(TRIALS) + _ORD + _RATE + _MONO + """
, lg AS (SELECT *, lag(y) OVER w AS y0, lag(snr_db) OVER w AS x0 FROM mo WINDOW w AS (PARTITION BY offset_bin ORDER BY snr_db)),
h AS (SELECT offset_bin, snr_db::DOUBLE AS x, x0::DOUBLE AS x0, y0, y, x0 + (snr_db-x0)*(0.3::DOUBLE-y0)/(y-y0) AS e FROM lg WHERE y0 < 0.3::DOUBLE AND y >= 0.3::DOUBLE QUALIFY row_number() OVER (PARTITION BY offset_bin ORDER BY snr_db) = 1),
a AS (SELECT offset_bin, max(y - rate) AS adjustment FROM mo GROUP BY 1)
SELECT a.offset_bin, x IS NOT NULL AS bracketed, x0 AS snr_lo, x AS snr_hi, round(y0, 9) AS pd_lo, round(y, 9) AS pd_hi, round(e, 9) AS estimate, round(adjustment, 9) AS adjustment FROM a LEFT JOIN h USING (offset_bin)""")
def crossing(spark, d):
    out = T.crossing(_rates(spark, d), ["offset_bin"], "snr_db", "rate", 0.3)
    return rounded(out, "pd_lo", "pd_hi", "estimate", "adjustment")


@query("ks_distance", with_(TRIALS) + """
, k AS (SELECT snr_db, ratio, count(*) FILTER (offset_bin < 4) AS a, count(*) FILTER (offset_bin >= 4) AS b FROM trials GROUP BY 1, 2),
r AS (SELECT snr_db, sum(a) OVER w AS ca, sum(b) OVER w AS cb, sum(a) OVER (PARTITION BY snr_db) AS na, sum(b) OVER (PARTITION BY snr_db) AS nb FROM k WINDOW w AS (PARTITION BY snr_db ORDER BY ratio)),
g AS (SELECT snr_db, max(abs(ca/na - cb/nb)) AS distance, CAST(any_value(na) AS BIGINT) AS n_first, CAST(any_value(nb) AS BIGINT) AS n_second FROM r GROUP BY 1)
SELECT snr_db, round(distance, 9) AS distance, n_first, n_second, round(1.36::DOUBLE*sqrt((n_first+n_second)/(n_first*n_second)), 9) AS critical, distance <= 1.36::DOUBLE*sqrt((n_first+n_second)/(n_first*n_second)) AS passes FROM g""")
def ks(spark, d):
    out = T.ks_distance(V.trials(spark, d), ["snr_db"], "ratio", c("offset_bin") >= 4, max_rows=bound(spark, d))
    return rounded(out, "distance", "critical")


@query("paired_crossing_bootstrap", with_(TRIALS) + f"""
, tt AS (SELECT row_number() OVER (PARTITION BY snr_db ORDER BY trial, offset_bin, ratio, power) - 1 AS trial, snr_db, ratio FROM trials),
p AS (SELECT trial FROM tt GROUP BY 1 HAVING count(DISTINCT snr_db) = (SELECT count(DISTINCT snr_db) FROM tt)),
hi AS (SELECT trial, snr_db, max((ratio > 1.004::DOUBLE)::INT) AS hit FROM tt SEMI JOIN p USING (trial) GROUP BY 1, 2),
ids AS (SELECT trial, row_number() OVER (ORDER BY trial) - 1 AS d, count(*) OVER () AS u FROM p),
dr AS ({draw_sql(7, "ids, (SELECT unnest(range(300)) AS replicate)")}),
w AS (SELECT replicate, ids.trial, count(*) AS w FROM dr JOIN ids ON ids.d = dr.pick GROUP BY 1, 2),
rt AS (SELECT replicate, snr_db, sum(hit*w)/sum(w) AS rate FROM hi JOIN w USING (trial) GROUP BY 1, 2),
mo AS (SELECT *, max(rate) OVER (PARTITION BY replicate ORDER BY snr_db) AS y FROM rt),
lg AS (SELECT *, lag(y) OVER w AS y0, lag(snr_db) OVER w AS x0 FROM mo WINDOW w AS (PARTITION BY replicate ORDER BY snr_db)),
h AS (SELECT replicate, x0 + (snr_db-x0)*(0.6::DOUBLE-y0)/(y-y0) AS e FROM lg WHERE y0 < 0.6::DOUBLE AND y >= 0.6::DOUBLE QUALIFY row_number() OVER (PARTITION BY replicate ORDER BY snr_db) = 1)
SELECT count(*) AS valid_replicates, round(quantile_cont(e, 0.025), 9) AS low, round(quantile_cont(e, 0.5), 9) AS median, round(quantile_cont(e, 0.975), 9) AS high FROM h HAVING count(*) > 0""")
def crossing_bootstrap(spark, d):
    t = T.paired_trials(materialize(paired_grid(spark, d).select("trial", "snr_db", "ratio")), "trial", "snr_db")
    out = T.paired_crossing_bootstrap(t, "trial", "snr_db", "ratio", 1.004, 0.6, 300, 7, max_rows=bound(spark, d))
    return rounded(out, "low", "median", "high")


_PTS = ", pt AS (SELECT snr_db AS amplitude, count(*) AS n_valid, avg(ratio-1) AS rho_hat, stddev_samp(ratio-1)/sqrt(count(*)) AS rho_sem, snr_db*snr_db AS injected_power FROM trials GROUP BY 1)"


def _injected(spark, d):
    return V.trials(spark, d).select(c("snr_db").alias("amplitude"), (c("ratio") - 1).alias("rho"), "ratio", "power")


@query("injection_points", with_(TRIALS) + _PTS + "SELECT amplitude, n_valid, round(rho_hat, 9) AS rho_hat, round(rho_sem, 9) AS rho_sem, injected_power FROM pt")
def injection_points(spark, d):
    return rounded(T.injection_points(_injected(spark, d), "amplitude", "rho"), "rho_hat", "rho_sem")


_DLO, _DHI = wilson("detected", "n_valid")


@query("injection_detection", with_(TRIALS) + f"""
, ct AS (SELECT count(*) AS n_control, quantile_cont(ratio, 0.9) AS a, quantile_cont(ratio, 0.99) AS b, quantile_cont(power, 0.9) AS c, quantile_cont(power, 0.99) AS e FROM trials WHERE snr_db = 0),
k AS (SELECT snr_db AS amplitude, count(*) AS n_valid, any_value(n_control) AS n_control, count(*) FILTER (ratio > a) AS ka, count(*) FILTER (ratio > b) AS kb, count(*) FILTER (power > c) AS kc, count(*) FILTER (power > e) AS ke FROM trials, ct GROUP BY 1),
l AS (SELECT amplitude, n_valid, n_control, unnest([{{'s': 'ratio', 'p': 0.1::DOUBLE, 'd': ka}}, {{'s': 'ratio', 'p': 0.01::DOUBLE, 'd': kb}}, {{'s': 'power', 'p': 0.1::DOUBLE, 'd': kc}}, {{'s': 'power', 'p': 0.01::DOUBLE, 'd': ke}}]) AS r FROM k),
m AS (SELECT amplitude, n_valid, n_control, r.s AS statistic, r.p AS p_fa, r.d AS detected FROM l WHERE n_control >= 10/r.p)
SELECT *, round(detected/n_valid, 9) AS p_d, round({_DLO}, 9) AS p_d_lo, round({_DHI}, 9) AS p_d_hi FROM m""")
def injection_detection(spark, d):
    out = T.injection_detection(_injected(spark, d), "amplitude", ["ratio", "power"], [0.1, 0.01], max_rows=bound(spark, d))
    return rounded(out, "p_d", "p_d_lo", "p_d_hi")


@query("injection_recovery_fit", with_(TRIALS) + _PTS + """
, s AS (SELECT sum(1/(rho_sem*rho_sem)) AS s0, sum(injected_power/(rho_sem*rho_sem)) AS s1, sum(injected_power*injected_power/(rho_sem*rho_sem)) AS s2, sum(rho_hat/(rho_sem*rho_sem)) AS t0, sum(injected_power*rho_hat/(rho_sem*rho_sem)) AS t1 FROM pt),
f AS (SELECT (s2*t0 - s1*t1)/(s0*s2-s1*s1) AS floor, (s0*t1 - s1*t0)/(s0*s2-s1*s1) AS gain, sqrt(s2/(s0*s2-s1*s1)) AS floor_err, sqrt(s0/(s0*s2-s1*s1)) AS gain_err FROM s),
l AS (SELECT regr_slope(log10(rho_hat-floor), log10(injected_power)) AS sl, count(*) AS n FROM pt, f WHERE injected_power*gain > 3*abs(floor) AND rho_hat > floor)
SELECT round(floor, 9) AS floor, round(gain, 12) AS gain, round(floor_err, 9) AS floor_err, round(gain_err, 12) AS gain_err, round(CASE WHEN n >= 2 THEN sl END, 6) AS log_slope FROM f, l""")
def recovery_fit(spark, d):
    out = T.recovery_fit(T.injection_points(_injected(spark, d), "amplitude", "rho"))
    return rounded(rounded(rounded(out, "floor", "floor_err"), "gain", "gain_err", digits=12), "log_slope", digits=6)


# ------------------------------------------------------------------ census
CLS = "CASE service_class WHEN 'full_service' THEN 'primary' WHEN 'translator' THEN 'non_primary' ELSE 'other' END"
RANKED = f""", ln AS (SELECT *, row_number() OVER (PARTITION BY rf_channel ORDER BY snr_db DESC, line_id) - 1 AS line_rank FROM lines),
cn AS (SELECT rf_channel, callsign, {CLS} AS cls, row_number() OVER (PARTITION BY rf_channel ORDER BY detectability_db DESC, distance_km) - 1 AS line_rank FROM census),
rec AS (SELECT ln.rf_channel, line_id, offset_hz, snr_db, ln.line_rank, coalesce(callsign, '') AS callsign,
 CASE WHEN callsign IS NULL THEN 'unassociated' WHEN ln.line_rank = 0 AND cls = 'primary' THEN 'dominant' ELSE 'ranked' END AS tier, coalesce(cls, 'unassociated') AS service_class FROM ln LEFT JOIN cn USING (rf_channel, line_rank))"""


def part_bound(spark, d):
    return max(row_bound(spark, d, "part"), row_bound(spark, d, "supplier"))


@query("service_class", with_(CENSUS) + f"SELECT callsign, {CLS} AS service_class FROM census")
def service_class(spark, d):
    return V.census(spark, d).select("callsign", keys.service_class(F.concat(F.lit(" "), F.replace("service_class", F.lit("_"), F.lit("-")))).alias("service_class"))


@query("census_within_radius", with_(CENSUS) + "SELECT * FROM census WHERE distance_km <= 60 + 1e-9")
def radius(spark, d):
    return S.within_radius(V.census(spark, d), 60.0)


@query("associate_lines_ranked", with_(CENSUS) + RANKED + "SELECT rf_channel, line_id, round(offset_hz, 6) AS offset_hz, snr_db, line_rank, callsign, tier, service_class FROM rec")
def associate(spark, d):
    return rounded(S.associate_lines(V.lines(spark, d), V.census(spark, d), max_rows=part_bound(spark, d)), "offset_hz", digits=6)


@query("associate_lines_dominant", with_(CENSUS) + RANKED + """
SELECT ln.rf_channel, line_id, round(offset_hz, 6) AS offset_hz, snr_db, ln.line_rank, CASE WHEN ln.line_rank = 0 THEN coalesce(callsign, '') ELSE '' END AS callsign,
 CASE WHEN callsign IS NULL THEN 'unassociated' WHEN ln.line_rank = 0 THEN 'dominant' ELSE 'pooled' END AS tier, CASE WHEN callsign IS NULL THEN 'unassociated' WHEN ln.line_rank = 0 THEN cls ELSE 'non_primary' END AS service_class
FROM ln LEFT JOIN (SELECT * FROM cn WHERE line_rank = 0) c0 ON c0.rf_channel = ln.rf_channel""")
def associate_dominant(spark, d):
    out = S.associate_lines(V.lines(spark, d), V.census(spark, d), "dominant_secondary", max_rows=part_bound(spark, d))
    return rounded(out, "offset_hz", digits=6)


@query("census_best_candidate", with_(CENSUS) + "SELECT rf_channel, callsign, service_class, detectability_db FROM census QUALIFY row_number() OVER (PARTITION BY rf_channel ORDER BY detectability_db DESC, distance_km) = 1")
def best_candidate(spark, d):
    return S.best_candidate(V.census(spark, d))


@query("absent_channels", with_(FRAMES, CENSUS) + """
, b AS (SELECT rf_channel AS physical_channel, callsign FROM census QUALIFY row_number() OVER (PARTITION BY rf_channel ORDER BY detectability_db DESC, distance_km) = 1),
p AS (SELECT physical_channel, count(*) AS n_frames FROM v GROUP BY 1)
SELECT physical_channel, coalesce(n_frames, 0) AS n_frames, callsign, CASE WHEN n_frames IS NULL THEN 'not scanned' ELSE 'scanned' END AS status FROM p FULL JOIN b USING (physical_channel)""")
def absent(spark, d):
    present = V.frames(spark, d).groupBy("physical_channel").agg(F.count(F.lit(1)).alias("n_frames"))
    return S.with_absent_channels(present, V.census(spark, d))


@query("offset_dispersion", with_(CENSUS) + RANKED + """
, m AS (SELECT rf_channel, quantile_cont(offset_hz, 0.5) AS m FROM rec GROUP BY 1)
SELECT rf_channel, count(*) AS n_lines, count(*) FILTER (service_class='unassociated') AS n_unassociated, round(1.4826::DOUBLE*quantile_cont(abs(offset_hz-m), 0.5), 6) AS mad_hz, round(sqrt(avg(offset_hz*offset_hz)), 6) AS rms_hz,
 round(max(offset_hz)-min(offset_hz), 6) AS span_hz, round(count(*) FILTER (service_class='non_primary')/nullif(count(*) FILTER (service_class<>'unassociated'), 0), 9) AS non_primary_fraction FROM rec JOIN m USING (rf_channel) GROUP BY 1""")
def dispersion(spark, d):
    rec = S.associate_lines(V.lines(spark, d), V.census(spark, d), max_rows=part_bound(spark, d))
    out = S.offset_dispersion(rec, max_rows=part_bound(spark, d))
    return rounded(rounded(out, "mad_hz", "rms_hz", "span_hz", digits=6), "non_primary_fraction")


@query("dispersion_by_threshold", with_(CENSUS) + """
, t AS (SELECT unnest([6.0::DOUBLE, 12.0, 24.0, 40.0]) AS t), j AS (SELECT rf_channel, t, offset_hz FROM lines, t WHERE snr_db >= t),
m AS (SELECT rf_channel, t, quantile_cont(offset_hz, 0.5) AS m FROM j GROUP BY 1, 2),
s AS (SELECT rf_channel, t, count(*) AS n, 1.4826::DOUBLE*quantile_cont(abs(offset_hz-m), 0.5) AS mad FROM j JOIN m USING (rf_channel, t) GROUP BY 1, 2),
a AS (SELECT DISTINCT rf_channel, t FROM lines, t)
SELECT rf_channel, t AS snr_threshold_db, coalesce(n, 0) AS n_lines, round(mad, 6) AS mad_hz FROM a LEFT JOIN s USING (rf_channel, t)""")
def dispersion_threshold(spark, d):
    out = S.dispersion_by_threshold(V.lines(spark, d), [6.0, 12.0, 24.0, 40.0], max_rows=part_bound(spark, d))
    return rounded(out, "mad_hz", digits=6)


@query("spearman_rank_correlation", with_(CENSUS) + """
, r AS (SELECT rank() OVER (ORDER BY offset_hz) + (count(*) OVER (PARTITION BY offset_hz) - 1)/2 AS rx, rank() OVER (ORDER BY snr_db) + (count(*) OVER (PARTITION BY snr_db) - 1)/2 AS ry FROM lines)
SELECT count(*) AS n, round(corr(rx, ry), 9) AS rho FROM r""")
def spearman(spark, d):
    return rounded(S.spearman(V.lines(spark, d), "offset_hz", "snr_db", max_rows=part_bound(spark, d)), "rho")


@query("spearman_bootstrap")
def spearman_bootstrap(spark, d):
    rec = S.associate_lines(V.lines(spark, d), V.census(spark, d), max_rows=part_bound(spark, d))
    return S.spearman_bootstrap(S.offset_dispersion(rec, max_rows=part_bound(spark, d)), "mad_hz", "rms_hz", 300)
