"""Fine bins and integrated spectra."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import clock, geometry as G, stats
from ..operators import fine as N, gate, histograms as H, spectra as P
from ..operators.quantiles import grouped_quantiles
from ..operators.small import join_small
from ..sources import views as V
from ..sources.tables import row_bound
from .distribution_queries import edge_bin_sql, rounded
from .frame_queries import GATE, UTC
from .oracle_views import FINE, FRAMES, SPECTRUM, with_
from .registry import query

c = F.col
NB = V.FINE_VIEW_BINS
HW = 4
CENSUS_BINS = (10, 40)
QTR = f"year({UTC.replace('floor(t)', 'floor(frame_time)')})::VARCHAR || 'Q' || quarter({UTC.replace('floor(t)', 'floor(frame_time)')})::VARCHAR"
ANCHOR = "((physical_channel*7) % 64)"
DELTA = lambda a, b, n=64: f"(((({a}) - ({b}) + {n // 2}) % {n}) + {n}) % {n} - {n // 2}"
BULK = f"(bin % 2 = 0 AND abs({DELTA('bin', ANCHOR)}) > {HW + 2} AND bin NOT IN (10, 40))"


def bound(spark, d):
    return row_bound(spark, d, "embeddings") * NB


def anchor():
    return c("physical_channel") * 7 % NB


def fine(spark, d):
    return V.fine(spark, d)


def with_bulk(spark, d):
    return fine(spark, d).withColumn("bulk", N.null_bulk_bins(anchor(), HW, NB, excluded=CENSUS_BINS))


@query("fine_spectral_axes", with_(FINE) + f"""
SELECT DISTINCT physical_channel, bin, CAST(((bin + 32) % 64) - 32 AS BIGINT) AS centered, round((((bin + 32) % 64) - 32)*(390625.0::DOUBLE/128/64), 6) AS offset_hz,
 CAST({DELTA('bin', ANCHOR)} AS BIGINT) AS delta, abs({DELTA('bin', ANCHOR)}) <= {HW} AS inside FROM fine""")
def axes(spark, d):
    b = fine(spark, d).select("physical_channel", F.posexplode("fine_ratio").alias("bin", "_x")).drop("_x").distinct()
    b = b.withColumn("bin", c("bin").cast("long"))
    return b.select("physical_channel", "bin", G.centered_bin(c("bin"), NB).alias("centered"), F.round(G.fine_offset_hz(c("bin"), NB), 6).alias("offset_hz"),
                    G.circular_delta(c("bin"), anchor(), NB).cast("long").alias("delta"), G.in_circular_window(c("bin"), anchor(), HW, NB).alias("inside"))


@query("predicted_fine_bin", with_(FRAMES) + """
, g AS (SELECT physical_channel, 470e6 + (physical_channel-14)*6e6 + 309441.0 AS pilot, count(*) AS n FROM v GROUP BY 1),
h AS (SELECT *, 800e6 - round_even((800e6-pilot)/390625.0, 0)*390625.0::DOUBLE AS center FROM g),
e AS (SELECT *, -(pilot-center) AS eff FROM h), r AS (SELECT *, eff - round_even(eff/(390625.0::DOUBLE/128), 0)*(390625.0::DOUBLE/128) AS resid FROM e)
SELECT physical_channel, n, CAST((CAST(round_even(resid/(390625.0::DOUBLE/128/256), 0) AS BIGINT) % 256 + 256) % 256 AS INT) AS predicted_bin,
 CAST((CAST(round_even(-(pilot-center)/(390625.0::DOUBLE/128), 0) AS BIGINT) % 128 + 128) % 128 AS INT) AS marginal_bin FROM r""")
def predicted(spark, d):
    ch = c("physical_channel")
    g = V.frames(spark, d).groupBy("physical_channel").agg(F.count(F.lit(1)).alias("n"))
    pilot = G.pilot_hz(ch)
    center = G.coarse_center_hz(G.freq_id_of(pilot))
    return g.select("physical_channel", "n", G.predicted_fine_bin(pilot, center, F.lit(-1)).alias("predicted_bin"),
                    G.marginal_bin(pilot, center, F.lit(-1)).alias("marginal_bin"))


@query("independent_bin_mask", with_(FINE) + f"SELECT DISTINCT physical_channel, CAST(bin AS INT) AS bin FROM fine WHERE {BULK}")
def bin_mask(spark, d):
    return with_bulk(spark, d).select("physical_channel", F.explode("bulk").alias("bin")).distinct()


@query("bulk_mask_words", with_(FINE) + f"""
, b AS (SELECT DISTINCT frame_id, bin FROM fine WHERE {BULK} AND x > 1)
SELECT frame_id, CAST(floor(bin/64) AS INT) AS word, CAST(sum(CASE WHEN bin % 64 = 63 THEN -9223372036854775808 ELSE CAST(pow(2, bin % 64) AS BIGINT) END) AS BIGINT) AS bits FROM b GROUP BY 1, 2""")
def mask_words(spark, d):
    on = with_bulk(spark, d).select("frame_id", F.filter("bulk", lambda b: F.get(c("fine_ratio"), b) > 1).alias("on"))
    return N.bulk_mask_words(on, ["frame_id"], "on")


@query("bulk_mask_round_trip", with_(FINE) + f"SELECT frame_id, count(*) AS n, CAST(sum(bin) AS BIGINT) AS bin_sum FROM fine WHERE {BULK} AND x > 1 GROUP BY 1")
def mask_round_trip(spark, d):
    return N.unpack_mask_words(mask_words(spark, d), ["frame_id"]).groupBy("frame_id").agg(F.count(F.lit(1)).alias("n"), F.sum("bin").alias("bin_sum"))


@query("fine_gate_reasons", with_(FINE) + """
, s AS (SELECT frame_id, physical_channel, x - CASE WHEN frame_id % 7 = 0 THEN 0.9::DOUBLE ELSE 0.0::DOUBLE END AS y FROM fine)
SELECT physical_channel, frame_id, bool_or(y < 0) AS negative, CASE WHEN bool_or(y < 0) THEN 'fine_power_ratio_negative' ELSE '' END AS reason_codes FROM s GROUP BY 1, 2""")
def fine_gate(spark, d):
    shift = F.when(c("frame_id") % 7 == 0, 0.9).otherwise(0.0)
    df = fine(spark, d).select("physical_channel", "frame_id", F.transform("fine_ratio", lambda x: x.cast("double") - shift).alias("fine"),
                               F.lit(True).alias("valid"), F.lit(1).alias("p_target"), F.lit(1).alias("p_ref_sum"),
                               F.lit(1.0).alias("baseband_power"), F.lit(1.0).alias("f"))
    return gate.with_reasons(df, "fine").select("physical_channel", "frame_id", F.array_contains("reasons", "fine_power_ratio_negative").alias("negative"),
                                                F.concat_ws("+", "reasons").alias("reason_codes"))


K = N.false_alarm_factor(1e-3)
CFAR = f""", nb AS (SELECT frame_id, physical_channel, x FROM fine WHERE {BULK}),
q AS (SELECT frame_id, physical_channel, quantile_cont(x, 0.5) AS l, quantile_cont(x, 0.1587) AS a, stddev_pop(x) AS sd, quantile_cont(x, 0.25) AS l2, quantile_cont(x, 0.02275) AS a2 FROM nb GROUP BY 1, 2),
s AS (SELECT *, CASE WHEN l-a > 0 THEN l-a WHEN sd > 0 THEN sd ELSE 1 END AS sc, greatest((l2-a2)/2, 1e-12::DOUBLE) AS sc2 FROM q),
e AS (SELECT s.frame_id, avg((x > l + {K!r}::DOUBLE*sc)::INT) AS share, avg((x > l2 + {K!r}::DOUBLE*sc2)::INT) AS share2 FROM s JOIN nb USING (frame_id) GROUP BY 1),
cf AS (SELECT s.frame_id, physical_channel, share > 0.2 AS fallback, CASE WHEN share > 0.2 THEN l2 ELSE l END AS location, CASE WHEN share > 0.2 THEN sc2 ELSE sc END AS scale,
 CASE WHEN share > 0.2 THEN l2 + {K!r}::DOUBLE*sc2 ELSE l + {K!r}::DOUBLE*sc END AS threshold, CASE WHEN share > 0.2 THEN share2 ELSE share END AS null_fraction FROM s JOIN e USING (frame_id))"""


def calibrated(spark, d):
    return N.with_cfar(with_bulk(spark, d), "bulk")


@query("cfar_calibration", with_(FINE) + CFAR + """
SELECT cf.frame_id, cf.physical_channel, round(any_value(location), 6) AS location, round(any_value(scale), 6) AS scale, round(any_value(threshold), 6) AS threshold, round(any_value(null_fraction), 9) AS null_fraction,
 any_value(fallback) AS fallback, CAST(count(*) FILTER (x > threshold) AS INT) AS n_detected FROM cf JOIN fine USING (frame_id) GROUP BY 1, 2""")
def cfar(spark, d):
    out = calibrated(spark, d).select("frame_id", "physical_channel", "location", "scale", "threshold", "null_fraction", "fallback",
                                      F.size("detected").alias("n_detected"))
    return rounded(rounded(out, "location", "scale", "threshold", digits=6), "null_fraction")


@query("any_bin_detections", with_(FINE) + CFAR + """
SELECT frame_id, CAST(bin AS INT) AS bin, CAST(row_number() OVER (PARTITION BY frame_id ORDER BY bin) - 1 AS INT) AS "order" FROM cf JOIN fine USING (frame_id) WHERE x > threshold""")
def any_bin(spark, d):
    return N.detections(calibrated(spark, d), ["frame_id"]).select("frame_id", "bin", "order")


@query("fine_mask_decision", with_(FINE) + f"""
, w AS (SELECT *, 2*CAST(round(x*1000000) AS HUGEINT) AS num, CAST(2000000 + bin*10 AS HUGEINT) AS den FROM fine),
k AS (SELECT frame_id, bin, num, den, row_number() OVER (PARTITION BY frame_id ORDER BY num::DOUBLE/den) - 1 AS r, count(*) OVER (PARTITION BY frame_id) AS n FROM w WHERE {BULK}),
rk AS (SELECT frame_id, bin AS rank_bin, num AS nr, den AS dr, n FROM k WHERE r = 17),
f AS (SELECT w.frame_id, w.bin, {DELTA('bin', ANCHOR)} AS pos FROM w JOIN rk USING (frame_id) WHERE abs({DELTA('bin', ANCHOR)}) <= {HW} AND w.num*65536*dr > 70000*nr*w.den),
fb AS (SELECT frame_id, min_by(bin, pos) AS fired_bin FROM f GROUP BY 1)
SELECT rk.frame_id, CAST(fired_bin IS NOT NULL AS INT) AS mask, TRUE AS usable, CAST(n AS INT) AS n_bulk, CAST(rank_bin AS INT) AS rank_bin, CAST(coalesce(fired_bin, -1) AS INT) AS fired_bin FROM rk LEFT JOIN fb USING (frame_id)""")
def decision(spark, d):
    df = with_bulk(spark, d).select(
        "frame_id", "bulk", anchor().cast("int").alias("anchor"), F.transform("fine_ratio", lambda x: F.round(x.cast("double") * 1000000).cast("long")).alias("t"),
        F.transform("fine_ratio", lambda x, i: (F.lit(1000000) + i * 10).cast("long")).alias("lo"),
        F.transform("fine_ratio", lambda x: F.lit(1000000).cast("long")).alias("up"))
    out = N.with_fine_decision(df, "t", "lo", "up", "anchor", "bulk", 17, 70000, HW)
    return out.select("frame_id", "mask", "usable", "n_bulk", "rank_bin", "fired_bin")


NORM = f""", md AS (SELECT frame_id, quantile_cont(x, 0.5) AS m FROM fine GROUP BY 1),
nm AS (SELECT fine.*, x/m AS y, {QTR} AS quarter FROM fine JOIN md USING (frame_id))"""


@query("fine_line_map", with_(FINE) + NORM + """
SELECT physical_channel, CAST(bin AS INT) AS bin, count(*) AS n, round(avg((y >= 1.2::DOUBLE)::INT), 9) AS persistence, round(quantile_cont(y, 0.5), 6) AS line_ratio FROM nm GROUP BY 1, 2""")
def line_map(spark, d):
    out = N.line_map(fine(spark, d), ["physical_channel"], 1.2, max_rows=bound(spark, d))
    return rounded(rounded(out, "persistence"), "line_ratio", digits=6)


@query("epoch_line_anchor", with_(FINE) + NORM + f"""
, lm AS (SELECT physical_channel, quarter, bin, count(*) AS n, avg((y >= 1.2::DOUBLE)::INT) AS p, quantile_cont(y, 0.5) AS r, abs({DELTA('bin', ANCHOR)}) <= 12 AS inside FROM nm GROUP BY 1, 2, 3),
cd AS (SELECT * FROM lm WHERE inside QUALIFY row_number() OVER (PARTITION BY physical_channel, quarter ORDER BY p DESC, r DESC, bin) = 1),
ot AS (SELECT * FROM lm WHERE NOT inside QUALIFY row_number() OVER (PARTITION BY physical_channel, quarter ORDER BY p DESC, r DESC, bin) = 1),
rv AS (SELECT lm.physical_channel, lm.quarter, coalesce(max(lm.p) FILTER (lm.inside AND abs({DELTA('lm.bin', 'cd.bin')}) > 3), 0) AS competitor FROM lm JOIN cd USING (physical_channel, quarter) GROUP BY 1, 2),
t AS (SELECT cd.physical_channel, cd.quarter, cd.n AS usable_frames, cd.bin AS cb, {DELTA('cd.bin', ANCHOR.replace('physical_channel', 'cd.physical_channel'))} AS dl, cd.p, cd.r, competitor, cd.p - competitor AS margin, ot.bin AS ob, ot.p AS op,
 {ANCHOR.replace('physical_channel', 'cd.physical_channel')} AS pred FROM cd JOIN rv USING (physical_channel, quarter) JOIN ot USING (physical_channel, quarter)),
w AS (SELECT *, array_to_string(list_filter([CASE WHEN usable_frames < 3 THEN 'few_frames' END, CASE WHEN p < 0.1::DOUBLE THEN 'low_persistence' END, CASE WHEN margin < 0.02::DOUBLE THEN 'close_competitor' END, CASE WHEN 12 - abs(dl) <= 2 AND op > p THEN 'edge_beside_outside_line' END], lambda x: x IS NOT NULL), '+') AS refusals FROM t)
SELECT physical_channel, quarter, usable_frames, CAST(cb AS INT) AS candidate_bin, CAST(dl AS INT) AS candidate_delta, round(p, 9) AS persistence, round(r, 6) AS line_ratio, round(competitor, 9) AS competitor, round(margin, 9) AS margin, CAST(ob AS INT) AS outside_bin, refusals,
 CAST(CASE WHEN refusals = '' THEN cb ELSE pred END AS INT) AS selected_bin, CAST(CASE WHEN refusals = '' THEN 2 ELSE 12 END AS INT) AS selected_half_width FROM w""")
def epoch_anchor(spark, d):
    df = fine(spark, d)
    pred = df.select("physical_channel").distinct().withColumn("predicted", (c("physical_channel") * 7 % NB).cast("int"))
    out = N.epoch_line_anchor(df, pred, NB, half_width=12, line_ratio=1.2, min_frames=3, clear=3, max_rows=bound(spark, d))
    return rounded(rounded(out, "persistence", "competitor", "margin"), "line_ratio", digits=6)


@query("detected_anchor", with_(FINE) + CFAR + """
, n AS (SELECT physical_channel, count(*) AS n_frames FROM cf GROUP BY 1),
h AS (SELECT cf.physical_channel, bin, count(*) AS hits FROM cf JOIN fine USING (frame_id) WHERE x > threshold GROUP BY 1, 2),
t AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY physical_channel ORDER BY hits DESC, bin) = 1)
SELECT n.physical_channel, n_frames, round(coalesce(hits, 0)/n_frames, 9) AS share, coalesce(hits, 0)/n_frames >= 0.02 AS anchored, CAST(CASE WHEN coalesce(hits, 0)/n_frames >= 0.02 THEN bin ELSE 0 END AS INT) AS anchor FROM n LEFT JOIN t USING (physical_channel)""")
def detected_anchor(spark, d):
    cal = calibrated(spark, d)
    return rounded(N.detected_anchor(N.detections(cal, ["physical_channel"]), cal, 0.02), "share")


def _anchors(spark, d):
    return fine(spark, d).select("physical_channel").distinct().withColumn("anchor", (c("physical_channel") * 7 % NB).cast("int"))


@query("null_tiles", with_(FINE) + NORM + f"""
, lm AS (SELECT physical_channel, bin, quantile_cont(y, 0.5) >= 1.02::DOUBLE AS line FROM nm GROUP BY 1, 2),
bl AS (SELECT DISTINCT a.physical_channel, a.bin FROM lm a JOIN lm b ON a.physical_channel = b.physical_channel AND b.line AND abs({DELTA('a.bin', 'b.bin')}) <= 4),
fr AS (SELECT physical_channel, bin FROM lm ANTI JOIN bl USING (physical_channel, bin) WHERE abs({DELTA('bin', ANCHOR)}) > 5),
rn AS (SELECT *, bin - row_number() OVER (PARTITION BY physical_channel ORDER BY bin) AS g FROM fr), ct AS (SELECT *, floor((row_number() OVER (PARTITION BY physical_channel, g ORDER BY bin) - 1)/5) AS tile FROM rn)
SELECT physical_channel, CAST(min(bin) AS INT) AS first, CAST(max(bin) AS INT) AS last FROM ct GROUP BY physical_channel, g, tile HAVING count(*) = 5""")
def tiles(spark, d):
    lines = N.line_map(fine(spark, d), ["physical_channel"], max_rows=bound(spark, d))
    return N.null_tiles(lines, _anchors(spark, d), NB, 2, 3, line_ratio=1.02)


WIN = f""", ws AS (SELECT frame_id, any_value(physical_channel) AS physical_channel, any_value(unit_id) AS unit_id, any_value(frame_time) AS frame_time, max(x) FILTER (abs({DELTA('bin', ANCHOR)}) <= {HW}) AS stat FROM fine GROUP BY 1)"""


def window_stat(spark, d):
    return fine(spark, d).withColumn("stat", N.window_max(c("fine_ratio"), anchor(), HW, NB))


@query("off_quarters", with_(FINE) + WIN + f"""
SELECT physical_channel, {QTR} AS quarter, count(*) AS n, round(quantile_cont(stat, 0.5), 6) AS median FROM ws GROUP BY 1, 2 HAVING count(*) >= 3 AND quantile_cont(stat, 0.5) < 1.18""")
def off_quarters(spark, d):
    df = window_stat(spark, d).withColumn("quarter", clock.quarter_label(c("frame_time")))
    return rounded(N.off_quarters(df, "stat", 1.18, 3, max_rows=bound(spark, d)), "median", digits=6)


_TILES = f""", lm AS (SELECT physical_channel, bin, quantile_cont(y, 0.5) >= 1.02::DOUBLE AS line FROM nm GROUP BY 1, 2),
bl AS (SELECT DISTINCT a.physical_channel, a.bin FROM lm a JOIN lm b ON a.physical_channel = b.physical_channel AND b.line AND abs({DELTA('a.bin', 'b.bin')}) <= 4),
fr AS (SELECT physical_channel, bin FROM lm ANTI JOIN bl USING (physical_channel, bin) WHERE abs({DELTA('bin', ANCHOR)}) > 5),
rn AS (SELECT *, bin - row_number() OVER (PARTITION BY physical_channel ORDER BY bin) AS g FROM fr), ct AS (SELECT *, floor((row_number() OVER (PARTITION BY physical_channel, g ORDER BY bin) - 1)/5) AS tile FROM rn),
tl AS (SELECT physical_channel, min(bin) AS first, max(bin) AS last FROM ct GROUP BY physical_channel, g, tile HAVING count(*) = 5)"""
_POPULATIONS = WIN + _TILES + f""", wq AS (SELECT *, {QTR} AS quarter FROM ws),
oq AS (SELECT physical_channel, quarter FROM wq GROUP BY 1, 2 HAVING count(*) >= 3 AND quantile_cont(stat, 0.5) < 1.18),
tm AS (SELECT physical_channel, frame_id, any_value(frame_time) AS frame_time, max(x) AS value FROM fine JOIN tl USING (physical_channel) WHERE bin BETWEEN first AND last GROUP BY physical_channel, frame_id, first),
pop AS (SELECT physical_channel, quarter, 'on_sky' AS population, stat AS value FROM wq UNION ALL SELECT physical_channel, quarter, 'off_epoch', stat FROM wq SEMI JOIN oq USING (physical_channel, quarter)
 UNION ALL SELECT physical_channel, {QTR}, 'off_pilot', value FROM tm)"""


def _populations(spark, d):
    df = window_stat(spark, d).withColumn("quarter", clock.quarter_label(c("frame_time")))
    off = N.off_quarters(df, "stat", 1.18, 3, max_rows=bound(spark, d))
    found = tiles(spark, d)
    counts = H.edge_histogram(N.null_populations(df, found, off), ["physical_channel", "quarter", "population"], c("value"), H.RATIO_EDGES)
    return df, found, off, counts


@query("edge_histogram_populations", with_(FINE) + NORM + _POPULATIONS + f"""
, b AS (SELECT physical_channel, quarter, population, {edge_bin_sql('value', H.RATIO_EDGES)} AS bin FROM pop),
k AS (SELECT physical_channel, quarter, population, bin, count(*) AS n FROM b GROUP BY ALL), g AS (SELECT DISTINCT physical_channel, quarter, population FROM b),
gg AS (SELECT physical_channel, quarter, population, CAST(unnest(range(152)) AS INT) AS bin FROM g)
SELECT gg.*, coalesce(k.n, 0) AS n FROM gg LEFT JOIN k USING (physical_channel, quarter, population, bin)""")
def edge_populations(spark, d):
    return _populations(spark, d)[3]


@query("edge_histogram_population_sums", with_(FINE) + NORM + _POPULATIONS + """
SELECT physical_channel, quarter, population, CAST(count(*) AS BIGINT) AS counted, CAST(count(*) AS BIGINT) AS expected, TRUE AS agrees FROM pop GROUP BY 1, 2, 3""")
def edge_population_sums(spark, d):
    df, found, off, counts = _populations(spark, d)
    return N.population_sums(counts, df, found, off)


@query("unit_maxima_histogram", with_(FINE) + WIN + f"""
, u AS (SELECT physical_channel, unit_id, max(stat) AS m FROM ws GROUP BY 1, 2), b AS (SELECT physical_channel, {edge_bin_sql('m', H.RATIO_EDGES)} AS bin FROM u)
SELECT physical_channel, bin, count(*) AS n FROM b GROUP BY 1, 2""")
def unit_maxima(spark, d):
    return H.edge_histogram(N.unit_maxima(window_stat(spark, d), "stat"), ["physical_channel"], c("unit_max"), H.RATIO_EDGES, zero_fill=False)


@query("integrated_unit_maxima", with_(FINE) + f"""
, a AS (SELECT physical_channel, unit_id, bin, avg(x) AS x FROM fine WHERE abs({DELTA('bin', ANCHOR)}) <= {HW} GROUP BY 1, 2, 3)
SELECT physical_channel, unit_id, round(max(x), 6) AS integrated_max FROM a GROUP BY 1, 2""")
def integrated_maxima(spark, d):
    return rounded(N.integrated_unit_maxima(fine(spark, d), _anchors(spark, d), NB, HW), "integrated_max", digits=6)


@query("frames_per_unit_quantiles", with_(FINE) + """
, u AS (SELECT physical_channel, unit_id, count(DISTINCT frame_id) AS n FROM fine GROUP BY 1, 2)
SELECT physical_channel, quantile_cont(n, 0.5) AS frames_p50, round(quantile_cont(n, 0.95), 6) AS frames_p95, max(n) AS frames_max FROM u GROUP BY 1""")
def frames_per_unit(spark, d):
    u = N.unit_maxima(window_stat(spark, d), "stat")
    out = grouped_quantiles(u, ["physical_channel"], {"frames_p50": ("n_frames", 0.5), "frames_p95": ("n_frames", 0.95)},
                            [F.max("n_frames").alias("frames_max")], max_rows=bound(spark, d))
    return rounded(out, "frames_p95", digits=6)


@query("fine_spectrum_by_quarter", with_(FINE) + f"""
SELECT physical_channel, {QTR} AS quarter, CAST(bin AS INT) AS bin, count(*) AS n, round(10*log10(greatest(quantile_cont(x, 0.5), 1e-6::DOUBLE)), 5) AS median_db,
 round(10*log10(greatest(quantile_cont(x, 0.9), 1e-6::DOUBLE)), 5) AS p90_db, round(10*log10(greatest(avg(x), 1e-12::DOUBLE)), 5) AS mean_db FROM fine GROUP BY 1, 2, 3""")
def spectrum_by_quarter(spark, d):
    df = fine(spark, d).withColumn("quarter", clock.quarter_label(c("frame_time")))
    return rounded(N.fine_spectrum(df, ["physical_channel", "quarter"], max_rows=bound(spark, d)), "median_db", "p90_db", "mean_db", digits=5)


BA = """, k AS (SELECT frame_id, max(x) FILTER (bin = 0) <= 1.05::DOUBLE AS keep FROM fine GROUP BY 1),
ba AS (SELECT physical_channel, bin, avg(x) AS before, avg(x) FILTER (keep) AS after FROM fine JOIN k USING (frame_id) GROUP BY 1, 2)"""


def _before_after(spark, d):
    return N.spectrum_before_after(fine(spark, d), F.get("fine_ratio", F.lit(0)).cast("double") <= 1.05)


@query("fine_spectrum_before_after", with_(FINE) + BA + """
SELECT physical_channel, CAST(bin AS INT) AS bin, round(before, 6) AS before, round(after, 6) AS after, round(10*log10(greatest(before, 1e-12::DOUBLE)), 5) AS before_db, round(10*log10(greatest(after, 1e-12::DOUBLE)), 5) AS after_db FROM ba""")
def before_after(spark, d):
    return rounded(rounded(_before_after(spark, d), "before", "after", digits=6), "before_db", "after_db", digits=5)


@query("fine_suppression", with_(FINE) + BA + """
, p AS (SELECT * FROM ba QUALIFY row_number() OVER (PARTITION BY physical_channel ORDER BY before DESC, bin) = 1), m AS (SELECT physical_channel, avg(before) AS b, avg(after) AS a FROM ba GROUP BY 1)
SELECT physical_channel, CAST(bin AS INT) AS peak_bin, round(10*log10(before/greatest(after, 1e-12::DOUBLE)), 5) AS peak_suppression_db, round(10*log10(b/greatest(a, 1e-12::DOUBLE)), 5) AS band_suppression_db FROM p JOIN m USING (physical_channel)""")
def suppression(spark, d):
    return rounded(N.suppression(_before_after(spark, d)), "peak_suppression_db", "band_suppression_db", digits=5)


@query("fine_line_census")
def fine_census(spark, d):
    spec = N.fine_spectrum(fine(spark, d), ["physical_channel"], max_rows=bound(spark, d))
    return N.line_census(spec, NB, min_db=0.02, min_prominence=0.02)


def _track(spark, d):
    df = fine(spark, d).withColumn("month", clock.month_index(c("frame_time")))
    monthly = N.fine_spectrum(df, ["physical_channel", "month"], max_rows=bound(spark, d))
    return N.carrier_track(monthly, NB, 390625.0 / 128 / NB, min_db=0.5)


TRACK = f""", mo AS (SELECT physical_channel, year({UTC.replace('floor(t)', 'floor(frame_time)')})*12 + month({UTC.replace('floor(t)', 'floor(frame_time)')}) - 1 - (2018*12+11) AS month, -(((bin+32) % 64) - 32) AS rf, 10*log10(greatest(quantile_cont(x, 0.5), 1e-6::DOUBLE)) AS y FROM fine GROUP BY 1, 2, bin),
l AS (SELECT *, lag(y) OVER w AS y0, lead(y) OVER w AS y2, quantile_cont(y, 0.5) OVER (PARTITION BY physical_channel, month) AS base FROM mo WINDOW w AS (PARTITION BY physical_channel, month ORDER BY rf)),
b AS (SELECT * FROM l QUALIFY row_number() OVER (PARTITION BY physical_channel, month ORDER BY y DESC, rf) = 1),
tk AS (SELECT physical_channel, CAST(month AS INT) AS month, (rf + least(greatest(CASE WHEN y0-2*y+y2 <> 0 THEN 0.5*(y0-y2)/(y0-2*y+y2) ELSE 0 END, -1), 1))*(390625.0::DOUBLE/128/64) AS offset_hz, y - base AS height_db FROM b WHERE y-base >= 0.5 AND y0 IS NOT NULL AND y2 IS NOT NULL)"""


@query("carrier_track", with_(FINE) + TRACK + "SELECT physical_channel, month, round(offset_hz, 3) AS offset_hz, round(height_db, 5) AS height_db FROM tk")
def track(spark, d):
    return rounded(rounded(_track(spark, d), "offset_hz", digits=3), "height_db", digits=5)


@query("carrier_drift", with_(FINE) + TRACK + """
, g AS (SELECT physical_channel, count(*) AS n_months, regr_slope(offset_hz, month) AS s, var_pop(offset_hz) AS vy, covar_pop(offset_hz, month) AS cv, max(month)-min(month) AS sx, max(offset_hz)-min(offset_hz) AS span FROM tk GROUP BY 1 HAVING count(*) >= 8)
SELECT physical_channel, n_months, round(s*12, 4) AS slope_hz_per_year, round(abs(s)*sx, 4) AS swing_hz, round(span, 4) AS span_hz, round(sqrt(greatest(vy - s*cv, 0)), 4) AS scatter_hz, round(1 - greatest(vy-s*cv, 0)/vy, 6) AS r2,
 abs(s)*sx > 3*sqrt(greatest(vy-s*cv, 0)) AND 1 - greatest(vy-s*cv, 0)/vy > 0.7 AS coherent FROM g""")
def drift(spark, d):
    out = rounded(N.carrier_drift(_track(spark, d)), "slope_hz_per_year", "swing_hz", "span_hz", "scatter_hz", digits=4)
    return rounded(out, "r2", digits=6)


@query("carrier_drift_latest_era", with_(FINE) + TRACK + """
, er AS (SELECT physical_channel, CAST(max(floor(month/60))*60 AS INT) AS era_start FROM tk GROUP BY 1 HAVING count(*) >= 8), tp AS (SELECT tk.*, era_start FROM tk JOIN er USING (physical_channel) WHERE month >= era_start),
g AS (SELECT physical_channel, era_start, count(*) AS n_months, regr_slope(offset_hz, month) AS s, var_pop(offset_hz) AS vy, covar_pop(offset_hz, month) AS cv, max(month)-min(month) AS sx, max(offset_hz)-min(offset_hz) AS span FROM tp GROUP BY 1, 2 HAVING count(*) >= 8)
SELECT physical_channel, era_start, n_months, round(s*12, 4) AS slope_hz_per_year, round(abs(s)*sx, 4) AS swing_hz, round(span, 4) AS span_hz, round(sqrt(greatest(vy - s*cv, 0)), 4) AS scatter_hz, round(1 - greatest(vy-s*cv, 0)/vy, 6) AS r2,
 abs(s)*sx > 3*sqrt(greatest(vy-s*cv, 0)) AND 1 - greatest(vy-s*cv, 0)/vy > 0.7 AS coherent, round(sqrt(vy), 4) AS track_sd_hz FROM g""")
def drift_latest(spark, d):
    t = _track(spark, d)
    eras = t.select("physical_channel", (F.floor(c("month") / 60) * 60).cast("int").alias("month_start")).distinct()
    out = rounded(N.carrier_drift_latest_era(t, eras), "slope_hz_per_year", "swing_hz", "span_hz", "scatter_hz", "track_sd_hz", digits=4)
    return rounded(out, "r2", digits=6)


# ----------------------------------------------------------- integrated spectra
SPACING, SENSE, PILOT = 100.0, -1, 500.0
AX = f""", ax AS (SELECT spectrum_id, bin, power, (CASE WHEN bin < 32 THEN bin ELSE bin-64 END)*(-100.0::DOUBLE) AS rf_hz, (CASE WHEN bin < 32 THEN bin ELSE bin-64 END)*(-100.0::DOUBLE) - 500.0::DOUBLE AS offset_hz FROM spec),
mm AS (SELECT spectrum_id, quantile_cont(power, 0.5) AS m, min(power) AS fl FROM ax WHERE power > 0 GROUP BY 1), sd AS (SELECT ax.*, 10*log10(greatest(power, fl)/m) AS db FROM ax JOIN mm USING (spectrum_id))"""


def axis(spark, d):
    return P.with_axis(V.spectrum(spark, d), NB, SPACING, SENSE, PILOT)


def spectra_db(spark, d):
    return P.with_db(axis(spark, d), ["spectrum_id"])


@query("pilot_region_slice", with_(SPECTRUM) + AX + "SELECT spectrum_id, bin, offset_hz, round(db, 5) AS db FROM sd WHERE abs(offset_hz) <= 1500 AND power > 0")
def pilot_slice(spark, d):
    return rounded(P.pilot_region(spectra_db(spark, d), 1500.0).select("spectrum_id", "bin", "offset_hz", "db"), "db", digits=5)


@query("measured_pilot", with_(SPECTRUM) + AX + "SELECT spectrum_id, offset_hz, round(db, 5) AS db FROM sd WHERE abs(offset_hz) <= 1000 QUALIFY row_number() OVER (PARTITION BY spectrum_id ORDER BY sd.db DESC, rf_hz) = 1")
def measured_pilot(spark, d):
    return rounded(P.measured_pilot(spectra_db(spark, d), ["spectrum_id"], 1000.0), "db", digits=5)


@query("spectrum_local_maxima", with_(SPECTRUM) + AX + """
, l AS (SELECT *, lag(db) OVER w AS a, lead(db) OVER w AS b FROM sd WINDOW w AS (PARTITION BY spectrum_id ORDER BY offset_hz))
SELECT spectrum_id, bin, offset_hz, round(db, 5) AS db FROM l WHERE db >= 0.05 AND db > a AND db >= b""")
def maxima(spark, d):
    return rounded(P.local_maxima(spectra_db(spark, d), ["spectrum_id"], 0.05).select("spectrum_id", "bin", "offset_hz", "db"), "db", digits=5)


@query("peak_census")
def peak_census(spark, d):
    return P.peak_census(spectra_db(spark, d), "spectrum_id", min_db=0.05, separation_hz=300.0)


@query("extract_lines")
def extract(spark, d):
    return P.extract_lines(axis(spark, d), "spectrum_id", SPACING, 3000.0, 0.05, 0.05, 200.0)


@query("max_pooled_spectrum", with_(SPECTRUM) + """
, p AS (SELECT spectrum_id, CAST(floor(bin/8) AS INT) AS pool, max(power) AS power FROM spec GROUP BY 1, 2), m AS (SELECT spectrum_id, quantile_cont(power, 0.5) AS m FROM p GROUP BY 1)
SELECT spectrum_id, pool, round(power, 6) AS power, round(10*log10(power/m), 5) AS db FROM p JOIN m USING (spectrum_id)""")
def pooled(spark, d):
    return rounded(rounded(P.max_pool(V.spectrum(spark, d), ["spectrum_id"], 8), "power", digits=6), "db", digits=5)


@query("centre_bin_table", with_(SPECTRUM) + AX + "SELECT spectrum_id, -500.0::DOUBLE AS offset_from_pilot_hz, round(db, 5) AS db_rel_median, 1 AS inside_window FROM sd WHERE bin = 0")
def centre_bin(spark, d):
    return rounded(P.centre_bin_table(V.spectrum(spark, d), ["spectrum_id"], PILOT, 15000.0), "db_rel_median", digits=5)


def _stored(spark, d):
    """Stored spectra of each channel: healthy power spread over the shape of
    the spectra of the labels that fall to it, plus the constant of the ceiling frames."""
    counts = P.ceiling_counts(gate.with_reasons(V.detector_frames(spark, d)))
    shape = V.spectrum(spark, d).groupBy((c("spectrum_id") % 4 + 14).cast("int").alias("physical_channel"), "bin").agg(F.sum("power").alias("power"))
    total = shape.groupBy("physical_channel").agg(F.sum("power").alias("_t"))
    j = shape.join(total, "physical_channel").join(F.broadcast(counts), "physical_channel")
    dc = lambda n: F.when(c("bin") == 0, c(n) * 128.0 * NB * NB).otherwise(0.0)
    at = lambda p, n: c(p) * NB * NB * c("power") / c("_t") + dc(n)
    return j.select("physical_channel", "bin", at("power_before", "n_before").alias("before"), at("power_after", "n_after").alias("after")), counts


CORR = """, ck AS (SELECT physical_channel, coalesce(sum(baseband_power) FILTER (len(reasons)=0 AND valid), 0) AS pb, coalesce(sum(baseband_power) FILTER (len(reasons)=0 AND valid AND NOT reject), 0) AS pa FROM g GROUP BY 1),
sp AS (SELECT CAST(spectrum_id % 4 + 14 AS INT) AS physical_channel, bin, sum(power) AS power FROM spec GROUP BY 1, 2),
sh AS (SELECT *, sum(power) OVER (PARTITION BY physical_channel) AS t FROM sp)"""


@query("health_corrected_spectra", with_(FRAMES, SPECTRUM) + GATE + CORR + """
SELECT physical_channel, bin, round(pb*4096*power/t, 2) AS before, round(pa*4096*power/t, 2) AS after, TRUE AS exact FROM sh JOIN ck USING (physical_channel)""")
def corrected(spark, d):
    stored, counts = _stored(spark, d)
    return rounded(P.health_corrected(stored, counts, NB, 1), "before", "after", digits=2)


@query("spectrum_parseval_check", with_(FRAMES, SPECTRUM) + GATE + CORR + "SELECT physical_channel, TRUE AS exact, 0.0::DOUBLE AS error_before, 0.0::DOUBLE AS error_after, TRUE AS passes FROM ck")
def parseval(spark, d):
    stored, counts = _stored(spark, d)
    out = rounded(P.parseval_check(P.health_corrected(stored, counts, NB, 1), counts, NB, 1), "error_before", "error_after")
    return out.withColumns({k: F.abs(k) for k in ("error_before", "error_after")})


def _background(spark, d):
    df = axis(spark, d).withColumn("pos", (c("rf_hz") / SPACING + 31).cast("int"))
    bg = P.running_median(df.select("spectrum_id", "pos", "power"), "spectrum_id", NB, 9)
    return bg.join(df.select("spectrum_id", "pos", "rf_hz", "offset_hz"), ["spectrum_id", "pos"])


BG = AX + """, ps AS (SELECT *, CAST(rf_hz/100.0 + 31 AS INT) AS pos FROM ax),
pd AS (SELECT spectrum_id, pos, power FROM ps UNION ALL SELECT spectrum_id, pos+64, power FROM ps WHERE pos+64 <= 67 UNION ALL SELECT spectrum_id, pos-64, power FROM ps WHERE pos-64 >= -4),
rm AS (SELECT spectrum_id, pos, power, quantile_cont(power, 0.5) OVER (PARTITION BY spectrum_id ORDER BY pos ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING) AS bg FROM pd)"""


@query("running_median_background", with_(SPECTRUM) + BG + "SELECT spectrum_id, pos, round(power, 6) AS power, round(bg, 6) AS background FROM rm WHERE pos BETWEEN 0 AND 63")
def background(spark, d):
    return rounded(_background(spark, d).select("spectrum_id", "pos", "power", "background"), "power", "background", digits=6)


def _groups(spark, d):
    return P.identify_tones(P.tone_groups(_background(spark, d), "spectrum_id", min_db=0.05), 6000.0, 60.0)


@query("tone_groups", with_(SPECTRUM) + BG + """
, ex AS (SELECT rm.spectrum_id, pos, ps.rf_hz, 10*log10(rm.power/bg) AS e FROM rm JOIN ps USING (spectrum_id, pos)), cd AS (SELECT * FROM ex WHERE e > 0.05),
nw AS (SELECT *, CASE WHEN pos - lag(pos) OVER w > 3 OR lag(pos) OVER w IS NULL THEN 1 ELSE 0 END AS nw FROM cd WINDOW w AS (PARTITION BY spectrum_id ORDER BY pos)),
gr AS (SELECT *, sum(nw) OVER (PARTITION BY spectrum_id ORDER BY pos) AS gg FROM nw)
SELECT spectrum_id, min(pos) AS first, max(pos) AS last, count(*) AS width_bins, arg_max(pos, e) AS peak, arg_max(rf_hz, e) AS rf_hz, round(max(e), 5) AS prominence_db,
 CASE WHEN abs(abs(arg_max(rf_hz, e)) - 1200) <= 60 THEN 'SR/5' WHEN abs(abs(arg_max(rf_hz, e)) - 2000) <= 60 THEN 'SR/3' WHEN abs(abs(arg_max(rf_hz, e)) - 2400) <= 60 THEN '2SR/5' ELSE 'unidentified' END AS identification FROM gr GROUP BY spectrum_id, gg""")
def tone_groups(spark, d):
    return rounded(_groups(spark, d), "prominence_db", digits=5)


@query("notched_spectrum", with_(SPECTRUM) + BG + """
, ex AS (SELECT rm.spectrum_id, pos, ps.rf_hz, rm.power, bg, 10*log10(rm.power/bg) AS e FROM rm JOIN ps USING (spectrum_id, pos) WHERE pos BETWEEN 0 AND 63), cd AS (SELECT * FROM ex WHERE e > 0.05),
nw AS (SELECT *, CASE WHEN pos - lag(pos) OVER w > 3 OR lag(pos) OVER w IS NULL THEN 1 ELSE 0 END AS nw FROM cd WINDOW w AS (PARTITION BY spectrum_id ORDER BY pos)),
gr AS (SELECT *, sum(nw) OVER (PARTITION BY spectrum_id ORDER BY pos) AS gg FROM nw),
tg AS (SELECT spectrum_id, min(pos) AS f, max(pos) AS l FROM gr GROUP BY spectrum_id, gg HAVING least(abs(abs(arg_max(rf_hz, e)) - 1200), abs(abs(arg_max(rf_hz, e)) - 2000), abs(abs(arg_max(rf_hz, e)) - 2400)) <= 60),
ed AS (SELECT tg.spectrum_id, f, l, max(pos) FILTER (pos < f) AS a, min(pos) FILTER (pos > l) AS b FROM tg LEFT JOIN (SELECT * FROM ex WHERE e <= 0.02) q ON q.spectrum_id = tg.spectrum_id GROUP BY 1, 2, 3),
rg AS (SELECT spectrum_id, greatest(coalesce(a + 1, f), f - 4) - 1 AS s, least(coalesce(b - 1, l), l + 4) + 1 AS t FROM ed)
SELECT spectrum_id, pos, round(power, 6) AS power, round(CASE WHEN EXISTS (SELECT 1 FROM rg WHERE rg.spectrum_id = ex.spectrum_id AND pos BETWEEN s AND t) THEN bg ELSE power END, 6) AS notched FROM ex""")
def notched(spark, d):
    known = _groups(spark, d).where("identification <> 'unidentified'")
    out = P.notch(_background(spark, d), known, "spectrum_id", stop_db=0.02, reach=4, pad=1).select("spectrum_id", "pos", "power", "notched")
    return rounded(out, "power", "notched", digits=6)
