"""Sample blocks: codec, framing, projections, powers, spectra."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import samples as S
from ..operators import blocks as B
from ..sources import views as V
from ..sources.tables import row_bound, table
from .distribution_queries import rounded
from .oracle_views import SAMPLES, with_
from .registry import query

c = F.col


def frames(spark, d):
    """Payload per 128-sample frame of one stream."""
    s = V.samples(spark, d)
    return B.pack_frames(s, ["frame"], "n", S.encode_offset(c("re"), c("im")))


@query("decode_samples", with_(SAMPLES) + """
SELECT frame, n, CAST((re+8)*16 + im+8 AS INT) AS byte, CAST(re AS INT) AS re, CAST(im AS INT) AS im,
 CAST(((re+16) % 16)*16 + (im+16) % 16 AS INT) AS twos_byte, CAST(re AS INT) AS twos_re, CAST(im AS INT) AS twos_im FROM smp""")
def decode(spark, d):
    s = V.samples(spark, d).select("frame", "n", S.encode_offset(c("re"), c("im")).alias("byte"))
    re, im = S.decode_offset(c("byte"))
    two = s.select("frame", "n", "byte", re.alias("re"), im.alias("im"), S.repack(c("byte")).alias("twos_byte"))
    tr, ti = S.decode_twos(c("twos_byte"))
    return two.select("*", tr.alias("twos_re"), ti.alias("twos_im"))


@query("quantize_samples", """WITH e AS (SELECT event_id, CAST(event_id % 4 AS INT) AS stream, value AS re, user_id::DOUBLE - 50 AS im FROM events),
s AS (SELECT stream, 7.0::DOUBLE/(3.0::DOUBLE*stddev_pop(re)) AS scale FROM e GROUP BY 1)
SELECT event_id, e.stream, CAST(least(greatest(round_even(re*round(scale, 9), 0), -7), 7) AS INT) AS q_re, CAST(least(greatest(round_even(im*round(scale, 9), 0), -7), 7) AS INT) AS q_im,
 abs(re*scale) > 7 OR abs(im*scale) > 7 AS clipped FROM e JOIN s USING (stream)""")
def quantize(spark, d):
    e = table(spark, d, "events").select("event_id", (c("event_id") % 4).cast("int").alias("stream"), c("value").alias("re"),
                                         (c("user_id").cast("double") - 50).alias("im"))
    return B.quantize(e, "re", "im", ["stream"]).select("event_id", "stream", "q_re", "q_im", "clipped")


@query("frame_source", """WITH e AS (SELECT event_id, CAST(floor(event_id/500.0) AS BIGINT) AS unit, event_id % 500 AS i, (CAST(round(value*100) AS BIGINT) % 16)*16 + (user_id*37 + event_id*11) % 16 AS byte FROM events),
f AS (SELECT unit, CAST(floor(i/128.0) AS INT) AS frame_in_unit, string_agg(printf('%02X', byte), '' ORDER BY i) AS payload_hex, count(*) AS n FROM e GROUP BY 1, 2)
SELECT unit, frame_in_unit, payload_hex FROM f WHERE n = 128""")
def frame_source(spark, d):
    e = table(spark, d, "events").select(
        F.floor(c("event_id") / 500).alias("unit"), (c("event_id") % 500).alias("i"),
        (F.round(c("value") * 100).cast("long") % 16 * 16 + (c("user_id") * 37 + c("event_id") * 11) % 16).alias("byte"))
    blocks = B.pack_frames(e, ["unit"], "i", c("byte")).withColumn("n_streams", F.lit(1))
    return B.frame_source(blocks, 128).select("unit", "frame_in_unit", F.hex("payload").alias("payload_hex"))


@query("frame_to_detector_rows", with_(SAMPLES) + """
SELECT frame, n, CAST((frame % 3)*16 + win AS BIGINT) AS row, CAST(CASE WHEN frame % 2 = 1 THEN 7 - k ELSE k END AS INT) AS place FROM smp""")
def detector_rows(spark, d):
    s = V.samples(spark, d)
    sense = F.when(c("frame") % 2 == 1, -1).otherwise(1)
    return B.with_row_index(s, 8, 16, c("frame") % 3, sense).select("frame", "n", "row", "place")


PROJ = """, z AS (SELECT frame, term, win AS "row", CAST(sum(re*wr + im*wi) AS BIGINT) AS zr, CAST(sum(im*wr - re*wi) AS BIGINT) AS zi FROM smp JOIN wgt USING (k) GROUP BY 1, 2, 3),
pw AS (SELECT frame, CAST(sum(zr*zr+zi*zi) FILTER (term=0) AS BIGINT) AS p_target, CAST(sum(zr*zr+zi*zi) FILTER (term=1) AS BIGINT) AS p_lower, CAST(sum(zr*zr+zi*zi) FILTER (term=2) AS BIGINT) AS p_upper FROM z GROUP BY 1)"""


@query("row_projections", with_(SAMPLES) + PROJ + 'SELECT frame, term, "row", zr, zi FROM z')
def projections(spark, d):
    return B.row_projections(frames(spark, d), V.weights(spark), ["frame"], 1)


@query("row_projections_relational", with_(SAMPLES) + PROJ + 'SELECT frame, term, "row", zr, zi FROM z')
def projections_relational(spark, d):
    return B.row_projections_relational(V.samples(spark, d), V.weights(spark))


@query("coarse_powers", with_(SAMPLES) + PROJ + "SELECT frame, p_target, p_lower, p_upper, p_lower + p_upper AS p_ref_sum FROM pw")
def powers(spark, d):
    return B.detect_frames(frames(spark, d), V.weights(spark), ["frame"], 1).select("frame", "p_target", "p_lower", "p_upper", "p_ref_sum")


@query("coarse_power_identity", with_(SAMPLES) + PROJ + "SELECT 0 AS mismatches, count(*) AS n FROM pw")
def power_identity(spark, d):
    a = B.detect_frames(frames(spark, d), V.weights(spark), ["frame"], 1)
    b = B.coarse_powers(B.row_projections_relational(V.samples(spark, d), V.weights(spark)), ["frame"])
    bad = B.power_mismatches(a, b, ["frame"]).agg(F.count(F.lit(1)).cast("int").alias("mismatches"))
    return bad.join(F.broadcast(b.agg(F.count(F.lit(1)).alias("n"))), F.lit(True))


@query("baseband_power_by_frame", with_(SAMPLES) + "SELECT frame, round(avg(re*re+im*im), 9) AS baseband_power FROM smp GROUP BY 1")
def baseband(spark, d):
    out = B.detect_frames(frames(spark, d), V.weights(spark), ["frame"], 1).select("frame", "baseband_power")
    return rounded(out, "baseband_power")


@query("fine_reduce", with_(SAMPLES) + PROJ + """
, b AS (SELECT CAST(unnest(range(32)) AS INT) AS bin),
s AS (SELECT frame, term, bin, sum(zr*cos(2*pi()*bin*"row"/32) + zi*sin(2*pi()*bin*"row"/32)) AS sr, sum(zi*cos(2*pi()*bin*"row"/32) - zr*sin(2*pi()*bin*"row"/32)) AS si FROM z, b GROUP BY 1, 2, 3),
q AS (SELECT frame, bin, sum(sr*sr+si*si) FILTER (term=0) AS t, sum(sr*sr+si*si) FILTER (term>0) AS r FROM s GROUP BY 1, 2)
SELECT frame, bin, round(CASE WHEN r > 0 THEN 2*t/r ELSE 0 END, 3) AS fine_ratio FROM q""")
def fine_reduce(spark, d):
    out = B.detect_frames(frames(spark, d), V.weights(spark), ["frame"], 1).select("frame", F.posexplode("fine_ratio").alias("bin", "x"))
    return out.select("frame", "bin", F.round(c("x").cast("double"), 3).alias("fine_ratio"))


@query("fine_parseval_identity", with_(SAMPLES) + PROJ + "SELECT frame, p_target FROM pw")
def parseval(spark, d):
    """Term power recovered from the padded window spectrum."""
    z = B.row_projections_relational(V.samples(spark, d), V.weights(spark)).where("term = 0")
    bins = z.select("frame", "row", "zr", "zi", F.explode(F.sequence(F.lit(0), F.lit(31))).alias("bin"))
    a = c("bin") * c("row") * F.lit(2 * 3.141592653589793 / 32)
    s = bins.groupBy("frame", "bin").agg(F.sum(c("zr") * F.cos(a) + c("zi") * F.sin(a)).alias("sr"), F.sum(c("zi") * F.cos(a) - c("zr") * F.sin(a)).alias("si"))
    return s.groupBy("frame").agg(F.round(F.sum(c("sr") * c("sr") + c("si") * c("si")) / 32).cast("long").alias("p_target"))


_SPEC = """, b AS (SELECT CAST(unnest(range(128)) AS INT) AS bin),
x AS (SELECT frame, bin, sum(re*cos(2*pi()*bin*n/128) + im*sin(2*pi()*bin*n/128)) AS xr, sum(im*cos(2*pi()*bin*n/128) - re*sin(2*pi()*bin*n/128)) AS xi FROM smp, b GROUP BY 1, 2)"""


def _decided(spark, d):
    p = B.detect_frames(frames(spark, d), V.weights(spark), ["frame"], 1)
    flags = p.select("frame", (c("p_ref_sum") > 0).alias("valid"), (2 * c("p_target") > c("p_ref_sum")).alias("reject"))
    return frames(spark, d).join(flags, "frame").withColumn("physical_channel", F.lit(14))


@query("integrated_spectra", with_(SAMPLES) + PROJ + _SPEC + """
SELECT 14 AS physical_channel, bin, round(sum(xr*xr+xi*xi) FILTER (p_lower+p_upper > 0), 3) AS before, round(coalesce(sum(xr*xr+xi*xi) FILTER (p_lower+p_upper > 0 AND NOT 2*p_target > p_lower+p_upper), 0), 3) AS after,
 count(*) FILTER (p_lower+p_upper > 0) AS n_before, count(*) FILTER (p_lower+p_upper > 0 AND NOT 2*p_target > p_lower+p_upper) AS n_after FROM x JOIN pw USING (frame) GROUP BY 2""")
def integrated(spark, d):
    return rounded(B.integrated_spectra(_decided(spark, d), ["physical_channel"], 1), "before", "after", digits=3)


_MARG = """, b AS (SELECT CAST(unnest(range(8)) AS INT) AS bin),
y AS (SELECT frame, win, bin, sum(re*cos(2*pi()*bin*k/8) + im*sin(2*pi()*bin*k/8)) AS xr, sum(im*cos(2*pi()*bin*k/8) - re*sin(2*pi()*bin*k/8)) AS xi FROM smp, b GROUP BY 1, 2, 3),
mg AS (SELECT frame, bin, avg(xr*xr+xi*xi) AS m FROM y GROUP BY 1, 2)"""


@query("coarse_marginal", with_(SAMPLES) + _MARG + "SELECT frame, bin, round(m, 6) AS m FROM mg")
def marginal(spark, d):
    out = B.analyze("control", frames(spark, d), ["frame"], 1, 8).select("frame", F.posexplode("marginal").alias("bin", "m"))
    return rounded(out, "m", digits=6)


@query("marginal_ratio", with_(SAMPLES) + _MARG + """
SELECT t.frame, round(2*t.m/(l.m+u.m), 6) AS f FROM mg t JOIN mg l ON l.frame=t.frame AND l.bin=7 JOIN mg u ON u.frame=t.frame AND u.bin=3 WHERE t.bin=1""")
def marginal_f(spark, d):
    out = B.coarse_marginal(frames(spark, d), ["frame"], 1, 8)
    return rounded(out.select("frame", B.marginal_ratio(F.lit(1), 8).alias("f")), "f", digits=6)


@query("tone_injection")
def injection(spark, d):
    f = frames(spark, d).withColumn("first_sample", c("frame") * 128)
    return B.injection_manifest(B.inject_tone(f, ["frame"], 1, 0.11, 3.0, 5), ["frame"], 3.0)


@query("tone_injection_identity", with_(SAMPLES) + "SELECT frame, 0::BIGINT AS clip_count, TRUE AS identical FROM smp GROUP BY 1")
def injection_zero(spark, d):
    f = frames(spark, d).withColumn("first_sample", c("frame") * 128)
    out = B.inject_tone(f, ["frame"], 1, 0.11, 0.0, 5).withColumnRenamed("payload", "after")
    return out.join(f, "frame").select("frame", "clip_count", (c("after") == c("payload")).alias("identical"))
