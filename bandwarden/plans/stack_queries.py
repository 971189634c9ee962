"""Stack-level queries: alignment, evidence, chunks, presence, numbering."""
from __future__ import annotations

from pyspark.sql import functions as F

from .. import constants as C
from ..functions import clock, units as U
from ..operators import align, evidence, numbering, presence, reduce
from ..sources import views as V
from .oracle_views import FRAMES, FREQ_ID, UNITS, with_
from .registry import query

c = F.col
R = lambda col, n=9: F.round(col, n)
CHANNELS = (14, 15, 16, 17)
COMMON = ", cm AS (SELECT event_id, frame_in_unit FROM v GROUP BY 1, 2 HAVING count(DISTINCT physical_channel) = (SELECT count(DISTINCT physical_channel) FROM v))"
NUM = COMMON + ", nb AS (SELECT event_id, frame_in_unit, ROW_NUMBER() OVER (ORDER BY min(unit_time0), event_id, frame_in_unit) - 1 AS frame_index FROM v SEMI JOIN cm USING (event_id, frame_in_unit) GROUP BY 1, 2)"


@query("align_frames", with_(FRAMES) + NUM + """
SELECT nb.frame_index, v.event_id, v.frame_in_unit, v.physical_channel, v.f, CAST(v.reject AS INT) AS mask FROM v JOIN nb USING (event_id, frame_in_unit)""")
def align_frames(spark, d):
    df = V.detector_frames(spark, d)
    return align.align_and_number(df).select(
        "frame_index", "event_id", "frame_in_unit", "physical_channel", "f", c("reject").cast("int").alias("mask"))


@query("alignment_drop_counts", with_(FRAMES) + COMMON + """
SELECT physical_channel, count(*) AS n_input, count(cm.event_id) AS n_aligned, count(*) - count(cm.event_id) AS n_dropped
FROM v LEFT JOIN cm USING (event_id, frame_in_unit) GROUP BY 1""")
def drop_counts(spark, d):
    return align.drop_counts(V.frames(spark, d))


@query("event_metadata_agreement", with_(UNITS) + """
, m AS (SELECT event_id, physical_channel, unit_time0 + CASE WHEN event_id % 97 = 0 AND physical_channel = 17 THEN 1.0 ELSE 0.0 END AS t FROM u)
SELECT event_id, count(*) AS n, max(t) - min(t) AS start_spread FROM m GROUP BY 1
HAVING count(*) = 4 AND max(t) - min(t) > 0 AND max(t)-min(t) >= 0.5::DOUBLE*2.56e-6""")
def event_metadata(spark, d):
    """Agreement of event clocks, with starts shifted on some events."""
    shift = F.when((c("event_id") % 97 == 0) & (c("physical_channel") == 17), 1.0).otherwise(0.0)
    u = V.units(spark, d).select(
        c("event_id").cast("string").alias("event_key"), "physical_channel", "event_id", c("event_id").alias("time0_fpga"),
        F.lit(C.SAMPLE_PERIOD_S).alias("period"), (c("unit_time0") + shift).alias("unit_time0"))
    bad = align.event_metadata_violations(u, len(CHANNELS))
    return bad.select(c("event_key").cast("long").alias("event_id"), "n", "start_spread")


@query("frame_unit_lookup", with_(UNITS) + """
SELECT v.physical_channel, v.event_id, v.frame_in_unit, u.scope, u.unit_key, u.n_frames FROM v JOIN u USING (physical_channel, event_id)""")
def frame_unit_lookup(spark, d):
    u = V.units(spark, d).select("physical_channel", "event_id", "scope", "unit_key", "n_frames")
    f = V.frames(spark, d).select("physical_channel", "event_id", "frame_in_unit")
    return align.attach_units(f, u)


@query("inventory_exposure_by_class", with_(UNITS) + """
SELECT scope, count(*) AS units, CAST(sum(n_frames) AS BIGINT) AS frames, count(DISTINCT event_id) AS events,
 round(sum(n_frames)*(16384*2.56e-6::DOUBLE), 6) AS seconds FROM u GROUP BY 1""")
def exposure_by_class(spark, d):
    u = V.units(spark, d)
    return evidence.exposure_by_class(u.drop("scope"), u.select("unit_key", "scope")).withColumn("seconds", R(c("seconds"), 6))


@query("inventory_bytes_by_class", with_(UNITS) + """
, i AS (SELECT *, CASE WHEN event_id % 17 <> 4 THEN n_frames*1000 + event_id % 100 END AS size_bytes, event_id % 10 <> 0 AS processed, event_id % 20 = 0 AS bad FROM u)
SELECT scope, count(*) AS units, count(*) FILTER (processed) AS processed_units, count(*) FILTER (bad) AS quarantined_units, CAST(coalesce(sum(n_frames) FILTER (processed), 0) AS BIGINT) AS frames,
 count(DISTINCT event_id) FILTER (processed) AS events, round(coalesce(sum(n_frames) FILTER (processed), 0)*(16384*2.56e-6::DOUBLE), 6) AS seconds, CAST(sum(coalesce(size_bytes, 0)) AS BIGINT) AS catalogued_bytes,
 CAST(coalesce(sum(size_bytes) FILTER (processed), 0) AS BIGINT) AS processed_bytes, CAST(coalesce(sum(size_bytes) FILTER (bad), 0) AS BIGINT) AS quarantined_bytes FROM i GROUP BY 1""")
def bytes_by_class(spark, d):
    u = V.units(spark, d)
    size = F.when(c("event_id") % 17 != 4, c("n_frames") * 1000 + c("event_id") % 100)
    out = evidence.bytes_by_class(u.select("unit_key", "scope", size.alias("size_bytes")), u.where(c("event_id") % 10 != 0), u.where(c("event_id") % 20 == 0))
    return out.withColumn("seconds", R(c("seconds"), 6))


@query("evidence_reconciliation", with_(UNITS) + """
, p AS (SELECT * FROM u WHERE event_id % 10 <> 0), q AS (SELECT * FROM u WHERE event_id % 20 = 0)
SELECT 'inventory_duplicate' AS "check", count(*) AS n FROM (SELECT unit_key FROM u GROUP BY 1 HAVING count(*)>1)
UNION ALL SELECT 'processed_not_in_inventory', count(*) FROM p ANTI JOIN u USING (unit_key)
UNION ALL SELECT 'flagged_not_in_inventory', 0
UNION ALL SELECT 'unprocessed_not_quarantined', count(*) FROM (SELECT * FROM u ANTI JOIN p USING (unit_key)) ANTI JOIN q USING (unit_key)
UNION ALL SELECT 'quarantined_but_processed', count(*) FROM q SEMI JOIN p USING (unit_key)""")
def reconciliation(spark, d):
    u = V.units(spark, d)
    processed, quarantine = u.where(c("event_id") % 10 != 0), u.where(c("event_id") % 20 == 0)
    return evidence.reconcile(u, processed, u.where("n_frames > 2"), quarantine)


@query("pending_units", with_(UNITS) + """
SELECT unit_key FROM u WHERE event_id % 3 <> 0 AND event_id % 5 <> 0 AND event_id % 7 <> 0""")
def pending(spark, d):
    u = V.units(spark, d).select(c("unit_key").alias("stable_key"), F.concat(F.lit("n/"), c("unit_key")).alias("name"), "event_id")
    saved = u.where(c("event_id") % 3 == 0)
    keyed = u.where(c("event_id") % 5 == 0).select("stable_key", "name")
    named = u.where(c("event_id") % 7 == 0).select(F.lit(None).cast("string").alias("stable_key"), "name")
    return evidence.pending_units(u, saved, keyed.unionByName(named)).select(c("stable_key").alias("unit_key"))


@query("inventory_id_comparison", with_(UNITS) + """
, q AS (SELECT DISTINCT freq_id + CASE WHEN physical_channel=14 THEN 1 ELSE 0 END AS freq_id FROM u)
SELECT freq_id, 'missing' AS status FROM q WHERE freq_id NOT IN (SELECT freq_id FROM u)
UNION ALL SELECT DISTINCT freq_id, 'extra' FROM u WHERE freq_id NOT IN (SELECT freq_id FROM q)""")
def id_comparison(spark, d):
    u = V.units(spark, d)
    wanted = u.select((c("freq_id") + F.when(c("physical_channel") == 14, 1).otherwise(0)).alias("freq_id"))
    return evidence.compare_ids(wanted, u)


@query("scan_scope_accounting", with_(UNITS) + """
, t AS (SELECT physical_channel, event_id % 2 = 0 AS done, n_frames > 2 AS capped, event_id % 5 = 0 AND event_id % 2 = 1 AS quar, event_id % 15 = 0 AS failed FROM u),
p AS (SELECT physical_channel, count(*) AS enumerated, count(*) FILTER (done AND NOT capped) AS completed, count(*) FILTER (done AND capped) AS capped,
 count(*) FILTER (quar AND failed) AS failed, count(*) FILTER (quar AND NOT failed) AS quarantined, count(*) FILTER (NOT done AND NOT quar) AS unprocessed
 FROM t GROUP BY GROUPING SETS ((physical_channel), ()))
SELECT *, CASE WHEN enumerated=0 THEN 'empty' WHEN failed>0 THEN 'failed' WHEN unprocessed>0 THEN 'incomplete' WHEN capped>0 THEN 'capped' ELSE 'complete' END AS status FROM p""")
def scan_scope(spark, d):
    u = V.units(spark, d)
    done = u.where(c("event_id") % 2 == 0).select("unit_key", (c("n_frames") > 2).alias("capped"))
    quar = u.where((c("event_id") % 5 == 0) & (c("event_id") % 2 == 1)).select("unit_key", (c("event_id") % 15 == 0).alias("failed"))
    return evidence.scan_scope(u, done, quar)


@query("per_file_cap", with_(FRAMES) + """
SELECT physical_channel, event_id, count(*) AS n_frames, count(*) FILTER (frame_in_unit < 2) AS n_kept, max(frame_in_unit) >= 2 AS capped FROM v GROUP BY 1, 2""")
def per_file_cap(spark, d):
    return evidence.capped_units(V.frames(spark, d), 2)


_Q = "CASE WHEN f > 0 THEN 10*log10(f/mu0) END"
_S = f"(CASE WHEN f/mu0 - 1 > 0 THEN 10*log10(f/mu0-1) END + 11.3::DOUBLE - 10*log10(6e6::DOUBLE/(390625.0::DOUBLE/128)))"


@query("chunk_reductions", with_(FRAMES) + NUM + f"""
, j AS (SELECT v.*, nb.frame_index, {_Q} AS q_db, {_S} AS shelf_db, floor((nb.frame_index*16384.0::DOUBLE/390625.0)/10.0::DOUBLE) AS chunk FROM v JOIN nb USING (event_id, frame_in_unit))
SELECT dense_rank() OVER (ORDER BY chunk) - 1 AS chunk_index, physical_channel, min(frame_index) AS chunk_start_frame, max(frame_index)+1 AS chunk_stop_frame,
 round(avg(baseband_power) FILTER (valid), 9) AS input_power_mean, round(avg(baseband_power) FILTER (valid AND NOT reject), 9) AS cleaned_power_mean,
 count(*) AS total_count, count(*) FILTER (valid) AS valid_count, count(*) FILTER (NOT valid) AS invalid_count,
 count(*) FILTER (valid AND reject) AS masked_count_valid, count(*) FILTER (valid AND NOT reject) AS unmasked_count_valid,
 round(count(*) FILTER (valid AND reject)/nullif(count(*) FILTER (valid),0), 9) AS mask_fraction_valid, round(count(*) FILTER (valid AND reject)/count(*), 9) AS mask_fraction_total,
 round(max(q_db) FILTER (valid), 6) AS q_db_max, round(max(shelf_db) FILTER (valid), 6) AS shelf_db_max,
 round(quantile_cont(q_db, 0.5) FILTER (valid), 6) AS q_db_median, round(quantile_cont(q_db, 0.95) FILTER (valid), 6) AS q_db_p95,
 round(quantile_cont(shelf_db, 0.5) FILTER (valid), 6) AS shelf_db_median, round(quantile_cont(shelf_db, 0.95) FILTER (valid), 6) AS shelf_db_p95
FROM j GROUP BY chunk, physical_channel""")
def chunks(spark, d):
    df = align.align_and_number(V.detector_frames(spark, d))
    df = df.withColumn("q_db", U.to_db(c("f") / c("mu0"))).withColumn(
        "shelf_db", U.excess_to_shelf_db(U.to_db(c("f") / c("mu0") - 1)))
    out = reduce.chunk_reductions(df, max_rows=V.frame_bound(spark, d))
    nine = ("input_power_mean", "cleaned_power_mean", "mask_fraction_valid", "mask_fraction_total")
    six = ("q_db_max", "shelf_db_max", "q_db_median", "q_db_p95", "shelf_db_median", "shelf_db_p95")
    return out.withColumns({**{k: R(c(k)) for k in nine}, **{k: R(c(k), 6) for k in six}})


@query("event_boundaries", with_(FRAMES) + NUM + """
, l AS (SELECT event_id, frame_index, lag(event_id) OVER (ORDER BY frame_index) AS prev FROM nb)
SELECT event_id, frame_index FROM l WHERE prev IS NULL OR prev <> event_id""")
def boundaries(spark, d):
    return align.event_boundaries(align.numbered_identities(V.frames(spark, d)))


@query("frame_numbering", with_(FRAMES) + """
SELECT physical_channel, event_id, frame_in_unit, row_number() OVER (PARTITION BY physical_channel ORDER BY unit_time0, event_id, frame_in_unit) - 1 AS frame_index FROM v""")
def frame_numbering(spark, d):
    df = V.frames(spark, d).select("physical_channel", "event_id", "frame_in_unit", "unit_time0")
    return numbering.number_within(df, ["physical_channel"], ["unit_time0", "event_id", "frame_in_unit"], "frame_index",
                                   max_rows=V.frame_bound(spark, d)).drop("unit_time0")


@query("frame_numbering_violations", with_(FRAMES) + """
SELECT physical_channel, event_id, count(*) AS n, min(frame_in_unit) AS first, max(frame_in_unit) AS last, count(DISTINCT frame_in_unit) AS distinct_frames
FROM v WHERE valid GROUP BY 1, 2 HAVING min(frame_in_unit)<>0 OR max(frame_in_unit)<>count(*)-1 OR count(DISTINCT frame_in_unit)<>count(*)""")
def numbering_violations(spark, d):
    return align.frame_numbering_violations(V.detector_frames(spark, d).where("valid"))


@query("control_pilot_join", with_(FRAMES) + """
SELECT p.event_id, p.frame_in_unit, p.f AS pilot_f, c.baseband_power AS control_power
FROM v p JOIN v c USING (event_id, frame_in_unit) WHERE p.physical_channel = 17 AND c.physical_channel = 14""")
def control_join(spark, d):
    df = V.detector_frames(spark, d)
    pilot = df.where("physical_channel = 17").select("event_id", "frame_in_unit", c("f").alias("pilot_f"))
    control = df.where("physical_channel = 14").select("event_id", "frame_in_unit", c("baseband_power").alias("control_power"))
    return align.control_join(pilot, control)


SIG = ", sg AS (SELECT signature, count(*) AS n_events FROM (SELECT event_id, bit_or(CAST(1 << (physical_channel-14) AS BIGINT)) AS signature FROM v GROUP BY 1) GROUP BY 1)"


def _signatures(spark, d):
    return presence.signatures(V.frames(spark, d).select("physical_channel", "event_id"), CHANNELS)


@query("presence_signatures", with_(FRAMES) + SIG + "SELECT * FROM sg")
def presence_signatures(spark, d):
    return _signatures(spark, d)


@query("best_common_subset", with_(FRAMES) + SIG + """
, t AS (SELECT a.signature, CAST(sum(b.n_events) AS BIGINT) AS total, bit_and(b.signature) AS closed FROM sg a JOIN sg b ON (a.signature & b.signature) = a.signature GROUP BY 1),
r AS (SELECT CAST(bit_count(closed) AS INT) AS k, total, closed, row_number() OVER (PARTITION BY bit_count(closed) ORDER BY total DESC, closed) AS rn FROM t)
SELECT k, total AS common_events, closed AS channels_mask FROM r WHERE rn = 1""")
def best_subset(spark, d):
    return presence.best_common_subset(_signatures(spark, d), len(CHANNELS))


@query("presence_report", with_(FRAMES) + """
, h AS (SELECT DISTINCT physical_channel, event_id FROM v), k AS (SELECT event_id, count(*) AS n FROM h GROUP BY 1)
SELECT 'channel' AS kind, CAST(physical_channel AS BIGINT) AS key, count(*) AS n FROM h GROUP BY 2
UNION ALL SELECT 'holders', n, count(*) FROM k GROUP BY 2 UNION ALL SELECT 'union', NULL, count(*) FROM k""")
def presence_report(spark, d):
    return presence.presence_report(V.frames(spark, d))


_BITS = ", ".join(f"(CAST({1 << i} AS BIGINT), {ch})" for i, ch in enumerate(CHANNELS))


@query("greedy_drop_curve", with_(FRAMES) + SIG + f"""
, b AS (SELECT * FROM (VALUES {_BITS}) AS t(bit, ch)),
own AS (SELECT bit, ch, sum(n_events) AS own FROM b JOIN sg ON (signature & bit) = bit GROUP BY 1, 2),
i0 AS (SELECT coalesce(sum(n_events) FILTER (signature = 15), 0) AS n FROM sg),
s1 AS (SELECT bit, ch, coalesce(sum(n_events) FILTER ((signature & (15 - bit)) = 15 - bit), 0) AS n, own FROM own, sg GROUP BY bit, ch, own ORDER BY n DESC, own, ch LIMIT 1),
s2 AS (SELECT o.bit, o.ch, coalesce(sum(n_events) FILTER ((signature & (15 - s1.bit - o.bit)) = 15 - s1.bit - o.bit), 0) AS n, o.own FROM own o, s1, sg WHERE o.bit <> s1.bit GROUP BY o.bit, o.ch, o.own ORDER BY n DESC, own, ch LIMIT 1)
SELECT 0 AS step, s1.ch AS dropped_channel, 3 AS n_channels_after, CAST(s1.n AS BIGINT) AS common_events, CAST(s1.n >= i0.n*1.1 AS INT) AS accepted FROM s1, i0
UNION ALL SELECT 1, s2.ch, 2, CAST(s2.n AS BIGINT), CAST(s1.n >= i0.n*1.1 AND s2.n >= s1.n*1.1 AS INT) FROM s1, s2, i0""")
def drop_curve(spark, d):
    return presence.greedy_drop_curve(_signatures(spark, d), CHANNELS)


@query("composition_by_class", with_(UNITS) + """
, p AS (SELECT physical_channel, 'archive' AS population, scope FROM u UNION ALL SELECT physical_channel, 'sampled', scope FROM u WHERE n_frames >= 2)
SELECT physical_channel, population, count(*) AS n_events, round(count(*) FILTER (scope='scheduled')/count(*), 9) AS share_scheduled,
 round(count(*) FILTER (scope='triggered_event')/count(*), 9) AS share_triggered_event FROM p GROUP BY 1, 2""")
def composition(spark, d):
    u = V.units(spark, d).select("physical_channel", "scope", "n_frames")
    pops = u.select("physical_channel", "scope", F.explode(F.when(c("n_frames") >= 2, F.array(
        F.lit("archive"), F.lit("sampled"))).otherwise(F.array(F.lit("archive")))).alias("population"))
    out = presence.composition(pops, ["scheduled", "triggered_event"])
    return out.withColumns({k: R(c(k)) for k in ("share_scheduled", "share_triggered_event")})


@query("data_hours_and_span", with_(UNITS) + COMMON + """
SELECT (SELECT count(*) FROM cm) AS common_frames, round((SELECT count(*) FROM cm)*(16384*2.56e-6::DOUBLE)/3600, 9) AS data_hours,
 min(unit_time0) AS first_start, max(unit_time0) AS last_start, (max(unit_time0)-min(unit_time0))/86400 AS span_days FROM u""")
def data_hours(spark, d):
    df = V.frames(spark, d)
    n = align.common_identities(df).agg(F.count(F.lit(1)).alias("common_frames"))
    span = df.agg(F.min("unit_time0").alias("first_start"), F.max("unit_time0").alias("last_start"))
    return n.join(F.broadcast(span), F.lit(True)).select(
        "common_frames", R(c("common_frames") * C.FRAME_SECONDS / 3600.0).alias("data_hours"), "first_start", "last_start",
        ((c("last_start") - c("first_start")) / 86400.0).alias("span_days"))


@query("identity_set_operations", with_(FRAMES) + """
, k AS (SELECT event_id, count(DISTINCT physical_channel) AS n FROM v GROUP BY 1)
SELECT 'all_channels' AS kind, count(*) AS n FROM k WHERE n = 4 UNION ALL SELECT 'any_channel', count(*) FROM k
UNION ALL SELECT 'not_common', count(*) FROM k WHERE n < 4""")
def set_operations(spark, d):
    ids = V.frames(spark, d).select("physical_channel", "event_id").distinct()
    any_ = ids.select("event_id").distinct()
    common = ids.groupBy("event_id").agg(F.count(F.lit(1)).alias("k")).where(c("k") == len(CHANNELS)).select("event_id")
    count = lambda df, kind: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(kind).alias("kind"), "n")
    return count(common, "all_channels").unionByName(count(any_, "any_channel")).unionByName(
        count(any_.exceptAll(common), "not_common"))


@query("ordered_detector_table", with_(FRAMES) + """
SELECT physical_channel, event_id, count(*) AS n, min(f) AS min_f FROM v GROUP BY 1, 2""")
def ordered(spark, d):
    return V.detector_frames(spark, d).groupBy("physical_channel", "event_id").agg(
        F.count(F.lit(1)).alias("n"), F.min("f").alias("min_f")).orderBy("physical_channel", "event_id")


@query("top_frames_per_channel", with_(FRAMES) + """
, r AS (SELECT physical_channel, event_id, frame_in_unit, f, row_number() OVER (PARTITION BY physical_channel ORDER BY f DESC, event_id, frame_in_unit) AS rank FROM v WHERE f IS NOT NULL)
SELECT * FROM r WHERE rank <= 5""")
def top_frames(spark, d):
    """Spark's rank limit keeps at most k rows per group before the shuffle."""
    from pyspark.sql import Window as W
    w = W.partitionBy("physical_channel").orderBy(c("f").desc(), "event_id", "frame_in_unit")
    df = V.detector_frames(spark, d).where(c("f").isNotNull()).select("physical_channel", "event_id", "frame_in_unit", "f")
    return df.withColumn("rank", F.row_number().over(w).cast("long")).where("rank <= 5")
