"""The derived views as SQL text, for the side-by-side check."""
from __future__ import annotations

from ..sources.views import WEIGHTS

NOISE = "((l_orderkey*7919 + l_partkey*104729 + l_linenumber*1299709) % 20001 - 10000)"

FRAMES = f"""
fr_b AS (
  SELECT CAST(14 + l_suppkey % 4 AS INT) AS physical_channel, l_orderkey AS event_id,
         l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_discount, l_tax, l_returnflag,
         CAST(l_quantity AS BIGINT) AS q, {NOISE} AS noise FROM lineitem),
fr_r AS (
  SELECT fr_b.*, ROW_NUMBER() OVER (PARTITION BY physical_channel, event_id
         ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS frame_in_unit FROM fr_b),
v_frames AS (
  SELECT physical_channel, event_id, CAST(frame_in_unit AS INT) AS frame_in_unit,
       q * (1000000 + noise + CASE WHEN l_returnflag = 'R' AND physical_channel = 17 THEN l_partkey*500 ELSE 0 END) AS p_target,
       CASE WHEN l_discount = 0 AND l_tax = 0 THEN 0 ELSE q*2000000 END AS p_ref_sum,
       CAST(6000 + physical_channel - 14 AS BIGINT) AS target_norm_sq,
       CAST(12000 AS BIGINT) AS reference_norm_sum_sq,
       CAST(q AS DOUBLE) * CAST(2.56 AS DOUBLE) AS baseband_power,
       CAST(epoch(o_orderdate) AS DOUBLE) AS unit_time0
  FROM fr_r JOIN orders ON o_orderkey = event_id),
v AS (
  SELECT *, p_ref_sum > 0 AS valid,
         CASE WHEN p_ref_sum > 0 THEN 2.0::DOUBLE * p_target / p_ref_sum END AS f,
         2.0::DOUBLE * target_norm_sq / reference_norm_sum_sq AS mu0,
         p_ref_sum > 0 AND p_target*reference_norm_sum_sq > target_norm_sq*p_ref_sum AS reject,
         p_ref_sum > 0 AND baseband_power >= 0 AND baseband_power < 128 AS healthy
  FROM v_frames)"""

FREQ_ID = "CAST(round_even((800e6 - (470e6 + (physical_channel-14)*6e6 + 309441.0))/390625.0, 0) AS BIGINT)"

UNITS = FRAMES + f""",
v_units AS (
  SELECT f.physical_channel, f.event_id, min(f.unit_time0) AS unit_time0, count(*) AS n_frames,
         min(CASE WHEN o.o_orderpriority LIKE '5%' THEN 'scheduled' ELSE 'triggered_event' END) AS scope,
         min(o.o_orderstatus) AS status
  FROM v_frames f JOIN orders o ON o.o_orderkey = f.event_id GROUP BY f.physical_channel, f.event_id),
u AS (SELECT *, {FREQ_ID} AS freq_id,
        'ns/' || status || '/baseband_' || event_id || '_' || {FREQ_ID} || '.h5' AS unit_key FROM v_units)"""

SAMPLES = """
smp AS (
  SELECT CAST(floor(event_id / 128.0) AS INT) AS frame, CAST(event_id % 128 AS INT) AS n,
         CAST(floor((event_id % 128) / 8.0) AS INT) AS win, CAST(event_id % 8 AS INT) AS k,
         CAST(round(value*100) AS BIGINT) % 16 - 8 AS re, (user_id*37 + event_id*11) % 16 - 8 AS im
  FROM events WHERE event_id < (SELECT 128*floor(count(*)/128.0) FROM events)),
wgt AS (SELECT * FROM (VALUES """ + ", ".join(map(str, WEIGHTS)) + """) AS t(term, k, wr, wi))"""

FINE = """
fine AS (
  SELECT vec_id AS frame_id, CAST(14 + label % 4 AS INT) AS physical_channel,
         CAST(floor(vec_id / 8.0) AS BIGINT) AS unit_id, 1546300800.0::DOUBLE + vec_id * 604800.0::DOUBLE AS frame_time,
         generate_subscripts(embedding, 1) - 1 AS bin,
         CAST(1.0::FLOAT + unnest(embedding) AS DOUBLE) AS x FROM embeddings)"""

SPECTRUM = """
sp_b AS (SELECT label AS spectrum_id, generate_subscripts(embedding, 1) - 1 AS bin,
         CAST(1.0::FLOAT + unnest(embedding) AS DOUBLE) AS x FROM embeddings),
spec AS (SELECT spectrum_id, CAST(bin AS INT) AS bin, avg(x) AS power FROM sp_b GROUP BY 1, 2)"""

CENSUS = """
census AS (
  SELECT CAST(14 + s_suppkey % 23 AS INT) AS rf_channel, s_name AS callsign,
         CASE s_nationkey % 3 WHEN 0 THEN 'full_service' WHEN 1 THEN 'translator' ELSE 'other' END AS service_class,
         s_acctbal AS detectability_db, CAST(10 + s_suppkey AS DOUBLE) AS distance_km FROM supplier),
lines AS (
  SELECT CAST(14 + p_partkey % 23 AS INT) AS rf_channel, p_partkey AS line_id, p_retailprice - 1400 AS offset_hz,
         CAST(p_size AS DOUBLE) AS snr_db FROM part)"""

TRIALS = f"""
trials AS (
  SELECT l_orderkey AS trial, CAST(round(l_discount*100) AS INT) AS snr_db, CAST(round(l_tax*100) AS INT) AS offset_bin,
         1.0::DOUBLE + CAST({NOISE} AS DOUBLE) / 1e6::DOUBLE + round(l_discount*100) * 0.001::DOUBLE AS ratio,
         l_quantity AS power FROM lineitem)"""


def with_(*views: str) -> str:
    return "WITH " + ",".join(views) + "\n"


def wilson(k: str, n: str) -> tuple[str, str]:
    z = "1.959963984540054::DOUBLE"
    p, den = f"(({k})::DOUBLE/({n}))", f"(1 + {z}*{z}/({n}))"
    mid = f"(({p} + {z}*{z}/(2.0::DOUBLE*({n})))/{den})"
    half = f"({z}*sqrt({p}*(1-{p})/({n}) + {z}*{z}/(4.0::DOUBLE*({n})*({n})))/{den})"
    low = f"CASE WHEN ({n})=0 THEN NULL WHEN ({k})=0 THEN 0.0::DOUBLE ELSE greatest(0.0::DOUBLE, {mid}-{half}) END"
    high = f"CASE WHEN ({n})=0 THEN NULL WHEN ({k})=({n}) THEN 1.0::DOUBLE ELSE least(1.0::DOUBLE, {mid}+{half}) END"
    return low, high
