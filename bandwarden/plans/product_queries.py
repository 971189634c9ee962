"""Validators, run comparison, products, streams and unit assignment."""
from __future__ import annotations

import uuid

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import constants as C, schema
from ..functions import clock, keys
from ..operators import align, assignment, blocks, catalogue, evidence, quality as K, spectra as P
from ..session import ensure_checkpoint_dir, materialize
from ..sources import inventory, products, views as V
from ..sources.tables import row_bound, stream_table, table
from ..streaming import incremental, windows
from .distribution_queries import rounded
from .fine_queries import calibrated
from .oracle_views import FINE, FRAMES, FREQ_ID, NOISE, SPECTRUM, UNITS, with_
from .registry import query

c = F.col


def scratch(spark, name):
    """New folder under the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def mutated(spark, d):
    """Detector frames with the mask flipped on some events."""
    df = V.detector_frames(spark, d)
    return df.withColumn("reject", F.when(c("event_id") % 1000 == 0, ~c("reject")).otherwise(c("reject")))


MUT = ", mu AS (SELECT * REPLACE (CASE WHEN event_id % 1000 = 0 THEN NOT reject ELSE reject END AS reject), reject AS good FROM v)"
_RULES = """SELECT 'mask_null' AS "check", 0 AS n UNION ALL SELECT 'valid_null', 0 UNION ALL SELECT 'masked_invalid', count(*) FROM mu WHERE reject AND NOT valid
UNION ALL SELECT 'valid_denominator', 0 UNION ALL SELECT 'mask_rule', count(*) FROM mu WHERE reject <> good UNION ALL SELECT 'negative_power', count(*) FROM mu WHERE p_target < 0 UNION ALL SELECT 'norms_positive', 0"""


@query("validate_frames", with_(FRAMES) + MUT + _RULES)
def validate(spark, d):
    return K.validate_frames(mutated(spark, d))


@query("audit_per_channel_product", with_(FRAMES) + MUT + _RULES + """
UNION ALL SELECT 'channel_freq_id', 0 UNION ALL SELECT 'pilot_in_band', 0 UNION ALL SELECT 'null_ratio', 0 UNION ALL SELECT 'ratio_recomputed', 0
UNION ALL SELECT 'excess_recomputed', count(*) FROM mu WHERE valid AND event_id % 500 = 0 UNION ALL SELECT 'excess_undefined_when_invalid', 0 UNION ALL SELECT 'ratio_undefined_when_invalid', 0
UNION ALL SELECT 'frame_in_unit', 0 UNION ALL SELECT 'unit_time_plausible', 0""")
def audit(spark, d):
    df = mutated(spark, d).withColumn("freq_id", V.freq_id(c("physical_channel")))
    rho = c("f") / c("mu0") - 1
    return K.audit_frames(df.withColumn("rho", F.when(c("event_id") % 500 == 0, rho + 1e-6).otherwise(rho)))


@query("audit_exceedance_list", with_(FINE) + """SELECT 'bins_ordered' AS "check", CAST(0 AS BIGINT) AS n UNION ALL SELECT 'bins_in_range', 0
UNION ALL SELECT 'threshold_above_location', 0 UNION ALL SELECT 'null_fraction_range', 0""")
def audit_list(spark, d):
    return K.audit_ragged(calibrated(spark, d), ["frame_id"])


@query("audit_units", with_(UNITS) + """
, vv AS (SELECT * FROM v WHERE valid), uu AS (SELECT * FROM u WHERE event_id % 50 <> 0)
SELECT 'unit_key_repeated' AS "check", 0 AS n UNION ALL SELECT 'frame_without_unit', count(*) FROM vv ANTI JOIN uu USING (physical_channel, event_id)
UNION ALL SELECT 'frame_in_unit_gaps', count(*) FROM (SELECT 1 FROM vv GROUP BY physical_channel, event_id HAVING min(frame_in_unit) <> 0 OR max(frame_in_unit) <> count(*)-1 OR count(DISTINCT frame_in_unit) <> count(*))""")
def audit_units(spark, d):
    return K.audit_units(V.units(spark, d).where(c("event_id") % 50 != 0), V.detector_frames(spark, d).where("valid"))


@query("audit_spectra", with_(SPECTRUM) + """SELECT 'non_negative' AS "check", count(*) FILTER (power < 0) AS n FROM spec UNION ALL SELECT 'after_not_above_before', count(*) FILTER (spectrum_id = 3) FROM spec""")
def audit_spectra(spark, d):
    s = V.spectrum(spark, d)
    return K.audit_spectra(s.select(c("power").alias("before"), (c("power") * F.when(c("spectrum_id") == 3, 1.5).otherwise(0.5)).alias("after")))


@query("shared_field_invariants", with_(FRAMES) + """
SELECT 'nfft' AS "check", 1 AS distinct_values UNION ALL SELECT 'target_norm_sq', count(DISTINCT target_norm_sq) FROM v UNION ALL SELECT 'reference_norm_sum_sq', count(DISTINCT reference_norm_sum_sq) FROM v
UNION ALL SELECT 'detector_version', 1 UNION ALL SELECT 'sample_rate_hz', 1""")
def invariants(spark, d):
    p = V.frames(spark, d).groupBy("physical_channel").agg(
        F.first("target_norm_sq").alias("target_norm_sq"), F.first("reference_norm_sum_sq").alias("reference_norm_sum_sq"))
    ch = c("physical_channel").cast("string")
    p = p.select("*", F.lit(C.FRAME_SAMPLES).alias("nfft"), F.lit(C.SAMPLE_RATE_HZ).alias("sample_rate_hz"),
                 F.concat(F.lit("det/1."), ch, F.lit(" kernel=2.1.0 K=128 source=abc"), ch).alias("detector_version"))
    return K.invariants(p, ["nfft", "target_norm_sq", "reference_norm_sum_sq"])


@query("contract_ranges", with_(FRAMES) + """
SELECT 'physical_channel_range' AS "check", count(*) FILTER (physical_channel > 16) AS n FROM v UNION ALL SELECT 'baseband_power_range', count(*) FILTER (baseband_power > 120) FROM v
UNION ALL SELECT 'f_range', count(*) FILTER (f IS NULL OR f < 0.995) FROM v""")
def contract(spark, d):
    rules = K.contract_rules({"physical_channel": (14, 16), "baseband_power": (0, 120), "f": (0.995, None)})
    return K.count_rules(V.detector_frames(spark, d), rules)


# Planted violations, as text that both engines read: column -> (remainder of the key, wrong value); one per rule at least.
_HEADER_WRONG = {
    "schema_version": (0, "'v0'"), "detector_version": (1, "'det/1 kernel=1.9.0 K=64'"), "mask_rule": (2, "'other'"), "weight_bank_sha256": (3, "'abc'"),
    "weight_manifest_sha256": (0, "NULL"), "contract_schema": (1, "'v9'"), "fine_pad_factor": (2, "3"), "freq_id": (3, "freq_id + 1"), "nfft": (0, "8192"),
    "window_samples": (1, "64"), "n_streams": (2, "2047"), "pilot_hz": (2, "pilot_hz + 3e5"), "coarse_hz": (1, "coarse_hz - 5e5"), "pilot_in_band": (0, "0"),
    "null_power_ratio": (2, "null_power_ratio + 1e-9"), "rational_overflow_count": (3, "5"), "fine_status": (1, "'off'"), "fine_bins": (3, "128"), "spectrum_bins": (2, "1")}
_FRAME_WRONG = {"p_target": (1, "-p_target"), "valid": (2, "NOT valid"), "reject": (3, "NOT reject"), "f": (4, "coalesce(f, 0) * (1 + 1e-7) + 1e-7"),
                "rho": (5, "coalesce(rho, 0) + 1e-6"), "baseband_power": (6, "-1e0"), "frame_in_unit": (7, "-1"), "unit_time0": (8, "2e9")}
_BIN_WRONG = {"bin": (1, "64"), "threshold": (2, "location"), "null_fraction": (3, "1.5e0"), "before": (4, "-1e0"), "after": (5, "before * 2")}
_UNIT_WRONG = {"key_rows": (1, "2"), "unit_key": (2, "'x'"), "last_frame": (3, "last_frame + 1"), "unit_time0": (4, "NULL"), "scope": (5, "'neither'")}


def _wrong(wrong, key, step):
    return {k: f"CASE WHEN {key} % {step} = {at} THEN {bad} ELSE {k} END" for k, (at, bad) in wrong.items()}


def _replaced(wrong, key, step):
    return "* REPLACE (" + ", ".join(f"{v} AS {k}" for k, v in _wrong(wrong, key, step).items()) + ")"


def _planted(df, wrong, key, step):
    new = _wrong(wrong, key, step)
    return df.select(*[F.expr(new[k]).alias(k) if k in new else c(k) for k in df.columns])


_HEADER_COLUMNS = {
    "schema_version": "'frame_product_v1'", "detector_version": "concat('det/1.', CAST(physical_channel AS VARCHAR(9)), ' kernel=2.1.0 K=128')", "mask_rule": "'normalized_positive_excess'",
    "weight_bank_sha256": "repeat('ab', 32)", "weight_manifest_sha256": "repeat('cd', 32)", "contract_schema": "'detector_contract_v1'", "fine_pad_factor": "2",
    "freq_id": "CAST(floor((800e6 - (470e6 + (physical_channel - 14) * 6e6 + 309441e0)) / 390625e0 + 0.5e0) AS BIGINT)", "nfft": "16384", "window_samples": "128", "n_streams": "2048",
    "pilot_hz": "470e6 + (physical_channel - 14) * 6e6 + 309441e0", "coarse_hz": "800e6 - floor((800e6 - (470e6 + (physical_channel - 14) * 6e6 + 309441e0)) / 390625e0 + 0.5e0) * 390625e0", "pilot_in_band": "1",
    "null_power_ratio": "2e0 * target_norm_sq / reference_norm_sum_sq", "rational_overflow_count": "0", "fine_status": "'enabled'", "fine_bins": "256", "spectrum_bins": "16384"}
_BIN_COLUMNS = {"threshold": "x + 1e0", "location": "x", "null_fraction": "5e-1", "before": "x", "after": "CASE WHEN x <= 1.05e0 THEN x ELSE 0e0 END"}
_KEYS = {"header": "CAST(physical_channel AS VARCHAR(9))", "frames": "concat(CAST(physical_channel AS VARCHAR(9)), '/', CAST(event_id AS VARCHAR(20)), '/', CAST(row_number AS VARCHAR(9)))",
         "fine": "concat(CAST(frame_id AS VARCHAR(20)), '/', CAST(place AS VARCHAR(9)))", "units": "concat(CAST(physical_channel AS VARCHAR(9)), '/', CAST(event_id AS VARCHAR(20)))"}
_as = lambda columns: ", ".join(f"{v} AS {k}" for k, v in columns.items())


@query("audit_catalogue", with_(UNITS, FINE) + f"""
, hd AS (SELECT {_replaced(_HEADER_WRONG, 'physical_channel', 4)} FROM (SELECT physical_channel, target_norm_sq, reference_norm_sum_sq, {_as(_HEADER_COLUMNS)} FROM (SELECT DISTINCT physical_channel, target_norm_sq, reference_norm_sum_sq FROM v))),
fm AS (SELECT {_replaced(_FRAME_WRONG, 'event_id', 1013)} FROM (SELECT *, f / mu0 - 1 AS rho, frame_in_unit AS row_number FROM v)),
fb AS (SELECT {_replaced(_BIN_WRONG, 'frame_id', 97)} FROM (SELECT *, bin AS place, {_as(_BIN_COLUMNS)} FROM fine)),
ut AS (SELECT {_replaced(_UNIT_WRONG, 'event_id', 1013)} FROM (SELECT *, n_frames - 1 AS last_frame, 1 AS key_rows FROM u)),
""" + catalogue.audit_sql({"header": ("hd", _KEYS["header"]), "frames": ("fm", _KEYS["frames"]), "fine": ("fb", _KEYS["fine"]), "units": ("ut", _KEYS["units"])}))
def audit_catalogue(spark, d):
    """All rules over headers, frames, fine bins and units with violations planted under each.

    Frames are joined and numbered once and written; headers, frame rules and units read that table."""
    df = V.with_detector(materialize(V.frames(spark, d)))
    header = df.select("physical_channel", "target_norm_sq", "reference_norm_sum_sq").distinct().selectExpr("*", *[f"{v} AS {k}" for k, v in _HEADER_COLUMNS.items()])
    frames = df.selectExpr("*", "f / mu0 - 1 AS rho", "frame_in_unit AS row_number")
    bins = V.fine_bins(V.fine(spark, d)).selectExpr("*", "bin AS place", *[f"{v} AS {k}" for k, v in _BIN_COLUMNS.items()])
    u = V.units_of(spark, d, df, F.max("frame_in_unit").cast("long").alias("last_frame"))
    units = u.withColumn("key_rows", F.count(F.lit(1)).over(W.partitionBy("unit_key")))
    return catalogue.audit({
        "header": (_planted(header, _HEADER_WRONG, "physical_channel", 4), _KEYS["header"]),
        "frames": (_planted(frames, _FRAME_WRONG, "event_id", 1013), _KEYS["frames"]),
        "fine": (_planted(bins, _BIN_WRONG, "frame_id", 97), _KEYS["fine"]),
        "units": (_planted(units, _UNIT_WRONG, "event_id", 1013), _KEYS["units"])})


@query("event_key_derivation", with_(UNITS) + "SELECT unit_key, 'ns/wrong' AS source_event_key FROM u WHERE event_id % 300 = 0")
def key_derivation(spark, d):
    u = V.units(spark, d)
    key = keys.source_event_key(c("unit_key"), c("freq_id"))
    u = u.withColumn("source_event_key", F.when(c("event_id") % 300 == 0, F.lit("ns/wrong")).otherwise(key))
    return K.key_derivation_violations(u).select("unit_key", "source_event_key")


@query("run_comparison", with_(FRAMES) + """
SELECT physical_channel, count(*) AS rows_first, count(*) FILTER (event_id % 400 <> 0) AS rows_second, count(*) FILTER (event_id % 400 = 0) AS only_first, CAST(0 AS BIGINT) AS only_second FROM v GROUP BY 1""")
def run_comparison(spark, d):
    a = V.detector_frames(spark, d)
    return K.compare_runs(a, a.where(c("event_id") % 400 != 0), ["event_id", "frame_in_unit", "p_target", "p_ref_sum", "valid", "reject"])


@query("run_spectra_comparison", with_(SPECTRUM) + """
SELECT spectrum_id, round(max(power*CASE WHEN spectrum_id = 2 THEN 1e-3 ELSE 0 END), 9) AS gap, round(max(power), 9) AS peak, CAST(0 AS BIGINT) AS missing_bins, spectrum_id <> 2 AS same FROM spec GROUP BY 1""")
def spectra_comparison(spark, d):
    a = V.spectrum(spark, d).select("spectrum_id", "bin", c("power").alias("before"), c("power").alias("after"))
    b = a.withColumn("before", c("before") * F.when(c("spectrum_id") == 2, 1.001).otherwise(1.0))
    return rounded(K.compare_spectra(a, b, ["spectrum_id"]), "gap", "peak")


@query("run_totals", with_(FRAMES) + "SELECT physical_channel, count(*) AS frames, count(DISTINCT event_id) AS units FROM v GROUP BY 1")
def run_totals(spark, d):
    return K.run_totals(V.frames(spark, d))


# ------------------------------------------------------------------- products
def frame_product(df):
    """Detector frames in the stored layout."""
    dec = lambda k: c(k).cast("decimal(20,0)").alias(k)
    return df.select(
        V.freq_id(c("physical_channel")).alias("freq_id"), "physical_channel", c("event_id").alias("unit_index"), "frame_in_unit",
        dec("p_target"), dec("p_ref_sum"), "target_norm_sq", "reference_norm_sum_sq", c("f").alias("coarse_power_ratio"),
        (c("f") / c("mu0") - 1).alias("normalized_pilot_excess"), "valid", c("reject").alias("reject_mask"), "baseband_power",
        F.lit(None).cast("array<float>").alias("fine_ratio"))


@query("product_generation_round_trip", with_(FRAMES) + f"""
SELECT {FREQ_ID} AS freq_id, physical_channel, count(*) AS n, CAST(sum(p_target) AS BIGINT) AS p_target, count(*) FILTER (reject) AS masked FROM v GROUP BY 1, 2""")
def product_round_trip(spark, d):
    """Writes two generations and reads the newest one."""
    root = scratch(spark, "products")
    df = V.detector_frames(spark, d)
    products.write_products(root, products.new_generation(), {"frames": frame_product(df.where("physical_channel = 14"))})
    products.write_products(root, products.new_generation(), {"frames": frame_product(df)})
    back = products.read_product(spark, root, "frames")
    return back.groupBy("freq_id", "physical_channel").agg(
        F.count(F.lit(1)).alias("n"), F.sum("p_target").cast("long").alias("p_target"), F.count_if("reject_mask").alias("masked"))


def _spectra_product(spark, d):
    """Mean fine ratio per bin, of all frames and of those below 1.05, in the stored layout."""
    bins = V.fine_bins(V.fine(spark, d))
    return bins.groupBy("physical_channel", "bin").agg(F.avg("x").alias("before"), F.avg(F.when(c("x") <= 1.05, c("x"))).alias("after")).select(
        V.freq_id(c("physical_channel")).alias("freq_id"), c("bin").cast("int").alias("bin"), "before", "after")


def _exceedance_product(spark, d):
    bins = V.fine_bins(V.fine(spark, d)).where("x > 1.3")
    return bins.select(V.freq_id(c("physical_channel")).alias("freq_id"), c("unit_id").cast("long").alias("unit_index"),
                       (c("frame_id") % 8).cast("int").alias("frame_in_unit"), c("bin").cast("int").alias("bin"))


def _unit_product(spark, d):
    u = V.units(spark, d)
    return u.select("freq_id", c("event_id").alias("unit_index"), "unit_key", keys.source_event_key(c("unit_key"), c("freq_id")).alias("source_event_key"),
                    "event_id", c("unit_time0").alias("time0"), F.lit(0).cast("long").alias("time0_fpga"), F.lit(2.56e-6).alias("period"), F.lit(2048).alias("n_streams"))


def _whole_generation(spark, d):
    """All four tables and a summary, published together."""
    root, generation = scratch(spark, "generation"), products.new_generation()
    df = V.detector_frames(spark, d)
    summary = df.groupBy("physical_channel").agg(F.count(F.lit(1)).alias("n_frames"), F.count_if("valid").alias("n_valid"), F.count_if("reject").alias("n_masked"))
    products.write_products(root, generation, {
        "frames": frame_product(df), "units": _unit_product(spark, d), "spectra": _spectra_product(spark, d),
        "exceedances": _exceedance_product(spark, d)}, {"mask_summary": summary})
    return root, generation


_PARTS = """, n AS (SELECT 'frames' AS "table", count(*) AS n_rows FROM v UNION ALL SELECT 'units', count(*) FROM u
UNION ALL SELECT 'spectra', count(*) FROM (SELECT DISTINCT physical_channel, bin FROM fine) UNION ALL SELECT 'exceedances', count(*) FILTER (x > 1.3::DOUBLE) FROM fine
UNION ALL SELECT 'mask_summary.csv', count(DISTINCT physical_channel) FROM v)"""


@query("product_generation_tables", with_(UNITS, FINE) + _PARTS + """
SELECT "table", n_rows, CAST(NULL AS VARCHAR) AS refused FROM n""")
def generation_tables(spark, d):
    """Rows of each table of a generation, read back by way of the check of all of them."""
    root, generation = _whole_generation(spark, d)
    out = None
    for name, df in products.read_generation(spark, root, generation).items():
        part = df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("table"), "n_rows", F.lit(None).cast("string").alias("refused"))
        out = part if out is None else out.unionByName(part)
    return out


@query("product_generation_refusal", with_(UNITS, FINE) + _PARTS + """
SELECT "table", n_rows, n_rows + 1 AS found_rows, 'GenerationRefused' AS refused FROM n WHERE "table" IN ('exceedances', 'mask_summary.csv')""")
def generation_refusal(spark, d):
    """One more row in a table and in a summary after publication: both are named and the generation is refused."""
    root, generation = _whole_generation(spark, d)
    extra = schema.conform(products.stamp(_exceedance_product(spark, d).orderBy("unit_index", "frame_in_unit", "bin").limit(1), generation), schema.EXCEEDANCES)
    extra.write.mode("append").partitionBy("generation_id", "freq_id").parquet(f"{root}/exceedances")
    spark.createDataFrame([("14", "1", "1", "0")], "physical_channel string, n_frames string, n_valid string, n_masked string").write.mode("append").option(
        "header", True).csv(f"{root}/mask_summary.csv/generation_id={generation}")
    try:
        products.read_generation(spark, root, generation)
        refused = None
    except products.GenerationRefused as fault:
        refused = type(fault).__name__
    return products.mixed_generations(root, spark, generation).select("table", "n_rows", "found_rows", F.lit(refused).cast("string").alias("refused"))


@query("inventory_round_trip", with_(UNITS) + "SELECT freq_id, scope, count(*) AS n FROM u GROUP BY 1, 2")
def inventory_round_trip(spark, d):
    path = scratch(spark, "inventory")
    products.write_ledger(V.units(spark, d).select("unit_key", "freq_id", "scope", (c("n_frames") * 100).alias("bytes")), path)
    return inventory.read_inventory(spark, path).groupBy("freq_id", "scope").agg(F.count(F.lit(1)).alias("n"))


@query("stack_wide_view", with_(FRAMES) + """
, cm AS (SELECT event_id, frame_in_unit FROM v GROUP BY 1, 2 HAVING count(DISTINCT physical_channel) = 4),
nb AS (SELECT event_id, frame_in_unit, ROW_NUMBER() OVER (ORDER BY min(unit_time0), event_id, frame_in_unit) - 1 AS frame_index FROM v SEMI JOIN cm USING (event_id, frame_in_unit) GROUP BY 1, 2)
SELECT frame_index, max(f) FILTER (physical_channel=14) AS "14", max(f) FILTER (physical_channel=15) AS "15", max(f) FILTER (physical_channel=16) AS "16", max(f) FILTER (physical_channel=17) AS "17" FROM v JOIN nb USING (event_id, frame_in_unit) GROUP BY 1""")
def wide(spark, d):
    df = align.align_and_number(V.detector_frames(spark, d))
    path = scratch(spark, "stack")
    products.write_stack(df.select("frame_index", "physical_channel", "f"), path)
    return products.wide_view(spark.read.parquet(path), "f", [14, 15, 16, 17])


@query("healthy_view", with_(FRAMES) + """
SELECT physical_channel, event_id, frame_in_unit, row_number() OVER (PARTITION BY physical_channel ORDER BY unit_time0, event_id, frame_in_unit) - 1 AS frame_index FROM v WHERE healthy""")
def healthy_view(spark, d):
    df = V.detector_frames(spark, d).select("physical_channel", "event_id", "frame_in_unit", "unit_time0", "healthy")
    return products.healthy_view(df, V.frame_bound(spark, d)).drop("unit_time0", "healthy")


@query("era_view", with_(FRAMES) + """
SELECT physical_channel, event_id, frame_in_unit, row_number() OVER (PARTITION BY physical_channel ORDER BY unit_time0, event_id, frame_in_unit) - 1 AS frame_index FROM v WHERE healthy AND unit_time0 >= 852076800 AND unit_time0 < 883612800""")
def era_view(spark, d):
    df = V.detector_frames(spark, d).where("healthy").select("physical_channel", "event_id", "frame_in_unit", "unit_time0")
    df = df.withColumn("month", clock.month_index(c("unit_time0")))
    first = 1997 * 12 - C.SURVEY_MONTH0
    return products.era_view(df, first, first + 11, max_rows=V.frame_bound(spark, d)).drop("unit_time0", "month")


@query("unit_metadata", with_(UNITS) + """
SELECT unit_key, unit_time0 AS time0, CASE WHEN event_id % 11 <> 0 THEN event_id END AS event_id, CASE WHEN event_id % 13 <> 0 THEN 2.56e-6::DOUBLE END AS period FROM u""")
def unit_metadata(spark, d):
    u = V.units(spark, d).select(
        "unit_key", "freq_id", F.lit(5e8).alias("center_hz"), c("unit_time0").alias("time0"), F.lit(0).cast("long").alias("time0_fpga"),
        F.when(c("event_id") % 11 == 0, -1).otherwise(c("event_id")).alias("event_id"),
        F.when(c("event_id") % 13 == 0, float("nan")).otherwise(2.56e-6).alias("period"), F.lit(2048).alias("n_streams"))
    return inventory.unit_metadata(u).select("unit_key", "time0", "event_id", "period")


@query("discover_datasets", with_(UNITS) + """
SELECT physical_channel, freq_id, unit_key AS path, CAST(coalesce(sum(n_frames*16384) OVER (PARTITION BY physical_channel, freq_id ORDER BY unit_key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start_sample,
 n_frames*16384 AS n_samples, row_number() OVER (PARTITION BY physical_channel, freq_id ORDER BY unit_key) AS segment FROM u""")
def discover(spark, d):
    u = V.units(spark, d).select("physical_channel", "freq_id", c("unit_key").alias("path"), (c("n_frames") * C.FRAME_SAMPLES).alias("n_samples"))
    return inventory.discover_datasets(u, max_rows=V.frame_bound(spark, d))


# -------------------------------------------------------------------- streams
STREAM = f""", st AS (SELECT CAST(14 + l_suppkey % 4 AS INT) AS physical_channel, l_orderkey AS event_id, CAST(l_quantity AS BIGINT) AS q, {NOISE} AS noise, l_partkey, l_returnflag, l_discount, l_tax FROM lineitem),
sv AS (SELECT physical_channel, event_id, q*2.56::DOUBLE AS p, NOT (l_discount=0 AND l_tax=0) AND q > 0 AS valid,
 NOT (l_discount=0 AND l_tax=0) AND q*(1000000+noise+CASE WHEN l_returnflag='R' AND physical_channel=17 THEN l_partkey*500 ELSE 0 END)*12000 > (6000+physical_channel-14)*q*2000000 AS reject FROM st)"""
STREAM = STREAM[1:].lstrip()


def _done(query):
    query.awaitTermination()


@query("streaming_chunk_sums", "WITH " + STREAM + """
SELECT CAST(floor(event_id*0.01/10) AS BIGINT) AS chunk, physical_channel, count(*) AS total_count, count(*) FILTER (valid) AS valid_count, count(*) FILTER (valid AND reject) AS masked_count_valid,
 round(sum(p) FILTER (valid), 4) AS power_sum, round(sum(p) FILTER (valid AND NOT reject), 4) AS cleaned_sum FROM sv GROUP BY 1, 2""")
def stream_chunks(spark, d):
    root = scratch(spark, "chunks")
    _done(windows.run_chunks(windows.with_event_time(V.stream_frames(spark, d)), root))
    return rounded(windows.read_chunks(spark, root).drop("late_count", "closed"), "power_sum", "cleaned_sum", digits=4)


def _in_steps(spark, d, name, step, steps, run, seen=lambda df: df):
    """Hands a stream the rows of one table in steps: those of a step are written to a folder and ``run``, then those of the next."""
    rows, folder = table(spark, d, name), scratch(spark, name)
    for k in steps:
        rows.where(step == k).write.mode("append").parquet(f"{folder}/{name}.parquet")
        _done(run(seen(folder)))


LATE = """, md AS (SELECT max(event_id) // 2 AS half FROM sv),
ls AS (SELECT sv.*, CAST(floor(event_id*0.01/10) AS BIGINT) AS chunk, CASE WHEN event_id > half THEN 1 WHEN event_id % 7 = 3 THEN 2 ELSE 0 END AS step FROM sv, md),
wm AS (SELECT max(event_id)*0.01 - 60 AS reached FROM ls WHERE step < 2),
lt AS (SELECT ls.*, step = 2 AND (chunk + 1)*10 <= reached AS late FROM ls, wm)"""


def _with_late_frames(spark, d):
    """The earlier half of the frames, the later half, and then what had been held back of the earlier half."""
    root = scratch(spark, "late")
    half = F.lit(table(spark, d, "lineitem").agg(F.max("l_orderkey")).first()[0] // 2)
    step = F.when(c("l_orderkey") > half, 1).when(c("l_orderkey") % 7 == 3, 2).otherwise(0)
    _in_steps(spark, d, "lineitem", step, (0, 1, 2), lambda df: windows.run_chunks(df, root),
              lambda folder: windows.with_event_time(V.stream_frames(spark, folder, 100000)))
    return root


@query("streaming_chunks_with_late_frames", "WITH " + STREAM + LATE + """
SELECT chunk, physical_channel, count(*) AS total_count, count(*) FILTER (valid) AS valid_count, count(*) FILTER (valid AND reject) AS masked_count_valid,
 round(sum(p) FILTER (valid), 4) AS power_sum, round(sum(p) FILTER (valid AND NOT reject), 4) AS cleaned_sum, count(*) FILTER (late) AS late_count,
 (chunk + 1)*10 <= (SELECT reached FROM wm) AS closed FROM lt GROUP BY 1, 2""")
def stream_late(spark, d):
    return rounded(windows.read_chunks(spark, _with_late_frames(spark, d)), "power_sum", "cleaned_sum", digits=4)


@query("streaming_late_frames", "WITH " + STREAM + LATE + """
SELECT physical_channel, event_id, chunk, count(*) AS n, round(sum(p), 4) AS power_sum FROM lt WHERE late GROUP BY 1, 2, 3""")
def stream_late_frames(spark, d):
    late = windows.late_frames(spark, _with_late_frames(spark, d))
    if late is None:
        return spark.createDataFrame([], "physical_channel int, event_id long, chunk long, n long, power_sum double")
    return rounded(late.groupBy("physical_channel", "event_id", "chunk").agg(
        F.count(F.lit(1)).alias("n"), F.sum("baseband_power").alias("power_sum")), "power_sum", digits=4)


@query("streaming_power_accumulator", "WITH " + STREAM + """
SELECT physical_channel, round(sum(p), 4) AS power_sum, count(*) AS n, count(*) FILTER (valid) AS n_valid FROM sv GROUP BY 1""")
def stream_power(spark, d):
    root = scratch(spark, "power")
    _done(windows.run_accumulator(windows.power_accumulator(V.stream_frames(spark, d)), root))
    return rounded(windows.read_accumulator(spark, root, ("physical_channel",)), "power_sum", digits=4)


@query("streaming_spectrum_accumulator", with_(FINE) + """
SELECT physical_channel, CAST(bin AS INT) AS bin, round(sum(x), 3) AS before, round(coalesce(sum(x) FILTER (x <= 1.05::DOUBLE), 0), 3) AS after, count(*) AS n FROM fine GROUP BY 1, 2""")
def stream_spectrum(spark, d):
    """Three runs of one stream, each going on from the state of the last; the second brings two of the channels only."""
    root = scratch(spark, "spectrum")

    def bins(folder):
        b = stream_table(spark, folder, "embeddings").select((F.lit(14) + c("label") % 4).cast("int").alias("physical_channel"), F.posexplode("embedding").alias("bin", "e"))
        x = (F.lit(1.0).cast("float") + c("e")).cast("double")
        return windows.spectrum_accumulator(b.select("physical_channel", "bin", x.alias("before"), F.when(x <= 1.05, x).otherwise(0.0).alias("after")))

    step = F.when((c("label") % 4 < 2) & (c("vec_id") % 3 == 1), 1).when(c("vec_id") % 3 == 2, 2).otherwise(0)
    _in_steps(spark, d, "embeddings", step, (0, 1, 2), lambda df: windows.run_accumulator(df, root), bins)
    return rounded(windows.read_accumulator(spark, root, ("physical_channel", "bin")), "before", "after", digits=3)


def _unit_key():
    return F.concat_ws("/", c("physical_channel").cast("string"), c("event_id").cast("string"))


@query("incremental_scan", "WITH " + STREAM + """
, un AS (SELECT physical_channel || '/' || event_id AS unit_key, count(*) AS n_frames, round(sum(p), 4) AS power_sum, bool_or(p > 127) AS bad FROM sv GROUP BY 1)
SELECT unit_key, CASE WHEN bad THEN 0 ELSE n_frames END AS n_frames, CASE WHEN bad THEN 0.0::DOUBLE ELSE power_sum END AS power_sum, bad AS quarantined FROM un""")
def incremental_scan(spark, d):
    """Scans twice; the second call finds nothing new."""
    root = scratch(spark, "scan")

    def process(good):
        return good.groupBy("unit_key").agg(F.count(F.lit(1)).alias("n_frames"), F.sum("baseband_power").alias("power_sum"))

    for _ in range(2):
        df = V.stream_frames(spark, d).withColumn("unit_key", _unit_key())
        _done(df.writeStream.foreachBatch(incremental.upsert_units(process, f"{root}/out", f"{root}/bad", c("baseband_power") > 127))
              .option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start())
    parts = incremental.saved(spark, f"{root}/out", f"{root}/bad")
    good = parts.groupBy("unit_key").agg(F.sum("n_frames").alias("n_frames"), F.round(F.sum("power_sum"), 4).alias("power_sum"), F.lit(False).alias("quarantined"))
    bad = incremental.refused_units(spark, f"{root}/bad").select("unit_key", F.lit(0).cast("long").alias("n_frames"), F.lit(0.0).alias("power_sum"), F.lit(True).alias("quarantined"))
    return good.unionByName(bad)


@query("incremental_scan_outcomes", "WITH " + STREAM + """
, un AS (SELECT physical_channel || '/' || event_id AS unit_key, any_value(event_id) AS event_id, count(*) AS n, count(*) FILTER (valid) AS ok, sum(p) AS p, bool_or(p > 127) AS bad, max(event_id % 3) + 1 AS parts FROM sv GROUP BY 1),
oc AS (SELECT *, CASE WHEN bad THEN 'refused' WHEN event_id % 89 = 5 THEN 'unknown' WHEN ok = 0 THEN 'NoValidFrame' END AS error FROM un)
SELECT unit_key, error, coalesce(error = 'NoValidFrame', false) AS failed, CASE WHEN error IS NULL THEN n END AS n_frames, CASE WHEN error IS NULL THEN round(p / ok, 6) END AS mean_power FROM oc""")
def incremental_outcomes(spark, d):
    """A scan against an inventory that misses some units, with units that the processing cannot reduce, in three runs."""
    root = scratch(spark, "outcomes")
    li = table(spark, d, "lineitem")
    inventory_ = li.where(c("l_orderkey") % 89 != 5).select(
        F.concat_ws("/", (F.lit(14) + c("l_suppkey") % 4).cast("int").cast("string"), c("l_orderkey").cast("string")).alias("unit_key"))

    def process(good):
        n, ok, p = F.count(F.lit(1)), F.count_if("valid"), F.sum("baseband_power")
        return good.groupBy("unit_key").agg(n.alias("n_frames"), F.try_divide(p, ok).alias("mean_power"),
                                            F.when(ok == 0, "NoValidFrame").alias("error"))

    run = incremental.upsert_units(process, f"{root}/out", f"{root}/bad", c("baseband_power") > 127, inventory=inventory_)
    _in_steps(spark, d, "lineitem", c("l_orderkey") % 3, (0, 1, 2),
              lambda df: df.withColumn("unit_key", _unit_key()).writeStream.foreachBatch(run).option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start(),
              lambda folder: V.stream_frames(spark, folder, 100000))
    good = incremental.saved(spark, f"{root}/out", f"{root}/bad").select(
        "unit_key", F.lit(None).cast("string").alias("error"), F.lit(False).alias("failed"), "n_frames", F.round("mean_power", 6).alias("mean_power"))
    bad = incremental.refused_units(spark, f"{root}/bad").select("unit_key", F.element_at("errors", 1).alias("error"), "failed")
    return good.unionByName(bad, allowMissingColumns=True)


# ----------------------------------------------------------------- assignment
def _assigned(spark, d):
    """Every unit against the events of its own day and copies, under negative ids, of most events that drifted off it."""
    u = materialize(V.units(spark, d).select("physical_channel", "event_id", "unit_time0", "n_frames", "scope"))
    day = clock.utc_date(c("unit_time0"))
    drift = F.date_add(day, (c("event_id") % 3 - 1).cast("int"))
    un = u.select("physical_channel", c("event_id").alias("id"), c("unit_time0").cast("long").alias("order"), drift.alias("day"), "n_frames")
    ev = u.select("physical_channel", c("event_id").alias("id"), c("event_id").alias("order"), day.alias("day"), "n_frames", c("scope").alias("event_class"))
    more = u.where((c("event_id") % 3 != 1) & (c("event_id") % 4 != 0)).select(
        "physical_channel", (-c("event_id")).alias("id"), c("event_id").alias("order"), drift.alias("day"), "n_frames", c("scope").alias("event_class"))
    return assignment.assign_units(un, ev.unionByName(more))


@query("unit_event_assignment")
def unit_assignment(spark, d):
    return _assigned(spark, d)


@query("assignment_quality")
def assignment_quality(spark, d):
    return assignment.assignment_quality(_assigned(spark, d))
