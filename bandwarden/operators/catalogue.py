"""Rule catalogues: audits as rows of a table, compiled into one pass over each product table.

A rule names its table, itself and, as SQL text, what breaks it; an undefined predicate is a violation.  The report counts
violations and lists the first offending keys of every rule, rules without any included.
"""
from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize

KEYS_LISTED = 3


@dataclass(frozen=True)
class Rule:
    table: str
    name: str
    broken: str


#: Per-channel headers: provenance, geometry and identities; one row a channel.
HEADER_RULES = tuple(Rule("header", *r) for r in (
    ("schema_version", "schema_version <> 'frame_product_v1'"),
    ("detector_version_kernel", "NOT (detector_version LIKE '%kernel=2._.%')"),
    ("detector_version_window", "NOT (detector_version LIKE '%K=128%')"),
    ("mask_rule", "mask_rule <> 'normalized_positive_excess'"),
    ("weight_bank_digest", "length(weight_bank_sha256) <> 64"),
    ("weight_manifest_digest", "length(weight_manifest_sha256) <> 64"),
    ("contract_schema", "contract_schema <> 'detector_contract_v1'"),
    ("contract_fine_pad", "fine_pad_factor <> 2"),
    ("channel_freq_id", "freq_id <> CAST(floor((800e6 - pilot_hz) / 390625e0 + 0.5e0) AS BIGINT)"),
    ("frame_samples", "nfft <> 16384"),
    ("window_samples", "window_samples <> 128"),
    ("input_streams", "n_streams <> 2048"),
    ("pilot_frequency", "abs(pilot_hz - (470e6 + (physical_channel - 14) * 6e6 + 309441e0)) >= 1e0"),
    ("coarse_frequency", "abs(coarse_hz - (800e6 - freq_id * 390625e0)) >= 1e0"),
    ("pilot_in_band", "abs(pilot_hz - coarse_hz) > 390625e0 / 2"),
    ("pilot_in_band_flag", "pilot_in_band <> 1"),
    ("null_power_ratio", "abs(null_power_ratio - 2e0 * target_norm_sq / reference_norm_sum_sq) >= 1e-12"),
    ("rational_overflow", "rational_overflow_count <> 0"),
    ("fine_status", "fine_status <> 'enabled'"),
    ("fine_bins", "fine_bins <> 2 * nfft / window_samples"),
    ("spectrum_length", "spectrum_bins <> nfft"),
))

#: Frames: the exact integer contract and recomputed ratios.
FRAME_RULES = tuple(Rule("frames", *r) for r in (
    ("powers_not_negative", "p_target < 0 OR p_ref_sum < 0"),
    ("valid_denominator", "valid <> (p_ref_sum > 0)"),
    ("mask_rule", "reject <> (p_ref_sum > 0 AND CAST(p_target AS DECIMAL(20,0)) * CAST(reference_norm_sum_sq AS DECIMAL(10,0)) > CAST(p_ref_sum AS DECIMAL(20,0)) * CAST(target_norm_sq AS DECIMAL(10,0)))"),
    ("masked_invalid", "reject AND NOT valid"),
    ("ratio_recomputed", "valid AND abs(f - 2e0 * p_target / CASE WHEN p_ref_sum > 0 THEN p_ref_sum END) > 1e-9 * abs(2e0 * p_target / CASE WHEN p_ref_sum > 0 THEN p_ref_sum END)"),
    ("ratio_undefined_when_invalid", "NOT valid AND f IS NOT NULL"),
    ("excess_recomputed", "valid AND abs(rho - (f / mu0 - 1)) > 1e-12 + 1e-9 * abs(f / mu0 - 1)"),
    ("excess_undefined_when_invalid", "NOT valid AND rho IS NOT NULL"),
    ("power_range", "NOT (baseband_power >= 0 AND baseband_power < 1e6)"),
    ("frame_in_unit", "frame_in_unit < 0"),
    ("unit_time_plausible", "NOT (unit_time0 > 0 AND unit_time0 < 1.9e9)"),
))

#: Fine bins and spectra of a frame: lists, calibration and sums.
BIN_RULES = tuple(Rule("fine", *r) for r in (
    ("bins_in_range", "bin < 0 OR bin >= 64"),
    ("threshold_above_location", "NOT (threshold > location)"),
    ("null_fraction_range", "NOT (null_fraction >= 0 AND null_fraction <= 1)"),
    ("spectrum_not_negative", "before < 0 OR after < 0"),
    ("after_not_above_before", "after > before * (1 + 1e-12) + 1e-6"),
))

#: Units: keys, times and lengths.
UNIT_RULES = tuple(Rule("units", *r) for r in (
    ("unit_key_unique", "key_rows <> 1"),
    ("unit_key_event", "NOT (unit_key LIKE concat('%_', CAST(event_id AS VARCHAR(20)), '_%'))"),
    ("frames_of_unit", "n_frames <> last_frame + 1"),
    ("unit_time", "unit_time0 IS NULL"),
    ("scope_known", "scope NOT IN ('scheduled', 'triggered_event')"),
))
RULES = (*HEADER_RULES, *FRAME_RULES, *BIN_RULES, *UNIT_RULES)


def broken_rules(df: DataFrame, rules: Iterable[Rule], key: str) -> DataFrame:
    """``table``, ``rule``, ``key`` of every violation; rows that break nothing leave in the projection."""
    rules = list(rules)
    named = F.array_compact(F.array(*[F.when(F.coalesce(F.expr(r.broken), F.lit(True)), F.lit(r.name)) for r in rules]))
    return df.select(F.expr(key).alias("key"), F.explode(named).alias("rule")).select(F.lit(rules[0].table).alias("table"), "rule", "key")


def audit(tables: dict[str, tuple[DataFrame, str]], rules: Iterable[Rule] = RULES, listed: int = KEYS_LISTED) -> DataFrame:
    """``table``, ``rule``, ``n``, ``first_keys`` of every rule whose table is given as (rows, key expression)."""
    rules = [r for r in rules if r.table in tables]
    spark = next(iter(tables.values()))[0].sparkSession
    bad = None
    for name, (df, key) in tables.items():
        part = broken_rules(df, [r for r in rules if r.table == name], key)
        bad = part if bad is None else bad.unionByName(part)
    bad = materialize(bad)  # each table is read once; what is written are violations only
    # Counts combine inside tasks, and the limit by rank keeps a rule that all rows break from gathering their keys.
    counts = bad.groupBy("table", "rule").agg(F.count(F.lit(1)).alias("n"))
    order = W.partitionBy("table", "rule").orderBy("key")
    first = bad.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= listed).groupBy("table", "rule").agg(
        F.concat_ws(" ", F.array_sort(F.collect_list("key"))).alias("first_keys"))
    known = spark.createDataFrame([(r.table, r.name) for r in rules], "table string, rule string")
    return known.join(counts, ["table", "rule"], "left").join(first, ["table", "rule"], "left").select(
        "table", "rule", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("first_keys", F.lit("")).alias("first_keys"))


def audit_sql(tables: dict[str, tuple[str, str]], rules: Iterable[Rule] = RULES, listed: int = KEYS_LISTED) -> str:
    """The same report as SQL over named relations, given as (relation, key expression)."""
    rules = [r for r in rules if r.table in tables]
    parts = []
    for name, (relation, key) in tables.items():
        cases = ", ".join(f"CASE WHEN coalesce({r.broken}, true) THEN '{r.name}' END" for r in rules if r.table == name)
        parts.append(f"SELECT '{name}' AS \"table\", {key} AS key, unnest([{cases}]) AS rule FROM {relation}")
    known = ", ".join(f"('{r.table}', '{r.name}')" for r in rules)
    return f"""bad AS (SELECT *, row_number() OVER (PARTITION BY "table", rule ORDER BY key) AS rk FROM ({" UNION ALL ".join(parts)}) WHERE rule IS NOT NULL),
known AS (SELECT * FROM (VALUES {known}) AS k("table", rule))
SELECT known."table", known.rule, count(key) AS n, coalesce(string_agg(key, ' ' ORDER BY key) FILTER (rk <= {listed}), '') AS first_keys FROM known LEFT JOIN bad USING ("table", rule) GROUP BY 1, 2"""


def layout_problems(df: DataFrame, layout: T.StructType, required: Iterable[str] = ()) -> DataFrame:
    """``field``, ``problem`` for every field, nested ones by path, that is missing, unknown, of another type, or null though required."""
    found: list[tuple[str, str]] = []

    def compare(path: str, have: T.DataType, want: T.DataType) -> None:
        if isinstance(have, T.StructType) and isinstance(want, T.StructType):
            fields(path + ".", have, want)
        elif isinstance(have, T.ArrayType) and isinstance(want, T.ArrayType):
            compare(path + "[]", have.elementType, want.elementType)
        elif have.simpleString() != want.simpleString():
            found.append((path, f"{have.simpleString()} is not {want.simpleString()}"))

    def fields(path: str, have: T.StructType, want: T.StructType) -> None:
        mine, other = {f.name: f.dataType for f in have}, {f.name: f.dataType for f in want}
        found.extend((path + n, "missing") for n in other if n not in mine)
        found.extend((path + n, "unknown") for n in mine if n not in other)
        for n in other:
            if n in mine:
                compare(path + n, mine[n], other[n])

    fields("", df.schema, layout)
    out = df.sparkSession.createDataFrame(found, "field string, problem string")
    there = [n for n in required if n in df.columns]
    if not there:
        return out
    empty = df.agg(*[F.count_if(F.col(n).isNull()).alias(n) for n in there])
    rows = F.array(*[F.struct(F.lit(n).alias("field"), F.col(n).alias("n")) for n in there])
    return out.unionByName(empty.select(F.explode(rows).alias("r")).where("r.n > 0").select(
        "r.field", F.concat(F.lit("null in "), F.col("r.n").cast("string"), F.lit(" rows")).alias("problem")))
