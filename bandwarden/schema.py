"""Fixed, versioned table layouts and their enforcement."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCHEMA_VERSION = "frame_product_v1"

_TYPES = {
    "string": T.StringType(), "long": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(),
    "boolean": T.BooleanType(), "binary": T.BinaryType(), "u64": T.DecimalType(20, 0), "floats": T.ArrayType(T.FloatType()),
}


def _layout(text: str) -> T.StructType:
    """Layout from ``name type`` pairs; needs no session."""
    return T.StructType([T.StructField(n, _TYPES[t]) for n, t in (part.split() for part in text.split(","))])


FRAMES = _layout(
    "schema_version string, generation_id string, freq_id long, physical_channel int, unit_index long, frame_in_unit int, "
    "p_target u64, p_ref_sum u64, target_norm_sq long, reference_norm_sum_sq long, "
    "coarse_power_ratio double, normalized_pilot_excess double, valid boolean, reject_mask boolean, "
    "baseband_power double, fine_ratio floats")
UNITS = _layout(
    "schema_version string, generation_id string, freq_id long, unit_index long, unit_key string, source_event_key string, "
    "event_id long, time0 double, time0_fpga long, period double, n_streams int")
SPECTRA = _layout(
    "schema_version string, generation_id string, freq_id long, bin int, before double, after double")
EXCEEDANCES = _layout(
    "schema_version string, generation_id string, freq_id long, unit_index long, frame_in_unit int, bin int")
INVENTORY = _layout("unit_key string, freq_id long, scope string, bytes long, _corrupt_record string")
QUARANTINE = _layout("unit_key string, error string, failed boolean")
BLOCKS = _layout("unit_key string, freq_id long, start_sample long, n_streams int, payload binary")

TABLES = {"frames": FRAMES, "units": UNITS, "spectra": SPECTRA, "exceedances": EXCEEDANCES}


class SchemaRefused(ValueError):
    """Raised where a table does not have exactly the current layout."""


def conform(df: DataFrame, layout: T.StructType, version: str | None = SCHEMA_VERSION) -> DataFrame:
    """``df`` with exactly the fields of the layout; other names or types are
    refused rather than converted."""
    have = {f.name: f.dataType for f in df.schema}
    want = {f.name: f.dataType for f in layout}
    wrong = sorted([n for n in want if n not in have] + [n for n in have if n not in want])
    wrong += [f"{n}: {have[n].simpleString()} is not {t.simpleString()}" for n, t in want.items()
              if n in have and have[n].simpleString() != t.simpleString()]
    if wrong:
        raise SchemaRefused(f"layout differs: {wrong}")
    out = df.select(*want)
    if version is not None and "schema_version" in want:
        old = out.where(~F.col("schema_version").eqNullSafe(F.lit(version))).select("schema_version").take(1)
        if old:
            raise SchemaRefused(f"version {old[0][0]} is not {version}")
    return out
