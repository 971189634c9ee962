"""Decibel, shelf signal-to-noise and threshold conversions."""
from __future__ import annotations

import math
from fractions import Fraction

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as C


def to_db(x: Column) -> Column:
    """Decibels of a positive value, else undefined."""
    return F.when(x > 0, F.lit(10.0) * F.log10(x))


def level_db(x: Column, reference: Column, floor: float = 1e-9) -> Column:
    """Level over a reference with the value clipped from below."""
    return F.lit(10.0) * F.log10(F.greatest(x, F.lit(floor)) / reference)


def spreading_db(bin_enbw_hz: Column | float, bandwidth_hz: float = C.SHELF_BANDWIDTH_HZ) -> Column:
    enbw = bin_enbw_hz if isinstance(bin_enbw_hz, Column) else F.lit(float(bin_enbw_hz))
    return F.lit(10.0) * F.log10(F.lit(bandwidth_hz) / enbw)


def capture_db(efficiency: float = C.CAPTURE_EFFICIENCY) -> float:
    if not (efficiency > 0 and math.isfinite(efficiency)):
        raise ValueError("capture efficiency must be positive and finite")
    return 10.0 * math.log10(efficiency)


def excess_to_shelf_db(excess_db: Column, bin_enbw_hz: Column | float = C.COARSE_BIN_HZ,
                       efficiency: float = C.CAPTURE_EFFICIENCY,
                       pilot_below_data_db: float = C.PILOT_BELOW_DATA_DB) -> Column:
    return excess_db + F.lit(pilot_below_data_db) - spreading_db(bin_enbw_hz) - F.lit(capture_db(efficiency))


def shelf_to_excess_db(snr_db: Column, bin_enbw_hz: Column | float = C.COARSE_BIN_HZ,
                       efficiency: float = C.CAPTURE_EFFICIENCY,
                       pilot_below_data_db: float = C.PILOT_BELOW_DATA_DB) -> Column:
    return snr_db - F.lit(pilot_below_data_db) + spreading_db(bin_enbw_hz) + F.lit(capture_db(efficiency))


def composite_to_shelf_db(pilot_below_data_db: float = C.PILOT_BELOW_DATA_DB) -> float:
    """Correction from composite to data-shelf signal-to-noise."""
    return -10.0 * math.log10(1.0 + 10.0 ** (-pilot_below_data_db / 10.0))


def excess_db_to_threshold(excess_db: Column) -> Column:
    """Normalised-ratio threshold ``1 + 10**(x/10)``."""
    return F.lit(1.0) + F.pow(F.lit(10.0), excess_db / 10.0)


def shelf_db_to_threshold(snr_db: Column, **kw) -> Column:
    return excess_db_to_threshold(shelf_to_excess_db(snr_db, **kw))


def _nearest_rational(value: float, limit: int) -> tuple[int, int]:
    best = Fraction(value).limit_denominator(limit)
    return best.numerator, best.denominator


def with_half_rational(thresholds: DataFrame, value: str,
                       limit: int = C.THRESHOLD_MAX_DENOMINATOR) -> DataFrame:
    """Best rational ``half_num/half_den`` of a power-ratio column.

    The table holds one row per channel and threshold, so an Arrow UDF with
    Python integers is enough; the comparison it feeds stays in the JVM.
    """
    @F.pandas_udf("half_num decimal(38,0), half_den decimal(38,0)")
    def approximate(x: pd.Series) -> pd.DataFrame:
        from decimal import Decimal
        pairs = [_nearest_rational(v, limit) if v == v and v is not None else (None, None) for v in x]
        return pd.DataFrame({"half_num": [None if a is None else Decimal(a) for a, _ in pairs],
                             "half_den": [None if b is None else Decimal(b) for _, b in pairs]})
    return thresholds.withColumn("_r", approximate(F.col(value))).select("*", "_r.*").drop("_r")
