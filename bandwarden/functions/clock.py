"""Frame time, sidereal time and calendar coordinates.

All fields are taken from UTC seconds with date arithmetic, so results do not
depend on the session time zone.
"""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as C

EPOCH = "timestamp_ntz'1970-01-01 00:00:00'"


def ntz_seconds(ts: Column) -> Column:
    """Seconds since 1970 of a zone-free timestamp, as a double."""
    days = F.datediff(ts.cast("date"), F.lit("1970-01-01").cast("date"))
    seconds = days.cast("long") * 86400 + F.hour(ts) * 3600 + F.minute(ts) * 60
    return seconds.cast("double") + F.extract(F.lit("SECOND"), ts).cast("double")


def utc_date(t: Column) -> Column:
    return F.date_add(F.lit("1970-01-01").cast("date"), F.floor(t / 86400.0).cast("int"))


def utc_hour(t: Column) -> Column:
    return F.floor(F.pmod(t, F.lit(86400.0)) / 3600.0).cast("int")


def utc_ntz(t: Column) -> Column:
    """Zone-free UTC timestamp, cut to whole seconds."""
    return F.expr(EPOCH) + F.make_dt_interval(secs=F.floor(t).cast("decimal(18,6)"))


def civil_ntz(t: Column, zone: str = C.CIVIL_ZONE) -> Column:
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), utc_ntz(t))


def frame_time(t0: Column, frame_in_unit: Column, nfft: int = C.FRAME_SAMPLES,
               period: Column | float = C.SAMPLE_PERIOD_S) -> Column:
    dt = period if isinstance(period, Column) else F.lit(period)
    return t0 + frame_in_unit.cast("double") * F.lit(float(nfft)) * dt


def frame_duration(nfft: int = C.FRAME_SAMPLES, period: Column | float = C.SAMPLE_PERIOD_S) -> Column:
    dt = period if isinstance(period, Column) else F.lit(period)
    return F.lit(float(nfft)) * dt


def relative_time(frame_index: Column, nfft: int = C.FRAME_SAMPLES,
                  sample_rate: float = C.SAMPLE_RATE_HZ) -> Column:
    """Accumulated data time, not wall clock."""
    return frame_index.cast("double") * F.lit(float(nfft)) / F.lit(sample_rate)


def lmst_hours(t: Column, longitude: float = C.LONGITUDE_EAST_DEG) -> Column:
    """Local mean sidereal hours from the polynomial of Greenwich sidereal degrees."""
    days = t / 86400.0 + 2440587.5 - 2451545.0
    cent = days / 36525.0
    degrees = (F.lit(280.46061837) + F.lit(360.98564736629) * days
               + F.lit(0.000387933) * cent * cent - cent * cent * cent / 38710000.0)
    return F.pmod(degrees + F.lit(longitude), F.lit(360.0)) / 15.0


def solar_hour(t: Column) -> Column:
    return F.floor(F.pmod(t / 3600.0 + F.lit(C.SOLAR_OFFSET_HOURS), F.lit(24.0))).cast("int")


def month_label(date: Column) -> Column:
    return F.concat(F.lpad(F.year(date).cast("string"), 4, "0"), F.lit("-"),
                    F.lpad(F.month(date).cast("string"), 2, "0"))


def month_index(t: Column) -> Column:
    d = utc_date(t)
    return (F.year(d) * 12 + F.month(d) - 1 - C.SURVEY_MONTH0).cast("int")


def quarter_label(t: Column) -> Column:
    d = utc_date(t)
    return F.concat(F.year(d).cast("string"), F.lit("Q"), F.quarter(d).cast("string"))


def hour_label(h: Column) -> Column:
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    return F.concat(two(h), F.lit(":00-"), two(h + 1), F.lit(":00"))


def season(month: Column) -> Column:
    return (F.when(month.isin(12, 1, 2), "DJF").when(month.isin(3, 4, 5), "MAM")
            .when(month.isin(6, 7, 8), "JJA").otherwise("SON"))
