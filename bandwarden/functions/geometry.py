"""Channel geometry and spectral axes."""
from __future__ import annotations

from pyspark.sql import Column, SparkSession, DataFrame
from pyspark.sql import functions as F

from .. import constants as C


def lower_edge_hz(channel: Column) -> Column:
    return F.lit(C.FIRST_CHANNEL_LOWER_EDGE_HZ) + (channel - C.FIRST_CHANNEL) * F.lit(C.CHANNEL_WIDTH_HZ)


def center_hz(channel: Column) -> Column:
    return lower_edge_hz(channel) + F.lit(C.CHANNEL_WIDTH_HZ / 2)


def pilot_hz(channel: Column) -> Column:
    return lower_edge_hz(channel) + F.lit(C.PILOT_OFFSET_HZ)


def freq_id_of(center: Column) -> Column:
    """Coarse channel of a centre frequency, rounded half to even."""
    return F.bround((F.lit(C.BAND_TOP_HZ) - center) / F.lit(C.SAMPLE_RATE_HZ)).cast("long")


def coarse_center_hz(freq_id: Column) -> Column:
    return F.lit(C.BAND_TOP_HZ) - freq_id * F.lit(C.SAMPLE_RATE_HZ)


def pilot_in_channel(channel: Column, freq_id: Column) -> Column:
    return F.abs(pilot_hz(channel) - coarse_center_hz(freq_id)) <= F.lit(C.SAMPLE_RATE_HZ / 2)


def nearest_channel(frequency: Column, tolerance_hz: float = C.CHANNEL_MATCH_TOLERANCE_HZ) -> Column:
    """Nearest television channel of a pilot-like frequency within tolerance.

    Pilots are equally spaced, so the nearest one is arithmetic, not a search;
    a tie goes to the lower channel."""
    raw = (frequency - F.lit(C.FIRST_CHANNEL_LOWER_EDGE_HZ + C.PILOT_OFFSET_HZ)) / F.lit(C.CHANNEL_WIDTH_HZ)
    ch = F.least(F.greatest(F.ceil(raw - 0.5) + C.FIRST_CHANNEL, F.lit(C.FIRST_CHANNEL)), F.lit(C.LAST_CHANNEL))
    return F.when(F.abs(pilot_hz(ch) - frequency) <= tolerance_hz, ch.cast("int"))


def parse_channels(spec: str) -> list[int]:
    """Channel numbers of a text such as ``14,18:20,36``; ranges include both ends."""
    out: list[int] = []
    for item in (part.strip() for part in spec.split(",")):
        if not item:
            continue
        ends = [int(x) for x in item.split(":", 1)]
        for value in ends:
            if not C.FIRST_CHANNEL <= value <= C.LAST_CHANNEL:
                raise ValueError(f"channel {value} is outside {C.FIRST_CHANNEL}-{C.LAST_CHANNEL}")
        first, last = ends[0], ends[-1]
        step = 1 if last >= first else -1
        out += range(first, last + step, step)
    if not out:
        raise ValueError("no channel selected")
    return out


def channel_table(spark: SparkSession) -> DataFrame:
    """All channels with edges, pilot and coarse channel (56 rows)."""
    ch = F.col("physical_channel")
    return (
        spark.range(C.FIRST_CHANNEL, C.LAST_CHANNEL + 1)
        .select(F.col("id").cast("int").alias("physical_channel"))
        .select(ch, lower_edge_hz(ch).alias("lower_edge_hz"), center_hz(ch).alias("center_hz"),
                pilot_hz(ch).alias("pilot_hz"), freq_id_of(pilot_hz(ch)).alias("freq_id"))
    )


def centered_bin(b: Column, n: int = C.FINE_BINS) -> Column:
    """Bin index moved to ``[-n/2, n/2)``."""
    return F.pmod(b + n // 2, F.lit(n)) - n // 2


def fine_offset_hz(b: Column, n: int = C.FINE_BINS, envelope_hz: float = C.COARSE_BIN_HZ) -> Column:
    return centered_bin(b, n).cast("double") * F.lit(envelope_hz / n)


def circular_delta(measured: Column, predicted: Column, n: int) -> Column:
    """Signed distance on a circular axis of even size."""
    return F.pmod(measured - predicted + n // 2, F.lit(n)) - n // 2


def circular_window(anchor: Column, half_width: int, n: int) -> Column:
    steps = F.sequence(F.lit(-half_width), F.lit(half_width))
    return F.transform(steps, lambda k: F.pmod(anchor + k, F.lit(n)))


def in_circular_window(b: Column, anchor: Column, half_width: int, n: int) -> Column:
    return F.abs(circular_delta(b, anchor, n)) <= half_width


def predicted_fine_bin(pilot: Column, center: Column, sense: Column,
                       sample_rate: float = C.SAMPLE_RATE_HZ, window: int = C.WINDOW_SAMPLES,
                       n: int = C.FINE_BINS) -> Column:
    """Fine bin where the pilot lands: residual to the nearest coarse bin."""
    coarse = sample_rate / window
    effective = sense * (pilot - center)
    residual = effective - F.bround(effective / coarse) * F.lit(coarse)
    return F.pmod(F.bround(residual / (coarse / n)).cast("int"), F.lit(n))


def spectrum_offset_hz(b: Column, n: int, sense: Column, center: Column, pilot: Column,
                       spacing_hz: float) -> Column:
    """Offset of a natural-order spectrum bin from the pilot."""
    signed = F.when(b < n // 2, b).otherwise(b - n).cast("double") * F.lit(spacing_hz)
    return center + sense * signed - pilot


def marginal_bin(rf: Column, center: Column, sense: Column, window: int = C.WINDOW_SAMPLES,
                 sample_rate: float = C.SAMPLE_RATE_HZ) -> Column:
    """Window bin nearest a sky frequency, undefined outside the coarse channel."""
    base = sense * (rf - center)
    b = F.pmod(F.bround(base / (sample_rate / window)).cast("int"), F.lit(window))
    return F.when(F.abs(base) <= sample_rate / 2, b)
