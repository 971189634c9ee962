"""Frame alignment over channels on event and frame identity."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import constants as C
from ..session import materialize
from .gate import require_empty
from .numbering import total_before

IDENTITY = ("event_id", "frame_in_unit")


def duplicate_identities(df: DataFrame) -> DataFrame:
    return df.groupBy("physical_channel", *IDENTITY).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def channel_bit() -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.col("physical_channel") - C.FIRST_CHANNEL)


def common_identities(df: DataFrame, *extra: Column) -> DataFrame:
    """(event, frame) pairs that every channel holds.

    The channels of an identity are bits of one long, so the aggregation has a
    fixed-size state and one shuffle; the bits of all channels are one more
    aggregate."""
    held = df.groupBy(*IDENTITY).agg(F.bit_or(channel_bit()).alias("_bits"), *extra)
    total = df.agg(F.bit_or(channel_bit()).alias("_all"))
    return held.join(F.broadcast(total), F.col("_bits") == F.col("_all")).drop("_bits", "_all")


def align_frames(df: DataFrame, strict: bool = False) -> DataFrame:
    """Frames on identities common to all channels.

    ``strict`` raises on duplicates and on an empty intersection."""
    if strict:
        require_empty(duplicate_identities(df), "duplicate frame identity")
    out = df.join(common_identities(df), list(IDENTITY), "left_semi")
    if strict and out.isEmpty():
        raise ValueError("no frame is common to all channels")
    return out


def drop_counts(df: DataFrame) -> DataFrame:
    """Frames and aligned frames per channel, one pass over a tagged table."""
    common = common_identities(df).withColumn("_c", F.lit(1))
    tagged = df.select("physical_channel", *IDENTITY).join(common, list(IDENTITY), "left")
    return tagged.groupBy("physical_channel").agg(
        F.count(F.lit(1)).alias("n_input"), F.count("_c").alias("n_aligned"),
        (F.count(F.lit(1)) - F.count("_c")).alias("n_dropped"))


def numbered_identities(df: DataFrame) -> DataFrame:
    """Common identities with a contiguous ``frame_index`` by event start, event and frame.

    Only events, of which there are far fewer than frames, are put in order: an event's first number is the count of
    identities in the events before it."""
    ids = common_identities(df, F.min("unit_time0").alias("unit_time0"))
    ids = materialize(ids)
    events = ids.groupBy("event_id").agg(F.min("unit_time0").alias("unit_time0"), F.count(F.lit(1)).alias("_n"))
    starts = total_before(events, ["unit_time0", "event_id"], "_n", "_start").select("event_id", "_start")
    place = F.row_number().over(W.partitionBy("event_id").orderBy("frame_in_unit")) - 1
    return ids.withColumn("_p", place).join(starts, "event_id").select(*IDENTITY, (F.col("_start") + F.col("_p")).alias("frame_index"))


def align_and_number(df: DataFrame) -> DataFrame:
    """Frames of the common identities with their common ``frame_index``: one
    pass finds and numbers the identities, one join brings them to the frames."""
    return df.join(numbered_identities(df), list(IDENTITY))


def event_boundaries(frames: DataFrame) -> DataFrame:
    """First frame of each event run in a numbered common order.

    A run starts where the frame before belongs to another event; frames of an
    event are contiguous, so the run start is the smallest index."""
    return frames.groupBy("event_id").agg(F.min("frame_index").alias("frame_index"))


def frame_numbering_violations(df: DataFrame) -> DataFrame:
    """Units whose frame numbers are not exactly 0..n-1."""
    n = F.count(F.lit(1))
    return df.groupBy("physical_channel", "event_id").agg(
        n.alias("n"), F.min("frame_in_unit").alias("first"), F.max("frame_in_unit").alias("last"),
        F.count_distinct("frame_in_unit").alias("distinct_frames")).where(
        "first <> 0 OR last <> n - 1 OR distinct_frames <> n")


def ulp(x: Column) -> Column:
    """Spacing of doubles at a positive value."""
    return F.pow(F.lit(2.0), F.floor(F.log2(x)) - 52)


def event_metadata_violations(units: DataFrame, channels: int) -> DataFrame:
    """Events of all channels whose id, clock, period or start disagree.

    Needs ``event_key, physical_channel, event_id, time0_fpga, period, unit_time0``
    with NULL for an unknown value; one aggregation, no pairs."""
    known = lambda k: F.count(k)
    spread = F.max("unit_time0") - F.min("unit_time0")
    half = F.lit(0.5) * F.min("period")
    margin = ulp(F.min("unit_time0")) + ulp(F.max("unit_time0"))
    grouped = units.groupBy("event_key").agg(
        F.count(F.lit(1)).alias("n"),
        *[known(k).alias(f"known_{k}") for k in ("event_id", "time0_fpga", "period", "unit_time0")],
        F.count_distinct("event_id").alias("ids"), F.count_distinct("time0_fpga").alias("clocks"),
        (F.max("period") - F.min("period")).alias("period_spread"), F.max("period").alias("period_max"),
        spread.alias("start_spread"), F.greatest(F.lit(0.0), half - margin).alias("start_tolerance"),
    ).where(F.col("n") == channels)
    partial = lambda k: (F.col(f"known_{k}") > 0) & (F.col(f"known_{k}") < F.col("n"))
    reasons = F.array_compact(F.array(
        F.when(partial("event_id") | (F.col("ids") > 1), F.lit("event_id")),
        F.when(partial("time0_fpga") | (F.col("clocks") > 1), F.lit("time0_fpga")),
        F.when(partial("period") | (F.col("period_spread") > 1e-12 * F.col("period_max")), F.lit("period")),
        F.when(partial("unit_time0") | ((F.col("known_unit_time0") > 0) & (F.col("known_period") < F.col("n")))
               | ((F.col("start_spread") > 0) & (F.col("start_spread") >= F.col("start_tolerance"))), F.lit("unit_time0")),
    ))
    return grouped.withColumn("disagrees", reasons).where(F.size("disagrees") > 0)


def attach_units(frames: DataFrame, units: DataFrame) -> DataFrame:
    """Frames with the columns of their unit; a unit is one row, so a hot unit
    is split by the skew join of adaptive execution."""
    return frames.join(units, ["physical_channel", "event_id"])


def control_join(pilot: DataFrame, control: DataFrame) -> DataFrame:
    """Pilot frames with the control frames of the same event and frame."""
    return pilot.join(control, list(IDENTITY))


def latest_per_group(df: DataFrame, keys: list[str], order: Column, k: int = 1) -> DataFrame:
    """First ``k`` rows of each group."""
    return df.withColumn("_rn", F.row_number().over(W.partitionBy(*keys).orderBy(order))).where(
        F.col("_rn") <= k).drop("_rn")
