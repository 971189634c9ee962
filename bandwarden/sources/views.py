"""Survey-shaped views over the star-schema tables.

They are integer arithmetic over the given tables, so a second engine can state
them with the same text.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import clock, exact, geometry
from ..operators.numbering import number_within
from .tables import row_bound, stream_table, table


def frame_bound(spark: SparkSession, folder: str) -> int:
    """Frames come one per lineitem row."""
    return row_bound(spark, folder, "lineitem")


def _base(li: DataFrame) -> DataFrame:
    """Line items as frames before numbering."""
    c = F.col
    noise = (c("l_orderkey") * 7919 + c("l_partkey") * 104729 + c("l_linenumber").cast("long") * 1299709) % 20001 - 10000
    ch = (F.lit(14) + c("l_suppkey") % 4).cast("int")
    return li.select(
        ch.alias("physical_channel"), c("l_orderkey").alias("event_id"), "l_linenumber", "l_partkey",
        "l_suppkey", "l_extendedprice", c("l_quantity").cast("long").alias("q"), noise.alias("noise"),
        ((c("l_returnflag") == "R") & (ch == 17)).alias("tail"),
        ((c("l_discount") == 0) & (c("l_tax") == 0)).alias("dead"))


def _powers(base: DataFrame, *keep: str) -> DataFrame:
    """Powers and baseband power; all fit in 64 bits (at most
    50*(10**6 + 10**4 + 500*partkey))."""
    c = F.col
    return base.select(
        "physical_channel", "event_id", *keep,
        (c("q") * (F.lit(1000000) + c("noise") + F.when(c("tail"), c("l_partkey") * 500).otherwise(0))).alias("p_target"),
        F.when(c("dead"), F.lit(0)).otherwise(c("q") * 2000000).cast("long").alias("p_ref_sum"),
        (c("q").cast("double") * 2.56).alias("baseband_power"))


def _with_norms(powers: DataFrame, *keep: str) -> DataFrame:
    """Adds the norms of the channel."""
    return powers.select(
        "physical_channel", "event_id", *keep, "p_target", "p_ref_sum",
        (F.lit(6000) + F.col("physical_channel") - 14).cast("long").alias("target_norm_sq"),
        F.lit(12000).cast("long").alias("reference_norm_sum_sq"), "baseband_power")


# Rows of a task of the frame exchange, about.
TASK_ROWS = 1 << 18


def _tasks(spark: SparkSession, rows: int) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), rows // TASK_ROWS)


def frames(spark: SparkSession, folder: str) -> DataFrame:
    """Frame rows: powers, norms, baseband power, unit start, frame in unit.

    On a large table one exchange by event, into tasks of about ``TASK_ROWS`` rows,
    serves the numbering, the join and whatever is grouped by unit.  The numbering sorts by
    event first, which is the order the join wants, so a task sorts its frames once."""
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
    rows = frame_bound(spark, folder)
    spread = (_tasks(spark, rows), "event_id") if rows > C.HOT_GROUP_ROWS else None
    numbered = number_within(_powers(_base(table(spark, folder, "lineitem")), *order), ["event_id", "physical_channel"],
                             order, "frame_in_unit", max_rows=rows, spread=spread)
    powers = _with_norms(numbered.withColumn("frame_in_unit", F.col("frame_in_unit").cast("int")), "frame_in_unit")
    orders = table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("event_id"), clock.ntz_seconds(F.col("o_orderdate")).alias("unit_time0"))
    return powers.join(orders, "event_id")


def stream_frames(spark: SparkSession, folder: str, files_per_trigger: int = 1) -> DataFrame:
    """The same powers from a file stream, with data time ten milliseconds per
    event; frames are not numbered because a stream has no order."""
    li = stream_table(spark, folder, "lineitem", maxFilesPerTrigger=files_per_trigger)
    return with_detector(_with_norms(_powers(_base(li)))).withColumn("data_time", F.col("event_id") * 0.01)


def with_detector(df: DataFrame) -> DataFrame:
    """Adds validity, ratio, null ratio, exact mask and the frame gate flag."""
    c = F.col
    p, r, tn, rn = c("p_target"), c("p_ref_sum"), c("target_norm_sq"), c("reference_norm_sum_sq")
    valid = r > 0
    power = c("baseband_power")
    healthy = valid & power.isNotNull() & ~F.isnan(power) & (power >= 0) & (power < C.POWER_CEILING)
    return df.select(
        "*", valid.alias("valid"), exact.coarse_ratio(p, r).alias("f"), exact.null_ratio(tn, rn).alias("mu0"),
        exact.reject_mask(p, r, tn, rn).alias("reject"), healthy.alias("healthy"))


def detector_frames(spark: SparkSession, folder: str) -> DataFrame:
    return with_detector(frames(spark, folder))


def freq_id(channel) :
    return geometry.freq_id_of(geometry.pilot_hz(channel))


def units(spark: SparkSession, folder: str) -> DataFrame:
    """One row per (channel, event): start, frames, trigger scope, keys."""
    return units_of(spark, folder, frames(spark, folder))


def units_of(spark: SparkSession, folder: str, found: DataFrame, *more: Column) -> DataFrame:
    """The units of the frames ``found``, with further aggregates of their frames."""
    c = F.col
    prio = table(spark, folder, "orders").select(
        c("o_orderkey").alias("event_id"),
        F.when(c("o_orderpriority").startswith("5"), "scheduled").otherwise("triggered_event").alias("scope"),
        c("o_orderstatus").alias("status"))
    fid = freq_id(c("physical_channel"))
    per_unit = found.groupBy("physical_channel", "event_id").agg(
        F.min("unit_time0").alias("unit_time0"), F.count(F.lit(1)).alias("n_frames"), *more)
    return (
        per_unit.join(prio, "event_id")
        .select("physical_channel", "event_id", "unit_time0", "n_frames", "scope", fid.alias("freq_id"),
                F.concat(F.lit("ns/"), c("status"), F.lit("/baseband_"), c("event_id").cast("string"),
                         F.lit("_"), fid.cast("string"), F.lit(".h5")).alias("unit_key"),
                *per_unit.columns[4:])
    )


def samples(spark: SparkSession, folder: str) -> DataFrame:
    """Integer samples of 128-sample frames: K = 8, 16 windows, one stream.

    A frame is complete when all of its 128 samples are there; others are left out."""
    ev, c = table(spark, folder, "events"), F.col
    e = c("event_id")
    held = F.count(F.lit(1)).over(W.partitionBy(F.floor(e / 128)))
    return ev.withColumn("_held", held).where("_held = 128").select(
        F.floor(e / 128).cast("int").alias("frame"), (e % 128).cast("int").alias("n"),
        F.floor((e % 128) / 8).cast("int").alias("win"), (e % 8).cast("int").alias("k"),
        (F.round(c("value") * 100).cast("long") % 16 - 8).alias("re"),
        ((c("user_id") * 37 + e * 11) % 16 - 8).alias("im"))


# 7*exp(2j*pi*bin*k/8) rounded to integers for the target bin 1 and the
# references -1 and 3 (fixed values).
WEIGHTS = (
    (0, 0, 7, 0), (0, 1, 5, 5), (0, 2, 0, 7), (0, 3, -5, 5), (0, 4, -7, 0), (0, 5, -5, -5), (0, 6, 0, -7), (0, 7, 5, -5),
    (1, 0, 7, 0), (1, 1, 5, -5), (1, 2, 0, -7), (1, 3, -5, -5), (1, 4, -7, 0), (1, 5, -5, 5), (1, 6, 0, 7), (1, 7, 5, 5),
    (2, 0, 7, 0), (2, 1, -5, 5), (2, 2, 0, -7), (2, 3, 5, 5), (2, 4, -7, 0), (2, 5, 5, -5), (2, 6, 0, 7), (2, 7, -5, -5),
)


def weights(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(WEIGHTS), "term int, k int, wr int, wi int")


def fine(spark: SparkSession, folder: str) -> DataFrame:
    """Fine ratios per frame: 64 bins, padded by two, with a quarter-long epoch."""
    c = F.col
    return table(spark, folder, "embeddings").select(
        c("vec_id").alias("frame_id"), (F.lit(14) + c("label") % 4).cast("int").alias("physical_channel"),
        F.transform("embedding", lambda x: F.lit(1.0).cast("float") + x).alias("fine_ratio"),
        F.floor(c("vec_id") / 8).alias("unit_id"),
        (F.lit(1546300800.0) + c("vec_id").cast("double") * 604800.0).alias("frame_time"))


FINE_VIEW_BINS = 64


def fine_bins(df: DataFrame) -> DataFrame:
    """One row per (frame, bin) with the value as a double."""
    keep = [x for x in df.columns if x != "fine_ratio"]
    return df.select(*keep, F.posexplode("fine_ratio").alias("bin", "_x")).withColumn(
        "x", F.col("_x").cast("double")).drop("_x")


def spectrum(spark: SparkSession, folder: str) -> DataFrame:
    """Mean spectrum per label: (spectrum_id, bin, power), bin 0 the centre."""
    emb = table(spark, folder, "embeddings")
    bins = emb.select(F.col("label").alias("spectrum_id"), F.posexplode("embedding").alias("bin", "e"))
    return bins.groupBy("spectrum_id", "bin").agg(
        F.avg((F.lit(1.0).cast("float") + F.col("e")).cast("double")).alias("power"))


def census(spark: SparkSession, folder: str) -> DataFrame:
    c = F.col
    return table(spark, folder, "supplier").select(
        (F.lit(14) + c("s_suppkey") % 23).cast("int").alias("rf_channel"), c("s_name").alias("callsign"),
        F.when(c("s_nationkey") % 3 == 0, "full_service").when(c("s_nationkey") % 3 == 1, "translator")
        .otherwise("other").alias("service_class"),
        c("s_acctbal").alias("detectability_db"), (c("s_suppkey") + 10).cast("double").alias("distance_km"))


def lines(spark: SparkSession, folder: str) -> DataFrame:
    c = F.col
    return table(spark, folder, "part").select(
        (F.lit(14) + c("p_partkey") % 23).cast("int").alias("rf_channel"), c("p_partkey").alias("line_id"),
        (c("p_retailprice") - 1400).alias("offset_hz"), c("p_size").cast("double").alias("snr_db"))


def trials(spark: SparkSession, folder: str) -> DataFrame:
    """Trial outcomes on a (snr, offset) grid from line items."""
    li, c = table(spark, folder, "lineitem"), F.col
    noise = (c("l_orderkey") * 7919 + c("l_partkey") * 104729 + c("l_linenumber").cast("long") * 1299709) % 20001 - 10000
    return li.select(
        c("l_orderkey").alias("trial"), F.round(c("l_discount") * 100).cast("int").alias("snr_db"),
        F.round(c("l_tax") * 100).cast("int").alias("offset_bin"),
        (F.lit(1.0) + noise.cast("double") / 1e6 + F.round(c("l_discount") * 100) * F.lit(0.001)).alias("ratio"),
        c("l_quantity").alias("power"))
