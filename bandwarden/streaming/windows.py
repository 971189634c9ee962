"""Data-time chunks with a side table for late frames, and running accumulators."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .tables import batch_table, put_batch

SUMS = ("total_count", "valid_count", "masked_count_valid", "power_sum", "cleaned_sum")


def with_event_time(df: DataFrame, seconds: str = "data_time") -> DataFrame:
    """Data time in seconds as a timestamp for windows and watermarks."""
    return df.withColumn("event_time", F.timestamp_micros(F.round(F.col(seconds) * 1e6).cast("long")))


def _frame_sums() -> list[Column]:
    p, v, m = F.col("baseband_power"), F.col("valid"), F.col("reject")
    return [F.count(F.lit(1)).alias("total_count"), F.count_if(v).alias("valid_count"), F.count_if(v & m).alias("masked_count_valid"),
            F.sum(F.when(v, p)).alias("power_sum"), F.sum(F.when(v & ~m, p)).alias("cleaned_sum")]


def chunk_sums(df: DataFrame, seconds: float = 10.0, delay: str = "1 minute") -> DataFrame:
    """Tumbling chunks of data time per channel as one windowed aggregation: counts and power sums.

    As a stream it holds open chunks in the state store and drops frames later than the watermark; ``run_chunks`` keeps these."""
    w = F.window("event_time", f"{seconds:g} seconds")
    out = df.withWatermark("event_time", delay).groupBy(w.alias("w"), "physical_channel").agg(*_frame_sums())
    return out.select(F.floor(F.unix_micros("w.start") / F.lit(round(seconds * 1e6))).alias("chunk"), "physical_channel", *SUMS)


# ------------------------------------------------------------ chunks and late frames
def watermark(spark: SparkSession, root: str, before: int | None = None) -> int | None:
    """Microseconds that all frames up to now, or those of the batches before one, have passed: the latest less the delay."""
    steps = batch_table(spark, f"{root}/progress")
    if steps is None:
        return None
    if before is not None:
        steps = steps.where(F.col("batch_id") < before)
    return steps.agg(F.max(F.col("latest") - F.col("delay"))).first()[0]


def chunk_batch(root: str, seconds: float = 10.0, delay: float = 60.0) -> Callable[[DataFrame, int], None]:
    """Batch function of a chunk stream that is safe to repeat.

    A frame is late when its chunk had ended at the watermark, which the batches before this one set: so a replay judges
    alike.  Sums can be merged, so a batch writes sums of its own frames only, on-time and late ones apart, and late frames
    themselves to a table of their own; nothing is carried from batch to batch but the watermark."""
    width, lag = round(seconds * 1e6), round(delay * 1e6)

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        reached = watermark(spark, root, batch_id)
        chunk = F.floor(F.unix_micros("event_time") / F.lit(width))
        late = F.lit(False) if reached is None else (chunk + 1) * width <= reached
        rows = batch.withColumn("chunk", chunk).withColumn("late", late)
        sums = rows.groupBy("chunk", "physical_channel", "late").agg(*_frame_sums(), F.max(F.unix_micros("event_time")).alias("latest"))
        put_batch(sums, f"{root}/sums", batch_id)
        mine = batch_table(spark, f"{root}/sums").where(F.col("batch_id") == batch_id)
        done = mine.agg(F.max("latest").alias("latest"), F.lit(lag).alias("delay"), F.coalesce(F.sum("total_count"), F.lit(0)).alias("frames"),
                        F.coalesce(F.sum(F.when(F.col("late"), F.col("total_count"))), F.lit(0)).alias("late_frames")).collect()
        if done[0]["late_frames"]:
            put_batch(rows.where("late").drop("late"), f"{root}/late", batch_id)
        put_batch(spark.createDataFrame(done, "latest long, delay long, frames long, late_frames long"), f"{root}/progress", batch_id)
    return run


def run_chunks(df: DataFrame, root: str, seconds: float = 10.0, delay: float = 60.0) -> StreamingQuery:
    """Chunks all frames not seen before and stops; call again to go on.  ``df`` needs ``event_time``."""
    return (df.writeStream.foreachBatch(chunk_batch(root, seconds, delay)).option("checkpointLocation", f"{root}/state")
            .trigger(availableNow=True).start())


def read_chunks(spark: SparkSession, root: str, seconds: float = 10.0, late: bool = True) -> DataFrame:
    """Sums per chunk and channel, ``late_count`` and whether the watermark has closed the chunk.

    With ``late`` the late frames are merged, and the sums are those of all frames; without, those of on-time ones."""
    parts = batch_table(spark, f"{root}/sums")
    if not late:
        parts = parts.where(~F.col("late"))
    out = parts.groupBy("chunk", "physical_channel").agg(
        *[F.sum(s).alias(s) for s in SUMS], F.coalesce(F.sum(F.when(F.col("late"), F.col("total_count"))), F.lit(0)).alias("late_count"))
    return out.withColumn("closed", (F.col("chunk") + 1) * round(seconds * 1e6) <= F.lit(watermark(spark, root)))


def late_frames(spark: SparkSession, root: str) -> DataFrame | None:
    """The frames that came after their chunk had closed, with the batch that brought them; None as long as there are none."""
    return batch_table(spark, f"{root}/late")


# ------------------------------------------------------------ running accumulators
def spectrum_accumulator(bins: DataFrame, keys: tuple[str, ...] = ("physical_channel", "bin")) -> DataFrame:
    """Running sums per channel and bin, one row of state for each."""
    return bins.groupBy(*keys).agg(F.sum("before").alias("before"), F.sum("after").alias("after"), F.count(F.lit(1)).alias("n"))


def power_accumulator(frames: DataFrame) -> DataFrame:
    return frames.groupBy("physical_channel").agg(
        F.sum("baseband_power").alias("power_sum"), F.count(F.lit(1)).alias("n"), F.count_if("valid").alias("n_valid"))


def run_accumulator(totals: DataFrame, root: str) -> StreamingQuery:
    """Runs a streaming aggregation in update mode: a batch writes the totals of the keys it has changed, no others.

    State is one row for each key, in the state store under ``root``; a later call goes on from there."""
    return (totals.writeStream.outputMode("update").foreachBatch(lambda batch, batch_id: put_batch(batch, f"{root}/totals", batch_id))
            .option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start())


def read_accumulator(spark: SparkSession, root: str, keys: tuple[str, ...]) -> DataFrame:
    """The latest totals of every key."""
    rows = batch_table(spark, f"{root}/totals")
    values = [c for c in rows.columns if c not in (*keys, "batch_id")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch_id").alias("v")).select(*keys, *[F.col(f"v.{c}").alias(c) for c in values])
