"""Per-channel summaries and data-time chunks."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import clock, units
from .quantiles import grouped_quantiles


def masked_mean(x: Column, keep: Column) -> Column:
    """Mean over kept samples only; undefined when there are none."""
    return F.avg(F.when(keep & ~F.isnan(x), x))


def mask_counts(valid: Column, mask: Column) -> list[Column]:
    total = F.count(F.lit(1))
    nv, nm = F.count_if(valid), F.count_if(valid & mask)
    return [
        total.alias("total_count"), nv.alias("valid_count"), (total - nv).alias("invalid_count"),
        nm.alias("masked_count_valid"), (nv - nm).alias("unmasked_count_valid"),
        F.when(nv > 0, nm / nv).alias("mask_fraction_valid"),
        F.when(total > 0, nm / total).alias("mask_fraction_total"),
    ]


def mask_summary(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*(keys or ("physical_channel",))).agg(*mask_counts(F.col("valid"), F.col("reject")))


def power_before_after(df: DataFrame) -> DataFrame:
    """Mean power over valid and over kept frames, linear and in decibels."""
    v, m, p = F.col("valid"), F.col("reject"), F.col("baseband_power")
    out = df.groupBy("physical_channel").agg(
        masked_mean(p, v).alias("before_linear"), masked_mean(p, v & ~m).alias("after_linear"),
        F.count_if(v).alias("n_before"), F.count_if(v & ~m).alias("n_after"))
    return out.select("*", units.to_db(F.col("before_linear")).alias("before_db"),
                      units.to_db(F.col("after_linear")).alias("after_db"))


def channel_summary(df: DataFrame) -> DataFrame:
    """Finite counts, mean, largest ratio and the valid and masked shares."""
    f, v, m = F.col("f"), F.col("valid"), F.col("reject")
    fin = f.isNotNull() & ~F.isnan(f)
    return df.groupBy("physical_channel").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(fin).alias("n_finite"), F.avg(F.when(fin, f)).alias("mean_f"),
        F.max(F.when(fin, f)).alias("max_f"), (F.count_if(v) / F.count(F.lit(1))).alias("valid_fraction"),
        F.when(F.count_if(v) > 0, F.count_if(v & m) / F.count_if(v)).alias("mask_fraction"))


def chunk_reductions(df: DataFrame, seconds: float = 10.0, nfft: int = C.FRAME_SAMPLES,
                     sample_rate: float = C.SAMPLE_RATE_HZ, max_rows: int | None = None) -> DataFrame:
    """Fixed-length chunks of accumulated data time per channel.

    Needs ``frame_index`` (common over channels), ``q_db`` and ``shelf_db``.
    Chunk numbers are dense over the chunks that hold frames.
    """
    first = df.agg(F.min("frame_index").alias("_first"))
    t = clock.relative_time(F.col("frame_index") - F.col("_first"), nfft, sample_rate)
    chunked = df.join(F.broadcast(first), F.lit(True)).withColumn("chunk", F.floor(t / F.lit(seconds)))
    v, m, p = F.col("valid"), F.col("reject"), F.col("baseband_power")
    q, s = F.when(v, F.col("q_db")), F.when(v, F.col("shelf_db"))
    aggs = [
        F.min("frame_index").alias("chunk_start_frame"), (F.max("frame_index") + 1).alias("chunk_stop_frame"),
        masked_mean(p, v).alias("input_power_mean"), masked_mean(p, v & ~m).alias("cleaned_power_mean"),
        *mask_counts(v, m), F.max(q).alias("q_db_max"), F.max(s).alias("shelf_db_max"),
    ]
    out = grouped_quantiles(
        chunked, ["chunk", "physical_channel"],
        {"q_db_median": (q, 0.5), "q_db_p95": (q, 0.95), "shelf_db_median": (s, 0.5), "shelf_db_p95": (s, 0.95)},
        aggs, max_rows=max_rows)
    dense = _dense(out.select("chunk").distinct(), "chunk", "chunk_index")
    return out.join(dense, "chunk").drop("chunk")


def _dense(df: DataFrame, col: str, name: str) -> DataFrame:
    """Dense zero-based numbers of distinct values, counted in two levels so
    that no single task sees them all."""
    block = F.floor(F.col(col) / 65536)
    blocks = df.groupBy(block.alias("_b")).agg(F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy(F.floor(F.col("_b") / 65536)).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    starts = blocks.withColumn("_s", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    local = F.row_number().over(W.partitionBy("_b").orderBy(col)) - 1
    return (df.withColumn("_b", block).withColumn("_r", local).join(starts, "_b")
            .select(col, (F.col("_r") + F.col("_s")).cast("long").alias(name)))
