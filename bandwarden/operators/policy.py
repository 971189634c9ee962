"""Applying a threshold policy and the verdicts that follow from it."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import clock, units
from .quantiles import grouped_quantiles


def apply_policy(df: DataFrame, eta: float = 1.4, min_n: int = 5) -> DataFrame:
    """Monthly masked share under the stored rule and under ``eta * mu0``."""
    f, mu0, n = F.col("f"), F.col("mu0"), F.count(F.lit(1))
    g = df.where("healthy").groupBy("physical_channel", clock.month_index(F.col("unit_time0")).alias("month")).agg(
        n.alias("n"), (F.count_if(f > mu0) / n).alias("masked_stored"), (F.count_if(f > mu0 * eta) / n).alias("masked_policy"))
    enough = F.col("n") >= min_n
    return g.withColumns({k: F.when(enough, F.col(k)) for k in ("masked_stored", "masked_policy")})


def kept_excess(df: DataFrame, eta: float = 1.4, max_rows: int | None = None) -> DataFrame:
    """Median, p99 and largest excess of the frames the policy keeps."""
    kept = df.where(F.col("healthy") & (F.col("f") <= F.col("mu0") * eta)).select(
        "physical_channel", units.level_db(F.col("f"), F.col("mu0")).alias("x"))
    return grouped_quantiles(kept, ["physical_channel"], {"median_db": ("x", 0.5), "p99_db": ("x", 0.99)},
                             [F.max("x").alias("max_db"), F.count(F.lit(1)).alias("n")], max_rows=max_rows)


def disposition(shift_db: Column, occupancy: Column) -> Column:
    """Verdict from the null shift and the occupancy at the channel's factor."""
    return (F.when((shift_db > C.CARRIER_DOMINATED_DB) | (occupancy >= C.EXCISE_OCCUPANCY), "excise")
            .when(occupancy <= C.CLEAN_OCCUPANCY, "keep, light masking").otherwise("keep, heavy masking"))


def channel_dispositions(coarse: DataFrame, verdicts: DataFrame, pending: Sequence[int] = ()) -> DataFrame:
    """Keep or discard for each coarse channel from all allocations it touches, scanned or not.

    ``coarse``: freq_id; ``verdicts``: physical_channel, kept.  Allocations in ``pending`` count as kept until they have
    a verdict.  Touched allocations are at most two consecutive numbers, found by arithmetic."""
    mid = F.lit(C.BAND_TOP_HZ) - F.col("freq_id") * F.lit(C.SAMPLE_RATE_HZ)
    lo, hi = mid - C.SAMPLE_RATE_HZ / 2, mid + C.SAMPLE_RATE_HZ / 2
    place = lambda x: (x - C.FIRST_CHANNEL_LOWER_EDGE_HZ) / C.CHANNEL_WIDTH_HZ + C.FIRST_CHANNEL
    first = F.greatest(F.floor(place(lo)), F.lit(C.FIRST_CHANNEL)).cast("int")
    last = F.least(F.ceil(place(hi)) - 1, F.lit(C.LAST_ALLOCATION)).cast("int")
    touch = coarse.select("freq_id", lo.alias("f_lo"), hi.alias("f_hi"), F.explode(F.sequence(first, last)).alias("physical_channel"))
    pilot_fid = F.bround((F.lit(C.BAND_TOP_HZ) - (C.FIRST_CHANNEL_LOWER_EDGE_HZ + (F.col("physical_channel") - C.FIRST_CHANNEL)
                                                  * C.CHANNEL_WIDTH_HZ + C.PILOT_OFFSET_HZ)) / C.SAMPLE_RATE_HZ)
    j = touch.join(F.broadcast(verdicts.select("physical_channel", "kept")), "physical_channel", "left")  # one row a channel
    held = F.coalesce("kept", F.col("physical_channel").isin(list(pending)) if pending else F.lit(False))
    monitor = F.coalesce(~F.col("kept"), F.lit(False)) & (pilot_fid == F.col("freq_id"))
    g = j.groupBy("freq_id", "f_lo", "f_hi").agg(
        F.count(F.lit(1)).alias("n"), F.bool_or(held).alias("any_kept"), F.bool_or(monitor).alias("pilot"),
        F.min("physical_channel").alias("a"), F.max("physical_channel").alias("b"))
    shared, a = F.col("n") == 2, F.col("a").cast("string")
    outer = ~shared & ((F.col("f_lo") < C.FIRST_CHANNEL_LOWER_EDGE_HZ)
                       | (F.col("f_hi") > C.FIRST_CHANNEL_LOWER_EDGE_HZ + C.CHANNEL_WIDTH_HZ * (C.LAST_ALLOCATION - C.FIRST_CHANNEL + 1)))
    pair = F.concat(F.lit("edge shared: ch"), a, F.lit("/ch"), F.col("b").cast("string"))
    reason = (F.when(F.col("any_kept"), F.when(shared, pair).otherwise(F.concat(F.lit("kept allocation ch"), a)))
              .when(F.col("pilot"), F.concat(F.lit("pilot monitor, excised ch"), a))
              .when(shared, F.concat(pair, F.lit(", both excised")))
              .when(outer, "band edge (shares non-DTV spectrum)").otherwise(F.concat(F.lit("interior of excised ch"), a)))
    keep = F.col("any_kept") | F.col("pilot") | outer
    return g.select("freq_id", "f_lo", "f_hi", F.when(keep, "keep").otherwise("discard").alias("disposition"), reason.alias("reason"))


def contiguous_ranges(df: DataFrame, keys: list[str], number: str = "freq_id") -> DataFrame:
    """First and last of each run of consecutive numbers.

    Runs are found per 4096-wide block and joined where blocks meet, so no
    task orders a whole key."""
    block = F.floor(F.col(number) / 4096)
    w = W.partitionBy(*keys, block).orderBy(number)
    runs = df.select(*keys, number).distinct().withColumn("_i", F.col(number) - F.row_number().over(w)).groupBy(
        *keys, block.alias("_b"), "_i").agg(F.min(number).alias("first"), F.max(number).alias("last"))
    step = W.partitionBy(*keys).orderBy("first")
    new = F.coalesce(F.col("first") != F.lag("last").over(step) + 1, F.lit(True)).cast("int")
    return runs.withColumn("_n", new).withColumn("_g", F.sum("_n").over(step)).groupBy(*keys, "_g").agg(
        F.min("first").alias("first"), F.max("last").alias("last")).drop("_g")
