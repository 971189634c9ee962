"""Event presence over channels: signatures, subsets, drop curve."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def signatures(df: DataFrame, channels: Sequence[int]) -> DataFrame:
    """Events per presence signature; bit i stands for ``channels[i]``.

    Distinct signatures number at most 2**len(channels), in practice few."""
    bit = F.lit(None).cast("long")
    for i, ch in reversed(list(enumerate(channels))):
        bit = F.when(F.col("physical_channel") == ch, F.lit(1 << i)).otherwise(bit)
    per_event = df.groupBy("event_id").agg(F.bit_or(bit.cast("long")).alias("signature"))
    return per_event.groupBy("signature").agg(F.count(F.lit(1)).alias("n_events"))


def presence_report(df: DataFrame) -> DataFrame:
    """Events per channel, events by number of holders, union and intersection."""
    held = df.select("physical_channel", "event_id").distinct()
    per = held.groupBy("physical_channel").agg(F.count(F.lit(1)).alias("n")).select(
        F.lit("channel").alias("kind"), F.col("physical_channel").cast("long").alias("key"), "n")
    holders = held.groupBy("event_id").agg(F.count(F.lit(1)).alias("key")).groupBy("key").agg(
        F.count(F.lit(1)).alias("n"))
    histogram = holders.select(F.lit("holders").alias("kind"), "key", "n")
    union = holders.agg(F.sum("n").alias("n")).select(F.lit("union").alias("kind"), F.lit(None).cast("long").alias("key"), "n")
    return per.unionByName(histogram).unionByName(union)


def superset_counts(sig: DataFrame, bits: int) -> DataFrame:
    """For each observed signature S: events whose signature contains S, and
    the channels all of them share.

    A signature meets the observed signatures that hold its rarest channel, and of these the ones that contain it are
    added up; signatures that nobody observed are never formed."""
    held = lambda s: F.filter(F.sequence(F.lit(0), F.lit(bits - 1)), lambda i: F.getbit(s, i) == 1)
    wide = sig.select("signature", "n_events", F.explode(F.concat(F.array(F.lit(-1)), held(F.col("signature")))).alias("bit"))
    common = wide.groupBy("bit").agg(F.count(F.lit(1)).alias("holders"))  # one row a channel, and one for all
    rarest = wide.join(F.broadcast(common), "bit").groupBy("signature").agg(F.min_by("bit", F.struct("holders", -F.col("bit"))).alias("bit"))
    over = rarest.alias("s").join(wide.alias("t"), "bit").where(
        F.col("s.signature").bitwiseAND(F.col("t.signature")) == F.col("s.signature"))
    return over.groupBy(F.col("s.signature").alias("signature")).agg(
        F.sum("t.n_events").alias("total"), F.bit_and("t.signature").alias("closed"))


def best_common_subset(sig: DataFrame, bits: int) -> DataFrame:
    """Largest common event count per number of channels; ties to the smaller
    signature."""
    s = superset_counts(sig, bits).withColumn("k", F.bit_count("closed"))
    best = F.max_by(F.struct("total", "closed"), F.struct(F.col("total"), -F.col("closed")))
    return s.groupBy("k").agg(best.alias("b")).select("k", F.col("b.total").alias("common_events"),
                                                     F.col("b.closed").alias("channels_mask"))


def _intersection(kept: int) -> Column:
    return F.sum(F.when(F.col("signature").bitwiseAND(F.lit(kept)) == F.lit(kept), F.col("n_events")).otherwise(0))


def greedy_drop_curve(sig: DataFrame, channels: Sequence[int], growth_percent: float = 10.0,
                      min_channels: int = 2) -> DataFrame:
    """Remove the channel that constrains the common events most, repeatedly.

    Ties go to fewer own events, then to the smaller id.  ``accepted`` follows
    the registered rule: growth by the given percent, enough channels left.
    Each step is one aggregation of at most one column per channel over the
    small signature table; only those scalars reach the driver.
    """
    spark = sig.sparkSession
    sig = sig.persist()
    n = len(channels)
    full = (1 << n) - 1
    own_row = sig.agg(*[_intersection(1 << i).alias(f"o{i}") for i in range(n)], _intersection(full).alias("all")).first()
    own, current = [own_row[f"o{i}"] or 0 for i in range(n)], own_row["all"] or 0
    kept, rows, open_, accepted_count = full, [], True, current
    for step in range(n - max(2, n // 2)):
        left = [i for i in range(n) if kept >> i & 1]
        after = sig.agg(*[_intersection(kept & ~(1 << i)).alias(f"c{i}") for i in left]).first()
        drop = max(left, key=lambda i: (after[f"c{i}"] or 0, -own[i], -channels[i]))
        count = after[f"c{drop}"] or 0
        grew = count > 0 if accepted_count == 0 else count >= accepted_count * (1 + growth_percent / 100)
        open_ = open_ and grew and len(left) > min_channels
        if open_:
            accepted_count = count
        kept &= ~(1 << drop)
        rows.append((step, channels[drop], len(left) - 1, count, int(open_)))
    sig.unpersist()
    return spark.createDataFrame(
        rows, "step int, dropped_channel int, n_channels_after int, common_events long, accepted int")


def composition(units: DataFrame, classes: Sequence[str]) -> DataFrame:
    """Share of each class among the sampled and all events per channel."""
    n = F.count(F.lit(1))
    return units.groupBy("physical_channel", "population").agg(
        n.alias("n_events"), *[(F.count_if(F.col("scope") == k) / n).alias(f"share_{k}") for k in classes])
