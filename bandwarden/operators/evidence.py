"""Inventory joins, reconciliation, pending work and scope accounting."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import FRAME_SECONDS


def exposure_by_class(units: DataFrame, inventory: DataFrame, frame_seconds: float = FRAME_SECONDS) -> DataFrame:
    """Units, frames, events and seconds per trigger class."""
    joined = units.join(inventory.select("unit_key", "scope"), "unit_key")
    return joined.groupBy("scope").agg(
        F.count(F.lit(1)).alias("units"), F.sum("n_frames").alias("frames"),
        F.count_distinct("event_id").alias("events"),
        (F.sum("n_frames") * F.lit(frame_seconds)).alias("seconds"))


def bytes_by_class(inventory: DataFrame, units: DataFrame, quarantined: DataFrame, frame_seconds: float = FRAME_SECONDS) -> DataFrame:
    """Catalogued, processed and quarantined units and bytes per trigger class, with the frames, events and seconds processed.

    ``inventory``: unit_key, scope, size_bytes (NULL counts as none), one row a unit; bytes are those of the catalogue, not a
    measure of what was read.  ``units``: unit_key, event_id, n_frames; ``quarantined``: unit_key."""
    done = units.select("unit_key", "event_id", "n_frames", F.lit(True).alias("processed"))
    bad = quarantined.select("unit_key").distinct().withColumn("bad", F.lit(True))
    j = inventory.join(done, "unit_key", "left").join(bad, "unit_key", "left")
    size, of = F.coalesce("size_bytes", F.lit(0)).cast("long"), lambda flag, x: F.coalesce(F.sum(F.when(F.col(flag), x)), F.lit(0))
    return j.groupBy("scope").agg(
        F.count(F.lit(1)).alias("units"), F.count_if("processed").alias("processed_units"), F.count_if("bad").alias("quarantined_units"),
        F.coalesce(F.sum("n_frames"), F.lit(0)).alias("frames"), F.count_distinct("event_id").alias("events"),
        (F.coalesce(F.sum("n_frames"), F.lit(0)) * F.lit(frame_seconds)).alias("seconds"),
        F.sum(size).alias("catalogued_bytes"), of("processed", size).alias("processed_bytes"), of("bad", size).alias("quarantined_bytes"))


def reconcile(inventory: DataFrame, processed: DataFrame, flagged: DataFrame, quarantine: DataFrame) -> DataFrame:
    """Violation counts between the evidence tables; all zero means they agree."""
    key = "unit_key"
    checks = {
        "inventory_duplicate": inventory.groupBy(key).count().where("count > 1"),
        "processed_not_in_inventory": processed.join(inventory, key, "left_anti"),
        "flagged_not_in_inventory": flagged.join(inventory, key, "left_anti"),
        "unprocessed_not_quarantined": inventory.join(processed, key, "left_anti").join(quarantine, key, "left_anti"),
        "quarantined_but_processed": quarantine.join(processed, key, "left_semi"),
    }
    out = None
    for name, bad in checks.items():
        row = bad.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("check"), "n")
        out = row if out is None else out.unionByName(row)
    return out


def pending_units(enumerated: DataFrame, saved: DataFrame, quarantined: DataFrame) -> DataFrame:
    """Enumerated units neither saved nor quarantined.

    Saved work matches on ``stable_key``, quarantine on the stable key or,
    where it has none, on the name: an OR split into two equi-joins."""
    left = enumerated.join(saved.select("stable_key").distinct(), "stable_key", "left_anti")
    keyed = quarantined.where(F.col("stable_key").isNotNull()).select("stable_key").distinct()
    named = quarantined.where(F.col("stable_key").isNull()).select("name").distinct()
    return left.join(keyed, "stable_key", "left_anti").join(named, "name", "left_anti")


def compare_ids(requested: DataFrame, found: DataFrame, key: str = "freq_id") -> DataFrame:
    """Requested ids that were not found and found ids that were not requested."""
    a, b = requested.select(key).distinct(), found.select(key).distinct()
    return (a.join(b, key, "left_anti").withColumn("status", F.lit("missing"))
            .unionByName(b.join(a, key, "left_anti").withColumn("status", F.lit("extra"))))


def scan_scope(enumerated: DataFrame, done: DataFrame, quarantine: DataFrame, key: str = "unit_key",
               channel: str = "physical_channel") -> DataFrame:
    """Per channel and in total: enumerated, completed, capped, failed,
    quarantined and unprocessed units with a status.

    ``done`` has a ``capped`` flag; a capped unit is not complete."""
    tagged = (
        enumerated.select(channel, key)
        .join(done.select(key, "capped").withColumn("_d", F.lit(True)), key, "left")
        .join(quarantine.select(key, "failed").withColumn("_q", F.lit(True)), key, "left"))
    d, q = F.col("_d").isNotNull(), F.col("_q").isNotNull()
    agg = [F.count(F.lit(1)).alias("enumerated"), F.count_if(d & ~F.col("capped")).alias("completed"),
           F.count_if(d & F.col("capped")).alias("capped"), F.count_if(q & F.col("failed")).alias("failed"),
           F.count_if(q & ~F.col("failed")).alias("quarantined"), F.count_if(~d & ~q).alias("unprocessed")]
    per = tagged.groupBy(channel).agg(*agg)
    total = per.agg(*[F.sum(x).alias(x) for x in per.columns[1:]]).withColumn(channel, F.lit(None).cast("int"))
    return per.unionByName(total).withColumn("status", scope_status())


def scope_status() -> Column:
    c = F.col
    return (F.when(c("enumerated") == 0, "empty").when(c("failed") > 0, "failed")
            .when(c("unprocessed") > 0, "incomplete").when(c("capped") > 0, "capped").otherwise("complete"))


def stale_units(done: DataFrame, enumerated: DataFrame, key: str = "unit_key") -> DataFrame:
    """Saved units that the enumeration no longer lists; any row is refused."""
    return done.join(enumerated, key, "left_anti")


def capped_frames(frames: DataFrame, cap: int) -> DataFrame:
    """At most ``cap`` frames of each unit by frame number."""
    return frames.where(F.col("frame_in_unit") < cap)


def capped_units(frames: DataFrame, cap: int) -> DataFrame:
    """Units with the flag that the cap cut frames off."""
    return frames.groupBy("physical_channel", "event_id").agg(
        F.count(F.lit(1)).alias("n_frames"), F.count_if(F.col("frame_in_unit") < cap).alias("n_kept"),
        (F.max("frame_in_unit") >= cap).alias("capped"))
