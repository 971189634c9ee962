"""JSON-line inventory, datasets and unit metadata."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema
from ..operators.numbering import running_sums


def read_inventory(spark: SparkSession, path: str) -> DataFrame:
    """Inventory rows; unreadable lines and rows without a frequency are left out."""
    raw = (spark.read.schema(schema.INVENTORY).option("mode", "PERMISSIVE")
           .option("columnNameOfCorruptRecord", "_corrupt_record").json(path))
    return raw.where(F.col("_corrupt_record").isNull() & F.col("freq_id").isNotNull()).drop("_corrupt_record")


def frequency_ids(inventory: DataFrame) -> DataFrame:
    return inventory.select("freq_id").distinct().orderBy("freq_id")


def unit_metadata(raw: DataFrame) -> DataFrame:
    """Unit attributes with NULL for anything missing or impossible."""
    c = F.col
    fin = lambda k: F.when(c(k).isNotNull() & ~F.isnan(k), c(k))
    return raw.select(
        "unit_key", "freq_id", fin("center_hz").alias("center_hz"), fin("time0").alias("time0"),
        F.when(c("time0_fpga") > 0, c("time0_fpga")).alias("time0_fpga"), F.when(c("event_id") >= 0, c("event_id")).alias("event_id"),
        F.when(c("period") > 0, fin("period")).alias("period"), F.when(c("n_streams") > 0, c("n_streams")).alias("n_streams"))


def dataset_violations(segments: DataFrame) -> DataFrame:
    """Channels with two coarse channels, or mixed geometry among segments."""
    fields = ("freq_id", "center_hz", "rank", "axes", "n_streams", "dtype", "encoding")
    g = segments.groupBy("physical_channel").agg(*[F.count_distinct(k).alias(k) for k in fields])
    mixed = F.array_compact(F.array(*[F.when(F.col(k) > 1, F.lit(k)) for k in fields]))
    return g.select("physical_channel", mixed.alias("mixed")).where(F.size("mixed") > 0)


def discover_datasets(segments: DataFrame, max_rows: int | None = None) -> DataFrame:
    """Segments in path order with the samples that come before them.

    Needs physical_channel, freq_id, path, n_samples; one row per file."""
    keys = ["physical_channel", "freq_id"]
    r = running_sums(segments.select(*keys, "path", "n_samples", F.lit(1).alias("one")), keys, "path", ["n_samples", "one"],
                     max_rows=max_rows)
    return r.select(*keys, "path", "n_samples", (F.col("cum_n_samples") - F.col("n_samples")).alias("start_sample"),
                    F.col("cum_one").alias("segment"))
