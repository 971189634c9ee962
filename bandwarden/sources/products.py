"""Product tables: sinks, generation-bound reads, views and documents."""
from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import schema
from ..operators.numbering import number_within


def new_generation() -> str:
    return uuid.uuid4().hex


def stamp(df: DataFrame, generation: str) -> DataFrame:
    return df.withColumn("schema_version", F.lit(schema.SCHEMA_VERSION)).withColumn("generation_id", F.lit(generation))


class GenerationRefused(RuntimeError):
    """Raised where tables are not those that were published together."""


def write_products(root: str, generation: str, tables: dict[str, DataFrame], summaries: dict[str, DataFrame] | None = None) -> None:
    """Writes product tables, and summaries as CSV, under one generation, then publishes it.

    Each table is partitioned by generation and frequency, so a rerun replaces
    only its own part; readers see the generation after its last row, when it
    is appended to ``generations`` with the rows and the digest of each table."""
    spark = next(iter(tables.values())).sparkSession
    rows = []
    for name, df in tables.items():
        layout = schema.TABLES[name]
        out = schema.conform(stamp(df, generation), layout, version=None)
        (out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("generation_id", "freq_id").parquet(f"{root}/{name}"))
        part = spark.read.schema(layout).parquet(f"{root}/{name}").where(F.col("generation_id") == generation)
        rows.append(part.agg(F.count(F.lit(1)).alias("n_rows"), digest(layout.fieldNames()).alias("digest")).select(
            F.lit(generation).alias("generation_id"), F.lit(name).alias("table"), "n_rows", "digest",
            F.current_timestamp().alias("published_at")))
    for name, df in (summaries or {}).items():
        write_csv(df, _csv(root, name, generation))
        part = read_summary(spark, root, name, generation)
        rows.append(part.agg(F.count(F.lit(1)).alias("n_rows"), digest(sorted(part.columns)).alias("digest")).select(
            F.lit(generation).alias("generation_id"), F.lit(f"{name}.csv").alias("table"), "n_rows", "digest",
            F.current_timestamp().alias("published_at")))
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    out.coalesce(1).write.mode("append").parquet(f"{root}/generations")


def digest(columns: list[str]):
    """Order-free content digest of all columns."""
    return F.sum(F.pmod(F.xxhash64(*columns), F.lit(2**31 - 1)))


def newest_generation(spark: SparkSession, root: str) -> str:
    g = spark.read.parquet(f"{root}/generations")
    return g.agg(F.max_by("generation_id", "published_at")).first()[0]


def _csv(root: str, name: str, generation: str) -> str:
    return f"{root}/{name}.csv/generation_id={generation}"


def read_summary(spark: SparkSession, root: str, name: str, generation: str | None = None) -> DataFrame:
    """A summary of the newest (or a given) generation, as text."""
    return spark.read.option("header", True).csv(_csv(root, name, generation or newest_generation(spark, root)))


def read_generation(spark: SparkSession, root: str, generation: str | None = None) -> dict[str, DataFrame]:
    """All tables of one generation, read only if every one is as it was published.

    Lost, added or altered rows of any table refuse the generation, and so does one that nobody published."""
    generation = generation or newest_generation(spark, root)
    published = [r["table"] for r in spark.read.parquet(f"{root}/generations").where(F.col("generation_id") == generation).select("table").distinct().collect()]
    wrong = sorted(r["table"] for r in mixed_generations(root, spark, generation).select("table").collect())
    if wrong or not published:
        raise GenerationRefused(f"generation {generation}: {wrong or 'not published'}")
    return {t: read_summary(spark, root, t[:-4], generation) if t.endswith(".csv") else read_product(spark, root, t, generation) for t in published}


def read_product(spark: SparkSession, root: str, name: str, generation: str | None = None) -> DataFrame:
    """A product table of the newest (or a given) published generation."""
    layout = schema.TABLES[name]
    df = spark.read.schema(layout).parquet(f"{root}/{name}")
    return df.where(F.col("generation_id") == (generation or newest_generation(spark, root)))


def mixed_generations(root: str, spark: SparkSession, generation: str) -> DataFrame:
    """Tables and summaries whose rows or digest differ from what was published."""
    published = spark.read.parquet(f"{root}/generations").where(F.col("generation_id") == generation)
    found = None
    for name in [r["table"] for r in published.select("table").distinct().collect()]:   # a few names
        if name.endswith(".csv"):
            there = _exists(spark, _csv(root, name[:-4], generation))
            part = read_summary(spark, root, name[:-4], generation) if there else None
        else:
            there = _exists(spark, f"{root}/{name}")
            part = read_product(spark, root, name, generation) if there else None
        if part is None:
            continue
        columns = sorted(part.columns) if name.endswith(".csv") else schema.TABLES[name].fieldNames()
        part = part.agg(F.count(F.lit(1)).alias("found_rows"), digest(columns).alias("found_digest")).withColumn("table", F.lit(name))
        found = part if found is None else found.unionByName(part)
    if found is None:
        return published
    j = published.join(found, "table", "left")
    return j.where(~F.col("n_rows").eqNullSafe(F.col("found_rows")) | ~F.col("digest").eqNullSafe(F.col("found_digest")))


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def write_stack(df: DataFrame, path: str) -> None:
    """Canonical stack in long form, one part per channel."""
    df.write.mode("overwrite").partitionBy("physical_channel").parquet(path)


def wide_view(df: DataFrame, value: str, channels: list[int]) -> DataFrame:
    """Frame by channel display of one column; the channels are named, so the
    pivot needs no extra pass."""
    return df.groupBy("frame_index").pivot("physical_channel", channels).agg(F.first(value))


def document(df: DataFrame) -> DataFrame:
    """Each row as one JSON text with its fields in name order."""
    return df.select(F.to_json(F.struct(*sorted(df.columns))).alias("document"))


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_ledger(df: DataFrame, path: str) -> None:
    """JSON lines with fields in name order; NaN becomes NULL first."""
    clean = [F.when(F.isnan(c), None).otherwise(F.col(c)).alias(c) if t in ("double", "float") else F.col(c)
             for c, t in sorted(df.dtypes)]
    df.select(*clean).write.mode("overwrite").json(path)


def healthy_view(frames: DataFrame, max_rows: int | None = None) -> DataFrame:
    """Healthy frames of each channel with a contiguous new frame index."""
    return renumbered(frames.where("healthy"), max_rows)


def era_view(frames: DataFrame, month_start: int, month_end: int, month: str = "month", max_rows: int | None = None) -> DataFrame:
    return renumbered(frames.where(F.col(month).between(month_start, month_end)), max_rows)


def renumbered(frames: DataFrame, max_rows: int | None = None) -> DataFrame:
    return number_within(frames, ["physical_channel"], ["unit_time0", "event_id", "frame_in_unit"], "frame_index", max_rows=max_rows)
