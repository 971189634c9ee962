"""Parquet tables by name, with a cheap row bound from the file footers."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_ROWS: dict[tuple, int] = {}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _status(spark: SparkSession, folder: str, name: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}.parquet")
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def row_bound(spark: SparkSession, folder: str, name: str) -> int:
    """Row count answered from Parquet footers, remembered while the table's files stay as they are."""
    files, path = _status(spark, folder, name)
    held = files.getContentSummary(path)
    key = (spark.sparkContext.applicationId, f"{folder}/{name}", held.getLength(), held.getFileCount())
    if key not in _ROWS:
        _ROWS[key] = table(spark, folder, name).count()
    return _ROWS[key]


def stream_table(spark: SparkSession, folder: str, name: str, **options: object) -> DataFrame:
    """A stream over a table's files, whether the table is one file or a folder of files."""
    files, path = _status(spark, folder, name)
    if not files.exists(path):
        raise FileNotFoundError(f"{folder}/{name}.parquet")
    reader = spark.readStream.schema(table(spark, folder, name).schema).options(**options)
    if files.getFileStatus(path).isDirectory():
        return reader.parquet(f"{folder}/{name}.parquet")
    return reader.option("pathGlobFilter", f"{name}.parquet").parquet(folder)
