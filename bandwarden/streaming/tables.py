"""Tables that streams write batch by batch; a batch that is given again overwrites itself."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def put_batch(df: DataFrame, path: str, batch_id: int) -> None:
    (df.withColumn("batch_id", F.lit(batch_id).cast("long")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("batch_id").parquet(path))


def batch_table(spark: SparkSession, path: str) -> DataFrame | None:
    """The table at ``path``; None where nothing has been written yet."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(where) or not any("=" in s.getPath().getName() for s in files.listStatus(where)):
        return None
    return spark.read.option("basePath", path).parquet(path)
