"""Reading tables, writing intermediate results, and connected components."""
from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@contextmanager
def _shuffles_released(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the statements inside go as soon as each has ended."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)


def written(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder and read back, which cuts its lineage."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/llm-{uuid.uuid4().hex}"
    with _shuffles_released(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_written(df: DataFrame) -> None:
    """Deletes the files of a table made by ``written`` that nothing reads any more."""
    spark = df.sparkSession
    root = ensure_checkpoint_dir(spark).rstrip("/").split(":")[-1]
    folders = {f.rsplit("/", 1)[0] for f in df.inputFiles()}
    for folder in folders:
        if root in folder and "/llm-" in folder:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: What a Python worker keeps from task to task for the operator it works for; tasks of other operators drop it.
worker_memory: dict = {}


def release_worker_memory() -> None:
    worker_memory.clear()
    pa.default_memory_pool().release_unused()


def batches(run: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]]):
    """A ``mapInArrow`` function from one that handles a single batch; unused memory goes back after each."""
    def over(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_worker_memory()
        for batch in found:
            yield from run(batch)
            del batch
            pa.default_memory_pool().release_unused()
    return over


def components(edges: DataFrame) -> DataFrame:
    """``node``, ``root`` for every node of ``edges(a, b)``: the root is the smallest node that links reach.

    Each round hooks every node to its smallest neighbour, follows the pointer once more, and contracts the edges;
    the number of rounds grows with the logarithm of the longest chain."""
    edges = written(edges.where(F.col("a") != F.col("b"))
                    .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    roots = None
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = written(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("to"))
                       .select("node", F.least("node", "to").alias("to")))
        far = hook.select(F.col("node").alias("to"), F.col("to").alias("far"))
        hook = written(hook.join(far, "to").select("node", F.col("far").alias("root")))
        if roots is None:
            roots = hook
        else:
            next_ = hook.select(F.col("node").alias("root"), F.col("root").alias("next"))
            roots = written(roots.join(next_, "root", "left").select("node", F.coalesce("next", "root").alias("root")))
        at, bt = (hook.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root")) for c in "ab")
        edges = written(edges.join(at, "a").join(bt, "b").where(F.col("a_root") != F.col("b_root"))
                        .select(F.least("a_root", "b_root").alias("a"), F.greatest("a_root", "b_root").alias("b")).distinct())
    return roots if roots is not None else edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
