"""Centroid clustering by Lloyd's rounds with the dimensions sharded.

Method: vectors are integers, cut into chunks of rows and blocks of columns.  A shard is one column block of one chunk and
lies in a partition that holds that block only; such a task knows its slice of the centroids and no more.  In each round it
computes exact partial squared distances to the slice, ``reduceByKey`` adds the blocks of a chunk and the argmin names
each vector's centroid.  The names go back to the shards of the chunk, whose rows are summed per centroid, and every
block forms its own slice of the new centroids.  Shards are dealt once and stay where they are: a round moves distances and names.

The driver holds the centroids, ``k`` times the number of dimensions, and nothing that grows with the vectors.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import RDD, TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import drop_written, table, written

CLUSTERS = 8
ROUNDS = 10
DIMENSIONS = 64
SCALE = 1024
SEED = 3
WIDTH = 16           # columns of a block
CHUNK = 1024         # rows of a chunk
CHUNKS = 64          # chunks of a partition
LARGEST = 1 << 27    # integer components stay below, so that distances fit a long

_RESULT = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"


def integer_vectors(vectors: DataFrame, dimensions: int, scale: int) -> DataFrame:
    """``vec_id``, ``v``: floor(scale x) of the vectors with exactly ``dimensions`` components, all finite.

    A component of ``LARGEST`` or more raises, as its distances would leave the range of a long."""
    e = F.col("e")
    finite = F.forall(e, lambda x: x.isNotNull() & (F.abs(x) < F.lit(float("inf"))))
    inside = F.forall(e, lambda x: F.abs(x * F.lit(float(scale))) < F.lit(float(LARGEST)))
    refused = F.raise_error(F.lit(f"a component times {scale} is {LARGEST} or more")).cast("array<double>")
    return (vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("e"))
            .where((F.size("e") == dimensions) & finite).withColumn("e", F.when(inside, e).otherwise(refused))
            .select("vec_id", F.transform(e, lambda x: F.floor(x * F.lit(float(scale))).cast("long")).alias("v")))


def shards_of(vectors: DataFrame, dimensions: int, width: int) -> DataFrame:
    """``chunk``, ``block``, ``ids`` (of block 0 only), ``cells``: the shards; to be written at once, as chunks number rows as they come."""
    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId() << 32
        for batch in found:
            for start in range(0, batch.num_rows, CHUNK):
                part = batch.slice(start, CHUNK)
                x = part.column("v").flatten().to_numpy().reshape(part.num_rows, dimensions).astype(np.int32)
                cells = [np.ascontiguousarray(x[:, a:a + width]).tobytes() for a in range(0, dimensions, width)]
                ids = [part.column("vec_id").to_pylist()] + [None] * (len(cells) - 1)
                yield pa.record_batch([pa.array([chunk] * len(cells), pa.int64()), pa.array(range(len(cells)), pa.int32()),
                                       pa.array(ids, pa.list_(pa.int64())), pa.array(cells, pa.binary())],
                                      names=["chunk", "block", "ids", "cells"])
                chunk += 1
    return vectors.mapInArrow(run, "chunk long, block int, ids array<long>, cells binary")


def smallest(a: np.ndarray) -> np.ndarray:
    """The same values in 32 bits where they fit; shuffles carry these."""
    return a.astype(np.int32) if a.size and a.max() < 1 << 31 and a.min() >= -(1 << 31) else a


def partial_distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances (row, centroid) over the columns given: by BLAS where no term can leave the exact range of doubles."""
    reach = (float(np.abs(x.astype(np.int64)).max(initial=0)) + float(np.abs(centroids).max(initial=0))) ** 2 * x.shape[1]
    if reach < 1 << 51:
        a, c = x.astype(np.float64), centroids.astype(np.float64)
        return ((a * a).sum(1)[:, None] - 2 * (a @ c.T) + (c * c).sum(1)).astype(np.int64)
    a = x.astype(np.int64)
    return np.stack([((a - c) ** 2).sum(1) for c in centroids], axis=1)


def _added(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a.astype(np.int64) + b


class Shards:
    """The shards as an RDD of ((block, chunk), rows by columns), dealt by block and chunk."""

    def __init__(self, shards: DataFrame, dimensions: int, width: int):
        chunks = shards.where("block = 0").count()
        self.blocks = -(-dimensions // width)
        self.tasks = max(1, -(-chunks // CHUNKS), min(chunks, shards.sparkSession.sparkContext.defaultParallelism))
        widths = [min(width, dimensions - b * width) for b in range(self.blocks)]
        tasks = self.tasks

        def place(key: tuple[int, int]) -> int:
            return key[0] * tasks + (key[1] ^ key[1] >> 32) % tasks

        self.place = place
        self.rdd = self._dealt(shards.select("block", "chunk", "cells").rdd.map(
            lambda r: ((r[0], r[1]), np.frombuffer(bytes(r[2]), np.int32).reshape(-1, widths[r[0]]))))

    def _dealt(self, rdd: RDD) -> RDD:
        return rdd.partitionBy(self.blocks * self.tasks, self.place)

    def nearest(self, slices: list[np.ndarray]) -> RDD:
        """(chunk, (centroid of each row, distance)); the smaller number wins a tie."""
        def partial(shard):
            (block, chunk), x = shard
            return chunk, smallest(partial_distances(x, slices[block]))
        return (self.rdd.map(partial).reduceByKey(_added, self.tasks)
                .mapValues(lambda d: (d.argmin(1).astype(np.int32), d.min(1).astype(np.int64))))

    def updated(self, slices: list[np.ndarray]) -> list[np.ndarray]:
        """The slices of the new centroids: floor of the exact mean; a centroid without vectors stays."""
        blocks = range(self.blocks)

        def sums(part):
            names, found = {}, {}
            for (block, chunk), value in part:   # the names come first, see below
                if value.ndim == 1:
                    names[block, chunk] = value
                    continue
                named = names[block, chunk]
                total, count = found.setdefault(block, (np.zeros(slices[block].shape, np.int64), np.zeros(len(slices[block]), np.int64)))
                np.add.at(total, named, value)
                count += np.bincount(named, minlength=len(count))
            for block, (total, count) in found.items():
                yield block, (total.astype(object), count.astype(object))

        def mean(item):
            block, (total, count) = item
            rows = [[int(s) // int(n) for s in row] if n else old.tolist() for row, n, old in zip(total, count, slices[block])]
            return block, np.array(rows, np.int64)

        names = self._dealt(self.nearest(slices).flatMap(lambda item: [((b, item[0]), item[1][0]) for b in blocks]))
        # Both sides are dealt alike, so the union sets partition to partition, the names before the shards.
        new = (names.union(self.rdd).mapPartitions(sums).reduceByKey(lambda a, b: (a[0] + b[0], a[1] + b[1]), self.blocks)
               .map(mean).collectAsMap())   # k x dimensions in all
        return [new.get(b, slices[b]) for b in blocks]


def clustered(vectors: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, dimensions: int = DIMENSIONS, scale: int = SCALE,
              seed: int = SEED, width: int = WIDTH) -> DataFrame:
    """``vec_id``, ``cluster``, ``distance``, ``cluster_inertia``, ``inertia``, ``centroid_sha256`` of every kept vector.

    Kept are vectors with exactly ``dimensions`` components, none null or non-finite; other columns are ignored.  Every row
    is a vector for itself, also where ids repeat.  The ``k`` rows with the smallest sha256 of ``seed:vec_id`` start;
    rows without an id come last there, equal ids go by their components.  With fewer rows there are fewer
    centroids, without any the result is empty.  Components beyond the range of exact distances raise."""
    spark = vectors.sparkSession
    whole = integer_vectors(vectors, dimensions, scale)
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    start = whole.select(hashed.alias("h"), "v").orderBy(F.asc_nulls_last("h"), "v").limit(k).collect()
    if not start:
        return spark.createDataFrame([], _RESULT)
    first = np.array([r["v"] for r in start], np.int64).reshape(len(start), dimensions)
    stored = written(shards_of(whole, dimensions, width))
    shards = Shards(stored, dimensions, width)
    slices = [first[:, a:a + width] for a in range(0, dimensions, width)]
    for _ in range(rounds):
        slices = shards.updated(slices)
    named = shards.nearest(slices).map(lambda item: (item[0], bytearray(item[1][0].tobytes()), bytearray(item[1][1].tobytes())))
    ids = stored.where("block = 0").select("chunk", "ids")

    def rows(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            for i in range(batch.num_rows):
                yield pa.record_batch([batch.column("ids")[i].values, pa.array(np.frombuffer(batch.column("names")[i].as_py(), np.int32)),
                                       pa.array(np.frombuffer(batch.column("far")[i].as_py(), np.int64))],
                                      names=["vec_id", "cluster", "distance"])

    result = written(spark.createDataFrame(named, "chunk long, names binary, far binary").join(ids, "chunk")
                     .mapInArrow(rows, "vec_id long, cluster int, distance long"))
    drop_written(stored)
    inertia = {r["cluster"]: r["s"] for r in result.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}  # k rows
    centroids = np.concatenate(slices, axis=1)
    digest = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
    facts = spark.createDataFrame([(c, s, sum(inertia.values()), digest[c]) for c, s in inertia.items()],
                                  "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return result.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op12_sharded_lloyd(spark: SparkSession, folder: str) -> DataFrame:
    return clustered(table(spark, folder, "embeddings"))


def _round(r: int) -> str:
    return f"""
a{r} AS MATERIALIZED (
  SELECT row, c, d FROM (SELECT row, c, CAST(sum((cell.x - cen.x) * (cell.x - cen.x)) AS BIGINT) AS d
    FROM cell JOIN c{r} cen USING (dim) GROUP BY row, c)
  QUALIFY row_number() OVER (PARTITION BY row ORDER BY d, c) = 1),
c{r + 1} AS MATERIALIZED (
  SELECT c, dim, coalesce(CAST((s - ((s % n + n) % n)) // n AS BIGINT), cen.x) AS x
  FROM c{r} cen LEFT JOIN (SELECT c, dim, sum(x) AS s, count(*) AS n FROM cell JOIN a{r} USING (row) GROUP BY c, dim) USING (c, dim))"""


ORACLE = f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE len(embedding) = {DIMENSIONS} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
cell AS MATERIALIZED (SELECT row, unnest(v) AS x, generate_subscripts(v, 1) AS dim FROM kept),
c0 AS MATERIALIZED (
  SELECT c, unnest(v) AS x, generate_subscripts(v, 1) AS dim
  FROM (SELECT row_number() OVER (ORDER BY sha256('{SEED}:' || vec_id) NULLS LAST, v) - 1 AS c, v FROM kept) WHERE c < {CLUSTERS}),
{",".join(_round(r) for r in range(ROUNDS))},
last AS MATERIALIZED (
  SELECT row, c, d FROM (SELECT row, c, CAST(sum((cell.x - cen.x) * (cell.x - cen.x)) AS BIGINT) AS d
    FROM cell JOIN c{ROUNDS} cen USING (dim) GROUP BY row, c)
  QUALIFY row_number() OVER (PARTITION BY row ORDER BY d, c) = 1)
SELECT vec_id, CAST(c AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia,
  CAST(sum(d) OVER () AS BIGINT) AS inertia, h AS centroid_sha256
FROM last JOIN kept USING (row) JOIN (SELECT c, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY dim)) AS h FROM c{ROUNDS} GROUP BY c) USING (c)"""
