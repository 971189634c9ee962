"""Mixing sources to target weights.

Method: multivariate-hypergeometric splitting tree.  Every source is a stream of its documents in a hashed order,
repeated until its target is reached, and cut into blocks of ``BLOCK_WORDS`` words.  The exact numbers of blocks are
split among the output shards down a binary tree: at each node the left half of the shards draws its share without
replacement from what the node holds, which is a multivariate-hypergeometric draw seeded by the node.  A shard walks
its own path from the root, so shards are computed in parallel and agree with each other.  A shard's blocks of a source
are a range of that source's permuted blocks; ranges of different shards are disjoint and leave nothing over.  Inside a
shard the pieces are shuffled by a seeded hash.
"""
from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .tables import batches, table, written
from .words import slices

WEIGHTS = (1, 2, 3)          # by the source's rank, repeating
MOST = 3                     # times a source may be repeated
BLOCK_WORDS = 4096           # and more where there would be over MOST_BLOCKS of them
MOST_BLOCKS = 500_000_000    # the draws take fewer than 10^9
SHARD_WORDS = 2_000_000
SEED = 7
_BUCKET_ROWS = 4096


_KEYS = ("doc_id", "source_key", "order", "text_key")


def _source_key():
    return F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("t"))


def _counted(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    sizes = np.zeros(len(batch), np.int64)
    for s in slices(batch.column("text")):
        sizes[s.first:s.first + s.rows] = np.diff(s.bounds)
    yield pa.record_batch([*(batch.column(c) for c in _KEYS), pa.array(sizes)], names=[*_KEYS, "size"])


def source_targets(sizes: DataFrame) -> DataFrame:
    """``source_key``, ``source_size``, ``target`` from ``source_key, size``; one row per source.

    With the cap of three times its size, the common level per weight is found in closed form: sources reach their cap
    in the order of size over weight, compared in integers."""
    by_key = W.orderBy("source_key")
    shares = sizes.groupBy("source_key").agg(F.sum("size").alias("source_size")).select(
        "source_key", "source_size", ((F.row_number().over(by_key) - 1) % len(WEIGHTS) + WEIGHTS[0]).cast("long").alias("w"))
    every, before = W.orderBy(F.lit(0)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing), (
        W.orderBy("q", "source_key").rowsBetween(W.unboundedPreceding, -1))
    shares = shares.withColumn("q", (F.col("source_size") * (F.lit(6) / F.col("w")).cast("long"))).select(
        "*", F.sum("source_size").over(every).alias("total"), F.sum("w").over(every).alias("weights"),
        F.coalesce(F.sum("source_size").over(before), F.lit(0)).alias("full_size"),
        F.coalesce(F.sum("w").over(before), F.lit(0)).alias("full_w"), F.row_number().over(W.orderBy("q", "source_key")).alias("at"))
    rest = F.col("total") - MOST * F.col("full_size")
    free = F.col("weights") - F.col("full_w")
    open_ = MOST * F.col("source_size") * free > rest * F.col("w")
    level = F.min(F.when(open_, F.struct("at", rest.alias("rest"), free.alias("free")))).over(every)
    return shares.withColumn("level", level).select(
        "source_key", "source_size",
        F.when(F.col("level").isNull() | (F.col("at") < F.col("level.at")), (MOST * F.col("source_size")).cast("double"))
        .otherwise((F.col("level.rest") * F.col("w")).cast("double") / F.col("level.free").cast("double")).alias("target"))


def stream_positions(docs: DataFrame) -> DataFrame:
    """``doc_id, source_key, size, text_key, begin``: words before the document in its source's hashed order.

    The order is by a hash of the id, without an id by one of the text.  Sums run inside buckets of the hash and are shifted by the totals of the buckets before, so no source, however
    large, is summed in one task."""
    text = F.col("text").cast("string")
    nameless = F.concat(F.lit("?"), F.coalesce(text, F.lit("")))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), _source_key().alias("source_key"),
                       F.md5(F.coalesce(F.col("doc_id").cast("long").cast("string"), nameless)).alias("order"), F.xxhash64(text).alias("text_key"))
    keyed = written(docs.mapInArrow(batches(_counted), "doc_id long, source_key string, order string, text_key long, size long"))
    digits = max(0, math.ceil(math.log(max(1, keyed.count() / _BUCKET_ROWS), 16)))
    keyed = keyed.withColumn("bucket", F.substring("order", 1, digits) if digits else F.lit(""))
    totals = keyed.groupBy("source_key", "bucket").agg(F.sum("size").alias("in_bucket"))
    ahead = W.partitionBy("source_key").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    totals = totals.select("source_key", "bucket", F.coalesce(F.sum("in_bucket").over(ahead), F.lit(0)).alias("shift"))
    inside = W.partitionBy("source_key", "bucket").orderBy("order", "doc_id", "size", "text_key").rowsBetween(W.unboundedPreceding, -1)
    local = keyed.withColumn("local", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    return written(local.join(totals, ["source_key", "bucket"]).select(
        "doc_id", "source_key", "size", "text_key", (F.col("local") + F.col("shift")).alias("begin")))


def split_quotas(quotas: np.ndarray, shards: int, shard: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """First slot and number of slots that ``shard`` of ``shards`` has of every source."""
    first, held, low, high = np.zeros_like(quotas), quotas.copy(), 0, shards
    while high - low > 1:
        middle = (low + high) // 2
        total = int(held.sum())
        draw = total * (middle - low) // (high - low)
        rng = np.random.default_rng([seed, low, high])
        left = rng.multivariate_hypergeometric(held, draw) if total else held
        if shard < middle:
            held, high = left, middle
        else:
            first, held, low = first + left, held - left, middle
    return first, held


def block_of_slot(slot: int, blocks: int, seed: int) -> int:
    """The source's block at a place of its permuted order: an affine permutation of 0 .. blocks - 1."""
    step = max(1, int(blocks * 0.6180339887) + seed)
    while math.gcd(step, blocks) != 1:
        step += 1
    return (slot * step + seed) % blocks


def shard_blocks(spark: SparkSession, quotas: list[tuple[str, int]], shards: int, seed: int) -> DataFrame:
    """``source_key, block, shard`` of every block; one task row per shard."""
    keys, counts = [k for k, _ in quotas], np.array([n for _, n in quotas], np.int64)

    def run(found: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in found:
            for shard in frame["id"]:
                first, held = split_quotas(counts, shards, int(shard), seed)
                rows = [(keys[s], block_of_slot(int(slot), int(counts[s]), seed), int(shard))
                        for s in np.flatnonzero(held) for slot in range(first[s], first[s] + held[s])]
                if rows:
                    yield pd.DataFrame(rows, columns=["source_key", "block", "shard"])
    return spark.range(shards).mapInPandas(run, "source_key string, block long, shard long")


def mix_sources(docs: DataFrame, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """The documents with their source's size and target, and the pieces of the mix.

    Pieces: ``doc_id, source_key, begin, pass, start, n_words, block, shard, position``: which words of a document a
    shard has, and where.  A null text has no words and gives no piece; a null source is a source of its own and the
    last.  Repeated rows are separate documents, and so are rows without an id.  An empty table gives two empty results."""
    spark = docs.sparkSession
    placed = stream_positions(docs)
    found = source_targets(placed).collect()  # one row per source
    wanted = [(r.source_key, math.floor(r.target + 0.5)) for r in found]
    total = sum(words for _, words in wanted)
    block = max(BLOCK_WORDS, -(-total // MOST_BLOCKS))
    quotas = [(key, -(-words // block)) for key, words in wanted if words]
    schema = "source_key string, source_size long, target double"
    targets = spark.createDataFrame([tuple(r) for r in found], schema)
    placed = placed.join(F.broadcast(targets), "source_key")  # one row per source
    shards = max(1, -(-total // SHARD_WORDS))
    lo = F.col("pass") * F.col("source_size") + F.col("begin")
    hi = F.least(lo + F.col("size"), F.floor(F.col("target") + 0.5))
    spans = (placed.where("size > 0").withColumn("pass", F.explode(F.array([F.lit(p).cast("long") for p in range(MOST)])))
             .select("*", lo.alias("lo"), hi.alias("hi")).where("lo < hi"))
    width = F.lit(block)
    pieces = (spans.withColumn("block", F.explode(F.sequence(F.floor(F.col("lo") / width), F.floor((F.col("hi") - 1) / width))))
              .withColumn("from", F.greatest("lo", F.col("block") * width))
              .withColumn("to", F.least("hi", (F.col("block") + 1) * width))
              .select("doc_id", "source_key", "begin", "pass", (F.col("from") - F.col("lo")).alias("start"),
                      (F.col("to") - F.col("from")).alias("n_words"), "block"))
    drawn = pieces.join(shard_blocks(spark, quotas, shards, seed), ["source_key", "block"])
    shuffled = W.partitionBy("shard").orderBy(F.xxhash64(F.lit(seed), "doc_id", "pass", "start"), "source_key", "begin", "pass", "start")
    return placed, drawn.withColumn("position", F.row_number().over(shuffled) - 1)


def taken_words(docs: DataFrame) -> DataFrame:
    placed, pieces = mix_sources(docs)
    taken = pieces.groupBy("source_key", "begin", "doc_id").agg(F.sum("n_words").alias("taken"))
    same = [F.col("p.source_key") == F.col("t.source_key"), F.col("p.begin") == F.col("t.begin"),
            F.col("p.doc_id").eqNullSafe(F.col("t.doc_id")), F.col("p.size") > 0]
    return placed.alias("p").join(taken.alias("t"), same, "left").select(
        "p.doc_id", "p.size", "p.source_size", "p.target", F.coalesce("t.taken", F.lit(0).cast("long")).alias("taken"))


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` as the mix has them: one row per pass that takes words of it.

    All but the document at which a source's target ends are taken whole; of that one the text ends with the last word
    taken, and ``n_chars`` follows.  Rows that share an id, source and size are matched by their texts.  The columns come back
    as they were, also one that is named like a column used here."""
    placed, pieces = mix_sources(docs)
    row = ["doc_id", "source_key", "size"]
    takes = pieces.groupBy("source_key", "begin", F.col("doc_id").alias("id"), "pass").agg(F.sum("n_words").alias("take"))
    placed = placed.where("size > 0").select(*row, "begin", "text_key", F.row_number().over(W.partitionBy(*row, "text_key").orderBy("begin")).alias("copy"))
    takes = placed.join(takes, ["source_key", "begin"]).where(F.col("doc_id").eqNullSafe(F.col("id"))).drop("id", "begin")
    plain = F.coalesce(F.col("text").cast("string"), F.lit(""))
    words = F.size(F.regexp_extract_all(plain, F.lit("([^\\x20\\x09-\\x0D]+)"), 1)).cast("long")
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.col("doc_id").cast("long").alias("id"), _source_key().alias("key"),
                        words.alias("n"), F.xxhash64(F.col("text").cast("string")).alias("text_key"))
    keyed = keyed.withColumn("copy", F.row_number().over(W.partitionBy("id", "key", "n", "text_key").orderBy(F.lit(0))))  # the same text
    on = [F.col("k.id").eqNullSafe(F.col("t.doc_id")), F.col("k.key") == F.col("t.source_key"), F.col("k.n") == F.col("t.size"),
          F.col("k.text_key") == F.col("t.text_key"), F.col("k.copy") == F.col("t.copy")]
    spaced = F.regexp_extract_all("k.doc.text", F.lit("[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+"), 0)
    cut = F.array_join(F.slice(spaced, F.lit(1), F.col("t.take").cast("int")), "")
    whole = F.col("t.take") == F.col("t.size")
    changed = {"text": F.when(whole, F.col("k.doc.text")).otherwise(cut), "n_chars": F.length(cut)}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(whole, F.col("k.doc.n_chars")).otherwise(changed["n_chars"])
    return keyed.alias("k").join(takes.alias("t"), on).select(*[
        changed[f.name].cast(f.dataType).alias(f.name) if f.name in changed else F.col(f"k.doc.`{f.name}`").alias(f.name) for f in docs.schema.fields])


def op9_source_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return taken_words(table(spark, folder, "documents"))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, CASE WHEN source IS NULL THEN 't' ELSE 's' || source END AS k, md5(coalesce(CAST(doc_id AS VARCHAR), '?' || coalesce(text, ''))) AS h,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size
  FROM documents),
s AS (SELECT k, CAST(sum(size) AS BIGINT) AS source_size, (row_number() OVER (ORDER BY k) - 1) % 3 + 1 AS w FROM d GROUP BY k),
o AS (
  SELECT *, source_size * (6 // w) AS q FROM s),
p AS (
  SELECT *, CAST(sum(source_size) OVER () AS BIGINT) AS total, CAST(sum(w) OVER () AS BIGINT) AS weights,
         CAST(coalesce(sum(source_size) OVER (ORDER BY q, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS full_size,
         CAST(coalesce(sum(w) OVER (ORDER BY q, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS full_w,
         row_number() OVER (ORDER BY q, k) AS pos
  FROM o),
l AS (
  SELECT pos AS level_pos, total - 3 * full_size AS rest, weights - full_w AS free FROM p
  WHERE 3 * source_size * (weights - full_w) > (total - 3 * full_size) * w ORDER BY pos LIMIT 1),
t AS (
  SELECT p.k, p.source_size,
         CASE WHEN l.level_pos IS NULL OR p.pos < l.level_pos THEN CAST(3 * p.source_size AS DOUBLE)
              ELSE CAST(l.rest * p.w AS DOUBLE) / CAST(l.free AS DOUBLE) END AS target
  FROM p LEFT JOIN l ON TRUE),
r AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, CAST(floor(t.target + 0.5) AS BIGINT) AS take,
         CAST(coalesce(sum(d.size) OVER (PARTITION BY d.k ORDER BY d.h, d.doc_id, d.size
                       ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before
  FROM d JOIN t ON t.k = d.k)
SELECT doc_id, size, source_size, target,
       CASE WHEN size = 0 THEN CAST(0 AS BIGINT)
            ELSE size * (take // source_size) + greatest(0, least(size, take % source_size - before)) END AS taken
FROM r"""
