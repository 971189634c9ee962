"""Exact top-k search by inner product with block-at-a-time pruning.

Method: a vector is a sparse document over signed terms, one for each dimension and sign.  Documents stand in ranges,
ordered inside a range so that similar vectors are neighbours, and are cut into blocks with a small forward index (the
block's vectors) and the maximum of every term.  For a query the summed term maxima bound every score in a block; blocks
are visited by falling bound and scored through their forward index until the bound falls below the query's k-th score.

Ranges and groups of queries meet in separate tasks.  A query first visits the range it lies in, which gives every other
range a k-th score to prune against.  Only the best k of a range go on, and the last ranking is over those.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .tables import batches, table, written

SCALE = 64
TOP = 20
EVERY = 20          # queries: ids divisible by this
RANGE = 2048        # documents of a range
BLOCK = 64
QUERIES = 2048      # queries of a group
LOWEST = -(1 << 62)  # below every score

_ROWS = "query_id long, vec_id long, score long"


def integer_vectors(vectors: DataFrame) -> DataFrame:
    """``vec_id``, ``v``: floor(64 x) of every component; vectors that are null or hold null or non-finite ones go.

    Rows that repeat an id count once, with the smallest vector; a null id goes."""
    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        ids, rows = [], []
        for i, v in zip(batch.column("vec_id").to_pylist(), batch.column("embedding")):
            if i is None or not v.is_valid or v.values.null_count:
                continue
            x = v.values.to_numpy(zero_copy_only=False).astype(np.float64)
            if np.isfinite(x).all():
                ids.append(i)
                rows.append(np.floor(SCALE * x).astype(np.int64))
        yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(rows, pa.list_(pa.int64()))], names=["vec_id", "v"])
    return (vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
            .mapInArrow(batches(run), "vec_id long, v array<long>").groupBy("vec_id").agg(F.min("v").alias("v")))


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Rows of equal width; shorter vectors end in zeros."""
    rows = column.combine_chunks()
    length = rows.value_lengths().to_numpy()
    flat = rows.flatten().to_numpy()
    out = np.zeros((len(length), int(length.max(initial=0))), np.int64)
    out[np.repeat(np.arange(len(length)), length), np.arange(len(flat)) - np.repeat(np.cumsum(length) - length, length)] = flat
    return out


def _same_width(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    width = max(a.shape[1], b.shape[1])
    return tuple(np.pad(m, ((0, 0), (0, width - m.shape[1]))) for m in (a, b))


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer products: through doubles where no sum can leave their exact range."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if most < 2 ** 53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


def neighbours_together(v: np.ndarray) -> np.ndarray:
    """Order in which vectors with the same strongest terms are next to each other."""
    if not v.shape[1]:
        return np.arange(len(v))
    strong = np.argsort(-np.abs(v), axis=1, kind="stable")[:, :3]
    term = strong * 2 + (np.take_along_axis(v, strong, 1) < 0)
    return np.lexsort(term.T[::-1])


def search_range(ids: np.ndarray, v: np.ndarray, query_ids: np.ndarray, q: np.ndarray, least: np.ndarray,
                 top: int = TOP) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Rows (query, vec_id, score) that may be among a query's ``top``, and how many blocks were scored.

    ``least``: a score that ``top`` candidates are known to reach; ties with it stay."""
    order = neighbours_together(v)
    ids, v = ids[order], v[order]
    cuts = np.arange(0, len(ids), BLOCK)
    high, low = np.maximum.reduceat(v, cuts), np.maximum.reduceat(-v, cuts)
    bound = _product(np.maximum(q, 0), high) + _product(np.maximum(-q, 0), low)
    rank = np.argsort(-bound, axis=1, kind="stable")
    kth, best, scored = least.copy(), [], 0
    held = np.full((len(q), top), LOWEST)
    for r in range(len(cuts)):
        block = rank[:, r]
        active = np.flatnonzero(bound[np.arange(len(q)), block] >= kth)
        if not len(active):
            break
        for b in np.unique(block[active]):
            mine = active[block[active] == b]
            own = slice(cuts[b], cuts[b] + BLOCK)
            score = _product(q[mine], v[own])
            scored += len(mine)
            keep = (score >= kth[mine][:, None]) & (ids[own][None, :] != query_ids[mine][:, None])
            row, col = np.nonzero(keep)
            if not len(row):
                continue
            best.append((mine[row], ids[own][col], score[row, col]))
            some = np.unique(row)
            merged = np.concatenate([held[mine[some]], np.where(keep[some], score[some], LOWEST)], axis=1)
            held[mine[some]] = -np.partition(-merged, top - 1, axis=1)[:, :top]
            kth[mine[some]] = np.maximum(kth[mine[some]], held[mine[some]].min(axis=1))
    if not best:
        none = np.zeros(0, np.int64)
        return none, none, none, scored
    who, found, score = (np.concatenate(x) for x in zip(*best))
    keep = score >= kth[who]
    who, found, score = who[keep], found[keep], score[keep]
    order = np.lexsort((found, -score, who))
    who, found, score = who[order], found[order], score[order]
    place = np.arange(len(who)) - np.searchsorted(who, who)
    keep = place < top
    return query_ids[who[keep]], found[keep], score[keep], scored


def _search(queries: pa.Table, docs: pa.Table) -> pa.Table:
    names = ["query_id", "vec_id", "score"]
    if not queries.num_rows or not docs.num_rows:
        return pa.Table.from_arrays([pa.array([], pa.int64())] * 3, names=names)
    q, v = _same_width(_matrix(queries.column("v")), _matrix(docs.column("v")))
    out = search_range(docs.column("vec_id").to_numpy(), v, queries.column("vec_id").to_numpy(), q, queries.column("least").to_numpy())
    return pa.Table.from_arrays([pa.array(x) for x in out[:3]], names=names)


def _meet(queries: DataFrame, docs: DataFrame) -> DataFrame:
    key = ["query_group", "range"]
    docs = docs.select(*[F.col(c).alias(c) for c in docs.columns])  # both sides come from one table
    return queries.groupBy(*key).cogroup(docs.groupBy(*key)).applyInArrow(_search, _ROWS)


def _ranked(rows: DataFrame) -> DataFrame:
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= TOP)


def top_by_inner_product(vectors: DataFrame, is_query: Column) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score``: the best ``TOP`` rows for every query, itself excluded.

    Ties go to the smaller id; a query with fewer candidates gets them all; vectors of different lengths are compared
    as if the shorter ended in zeros.  Columns other than vec_id and embedding are ignored."""
    whole = written(integer_vectors(vectors))
    ranges = max(1, -(-whole.count() // RANGE))
    # Ids are distinct here, so a hash deals them evenly whatever their span; its seed differs from that of the groups.
    docs = whole.withColumn("range", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(ranges)).cast("long"))
    queries = docs.where(is_query)
    asked = queries.count()
    groups = max(1, -(-asked // QUERIES))
    group = F.pmod(F.xxhash64("vec_id"), F.lit(groups)).alias("query_group")
    none = F.lit(LOWEST).cast("long").alias("least")
    home = queries.select(F.lit(-1).cast("long").alias("query_group"), "range", "vec_id", "v", none)
    first = written(_meet(home, docs.select(F.lit(-1).cast("long").alias("query_group"), "range", "vec_id", "v")))
    least = first.groupBy("query_id").agg(F.min("score").alias("s"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= TOP)
    ready = queries.join(least, queries.vec_id == least.query_id, "left").select(
        group, F.col("range").alias("home"), "vec_id", "v", F.coalesce("s", none).alias("least"))
    away = (ready.withColumn("range", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(ranges - 1).cast("long"))))
            .where("range <> home").select("query_group", "range", "vec_id", "v", "least"))
    spread = docs.withColumn("query_group", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))))
    found = _meet(away, spread.select("query_group", "range", "vec_id", "v"))
    return _ranked(first.unionByName(found)).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op8_block_pruning(spark: SparkSession, folder: str) -> DataFrame:
    return top_by_inner_product(table(spark, folder, "embeddings"), F.col("vec_id") % EVERY == 0)


ORACLE = f"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor({SCALE} * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (
  SELECT q.vec_id AS query_id, d.vec_id, CAST(list_inner_product(q.v, d.v) AS BIGINT) AS score
  FROM v q JOIN v d ON q.vec_id <> d.vec_id WHERE q.vec_id % {EVERY} = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM p QUALIFY rank <= {TOP}"""
