"""Ranked lexical search by dense blocked matrix products.

Method: the distinct terms of a tile of items are its compact vocabulary.  Documents are read a tile at a time; a tile's
impacts over that vocabulary fill a dense float64 matrix, and one BLAS product with the items' weights scores all pairs
of the two tiles.  Weights and impacts are integers: the vocabulary is cut into column blocks in which no sum can reach
2^53, so every product is exact, and blocks are added as 64-bit integers.  Each task keeps the best ``TOP`` documents of
every item, with ties by id; those of all tasks are ranked twice, within salts and over them.

Items are taken in panels of about ``PANEL`` (item, term) pairs, dealt by a hash of the item and fetched one at a time;
a panel is what a task holds of the items.  Every panel passes over all documents once.
"""
from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .tables import batches, table, written

TOP = 10
PANEL = 1 << 18     # (item, term) pairs held at once
ITEMS = 64          # items of a tile
DOCUMENTS = 1024    # documents of a tile
COLUMNS = 1024      # terms of a column block, at most
SALTS = 64
EXACT = 1 << 53
IMPACT = 1_000_000  # above every impact

#: Term characters are ASCII letters, digits and everything beyond ASCII; only A-Z are folded.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


def _texts(column: pa.Array) -> Iterator[bytes]:
    for value in column.cast(pa.binary() if pa.types.is_string(column.type) else pa.large_binary()):
        yield value.as_py() or b""


def item_terms(items: DataFrame) -> DataFrame:
    """``item_id``, ``term``: the distinct terms of every item; rows that share an id are one item."""
    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for item, text in zip(batch.column("item_id"), _texts(batch.column("text"))):
            found = sorted(set(terms_of(text)))
            yield pa.record_batch([pa.array([item.as_py()] * len(found), pa.int64()), pa.array(found, pa.binary())], names=["item_id", "term"])
    return (items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
            .mapInArrow(batches(run), "item_id long, term binary").distinct())


def counted_terms(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """``doc_id``, ``n``, ``terms``, ``counts``: for each document with a term, its length and its terms of the vocabulary."""
    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        keep, lengths, terms, counts = [], [], [], []
        for row, text in enumerate(_texts(batch.column("text"))):
            found = terms_of(text)
            if not found:
                continue
            seen = Counter(found)
            mine = [(vocabulary[t], seen[t]) for t in seen.keys() & vocabulary.keys()]
            keep.append(row)
            lengths.append(len(found))
            terms.append([t for t, _ in mine])
            counts.append([c for _, c in mine])
        ids = batch.column("doc_id").take(pa.array(keep, pa.int64()))
        yield pa.record_batch([ids, pa.array(lengths, pa.int64()), pa.array(terms, pa.list_(pa.int32())),
                               pa.array(counts, pa.list_(pa.int64()))], names=["doc_id", "n", "terms", "counts"])
    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
            .mapInArrow(batches(run), "doc_id long, n long, terms array<int>, counts array<long>"))


@dataclass
class ItemTile:
    """Some items of a panel: their places in it, their terms, and (item, term, weight) of the matrix."""
    items: np.ndarray
    terms: np.ndarray
    row: np.ndarray
    column: np.ndarray
    weight: np.ndarray
    cuts: np.ndarray     # column blocks

    def weights(self, a: int, e: int) -> np.ndarray:
        out = np.zeros((len(self.items), e - a))
        part = (self.column >= a) & (self.column < e)
        out[self.row[part], self.column[part] - a] = self.weight[part]
        return out


def column_blocks(row: np.ndarray, column: np.ndarray, weight: np.ndarray, width: int, limit: int = EXACT) -> np.ndarray:
    """Cuts of the columns such that no item's weights times the largest impact reach ``limit`` inside a block."""
    order = np.argsort(column, kind="stable")
    bounds = np.searchsorted(column[order], np.arange(width + 1))
    held: dict[int, int] = {}
    cuts = [0]
    for c in range(width):
        cells = order[bounds[c]:bounds[c + 1]]
        full = any(held.get(int(row[i]), 0) + int(weight[i]) * IMPACT >= limit for i in cells)
        if c - cuts[-1] >= COLUMNS or (full and c > cuts[-1]):
            cuts.append(c)
            held = {}
        for i in cells:
            held[int(row[i])] = held.get(int(row[i]), 0) + int(weight[i]) * IMPACT
    return np.array([*cuts, width] if width else [0])


def item_tiles(item: np.ndarray, term: np.ndarray, weight: np.ndarray, df: np.ndarray) -> list[ItemTile]:
    """Tiles of a panel.  Items whose commonest terms agree stand together, which keeps a tile's vocabulary small."""
    if not len(item):
        return []
    order = np.lexsort((term, -df[term], item))
    item, term, weight = item[order], term[order], weight[order]
    first = np.searchsorted(item, np.arange(item.max() + 1))
    place = np.argsort(np.lexsort((term[np.minimum(first + 1, len(term) - 1)], term[first])))
    tiles = []
    for t in range(0, len(place), ITEMS):
        mine = (place[item] >= t) & (place[item] < t + ITEMS)
        items, row = np.unique(item[mine], return_inverse=True)
        terms, column = np.unique(term[mine], return_inverse=True)
        tiles.append(ItemTile(items, terms, row, column, weight[mine], column_blocks(row, column, weight[mine], len(terms))))
    return tiles


def impacts(n: np.ndarray, counts: np.ndarray, row: np.ndarray, total_docs: int, total_terms: int) -> np.ndarray:
    """Integer impact of each (document, term), with ``n`` the documents' lengths."""
    if len(n) and 90 * int(n.max()) * total_docs < 1 << 63:
        m = 10 + (90 * n * total_docs) // total_terms
    else:
        m = np.array([10 + (90 * int(x) * total_docs) // total_terms for x in n], np.int64)
    return (1_000_000_000 * counts) // (1000 * counts + 8 * m[row])


def tile_scores(tile: ItemTile, row: np.ndarray, term: np.ndarray, impact: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Documents that hold a term of the tile, and the int64 scores (item, document) of these."""
    at = np.minimum(np.searchsorted(tile.terms, term), len(tile.terms) - 1)
    held = tile.terms[at] == term
    docs, doc = np.unique(row[held], return_inverse=True)
    column, impact = at[held], impact[held]
    out = np.zeros((len(tile.items), len(docs)), np.int64)
    for a, e in zip(tile.cuts[:-1], tile.cuts[1:]):
        part = (column >= a) & (column < e)
        dense = np.zeros((len(docs), e - a))
        dense[doc[part], column[part] - a] = impact[part]
        out += (tile.weights(a, e) @ dense.T).astype(np.int64)
    return docs, out


class Best:
    """The best ``top`` (score, id) of each item so far; ids without a value come last among equals."""

    def __init__(self, items: int, top: int):
        self.top = top
        self.least = np.ones(items, np.int64)
        self.item, self.score, self.doc, self.missing = (np.zeros(0, np.int64) for _ in range(4))

    def add(self, items: np.ndarray, docs: np.ndarray, missing: np.ndarray, scores: np.ndarray) -> None:
        floor = self.least[items]
        if scores.shape[1] > self.top:  # what the top-th of this tile beats cannot enter; ties with it can
            floor = np.maximum(floor, -np.partition(-scores, self.top - 1, axis=1)[:, self.top - 1])
        i, d = np.nonzero(scores >= floor[:, None])
        if not len(i):
            return
        item = np.concatenate([self.item, items[i]])
        score = np.concatenate([self.score, scores[i, d]])
        doc, none = np.concatenate([self.doc, docs[d]]), np.concatenate([self.missing, missing[d]])
        order = np.lexsort((doc, none, -score, item))
        item = item[order]
        rank = np.arange(len(item)) - np.searchsorted(item, item)
        order, item = order[rank < self.top], item[rank < self.top]
        self.item, self.score, self.doc, self.missing = item, score[order], doc[order], none[order]
        last = rank[rank < self.top] == self.top - 1
        self.least[item[last]] = self.score[last]


def _scored(counted: DataFrame, tiles: list[ItemTile], ids: list, total_docs: int, total_terms: int, top: int) -> DataFrame:
    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(len(ids), top)
        for whole in found:
            for start in range(0, whole.num_rows, DOCUMENTS):
                batch = whole.slice(start, DOCUMENTS)
                doc = batch.column("doc_id")
                missing = doc.is_null().to_numpy(zero_copy_only=False).astype(np.int64)
                doc = doc.fill_null(0).to_numpy()
                lists = batch.column("terms")
                row = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy())
                term = lists.flatten().to_numpy()
                impact = impacts(batch.column("n").to_numpy(), batch.column("counts").flatten().to_numpy(), row, total_docs, total_terms)
                for tile in tiles:
                    docs, scores = tile_scores(tile, row, term, impact)
                    if len(docs):
                        best.add(tile.items, doc[docs], missing[docs], scores)
        yield pa.record_batch([pa.array([ids[i] for i in best.item], pa.int64()), pa.array(best.doc, mask=best.missing.astype(bool)),
                               pa.array(best.score)], names=["item_id", "doc_id", "score"])
    return counted.mapInArrow(run, "item_id long, doc_id long, score long")


def _panel_top(docs: DataFrame, pairs: pa.Table, top: int) -> DataFrame:
    words, terms = np.unique(np.array(pairs.column("term").to_pylist(), object), return_inverse=True)
    ids = sorted(set(pairs.column("item_id").to_pylist()), key=lambda i: (i is None, i or 0))
    place = {i: k for k, i in enumerate(ids)}
    item = np.array([place[i] for i in pairs.column("item_id").to_pylist()], np.int64)
    counted = written(counted_terms(docs, {w: k for k, w in enumerate(words)}))
    total = counted.agg(F.count(F.lit(1)).alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
    df = np.zeros(len(words), np.int64)
    for r in counted.select(F.explode("terms").alias("term")).groupBy("term").count().collect():  # at most the panel's vocabulary
        df[r["term"]] = r["count"]
    weight = np.array([math.floor(1000 * math.log((2 * total["docs"] + 2) / (2 * int(d) + 1))) for d in df], np.int64)
    return _scored(counted, item_tiles(item, terms, weight[terms], df), ids, total["docs"], total["terms"], top)


def ranked_documents(docs: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """``item_id``, ``rank``, ``doc_id``, ``score``: the ``top`` documents with a score above 0 for every item.

    Documents and items are read as (doc_id, text) and (item_id, text); other columns are ignored.  Null and empty texts have
    no terms.  Every document row is ranked for itself, also where ids repeat; equal scores go by id, rows without an id
    last.  Item rows that share an id, null included, are one item with the terms of all.  An item without terms, and an
    empty table, give no rows."""
    spark = docs.sparkSession
    pairs = written(item_terms(items))
    panels = -(-pairs.count() // PANEL)
    found = None
    for p in range(panels):
        mine = pairs.where(F.pmod(F.xxhash64("item_id"), F.lit(panels)) == p).toArrow()
        if mine.num_rows:
            best = _panel_top(docs, mine, top)
            found = best if found is None else found.unionByName(best)
    if found is None:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    salted = found.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)))
    near = salted.withColumn("rank", F.row_number().over(W.partitionBy("item_id", "salt").orderBy(*order))).where(F.col("rank") <= top)
    last = near.withColumn("rank", F.row_number().over(W.partitionBy("item_id").orderBy(*order))).where(F.col("rank") <= top)
    return last.select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def op11_impact_search(spark: SparkSession, folder: str) -> DataFrame:
    return ranked_documents(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_FOLDED = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE = f"""
WITH d AS (
  SELECT row_number() OVER () AS row, doc_id, regexp_extract_all({_FOLDED}, '{_TERM}') AS terms FROM documents WHERE text IS NOT NULL),
size AS (SELECT row, doc_id, len(terms) AS n FROM d WHERE len(terms) > 0),
total AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM size),
tf AS (SELECT row, term, count(*) AS tf FROM (SELECT row, unnest(terms) AS term FROM d) GROUP BY ALL),
item AS (SELECT DISTINCT item_id, unnest(regexp_extract_all({_FOLDED}, '{_TERM}')) AS term FROM benchmark WHERE text IS NOT NULL),
w AS (
  SELECT term, CAST(floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1))) AS BIGINT) AS w
  FROM tf, total WHERE term IN (SELECT term FROM item) GROUP BY term, docs),
scored AS (
  SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // total.terms)))) AS BIGINT) AS score
  FROM item JOIN w USING (term) JOIN tf USING (term) JOIN size USING (row), total GROUP BY item_id, row, doc_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked WHERE rank <= {TOP}"""
