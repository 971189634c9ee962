"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

Method: a document is a sparse vector of hashed words (counts, scaled to length one), one-hot bins of structure
statistics of the whole text, and the bin of the metadata column ``n_chars``.  All pairs interact with low rank; with
the sum-of-squares identity, 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2), a score takes time linear in the text.
Labels, language, source and document id are never inputs.

Training uses at most ``SAMPLE`` labelled rows, those with the smallest hashes, and never a held-out row
(crc32 of the id's text modulo 3 equal to 1).  Everything else covers all rows and whole texts.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import batches, table
from .words import Words, slices

SAMPLE = 6000
WORD_BUCKETS = 1 << 14
RANK = 8
EPOCHS = 12
BATCH = 64
SEED = 11

_SHARES = np.array([1e-9, 0.001, 0.003, 0.01, 0.02, 0.04, 0.08, 0.15, 0.3, 0.5, 0.75])
_CLASSES = {"sign": b"#*$%&<>", "bar": b"|", "bang": b"!?", "stop": b".,;:", "digit": b"0123456789",
            "upper": bytes(range(65, 91)), "lower": bytes(range(97, 123)), "space": b" \t\n\x0b\x0c\r", "line": b"\n"}
_EDGES = {
    "sign": _SHARES, "bar": _SHARES, "bang": _SHARES, "stop": _SHARES, "digit": _SHARES, "space": _SHARES, "capitals": _SHARES,
    "bytes": np.array([1, 16, 64, 128, 256, 512, 1024, 2048, 4096, 8192, 16384, 65536]),
    "word_length": np.array([1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 12, 16, 24]),
    "words_per_line": np.array([1, 2, 4, 8, 16, 32, 64, 128, 512]),
    "distinct": np.array([0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.97]),
    "top_word": _SHARES, "repeats": _SHARES,
    "metadata": np.array([0, 1, 16, 64, 128, 256, 512, 1024, 2048, 4096, 8192, 16384, 65536]),
}
_FIRST = dict(zip(_EDGES, np.cumsum([WORD_BUCKETS, *[len(e) + 1 for e in _EDGES.values()]])))
FEATURES = WORD_BUCKETS + sum(len(e) + 1 for e in _EDGES.values())


@dataclass
class Sparse:
    """Rows of (feature, value), flat; row r holds bounds[r] .. bounds[r + 1]."""
    feature: np.ndarray
    value: np.ndarray
    bounds: np.ndarray


def features(words: Words, n_chars: np.ndarray) -> Sparse:
    """Feature rows of a slice; ``n_chars`` is -1 where the metadata is missing."""
    rows, n = words.rows, np.diff(words.bounds)
    size = np.diff(words.offsets)
    bucket = (words.hashes(lower=True) & np.uint64(WORD_BUCKETS - 1)).astype(np.int64)
    key = np.repeat(np.arange(rows), n) * WORD_BUCKETS + bucket
    repeats = np.bincount(key[1:][key[1:] == key[:-1]] // WORD_BUCKETS, minlength=rows)
    key.sort()
    first = np.flatnonzero(np.diff(key, prepend=-1))
    count = np.diff(np.append(first, len(key))).astype(np.float64)
    row, word = key[first] // WORD_BUCKETS, key[first] % WORD_BUCKETS
    norm = np.sqrt(np.bincount(row, count * count, rows))
    held = {}
    for name, letters in _CLASSES.items():
        member = np.zeros(256, np.int64)
        member[list(letters)] = 1
        total = np.concatenate([[0], np.cumsum(member[words.data])])
        held[name] = np.diff(total[words.offsets])
    each = lambda a, b: a / np.maximum(1, b)
    distinct = np.bincount(row, minlength=rows)
    top = np.zeros(rows)
    np.maximum.at(top, row, count)
    stats = {name: each(held[name], size) for name in ("sign", "bar", "bang", "stop", "digit", "space")}
    stats |= {"capitals": each(held["upper"], held["upper"] + held["lower"]), "bytes": size,
              "word_length": each(size - held["space"], n), "words_per_line": each(n, held["line"] + 1),
              "distinct": each(distinct, n), "top_word": each(top, n), "repeats": each(repeats, n),
              "metadata": n_chars}
    bins = np.stack([_FIRST[k] + np.searchsorted(edges, stats[k], "right") for k, edges in _EDGES.items()], 1)
    width = bins.shape[1]
    feature = np.concatenate([word, bins.ravel()])
    value = np.concatenate([count / norm[row], np.full(bins.size, 1 / np.sqrt(width))])
    owner = np.concatenate([row, np.repeat(np.arange(rows), width)])
    order = np.argsort(owner, kind="stable")
    return Sparse(feature[order], value[order], np.searchsorted(owner[order], np.arange(rows + 1)))


class Machine:
    """Second-order factorisation machine for a 0/1 label."""

    def __init__(self, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.bias = 0.0
        self.weights = np.zeros((FEATURES, 1 + RANK))  # linear weight, then factors
        self.weights[:, 1:] = rng.normal(0, 0.05, (FEATURES, RANK))

    def _sums(self, x: Sparse) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        scaled = self.weights[x.feature] * x.value[:, None]
        total = np.add.reduceat(scaled, x.bounds[:-1])
        squares = np.add.reduceat(scaled[:, 1:] ** 2, x.bounds[:-1])
        return scaled, total, self.bias + total[:, 0] + 0.5 * (total[:, 1:] ** 2 - squares).sum(1)

    def score(self, x: Sparse) -> np.ndarray:
        """Probabilities in time linear in the entries; every row has its structure bins, so none is empty."""
        z = self._sums(x)[2]
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))

    def fit(self, x: Sparse, label: np.ndarray, seed: int = SEED) -> "Machine":
        """Adagrad on the logistic loss with a small ridge; rows in seeded random batches."""
        rng = np.random.default_rng(seed)
        seen, rate, ridge = np.full_like(self.weights, 1e-6), 0.15, 1e-4
        seen_bias = 1e-6
        for _ in range(EPOCHS):
            order = rng.permutation(len(label))
            for at in range(0, len(order), BATCH):
                part = take(x, order[at:at + BATCH])
                scaled, total, z = self._sums(part)
                error = 1 / (1 + np.exp(-np.clip(z, -500, 500))) - label[order[at:at + BATCH]]
                row = np.repeat(np.arange(len(error)), np.diff(part.bounds))
                e = (error[row] * part.value)[:, None]
                grad = np.concatenate([e, e * (total[row, 1:] - scaled[:, 1:])], 1) / len(error)
                used, where = np.unique(part.feature, return_inverse=True)
                step = np.stack([np.bincount(where, grad[:, f], len(used)) for f in range(1 + RANK)], 1)
                step += ridge * self.weights[used] / len(error)
                seen[used] += step * step
                self.weights[used] -= rate * step / np.sqrt(seen[used])
                g = error.mean()
                seen_bias += g * g
                self.bias -= rate * g / np.sqrt(seen_bias)
        return self


def take(x: Sparse, rows: np.ndarray) -> Sparse:
    length = np.diff(x.bounds)[rows]
    bounds = np.concatenate([[0], np.cumsum(length)])
    at = np.arange(bounds[-1]) + np.repeat(x.bounds[rows] - bounds[:-1], length)
    return Sparse(x.feature[at], x.value[at], bounds)


def held_out(doc_id: str | Column = "doc_id") -> Column:
    doc_id = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _metadata(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("n_chars").cast(pa.int64()).fill_null(-1).to_numpy(zero_copy_only=False)


def _feature_rows(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    meta, label = _metadata(batch), batch.column("quality")
    for words in slices(batch.column("text")):
        x = features(words, meta[words.first:words.first + words.rows])
        bounds = pa.array(x.bounds.astype(np.int32))
        yield pa.record_batch([
            label.slice(words.first, words.rows), pa.ListArray.from_arrays(bounds, pa.array(x.feature.astype(np.int32))),
            pa.ListArray.from_arrays(bounds, pa.array(x.value.astype(np.float32)))], names=["quality", "feature", "value"])


def _inputs(docs: DataFrame) -> DataFrame:
    n_chars = F.col("n_chars").cast("long") if "n_chars" in docs.columns else F.lit(None).cast("long")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), n_chars.alias("n_chars"))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Machine:
    """Machine fitted on at most ``sample`` labelled documents; without any label every score is one half."""
    known = (labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out())
             .groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").cast("int").alias("quality"))
             .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample))
    rows = (_inputs(docs).join(F.broadcast(known), "doc_id")  # at most ``sample`` rows
            .select("text", "n_chars", "quality", "doc_id")
            .mapInArrow(batches(_numbered_rows), "doc_id long, quality int, feature array<int>, value array<float>").toArrow())
    machine = Machine()
    rows = rows.sort_by([("doc_id", "ascending")]).combine_chunks()
    if not rows.num_rows:
        machine.weights[:] = 0
        return machine
    lists = rows.column("feature").combine_chunks()
    values = rows.column("value").combine_chunks()
    bounds = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
    x = Sparse(lists.flatten().to_numpy().astype(np.int64), values.flatten().to_numpy().astype(np.float64), bounds)
    return machine.fit(x, rows.column("quality").to_numpy().astype(np.float64))


def _numbered_rows(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    at = 0
    for out in _feature_rows(batch):
        yield pa.record_batch([batch.column("doc_id").slice(at, len(out)), *out.columns], names=["doc_id", *out.schema.names])
        at += len(out)


def _scores(batch: pa.RecordBatch, machine: Machine) -> np.ndarray:
    meta, out = _metadata(batch), np.zeros(len(batch))
    for words in slices(batch.column("text")):
        rows = slice(words.first, words.first + words.rows)
        out[rows] = machine.score(features(words, meta[rows]))
    return out


def score(docs: DataFrame, machine: Machine) -> DataFrame:
    """``doc_id``, ``held_out``, ``score``, ``predicted`` for every row; a null text is an empty text.

    A missing or null ``n_chars`` has a bin of its own; other columns are ignored; repeated rows get equal scores."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)  # a fixed number of weights

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        if len(batch):
            yield pa.record_batch([batch.column("doc_id"), pa.array(_scores(batch, shared.value))], names=["doc_id", "score"])
    return _inputs(docs).mapInArrow(batches(run), "doc_id long, score double").select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def accepted(docs: DataFrame, machine: Machine) -> DataFrame:
    """The rows of ``docs`` that are predicted to be good, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)
    has_size = "n_chars" in docs.columns

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        if len(batch):
            size = batch.column("n_chars") if has_size else pa.nulls(len(batch), pa.int64())
            inputs = pa.record_batch([batch.column("text"), size], names=["text", "n_chars"])
            yield batch.filter(pa.array(_scores(inputs, shared.value) >= 0.5))
    return docs.mapInArrow(batches(run), docs.schema)


def op1_quality_fm(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return score(docs, train(docs, table(spark, folder, "labels")))
