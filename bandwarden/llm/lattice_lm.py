"""Language-model scores of documents: subword lattice likelihood, with a word-count base beside it.

Method: a text is a sequence of pieces of an existing unigram vocabulary and one end.  A piece that starts a word carries
the word mark; every byte also has a piece of its own, so every text can be spelled.  The probability of a word is the
sum over all its segmentations, found by a forward recursion in log space that runs over many words at once; a
document's is the product over its words and the end.  Piece probabilities start from the vocabulary's scores (a rank,
so the weight is one over it) and are re-estimated once by expected counts over every training word of the corpus.

Words are counted in chunks of neighbouring ids: each task sends a word once per chunk, counts are summed over the
corpus, and only words that several chunks share go back.  The vocabulary's expected counts are one fixed vector.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import table, written
from .words import Words, as_long, slices

CHUNK_ROWS = 4096
END = 0x20          # stands for the word mark inside byte strings; no word has a space
_PRIOR = 1000.0     # weight of the vocabulary's own scores beside the expected counts
_PENDING = 3_000_000
_BASE = np.uint64(0x9E3779B97F4A7C1B)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_CODES = np.random.default_rng(77).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_BITS = 22


def vocabulary_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("piece_bpe_32k.model")


@dataclass
class Pieces:
    """Piece strings by hash, their starting weights, and the pieces of single bytes at the end."""
    keys: np.ndarray      # sorted hashes
    ids: np.ndarray       # piece of each key
    lengths: list[int]
    present: np.ndarray   # filter on the upper bits of a hash
    start: np.ndarray     # probabilities by the vocabulary's scores; the last entry is the end

    @property
    def first_byte(self) -> int:
        return len(self.start) - 257


def _hash(raw: bytes) -> int:
    value, power = 0, 1
    for b in raw:
        value, power = value + int(_CODES[b]) * power, power * int(_BASE)
    return value % (1 << 64)


def load_pieces(path: str) -> Pieces:
    import sentencepiece
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    strings, weight = [], []
    for i in range(model.get_piece_size()):
        piece, score = model.id_to_piece(i), model.get_score(i)
        if model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or "▁" in piece[1:] or score < -1e8:
            continue
        strings.append(piece.replace("▁", " ").encode())
        weight.append(1 / (1 - score))
    keys = np.array([_hash(s) for s in strings], np.uint64)
    order = np.argsort(keys)
    present = np.zeros(1 << _BITS, bool)
    present[keys >> np.uint64(64 - _BITS)] = True
    weight = np.array([*weight, *[min(weight) / 256] * 256, 0.0])
    weight[-1] = weight.sum() / 500  # an end for every few hundred pieces, until it is counted
    return Pieces(keys[order], order, sorted({len(s) for s in strings}), present, weight / weight.sum())


def _edges(pieces: Pieces, letters: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """Piece ids of all substrings: (length, matrix words x starts), -1 where there is none."""
    words, size = letters.shape
    power = np.ones(size + 1, np.uint64)
    power[1:] = np.cumprod(np.full(size, _BASE))
    down = np.ones(size + 1, np.uint64)
    down[1:] = np.cumprod(np.full(size, _INVERSE))
    sums = np.zeros((words, size + 1), np.uint64)
    np.cumsum(_CODES[letters] * power[:size], axis=1, out=sums[:, 1:])
    out = []
    for n in pieces.lengths:
        if n > size:
            break
        h = (sums[:, n:] - sums[:, :size - n + 1]) * down[:size - n + 1]
        ids = np.full(h.shape, -1, np.int32)
        row, col = np.nonzero(pieces.present[h >> np.uint64(64 - _BITS)])
        found = h[row, col]
        at = np.minimum(np.searchsorted(pieces.keys, found), len(pieces.keys) - 1)
        hit = pieces.keys[at] == found
        ids[row[hit], col[hit]] = pieces.ids[at[hit]]
        out.append((n, ids))
    return out


def _log_sum(parts: list[np.ndarray]) -> np.ndarray:
    s = np.stack(parts)
    top = s.max(axis=0)
    return top + np.log(np.exp(s - top).sum(axis=0))


def _lattice(pieces: Pieces, log_p: np.ndarray, letters: np.ndarray) -> tuple[np.ndarray, list, np.ndarray]:
    """Forward sums (starts x words), the edges with their log weights, and the log probability of every word."""
    words, size = letters.shape
    edges = [(n, ids, np.where(ids >= 0, log_p[ids], -np.inf).T) for n, ids in _edges(pieces, letters)]
    single = pieces.first_byte + letters.astype(np.int32)
    edges.append((1, single, log_p[single].T))
    ahead = np.zeros((size + 1, words))
    for t in range(1, size + 1):
        ahead[t] = _log_sum([ahead[t - n] + weight[t - n] for n, _, weight in edges if n <= t])
    return ahead, edges, ahead[size]


def _by_length(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Words of equal length together, as matrices that begin with the word mark, a bounded number at a time."""
    for n in np.unique(lengths):
        which = np.flatnonzero(lengths == n)
        step = max(1, 400_000 // int(n + 1))
        for at in range(0, len(which), step):
            some = which[at:at + step]
            letters = np.full((len(some), n + 1), END, np.uint8)
            letters[:, 1:] = flat[starts[some][:, None] + np.arange(n)]
            yield some, letters


def word_scores(pieces: Pieces, p: np.ndarray, flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Natural log of the lattice probability of every word."""
    out, log_p = np.zeros(len(starts)), np.log(p)
    for some, letters in _by_length(flat, starts, lengths):
        out[some] = _lattice(pieces, log_p, letters)[2]
    return out


def expected_counts(pieces: Pieces, p: np.ndarray, flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Expected uses of every piece in words that occur ``n`` times."""
    out, log_p = np.zeros(len(p)), np.log(p)
    for some, letters in _by_length(flat, starts, lengths):
        ahead, edges, total = _lattice(pieces, log_p, letters)
        size = letters.shape[1]
        back = np.zeros((size + 1, len(some)))
        for t in range(size - 1, -1, -1):
            back[t] = _log_sum([back[t + k] + weight[t] for k, _, weight in edges if t + k <= size])
        for k, ids, weight in edges:
            share = np.exp(ahead[:size - k + 1] + weight + back[k:] - total) * n[some]
            used = ids.T >= 0
            out += np.bincount(ids.T[used], share[used], len(p))
    return out


class _Distinct:
    """Distinct words of some slices with their training counts."""

    def __init__(self):
        self.hashes, self.counts, self.flat, self.lengths, self.size = [], [], [], [], 0

    def add(self, words: Words, h: np.ndarray, trained: np.ndarray) -> None:
        unique, first, inverse = np.unique(h, return_index=True, return_inverse=True)
        counts = np.bincount(inverse, np.repeat(trained, np.diff(words.bounds)), len(unique)).astype(np.int64)
        a, length = words.starts[first], (words.ends - words.starts)[first]
        flat = words.data[np.repeat(a - np.cumsum(length) + length, length) + np.arange(length.sum())]
        upper = (flat >= 65) & (flat <= 90)
        flat[upper] += 32
        for mine, new in ((self.hashes, unique), (self.counts, counts), (self.flat, flat), (self.lengths, length)):
            mine.append(new)
        self.size += len(unique)

    def merged(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Sorted hashes, counts, letters, and the first letter and length of every word."""
        if not self.hashes:
            none = np.zeros(0, np.int64)
            return np.zeros(0, np.uint64), none, np.zeros(0, np.uint8), none, none
        h, length = np.concatenate(self.hashes), np.concatenate(self.lengths)
        unique, first, inverse = np.unique(h, return_index=True, return_inverse=True)
        counts = np.bincount(inverse, np.concatenate(self.counts), len(unique)).astype(np.int64)
        return unique, counts, np.concatenate(self.flat), (np.cumsum(length) - length)[first], length[first]


def held_out(doc_id: str | Column = "doc_id") -> Column:
    doc_id = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 1, F.lit(False))


_COUNTED = pa.schema([("hash", pa.int64()), ("chunk", pa.int64()), ("n", pa.int64()), ("weight", pa.float64())])


def _count(path: str):
    """``mapInArrow`` function: words per chunk with training counts (``weight`` null), and expected piece counts."""
    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = load_pieces(path)
        expected = np.zeros(len(pieces.start))
        open_, chunk = _Distinct(), None

        def done() -> pa.RecordBatch:
            h, n, flat, starts, lengths = open_.merged()
            some = np.flatnonzero(n)
            nonlocal expected
            expected += expected_counts(pieces, pieces.start, flat, starts[some], lengths[some], n[some])
            return pa.record_batch([pa.array(as_long(h)), pa.array(np.full(len(h), chunk)), pa.array(n), pa.nulls(len(h), pa.float64())],
                                   schema=_COUNTED)

        for batch in found:
            chunks, held = batch.column("chunk").to_numpy(), batch.column("held_out").to_numpy(zero_copy_only=False)
            edges = np.flatnonzero(np.diff(chunks, prepend=chunks[0] - 1 if len(chunks) else 0))
            for a, e in zip(edges, np.append(edges[1:], len(batch))):
                if open_.size and (chunks[a] != chunk or open_.size > _PENDING):
                    yield done()
                    open_ = _Distinct()
                chunk = int(chunks[a])
                for words in slices(batch.column("text").slice(a, e - a)):
                    trained = ~held[a + words.first:a + words.first + words.rows]
                    open_.add(words, words.hashes(lower=True), trained)
                    expected[-1] += trained.sum()
        if open_.size:
            yield done()
        used = np.flatnonzero(expected)
        yield pa.record_batch([pa.array(used), pa.array(np.full(len(used), -1)), pa.array(np.zeros(len(used), np.int64)),
                               pa.array(expected[used])], schema=_COUNTED)
    return run


def _score_chunk(path: str, p: np.ndarray, train_tokens: int, distinct: int, train_docs: int):
    """Cogrouped function: texts of a chunk and the counts of its words that other chunks have too."""
    names = ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"]
    loaded: list[Pieces] = []

    def base(c: np.ndarray) -> np.ndarray:
        return np.log10((c + 0.5) / (train_tokens + 0.5 * (distinct + 1)))

    def run(texts: pa.Table, counts: pa.Table) -> pa.Table:
        if not loaded:
            loaded.append(load_pieces(path))
        texts = texts.combine_chunks()
        column, held = texts.column("text"), texts.column("held_out").to_numpy(zero_copy_only=False)
        distinct_words = _Distinct()
        for words in slices(column):
            distinct_words.add(words, words.hashes(lower=True), ~held[words.first:words.first + words.rows])
        h, c, flat, starts, lengths = distinct_words.merged()
        shared = counts.column("hash").to_numpy().view(np.uint64)
        at = np.searchsorted(h, shared)  # a word occurs in the chunk, or its count would not be here
        c[at] = counts.column("n").to_numpy()
        log_word = word_scores(loaded[0], p, flat, starts, lengths) / np.log(10)
        base_word = base(c)
        out = np.zeros((4, len(texts)))
        for words in slices(column):
            where = np.searchsorted(h, words.hashes(lower=True))
            row = np.repeat(np.arange(words.rows), np.diff(words.bounds)) + words.first
            for i, value in enumerate((np.ones(len(where)), c[where] > 0, base_word[where], log_word[where])):
                out[i] += np.bincount(row, value, len(texts))
        out += np.array([1, train_docs > 0, base(np.array(train_docs)), np.log10(p[-1])])[:, None]
        return pa.Table.from_arrays([texts.column("doc_id"), texts.column("held_out"), pa.array(out[0].astype(np.int64)),
                                     pa.array(out[1].astype(np.int64)), pa.array(out[2]), pa.array(out[3])], names=names)
    return run


def lattice_scores(docs: DataFrame, path: str | None = None) -> DataFrame:
    """``doc_id``, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score`` of every row.

    A null text is empty and has the end alone.  Repeated rows are documents of their own; a null id trains.  Without
    training rows all counts are zero and the pieces keep the vocabulary's own weights.  Other columns are ignored."""
    path = path or vocabulary_path()
    doc_id = F.col("doc_id").cast("long")
    low, high, rows = docs.agg(F.min(doc_id), F.max(doc_id), F.count(F.lit(1))).first()
    width = max(1, ((high or 0) - (low or 0) + 1) * CHUNK_ROWS // max(1, rows))
    texts = docs.select(doc_id.alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
                        held_out(doc_id).alias("held_out"),
                        F.coalesce(F.floor((doc_id - F.lit(low or 0)) / F.lit(width)), F.lit(0)).cast("long").alias("chunk"))
    counted = written(texts.mapInArrow(_count(path), "hash long, chunk long, n long, weight double"))
    sums = written(counted.where("weight IS NULL").groupBy("hash").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("chunks")))
    tokens, distinct = sums.agg(F.sum("n"), F.count(F.when(F.col("n") > 0, 1))).first()
    pieces = load_pieces(path)
    expected = np.zeros(len(pieces.start))
    for r in counted.where("weight IS NOT NULL").groupBy("hash").agg(F.sum("weight").alias("weight")).collect():  # one row per piece
        expected[r.hash] = r.weight
    train_docs = int(round(expected[-1]))
    p = expected + _PRIOR * pieces.start
    p /= p.sum()
    train_tokens = (tokens or 0) + train_docs
    shared = counted.where("weight IS NULL").select("hash", "chunk").join(
        sums.where("chunks > 1").select("hash", "n"), "hash").dropDuplicates(["hash", "chunk"])
    run = _score_chunk(path, p, train_tokens, distinct + (train_docs > 0), train_docs)
    scored = texts.groupBy("chunk").cogroup(shared.groupBy("chunk")).applyInArrow(
        run, "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(train_tokens).cast("long").alias("train_tokens"), "base_score", "score")


def op6_lattice_likelihood(spark: SparkSession, folder: str) -> DataFrame:
    return lattice_scores(table(spark, folder, "documents"))
