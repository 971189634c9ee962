"""Packing of examples into sequences under limits on tokens, segments and loss-bearing tokens.

Method: vector bin packing with the dot-product heuristic.  One sequence is open at a time; of the examples that still
fit in every dimension it takes the one whose demand has the largest dot product with what the sequence has left, each
dimension as a share of its limit.  Examples are dealt to groups of about ``GROUP`` by a hash of the whole row and
of its number among equal rows, so a group is one bounded task, no key is hot, and only the last sequence of a group is left partly filled.
"""
from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .tables import release_worker_memory, table, worker_memory, written

TOKENS, SEGMENTS, LOSS_TOKENS = 4096, 128, 4096
END_ID = 2
GROUP = 4096             # examples of a packing task
_CACHE_WORDS = 700_000   # words whose ids a worker remembers from task to task; it starts afresh beyond
_CACHE_RUNS = 400_000    # the same for runs of letters, digits or signs
_NO_ID = 2 ** 32 - 1     # stands between the ids of words that are spelled together
_BREAK = np.array([_NO_ID], "<u4").tobytes()

PIECES = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
          "tokens long, segments long, loss_tokens long")
_SCHEMA = pa.schema([(c.split()[0], pa.int64()) for c in PIECES.split(", ")])


def _byte_letters() -> dict[int, str]:
    """Letter that stands for each byte in byte-level vocabularies: printable ones are themselves, the rest follow 255."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(256 + i) for i, b in enumerate(hidden)}


def tokenizer_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


class WordEncoder:
    """Ids of texts as little-endian 32-bit bytes.

    The tokenizer drops white space and never joins across it, so a text's ids are those of its words in turn, and
    each distinct word is encoded once.  Words of ASCII and Latin letters are cut into runs of letters, digits and
    signs here, and each distinct run is merged once by the tokenizer's model; any other word goes to the tokenizer."""

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer
        self.whole = Tokenizer.from_file(path)
        self.model = Tokenizer(self.whole.model)
        self.plain = regex.compile("(?:(?!<\\|)[\x21-\x7e\u00c0-\u012f\u0131-\u0148\u014a-\u017e])+").fullmatch
        # The pattern that this tokenizer's file gives for cutting words into runs.
        self.runs = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+|\n").findall
        self.known: dict[bytes, bytes] = {}
        self.known_runs: dict[str, bytes] = {"\n": _BREAK}
        self.letters = _byte_letters()

    def _learn(self, missing: list[bytes]) -> None:
        """Words are cut and spelled all at once, with line breaks, which no word has, between them."""
        found = b"\n".join(missing).decode("utf-8", "replace").split("\n")
        plain = [t.isprintable() and "<|" not in t if t.isascii() else self.plain(t) is not None for t in found]
        cut, lines = list(compress(missing, plain)), list(compress(found, plain))
        other = [pair for pair, known in zip(zip(missing, found), plain) if not known]
        if len(self.known_runs) > _CACHE_RUNS:
            self.known_runs = {"\n": _BREAK}
        if cut:
            parts = self.runs("\n".join(lines).lower())
            runs = list(set(parts).difference(self.known_runs))
            if runs:
                spelled = [r if r.isascii() else r.encode().decode("latin-1").translate(self.letters) for r in runs]
                done = self.model.encode(spelled, is_pretokenized=True, add_special_tokens=False)
                flat = np.array(done.ids, "<u4").tobytes()
                bounds = (np.searchsorted(np.array(done.word_ids), np.arange(len(runs) + 1)) * 4).tolist()
                self.known_runs.update(zip(runs, [flat[a:e] for a, e in zip(bounds, bounds[1:])]))
            flat = b"".join(map(self.known_runs.__getitem__, parts))
            ends = (np.flatnonzero(np.frombuffer(flat, "<u4") == _NO_ID) * 4).tolist()
            self.known.update(zip(cut, [flat[a:e] for a, e in zip([0, *(e + 4 for e in ends)], [*ends, len(flat)])]))
        if other:
            done = self.whole.encode_batch_fast([t for _, t in other], add_special_tokens=False)
            self.known.update((word, np.array(e.ids, "<u4").tobytes()) for (word, _), e in zip(other, done))

    def texts(self, raw: list[bytes]) -> list[bytes]:
        split = [r.split() for r in raw]
        missing = set().union(*split).difference(self.known)
        if len(self.known) + len(missing) > _CACHE_WORDS:
            self.known = {}
            missing = set().union(*split)
        if missing:
            self._learn(list(missing))
        look = self.known.__getitem__
        return [b"".join(map(look, words)) for words in split]


def worker_encoder(path: str) -> WordEncoder:
    """The worker's encoder; what it has learned serves later tasks too, until the worker is given other work."""
    if path not in worker_memory:
        worker_memory[path] = WordEncoder(path)
    return worker_memory[path]


def document_pieces(path: str, limit: int):
    """``mapInArrow`` function: documents to pieces of at most ``limit`` ids; a null text is empty."""
    tail = np.array([END_ID], "<u4").tobytes()

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(path)
        for batch in found:
            ids, texts = batch.column("doc_id"), batch.column("text")
            for at in range(0, len(batch), 256):
                some = texts.slice(at, 256).cast(pa.large_binary()).to_pylist()
                rows = []
                for doc, raw in zip(ids.slice(at, 256).to_pylist(), encoder.texts([t or b"" for t in some])):
                    raw += tail
                    total = len(raw) // 4
                    for start in range(0, total, limit):
                        part = memoryview(raw)[4 * start:4 * (start + limit)]
                        n = len(part) // 4
                        rows.append((doc, start, n, zlib.crc32(part), total, n, 1, n - 1))
                columns = list(zip(*rows))
                yield pa.record_batch([pa.array(c, pa.int64()) for c in columns], schema=_SCHEMA)
            del batch, ids, texts
            pa.default_memory_pool().release_unused()
    return run


def place(demand: np.ndarray, limits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sequence number and token offset of every row of ``demand`` (tokens, segments, loss tokens).

    An example that fills a sequence, or is over a limit, has a sequence to itself."""
    sequence, offset = np.full(len(demand), -1), np.zeros(len(demand), np.int64)
    alone = (demand > limits).any(axis=1) | (demand[:, 0] == limits[0])
    number = int(alone.sum())
    sequence[alone] = np.arange(number)
    rest = np.flatnonzero(~alone)
    if not len(rest):
        return sequence, offset
    # Examples of equal demand are one kind; kinds are in order of their tokens.
    kinds, kind_of = np.unique(demand[rest], axis=0, return_inverse=True)
    order = rest[np.argsort(kind_of.ravel(), kind="stable")]
    count = np.bincount(kind_of.ravel(), minlength=len(kinds))
    next_ = np.cumsum(count) - count
    need = [np.ascontiguousarray(kinds[:, d]) for d in range(3)]
    share = [need[d] / limits[d] for d in range(3)]
    placed = 0
    while placed < len(rest):
        room, used = [int(x) for x in limits], 0
        while True:
            top = int(np.searchsorted(need[0], room[0], "right"))
            fits = (count[:top] > 0) & (need[1][:top] <= room[1]) & (need[2][:top] <= room[2])
            value = sum(share[d][:top] * (room[d] / limits[d]) for d in range(3)) + 1
            value *= fits
            best = int(value.argmax()) if top else 0
            if not top or not fits[best]:
                break
            row = order[next_[best]]
            sequence[row], offset[row] = number, used
            used += int(need[0][best])
            room = [room[d] - int(need[d][best]) for d in range(3)]
            next_[best] += 1
            count[best] -= 1
            placed += 1
        number += 1
        if number % 64 == 0:  # kinds that are used up make room for the others
            some = count > 0
            count, next_ = count[some], next_[some]
            need, share = [x[some] for x in need], [x[some] for x in share]
    return sequence, offset


def pack(examples: DataFrame, key: list[str], limits: tuple[int, int, int] = (TOKENS, SEGMENTS, LOSS_TOKENS)) -> DataFrame:
    """``examples`` (``tokens``, ``segments``, ``loss_tokens`` and more) with ``sequence_id`` and ``offset``.

    ``key`` names the columns that order the examples of a group; equal keys are allowed and packed as separate examples.
    Null counts are zero.  An empty table stays empty."""
    examples = written(examples)
    groups = max(1, -(-examples.count() // GROUP))
    bound = np.array(limits, np.int64)

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        release_worker_memory()
        frame = frame.sort_values(key + ["tokens"], kind="stable").reset_index(drop=True)
        demand = frame[["tokens", "segments", "loss_tokens"]].fillna(0).to_numpy(np.int64)
        sequence, offset = place(demand, bound)
        frame["sequence_id"] = (frame["packing_group"].to_numpy(np.int64) << 32) + sequence
        frame["offset"] = offset
        return frame.drop(columns="packing_group")

    out = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in examples.schema.fields),
                     "sequence_id long", "offset long"])
    row = [F.col(f"`{c}`") for c in examples.columns]
    salt = F.row_number().over(W.partitionBy(*row).orderBy(*[F.col(f"`{c}`") for c in key]))
    dealt = examples.withColumn("packing_group", F.pmod(F.xxhash64(*row, salt), F.lit(groups)))
    return dealt.groupBy("packing_group").applyInPandas(run, out)


def pack_documents(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Pieces of every document with their place; a null text is empty and consists of the end id alone.

    Repeated rows are packed as often as they occur; other columns of ``docs`` are ignored."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    pieces = docs.mapInArrow(document_pieces(path or tokenizer_path(), TOKENS), PIECES)
    return pack(pieces, ["doc_id", "start"]).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "loss_tokens")


def op2_vector_packing(spark: SparkSession, folder: str) -> DataFrame:
    return pack_documents(table(spark, folder, "documents"))
