"""Removal of repeated passages, found with difference-cover anchors.

A window is ``WINDOW`` consecutive words of one document.  A word goes when a window that covers it also starts earlier:
in a document with a smaller id, or earlier in the same one.  Windows are judged on the input.

Method: only windows of ``ANCHOR`` words at positions whose remainder modulo ``PERIOD`` lies in the difference cover
``COVER`` are hashed over the corpus.  Every difference of two remainders occurs in the cover, so two equal windows of
20 words at any two positions hold a pair of equal anchors at the same distance from their starts.  Anchors that occur
twice are extended to the full windows around them; only those are hashed at every position, with 128 bits, and the
first start of each is an aggregate that combines inside tasks, so a passage in a third of all documents is no hot key.
Texts that repeat word for word are settled by their identity and never hashed again.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .ngram_join import row_key
from .tables import batches, drop_written, table, written
from .words import Words, as_long, mix, rolling, slices

WINDOW = 20
PERIOD = 13
COVER = np.array([0, 1, 3, 9])
ANCHOR = WINDOW - PERIOD + 1
EMPTY_SHA = hashlib.sha256(b"").hexdigest()

_SCHEMA = pa.schema([("doc_id", pa.int64()), ("row", pa.binary()), ("n_words", pa.int64()), ("identity", pa.binary()), ("sha", pa.string()),
                     ("anchors", pa.list_(pa.int64()))])


def identity(hashes: np.ndarray) -> bytes | None:
    """Identity of a word sequence that has a window; None for a shorter one."""
    return hashlib.blake2b(hashes.tobytes(), digest_size=16).digest() if len(hashes) >= WINDOW else None


def joined_sha(words: Words, keep: np.ndarray) -> list[str]:
    """SHA-256 of each row's kept words, joined by one space."""
    size = words.ends - words.starts
    row = np.repeat(np.arange(words.rows), np.diff(words.bounds))
    kept = np.flatnonzero(keep)
    change = np.zeros(len(words.data) + 1, np.int64)
    np.add.at(change, words.starts[kept], 1)
    np.add.at(change, words.ends[kept], -1)
    mask = np.cumsum(change[:-1]) > 0
    data = words.data.copy()
    gap = words.ends[kept[:-1]][row[kept[:-1]] == row[kept[1:]]]  # the white space after a word that another one follows
    mask[gap], data[gap] = True, 32
    flat = data[mask].tobytes()
    length = np.bincount(row[kept], size[kept], words.rows).astype(np.int64)
    length += np.maximum(np.bincount(row[kept], minlength=words.rows) - 1, 0)
    at = np.concatenate([[0], np.cumsum(length)])
    return [hashlib.sha256(flat[a:e]).hexdigest() for a, e in zip(at, at[1:])]


def _anchored(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    in_cover = np.isin(np.arange(PERIOD), COVER)
    for words in slices(batch.column("text")):
        h, n = words.hashes(), np.diff(words.bounds)
        place = np.arange(len(h)) - np.repeat(words.bounds[:-1], n)
        size = np.repeat(n, n)
        chosen = np.flatnonzero(in_cover[place % PERIOD] & (place <= size - ANCHOR) & (size >= WINDOW))
        grams = rolling(h, ANCHOR)
        cuts = np.concatenate([[0], np.cumsum(np.bincount(np.searchsorted(words.bounds, chosen, "right") - 1, minlength=words.rows))])
        yield pa.record_batch([
            batch.column("doc_id").slice(words.first, words.rows), batch.column("row").slice(words.first, words.rows), pa.array(n, pa.int64()),
            pa.array([identity(h[a:e]) for a, e in zip(words.bounds, words.bounds[1:])], pa.binary()),
            pa.array(joined_sha(words, np.ones(len(h), bool))),
            pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(as_long(grams[chosen])))], schema=_SCHEMA)


def candidate_starts(found: np.ndarray, n: int) -> np.ndarray:
    """Starts of the windows that hold a repeated anchor; ``found`` are ranks of anchors in the document."""
    at = found // len(COVER) * PERIOD + COVER[found % len(COVER)]
    change = np.zeros(n + 2, np.int64)
    np.add.at(change, np.maximum(at - PERIOD + 1, 0), 1)
    np.add.at(change, at + 1, -1)
    return np.flatnonzero(np.cumsum(change)[:max(0, n - WINDOW + 1)] > 0)


def _each_candidate(batch: pa.RecordBatch) -> Iterator[tuple[Words, np.ndarray, int, np.ndarray, int]]:
    """Per row: its words, hashes, row, candidate starts, and its number in the batch."""
    found = batch.column("found")
    for words in slices(batch.column("text")):
        h = words.hashes()
        for r in range(words.rows):
            a, e = words.bounds[r], words.bounds[r + 1]
            ranks = np.array(found[words.first + r].as_py(), np.int64)
            yield words, h, r, candidate_starts(ranks, int(e - a)), words.first + r


def _windows(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for words, h, r, starts, row in _each_candidate(batch):
        if not len(starts):
            continue
        own = h[words.bounds[r]:words.bounds[r + 1]]
        one, two = rolling(own, WINDOW)[starts], rolling(mix(own ^ np.uint64(0x5851F42D4C957F2D)), WINDOW)[starts]
        same = pa.array(np.full(len(starts), row))
        yield pa.record_batch([pa.array(as_long(one)), pa.array(as_long(two)), batch.column("doc_id").take(same), batch.column("id").take(same),
                               pa.array(starts)], names=["h1", "h2", "doc_id", "id", "start"])


def _cleaned(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Removed words of the candidates: the windows that do not start here first cover them."""
    first = batch.column("first")
    removed, shas, kept_flags, seen = np.zeros(len(batch), np.int64), [], [], None

    def finish(words: Words) -> None:
        shas.extend(joined_sha(words, np.concatenate(kept_flags) if kept_flags else np.zeros(0, bool)))
        kept_flags.clear()

    for words, _, r, starts, row in _each_candidate(batch):
        if seen is not None and words is not seen:
            finish(seen)
        seen = words
        n = int(words.bounds[r + 1] - words.bounds[r])
        own = np.array(first[row].as_py() or [], np.int64)
        later = np.setdiff1d(starts, own)
        change = np.zeros(n + 1, np.int64)
        np.add.at(change, later, 1)
        np.add.at(change, later + WINDOW, -1)
        gone = np.cumsum(change[:-1]) > 0
        removed[row] = gone.sum()
        kept_flags.append(~gone)
    if seen is not None:
        finish(seen)
    yield pa.record_batch([batch.column("identity"), pa.array(removed), pa.array(shas, pa.string())], names=["identity", "n_removed", "kept_sha256"])


def remove_repeats(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``n_words``, ``n_removed``, ``kept_sha256`` for every row of ``docs``.

    A null text has no words.  Rows that repeat a document are that document and get its result.  Rows that share an id
    with other words are documents of their own, in the order of the rows; rows without an id come after all others and
    are told apart in the same way.  Other columns are ignored."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), row_key().alias("row"))
    # Rows get short numbers for the shuffles; they hold because the table with them is written.
    rows = written(docs.mapInArrow(batches(_anchored), "doc_id long, row binary, n_words long, identity binary, sha string, anchors array<long>")
                   .withColumn("id", F.monotonically_increasing_id()))
    order = F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "id", "row")
    firsts = written(rows.where("identity IS NOT NULL").groupBy("identity").agg(F.min(order).alias("at"))
                     .select("identity", "at.doc_id", "at.id", "at.row"))
    twice = written(rows.select(F.explode("anchors").alias("anchor")).groupBy("anchor").count().where("count > 1").select("anchor"))
    found = (rows.select("id", F.posexplode("anchors").alias("rank", "anchor")).join(twice.hint("shuffle_hash"), "anchor")
             .groupBy("id").agg(F.collect_set("rank").alias("found")))
    found = written(found.join(firsts.select("id", "row", "identity"), "id"))
    drop_written(twice)
    chosen = written(docs.join(found, "row").select("doc_id", "id", "text", "identity", "found"))
    starts = (chosen.mapInArrow(batches(_windows), "h1 long, h2 long, doc_id long, id long, start long")
              .groupBy("h1", "h2").agg(F.min(F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "id", "start")).alias("at")))
    own = starts.groupBy(F.col("at.id").alias("id")).agg(F.collect_list("at.start").alias("first"))
    result = written(chosen.join(own, "id", "left").select("text", "identity", "found", "first")
                     .mapInArrow(batches(_cleaned), "identity binary, n_removed long, kept_sha256 string").dropDuplicates(["identity"]))
    known = firsts.select("identity", F.col("doc_id").alias("first_doc")).join(result, "identity", "left")
    copy = F.col("identity").isNotNull() & ~F.col("doc_id").eqNullSafe(F.col("first_doc"))
    return rows.select("doc_id", "n_words", "identity", "sha").join(known, "identity", "left").select(
        "doc_id", "n_words", F.when(copy, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(copy, F.lit(EMPTY_SHA)).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"))


def op5_difference_cover(spark: SparkSession, folder: str) -> DataFrame:
    return remove_repeats(table(spark, folder, "documents"))


ORACLE = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
w AS (
  SELECT doc_id, i, array_to_string(ws[i:i + {WINDOW - 1}], ' ') AS win
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - {WINDOW - 2})) AS i FROM d WHERE len(ws) >= {WINDOW})),
later AS (SELECT doc_id, i FROM w QUALIFY row_number() OVER (PARTITION BY win ORDER BY doc_id, i) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + {WINDOW})) AS j FROM later),
kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY j) AS words, count(*) AS n
  FROM (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS j FROM d) ANTI JOIN gone USING (doc_id, j) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(words, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)"""
