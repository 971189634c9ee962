"""Removal of lines that are near copies of an earlier line, by an exact set-similarity join.

A line's tokens are its distinct five-word shingles, A-Z folded (a line with fewer words is one token); a line without
words is left alone.  Two lines match when ``100 * |intersection| >= 80 * |union|``.  A line goes when any earlier line
matches it, earlier by ``doc_id`` and then by line number; lines are judged on the input, not on what is left.  Rows
without an id come last, each text of them a document of its own, in the order of its hash.

Method: tokens are ordered by rarity; two matching lines share a token among the rarest of each (prefix filter).  The
place of the first shared token bounds the overlap (positional filter) and the sizes must be close (length filter);
what is left is verified on whole sets.  Rarity is counted exactly, but only over lines that can match at all and over
their prefixes: under a hash order, a match shares at least ``need`` of the first ``n - ceil(0.8 n) + need`` tokens, and
lines with too few such tokens in common with any other line are out.  Equal lines are one set with its first
occurrence, so a line repeated a million times costs one set; larger groups are split into blocks and compared by pairs
of blocks.

Lines and prefix tokens are shuffled as blocks of records by ranges of their hashes, one row for each range and about a
million tokens.  Before that, equal lines of a block become one, and of a token that several sets of a block share, two
are sent on and the others are known to share it; so no line or token is hot in its range.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .ngram_join import SHINGLE, SIMILARITY, _lists, _overlaps, candidate_blocks, row_key, shared_least, shingle_sql
from .tables import batches, table, written
from .words import Words, as_long, mix, rolling, slices

NEED_LEAST, NEED_PART = 8, 8   # at least 8 tokens, or an eighth of the set

SPLIT = 768               # sets of a block of a large group; lines are short
_RUN = 24                 # sets of a token whose pairs are listed; more are compared as a matrix

RANGE_BYTES = 1 << 22     # text whose lines and tokens fall into one range of hashes, on average
_HELD = 1 << 20           # prefix tokens of a block

PLACE = ("late", "doc", "high", "low", "line")  # order of occurrences; ``high`` and ``low`` are the halves of ``row``
LINE = np.dtype([("key", "<u8"), ("tail", "<u8"), ("late", "u1"), ("doc", "<i8"), ("high", "<u8"), ("low", "<u8"), ("line", "<i4")])
TOKEN = np.dtype([("token", "<u8"), ("key", "<u8"), ("n", "<i4")])
DEALT = "part int, lines binary, repeats binary, tokens binary, hits binary"
FOUND = "doc_id long, row binary, line int, key long, tail long, gone boolean, part int, hits binary"
FOUND_ARROW = pa.schema([("doc_id", pa.int64()), ("row", pa.binary()), ("line", pa.int32()), ("key", pa.int64()), ("tail", pa.int64()),
                         ("gone", pa.bool_()), ("part", pa.int32()), ("hits", pa.binary())])
WHOLE = pa.schema([("node", pa.int64()), ("tail", pa.int64()), ("tokens", pa.list_(pa.int64()))])


def needed(n):
    return np.minimum(shared_least(n), np.maximum(NEED_LEAST, n // NEED_PART))


def prefix_length(n):
    return n - shared_least(n) + needed(n)


def _need_columns(n):
    """``needed`` of the smallest set that ``n`` tokens can match, and ``prefix_length``."""
    least = F.ceil(n * F.lit(SIMILARITY) / F.lit(100))
    most = lambda m, shared: F.least(shared, F.greatest(F.lit(NEED_LEAST), F.floor(m / NEED_PART)))
    return most(least, F.ceil(least * F.lit(SIMILARITY) / F.lit(100))), n - least + most(n, least)


def line_shingles(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, line number, and the sorted distinct shingles, flat with bounds, of every line that has a word."""
    breaks = np.cumsum(words.data == 10)
    before = np.where(words.offsets[:-1] > 0, breaks[np.maximum(words.offsets[:-1], 1) - 1], 0) if len(breaks) else np.zeros(words.rows, np.int64)
    row = np.repeat(np.arange(words.rows), np.diff(words.bounds))
    line = breaks[words.starts] - before[row] if len(row) else np.zeros(0, np.int64)
    if not len(row):
        return row, line, np.zeros(0, np.uint64), np.zeros(1, np.int64)
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (line[1:] != line[:-1])
    first = np.flatnonzero(new)
    of = np.cumsum(new) - 1
    count = np.diff(np.append(first, len(row)))
    h = words.hashes(lower=True)
    owner, token = [], []
    grams = rolling(h, SHINGLE)
    full = np.flatnonzero(of[:len(grams)] == of[SHINGLE - 1:]) if len(grams) else np.zeros(0, np.int64)
    owner.append(of[full])
    token.append(grams[full])
    for k in range(1, SHINGLE):
        short = np.flatnonzero(count == k)
        if len(short):
            owner.append(short)
            token.append(mix(rolling(h, k)[first[short]] + np.uint64(k)))
    owner, token = np.concatenate(owner), np.concatenate(token)
    # One key sorts by line and then by the upper 40 bits of the token, which never tie within a line but for copies.
    order = np.argsort((owner.astype(np.uint64) << np.uint64(40)) | (token >> np.uint64(24)), kind="stable")
    owner, token = owner[order], token[order]
    keep = np.ones(len(owner), bool)
    keep[1:] = (owner[1:] != owner[:-1]) | (token[1:] != token[:-1])
    owner, token = owner[keep], token[keep]
    return row[first], line[first], token, np.searchsorted(owner, np.arange(len(first) + 1))


def _nodes(token: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128-bit identity of each set, ``key`` and ``tail``: two sums of independently mixed tokens."""
    if len(bounds) < 2:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    return tuple(np.add.reduceat(mix(token ^ np.uint64(s)), bounds[:-1]) for s in (0x1234567890ABCDEF, 0x0F1E2D3C4B5A6978))


def _occurrences(lines: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order of ``lines`` by set and place; in it, the first line of each set, and lines at another place than that one."""
    order = np.lexsort([lines[c] for c in (*PLACE[::-1], "tail", "key")])
    lines = lines[order]
    new = np.ones(len(lines), bool)
    new[1:] = (lines["key"][1:] != lines["key"][:-1]) | (lines["tail"][1:] != lines["tail"][:-1])
    lead = np.flatnonzero(new)[np.cumsum(new) - 1]
    again = np.zeros(len(lines), bool)
    for c in PLACE:
        again |= lines[c] != lines[c][lead]
    return order, new, again


def _runs(sorted_values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First index of every run of equal values, and the run of every value."""
    new = np.ones(len(sorted_values), bool)
    new[1:] = sorted_values[1:] != sorted_values[:-1]
    return np.flatnonzero(new), np.cumsum(new) - 1


def _range_of(h: np.ndarray, parts: int) -> np.ndarray:
    return ((h >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)


def _pieces(records: np.ndarray, part: np.ndarray | None, parts: int) -> list[bytes]:
    """Records by range, ``part`` ascending; without ``part`` in equal shares."""
    cuts = np.arange(parts + 1) * len(records) // parts if part is None else np.searchsorted(part, np.arange(parts + 1, dtype=np.uint64))
    raw, width = records.tobytes(), records.dtype.itemsize
    return [raw[a * width:e * width] for a, e in zip(cuts[:-1].tolist(), cuts[1:].tolist())]


def _dealt(lines: np.ndarray, tokens: np.ndarray, owner: np.ndarray, parts: int) -> pa.RecordBatch:
    """One row for every range; ``owner`` is the line of a token."""
    order, new, again = _occurrences(lines)
    first = np.zeros(len(lines), bool)
    first[order[new]] = True
    tokens = tokens[first[owner]]
    tokens = tokens[np.argsort(tokens["token"])]
    start, run = _runs(tokens["token"])
    known = np.arange(len(tokens)) - start[run] >= 2 if len(tokens) else np.zeros(0, bool)
    firsts, sent = lines[order[new]], tokens[~known]
    return pa.record_batch([
        pa.array(np.arange(parts), pa.int32()), *(pa.array(x, pa.binary()) for x in (
            _pieces(firsts, _range_of(firsts["key"], parts), parts), _pieces(lines[order[again]], None, parts),
            _pieces(sent, _range_of(sent["token"], parts), parts), _pieces(tokens[known], None, parts)))],
        names=["part", "lines", "repeats", "tokens", "hits"])


def _line_blocks(parts: int):
    """Lines and prefix tokens of a batch of texts, dealt to ``parts`` ranges."""
    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        doc, late = batch.column("doc_id").fill_null(0).to_numpy(), batch.column("doc_id").is_null().to_numpy(zero_copy_only=False)
        halves = np.frombuffer(b"".join(batch.column("row").to_pylist()), ">u8").reshape(-1, 2)
        lines, tokens, owners, count, held = [], [], [], 0, 0
        for words in slices(batch.column("text")):
            row, line, token, bounds = line_shingles(words)
            n, at = np.diff(bounds), row + words.first
            if not len(n):
                continue
            found = np.zeros(len(n), LINE)
            found["key"], found["tail"] = _nodes(token, bounds)
            found["late"], found["doc"], found["line"] = late[at], doc[at], line
            found["high"], found["low"] = halves[at, 0], halves[at, 1]
            owner = np.repeat(np.arange(len(n)), n)
            prefix = np.arange(len(token)) - bounds[:-1][owner] < prefix_length(n)[owner]
            owner = owner[prefix]
            mine = np.zeros(len(owner), TOKEN)
            mine["token"], mine["key"], mine["n"] = mix(token[prefix]), found["key"][owner], n[owner]
            lines.append(found)
            tokens.append(mine)
            owners.append(owner + count)
            count, held = count + len(n), held + len(mine)
            if held >= _HELD:
                yield _dealt(np.concatenate(lines), np.concatenate(tokens), np.concatenate(owners), parts)
                lines, tokens, owners, count, held = [], [], [], 0, 0
        if lines:
            yield _dealt(np.concatenate(lines), np.concatenate(tokens), np.concatenate(owners), parts)
    return run


def _records(blocks: pa.Table, name: str, kind: np.dtype) -> np.ndarray:
    return np.frombuffer(b"".join(blocks.column(name).to_pylist()), kind)


def _line_rows(lines: np.ndarray, gone: bool) -> pa.Table:
    """Lines as rows of ``FOUND``."""
    raw = np.stack([lines["high"], lines["low"]], 1).astype(">u8").tobytes()
    rows = pa.Array.from_buffers(pa.binary(16), len(lines), [None, pa.py_buffer(raw)]).cast(pa.binary())
    return pa.table([pa.array(lines["doc"], mask=lines["late"] != 0), rows, pa.array(lines["line"]), pa.array(as_long(lines["key"].copy())),
                     pa.array(as_long(lines["tail"].copy())), pa.array(np.full(len(lines), gone)), pa.nulls(len(lines), pa.int32()),
                     pa.nulls(len(lines), pa.binary())], schema=FOUND_ARROW)


def _settled(parts: int):
    """First lines and repeats of a range of sets, and the tokens of a range that several sets share, dealt to ``parts`` ranges of sets."""
    def run(blocks: pa.Table) -> pa.Table:
        lines, tokens = _records(blocks, "lines", LINE), _records(blocks, "tokens", TOKEN)
        order, new, again = _occurrences(lines)
        tokens = tokens[np.argsort(tokens["token"])]
        hits = [_records(blocks, "hits", TOKEN)]
        if len(tokens):
            start, run = _runs(tokens["token"])
            shared = np.logical_or.reduceat(tokens["key"] != tokens["key"][start][run], start)
            hits.append(tokens[shared[run]])
        hits = np.concatenate(hits)
        hits = hits[np.argsort(hits["key"])]
        out = pa.table([*(pa.nulls(parts, f.type) for f in list(FOUND_ARROW)[:6]), pa.array(np.arange(parts), pa.int32()),
                        pa.array(_pieces(hits, _range_of(hits["key"], parts), parts), pa.binary())], schema=FOUND_ARROW)
        repeats = np.concatenate([lines[order[again]], _records(blocks, "repeats", LINE)])
        return pa.concat_tables([_line_rows(lines[order[new]], False), _line_rows(repeats, True), out])
    return run


def _sharing(blocks: pa.Table) -> pa.Table:
    """Sets of a range with enough shared tokens in their prefix."""
    hits = _records(blocks, "hits", TOKEN)
    hits = hits[np.lexsort((hits["token"], hits["key"]))]
    new = np.ones(len(hits), bool)
    new[1:] = (hits["key"][1:] != hits["key"][:-1]) | (hits["token"][1:] != hits["token"][:-1])
    hits = hits[new]
    start, run = _runs(hits["key"])
    n = hits["n"][start].astype(np.int64)
    size = np.diff(np.append(start, len(hits)))
    keep = size >= needed(shared_least(n))
    bounds = np.concatenate([[0], np.cumsum(size[keep])]).astype(np.int32)
    tokens = hits["token"][keep[run]] if len(hits) else hits["token"]
    return pa.table([pa.array(as_long(hits["key"][start][keep])), pa.array(n[keep]),
                     pa.ListArray.from_arrays(pa.array(bounds), pa.array(as_long(tokens.copy())))], names=["node", "n", "tokens"])


def _whole_sets(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """All sets of the lines named in ``lines``."""
    lists = batch.column("lines")
    sizes = lists.value_lengths().to_numpy()
    wanted = (np.repeat(np.arange(len(sizes)), sizes) << 32) + lists.flatten().to_numpy()
    for words in slices(batch.column("text")):
        row, line, token, bounds = line_shingles(words)
        key, tail = _nodes(token, bounds)
        at = np.flatnonzero(np.isin(((row + words.first) << 32) + line, wanted))
        yield pa.record_batch([pa.array(as_long(key[at])), pa.array(as_long(tail[at])), _lists([token[bounds[i]:bounds[i + 1]] for i in at])], schema=WHOLE)


def _rare_tokens(passed: DataFrame) -> DataFrame:
    """The rare prefix of every set of ``passed(node, n, tokens)``: ``rare``, ``counts`` of sets and ``places``; a place counts rarer tokens."""
    need, length = _need_columns(F.col("n"))
    rows = passed.select("node", "n", F.explode("tokens").alias("token"))
    counts = rows.groupBy("token").agg(F.count(F.lit(1)).alias("sets")).where("sets > 1")
    ranked = (rows.join(counts, "token").groupBy("node", "n").agg(F.array_sort(F.collect_list(F.struct("sets", "token"))).alias("r"))
              .select("node", "r", need.cast("int").alias("need"), F.size("r").alias("shared"), length.cast("int").alias("length")))
    return (ranked.where("shared >= need").withColumn("r", F.slice("r", F.lit(1), F.expr("shared - need + 1")))
            .select("node", F.col("r.sets").alias("counts"), F.col("r.token").alias("rare"),
                    F.expr("transform(r, (x, i) -> greatest(length - shared, 0) + i)").alias("places")))


def first_shared(rare: list[np.ndarray], sizes: np.ndarray) -> np.ndarray:
    """Pairs that pass the prefix and positional filters.

    ``rare[i]``: columns (sets, token, place) of set i.  The first shared token in the order of rarity has ``place``
    tokens of the first-order prefix before it on either side, none of them in the other's prefix, so the prefixes share
    at most the smaller of what follows, and a match shares ``needed`` of them."""
    m = len(rare)
    flat = np.concatenate(rare)
    owner = np.repeat(np.arange(m), [len(r) for r in rare])
    order = np.lexsort((flat[:, 1], flat[:, 0]))
    flat, owner = flat[order], owner[order]
    cuts = np.flatnonzero((np.diff(flat[:, 0], prepend=-1) != 0) | (np.diff(flat[:, 1], prepend=0) != 0))
    size = np.diff(np.append(cuts, len(flat)))
    room, need = prefix_length(sizes[owner]) - flat[:, 2], needed(sizes[owner])
    first, keep = np.full((m, m), len(cuts)), np.zeros((m, m), bool)
    pairs = []
    for length in np.unique(size[(size > 1) & (size <= _RUN)]):  # runs of one length at once
        i, j = np.triu_indices(length, 1)
        at = np.flatnonzero(size == length)
        a, b = (cuts[at][:, None] + i).ravel(), (cuts[at][:, None] + j).ravel()
        pairs.append((np.repeat(at, len(i)), a, b))
    if pairs:
        run, a, b = (np.concatenate(x) for x in zip(*pairs))
        late = np.argsort(-run, kind="stable")  # of a pair's tokens the first is written last
        run, a, b = run[late], a[late], b[late]
        first[owner[a], owner[b]] = run
        keep[owner[a], owner[b]] = np.minimum(room[a], room[b]) >= np.minimum(need[a], need[b])
    for run in np.flatnonzero(size > _RUN):
        own = slice(cuts[run], cuts[run] + size[run])
        cell = np.ix_(owner[own], owner[own])
        before = first[cell] > run
        good = np.minimum.outer(room[own], room[own]) >= np.minimum.outer(need[own], need[own])
        keep[cell] = np.where(before, good, keep[cell])
        first[cell] = np.where(before, run, first[cell])
    return np.triu(keep, 1)


def block_matches(sets: list[np.ndarray], rare: list[np.ndarray], side: np.ndarray, split: bool) -> np.ndarray:
    """Matrix of the matching pairs (upper triangle); with ``split`` only pairs across the two sides."""
    sizes = np.array([len(s) for s in sets])
    keep = first_shared(rare, sizes)
    keep &= 100 * np.minimum.outer(sizes, sizes) >= SIMILARITY * np.maximum.outer(sizes, sizes)
    if split:
        keep &= side[:, None] != side[None, :]
    if keep.any():
        both = _overlaps(sets)
        keep &= 100 * both >= SIMILARITY * (np.add.outer(sizes, sizes) - both)
    return keep


def _matched_of_group(frame: pd.DataFrame) -> pd.DataFrame:
    """First lines of the sets of the group that have an earlier match in it."""
    place = ["late", "doc_id", "row", "line"]
    frame = frame.sort_values(place, kind="stable").drop_duplicates(["node", "tail"])
    sets = [np.asarray(t, np.int64).view(np.uint64) for t in frame["tokens"]]
    rare = [np.stack([np.asarray(c, np.int64) for c in own], 1) for own in zip(frame["counts"], frame["rare"], frame["places"])]
    keep = block_matches(sets, rare, frame["block"].to_numpy(), frame["low"].iloc[0] != frame["high"].iloc[0])
    return frame[place][keep.any(axis=0)]  # in the order of first occurrences, so the row of a pair is the earlier one


def _same_document(doc: Column, row: Column) -> Column:
    return doc.eqNullSafe(F.col("_doc")) & row.eqNullSafe(F.col("_row"))


def repeated_lines(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``row``, ``line`` (from 0) of every line to remove.

    ``row`` names the id and the text: rows that repeat both are one document, rows that share an id only, or have none,
    are documents of their own, in the order of ``row``; those without an id come after all others."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), row_key().alias("row"))
    parts = max(1, (docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // RANGE_BYTES)
    found = written(docs.mapInArrow(batches(_line_blocks(parts)), DEALT).groupBy("part").applyInArrow(_settled(max(1, parts // 8)), FOUND))
    passed = written(found.where("part IS NOT NULL").select("part", "hits").groupBy("part")
                     .applyInArrow(_sharing, "node long, n long, tokens array<long>"))
    lists = written(_rare_tokens(passed))
    placed, pairs = candidate_blocks(lists.select("node", F.explode("rare").alias("token")), SPLIT)
    firsts = found.where("NOT gone").select(F.col("key").alias("node"), "tail", "doc_id", "row", "line")
    wanted = written(firsts.join(placed.drop("split"), "node"))
    by_doc = wanted.groupBy(F.col("doc_id").alias("_doc"), F.col("row").alias("_row")).agg(F.collect_list("line").alias("lines"))
    whole = docs.join(by_doc, _same_document(F.col("doc_id"), F.col("row"))).select("text", "lines").mapInArrow(
        batches(_whole_sets), "node long, tail long, tokens array<long>")
    full = written(whole.join(wanted, ["node", "tail"]).dropDuplicates(["node", "tail"]).join(lists, "node")
                   .select("node", "tail", F.col("doc_id").isNull().alias("late"), F.coalesce("doc_id", F.lit(0)).alias("doc_id"),
                           "row", "line", "tokens", "counts", "rare", "places", "block"))
    either = pairs.select("low", "high", F.explode(F.array_distinct(F.array("low", "high"))).alias("block"))
    matched = (full.join(either, "block").groupBy("low", "high")
               .applyInPandas(_matched_of_group, "late boolean, doc_id long, row binary, line int").distinct())
    return found.where("gone").select("doc_id", "row", "line").unionByName(
        matched.select(F.when(~F.col("late"), F.col("doc_id")).alias("doc_id"), "row", "line"))


def removed_by_document(docs: DataFrame) -> DataFrame:
    return repeated_lines(docs).groupBy(F.col("doc_id").alias("_doc"), F.col("row").alias("_row")).agg(
        F.array_sort(F.collect_set("line")).alias("removed"))


def line_report(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``n_lines``, ``n_removed``, ``removed`` (line numbers from 0) for every row of ``docs``.

    A null or empty text has no lines.  Repeated rows of one document get the same answer; rows without an id, and rows
    that share one, are one document for each text."""
    plain = F.col("text").cast("string")
    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key().alias("row"),
                        F.when(F.coalesce(F.length(plain), F.lit(0)) == 0, F.lit(0))
                        .otherwise(F.length(plain) - F.length(F.replace(plain, F.lit("\n"), F.lit(""))) + 1).cast("long").alias("n_lines"))
    none = F.array().cast("array<int>")
    return sized.join(removed_by_document(docs), _same_document(F.col("doc_id"), F.col("row")), "left").select(
        "doc_id", "n_lines", F.coalesce(F.size("removed"), F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("removed", none).alias("removed"))


def without_repeated_lines(docs: DataFrame) -> DataFrame:
    """``docs`` without the repeated lines; a document of which no word is left goes, if it lost any.

    ``n_chars``, where there is such a column, follows the text."""
    removed = removed_by_document(docs).withColumnRenamed("removed", "_removed")
    joined = docs.join(removed, _same_document(F.col("doc_id").cast("long"), row_key()), "left")
    kept = F.when(F.col("_removed").isNull(), F.col("text")).otherwise(F.array_join(
        F.filter(F.split("text", "\n"), lambda _, i: ~F.array_contains("_removed", i)), "\n"))
    joined = joined.withColumn("_kept", kept).where(F.col("_removed").isNull() | F.col("_kept").rlike(r"[^\x20\x09-\x0D]"))
    changed = {"text": F.col("_kept"), "n_chars": F.when(F.col("_removed").isNull(), F.col("n_chars")).otherwise(F.length("_kept"))
               if "n_chars" in docs.columns else None}
    return joined.select(*[changed[f.name].cast(f.dataType).alias(f.name) if f.name in changed else F.col(f"`{f.name}`")
                           for f in docs.schema.fields])


def op10_line_join(spark: SparkSession, folder: str) -> DataFrame:
    """The report, with the removed line numbers as text."""
    report = line_report(table(spark, folder, "documents"))
    return report.withColumn("removed", F.array_join("removed", ","))


ORACLE = f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
s AS (SELECT doc_id, line, {shingle_sql("txt")} AS grams FROM (
  SELECT doc_id, unnest(ls) AS txt, CAST(generate_subscripts(ls, 1) - 1 AS INT) AS line FROM t)),
first AS (SELECT grams, min({{'d': doc_id, 'l': line}}) AS pos, row_number() OVER () AS id FROM (
  SELECT doc_id, line, list_sort(grams) AS grams FROM s WHERE len(grams) > 0) GROUP BY grams),
g AS (SELECT id, pos, len(grams) AS n, unnest(grams) AS gram FROM first),
m AS (
  SELECT b.id FROM g a JOIN g b ON a.gram = b.gram AND a.pos < b.pos
  GROUP BY a.id, b.id HAVING 100 * count(*) >= {SIMILARITY} * (any_value(a.n) + any_value(b.n) - count(*))),
gone AS (
  SELECT doc_id, line FROM s JOIN first f ON f.grams = list_sort(s.grams)
  WHERE f.pos <> {{'d': doc_id, 'l': line}} OR f.id IN (SELECT id FROM m)),
r AS (SELECT doc_id, count(*) AS n, string_agg(CAST(line AS VARCHAR), ',' ORDER BY line) AS removed FROM gone GROUP BY doc_id)
SELECT doc_id, CAST(CASE WHEN text = '' THEN 0 ELSE len(ls) END AS BIGINT) AS n_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_removed,
       coalesce(removed, '') AS removed
FROM t LEFT JOIN r USING (doc_id)"""
