"""Near duplicates by an exact Jaccard join of word shingles under several token orders.

Method: multiple-global-order filtering.  Two sets link when ``100 * |intersection| >= 80 * |union|``, so of ``n``
tokens at most ``n - ceil(0.8 n)`` may be foreign to the partner.  That gives a prefix filter under any order of all
tokens, and every filter here is one that no linked pair can fail:

1. First order, by hash: a pair shares at least ``need`` tokens among the first ``n - ceil(0.8 n) + need``.  Counting
   these prefix tokens over the corpus leaves the sets in which enough of them are shared with anyone.
2. Second order, by rarity among the sets left, over whole sets: a set of which less than ``ceil(0.8 n)`` tokens are
   shared with anyone is out, and a linked pair shares one of the rarest tokens that remain when all but one of so many
   are left out.  Tokens shared by chance or by a passage that many texts quote come late in this order, so they do not
   tie groups together.  Sets that share a rarest token, directly or by way of others, form a candidate group; links
   never leave a group.
3. Third order, by another hash: again one shared prefix token.  Inside blocks of a group the filters of the three
   orders are intersected, and the pairs left are verified on whole sets.

Equal sets are one node throughout, so thousands of exact copies cost one set.  Groups larger than a block are split
into blocks.  Blocks are compared with themselves and with the first of their group; after that only sets are, in pairs
of blocks, that share a rare token with a set of another component.  A task returns a spanning forest of the links it
found, never all pairs.  Tokens are shuffled once an order, as blocks of records by ranges of
their hashes, one row for each range and about half a million tokens; texts are shipped, which are smaller than their sets.
"""
from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .tables import batches, components, drop_written, table, written
from .words import Words, as_long, mix, rolling, slices

SHINGLE = 5
SIMILARITY = 80          # hundredths
NEED_LEAST = 32          # tokens that must be shared in the first prefix; smaller sets are taken whole
BLOCK = 128              # sets of a block
_COLUMNS = 4096          # tokens counted at once in a block

RANGE_BYTES = 1 << 23    # text whose prefix tokens fall into one range of hashes, on average
_HELD = 1 << 19          # tokens of a block of records
_FEW = 8                 # shared tokens up to which a pair of blocks is looked up by token
_COUNTED = 64            # sets of a token that are counted exactly for its rarity

SET = np.dtype([("late", "u1"), ("doc", "<i8"), ("row", "u1", 16), ("n", "<i8"), ("node", "u1", 16)])
TOKEN = np.dtype([("token", "<u8"), ("key", "<u8")])
DEALT = "part int, sets binary, tokens binary, hits binary"
FOUND = "doc_id long, row binary, n long, node binary, key long, token long"
FOUND_ARROW = pa.schema([("doc_id", pa.int64()), ("row", pa.binary()), ("n", pa.int64()), ("node", pa.binary()), ("key", pa.int64()),
                         ("token", pa.int64())])


def shared_least(n):
    """ceil(0.8 n): tokens of a set of ``n`` that any linked set has too."""
    return -(-n * SIMILARITY // 100)


def needed(n):
    """Tokens a pair must share in the first prefix; never falls as ``n`` grows."""
    return np.minimum(shared_least(n), np.maximum(NEED_LEAST, n // 20))


def prefix_length(n):
    return n - shared_least(n) + needed(n)


def shingle_sets(words: Words, k: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each row; fewer than ``k`` words are one shingle, none give an empty set."""
    h = words.hashes(lower=True)
    grams = rolling(h, k)
    out = []
    for a, e in zip(words.bounds[:-1], words.bounds[1:]):
        if e - a >= k:
            out.append(np.unique(grams[a:e - k + 1]))
        elif e > a:
            out.append(mix(rolling(h[a:e], int(e - a)) + np.uint64(e - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def node_of(tokens: np.ndarray) -> bytes | None:
    return hashlib.blake2b(tokens.tobytes(), digest_size=16).digest() if len(tokens) else None


def row_key() -> Column:
    """128-bit identity of a row by ``doc_id`` and ``text``; rows without an id differ by their text."""
    doc, text = F.col("doc_id").cast("long").cast("string"), F.col("text").cast("string")
    return F.unhex(F.md5(F.concat(F.coalesce(doc, F.lit("?")), F.lit(" "), F.coalesce(text, F.lit("")))))


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    bounds = np.zeros(len(arrays) + 1, np.int32)
    np.cumsum([len(a) for a in arrays], out=bounds[1:])
    flat = np.concatenate(arrays) if arrays else np.zeros(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(bounds), pa.array(as_long(flat)))


def key_of(nodes: np.ndarray) -> np.ndarray:
    """First half of each identity; ``nodes`` has 16 bytes a row."""
    return np.ascontiguousarray(nodes[:, :8]).view(np.uint64).ravel()


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


def _records(blocks: pa.Table, name: str, kind: np.dtype) -> np.ndarray:
    return np.frombuffer(b"".join(blocks.column(name).to_pylist()), kind)


def _dealt(sets: np.ndarray, tokens: np.ndarray, parts: int, most: int) -> pa.RecordBatch:
    """One row for every range.  Of a token that several sets of the block share, ``most`` are sent on and the others are hits."""
    tokens = tokens[np.argsort(tokens["token"])]
    start, run = _runs(tokens["token"])
    known = np.arange(len(tokens)) - start[run] >= most if len(tokens) else np.zeros(0, bool)
    sent = tokens[~known]
    return pa.record_batch([
        pa.array(np.arange(parts), pa.int32()), *(pa.array(x, pa.binary()) for x in (
            _pieces(sets, None, parts), _pieces(sent, _range_of(sent["token"], parts), parts), _pieces(tokens[known], None, parts)))],
        names=["part", "sets", "tokens", "hits"])


def _blocks(parts: int, chosen: Callable[[np.ndarray], np.ndarray], most: int, listed: bool):
    """Tokens that ``chosen`` picks from the sets of a batch of texts, dealt to ``parts`` ranges; with ``listed`` the sets too."""
    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        if listed:
            doc, late = batch.column("doc_id").fill_null(0).to_numpy(), batch.column("doc_id").is_null().to_numpy(zero_copy_only=False)
            names = np.frombuffer(b"".join(batch.column("row").to_pylist()), np.uint8).reshape(-1, 16)
        rows, tokens, seen, held = [], [], set(), 0
        for words in slices(batch.column("text")):
            sets = shingle_sets(words)
            nodes = [node_of(s) or bytes(16) for s in sets]
            found = np.zeros(len(sets), SET)
            found["n"] = [len(s) for s in sets]
            found["node"] = np.frombuffer(b"".join(nodes), np.uint8).reshape(-1, 16)
            if listed:
                at = slice(words.first, words.first + words.rows)
                found["late"], found["doc"], found["row"] = late[at], doc[at], names[at]
                rows.append(found)
            key = key_of(found["node"])
            for i, s in enumerate(sets):
                if len(s) and nodes[i] not in seen:  # equal sets of a block are sent once
                    seen.add(nodes[i])
                    own = chosen(s)
                    mine = np.empty(len(own), TOKEN)
                    mine["token"], mine["key"] = own, key[i]
                    tokens.append(mine)
                    held += len(own)
            if held >= _HELD:
                yield _dealt(*_joined(rows, tokens), parts, most)
                rows, tokens, seen, held = [], [], set(), 0
        if rows or tokens:
            yield _dealt(*_joined(rows, tokens), parts, most)
    return run


def _joined(rows: list[np.ndarray], tokens: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return np.concatenate([np.zeros(0, SET), *rows]), np.concatenate([np.zeros(0, TOKEN), *tokens])


def _first_prefix(tokens: np.ndarray) -> np.ndarray:
    """The prefix of the first order; mixed again, since smallest hashes would all fall into the first ranges."""
    return mix(tokens[:int(prefix_length(len(tokens)))])


def _fixed(values: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(16), len(values), [None, pa.py_buffer(values.tobytes())]).cast(pa.binary())


def _shared(blocks: pa.Table) -> pa.Table:
    """Rows of the sets, without ``token``, and one row of ``key`` and ``token`` for each token of a range that several sets share."""
    sets, tokens, hits = _records(blocks, "sets", SET), _records(blocks, "tokens", TOKEN), _records(blocks, "hits", TOKEN)
    if len(tokens):
        tokens = tokens[np.argsort(tokens["token"])]
        start, run = _runs(tokens["token"])
        tokens = tokens[np.logical_or.reduceat(tokens["key"] != tokens["key"][start][run], start)[run]]
    hits = np.concatenate([tokens, hits])
    hits = hits[np.lexsort((hits["key"], hits["token"]))]
    new = np.ones(len(hits), bool)
    new[1:] = (hits["key"][1:] != hits["key"][:-1]) | (hits["token"][1:] != hits["token"][:-1])
    hits, empty = hits[new], sets["n"] == 0
    nodes = pa.compute.if_else(pa.array(empty), pa.scalar(None, pa.binary()), _fixed(sets["node"]))
    return pa.concat_tables([
        pa.table([pa.array(sets["doc"], mask=sets["late"] != 0), _fixed(sets["row"]), pa.array(sets["n"]), nodes,
                  pa.array(as_long(key_of(sets["node"])), mask=empty), pa.nulls(len(sets), pa.int64())], schema=FOUND_ARROW),
        pa.table([*(pa.nulls(len(hits), f.type) for f in list(FOUND_ARROW)[:4]), pa.array(as_long(hits["key"].copy())),
                  pa.array(as_long(hits["token"].copy()))], schema=FOUND_ARROW)])


def _counted(blocks: pa.Table) -> pa.Table:
    """One row for each token of a range and each of the ``sets`` that share it, if several do; ``sets`` ends at ``_COUNTED`` + 1."""
    tokens, hits = _records(blocks, "tokens", TOKEN), _records(blocks, "hits", TOKEN)
    sets = np.zeros(0, np.int64)
    if len(tokens):
        tokens = tokens[np.argsort(tokens["token"])]
        start, run = _runs(tokens["token"])
        sets = np.minimum(np.diff(np.append(start, len(tokens))), _COUNTED + 1)[run]
        tokens, sets = tokens[sets > 1], sets[sets > 1]
    both = np.concatenate([tokens, hits])
    return pa.table([pa.array(as_long(both["key"].copy())), pa.array(as_long(both["token"].copy())),
                     pa.array(np.concatenate([sets, np.full(len(hits), _COUNTED + 1)]), pa.int32())], names=["key", "token", "sets"])


def _need_column(n):
    """``needed`` of the smallest partner that ``n`` tokens can link to."""
    least = F.ceil(n * F.lit(SIMILARITY) / F.lit(100))
    return F.least(F.ceil(least * F.lit(SIMILARITY) / F.lit(100)), F.greatest(F.lit(NEED_LEAST), F.floor(least / 20)))


def _passed(sets: DataFrame, shared: DataFrame) -> DataFrame:
    """``key``, ``n`` and a ``row`` of the ``sets`` that pass the first order by ``shared(key, token)``."""
    found = shared.groupBy("key").agg(F.size(F.collect_set("token")).alias("shared"))
    nodes = sets.where("node IS NOT NULL").groupBy("key", "node", "n").agg(F.min("row").alias("row"))
    return nodes.join(found, "key").where(F.col("shared") >= _need_column(F.col("n"))).select("row", "key", "node", "n")


def _rare_tokens(texts: DataFrame, parts: int) -> DataFrame:
    """(key, rare): prefixes of the second order of ``texts(key, n, text)``, for the sets that pass it."""
    counted = written(texts.select("text").mapInArrow(batches(_blocks(parts, np.asarray, _COUNTED + 1, False)), DEALT)
                      .groupBy("part").applyInArrow(_counted, "key long, token long, sets int"))
    sizes = texts.groupBy("key").agg(F.min("n").alias("n"))
    least = F.ceil(F.col("n") * F.lit(SIMILARITY) / F.lit(100)).cast("int")
    ranked = (counted.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("sets", "token"))).alias("r"))
              .join(sizes, "key").withColumn("least", least).where("size(r) >= least"))
    rare = written(ranked.select("key", F.expr("slice(r, 1, size(r) - least + 1).token").alias("rare")))
    drop_written(counted)
    return rare


def candidate_groups(rare: DataFrame, split: int | None = None) -> DataFrame:
    """``block`` and ``root`` of every candidate set: ``node``, ``root``, ``block``, ``split``.

    Small groups are pooled to blocks of about ``BLOCK`` sets; a larger group has blocks of at most about ``split``."""
    split = split or BLOCK
    hubs = rare.groupBy("token").agg(F.min("node").alias("hub"))
    groups = components(rare.join(hubs, "token").select(F.col("node").alias("a"), F.col("hub").alias("b")))
    sizes = groups.groupBy("root").agg(F.count(F.lit(1)).alias("size"))
    large = F.col("size") > BLOCK
    placed = groups.join(sizes, "root")
    total = placed.count()
    small = F.pmod(F.xxhash64("root"), F.lit(max(1, total // BLOCK)))
    part = F.pmod(F.xxhash64("node"), F.ceil(F.col("size") / split))
    return written(placed.select("node", "root", F.when(large, F.xxhash64("root", part)).otherwise(small).alias("block"),
                                 large.alias("split")))


def _alone(placed: DataFrame) -> DataFrame:
    return placed.select(F.col("block").alias("low"), F.col("block").alias("high")).distinct()


def candidate_blocks(rare: DataFrame, split: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Block of every candidate set, and all pairs of blocks that share a token."""
    placed = candidate_groups(rare, split).drop("root")
    tokens = (rare.join(placed.where("split").select("node", "block"), "node").select("token", "block").distinct())
    across = (tokens.alias("x").join(tokens.alias("y"), "token").where(F.col("x.block") < F.col("y.block"))
              .select(F.col("x.block").alias("low"), F.col("y.block").alias("high")).distinct())
    return placed, written(_alone(placed).unionByName(across))


def _open_pairs(full: DataFrame, roots: DataFrame) -> DataFrame:
    """``low``, ``high``, ``node``: sets of pairs of blocks that share a rare token which sets of different components have.

    Pairs that share up to ``_FEW`` such tokens get the sets that have them, others all sets with an open token."""
    rows = (full.where("split").select("node", "block", "rare").join(roots, "node", "left")
            .select("node", "block", F.coalesce("root", "node").alias("root"), F.explode("rare").alias("token")))
    mixed = (rows.groupBy("token").agg(*(f(c).alias(f"{n}_{c}") for c in ("root", "block") for n, f in (("min", F.min), ("max", F.max))))
             .where("min_root <> max_root AND min_block <> max_block").select("token"))
    left = written(rows.join(mixed, "token"))
    sides = left.groupBy("token", "block").agg(F.min("root").alias("first"), F.max("root").alias("last"))
    x, y = sides.alias("x"), sides.alias("y")
    differ = (F.col("x.block") < F.col("y.block")) & ~((F.col("x.first") == F.col("y.last")) & (F.col("x.last") == F.col("y.first")))
    across = written(x.join(y, (F.col("x.token") == F.col("y.token")) & differ)
                     .groupBy(F.col("x.block").alias("low"), F.col("y.block").alias("high"))
                     .agg(F.count(F.lit(1)).alias("shared"), F.slice(F.collect_set("x.token"), 1, _FEW).alias("tokens")))
    either = F.explode(F.array("low", "high")).alias("block")
    few = (across.where(F.col("shared") <= _FEW).select("low", "high", F.explode("tokens").alias("token")).select("*", either)
           .join(left, ["token", "block"]).select("low", "high", "node"))
    many = (across.where(F.col("shared") > _FEW).select("low", "high", either)
            .join(left.select("block", "node").distinct(), "block").select("low", "high", "node"))
    return few.unionByName(many).distinct()


def _edges(placed: DataFrame, full: DataFrame) -> DataFrame:
    """Links that connect the components of ``full(node, text, block, rare, split)``."""
    links = lambda pairs: pairs.groupBy("low", "high").applyInPandas(_links_of_group, "a binary, b binary")
    blocks = placed.where("split").select("root", "block").distinct()
    first = blocks.groupBy("root").agg(F.min("block").alias("low"))
    star = blocks.join(first, "root").where("low < block").select("low", F.col("block").alias("high"))
    either = _alone(placed).unionByName(star).select("low", "high", F.explode(F.array_distinct(F.array("low", "high"))).alias("block"))
    edges = written(links(full.join(either, "block")))
    if star.isEmpty():
        return edges
    left = _open_pairs(full, components(edges))
    return edges.unionByName(links(full.join(left, "node")))


def third_order(tokens: np.ndarray) -> np.ndarray:
    return mix(tokens ^ np.uint64(0xA5A5F00DC0FFEE11))


def _incidence(lists: list[np.ndarray], tokens: np.ndarray) -> np.ndarray:
    out = np.zeros((len(lists), len(tokens)), np.float32)
    for row, own in zip(out, lists):
        at = np.searchsorted(tokens, own)
        at[at == len(tokens)] = 0
        row[at[tokens[at] == own]] = 1
    return out


def _overlaps(lists: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections, a few thousand shared tokens at a time."""
    values, counts = np.unique(np.concatenate(lists), return_counts=True)
    common = values[counts > 1]
    out = np.zeros((len(lists), len(lists)), np.float64)
    for at in range(0, len(common), _COLUMNS):
        some = common[at:at + _COLUMNS]
        m = _incidence([x[np.searchsorted(x, some[0]):np.searchsorted(x, some[-1], "right")] for x in lists], some)
        out += m @ m.T
    return out


def block_links(sets: list[np.ndarray], rare: list[np.ndarray], side: np.ndarray, split: bool) -> list[tuple[int, int]]:
    """Spanning forest of the links among ``sets``; with ``split`` only links between the two sides are looked for.

    The filters of the three orders are intersected first; what is left is verified on whole sets."""
    sizes = np.array([len(s) for s in sets])
    keep = np.triu(np.ones((len(sets), len(sets)), bool), 1)
    if split:
        keep &= side[:, None] != side[None, :]
    keep &= 100 * np.minimum.outer(sizes, sizes) >= SIMILARITY * np.maximum.outer(sizes, sizes)
    keep &= _overlaps([np.unique(r) for r in rare]) > 0
    if keep.any():
        first = _overlaps([s[:int(prefix_length(len(s)))] for s in sets])
        need = needed(sizes)
        keep &= first >= np.minimum.outer(need, need)
    if keep.any():
        keep &= _overlaps([np.sort(np.sort(third_order(s))[:len(s) - int(shared_least(len(s))) + 1]) for s in sets]) > 0
    if not keep.any():
        return []
    both = _overlaps(sets)
    keep &= 100 * both >= SIMILARITY * (np.add.outer(sizes, sizes) - both)
    root = list(range(len(sets)))

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    out = []
    for i, j in zip(*(x.tolist() for x in np.nonzero(keep))):
        a, b = top(i), top(j)
        if a != b:
            root[max(a, b)] = min(a, b)
            out.append((i, j))
    return out


def _links_of_group(frame: pd.DataFrame) -> pd.DataFrame:
    nodes = frame["node"].tolist()
    sets = [s for words in slices(pa.array(frame["text"], pa.string())) for s in shingle_sets(words)]
    rare = [np.asarray(t, np.int64).view(np.uint64) for t in frame["rare"]]
    pairs = block_links(sets, rare, frame["block"].to_numpy(), frame["low"].iloc[0] != frame["high"].iloc[0])
    return pd.DataFrame({"a": [nodes[i] for i, _ in pairs], "b": [nodes[j] for _, j in pairs]})


def near_duplicate_groups(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``row`` (see ``row_key``), ``n``, ``node``, ``group``, ``component_id`` for every row of ``docs``.

    ``node`` is the identity of the row's set and ``group`` that of its group, both null for a text without words."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), row_key().alias("row"))
    parts = max(1, (docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // RANGE_BYTES)
    found = written(docs.mapInArrow(batches(_blocks(parts, _first_prefix, 2, True)), DEALT).groupBy("part").applyInArrow(_shared, FOUND))
    sets = written(found.where("token IS NULL").drop("token"))
    wanted = written(_passed(sets, found.where("token IS NOT NULL").select("key", "token")))
    drop_written(found)
    texts = written(docs.select("row", "text").join(wanted, "row").dropDuplicates(["row"]).select("key", "node", "n", "text"))
    rare = _rare_tokens(texts, parts)
    placed = candidate_groups(rare.select(F.col("key").alias("node"), F.explode("rare").alias("token")))
    full = written(texts.join(placed.select(F.col("node").alias("key"), "block", "split"), "key").join(rare, "key")
                   .select("node", "text", "block", "split", "rare"))
    drop_written(texts)
    drop_written(rare)
    slim = sets.drop("key")
    edges = _edges(placed, full)
    roots = components(edges)
    known = slim.where("node IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("first"))
    linked = written(roots.join(known, "node").select("node", "root", "first"))
    ids = linked.groupBy("root").agg(F.min("first").alias("component"))
    of_node = known.join(linked.select("node", "root"), "node", "left").join(ids, "root", "left").select(
        "node", F.coalesce("root", "node").alias("group"), F.coalesce("component", "first").alias("component_id"))
    return slim.join(of_node, "node", "left").select(
        "doc_id", "row", "n", "node", "group", F.coalesce("component_id", "doc_id").alias("component_id"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``component_id`` for every row of ``docs(doc_id, text, ...)``.

    A null or empty text has an empty set and is alone.  Repeated rows of a document each get a row; rows that share
    an id but not a text are nodes of their own, and so are rows without an id.  Ties do not arise: the component's id is
    its smallest ``doc_id``, null only where no row of it has one.  Other columns are ignored, an empty table gives no
    rows."""
    return near_duplicate_groups(docs).select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def op4_ngram_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(table(spark, folder, "documents"))


_FOLDED = "translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def shingle_sql(text: str) -> str:
    """List of the distinct shingles of a text, in SQL."""
    ws = rf"regexp_extract_all({_FOLDED.format(text)}, '[^\x20\x09-\x0D]+')"
    grams = f"list_transform(range(1, greatest(2, len(x.ws) - {SHINGLE - 2})), lambda i: array_to_string(x.ws[i:i + {SHINGLE - 1}], ' '))"
    return f"(SELECT CASE WHEN len(x.ws) = 0 THEN [] ELSE list_distinct({grams}) END FROM (SELECT {ws} AS ws) x)"


ORACLE = f"""
WITH RECURSIVE d AS (SELECT doc_id, {shingle_sql("text")} AS grams FROM documents),
g AS (SELECT doc_id, CAST(len(grams) AS BIGINT) AS n, unnest(grams) AS gram FROM d),
l AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM g a JOIN g b ON a.gram = b.gram AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= {SIMILARITY} * (any_value(a.n) + any_value(b.n) - count(*))),
r AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b)
SELECT d.doc_id, CAST(len(grams) AS BIGINT) AS n_shingles, component_id
FROM d JOIN (SELECT a, min(b) AS component_id FROM r GROUP BY a) c ON c.a = d.doc_id"""
