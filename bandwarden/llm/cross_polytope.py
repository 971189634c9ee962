"""Near duplicates among embeddings by cross-polytope hashing with multiprobe buckets.

Method: three rounds of random signs and a fast Hadamard transform rotate a vector; its code is the signed axis it then
lies closest to.  A table joins the codes of several rotations.  A vector resides in the bucket of its own codes in every
table and visits the ``PROBES - 1`` buckets whose codes it misses by least.  A pair is a candidate where one of the two resides in
a bucket that the other resides in or visits, and links if the cosine of the vectors themselves reaches the threshold.

The number of codes follows from the count, so that most buckets hold nothing but near vectors; the number of tables
follows from pairs simulated right at the threshold, so that ``RECALL`` of them would be found at any size.

Equal vectors are one node with a multiplicity.  Buckets that cannot hold a pair are left out before any vector is
shipped.  A bucket of more than ``BLOCK`` nodes is cut into blocks that meet in pairs in separate tasks.  A task
verifies by matrix products and returns link counts and a spanning forest for each node, never pairs; a pair that meets in several
buckets is counted in the smallest of them.
"""
from __future__ import annotations

import hashlib
import itertools
import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import batches, components, drop_written, table, written
from .words import as_long, mix

THRESHOLD = 0.95
PROBES = 8
OPTIONS = 3          # axes of a rotation that probes may use
LOAD = 16            # buckets for each vector, at least
RECALL = 0.98
SIMULATED = 2000     # pairs at the threshold
BLOCK = 1024         # nodes of a block
BUFFER = 8192        # rows handled at once in a task, and the largest pair of blocks
HITS = 1 << 16       # verified pairs looked up at once
HEAVY = 1000         # a vector with more than one in HEAVY of all rows has its rows joined by broadcast


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of the rows; their length is a power of two."""
    n, p = x.shape
    h = 1
    while h < p:
        pairs = x.reshape(n, p // (2 * h), 2, h)
        x = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(n, p)
        h *= 2
    return x


def unit_rows(x: np.ndarray) -> np.ndarray:
    """Rows of length one, whatever their scale; rows of zeros stay."""
    x = x / np.maximum(np.abs(x).max(axis=1, keepdims=True, initial=0), np.finfo(float).tiny)
    return x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), np.finfo(float).tiny)


@dataclass(frozen=True)
class Hashing:
    """The tables for vectors of ``dimensions`` components."""
    dimensions: int
    functions: int
    tables: int
    seed: int = 20240517

    @property
    def padded(self) -> int:
        return max(2, 1 << (self.dimensions - 1).bit_length())

    @cached_property
    def signs(self) -> np.ndarray:
        rng = np.random.default_rng([self.seed, self.dimensions])
        return rng.integers(0, 2, (self.tables, self.functions, 3, self.padded)) * 2.0 - 1

    @cached_property
    def choices(self) -> np.ndarray:
        """Which option each rotation takes; the first row takes every rotation's own axis."""
        options = min(OPTIONS if self.functions <= 4 else 2, self.padded)
        return np.array(list(itertools.product(range(options), repeat=self.functions)))

    def buckets(self, x: np.ndarray) -> np.ndarray:
        """Bucket numbers (vector, table, probe) of unit rows; the first probe is the bucket a vector resides in."""
        n = len(x)
        x = np.pad(x, ((0, 0), (0, self.padded - self.dimensions)))
        options = int(self.choices.max(initial=0)) + 1
        probes = min(PROBES, len(self.choices))
        out = np.empty((n, self.tables, probes), np.uint64)
        for t in range(self.tables):
            codes = np.empty((n, self.functions, options), np.uint64)
            missed = np.empty((n, self.functions, options))
            for f in range(self.functions):
                y = x
                for s in self.signs[t, f]:
                    y = hadamard(y * s)
                y = y / self.padded ** 1.5
                axis = np.argsort(-np.abs(y), axis=1, kind="stable")[:, :options]
                near = np.take_along_axis(y, axis, 1)
                codes[:, f] = axis * 2 + (near < 0)
                missed[:, f] = (np.abs(near[:, :1]) - np.abs(near)) ** 2
            loss = sum(missed[:, f][:, self.choices[:, f]] for f in range(self.functions))
            best = np.argsort(loss[:, 1:], axis=1, kind="stable")[:, :probes - 1] + 1
            best = np.concatenate([np.zeros((n, 1), best.dtype), best], axis=1)
            h = np.full((n, probes), np.uint64(t * (1 << 32) + self.dimensions), np.uint64)
            for f in range(self.functions):
                h = mix(h + np.take_along_axis(codes[:, f], self.choices[best, f], 1) * np.uint64(0x9E3779B97F4A7C15))
            out[:, t] = h
        return as_long(out)


def meeting(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest bucket that each pair meets in, from the buckets (pair, table, probe) of both; the largest long if none."""
    none = np.iinfo(np.int64).max
    first = np.where((a[:, :, :1] == b).any(2), a[:, :, 0], none).min(1)
    return np.minimum(first, np.where((b[:, :, :1] == a).any(2), b[:, :, 0], none).min(1))


def planned(count: int, dimensions: int, threshold: float = THRESHOLD) -> Hashing:
    """Codes by the count, tables by simulation: pairs at the threshold meet in some table with probability ``RECALL``."""
    axes = 2 * max(2, 1 << (dimensions - 1).bit_length())
    functions = min(8, max(1, math.ceil(math.log(LOAD * max(count, 1)) / math.log(axes))))
    if dimensions < 2:
        return Hashing(dimensions, functions, 1)
    rng = np.random.default_rng(dimensions)
    a = unit_rows(rng.normal(size=(SIMULATED, dimensions)))
    u = rng.normal(size=(SIMULATED, dimensions))
    u = unit_rows(u - (u * a).sum(1, keepdims=True) * a)
    b = unit_rows(threshold * a + math.sqrt(1 - threshold ** 2) * u)
    trial = Hashing(dimensions, functions, 2)
    x, y = trial.buckets(a), trial.buckets(b)
    met = ((x[:, :, :1] == y).any(2) | (y[:, :, :1] == x).any(2)).mean()
    return Hashing(dimensions, functions, max(1, math.ceil(math.log(1 - RECALL) / math.log(1 - min(float(met), 1 - 1e-9)))))


def _rows(vectors: DataFrame) -> DataFrame:
    """``vec_id``, ``key``, ``x``: the key names the components; both are null where the vector cannot link."""
    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        keys, rows = [], []
        for v in batch.column("x"):
            x = v.values.to_numpy(zero_copy_only=False).astype(np.float64) + 0.0 if v.is_valid and not v.values.null_count else np.zeros(0)
            good = np.isfinite(x).all() and x.any()
            keys.append(hashlib.blake2b(x.tobytes(), digest_size=16).digest() if good else None)
            rows.append(x if good else None)
        yield pa.record_batch([batch.column("vec_id"), pa.array(keys, pa.binary()), pa.array(rows, pa.list_(pa.float64()))], names=["vec_id", "key", "x"])
    return (vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("x"))
            .mapInArrow(batches(run), "vec_id long, key binary, x array<double>"))


def _nodes(rows: DataFrame) -> DataFrame:
    """``node``, ``id``, ``key``, ``x``, ``copies``: each vector once.  A node begins with its smallest vec_id, so the least node of
    a component tells its component_id; ids that are null come last."""
    lowest = F.lit(-(1 << 63)).cast("long")
    digits = F.lpad(F.hex(F.coalesce(F.col("first"), F.lit(0).cast("long")).bitwiseXOR(lowest)), 16, "0")
    named = F.concat(F.when(F.col("first").isNull(), F.lit("01")).otherwise(F.lit("00")), digits, F.hex("key"))
    return (rows.where("key IS NOT NULL").groupBy("key").agg(F.min("vec_id").alias("first"), F.count(F.lit(1)).alias("copies"), F.first("x").alias("x"))
            .select(F.unhex(named).alias("node"), F.monotonically_increasing_id().alias("id"), "key", "x", "copies"))


def _vec_id(node: str):
    value = F.conv(F.hex(F.substring(node, 2, 8)), 16, 10).cast("decimal(20,0)") - F.lit(str(1 << 63)).cast("decimal(20,0)")
    return F.when(F.hex(F.substring(node, 1, 1)) == "00", value.cast("long"))


def _by_length(rows: list[np.ndarray]) -> dict[int, np.ndarray]:
    length = np.array([len(r) for r in rows], np.int64)
    return {int(n): np.flatnonzero(length == n) for n in np.unique(length)}


def _entries(nodes: DataFrame, plans: dict[int, Hashing]) -> DataFrame:
    """``bucket``, ``id``, ``resides`` for all tables and probes."""
    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        ids = batch.column("id").to_numpy()
        rows = [r.values.to_numpy() for r in batch.column("x")]
        for n, mine in _by_length(rows).items():
            for at in np.array_split(mine, -(-len(mine) * n // (1 << 20))):
                b = plans[n].buckets(unit_rows(np.stack([rows[i] for i in at])))
                resides = np.zeros(b.shape, bool)
                resides[:, :, 0] = True
                yield pa.record_batch([pa.array(b.ravel()), pa.array(np.repeat(ids[at], b[0].size)), pa.array(resides.ravel())],
                                      names=["bucket", "id", "resides"])
    return nodes.select("id", "x").mapInArrow(batches(run), "bucket long, id long, resides boolean")


def _placed(entries: DataFrame, block: int) -> DataFrame:
    """Entries of the buckets that can hold a pair, once for each pair of blocks they take part in."""
    shared = (entries.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.max("resides").alias("lived_in"))
              .where((F.col("n") > 1) & F.col("lived_in")).select("bucket", F.ceil(F.col("n") / block).cast("int").alias("blocks")))
    own = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    return (entries.join(shared, "bucket").withColumn("own", own)
            .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
            .select("bucket", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "id", "resides"))


def linked_in_run(x: np.ndarray, own: np.ndarray, resides: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows, each once, of which one resides here and whose cosine reaches the threshold.

    Rows of a single block are paired with each other, rows of two blocks across."""
    def meet(a: np.ndarray, b: np.ndarray, once: bool) -> tuple[np.ndarray, np.ndarray]:
        hit = x[a] @ x[b].T >= threshold
        i, j = np.nonzero(np.triu(hit, 1) if once else hit)
        return a[i], b[j]
    low = own == own.min()
    home, guest = np.flatnonzero(low & resides), np.flatnonzero(low & ~resides)
    if low.all():
        parts = [meet(home, home, True), meet(home, guest, False)]
    else:
        parts = [meet(home, np.flatnonzero(~low), False), meet(guest, np.flatnonzero(~low & resides), False)]
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


def _verified(placed: pa.Table, plans: dict[int, Hashing], threshold: float) -> pa.RecordBatch | None:
    """``node``, ``root``, ``links`` from whole runs of a bucket and pair of blocks."""
    bucket, low, high, own = (placed.column(c).to_numpy() for c in ("bucket", "low", "high", "own"))
    resides = placed.column("resides").to_numpy()
    ids, copies = placed.column("id").to_numpy(), placed.column("copies").to_numpy()
    rows = [r.values.to_numpy() for r in placed.column("x").combine_chunks()]
    unit: dict[int, np.ndarray] = {}
    place = np.empty(len(rows), np.int64)
    length = np.array([len(r) for r in rows], np.int64)
    for n, mine in _by_length(rows).items():
        unit[n] = unit_rows(np.stack([rows[i] for i in mine]))
        place[mine] = np.arange(len(mine))
    change = (np.diff(bucket) != 0) | (np.diff(low) != 0) | (np.diff(high) != 0)
    cuts = [0, *(np.flatnonzero(change) + 1).tolist(), len(rows)]
    left, right = [], []
    for a, e in zip(cuts[:-1], cuts[1:]):
        if e - a < 2 or (low[a] != high[a] and (own[a:e] == own[a]).all()):
            continue
        for n in np.unique(length[a:e]):  # lengths share a bucket only where two bucket numbers agree by chance
            run = a + np.flatnonzero(length[a:e] == n)
            if low[a] != high[a] and (own[run] == own[run[0]]).all():
                continue
            i, j = linked_in_run(unit[int(n)][place[run]], own[run], resides[run], threshold)
            if len(i):
                left.append(run[i])
                right.append(run[j])
    if not left:
        return None
    left, right = np.concatenate(left), np.concatenate(right)
    node, at = np.unique(ids, return_inverse=True)
    row_of = np.empty(len(node), np.int64)
    row_of[at] = np.arange(len(rows))
    links = np.zeros(len(node), np.int64)
    for n in np.unique(length[left]):
        mine = np.flatnonzero(length[left] == n)
        used, where = np.unique(at[np.concatenate([left[mine], right[mine]])], return_inverse=True)
        found = plans[int(n)].buckets(unit[int(n)][place[row_of[used]]])
        for s in range(0, len(mine), HITS):
            part = mine[s:s + HITS]
            l, r = where[s:s + len(part)], where[len(mine) + s:len(mine) + s + len(part)]
            here = meeting(found[l], found[r]) == bucket[left[part]]
            l, r = left[part][here], right[part][here]
            np.add.at(links, at[l], copies[r])
            np.add.at(links, at[r], copies[l])
    names = placed.column("node").take(pa.array(row_of)).combine_chunks()
    order = np.empty(len(node), np.int64)   # nodes numbered as they compare
    order[np.argsort(np.array(names.to_pylist(), object), kind="stable")] = np.arange(len(node))
    by_order = np.argsort(order)
    a, b = order[at[left]], order[at[right]]
    root = np.arange(len(node))
    while True:
        before = root.copy()
        np.minimum.at(root, a, root[b])
        np.minimum.at(root, b, root[a])
        root = root[root]
        if (root == before).all():
            break
    touched = np.unique(np.concatenate([a, b]))
    return pa.record_batch([names.take(pa.array(by_order[touched])), names.take(pa.array(by_order[root[touched]])),
                            pa.array(links[by_order[touched]])], names=["node", "root", "links"])


def _runs(plans: dict[int, Hashing], threshold: float):
    """Cuts a sorted partition into buffers of whole runs."""
    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in found:
            held.append(batch)
            if sum(b.num_rows for b in held) < BUFFER:
                continue
            whole = pa.Table.from_batches(held)
            key = [whole.column(c).to_numpy() for c in ("bucket", "low", "high")]
            same = np.all([k == k[-1] for k in key], axis=0)
            first = whole.num_rows - (int(np.argmin(same[::-1])) if not same.all() else whole.num_rows)
            if first:
                out = _verified(whole.slice(0, first), plans, threshold)
                if out is not None:
                    yield out
            held = whole.slice(first).to_batches()
        if held:
            out = _verified(pa.Table.from_batches(held), plans, threshold)
            if out is not None:
                yield out
    return run


def near_duplicate_vectors(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``vec_id``, ``n_links``, ``component_id``, ``kept`` of every row.

    Vectors that are null, zero, empty or hold null or non-finite components link with nothing, and so do vectors of
    different lengths.  Rows are vectors for themselves also where ids repeat; equal vectors link with each other.  A
    component without any id has a null component_id; its rows are kept, as are all rows whose id is the component's.
    Columns other than vec_id and embedding are ignored.  Labels play no part."""
    rows = written(_rows(vectors))
    nodes = written(_nodes(rows))
    total = rows.count()
    sizes = nodes.groupBy(F.size("x").alias("n")).count().collect()   # one row for each length of vector
    plans = {r["n"]: planned(r["count"], r["n"], threshold) for r in sizes}
    entries = written(_entries(nodes, plans))
    placed = (_placed(entries, BLOCK).join(nodes.select("id", "node", "x", "copies"), "id")
              .repartition("bucket", "low", "high").sortWithinPartitions("bucket", "low", "high"))
    found = written(placed.mapInArrow(_runs(plans, threshold), "node binary, root binary, links long"))
    drop_written(entries)
    roots = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    result = written(nodes.select("node", "key", "copies").join(links, "node", "left").join(roots, "node", "left")
                     .select("key", "copies", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
                             F.coalesce("root", "node").alias("root"))
                     .select("key", "copies", "n_links", _vec_id("root").alias("component_id")))
    # Fewer than HEAVY vectors can have more than one in HEAVY of all rows each; theirs need no shuffle by key.
    heavy = F.col("copies") * HEAVY > total
    often = F.broadcast(result.where(heavy).drop("copies"))
    linked = rows.where("key IS NOT NULL").select("vec_id", "key")
    rest = linked.join(F.broadcast(result.where(heavy).select("key")), "key", "left_anti").join(result.where(~heavy).drop("copies"), "key")
    alone = rows.where("key IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    columns = ["vec_id", "n_links", "component_id"]
    whole = linked.join(often, "key").select(*columns).unionByName(rest.select(*columns)).unionByName(alone)
    return whole.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op13_cross_polytope(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicate_vectors(table(spark, folder, "embeddings"))


#: All pairs, which the small tables allow; cosines as the operator forms them, apart from rounding.
ORACLE = f"""
WITH RECURSIVE v AS MATERIALIZED (
  SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS x,
    embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0 AS good FROM embeddings),
link AS MATERIALIZED (
  SELECT a.row AS a, b.row AS b FROM v a JOIN v b ON a.row <> b.row AND a.good AND b.good AND len(a.x) = len(b.x)
  WHERE list_cosine_similarity(a.x, b.x) >= {THRESHOLD}),
reach AS (
  SELECT row, vec_id AS to_id, row AS via FROM v UNION
  SELECT reach.row, v.vec_id, link.b FROM reach JOIN link ON link.a = reach.via JOIN v ON v.row = link.b)
SELECT v.vec_id, CAST((SELECT count(*) FROM link WHERE link.a = v.row) AS BIGINT) AS n_links, c.component_id,
  v.vec_id IS NOT DISTINCT FROM c.component_id AS kept
FROM v JOIN (SELECT row, min(to_id) AS component_id FROM reach GROUP BY row) c USING (row)"""
