"""Block bootstrap over whole units with reproducible draws."""
from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ..session import materialize
from .numbering import number_within, running_sums
from .quantiles import grouped_quantiles
from .small import join_small


_PRIME = 2147483647  # 2**31 - 1
_CHUNK = 1 << 16        # draws made at a time
BLOCK_RANKS = 1 << 17   # units weighed together
SPAN_RANKS = 1 << 26    # ranks counted by one call
TASK_DRAWS = 1 << 24    # draws of one task, about


def draw(seed: int, replicate: Column | str, position: Column | str, size: Column | str) -> Column:
    """Reproducible draw of 0 .. size - 1: two quadratic steps modulo a prime, in integers that any engine repeats."""
    r, d, n = (F.col(x) if isinstance(x, str) else x for x in (replicate, position, size))
    x = (r.cast("long") * 1000003 + d.cast("long") * 7919 + F.lit(seed * 104729 + 12345).cast("long")) % _PRIME
    x = (x * x + x * 48271 + 1) % _PRIME
    return ((x * x + x * 69621 + 3) % _PRIME) % n


def draw_sql(seed: int, table: str) -> str:
    """The rows of ``table(replicate, d, u)`` with their draw as ``pick``, in SQL."""
    first = f"SELECT *, (replicate::BIGINT*1000003 + d::BIGINT*7919 + {seed * 104729 + 12345}) % {_PRIME} AS x1 FROM {table}"
    second = f"SELECT *, (x1*x1 + x1*48271 + 1) % {_PRIME} AS x2 FROM ({first})"
    return f"SELECT *, ((x2*x2 + x2*69621 + 3) % {_PRIME}) % u AS pick FROM ({second})"


def unit_sums(df: DataFrame, keys: Sequence[str], unit: str, sums: dict[str, Column]) -> DataFrame:
    return df.groupBy(*keys, unit).agg(*[F.sum(c).alias(n) for n, c in sums.items()])


def _picks(seed: int, replicate: int, start: int, stop: int, size: int) -> np.ndarray:
    """``draw`` for positions start .. stop - 1; remainders modulo 2**31 - 1 by shifts."""
    x = np.arange(start, stop, dtype=np.int64)
    x *= 7919
    x += replicate * 1000003 + seed * 104729 + 12345
    x %= _PRIME
    for slope, shift in ((48271, 1), (69621, 3)):
        x *= x + slope
        x += shift
        for _ in range(2):
            x = (x & _PRIME) + (x >> 31)
    x[x >= _PRIME] -= _PRIME
    x -= (x // size) * size
    return x


def _pack(counts: np.ndarray) -> bytes:
    kind = np.uint8 if counts.max(initial=0) < 256 else np.int32
    return np.dtype(kind).char.encode() + pa.compress(counts.astype(kind).tobytes(), "zstd", asbytes=True)


def _unpack(packed: bytes, n: int) -> np.ndarray:
    kind = np.dtype(packed[:1].decode())
    return np.frombuffer(pa.decompress(packed[1:], n * kind.itemsize, "zstd"), kind)


def _counter(seed: int, keys: Sequence[str], block: int, names: Sequence[str]):
    """Arrow batches of (keys, units, replicate, first rank) to counts of draws by block of ranks."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, held = [], 0
            todo = zip(*(batch.column(x).to_pylist() for x in ("_u", "replicate", "_from")))
            for i, (size, replicate, low) in enumerate(todo):
                counts = np.zeros(min(SPAN_RANKS, size - low), np.int32)
                for start in range(0, size, _CHUNK):
                    pick = _picks(seed, replicate, start, min(start + _CHUNK, size), size)
                    if size > SPAN_RANKS:
                        pick = pick[(pick >= low) & (pick < low + len(counts))] - low
                    np.add.at(counts, pick, np.int32(1))
                for at in range(0, len(counts), block):
                    part = counts[at:at + block]
                    rows.append((i, replicate, (low + at) // block, len(part), _pack(part)))
                    held += len(rows[-1][-1])
                if held > 1 << 24:
                    yield _batch(batch, rows, keys, names)
                    rows, held = [], 0
            if rows:
                yield _batch(batch, rows, keys, names)
    return run


def _batch(batch: pa.RecordBatch, rows: list[tuple], keys: Sequence[str], names: Sequence[str]) -> pa.RecordBatch:
    source, replicate, block, n, packed = zip(*rows)
    kept = [batch.column(k).take(pa.array(source)) for k in keys]
    return pa.RecordBatch.from_arrays(
        [*kept, pa.array(replicate, pa.int32()), pa.array(block, pa.int64()), pa.array(n, pa.int32()), pa.array(packed, pa.binary())], list(names))


def _schema(df: DataFrame, keys: Sequence[str], more: str) -> str:
    return ", ".join([*(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys), more])


def ranked_units(units: DataFrame, keys: Sequence[str], unit: str, max_rows: int | None = None) -> DataFrame:
    """Units with their block of ranks and place in it; a unit without key columns is left out."""
    slim = materialize(units.dropna(subset=list(keys)))
    ranked = number_within(slim, keys, [unit], "_rank", max_rows=max_rows)
    return materialize(ranked.withColumn("_block", F.floor(F.col("_rank") / BLOCK_RANKS)).withColumn("_at", (F.col("_rank") % BLOCK_RANKS).cast("int")))


def draw_counts(ranked: DataFrame, keys: Sequence[str], replicates: int, seed: int) -> DataFrame:
    """How often each unit is drawn, one row of counts per (replicate, block of ranks).

    Draw d of replicate r picks the unit of rank ``draw(seed, r, d)``.  The draws of a replicate are made and counted in one
    task, four bytes for each of at most ``SPAN_RANKS`` ranks; only the packed counts leave it."""
    size = materialize(ranked.groupBy(*keys).agg(F.count(F.lit(1)).alias("_u")))
    every = size.select(*keys, "_u", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("replicate"))
    every = every.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_u") - 1, F.lit(SPAN_RANKS).cast("long"))).alias("_from"))
    total, groups = size.agg(F.sum("_u"), F.count("_u")).first()
    tasks = min((total or 0) * replicates // TASK_DRAWS + 1, max(groups, 1) * replicates)
    names = [*keys, "replicate", "_block", "_n", "_w"]
    return every.repartition(tasks).mapInArrow(_counter(seed, list(keys), BLOCK_RANKS, names), _schema(ranked, keys, "replicate int, _block long, _n int, _w binary"))


def _weights(counts: pa.Table) -> Iterator[tuple[int, np.ndarray]]:
    for replicate, n, packed in zip(*(counts.column(x).to_pylist() for x in ("replicate", "_n", "_w"))):
        yield replicate, _unpack(packed, n)


def _repeat_keys(table: pa.Table, keys: Sequence[str], n: int) -> list:
    return [table.column(k).combine_chunks().take(pa.array(np.zeros(n, np.int64))) for k in keys]


def _weighed(keys: Sequence[str], sums: Sequence[str], names: Sequence[str], schema: pa.Schema):
    def run(counts: pa.Table, units: pa.Table) -> pa.Table:
        if not counts.num_rows or not units.num_rows:
            return schema.empty_table()
        order = np.argsort(units.column("_at").to_numpy())
        columns = []
        for s in sums:
            held = units.column(s)
            there = held.is_valid().to_numpy()[order] if held.null_count else None
            value = held.fill_null(0).to_numpy()[order]
            columns.append((value.astype(np.int64 if value.dtype.kind in "iub" else np.float64), there))
        replicates, found = [], [[] for _ in sums]
        for replicate, w in _weights(counts):
            replicates.append(replicate)
            for into, (value, there) in zip(found, columns):
                if there is not None and not w[there].any():
                    into.append(None)
                elif value.dtype == np.int64:
                    into.append(int(w.astype(np.int64) @ value))
                else:
                    drawn = w > 0
                    into.append(float(w[drawn].astype(np.float64) @ value[drawn]))
        held = [pa.array(x, schema.field(s).type) for x, s in zip(found, sums)]
        return pa.Table.from_arrays([*_repeat_keys(counts, keys, len(replicates)), pa.array(replicates, pa.int32()), *held], list(names))
    return run


def weighed_sums(counts: DataFrame, ranked: DataFrame, keys: Sequence[str], sums: Sequence[str]) -> DataFrame:
    """Sums over the drawn units per replicate: blocks of counts meet the block's units, partial sums are added up."""
    whole = {"tinyint", "smallint", "int", "bigint", "boolean"}
    kinds = {s: "bigint" if ranked.schema[s].dataType.simpleString() in whole else "double" for s in sums}
    units = ranked.select(*keys, "_block", "_at", *[F.col(s).cast(kinds[s]).alias(s) for s in sums])
    names = [*keys, "replicate", *sums]
    layout = _schema(ranked, keys, ", ".join(["replicate int", *(f"`{s}` {kinds[s]}" for s in sums)]))
    arrow = to_arrow_schema(units.sparkSession.createDataFrame([], layout).schema)
    by = [*keys, "_block"]
    parts = counts.groupBy(*by).cogroup(units.groupBy(*by)).applyInArrow(_weighed(list(keys), list(sums), names, arrow), layout)
    return parts.groupBy(*keys, "replicate").agg(*[F.sum(s).alias(s) for s in sums])


def resampled_sums(units: DataFrame, keys: Sequence[str], unit: str, sums: Sequence[str], replicates: int, seed: int,
                   max_rows: int | None = None) -> DataFrame:
    """Sums over as many units as the group has, drawn with replacement, for
    each replicate."""
    ranked = ranked_units(units.select(*keys, unit, *sums), keys, unit, max_rows)
    return weighed_sums(draw_counts(ranked, keys, replicates, seed), ranked, keys, sums)


def _values(keys: Sequence[str], value: str, names: Sequence[str], schema: pa.Schema):
    def run(counts: pa.Table, rows: pa.Table) -> pa.Table:
        if not counts.num_rows or not rows.num_rows:
            return schema.empty_table()
        at, c = rows.column("_at").to_numpy(), rows.column("c").to_numpy()
        distinct, slot = np.unique(rows.column(value).to_numpy(), return_inverse=True)
        parts = []
        for replicate, w in _weights(counts):
            # sums of counts, exact in doubles
            sums = np.bincount(slot, w[at] * c.astype(np.float64), len(distinct)).astype(np.int64)
            drawn = np.flatnonzero(sums)
            parts.append((np.full(len(drawn), replicate, np.int32), distinct[drawn], sums[drawn]))
        replicate, found, sums = (np.concatenate(x) for x in zip(*parts))
        return pa.Table.from_arrays([*_repeat_keys(counts, keys, len(sums)), *map(pa.array, (replicate, found, sums))], list(names))
    return run


def weighed_values(counts: DataFrame, rows: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Weight ``w`` of each distinct value per replicate; ``rows``: place of the unit, value and its count ``c`` there."""
    names, by = [*keys, "replicate", value, "w"], [*keys, "_block"]
    layout = _schema(rows, keys, f"replicate int, `{value}` double, w long")
    arrow = to_arrow_schema(rows.sparkSession.createDataFrame([], layout).schema)
    rows = rows.withColumn(value, F.col(value).cast("double"))
    parts = counts.groupBy(*by).cogroup(rows.groupBy(*by)).applyInArrow(_values(list(keys), value, names, arrow), layout)
    return parts.groupBy(*keys, "replicate", value).agg(F.sum("w").alias("w"))


def ratio_band(units: DataFrame, keys: Sequence[str], unit: str, num: str, den: str, replicates: int = 300, seed: int = 31,
               probabilities: tuple[float, float] = (0.16, 0.84), max_rows: int | None = None) -> DataFrame:
    """Interval and standard error of a ratio of sums over resampled units."""
    reps = resampled_sums(units, keys, unit, [num, den], replicates, seed, max_rows)
    r = reps.withColumn("_r", F.col(num) / F.greatest(F.col(den), F.lit(1.0)))
    lo, hi = probabilities
    return grouped_quantiles(r, keys, {"low": ("_r", lo), "high": ("_r", hi)},
                             [F.stddev_samp("_r").alias("error"), F.count(F.lit(1)).alias("replicates")], max_rows=replicates)


def weighted_high_quantile(df: DataFrame, keys: Sequence[str], unit: str, value: str, q: float = 0.999,
                           replicates: int = 300, seed: int = 5,
                           max_rows: int | None = None) -> DataFrame:
    """Interval of a high quantile under unit resampling.

    Each replicate weighs a frame by how often its unit was drawn.  A pass takes the values from a cut upwards, with the
    weight below it from the drawn unit sizes; a replicate whose quantile lies below the cut is left for the next pass,
    which takes a tail four times as large, until every replicate has its answer."""
    data = materialize(df.where(F.col(value).isNotNull()).select(*keys, unit, value))
    ranked = ranked_units(data.groupBy(*keys, unit).agg(F.count(F.lit(1)).alias("n")), keys, unit, max_rows)
    times = materialize(draw_counts(ranked, keys, replicates, seed))
    waiting = materialize(weighed_sums(times, ranked, keys, ["n"]).withColumnRenamed("n", "total"))
    answers, tail = None, 4.0
    while not waiting.isEmpty():
        whole = tail * (1 - q) >= 1
        if whole:
            top = data
        else:
            cut = grouped_quantiles(data, keys, {"_cut": (value, 1 - tail * (1 - q))}, max_rows=max_rows)
            top = join_small(data, cut, keys).where(F.col(value) >= F.col("_cut"))
        counted = top.groupBy(*keys, unit, value).agg(F.count(F.lit(1)).alias("c"))
        placed = counted.join(ranked.select(*keys, unit, "_block", "_at"), [*keys, unit]).select(*keys, "_block", "_at", value, "c")
        asked = join_small(times, waiting.select(*keys, "replicate"), [*keys, "replicate"], how="left_semi")
        weighted = materialize(weighed_values(asked, placed, keys, value))
        held = weighted.groupBy(*keys, "replicate").agg(F.sum("w").alias("held"))
        state = waiting.join(held, [*keys, "replicate"], "left").withColumn(
            "inside", F.lit(True) if whole else F.col("total") - F.coalesce("held", F.lit(0)) < F.lit(q) * F.col("total"))
        ready = materialize(state.where("inside").select(*keys, "replicate", "total"))
        r = running_sums(weighted, [*keys, "replicate"], value, ["w"], descending=True, max_rows=max_rows).join(ready, [*keys, "replicate"])
        # smallest value whose weight from below reaches q of the total
        ok = r.where(F.col("total") - F.col("cum_w") + F.col("w") >= F.lit(q) * F.col("total"))
        found = materialize(ok.groupBy(*keys, "replicate").agg(F.min(value).alias("_r")))
        answers = found if answers is None else answers.unionByName(found)
        waiting = materialize(waiting.join(ready.select(*keys, "replicate"), [*keys, "replicate"], "left_anti"))
        tail *= 4
    if answers is None:
        answers = waiting.select(*keys, "replicate", F.lit(None).cast("double").alias("_r"))
    return grouped_quantiles(answers, keys, {"low": ("_r", 0.16), "high": ("_r", 0.84)}, [F.count(F.lit(1)).alias("replicates")],
                             max_rows=replicates)
