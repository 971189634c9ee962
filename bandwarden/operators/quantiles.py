"""Exact linear-interpolated quantiles for groups of any size.

``percentile`` keeps a value map per group, which is fine for bounded groups
only.  A hot group is answered by narrowing: equal values become one row with
their count, then rows are counted in equal bins of the current interval and
the bin that holds the wanted rank is kept, until at most ``gather`` distinct
values are left.  Each round is one scan with map-side counts.
"""
from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import constants as C
from ..session import materialize
from .numbering import hot_groups

Spec = tuple[Column | str, float]


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _eq(a: str, b: str, keys: Sequence[str]) -> list[Column]:
    return [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in keys]


def grouped_quantiles(df: DataFrame, keys: Sequence[str], specs: Mapping[str, Spec],
                      aggs: Sequence[Column] = (), max_rows: int | None = None,
                      limit: int = C.HOT_GROUP_ROWS, bins: int = 1024,
                      gather: int = 100_000, accuracy: int | None = None) -> DataFrame:
    """One row per group with plain aggregates ``aggs`` and the quantiles of
    ``specs`` (name -> (value, probability)); NULL values are left out.

    ``max_rows`` bounds the input, or at least any one group; within ``limit``
    the check for hot groups is not needed.  ``accuracy`` asks for the approximate sketch instead.
    """
    if accuracy is not None:
        rough = [F.percentile_approx(_col(v), float(q), accuracy).cast("double").alias(n) for n, (v, q) in specs.items()]
        return df.groupBy(*keys).agg(*aggs, *rough)
    plain = lambda d: _plain(d, keys, specs, aggs)
    if max_rows is not None and max_rows <= limit:
        return plain(df)
    if keys:
        hot = hot_groups(df, keys, limit).select(*keys)
        if hot.isEmpty():
            return plain(df)
        cold = df.alias("d").join(hot.alias("h"), _eq("d", "h", keys), "left_anti")
        big = df.alias("d").join(hot.alias("h"), _eq("d", "h", keys), "left_semi")
    else:
        if df.count() <= limit:
            return plain(df)
        cold, big = None, df
    answer = _narrow(big, list(keys), specs, bins, gather)
    # Every group has a row, also one whose values are all NULL.
    base = big.groupBy(*keys).agg(*(aggs or [F.count(F.lit(1)).alias("_n")]))
    names = [c for c in base.columns if c != "_n" or aggs]
    on = _eq("b", "a", keys) if keys else F.lit(True)
    answer = base.alias("b").join(answer.alias("a") if keys else F.broadcast(answer).alias("a"), on, "left").select(
        *[F.col(f"b.{c}") for c in names], *[F.col(f"a.{n}") for n in specs])
    return answer if cold is None else plain(cold).unionByName(answer)


def _plain(df: DataFrame, keys: Sequence[str], specs: Mapping[str, Spec], aggs: Sequence[Column]) -> DataFrame:
    """Built-in percentiles, one value map per distinct value column."""
    wanted: dict[str, tuple[Column, list[float]]] = {}
    place: dict[str, tuple[str, int]] = {}
    for name, (value, q) in specs.items():
        column, probs = wanted.setdefault(value if isinstance(value, str) else repr(value), (_col(value), []))
        probs.append(float(q))
        place[name] = (column, len(probs) - 1)
    slot = {id(column): f"_p{i}" for i, (column, _) in enumerate(wanted.values())}
    maps = [F.percentile(column, F.array(*[F.lit(q) for q in probs])).alias(slot[id(column)]) for column, probs in wanted.values()]
    g = df.groupBy(*keys).agg(*aggs, *maps)
    keep = [c for c in g.columns if c not in slot.values()]
    return g.select(*keep, *[F.get(slot[id(column)], F.lit(i)).alias(n) for n, (column, i) in place.items()])


def _narrow(df: DataFrame, keys: list[str], specs: Mapping[str, Spec], bins: int, gather: int) -> DataFrame:
    """Quantiles of the groups that have a value.

    Infinities and NaN, which is the largest, are only counted; the search runs over the finite values between them."""
    gid = F.struct(*keys) if keys else F.struct(F.lit(0).alias("_g"))
    columns: dict[str, Column] = {}
    place = {name: list(columns).index(key) for name, (v, _) in specs.items()
             for key in [v if isinstance(v, str) else repr(v)] if columns.setdefault(key, _col(v)) is not None}
    values = F.array(*[c.cast("double") for c in columns.values()])
    melted = materialize(
        df.select(gid.alias("g"), F.posexplode(values)).where(F.col("col").isNotNull())
        .groupBy("g", F.col("pos").alias("m"), F.col("col").alias("v")).agg(F.count(F.lit(1)).alias("n")))
    v = F.col("v")
    low, high = v == float("-inf"), v == float("inf")
    finite = ~low & ~high & ~F.isnan(v)
    rows = lambda which: F.sum(F.when(which, F.col("n")).otherwise(0))
    stats = melted.groupBy("g", "m").agg(
        F.sum("n").alias("n"), rows(low).alias("below"), rows(finite).alias("c"), rows(high).alias("above"), F.count_if(finite).alias("k"),
        F.min(F.when(finite, v)).alias("lo"), F.max(F.when(finite, v)).alias("hi"))
    wanted = F.array(*[F.struct(F.lit(i).alias("spec"), F.lit(place[name]).alias("m"), F.lit(float(q)).alias("q"))
                       for i, (name, (_, q)) in enumerate(specs.items())])
    asked = stats.withColumn("w", F.explode(F.filter(wanted, lambda w: w["m"] == F.col("m"))))
    at = F.col("w.q") * (F.col("n") - 1)
    ends = F.array_distinct(F.array(F.floor(at), F.ceil(at)))
    ranks = asked.select("g", "m", F.col("w.spec").alias("spec"), at.alias("at"), F.explode(ends).alias("rank"), "below", "c", "above", "k", "lo", "hi")
    ranks = materialize(ranks)
    r = F.col("rank") - F.col("below")
    outside = F.when(r < 0, F.lit(float("-inf"))).when(r >= F.col("c") + F.col("above"), F.lit(float("nan"))).when(r >= F.col("c"), F.lit(float("inf")))
    known = ranks.select("g", "spec", "at", "rank", outside.alias("x"))
    todo = materialize(ranks.where(outside.isNull()).select(
        "g", "m", "lo", "hi", F.lit(0).cast("long").alias("base"), "k", r.alias("rank")).distinct())
    done = None
    while True:
        open_ = todo.where((F.col("lo") < F.col("hi")) & (F.col("k") > gather))
        closed = todo.where((F.col("lo") == F.col("hi")) | (F.col("k") <= gather))
        done = closed if done is None else done.unionByName(closed)
        if open_.isEmpty():
            break
        todo = materialize(_round(melted, open_, bins))
    picked = _gather(melted, done)
    inside = (ranks.where(outside.isNull()).select("g", "m", "spec", "at", "rank", r.alias("_r")).alias("k")
              .join(picked.alias("p"), (F.col("k.g") == F.col("p.g")) & (F.col("k.m") == F.col("p.m")) & (F.col("k._r") == F.col("p.rank")))
              .select("k.g", "k.spec", "k.at", "k.rank", "p.x"))
    pair = known.where("x IS NOT NULL").unionByName(inside).groupBy("g", "spec").agg(
        F.first("at").alias("at"), F.min_by("x", "rank").alias("a"), F.max_by("x", "rank").alias("b"))
    # The built-in's own weighting, so that both ways give the same bits.
    value = F.when(F.ceil("at") == F.floor("at"), F.col("a")).otherwise(
        (F.ceil("at") - F.col("at")) * F.col("a") + (F.col("at") - F.floor("at")) * F.col("b"))
    wide = pair.groupBy("g").agg(*[F.max(F.when(F.col("spec") == i, value)).alias(n) for i, n in enumerate(specs)])
    return wide.select(*[F.col("g")[k].alias(k) for k in keys], *specs)


def _round(melted: DataFrame, todo: DataFrame, bins: int) -> DataFrame:
    """Each open interval cut to the bin that holds its rank.

    Where an interval is too narrow for equal bins its smallest value alone is one bin, so every round makes it smaller."""
    lo, hi, v = F.col("t.lo"), F.col("t.hi"), F.col("d.v")
    width = hi / F.lit(float(bins)) - lo / F.lit(float(bins))
    b = F.when(lo + width > lo, F.least(F.floor((v / width) - (lo / width)), F.lit(bins - 1))).otherwise((v > lo).cast("long"))
    hits = (
        melted.alias("d").join(todo.alias("t"), (F.col("d.g") == F.col("t.g")) & (F.col("d.m") == F.col("t.m")) & v.between(lo, hi))
        .groupBy("t.g", "t.m", "t.rank", "t.base", b.alias("b"))
        .agg(F.sum("d.n").alias("c"), F.count(F.lit(1)).alias("k"), F.min("d.v").alias("lo"), F.max("d.v").alias("hi"))
    )
    w = W.partitionBy("g", "m", "rank").orderBy("b")
    upto = hits.withColumn("_end", F.col("base") + F.sum("c").over(w))
    start = F.col("_end") - F.col("c")
    return upto.where((start <= F.col("rank")) & (F.col("rank") < F.col("_end"))).select(
        "g", "m", "lo", "hi", start.cast("long").alias("base"), "k", "rank")


def _gather(melted: DataFrame, done: DataFrame) -> DataFrame:
    """Value at the wanted rank; at most ``gather`` distinct values per target."""
    known = done.where(F.col("lo") == F.col("hi")).select("g", "m", "rank", F.col("lo").alias("x"))
    small = done.where(F.col("lo") < F.col("hi"))
    upto = F.col("base") + F.sum("n").over(W.partitionBy("g", "m", "rank").orderBy("v"))
    values = (
        melted.alias("d").join(small.alias("t"), (F.col("d.g") == F.col("t.g")) & (F.col("d.m") == F.col("t.m"))
                               & F.col("d.v").between(F.col("t.lo"), F.col("t.hi")))
        .select("t.g", "t.m", "t.rank", "t.base", "d.v", "d.n").withColumn("_upto", upto)
        .where((F.col("_upto") > F.col("rank")) & (F.col("_upto") - F.col("n") <= F.col("rank")))
        .select("g", "m", "rank", F.col("v").alias("x"))
    )
    return known.unionByName(values)


def masked_quantile(value: Column | str, keep: Column, q: float) -> Spec:
    """Quantile spec over rows that pass ``keep``."""
    return (F.when(keep, _col(value)), q)
