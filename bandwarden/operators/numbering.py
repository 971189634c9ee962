"""Row numbers inside groups without ever sorting a hot group in one task."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import constants as C
from ..session import materialize


def _name(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


HASH_CELLS = 1 << 16


def hot_groups(df: DataFrame, keys: Sequence[str], limit: int = C.HOT_GROUP_ROWS) -> DataFrame:
    """Keys with more than ``limit`` rows; at most rows/limit of them.

    Rows are first counted by hash of the key, which ships few rows however many groups there are.  A group is no larger
    than its cell, so only the groups of cells beyond the limit are counted one by one."""
    cell = F.pmod(F.xxhash64(*keys), F.lit(HASH_CELLS))
    counts = lambda d: d.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > limit)
    full = [r["_c"] for r in df.groupBy(cell.alias("_c")).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > limit).select("_c").collect()]
    return materialize(counts(df.where(cell.isin(full)))) if full else counts(df.limit(0))


def number_within(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], name: str,
                  max_rows: int | None = None, limit: int = C.HOT_GROUP_ROWS, spread: tuple[int, str] | None = None) -> DataFrame:
    """Zero-based position of each row inside its group.

    Groups up to ``limit`` rows use a window.  Larger ones are range-sorted
    over all tasks, numbered inside each sorted run, and shifted by the sizes
    of the runs before it.  ``max_rows`` is a known bound of the whole input;
    when it is within ``limit`` no group can be hot and the check is skipped.
    ``spread`` names the tasks and the key, one of ``keys``, of the exchange
    before the window.
    """
    order = [_name(o) for o in order]
    w = W.partitionBy(*keys).orderBy(*order)
    window = lambda d: (d.repartition(spread[0], spread[1]) if spread else d).withColumn(name, (F.row_number().over(w) - 1).cast("long"))
    if max_rows is not None and max_rows <= limit:
        return window(df)
    hot = hot_groups(df, keys, limit).select(*keys)
    if hot.isEmpty():
        return window(df)
    same = lambda a, b: [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in keys]
    cold = df.alias("d").join(hot.alias("h"), same("d", "h"), "left_anti")
    big = df.alias("d").join(hot.alias("h"), same("d", "h"), "left_semi")
    return window(cold).unionByName(_number_sorted_runs(big, keys, order, name))


def _number_sorted_runs(df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str) -> DataFrame:
    cols = [F.col(k) for k in keys]
    sorted_runs = materialize(
        df.repartitionByRange(*cols, *order).sortWithinPartitions(*cols, *order)
        .withColumn("_run", F.spark_partition_id())
        .withColumn("_pos", F.monotonically_increasing_id())
    )
    runs = sorted_runs.groupBy(*keys, "_run").agg(
        F.count(F.lit(1)).alias("_n"), F.min("_pos").alias("_first"))
    before = W.partitionBy(*keys).orderBy("_run").rowsBetween(W.unboundedPreceding, -1)
    runs = runs.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    on = [F.col(f"s.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys] + [F.col("s._run") == F.col("r._run")]
    return (
        sorted_runs.alias("s").join(runs.alias("r"), on)
        .select(*[F.col(f"s.{c}") for c in df.columns],
                (F.col("s._pos") - F.col("r._first") + F.col("r._before")).cast("long").alias(name))
    )


def global_number(df: DataFrame, order: Sequence[str], name: str, first: int = 0) -> DataFrame:
    """Contiguous numbers over the whole table in ``order``, computed over all
    tasks: sorted runs are counted and each is shifted by those before it."""
    order = [_name(o) for o in order]
    numbered = _number_sorted_runs(df.withColumn("_all", F.lit(0)), ["_all"], order, name)
    return numbered.drop("_all").withColumn(name, F.col(name) + first)


def total_before(df: DataFrame, order: Sequence[str], value: str, name: str) -> DataFrame:
    """Sum of ``value`` over all rows before each row in ``order``, computed over all tasks."""
    runs = materialize(df.repartitionByRange(*[F.col(o) for o in order]).withColumn("_run", F.spark_partition_id()))
    shift = runs.groupBy("_run").agg(F.sum(value).alias("_s")).withColumn(
        "_s", F.coalesce(F.sum("_s").over(W.orderBy("_run").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    inside = W.partitionBy("_run").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    local = runs.withColumn("_l", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return local.join(shift, "_run").select(*df.columns, (F.col("_l") + F.col("_s")).alias(name))


def running_sums(df: DataFrame, keys: Sequence[str], order: str, sums: Sequence[str], descending: bool = False,
                 max_rows: int | None = None, limit: int = C.HOT_GROUP_ROWS) -> DataFrame:
    """Inclusive running sums ``cum_<name>`` and totals ``all_<name>`` over
    distinct ``order`` values of each group.

    With a hot group the table is range-sorted over all tasks, summed inside
    each sorted run, and shifted by the sums of the runs before it."""
    by = F.col(order).desc() if descending else F.col(order).asc()
    totals = [F.sum(s).over(W.partitionBy(*keys)).alias(f"all_{s}") for s in sums]
    small = max_rows is not None and max_rows <= limit
    if small or hot_groups(df, keys, limit).isEmpty():
        w = W.partitionBy(*keys).orderBy(by)
        return df.select("*", *[F.sum(s).over(w).alias(f"cum_{s}") for s in sums], *totals)
    runs_of = materialize(df.repartitionByRange(*[F.col(k) for k in keys], by).withColumn("_run", F.spark_partition_id()))
    per = runs_of.groupBy(*keys, "_run").agg(*[F.sum(s).alias(s) for s in sums])
    before = W.partitionBy(*keys).orderBy("_run").rowsBetween(W.unboundedPreceding, -1)
    shift = per.select(*keys, "_run", *[F.coalesce(F.sum(s).over(before), F.lit(0)).alias(f"_b_{s}") for s in sums], *totals)
    local = W.partitionBy(*keys, "_run").orderBy(by)
    inside = runs_of.select("*", *[F.sum(s).over(local).alias(f"_l_{s}") for s in sums])
    return inside.join(shift, [*keys, "_run"]).select(
        *df.columns, *[(F.col(f"_l_{s}") + F.col(f"_b_{s}")).alias(f"cum_{s}") for s in sums],
        *[F.col(f"all_{s}") for s in sums])
