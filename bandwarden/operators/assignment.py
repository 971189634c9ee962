"""Units to archive events by day, each event used once."""
from __future__ import annotations

import datetime
from collections import Counter, defaultdict, deque

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import materialize

TODAY, ONE_DAY = datetime.timedelta(0), datetime.timedelta(days=1)
OUTCOMES = ("exact", "classok", "daypure", "mixed", "orphan")
SWEEPS = 200              # of the overflow bound before it jumps to its largest value
TASK_ROWS = 1 << 17       # contested units and events of a task, about
RESULT = "physical_channel int, unit_id long, event_id long, event_class string, outcome string"
_ALL = object()


def overflow(days: np.ndarray, units: np.ndarray, events: np.ndarray) -> np.ndarray:
    """Upper bound of the units of each day that can find their day's events used up; ``days`` are sorted day numbers.

    A day's events are taken by its own units and by those that overflow from the days beside it.  The least solution of
    ``o = units + o(day before) + o(day after) - events``, cut to 0..units, is never exceeded; a sum that keeps rising
    is set to all units, which is a bound too."""
    beside = np.diff(days) == 1
    found = np.zeros(len(days), np.int64)
    for sweep in range(SWEEPS + len(days) + 1):
        into = np.zeros(len(days), np.int64)
        into[1:] += np.where(beside, found[:-1], 0)
        into[:-1] += np.where(beside, found[1:], 0)
        now = np.maximum(found, np.clip(units + into - events, 0, units))
        if (now == found).all():
            break
        found = np.where(now > found, units, found) if sweep >= SWEEPS else now
    return found


def _runs_of_channel(pdf: pd.DataFrame) -> pd.DataFrame:
    """Numbers the runs of days that an overflow may join; one row per day comes in."""
    pdf = pdf.sort_values("day").reset_index(drop=True)
    days = pd.to_datetime(pdf["day"]).to_numpy().astype("datetime64[D]").astype(np.int64)
    over = overflow(days, pdf["units"].to_numpy(), pdf["events"].to_numpy())
    joined = (np.diff(days) == 1) & ((over[:-1] > 0) | (over[1:] > 0))
    run = np.concatenate([[0], np.cumsum(~joined)])
    settled = pdf["enough"].to_numpy(bool) & (np.bincount(run)[run] == 1)
    return pd.DataFrame({"physical_channel": pdf["physical_channel"], "day": pdf["day"], "run": run, "settled": settled,
                         "rows": pdf["units"] + pdf["events"]})


def _runs(units: DataFrame, events: DataFrame) -> DataFrame:
    """Run of every (channel, day), and whether counts settle it.

    A day is settled when it is a run of its own and holds, for every number of frames, at least as many events as
    units: then no unit ever has to take an event with other frames.  A channel has a few thousand days at most."""
    keys = ["physical_channel", "day", "n_frames"]
    unit, event = F.lit(1).alias("u"), F.lit(0).alias("u")
    cells = units.select(*keys, unit).unionByName(events.select(*keys, event)).groupBy(*keys).agg(
        F.sum("u").alias("u"), F.count(F.lit(1)).alias("n"))
    per_day = cells.groupBy("physical_channel", "day").agg(
        F.sum("u").alias("units"), F.sum(F.col("n") - F.col("u")).alias("events"),
        F.min(F.col("u") <= F.col("n") - F.col("u")).alias("enough"))
    return per_day.groupBy("physical_channel").applyInPandas(_runs_of_channel, "physical_channel int, day date, run long, settled boolean, rows long")


class _Pool:
    """Free events of a day in their order, all together and by number of frames."""

    def __init__(self) -> None:
        self.line: dict[object, deque] = defaultdict(deque)
        self.kinds: dict[object, Counter] = defaultdict(Counter)
        self.used: set[int] = set()

    def add(self, event) -> None:
        for key in (_ALL, event.n_frames):
            self.line[key].append(event)
            self.kinds[key][event.event_class] += 1

    def __bool__(self) -> bool:
        return bool(self.kinds[_ALL])

    def take(self, n_frames: int) -> tuple[int, str | None, str]:
        alike = bool(self.kinds[n_frames])
        key = n_frames if alike else _ALL
        kinds = self.kinds[key]
        outcome = ("exact" if alike and kinds.total() == 1 else "mixed" if len(kinds) > 1 else "classok" if alike else "daypure")
        event = self.line[key].popleft()
        while event.Index in self.used:
            event = self.line[key].popleft()
        self.used.add(event.Index)
        for key in (_ALL, event.n_frames):
            left = self.kinds[key]
            left[event.event_class] -= 1
            if not left[event.event_class]:
                del left[event.event_class]
        return event.id, None if outcome == "mixed" else event.event_class, outcome


def _assign(pdf: pd.DataFrame) -> pd.DataFrame:
    """Outcomes of one contested run of days, unit by unit; the work grows with its rows."""
    pools: dict[object, _Pool] = defaultdict(_Pool)
    for event in pdf[~pdf["is_unit"]].sort_values(["order", "id"]).itertuples():
        pools[event.day].add(event)
    answers = []
    for unit in pdf[pdf["is_unit"]].sort_values(["order", "id"]).itertuples():
        pool = next((p for p in (pools.get(unit.day + d) for d in (TODAY, -ONE_DAY, ONE_DAY)) if p), None)
        answers.append((unit.id, *(pool.take(unit.n_frames) if pool else (None, None, "orphan"))))
    out = pd.DataFrame(answers, columns=["unit_id", "event_id", "event_class", "outcome"])
    out.insert(0, "physical_channel", pdf["physical_channel"].iloc[0])
    return out


def _by_rank(units: DataFrame, events: DataFrame) -> DataFrame:
    """Outcomes on settled days: the k-th unit with some number of frames takes the k-th such event.

    The events that are free at a rank are those from it to the last.  They are summed from the last one backwards, because
    a frame that ends with the group is summed anew for every row of it."""
    cell = ["physical_channel", "day", "n_frames"]
    order = W.partitionBy(*cell).orderBy("order", "id")
    left = W.partitionBy(*cell).orderBy(F.desc("order"), F.desc("id")).rowsBetween(W.unboundedPreceding, W.currentRow)
    kind = F.col("event_class")
    ranked = events.select(
        *cell, F.col("id").alias("event_id"), kind, F.count(F.lit(1)).over(W.partitionBy(*cell)).alias("all"), F.count(F.lit(1)).over(left).alias("free"),
        F.count(kind).over(left).alias("named"), F.min(kind).over(left).eqNullSafe(F.max(kind).over(left)).alias("alike")).withColumn(
        "rank", F.col("all") - F.col("free") + 1)
    pure = F.col("alike") & ((F.col("named") == 0) | (F.col("named") == F.col("free")))
    outcome = F.when(F.col("free") == 1, "exact").when(pure, "classok").otherwise("mixed")
    return units.select(*cell, F.row_number().over(order).alias("rank"), F.col("id").alias("unit_id")).join(ranked, [*cell, "rank"]).select(
        "physical_channel", "unit_id", "event_id", F.when(outcome != "mixed", kind).alias("event_class"), outcome.alias("outcome"))


def assign_units(units: DataFrame, events: DataFrame) -> DataFrame:
    """Event and class of each unit with the kind of match.

    ``units``: physical_channel, id, order, day, n_frames; ``events`` also with event_class.  Using an event once makes
    the step sequential.  Days whose units and events are settled by their counts are solved by window ranks; grouped
    calls see only the rest, cut where no unit can reach over to the next day.  A unit without day or channel is an
    orphan."""
    cols = ["physical_channel", "id", "order", "day", "n_frames"]
    placed = F.col("day").isNotNull() & F.col("physical_channel").isNotNull()
    u, e = units.select(*cols).where(placed), events.select(*cols, "event_class").where(placed)
    runs = materialize(_runs(u, e))
    # Contested rows are short but take long, so their tasks are cut by rows and not by bytes.
    waiting = runs.where("NOT settled").agg(F.sum("rows")).first()[0] or 0
    tasks = max(int(u.sparkSession.conf.get("spark.sql.shuffle.partitions")), waiting // TASK_ROWS)
    u, e = (x.join(runs.drop("rows"), ["physical_channel", "day"]) for x in (u, e))
    both = u.withColumn("event_class", F.lit(None).cast("string")).withColumn("is_unit", F.lit(True)).unionByName(
        e.withColumn("is_unit", F.lit(False)))
    contested = both.where("NOT settled").drop("settled").repartition(tasks, "physical_channel", "run").groupBy("physical_channel", "run").applyInPandas(_assign, RESULT)
    nowhere = units.where(~placed).select(
        "physical_channel", F.col("id").alias("unit_id"), F.lit(None).cast("long").alias("event_id"),
        F.lit(None).cast("string").alias("event_class"), F.lit("orphan").alias("outcome"))
    return _by_rank(u.where("settled"), e.where("settled")).unionByName(contested).unionByName(nowhere)


def assignment_quality(assigned: DataFrame) -> DataFrame:
    n, ok = F.count(F.lit(1)), F.count("event_class")
    return assigned.groupBy("physical_channel").agg(
        n.alias("n_units"), ok.alias("n_assigned"), (n - ok).alias("n_ambiguous"), (ok / n).alias("assigned_fraction"))
