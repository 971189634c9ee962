"""Activity eras: change points in monthly levels and what follows from them."""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import clock
from ..session import materialize
from .exposure import unit_stats
from .quantiles import grouped_quantiles
from .small import CHANNEL_ROWS, join_small

ERA_ROWS = CHANNEL_ROWS * C.ERA_MAX


def split_scores(months: np.ndarray, level: np.ndarray) -> np.ndarray:
    """Score of a new era at every position of a run of months; zero where none may start.

    All positions share one ranking of the run, so the rank sums left of them are a running sum and the tie-corrected
    variance differs only by the two sample sizes."""
    n = len(level)
    at = np.arange(1, n)
    series = pd.Series(level)
    rank_sum = series.rank(method="average").cumsum().to_numpy()[:-1]
    tied = series.value_counts().to_numpy(float)
    spread = at * (n - at) / 12 * (n + 1 - (tied ** 3 - tied).sum() / (n * (n - 1)))
    away = np.abs(rank_sum - at * (at + 1) / 2 - at * (n - at) / 2)
    z = np.divide(away, np.sqrt(spread), out=np.zeros(n - 1), where=spread > 0)
    before = series.expanding().median().to_numpy()[:-1]
    after = series[::-1].expanding().median().to_numpy()[::-1][1:]
    step = np.abs(after - before)
    days = C.DAYS_PER_MONTH * np.minimum(months[at - 1] - months[0] + 1, months[-1] - months[at] + 1)
    allowed = ((np.minimum(at, n - at) >= C.ERA_MIN_MONTHS) & (days >= C.ERA_MIN_DAYS)
               & (step >= C.ERA_MIN_STEP_DB) & (z >= C.ERA_Z))
    return np.concatenate([[0.0], np.where(allowed, z * step, 0.0)])


def cut_months(months: np.ndarray, level: np.ndarray) -> list[int]:
    """Positions where a new era starts.

    Runs wait in a stack, earlier months on top; the best position of a run cuts it in two, as long as there are fewer
    than the greatest number of eras."""
    cuts: list[int] = []
    waiting = [(0, len(months))]
    while waiting and len(cuts) < C.ERA_MAX - 1:
        lo, hi = waiting.pop()
        if hi - lo < 2 * C.ERA_MIN_MONTHS:
            continue
        score = split_scores(months[lo:hi], level[lo:hi])
        best = int(score.argmax())
        if score[best] > 0:
            cuts.append(lo + best)
            waiting += [(lo + best, hi), (lo, lo + best)]
    return sorted(cuts)


def unit_levels(df: DataFrame) -> DataFrame:
    return unit_stats(df).select("physical_channel", "event_id", "unit_time0", "level_db",
                                 clock.month_index(F.col("unit_time0")).alias("month"))


def monthly_levels(levels: DataFrame, max_rows: int | None = None) -> DataFrame:
    return grouped_quantiles(levels, ["physical_channel", "month"], {"level_db": ("level_db", 0.5)},
                             [F.count(F.lit(1)).alias("n_units")], max_rows=max_rows)


def segment(levels: DataFrame, max_rows: int | None = None) -> DataFrame:
    """Eras per channel with their units and levels.

    Only monthly medians, one row per channel and calendar month, reach the
    grouped pandas call; everything per unit stays distributed."""
    def cut(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("month")
        months, level = pdf["month"].to_numpy(), pdf["level_db"].to_numpy()
        edges = [0, *cut_months(months, level), len(months)]
        return pd.DataFrame({
            "physical_channel": pdf["physical_channel"].iloc[0], "era": range(len(edges) - 1),
            "month_start": [months[a] for a in edges[:-1]], "month_end": [months[b - 1] for b in edges[1:]]})

    bounds = materialize(monthly_levels(levels, max_rows).groupBy("physical_channel").applyInPandas(
        cut, "physical_channel int, era int, month_start int, month_end int"))
    tagged = assign_era(levels, bounds)
    return grouped_quantiles(
        tagged, ["physical_channel", "era", "month_start", "month_end"],
        {"level_median_db": ("level_db", 0.5), "level_p90_db": ("level_db", 0.9)},
        [F.count(F.lit(1)).alias("n_units")], max_rows=max_rows)


def assign_era(df: DataFrame, eras: DataFrame, month: str = "month") -> DataFrame:
    """Rows with the era of their month; the era table has at most five rows a
    channel, so the range test rides on a broadcast equi-join."""
    j = join_small(df, eras.select("physical_channel", "era", "month_start", "month_end"), ["physical_channel"], rows=ERA_ROWS)
    return j.where(F.col(month).between(F.col("month_start"), F.col("month_end")))


def latest_era(df: DataFrame, eras: DataFrame, month: str = "month") -> DataFrame:
    last = eras.groupBy("physical_channel").agg(F.max(F.struct("era", "month_start", "month_end")).alias("e")).select(
        "physical_channel", "e.*")
    return assign_era(df, last, month)


def quiet_era_floor(frames: DataFrame, eras: DataFrame, value: str = "shelf_db", level_db: float = 1.0, q: float = 0.9,
                    min_n: int = 30, max_rows: int | None = None) -> DataFrame:
    """High quantile of the value in the quietest era of each channel whose
    level is low and which has enough finite values."""
    quiet = eras.where(F.col("level_median_db") <= level_db)
    held = materialize(assign_era(frames, quiet).select("physical_channel", "era", value))
    g = grouped_quantiles(held, ["physical_channel", "era"], {"floor_db": (value, q)},
                          [F.count(value).alias("n")], max_rows=max_rows).where(F.col("n") >= min_n)
    j = g.join(F.broadcast(eras.select("physical_channel", "era", "level_median_db")), ["physical_channel", "era"])
    return j.groupBy("physical_channel").agg(
        F.min_by(F.struct("era", "floor_db", "n"), F.struct("level_median_db", "era")).alias("b")).select("physical_channel", "b.*")


def era_agreement(eras: DataFrame, known: DataFrame) -> DataFrame:
    """Found eras against a table of known transitions (one row a channel)."""
    n = eras.groupBy("physical_channel").agg(F.count(F.lit(1)).alias("n_eras"))
    j = n.join(F.broadcast(known.select("physical_channel").distinct().withColumn("known", F.lit(True))), "physical_channel", "left")
    many, was = F.col("n_eras") > 1, F.col("known").isNotNull()
    return j.select("physical_channel", "n_eras", F.when(many & was, "agrees").when(many, "NEW").when(was, "MISSED")
                    .otherwise("single").alias("verdict"))
