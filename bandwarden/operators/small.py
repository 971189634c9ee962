"""Joins with tables that are small by construction or by a checked count."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as C

# One row per television channel at most.
CHANNEL_ROWS = C.LAST_CHANNEL - C.FIRST_CHANNEL + 1


def join_small(df: DataFrame, small: DataFrame, keys: Sequence[str], rows: int | None = None,
               how: str = "inner") -> DataFrame:
    """``df`` joined with a per-group table without shuffling ``df``.

    ``rows`` is a proven bound (one row per channel when the only key is the
    channel).  Without one the table is counted: up to the limit it is
    broadcast, beyond it the planner picks a shuffle join and splits skew."""
    keys = list(keys)
    if rows is None and keys == ["physical_channel"]:
        rows = CHANNEL_ROWS
    if rows is None:
        rows = small.limit(C.BROADCAST_ROWS + 1).count()
    side = F.broadcast(small) if rows <= C.BROADCAST_ROWS else small
    return df.join(side, keys, how)


def join_scalar(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Adds the columns of a one-row aggregate to every row."""
    return df.join(F.broadcast(one_row), F.lit(True))
