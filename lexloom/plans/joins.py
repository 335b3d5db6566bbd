"""Joins whose hot keys are known by their counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: rows up to which a table is broadcast (its rows hold short values), after they have been counted
SMALL_ROWS = 500_000
#: a key is hot if it holds more than this part of all rows, so there are fewer than HOT_PART hot keys
HOT_PART = 1000


def join_counted(rows: DataFrame, known: DataFrame, on: str, n: str, total: int | None = None) -> DataFrame:
    """Inner join of rows with known on a key that is unique in known and never null; column n tells how many rows hold the key.

    The hot keys, fewer than HOT_PART whatever the size of the tables, are broadcast, and their rows stay where they are;
    all others are shuffled. Both tables are read more than once, so they should be staged. total: the number of rows, or a
    bound on it, where it is known.
    """
    total = (known.agg(F.sum(n)).first()[0] or 0) if total is None else total
    is_hot = F.col(n) * HOT_PART > int(total)
    hot = known.filter(is_hot)
    near = rows.join(F.broadcast(hot), on)
    far = rows.join(F.broadcast(hot.select(on)), on, "left_anti").join(known.filter(~is_hot), on)
    return near.unionByName(far)


def small(df: DataFrame) -> DataFrame:
    """df, to be broadcast if it has at most SMALL_ROWS rows; else Spark joins it as it sees fit. df is counted, so it should be staged or cheap."""
    return F.broadcast(df) if df.limit(SMALL_ROWS + 1).count() <= SMALL_ROWS else df
