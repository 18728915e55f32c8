"""Ranking, sampling by rank, and totals: the window operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _ordered(order: Sequence[Column | str]) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in order]


def top_n_per_group(df: DataFrame, by: Sequence[str], order: Sequence[Column | str], n: int, rank: str = "rank") -> DataFrame:
    """The first n rows of each group with their rank (long, from 1)."""
    numbered = df.withColumn(rank, F.row_number().over(Window.partitionBy(*by).orderBy(*_ordered(order))).cast("long"))
    return numbered.where(F.col(rank) <= n)


def best_per_key(df: DataFrame, by: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    return top_n_per_group(df, by, order, 1, "_rank").drop("_rank")


def latest_per_key(df: DataFrame, by: Sequence[str], time: str, ties: Sequence[str] = ()) -> DataFrame:
    """The newest row of each key; ties are broken by the columns named, largest last wins.

    An aggregate of one struct, so each task sends on one row for each key.
    """
    others = [c for c in df.columns if c not in by and c != time and c not in ties]
    row = F.struct(time, *ties, *others)
    newest = df.groupBy(*by).agg(F.max(row).alias("_newest"))
    return newest.select(*by, "_newest.*").select(*df.columns)


def last_wins(df: DataFrame, by: Sequence[str], sequence: str) -> DataFrame:
    return latest_per_key(df, by, sequence)


def assign_rank(df: DataFrame, order: Sequence[Column | str], by: Sequence[str] = (), rank: str = "rank") -> DataFrame:
    """Positions 1..n within each group; without groups, only for results of a few rows."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*by).orderBy(*_ordered(order))).cast("long"))


def tail_align(df: DataFrame, by: Sequence[str], time: str, ties: Sequence[str] = ()) -> DataFrame:
    """Position of each point counted from the end of its series (1 is the newest)."""
    newest = [F.col(c).desc() for c in (time, *ties)]
    return df.withColumn("from_end", F.row_number().over(Window.partitionBy(*by).orderBy(*newest)).cast("long"))


def running_position(df: DataFrame, by: Sequence[str], time: str, ties: Sequence[str] = ()) -> DataFrame:
    return df.withColumn("position", F.row_number().over(Window.partitionBy(*by).orderBy(time, *ties)).cast("long"))


def share_of_total(df: DataFrame, value: str, digits: int = 2) -> DataFrame:
    """Percent of the column's sum, by a join with the one-row total rather than a window over all rows."""
    total = df.agg(F.sum(value).alias("_total"))
    return df.crossJoin(F.broadcast(total)).withColumn("percent", F.round(F.col(value) * 100.0 / F.col("_total"), digits)).drop("_total")


def share_of_max(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    largest = F.max(value).over(Window.partitionBy(*by))
    return df.withColumn("share", F.col(value) / F.when(largest == 0, 1.0).otherwise(largest))


def first_seen_distinct(items: Column) -> Column:
    """An array without later repeats, order kept."""
    return F.array_distinct(items)
