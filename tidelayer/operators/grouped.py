"""Grouped metrics. All of them combine on the map side, so a group with most of the rows is no
bottleneck: what is shuffled is one partial result per group and task."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def earliest_per_stage(df: DataFrame, keys: Sequence[str], stage: str, time: str, names: Mapping[str, str]) -> DataFrame:
    """Pivot with a fixed list of stages: earliest time per stage; stages not listed are left out.

    One conditional minimum per stage gives one shuffle, where a generic pivot takes two.
    """
    return df.groupBy(*keys).agg(
        *(F.min(F.when(F.col(stage) == value, F.col(time))).alias(name) for value, name in names.items())
    )


def frequency(df: DataFrame, key: str | Column, name: str = "n") -> DataFrame:
    """Rows per value; rows without a value are not counted."""
    column = F.col(key) if isinstance(key, str) else key
    return df.where(column.isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias(name))


def count_where(condition: Column) -> Column:
    """Rows for which the condition holds (NULL does not hold)."""
    return F.count_if(condition)


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key: the first by `order`, which must be unique within a key.

    The minimum of a struct is combined on the map side, so copies of one row never meet in one task
    as a window would make them.
    """
    rest = [c for c in df.columns if c not in keys and c not in order]
    first = F.min(F.struct(*order, *rest)).alias("_first")
    return df.groupBy(*keys).agg(first).select(*keys, "_first.*").select(*df.columns)
