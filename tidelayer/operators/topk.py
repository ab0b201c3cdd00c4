"""Sorted results. A limit after a sort keeps k rows per task and merges those, never the whole input."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest(df: DataFrame, time: str, tie_break: str, n: int = 5) -> DataFrame:
    return df.orderBy(F.desc(time), F.asc(tie_break)).limit(n)


def first_rows(df: DataFrame, *order: str, n: int = 100) -> DataFrame:
    """Preview: the first n rows of a stated order, so that two previews agree."""
    return df.orderBy(*order).limit(n)
