"""Event time: parsing, calendar features, durations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def event_time(ts: str | Column) -> Column:
    """ISO text, with T or blank, to timestamp. Under ANSI a text that is no time raises."""
    return F.to_timestamp(ts)


def event_time_lenient(ts: str | Column) -> Column:
    """ISO text with or without microseconds; NULL for anything else."""
    return F.coalesce(
        F.try_to_timestamp(ts, F.lit("yyyy-MM-dd'T'HH:mm:ss.SSSSSS")),
        F.try_to_timestamp(ts, F.lit("yyyy-MM-dd'T'HH:mm:ss")),
    )


def is_weekend(ts: str | Column) -> Column:
    """Saturday or Sunday; a missing time stays NULL."""
    return F.dayofweek(ts).isin(1, 7)


def with_time_features(df: DataFrame, ts: str = "event_timestamp") -> DataFrame:
    """Hour, day of week (Sunday = 1), weekend flag (False for a missing time) and date."""
    return df.withColumns(
        {
            "event_hour": F.hour(ts),
            "event_day_of_week": F.dayofweek(ts),
            "is_weekend": F.coalesce(is_weekend(ts), F.lit(False)),
            "event_date": F.to_date(ts),
        }
    )


def minutes_between(start: str, end: str) -> Column:
    """Whole seconds from start to end, in minutes; NULL when either is missing."""
    return (F.unix_timestamp(end) - F.unix_timestamp(start)) / 60


def time_partition(ts: str, unit: str) -> Column:
    """Partition value of a time: a date for days, text for hours (2024-01-31-23) and months (2024-01)."""
    if unit == "day":
        return F.to_date(ts)
    return F.date_format(ts, {"hour": "yyyy-MM-dd-HH", "month": "yyyy-MM"}[unit])
