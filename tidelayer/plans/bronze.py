"""Bronze: raw copies, with a parsed event time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelayer.functions.times import event_time, event_time_lenient


def orders(feed: DataFrame) -> DataFrame:
    """The feed with event_timestamp."""
    return feed.withColumn("event_timestamp", event_time("ts"))


def orders_lenient(feed: DataFrame) -> DataFrame:
    """The same for a feed whose time texts may be anything: NULL instead of a failed job."""
    return feed.withColumn("event_timestamp", event_time_lenient("ts"))


def locations(nation: DataFrame) -> DataFrame:
    """Location dimension: id, city."""
    return nation.select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("city"))


def brands(part: DataFrame) -> DataFrame:
    """Brand dimension: id, name; the parts are reduced to their brands on the map side."""
    return part.select("p_brand").distinct().select(
        F.regexp_extract("p_brand", r"(\d+)$", 1).cast("int").alias("id"), F.col("p_brand").alias("name")
    )


def items(part: DataFrame) -> DataFrame:
    """Item dimension: id, brand, name, price, category."""
    return part.select(
        F.col("p_partkey").alias("id"),
        F.col("p_brand").alias("brand"),
        F.col("p_name").alias("name"),
        F.col("p_retailprice").alias("price"),
        F.col("p_type").alias("category"),
    )


def categories(part: DataFrame) -> DataFrame:
    """Category dimension: the names that items have."""
    return part.select(F.col("p_type").alias("name")).distinct()
