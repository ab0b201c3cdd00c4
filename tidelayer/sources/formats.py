"""File formats other than the Parquet tables: read options in one place, and the matching writes."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from tidelayer.functions.times import time_partition

FORMATS = ("parquet", "json", "csv", "orc", "text")


def read_json(spark: SparkSession, path: str, schema: str | StructType | None = None, multiline: bool = False) -> DataFrame:
    reader = spark.read.option("multiLine", multiline)
    return (reader.schema(schema) if schema else reader).json(path)


def read_csv(
    spark: SparkSession,
    path: str,
    schema: str | StructType | None = None,
    delimiter: str = ",",
    header: bool = True,
) -> DataFrame:
    """Declared schema, or one more pass over the file to infer it."""
    reader = spark.read.option("header", header).option("sep", delimiter)
    return (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path)


def read_orc(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.orc(path)


def read_text(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)


def read_any(spark: SparkSession, fmt: str, path: str, schema: str | StructType | None = None, **options: str) -> DataFrame:
    reader = spark.read.format(fmt).options(**options)
    return (reader.schema(schema) if schema else reader).load(path)


def clustered(df: DataFrame, partition_by: Iterable[str]) -> DataFrame:
    """Rows of one partition folder together, in tasks of about the advisory size.

    Without it every task writes a file to every folder. Rebalancing splits a folder that has most
    of the rows over many tasks, and puts small folders together in one.
    """
    return df.hint("rebalance", *partition_by)


def write_any(
    df: DataFrame,
    fmt: str,
    path: str,
    mode: str = "overwrite",
    compression: str | None = None,
    partition_by: list[str] | None = None,
    **options: str,
) -> str:
    """Write and give the path back, so that a round trip reads as one expression."""
    writer = (clustered(df, partition_by) if partition_by else df).write.format(fmt).mode(mode).options(**options)
    if compression:
        writer = writer.option("compression", compression)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)
    return path


def write_by_time(df: DataFrame, path: str, ts: str, unit: str, mode: str = "overwrite") -> str:
    """Parquet by hour, day or month folders of a time column, in a partition column named <ts>_<unit>.

    Filters on that column skip whole folders when the table is read.
    """
    column = f"{ts}_{unit}"
    return write_any(df.withColumn(column, time_partition(ts, unit)), "parquet", path, mode, partition_by=[column])
