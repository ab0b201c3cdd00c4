"""Catalog tables by name: layer schemas, create-or-replace, checked append, load, preview."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession

LAYERS = ("bronze", "silver", "gold")


def create_layers(spark: SparkSession, layers: Iterable[str] = LAYERS) -> list[str]:
    """One schema per layer, made where it is missing; gives back all schemas there are."""
    for layer in layers:
        spark.sql(f"CREATE NAMESPACE IF NOT EXISTS {layer}")
    return [row[0] for row in spark.sql("SHOW NAMESPACES").collect()]


def drop_layers(spark: SparkSession, layers: Iterable[str] = LAYERS) -> None:
    for layer in layers:
        spark.sql(f"DROP NAMESPACE IF EXISTS {layer} CASCADE")


def replace_table(df: DataFrame, name: str, partition_by: Iterable[str] = (), path: str | None = None) -> None:
    """Create or replace. The rows must not come from the table itself."""
    writer = df.write.mode("overwrite").partitionBy(*partition_by)
    (writer.option("path", path) if path else writer).saveAsTable(name)


def append_table(df: DataFrame, name: str) -> None:
    """Adds rows; columns that the table has not, or with other types, are refused before anything is written."""
    table = df.sparkSession.table(name)
    if sorted(df.dtypes) != sorted(table.dtypes):
        raise ValueError(f"schema mismatch for {name}: table has {table.dtypes}, rows have {df.dtypes}")
    df.select(*table.columns).write.mode("append").saveAsTable(name)


def create_as(spark: SparkSession, name: str, query: str, path: str | None = None, **inputs: DataFrame) -> None:
    """CREATE TABLE AS SELECT; `{input}` placeholders of the query are DataFrames."""
    at = f"LOCATION '{path}'" if path else ""
    spark.sql(f"CREATE TABLE {name} USING parquet {at} AS {query}", **inputs)


def insert_select(spark: SparkSession, name: str, query: str, **inputs: DataFrame) -> None:
    """INSERT INTO .. SELECT; `{input}` placeholders of the query are DataFrames."""
    spark.sql(f"INSERT INTO {name} {query}", **inputs)


def insert_values(spark: SparkSession, name: str, rows: list[tuple]) -> None:
    """Adds a few literal rows, in the order of the table's columns."""
    append_table(spark.createDataFrame(rows, spark.table(name).schema), name)


def columns_of(spark: SparkSession, name: str) -> DataFrame:
    """column_name, column_type as the catalog has them."""
    described = spark.sql(f"DESCRIBE TABLE {name}")
    return described.selectExpr("col_name AS column_name", "data_type AS column_type")


def load_tables(tables: Mapping[str, DataFrame]) -> None:
    """Overwrites one table per entry: dimensions and facts of a load."""
    for name, df in tables.items():
        replace_table(df, name)


def tables_of(spark: SparkSession, layer: str) -> list[str]:
    return [row["tableName"] for row in spark.sql(f"SHOW TABLES IN {layer}").collect() if not row["isTemporary"]]


def describe(spark: SparkSession, name: str) -> DataFrame:
    return spark.sql(f"DESCRIBE EXTENDED {name}")


def preview(spark: SparkSession, name: str, n: int = 100) -> DataFrame:
    """Any n rows, for a look at a table."""
    return spark.table(name).limit(n)
