"""Registered tables with their freshness targets, and the lineage between them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Layer, table, kind, partitioning, freshness target in hours.
TABLES = [
    ("bronze", "raw_orders", "staging", '{"type": "hour", "column": "event_timestamp"}', 1),
    ("bronze", "raw_clicks", "staging", '{"type": "hour", "column": "event_timestamp"}', 1),
    ("bronze", "raw_inventory", "staging", '{"type": "day", "column": "updated_at"}', 24),
    ("silver", "orders", "fact", '{"type": "day", "column": "order_date"}', 2),
    ("silver", "order_items", "fact", '{"type": "day", "column": "order_date"}', 2),
    ("silver", "customers", "dimension", None, 24),
    ("silver", "products", "dimension", None, 24),
    ("gold", "daily_sales", "aggregate", '{"type": "day", "column": "sales_date"}', 4),
    ("gold", "customer_lifetime_value", "aggregate", None, 24),
    ("gold", "product_performance", "aggregate", '{"type": "month", "column": "period_start"}', 24),
]
# Source layer and table, target layer and table, transformation.
EDGES = [
    ("bronze", "raw_orders", "silver", "orders", "etl"),
    ("bronze", "raw_orders", "silver", "order_items", "etl"),
    ("silver", "orders", "gold", "daily_sales", "aggregation"),
    ("silver", "orders", "gold", "customer_lifetime_value", "aggregation"),
    ("silver", "order_items", "gold", "product_performance", "aggregation"),
]


def tables(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(TABLES, "layer STRING, table_name STRING, kind STRING, partition_spec STRING, sla_hours INT").withColumn(
        "partition_unit", F.get_json_object("partition_spec", "$.type")
    )


def edges(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        EDGES, "source_layer STRING, source_table STRING, target_layer STRING, target_table STRING, transformation STRING"
    )


def two_hops(spark: SparkSession) -> DataFrame:
    """Bronze tables and the gold tables they reach through one silver table."""
    first, second = edges(spark).alias("a"), edges(spark).alias("b")
    meet = (F.col("a.target_layer") == F.col("b.source_layer")) & (F.col("a.target_table") == F.col("b.source_table"))
    return first.join(second, meet).select(
        F.col("a.source_table").alias("bronze_table"),
        F.col("a.target_table").alias("silver_table"),
        F.col("b.target_table").alias("gold_table"),
        F.concat_ws(" > ", "a.transformation", "b.transformation").alias("path"),
    )
