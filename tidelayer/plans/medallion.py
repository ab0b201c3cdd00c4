"""The event medallion as a graph: SQL and Python datasets, views and one stream, over a data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelayer.plans import bronze, gold, silver
from tidelayer.plans.graph import Graph
from tidelayer.sources import read_declared, stream_table
from tidelayer.sources.feed import order_feed


def clean_events(events: DataFrame) -> DataFrame:
    """Events with a type, four columns, time named event_time."""
    return events.where(F.col("event_type").isNotNull()).select("event_id", "event_type", "user_id", F.col("ts").alias("event_time"))


def medallion(spark: SparkSession, sf_dir: str) -> Graph:
    graph = Graph(spark)

    @graph.view("bronze_orders", "bronze", "Raw order events with a parsed time.")
    def _(read):
        return bronze.orders(order_feed(read_declared(spark, sf_dir, "events")))

    @graph.view("bronze_locations", "bronze", "Places.")
    def _(read):
        return bronze.locations(read_declared(spark, sf_dir, "nation"))

    @graph.view("bronze_brands", "bronze", "Brands.")
    def _(read):
        return bronze.brands(read_declared(spark, sf_dir, "part"))

    @graph.stream("events_clean", "silver", lambda: stream_table(spark, sf_dir, "events"), "Events taken in as they arrive.")
    def _(stream):
        return clean_events(stream)

    @graph.view("silver_orders", "silver", "Parsed and enriched orders.")
    def _(read):
        return silver.enriched(read("bronze_orders"), read("bronze_locations"))

    graph.sql("silver_orders_sql", "silver", silver.ENRICHED_SQL, "The same in SQL, without the null filter.")

    @graph.view("silver_lifecycle", "silver", "One row per delivered order.")
    def _(read):
        return silver.order_lifecycle(read("silver_orders"))

    @graph.view("gold_hourly", "gold", "Orders and revenue per hour and place.")
    def _(read):
        return gold.hourly_metrics(read("silver_orders"))

    @graph.view("gold_delivery", "gold", "Delivery times per day and place.")
    def _(read):
        return gold.delivery_performance(read("silver_lifecycle"))

    @graph.view("gold_brands", "gold", "Revenue per brand.")
    def _(read):
        return gold.brand_summary(read("silver_orders"), read("bronze_brands"))

    graph.sql("gold_hourly_sql", "gold", gold.HOURLY_SQL, "Orders and revenue per hour and city.")
    graph.sql("gold_brands_sql", "gold", gold.BRANDS_SQL, "Revenue per brand name, largest first.")

    @graph.view("events_by_type", "gold", "Events per type, recomputed from the stream's table.")
    def _(read):
        return gold.events_by_type(read("events_clean"))

    return graph
