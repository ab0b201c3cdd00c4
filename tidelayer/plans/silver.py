"""Silver: parsed, enriched and reshaped events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelayer.functions import payload
from tidelayer.functions.times import is_weekend, minutes_between, with_time_features
from tidelayer.operators.grouped import earliest_per_stage
from tidelayer.operators.joins import join_dimension

# Lifecycle stage (event type) and the column its time goes to.
STAGE_TIMES = {
    "order_created": "created_at",
    "kitchen_started": "kitchen_started_at",
    "kitchen_finished": "kitchen_finished_at",
    "order_ready": "order_ready_at",
    "driver_arrived": "driver_arrived_at",
    "driver_picked_up": "pickup_at",
    "delivered": "delivered_at",
}

# SQL form of the enrichment; `{bronze_orders}` and `{bronze_locations}` are upstream datasets.
ENRICHED_SQL = f"""
WITH places AS (SELECT id AS place_id, city FROM {{bronze_locations}}),
read_orders AS (SELECT *, from_json(body, '{payload.BRIEF_BODY}') AS content FROM {{bronze_orders}})
SELECT event_id, event_type, event_timestamp, CAST(event_timestamp AS DATE) AS event_date, hour(event_timestamp) AS event_hour,
       order_id, content.total AS order_total, size(content.items) AS num_items, content.brand_id, content.brand_name,
       location_id, city AS city_name
FROM read_orders LEFT JOIN places ON place_id = location_id
"""


def complete_rows(orders: DataFrame) -> DataFrame:
    """Rows that have an event id, an order id and a time."""
    return orders.where(F.col("event_id").isNotNull() & F.col("order_id").isNotNull() & F.col("event_timestamp").isNotNull())


def _with_city(orders: DataFrame, locations: DataFrame) -> DataFrame:
    """city_name by place; a row whose place is unknown or missing stays without one."""
    cities = locations.select(F.col("id").alias("location_id"), F.col("city").alias("city_name"))
    return join_dimension(orders, cities, "location_id").select(*orders.columns, "city_name")


def enriched(orders: DataFrame, locations: DataFrame) -> DataFrame:
    """Parsed body, time features and city; rows lacking a key or time are dropped."""
    parsed = (
        complete_rows(orders)
        .withColumn("details", payload.parse("body", payload.FLAT_BODY))
        .select(
            "event_id",
            "event_type",
            "event_timestamp",
            "ts",
            "ts_seconds",
            "order_id",
            "location_id",
            "sequence",
            "body",
            "details.brand_id",
            F.col("details.total").alias("order_total"),
            F.col("details.customer_lat").alias("latitude"),
            F.col("details.customer_lon").alias("longitude"),
            "details.driver_id",
        )
    )
    return _with_city(with_time_features(parsed), locations)


def enriched_with_items(orders: DataFrame, locations: DataFrame) -> DataFrame:
    """The variant with item counts; the weekend flag of a missing time is NULL here."""
    parsed = (
        complete_rows(orders)
        .withColumn("details", payload.parse("body", payload.CREATED_BODY))
        .select(
            "event_id",
            "event_type",
            "event_timestamp",
            "ts_seconds",
            "order_id",
            "location_id",
            "sequence",
            "details.brand_id",
            "details.brand_name",
            F.col("details.total").alias("order_total"),
            F.col("details.customer_lat").alias("latitude"),
            F.col("details.customer_lon").alias("longitude"),
            F.size("details.items").alias("num_items"),
            payload.fold_quantity("details.items").alias("total_quantity"),
            F.hour("event_timestamp").alias("event_hour"),
            F.dayofweek("event_timestamp").alias("event_dow"),
            is_weekend("event_timestamp").alias("is_weekend"),
            F.to_date("event_timestamp").alias("event_date"),
        )
    )
    return _with_city(parsed, locations)


def created_orders(feed: DataFrame) -> DataFrame:
    """Created orders only, from the raw feed: the type filter runs before any JSON is parsed."""
    return (
        feed.where(F.col("event_type") == "order_created")
        .withColumn("details", payload.parse("body", payload.BRIEF_BODY))
        .select(
            "order_id",
            F.to_timestamp("ts").alias("order_ts"),
            "location_id",
            F.col("details.brand_name").alias("brand"),
            F.col("details.total").alias("order_total"),
            F.size("details.items").alias("item_count"),
        )
    )


def paid_orders(created: DataFrame) -> DataFrame:
    """Created orders with a total above zero (a missing total is not) and their date."""
    return created.where("order_total > 0").withColumn("order_date", F.to_date("order_ts"))


def order_lifecycle(enriched_orders: DataFrame) -> DataFrame:
    """One row per delivered order and place: first time of each stage, and three durations.

    Events that lost their place are an order of their own, so the order lacks their stage.
    """
    return _lifecycle(enriched_orders, ["order_id", "location_id", "city_name"])


def order_lifecycle_whole(enriched_orders: DataFrame) -> DataFrame:
    """One row per delivered order, wherever its events say they were: no stage is lost with its place."""
    return _lifecycle(enriched_orders, ["order_id"])


def _lifecycle(enriched_orders: DataFrame, keys: list[str]) -> DataFrame:
    staged = enriched_orders.where(F.col("event_type").isin(*STAGE_TIMES))
    stages = earliest_per_stage(staged, keys, "event_type", "event_timestamp", STAGE_TIMES)
    return stages.where(F.col("delivered_at").isNotNull()).withColumns(
        {
            "kitchen_duration_min": minutes_between("kitchen_started_at", "kitchen_finished_at"),
            "delivery_duration_min": minutes_between("pickup_at", "delivered_at"),
            "total_duration_min": minutes_between("created_at", "delivered_at"),
        }
    )


def product_orders(feed: DataFrame) -> DataFrame:
    """Product orders with an id, time parsed once."""
    at = F.to_timestamp("timestamp")
    return feed.where(F.col("order_id").isNotNull()).select(
        "order_id",
        "customer_id",
        "product_id",
        "product_name",
        "quantity",
        "unit_price",
        "total",
        at.alias("order_timestamp"),
        F.to_date(at).alias("order_date"),
        F.hour(at).alias("order_hour"),
    )
