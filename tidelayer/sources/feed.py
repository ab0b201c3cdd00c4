"""Raw feeds in the shapes the layers expect, derived row by row from the `events` and `orders` tables.

Nothing here joins, groups or shuffles: every feed is a projection of its table, so it streams and
it costs one scan. The defects a raw feed has (unknown keys, NULL keys, cut or unquoted JSON,
missing totals) are set by expression so that cleaning rules have something to clean.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Event types of the order feed, in the order an order goes through them.
ORDER_EVENT_TYPES = [
    "order_created",
    "kitchen_started",
    "kitchen_finished",
    "order_ready",
    "driver_arrived",
    "driver_picked_up",
    "delivered",
    "driver_ping",
]


def _props_k() -> Column:
    return F.get_json_object("props", "$.k").cast("int")


# Payload text by stage: the created order, the kitchen, the driver, the position.
_BODY = """
CASE
  WHEN stage = 0 THEN to_json(named_struct(
    'customer_lat', 40D + k / 100D,
    'customer_lon', -70D - k / 100D,
    'brand_id', k % 30,
    'brand_name', concat('brand ', k % 30),
    'items', transform(sequence(1, k % 4 + 1), i -> named_struct(
        'item_id', k + i, 'name', concat('item ', k + i), 'price', value, 'quantity', i)),
    'total', CASE WHEN event_id % 37 <> 0 THEN value END))
  WHEN stage IN (1, 2, 3) THEN to_json(named_struct('kitchen_id', concat('K', k % 7)))
  WHEN stage IN (4, 5, 6) THEN to_json(named_struct('driver_id', concat('D', user_id % 50)))
  ELSE to_json(named_struct('progress_pct', value))
END
"""
# Some payloads are cut in half, lack their last brace, lack a quote or have a comma too many.
_DAMAGED_BODY = """
CASE
  WHEN event_id % 101 = 0 THEN left(body, length(body) div 2)
  WHEN event_id % 103 = 0 THEN left(body, length(body) - 1)
  WHEN event_id % 107 = 0 THEN concat('{', substring(body, 3))
  WHEN event_id % 109 = 0 THEN concat(left(body, length(body) - 1), ',}')
  ELSE body
END
"""


def order_feed(events: DataFrame) -> DataFrame:
    """events -> event_id, event_type, ts, ts_seconds, location_id, order_id, sequence, body.

    One order is what one user does within one week. `body` is JSON text by event type.
    """
    types = ", ".join(f"'{name}'" for name in ORDER_EVENT_TYPES)
    staged = events.selectExpr("event_id", "ts", "user_id", "value", "CAST(get_json_object(props, '$.k') AS INT) AS k")
    bodies = staged.selectExpr("*", "k % 8 AS stage").selectExpr("*", f"{_BODY} AS body")
    return bodies.selectExpr(
        "CAST(event_id AS STRING) AS event_id",
        f"element_at(array({types}), stage + 1) AS event_type",
        "date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss.SSSSSS\") AS ts",
        "unix_timestamp(ts) AS ts_seconds",
        "CASE WHEN event_id % 89 <> 0 THEN CAST(user_id % 27 AS INT) END AS location_id",
        "CASE WHEN event_id % 97 <> 0 THEN concat(user_id, '-', (dayofmonth(ts) - 1) div 7) END AS order_id",
        "stage AS sequence",
        f"{_DAMAGED_BODY} AS body",
    )


def product_orders(events: DataFrame) -> DataFrame:
    """events -> ten-field product order events, time as ISO text."""
    k = F.col("k")
    return events.withColumn("k", _props_k()).select(
        F.col("event_id").cast("string").alias("event_id"),
        F.col("event_type"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"),
        F.when(F.col("event_id") % 97 != 0, F.concat(F.lit("ORD-"), F.col("event_id").cast("string"))).alias("order_id"),
        F.concat(F.lit("CUST-"), F.col("user_id").cast("string")).alias("customer_id"),
        F.concat(F.lit("PROD-"), k.cast("string")).alias("product_id"),
        F.concat(F.lit("Product "), k.cast("string")).alias("product_name"),
        (k % 3 + 1).alias("quantity"),
        F.col("value").alias("unit_price"),
        F.round(F.col("value") * (k % 3 + 1), 2).alias("total"),
    )


def envelope(payload: DataFrame, key: str, topic: str, partition_key: str, offset: str, time: str) -> DataFrame:
    """Rows as message-log records: key, value (JSON, both binary), topic, partition, offset, timestamp."""
    return payload.select(
        F.col(key).cast("string").cast("binary").alias("key"),
        F.to_json(F.struct("*")).cast("binary").alias("value"),
        F.lit(topic).alias("topic"),
        F.pmod(F.col(partition_key).cast("bigint"), F.lit(8)).cast("int").alias("partition"),
        F.col(offset).cast("bigint").alias("offset"),
        F.col(time).cast("timestamp").alias("timestamp"),
    )


def block_feed(orders: DataFrame) -> DataFrame:
    """orders -> block events: ten fields, the limit fixed, the rest taken from the order."""
    key = F.col("o_orderkey")
    return orders.select(
        key.alias("block_number"),
        F.concat(F.lit("0x"), F.lpad(F.lower(F.hex(key)), 16, "0")).alias("block_hash"),
        F.concat(F.lit("0x"), F.lpad(F.lower(F.hex(key - 1)), 16, "0")).alias("parent_hash"),
        F.when(F.col("o_orderpriority") == "5-LOW", F.lit("0x" + "0" * 40))
        .otherwise(F.concat(F.lit("0x"), F.lpad(F.lower(F.hex("o_custkey")), 40, "0")))
        .alias("miner"),
        (F.col("o_totalprice") * 30).cast("bigint").alias("gas_used"),
        F.lit(15_000_000).cast("bigint").alias("gas_limit"),
        (F.col("o_custkey") % 700).alias("transaction_count"),
        F.unix_timestamp("o_orderdate").alias("timestamp"),
        F.concat(F.rint(F.col("o_totalprice") * 100).cast("bigint").cast("string"), F.lit("0000000000000000")).alias("total_value_wei"),
        F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("clerk"), F.col("o_custkey").cast("string"), F.lit("@example.com")))
        .when(F.col("o_orderstatus") == "P", F.concat(F.lit("ref 900-12-"), F.lpad((key % 10000).cast("string"), 4, "0")))
        .otherwise(F.lit("plain"))
        .alias("extra_data"),
    )
