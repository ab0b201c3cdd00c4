"""SQL pieces the checks share. They state the derived feeds with no JSON text in between."""

# order feed, with what its payload holds: NULLs where the text is damaged
ORDER_FEED = """
raw AS (
  SELECT event_id, ts, user_id, value, CAST(json_extract(props, '$.k') AS INTEGER) AS k,
         event_id % 101 = 0 OR event_id % 103 = 0 OR event_id % 107 = 0 OR event_id % 109 = 0 AS damaged
  FROM events),
feed AS (
  SELECT CAST(event_id AS VARCHAR) AS event_id, event_id AS event_no, ts AS event_timestamp, value, k, user_id, damaged,
         CASE k % 8 WHEN 0 THEN 'order_created' WHEN 1 THEN 'kitchen_started' WHEN 2 THEN 'kitchen_finished'
                    WHEN 3 THEN 'order_ready' WHEN 4 THEN 'driver_arrived' WHEN 5 THEN 'driver_picked_up'
                    WHEN 6 THEN 'delivered' ELSE 'driver_ping' END AS event_type,
         CASE WHEN event_id % 89 <> 0 THEN CAST(user_id % 27 AS INTEGER) END AS location_id,
         CASE WHEN event_id % 97 <> 0
              THEN CAST(user_id AS VARCHAR) || '-' || CAST((day(ts) - 1) // 7 AS VARCHAR) END AS order_id,
         CAST(k % 8 AS INTEGER) AS sequence
  FROM raw),
parsed AS (
  SELECT *,
         CASE WHEN event_type = 'order_created' AND NOT damaged THEN CAST(k % 30 AS INTEGER) END AS brand_id,
         CASE WHEN event_type = 'order_created' AND NOT damaged THEN 'brand ' || CAST(k % 30 AS VARCHAR) END AS brand_name,
         CASE WHEN event_type = 'order_created' AND NOT damaged AND event_no % 37 <> 0 THEN value END AS order_total,
         CASE WHEN event_type = 'order_created' AND NOT damaged THEN 40.0 + k / 100.0 END AS latitude,
         CASE WHEN event_type = 'order_created' AND NOT damaged THEN -70.0 - k / 100.0 END AS longitude,
         CASE WHEN event_type = 'order_created' AND NOT damaged THEN CAST(k % 4 + 1 AS INTEGER) END AS num_items,
         CASE WHEN event_type = 'order_created' AND NOT damaged
              THEN CAST((k % 4 + 1) * (k % 4 + 2) / 2 AS INTEGER) END AS total_quantity,
         CASE WHEN k % 8 IN (4, 5, 6) AND NOT damaged THEN 'D' || CAST(user_id % 50 AS VARCHAR) END AS driver_id,
         CAST(hour(event_timestamp) AS INTEGER) AS event_hour,
         CAST(dayofweek(event_timestamp) + 1 AS INTEGER) AS event_day_of_week,
         dayofweek(event_timestamp) IN (0, 6) AS is_weekend,
         CAST(event_timestamp AS DATE) AS event_date,
         n_name AS city_name
  FROM feed LEFT JOIN nation ON location_id = n_nationkey),
enriched AS (SELECT * FROM parsed WHERE order_id IS NOT NULL)
"""

# delivered orders: stage times and durations
LIFECYCLE = (
    ORDER_FEED
    + """,
staged AS (
  SELECT order_id, location_id, city_name,
         min(event_timestamp) FILTER (event_type = 'order_created') AS created_at,
         min(event_timestamp) FILTER (event_type = 'kitchen_started') AS kitchen_started_at,
         min(event_timestamp) FILTER (event_type = 'kitchen_finished') AS kitchen_finished_at,
         min(event_timestamp) FILTER (event_type = 'order_ready') AS order_ready_at,
         min(event_timestamp) FILTER (event_type = 'driver_arrived') AS driver_arrived_at,
         min(event_timestamp) FILTER (event_type = 'driver_picked_up') AS pickup_at,
         min(event_timestamp) FILTER (event_type = 'delivered') AS delivered_at
  FROM enriched GROUP BY ALL),
lifecycle AS (
  SELECT *,
         (floor(epoch(kitchen_finished_at)) - floor(epoch(kitchen_started_at))) / 60 AS kitchen_duration_min,
         (floor(epoch(delivered_at)) - floor(epoch(pickup_at))) / 60 AS delivery_duration_min,
         (floor(epoch(delivered_at)) - floor(epoch(created_at))) / 60 AS total_duration_min
  FROM staged WHERE delivered_at IS NOT NULL)
"""
)

# product orders and their silver form
PRODUCT_ORDERS = """
product_feed AS (
  SELECT CASE WHEN event_id % 97 <> 0 THEN 'ORD-' || CAST(event_id AS VARCHAR) END AS order_id,
         'CUST-' || CAST(user_id AS VARCHAR) AS customer_id,
         'PROD-' || json_extract_string(props, '$.k') AS product_id,
         'Product ' || json_extract_string(props, '$.k') AS product_name,
         CAST(json_extract(props, '$.k') AS INTEGER) % 3 + 1 AS quantity,
         value AS unit_price,
         round(value * (CAST(json_extract(props, '$.k') AS INTEGER) % 3 + 1), 2) AS total,
         date_trunc('second', ts) AS order_timestamp, event_type
  FROM events),
product_silver AS (
  SELECT *, CAST(order_timestamp AS DATE) AS order_date, CAST(hour(order_timestamp) AS INTEGER) AS order_hour
  FROM product_feed WHERE order_id IS NOT NULL)
"""


def cents(column: str) -> str:
    """Exact sum of an amount with two decimals."""
    return f"CAST(sum(CAST(round({column} * 100) AS BIGINT)) AS DOUBLE) / 100"


# blocks, one per order
BLOCKS = """
blocks AS (
  SELECT o_orderkey AS block_number,
         '0x' || lpad(printf('%x', o_orderkey), 16, '0') AS block_hash,
         CASE WHEN o_orderpriority = '5-LOW' THEN '0x0000000000000000000000000000000000000000'
              ELSE '0x' || lpad(printf('%x', o_custkey), 40, '0') END AS miner,
         CAST(trunc(o_totalprice * 30) AS BIGINT) AS gas_used,
         CAST(15000000 AS BIGINT) AS gas_limit,
         o_custkey % 700 AS transaction_count,
         '0x' || lpad(printf('%x', o_orderkey - 1), 16, '0') AS parent_hash,
         CAST(floor(epoch(o_orderdate)) AS BIGINT) AS timestamp,
         CAST(CAST(round(o_totalprice * 100) AS BIGINT) AS VARCHAR) || '0000000000000000' AS total_value_wei,
         CASE o_orderstatus WHEN 'F' THEN 'clerk' || CAST(o_custkey AS VARCHAR) || '@example.com'
              WHEN 'P' THEN 'ref 900-12-' || lpad(CAST(o_orderkey % 10000 AS VARCHAR), 4, '0') ELSE 'plain' END AS extra_data
  FROM orders),
flagged AS (
  SELECT *,
         list_filter([CASE WHEN gas_used * 100 > gas_limit * 95 THEN 'HIGH_GAS_USAGE' END,
                      CASE WHEN transaction_count > 500 THEN 'HIGH_TX_COUNT' END,
                      CASE WHEN transaction_count = 0 THEN 'EMPTY_BLOCK' END,
                      CASE WHEN miner = '0x0000000000000000000000000000000000000000' THEN 'ZERO_MINER' END,
                      CASE WHEN regexp_matches(extra_data, '\\b\\d{3}-\\d{2}-\\d{4}\\b') THEN 'PII_SSN'
                           WHEN regexp_matches(extra_data, '(?i)[A-Z0-9._%+-]+@[A-Z0-9.-]+\\.[A-Z]{2,}') THEN 'PII_EMAIL' END],
                     lambda x: x IS NOT NULL) AS reasons
  FROM blocks),
decided AS (SELECT *, CASE WHEN len(reasons) > 0 THEN 'QUARANTINE' ELSE 'ALLOW' END AS decision FROM flagged)
"""

# revenue per order and customer
SALES = """
per_customer AS (
  SELECT o_custkey, sum(CAST(round(l_extendedprice * (1 - l_discount) * 10000) AS BIGINT)) AS u
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1)
"""
