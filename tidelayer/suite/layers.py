"""Bronze, silver and gold datasets, each one query."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelayer.plans import bronze, commerce, gold, silver
from tidelayer.plans.graph import sql_dataset
from tidelayer.plans.medallion import medallion
from tidelayer.session import run_dir
from tidelayer.sources import read_table
from tidelayer.sources.feed import order_feed, product_orders
from tidelayer.suite.common import LIFECYCLE, ORDER_FEED, PRODUCT_ORDERS, cents


def _feed(spark: SparkSession, sf: str) -> DataFrame:
    return order_feed(read_table(spark, sf, "events"))


def _places(spark: SparkSession, sf: str) -> DataFrame:
    return bronze.locations(read_table(spark, sf, "nation"))


def _enriched(spark: SparkSession, sf: str) -> DataFrame:
    return silver.enriched(bronze.orders(_feed(spark, sf)), _places(spark, sf))


def bronze_orders(spark, sf):
    return bronze.orders(_feed(spark, sf)).select("event_id", "event_type", "event_timestamp", "ts_seconds", "location_id", "order_id", "sequence")


def bronze_places(spark, sf):
    return _places(spark, sf)


def bronze_brands(spark, sf):
    return bronze.brands(read_table(spark, sf, "part"))


def bronze_items(spark, sf):
    return bronze.items(read_table(spark, sf, "part"))


def bronze_categories(spark, sf):
    return bronze.categories(read_table(spark, sf, "part"))


def silver_product_orders(spark, sf):
    return silver.product_orders(product_orders(read_table(spark, sf, "events")))


def silver_enriched(spark, sf):
    return _enriched(spark, sf).drop("body", "ts")


def silver_enriched_sql(spark, sf):
    upstream = {"bronze_orders": bronze.orders(_feed(spark, sf)), "bronze_locations": _places(spark, sf)}
    return sql_dataset(spark, silver.ENRICHED_SQL)(upstream.__getitem__)


def silver_quantities(spark, sf):
    return silver.enriched_with_items(bronze.orders(_feed(spark, sf)), _places(spark, sf))


def created_orders(spark, sf):
    return silver.created_orders(_feed(spark, sf))


def daily_revenue(spark, sf):
    return gold.daily_revenue(silver.paid_orders(silver.created_orders(_feed(spark, sf))))


def order_lifecycle(spark, sf):
    return silver.order_lifecycle(_enriched(spark, sf))


def order_lifecycle_whole(spark, sf):
    return silver.order_lifecycle_whole(_enriched(spark, sf))


def gold_brand_ranking(spark, sf):
    return gold.brand_ranking(silver_quantities(spark, sf))


def gold_hourly(spark, sf):
    return gold.hourly_metrics(_enriched(spark, sf))


def gold_hourly_sql(spark, sf):
    return sql_dataset(spark, gold.HOURLY_SQL)({"silver_orders_sql": silver_enriched_sql(spark, sf)}.__getitem__)


def gold_brand_sql(spark, sf):
    return sql_dataset(spark, gold.BRANDS_SQL)({"silver_orders_sql": silver_enriched_sql(spark, sf)}.__getitem__)


def gold_delivery(spark, sf):
    means = {c: F.round(c, 6) for c in ("avg_kitchen_time_min", "avg_delivery_time_min", "avg_total_time_min")}
    return gold.delivery_performance(silver.order_lifecycle(_enriched(spark, sf))).withColumns(means)


def gold_brand(spark, sf):
    return gold.brand_summary(_enriched(spark, sf), bronze.brands(read_table(spark, sf, "part")))


def gold_customer(spark, sf):
    return gold.customer_summary(silver.product_orders(product_orders(read_table(spark, sf, "events"))))


def order_summary(spark, sf):
    """Raw JSON rows -> orders by path -> one summary row."""
    raw = read_table(spark, sf, "events").select(
        "event_type", F.to_json(F.struct(F.col("event_id").alias("order_id"), F.col("value").alias("amount"))).alias("payload")
    )
    orders = raw.where(F.col("event_type") == "purchase").select(
        F.get_json_object("payload", "$.order_id").alias("order_id"), F.get_json_object("payload", "$.amount").cast("double").alias("amount")
    )
    return gold.order_summary(orders)


def daily_sales(spark, sf):
    return commerce.daily_sales(*(read_table(spark, sf, t) for t in ("orders", "customer", "nation", "region")))


def customer_ltv(spark, sf):
    return commerce.customer_ltv(read_table(spark, sf, "orders"), read_table(spark, sf, "customer"))


def product_performance(spark, sf):
    return commerce.product_performance(read_table(spark, sf, "lineitem"), read_table(spark, sf, "part"))


def graph_run(spark, sf):
    """The whole medallion graph, materialised below the shared folder: rows per dataset."""
    return medallion(spark, sf).run(run_dir(spark, "medallion")).select("dataset", "layer", "kind", "status", "n_rows")


def gold_from_tables(spark, sf):
    """Revenue per brand from the graph's materialised tables, not from one spanning plan."""
    graph, root = medallion(spark, sf), run_dir(spark, "medallion")
    graph.run(root, only=("bronze_orders", "bronze_locations", "bronze_brands", "silver_orders", "gold_brands"))
    return graph.table(root, "gold_brands")


QUERIES = {
    f.__name__: f
    for f in (
        bronze_orders,
        bronze_places,
        bronze_brands,
        bronze_items,
        bronze_categories,
        silver_product_orders,
        silver_enriched,
        silver_enriched_sql,
        silver_quantities,
        created_orders,
        daily_revenue,
        order_lifecycle,
        order_lifecycle_whole,
        gold_brand_ranking,
        gold_hourly,
        gold_hourly_sql,
        gold_brand_sql,
        gold_delivery,
        gold_brand,
        gold_customer,
        order_summary,
        daily_sales,
        customer_ltv,
        product_performance,
        graph_run,
        gold_from_tables,
    )
}

_REVENUE = cents("order_total")
_CENTS = "CAST(round(order_total * 100) AS BIGINT)"
_AVG = f"CAST((2 * sum({_CENTS}) + count(order_total)) // (2 * count(order_total)) AS DOUBLE) / 100"
_BRAND = f"""WITH {ORDER_FEED},
    m AS (SELECT brand_id, count(order_id) AS total_orders, {_REVENUE} AS total_revenue,
          {_REVENUE} / count(order_total) AS avg_order_value, count(DISTINCT location_id) AS locations_served,
          min(event_date) AS first_order_date, max(event_date) AS last_order_date
          FROM enriched WHERE event_type = 'order_created' GROUP BY 1),
    b AS (SELECT DISTINCT CAST(regexp_extract(p_brand, '[0-9]+$') AS INTEGER) AS id, p_brand AS brand_name FROM part)
    SELECT m.*, brand_name FROM m LEFT JOIN b ON brand_id = id"""

ORACLE = {
    "bronze_orders": f"""WITH {ORDER_FEED} SELECT event_id, event_type, event_timestamp,
        CAST(floor(epoch(event_timestamp)) AS BIGINT) AS ts_seconds, location_id, order_id, sequence FROM feed""",
    "bronze_places": "SELECT n_nationkey AS id, n_name AS city FROM nation",
    "bronze_brands": "SELECT DISTINCT CAST(regexp_extract(p_brand, '[0-9]+$') AS INTEGER) AS id, p_brand AS name FROM part",
    "bronze_items": """SELECT p_partkey AS id, p_brand AS brand, p_name AS name, p_retailprice AS price, p_type AS category
        FROM part""",
    "bronze_categories": "SELECT DISTINCT p_type AS name FROM part",
    "silver_product_orders": f"""WITH {PRODUCT_ORDERS} SELECT order_id, customer_id, product_id, product_name, quantity, unit_price,
        total, order_timestamp, order_date, order_hour FROM product_silver""",
    "silver_enriched": f"""WITH {ORDER_FEED} SELECT event_id, event_type, event_timestamp,
        CAST(floor(epoch(event_timestamp)) AS BIGINT) AS ts_seconds, order_id, location_id, sequence, brand_id, order_total,
        latitude, longitude, driver_id, event_hour, event_day_of_week, is_weekend, event_date, city_name FROM enriched""",
    "silver_enriched_sql": f"""WITH {ORDER_FEED} SELECT event_id, event_type, event_timestamp, order_id, location_id, brand_id,
        brand_name, order_total, num_items, event_hour, event_date, city_name FROM parsed""",
    "silver_quantities": f"""WITH {ORDER_FEED} SELECT event_id, event_type, event_timestamp,
        CAST(floor(epoch(event_timestamp)) AS BIGINT) AS ts_seconds, order_id, location_id, sequence, brand_id, brand_name,
        order_total, latitude, longitude, num_items, total_quantity, event_hour, event_day_of_week AS event_dow, is_weekend,
        event_date, city_name FROM enriched""",
    "created_orders": f"""WITH {ORDER_FEED} SELECT order_id, event_timestamp AS order_ts, location_id, brand_name AS brand,
        order_total, num_items AS item_count FROM parsed WHERE event_type = 'order_created'""",
    "daily_revenue": f"""WITH {ORDER_FEED} SELECT event_date AS order_date, count(*) AS order_count,
        round({_REVENUE}, 2) AS revenue FROM parsed WHERE event_type = 'order_created' AND order_total > 0 GROUP BY 1""",
    "order_lifecycle": f"WITH {LIFECYCLE} SELECT * FROM lifecycle",
    "order_lifecycle_whole": f"""WITH {LIFECYCLE}, w AS (
        SELECT order_id, min(created_at) AS created_at, min(kitchen_started_at) AS kitchen_started_at,
        min(kitchen_finished_at) AS kitchen_finished_at, min(order_ready_at) AS order_ready_at,
        min(driver_arrived_at) AS driver_arrived_at, min(pickup_at) AS pickup_at, min(delivered_at) AS delivered_at
        FROM staged GROUP BY 1 HAVING min(delivered_at) IS NOT NULL)
        SELECT *, (floor(epoch(kitchen_finished_at)) - floor(epoch(kitchen_started_at))) / 60 AS kitchen_duration_min,
        (floor(epoch(delivered_at)) - floor(epoch(pickup_at))) / 60 AS delivery_duration_min,
        (floor(epoch(delivered_at)) - floor(epoch(created_at))) / 60 AS total_duration_min FROM w""",
    "gold_brand_ranking": f"""WITH {ORDER_FEED} SELECT brand_id, brand_name, count(order_id) AS total_orders,
        round({_REVENUE}, 2) AS total_revenue, {_AVG} AS avg_order_value, count(DISTINCT location_id) AS locations_served,
        min(event_date) AS first_order_date, max(event_date) AS last_order_date
        FROM enriched WHERE event_type = 'order_created' GROUP BY 1, 2
        ORDER BY total_revenue DESC NULLS LAST, brand_id NULLS FIRST, brand_name NULLS FIRST""",
    "gold_hourly": f"""WITH {ORDER_FEED} SELECT event_date, event_hour, location_id, city_name, count(order_id) AS order_count,
        {_REVENUE} AS total_revenue, {_REVENUE} / count(order_total) AS avg_order_value,
        count(DISTINCT brand_id) AS unique_brands FROM enriched WHERE event_type = 'order_created' GROUP BY 1, 2, 3, 4""",
    "gold_hourly_sql": f"""WITH {ORDER_FEED} SELECT event_date, event_hour, city_name, count(*) AS order_count,
        {_REVENUE} AS total_revenue, {_AVG} AS avg_order_value FROM parsed WHERE event_type = 'order_created' GROUP BY 1, 2, 3""",
    "gold_brand_sql": f"""WITH {ORDER_FEED} SELECT brand_name, count(*) AS total_orders, {_REVENUE} AS total_revenue,
        {_AVG} AS avg_order_value, count(DISTINCT location_id) AS locations_served
        FROM parsed WHERE event_type = 'order_created' GROUP BY 1 ORDER BY total_revenue DESC NULLS LAST, brand_name NULLS FIRST""",
    "gold_delivery": f"""WITH {LIFECYCLE} SELECT CAST(created_at AS DATE) AS order_date, location_id, city_name,
        count(order_id) AS completed_orders, round(avg(kitchen_duration_min), 6) AS avg_kitchen_time_min,
        round(avg(delivery_duration_min), 6) AS avg_delivery_time_min, round(avg(total_duration_min), 6) AS avg_total_time_min,
        quantile_disc(total_duration_min, 0.5) AS median_total_time_min,
        quantile_disc(total_duration_min, 0.95) AS p95_total_time_min FROM lifecycle GROUP BY 1, 2, 3""",
    "gold_brand": _BRAND,
    "gold_customer": f"""WITH {PRODUCT_ORDERS} SELECT customer_id, count(*) AS total_orders, {cents("total")} AS total_revenue,
        {cents("total")} / count(total) AS avg_order_value, min(order_timestamp) AS first_order,
        max(order_timestamp) AS last_order, count(DISTINCT product_id) AS unique_products FROM product_silver GROUP BY 1""",
    "order_summary": f"""SELECT count(*) AS total_orders, {cents("value")} AS total_revenue,
        {cents("value")} / count(value) AS avg_order_value FROM events WHERE event_type = 'purchase'""",
    "daily_sales": f"""SELECT CAST(o_orderdate AS DATE) AS sales_date, r_name AS region, count(*) AS order_count,
        {cents("o_totalprice")} AS total_sales FROM orders LEFT JOIN customer ON o_custkey = c_custkey
        LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2""",
    "customer_ltv": f"""SELECT c_custkey AS customer_id, c_name AS customer_name, count(o_orderkey) AS order_count,
        coalesce({cents("o_totalprice")}, 0) AS lifetime_value, {cents("o_totalprice")} / nullif(count(o_orderkey), 0) AS avg_order_value,
        CAST(min(o_orderdate) AS DATE) AS first_order, CAST(max(o_orderdate) AS DATE) AS last_order
        FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1, 2""",
    "product_performance": """SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS period_start, p_brand AS brand,
        CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS quantity,
        CAST(sum(CAST(round(l_extendedprice * (1 - l_discount) * 10000) AS BIGINT)) AS DOUBLE) / 10000 AS revenue,
        count(DISTINCT l_partkey) AS products FROM lineitem LEFT JOIN part ON l_partkey = p_partkey GROUP BY 1, 2""",
    "graph_run": f"""WITH {LIFECYCLE}, n AS (
        SELECT 'bronze_orders' AS dataset, 'bronze' AS layer, 'view' AS kind, (SELECT count(*) FROM events) AS n_rows
        UNION ALL SELECT 'bronze_locations', 'bronze', 'view', (SELECT count(*) FROM nation)
        UNION ALL SELECT 'bronze_brands', 'bronze', 'view', (SELECT count(DISTINCT p_brand) FROM part)
        UNION ALL SELECT 'events_clean', 'silver', 'stream', (SELECT count(*) FROM events)
        UNION ALL SELECT 'silver_orders', 'silver', 'view', (SELECT count(*) FROM enriched)
        UNION ALL SELECT 'silver_orders_sql', 'silver', 'view', (SELECT count(*) FROM parsed)
        UNION ALL SELECT 'silver_lifecycle', 'silver', 'view', (SELECT count(*) FROM lifecycle)
        UNION ALL SELECT 'gold_hourly', 'gold', 'view', (SELECT count(*) FROM
            (SELECT DISTINCT event_date, event_hour, location_id FROM enriched WHERE event_type = 'order_created'))
        UNION ALL SELECT 'gold_delivery', 'gold', 'view', (SELECT count(*) FROM
            (SELECT DISTINCT CAST(created_at AS DATE), location_id FROM lifecycle))
        UNION ALL SELECT 'gold_brands', 'gold', 'view', (SELECT count(*) FROM
            (SELECT DISTINCT brand_id FROM enriched WHERE event_type = 'order_created'))
        UNION ALL SELECT 'gold_hourly_sql', 'gold', 'view', (SELECT count(*) FROM
            (SELECT DISTINCT event_date, event_hour, city_name FROM parsed WHERE event_type = 'order_created'))
        UNION ALL SELECT 'gold_brands_sql', 'gold', 'view', (SELECT count(*) FROM
            (SELECT DISTINCT brand_name FROM parsed WHERE event_type = 'order_created'))
        UNION ALL SELECT 'events_by_type', 'gold', 'view', (SELECT count(DISTINCT event_type) FROM events))
        SELECT dataset, layer, kind, 'completed' AS status, n_rows FROM n""",
    "gold_from_tables": _BRAND,
}
