"""Data-quality jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelayer.operators import quality
from tidelayer.operators.grouped import keep_first
from tidelayer.plans import gold, registry, silver
from tidelayer.sources import read_table
from tidelayer.sources.feed import order_feed, product_orders
from tidelayer.suite.common import ORDER_FEED, PRODUCT_ORDERS, cents

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels",
    "conversations",
)


def _events(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "events")


def redelivered(events: DataFrame) -> DataFrame:
    """Events with copies as a feed has them: purchases come again unchanged, errors a few seconds later."""
    again = events.where(F.col("event_type") == "purchase")
    shifted = events.where(F.col("event_type") == "error").withColumn(
        "ts", F.col("ts") + F.make_dt_interval(secs=(F.col("event_id") % 10 + 1).cast("decimal(8,6)"))
    )
    return events.unionByName(again).unionByName(shifted)


def qc_layers(spark, sf):
    """Rows and totals of the product-order layers."""
    raw = product_orders(_events(spark, sf))
    clean = silver.product_orders(raw)
    return quality.layer_totals(raw, clean, gold.customer_summary(clean), "total", "total_revenue", "total_orders")


def qc_stats(spark, sf):
    return quality.feed_stats(order_feed(_events(spark, sf)), "order_id", "event_type", "location_id", "ts")


def qc_presence(spark, sf):
    return quality.presence({name: read_table(spark, sf, name) for name in TABLES})


def qc_nulls(spark, sf):
    return quality.null_report(order_feed(_events(spark, sf)), ["event_id", "order_id", "location_id", "ts", "body"])


def qc_malformed(spark, sf):
    return quality.malformed_report(order_feed(_events(spark, sf)), "event_type", "body")


def qc_duplicates(spark, sf):
    """Event ids that came more than once, and how far their times are apart."""
    return quality.repeated_keys(redelivered(_events(spark, sf)), "event_id", "ts")


def qc_exactly_once(spark, sf):
    """Rows against distinct ids, of the table and of a feed with copies."""
    events = _events(spark, sf)
    table = quality.duplicate_report(events, "event_id").withColumn("input", F.lit("table"))
    feed = quality.duplicate_report(redelivered(events), "event_id").withColumn("input", F.lit("feed"))
    return table.unionByName(feed).select("input", "n_rows", "n_distinct", "exactly_once")


def dedup_keep_first(spark, sf):
    """One row per event id, the earliest; copies are reduced before they are shuffled."""
    return keep_first(redelivered(_events(spark, sf)), ["event_id"], ["ts"])


def qc_out_of_order(spark, sf):
    """Arrivals older than what came before; event time here runs behind arrival by up to six minutes."""
    arrived = _events(spark, sf).withColumn("ts", F.col("ts") - F.make_dt_interval(mins=(F.col("event_id") % 7).cast("int")))
    return quality.late_arrivals(arrived, "event_id", "ts", "event_type")


def qc_order_total(spark, sf):
    """Order totals against the sum of their lines."""
    lines = read_table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_extendedprice")
    return quality.amounts_that_differ(read_table(spark, sf, "orders"), lines, "o_orderkey", "o_totalprice", "l_extendedprice")


def qc_freshness(spark, sf):
    """Newest row per registered table against its target, as of the newest event."""
    events = _events(spark, sf)
    of_type = {kind: F.max(F.when(F.col("event_type") == kind, F.col("ts"))).alias(kind) for kind in ("click", "purchase")}
    per_event_table = F.array(
        *(
            F.struct(F.lit(layer).alias("layer"), F.lit(table).alias("table_name"), F.col(column).alias("newest_ts"))
            for layer, table, column in (("bronze", "raw_orders", "all"), ("bronze", "raw_clicks", "click"), ("gold", "daily_sales", "purchase"))
        )
    )
    found = events.agg(F.max("ts").alias("all"), *of_type.values()).select(F.inline(per_event_table))
    for layer, table, df, column in (
        ("silver", "orders", read_table(spark, sf, "orders"), "o_orderdate"),
        ("silver", "order_items", read_table(spark, sf, "lineitem"), "l_shipdate"),
    ):
        found = found.unionByName(df.agg(F.max(column).alias("newest_ts")).select(F.lit(layer).alias("layer"), F.lit(table).alias("table_name"), "newest_ts"))
    now = events.agg(F.max("ts")).scalar()
    return quality.freshness(found, registry.tables(spark), now).withColumn("age_hours", F.round("age_hours", 6))


def lineage_two_hop(spark, sf):
    """Bronze to gold over one silver table, with the rows the tables on the way have."""
    events, orders, lines = _events(spark, sf), read_table(spark, sf, "orders"), read_table(spark, sf, "lineitem")

    def rows(df: DataFrame, name: str) -> DataFrame:
        return df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n")

    sizes = rows(events, "raw_orders").unionByName(rows(orders, "orders")).unionByName(rows(lines, "order_items"))
    hops = registry.two_hops(spark)
    source = sizes.select(F.col("name").alias("bronze_table"), F.col("n").alias("bronze_rows"))
    middle = sizes.select(F.col("name").alias("silver_table"), F.col("n").alias("silver_rows"))
    sized = hops.join(source, "bronze_table", "left").join(middle, "silver_table", "left")
    return sized.select("bronze_table", "silver_table", "gold_table", "path", "bronze_rows", "silver_rows")


QUERIES = {
    f.__name__: f
    for f in (
        qc_layers,
        qc_stats,
        qc_presence,
        qc_nulls,
        qc_malformed,
        qc_duplicates,
        qc_exactly_once,
        dedup_keep_first,
        qc_out_of_order,
        qc_order_total,
        qc_freshness,
        lineage_two_hop,
    )
}

_REDELIVERED = """redelivered AS (SELECT * FROM events
    UNION ALL SELECT * FROM events WHERE event_type = 'purchase'
    UNION ALL SELECT event_id, ts + to_seconds(event_id % 10 + 1), user_id, event_type, value, props FROM events WHERE event_type = 'error')"""

ORACLE = {
    "qc_layers": f"""WITH {PRODUCT_ORDERS},
        b AS (SELECT count(*) AS n, {cents("total")} AS t FROM product_feed),
        s AS (SELECT count(*) AS n, {cents("total")} AS t FROM product_silver)
        SELECT b.n AS bronze_rows, s.n AS silver_rows, s.n AS gold_rows, b.t AS bronze_total, s.t AS silver_total,
        s.t AS gold_total, b.n = s.n AS rows_agree, abs(b.t - s.t) < 0.01 AS totals_agree FROM b, s""",
    "qc_stats": f"""WITH {ORDER_FEED}
        SELECT 'rows' AS metric, NULL AS item, count(*) AS n FROM feed
        UNION ALL SELECT 'unique_ids', NULL, count(*) FROM (SELECT DISTINCT order_id FROM feed)
        UNION ALL SELECT 'type', event_type, count(*) FROM feed GROUP BY 2
        UNION ALL SELECT 'place', CAST(location_id AS VARCHAR), count(*) FROM feed WHERE location_id IS NOT NULL GROUP BY 2
        UNION ALL SELECT 'first_ts', strftime(min(event_timestamp), '%Y-%m-%dT%H:%M:%S.%f'), NULL FROM feed
        UNION ALL SELECT 'last_ts', strftime(max(event_timestamp), '%Y-%m-%dT%H:%M:%S.%f'), NULL FROM feed""",
    "qc_presence": " UNION ALL ".join(
        f"SELECT '{t}' AS input, count(*) > 0 AS present FROM {t}" for t in TABLES
    ),
    "qc_nulls": f"""WITH {ORDER_FEED}, c AS (SELECT count(*) AS n, count(*) FILTER (order_id IS NULL) AS o,
        count(*) FILTER (location_id IS NULL) AS l FROM feed)
        SELECT 'event_id' AS field, n AS n_rows, 0 AS n_nulls, 0.0::DOUBLE AS null_rate FROM c
        UNION ALL SELECT 'order_id', n, o, o / n FROM c UNION ALL SELECT 'location_id', n, l, l / n FROM c
        UNION ALL SELECT 'ts', n, 0, 0.0 FROM c UNION ALL SELECT 'body', n, 0, 0.0 FROM c""",
    "qc_malformed": f"""WITH {ORDER_FEED} SELECT event_type, count(*) AS n_rows, count(*) FILTER (damaged) AS n_malformed,
        count(*) FILTER (damaged) / count(*) AS malformed_rate FROM feed GROUP BY 1""",
    "qc_duplicates": f"""WITH {_REDELIVERED} SELECT event_id, count(*) AS copies,
        CAST(max(floor(epoch(ts))) - min(floor(epoch(ts))) AS BIGINT) AS span_seconds FROM redelivered
        GROUP BY 1 HAVING count(*) > 1""",
    "qc_exactly_once": f"""WITH {_REDELIVERED}
        SELECT 'table' AS input, count(*) AS n_rows, count(DISTINCT event_id) AS n_distinct,
        count(*) = count(DISTINCT event_id) AS exactly_once FROM events
        UNION ALL SELECT 'feed', count(*), count(DISTINCT event_id), count(*) = count(DISTINCT event_id) FROM redelivered""",
    "dedup_keep_first": "SELECT event_id, ts, user_id, event_type, value, props FROM events",
    "qc_out_of_order": """WITH a AS (SELECT event_id, event_type, ts - to_minutes(event_id % 7) AS ts FROM events),
        w AS (SELECT *, max(ts) OVER (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS newest FROM a)
        SELECT event_type, count(*) AS n_rows, count(*) FILTER (ts < newest) AS n_late,
        max(CASE WHEN ts < newest THEN epoch_us(newest) - epoch_us(ts) END) / 1000000 AS max_lag_seconds FROM w GROUP BY 1""",
    "qc_order_total": """WITH l AS (SELECT l_orderkey, sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS c, count(*) AS n
        FROM lineitem GROUP BY 1)
        SELECT o_orderkey, CAST(CAST(round(o_totalprice * 100) AS BIGINT) AS DOUBLE) / 100 AS total,
        CAST(coalesce(c, 0) AS DOUBLE) / 100 AS parts_total, coalesce(n, 0) AS parts,
        CAST(round(o_totalprice * 100) AS BIGINT) = coalesce(c, 0) AS consistent FROM orders LEFT JOIN l ON o_orderkey = l_orderkey""",
    "qc_freshness": """WITH f AS (
        SELECT 'bronze' AS layer, 'raw_orders' AS table_name, max(ts) AS newest_ts, CAST(1 AS INTEGER) AS sla_hours FROM events
        UNION ALL SELECT 'bronze', 'raw_clicks', max(ts), 1 FROM events WHERE event_type = 'click'
        UNION ALL SELECT 'silver', 'orders', max(o_orderdate), 2 FROM orders
        UNION ALL SELECT 'silver', 'order_items', max(l_shipdate), 2 FROM lineitem
        UNION ALL SELECT 'gold', 'daily_sales', max(ts), 4 FROM events WHERE event_type = 'purchase'),
        a AS (SELECT *, (floor(epoch((SELECT max(ts) FROM events))) - floor(epoch(newest_ts))) / 3600 AS age FROM f)
        SELECT layer, table_name, newest_ts, sla_hours, round(age, 6) AS age_hours, age <= sla_hours AS is_fresh FROM a
        UNION ALL SELECT * FROM (VALUES ('bronze', 'raw_inventory', NULL, 24, NULL, FALSE), ('silver', 'customers', NULL, 24, NULL, FALSE),
            ('silver', 'products', NULL, 24, NULL, FALSE), ('gold', 'customer_lifetime_value', NULL, 24, NULL, FALSE),
            ('gold', 'product_performance', NULL, 24, NULL, FALSE))""",
    "lineage_two_hop": """WITH n AS (SELECT (SELECT count(*) FROM events) AS e, (SELECT count(*) FROM orders) AS o,
        (SELECT count(*) FROM lineitem) AS l)
        SELECT 'raw_orders' AS bronze_table, 'orders' AS silver_table, 'daily_sales' AS gold_table,
        'etl > aggregation' AS path, e AS bronze_rows, o AS silver_rows FROM n
        UNION ALL SELECT 'raw_orders', 'orders', 'customer_lifetime_value', 'etl > aggregation', e, o FROM n
        UNION ALL SELECT 'raw_orders', 'order_items', 'product_performance', 'etl > aggregation', e, l FROM n""",
}
