"""Layers compared by content, layouts that spare shuffles and scans, summaries that add up, views kept up to date."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelayer.functions import money, shapes, summaries
from tidelayer.operators.numbering import numbered
from tidelayer.operators.reach import closure
from tidelayer.operators.reconcile import reconcile
from tidelayer.plans import registry, silver
from tidelayer.plans.incremental import DailyView
from tidelayer.plans.medallion import medallion
from tidelayer.session import run_dir
from tidelayer.sources import read_table
from tidelayer.sources.bucketed import buckets_for, write_bucketed
from tidelayer.sources.feed import order_feed, product_orders
from tidelayer.sources.formats import write_any, write_by_time
from tidelayer.streaming import jobs, sinks
from tidelayer.streaming.progress import ProgressTable
from tidelayer.suite.common import ORDER_FEED, PRODUCT_ORDERS, cents


def drifted(orders: DataFrame) -> DataFrame:
    """A layer as it may come out of a faulty reload: opposite errors in amounts that leave the total, rows lost and doubled."""
    n = F.substring("order_id", 5, 20).cast("bigint")
    wrong = F.when(n % 500 == 0, 1.0).when(n % 500 == 1, -1.0).otherwise(0.0)
    rows = orders.withColumn("total", F.round(F.col("total") + wrong, 2)).where(n % 997 != 2)
    return rows.unionByName(rows.where(n % 991 == 3))


def qc_reconcile(spark, sf):
    """Rows in which a layer and its faulty reload differ."""
    orders = silver.product_orders(product_orders(read_table(spark, sf, "events")))
    columns = ["order_id", "customer_id", "product_id", "quantity", "total"]
    return reconcile(orders, drifted(orders), ["order_id"], columns)


def bucketed_sales(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Orders and their lines as tables of one layout by order."""
    base = run_dir(spark, "bucketed")
    suffix = base.rsplit("-", 1)[1]
    orders = read_table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    lines = read_table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_extendedprice", "l_quantity")
    buckets = buckets_for(orders, lines)
    return tuple(write_bucketed(df, f"{name}_{suffix}", "o_orderkey", buckets, f"{base}/{name}") for name, df in (("placed", orders), ("lines", lines)))


def sales_per_order(orders: DataFrame, lines: DataFrame) -> DataFrame:
    per_order = lines.groupBy("o_orderkey").agg(
        money.total("l_extendedprice").alias("revenue"), F.sum(F.col("l_quantity").cast("bigint")).alias("quantity"), F.count(F.lit(1)).alias("n_lines")
    )
    return orders.join(per_order, "o_orderkey", "left")


def join_co_located(spark, sf):
    """Orders with the sums of their lines, from tables that lie by order: neither grouped nor joined rows are shuffled."""
    return sales_per_order(*bucketed_sales(spark, sf))


def by_day_and_calendar(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Events in folders by day, and the calendar of their days as a table."""
    events = read_table(spark, sf, "events").select("event_id", "ts", "event_type", "value")
    by_day = spark.read.parquet(write_by_time(events, run_dir(spark, "by-day"), "ts", "day"))
    days = by_day.select(F.col("ts_day").alias("day")).distinct().withColumn("day_kind", F.when(F.dayofweek("day").isin(1, 7), "weekend").otherwise("weekday"))
    return by_day, spark.read.parquet(write_any(days, "parquet", run_dir(spark, "calendar")))


def of_day_kind(by_day: DataFrame, calendar: DataFrame, kind: str) -> DataFrame:
    """Events of the days that the calendar calls so: which folders those are is known only while the query runs."""
    wanted = calendar.where(F.col("day_kind") == kind).select(F.col("day").alias("ts_day"))
    return by_day.join(wanted, "ts_day").groupBy("event_type").agg(F.count(F.lit(1)).alias("n_rows"), money.total("value").alias("total_value"))


def pruned_at_run_time(spark, sf):
    return of_day_kind(*by_day_and_calendar(spark, sf), "weekend")


def daily_sketches(spark: SparkSession, sf: str) -> DataFrame:
    """Prices per shipping day and return flag, kept as sketches."""
    lines = read_table(spark, sf, "lineitem").where("l_extendedprice IS NOT NULL")
    daily = summaries.quantile_sketches(lines, [F.to_date("l_shipdate").alias("day"), "l_returnflag"], "l_extendedprice")
    return spark.read.parquet(write_any(daily, "parquet", run_dir(spark, "sketches")))


def merged_percentiles(spark: SparkSession, sf: str) -> DataFrame:
    """Median and 95th percentile per month and return flag from the sketches of its days."""
    month = F.date_format("day", "yyyy-MM").alias("month")
    merged = summaries.merged_sketches(daily_sketches(spark, sf), [month, "l_returnflag"])
    return merged.select("month", "l_returnflag", summaries.quantile("sketch", 0.5).alias("p50"), summaries.quantile("sketch", 0.95).alias("p95"))


def percentiles_merged(spark, sf):
    """How far the merged percentiles are off: the share of rows at or below each has to be within half a percent, or one row."""
    merged = merged_percentiles(spark, sf)
    lines = read_table(spark, sf, "lineitem").where("l_extendedprice IS NOT NULL")
    lines = lines.select(F.date_format("l_shipdate", "yyyy-MM").alias("month"), "l_returnflag", F.col("l_extendedprice").alias("v"))
    ranks = [F.count_if(F.col("v") < F.col(p)).alias(f"below_{p}") for p in ("p50", "p95")] + [F.count_if(F.col("v") <= F.col(p)).alias(f"upto_{p}") for p in ("p50", "p95")]
    counted = lines.join(merged, ["month", "l_returnflag"]).groupBy("month", "l_returnflag").agg(F.count(F.lit(1)).alias("n_rows"), *ranks)

    def holds(p: str, share: float):
        slack = F.greatest(F.lit(1.0), F.col("n_rows") * 0.005)
        return (F.col(f"below_{p}") <= F.col("n_rows") * share + slack) & (F.col(f"upto_{p}") >= F.col("n_rows") * share - slack)

    return counted.select("month", "l_returnflag", "n_rows", holds("p50", 0.5).alias("median_holds"), holds("p95", 0.95).alias("p95_holds"))


def distinct_by_bitmaps(spark, sf):
    """Users per day and type, and per type over all days, from one table of daily bitmaps."""
    events = read_table(spark, sf, "events").withColumn("event_date", F.to_date("ts"))
    daily = summaries.id_bitmaps(events, ["event_date", "event_type"], "user_id")
    kept = spark.read.schema(daily.schema).parquet(write_any(daily, "parquet", run_dir(spark, "bitmaps")))
    per_day = summaries.distinct_of(kept, ["event_date", "event_type"], "n_users")
    per_type = summaries.distinct_of(kept, ["event_type"], "n_users").withColumn("event_date", F.lit(None).cast("date"))
    return per_day.unionByName(per_type)


def daily_view(spark: SparkSession, path: str) -> DailyView:
    """Rows, exact value, first and last time per day and type."""

    def partial(rows: DataFrame) -> DataFrame:
        values = [F.count(F.lit(1)).alias("n_rows"), money.total_exact("value").alias("value"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")]
        return rows.groupBy(F.to_date("ts").alias("event_date"), "event_type").agg(*values)

    merge = {"n_rows": F.sum, "value": lambda c: F.sum(c).cast(money.EXACT), "first_ts": F.min, "last_ts": F.max}
    return DailyView(spark, path, "event_date", ["event_date", "event_type"], partial, merge)


def gold_incremental(spark, sf):
    """Three deliveries, the second of which comes twice: later events first, some of each day late."""
    events = read_table(spark, sf, "events").select("event_id", "ts", "event_type", "value")
    late, early = F.col("event_id") % 10 == 0, F.dayofmonth("ts") <= 15
    view = daily_view(spark, run_dir(spark, "daily-view"))
    for number, rows in ((1, ~late & ~early), (2, ~late & early), (2, ~late & early), (3, late)):
        view.take(events.where(rows), number)
    return view.read().withColumn("value", F.col("value").cast("double"))


def lineage_closure(spark, sf):
    """What each table reaches over any number of hops, in the registry and the medallion graph, with the rows it passes on."""
    graph = medallion(spark, sf).dry_run().select(F.explode("reads").alias("source"), F.col("dataset").alias("target"))
    known = registry.edges(spark).select(F.col("source_table").alias("source"), F.col("target_table").alias("target"))

    def rows(table: str, *names: str) -> DataFrame:
        counted = read_table(spark, sf, table).agg(F.count(F.lit(1)).alias("source_rows"))
        return counted.select(F.explode(F.array(*map(F.lit, names))).alias("source"), "source_rows")

    sizes = rows("events", "raw_orders", "bronze_orders", "events_clean").unionByName(rows("orders", "orders"))
    sizes = sizes.unionByName(rows("lineitem", "order_items")).unionByName(rows("nation", "bronze_locations"))
    return closure(known.unionByName(graph)).join(sizes, "source", "left").select("source", "target", "depth", "source_rows")


def numbered_orders(spark, sf):
    """Every order with its place in the order of dates."""
    orders = read_table(spark, sf, "orders").select("o_orderdate", "o_orderkey", "o_totalprice")
    return numbered(orders, ["o_orderdate", "o_orderkey"])


def stream_progress(spark, sf):
    """A replay with a progress table: rows and purchases of its micro-batches, added up, and how it ended."""
    events = read_table(spark, sf, "events").select("event_id", "ts", "event_type")
    files = jobs.files_for(events)
    path = jobs.replay_files(events, run_dir(spark, "replay"), ["ts", "event_id"], files)
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", max(1, files // 4)).parquet(path)
    purchases = F.count_if(F.col("event_type") == "purchase").alias("purchases")
    base = run_dir(spark, "watched")
    with ProgressTable(spark, f"{base}/progress") as log:
        query = sinks.append_files(stream.observe("batch", F.count(F.lit(1)).alias("n"), purchases), f"{base}/out", f"{base}/checkpoint")
        log.wait_for(query)
    batches = F.col("event") == "progress"
    return log.read().where(F.col("run_id") == str(query.runId)).agg(
        F.sum("input_rows").alias("input_rows"),
        F.sum(F.element_at("metrics", "batch.n").cast("bigint")).alias("n_rows"),
        F.sum(F.element_at("metrics", "batch.purchases").cast("bigint")).alias("n_purchases"),
        (F.count_if(batches & (F.col("input_rows") > 0)) >= 3).alias("several_batches"),
        (F.count_if(~batches & F.col("error").isNull()) == 1).alias("ended_well"),
    )


def json_shapes(spark, sf):
    """Fields of the payloads per event type, and the kind of value each has."""
    found = shapes.field_shapes(order_feed(read_table(spark, sf, "events")), "event_type", "body")
    return found.select("kind", "field", "n_rows", F.regexp_replace("type", "[(<].*", "").alias("type"))


QUERIES = {
    f.__name__: f
    for f in (
        qc_reconcile,
        join_co_located,
        pruned_at_run_time,
        percentiles_merged,
        distinct_by_bitmaps,
        gold_incremental,
        lineage_closure,
        numbered_orders,
        stream_progress,
        json_shapes,
    )
}

ORACLE = {
    "qc_reconcile": f"""WITH {PRODUCT_ORDERS},
        a AS (SELECT CAST(substr(order_id, 5) AS BIGINT) AS n, order_id, customer_id, product_id, quantity, total FROM product_silver),
        moved AS (SELECT n, order_id, customer_id, product_id, quantity,
            round(total + CASE n % 500 WHEN 0 THEN 1.0 WHEN 1 THEN -1.0 ELSE 0.0 END, 2) AS total FROM a WHERE n % 997 <> 2),
        sides AS (SELECT *, 1 AS l, 0 AS r FROM a UNION ALL SELECT *, 0, 1 FROM moved UNION ALL SELECT *, 0, 1 FROM moved WHERE n % 991 = 3)
        SELECT order_id, customer_id, product_id, quantity, total, CAST(sum(l) AS BIGINT) AS left_rows, CAST(sum(r) AS BIGINT) AS right_rows
        FROM sides GROUP BY 1, 2, 3, 4, 5 HAVING sum(l) <> sum(r)""",
    "join_co_located": f"""SELECT o_orderkey, o_custkey, o_orderstatus, {cents("l_extendedprice")} AS revenue,
        CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS quantity, nullif(count(l_orderkey), 0) AS n_lines
        FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2, 3""",
    "pruned_at_run_time": f"""SELECT event_type, count(*) AS n_rows, {cents("value")} AS total_value FROM events
        WHERE dayofweek(ts) IN (0, 6) GROUP BY 1""",
    "percentiles_merged": """SELECT strftime(l_shipdate, '%Y-%m') AS month, l_returnflag, count(*) AS n_rows, TRUE AS median_holds, TRUE AS p95_holds
        FROM lineitem WHERE l_extendedprice IS NOT NULL GROUP BY 1, 2""",
    "distinct_by_bitmaps": """SELECT CAST(ts AS DATE) AS event_date, event_type, count(DISTINCT user_id) AS n_users FROM events GROUP BY 1, 2
        UNION ALL SELECT NULL, event_type, count(DISTINCT user_id) FROM events GROUP BY 2""",
    "gold_incremental": f"""SELECT CAST(ts AS DATE) AS event_date, event_type, count(*) AS n_rows, {cents("value")} AS value,
        min(ts) AS first_ts, max(ts) AS last_ts FROM events GROUP BY 1, 2""",
    "lineage_closure": """WITH RECURSIVE edges(source, target) AS (VALUES
        ('raw_orders', 'orders'), ('raw_orders', 'order_items'), ('orders', 'daily_sales'), ('orders', 'customer_lifetime_value'), ('order_items', 'product_performance'),
        ('bronze_orders', 'silver_orders'), ('bronze_locations', 'silver_orders'), ('bronze_orders', 'silver_orders_sql'), ('bronze_locations', 'silver_orders_sql'),
        ('silver_orders', 'silver_lifecycle'), ('silver_orders', 'gold_hourly'), ('silver_lifecycle', 'gold_delivery'), ('silver_orders', 'gold_brands'),
        ('bronze_brands', 'gold_brands'), ('silver_orders_sql', 'gold_hourly_sql'), ('silver_orders_sql', 'gold_brands_sql'), ('events_clean', 'events_by_type')),
        reach AS (SELECT source, target, 1 AS depth FROM edges
            UNION SELECT r.source, e.target, r.depth + 1 FROM reach r JOIN edges e ON e.source = r.target WHERE r.depth < 20),
        sizes AS (SELECT unnest(['raw_orders', 'bronze_orders', 'events_clean']) AS source, (SELECT count(*) FROM events) AS source_rows
            UNION ALL SELECT 'orders', count(*) FROM orders UNION ALL SELECT 'order_items', count(*) FROM lineitem
            UNION ALL SELECT 'bronze_locations', count(*) FROM nation)
        SELECT source, target, min(depth) AS depth, source_rows FROM reach LEFT JOIN sizes USING (source) GROUP BY ALL""",
    "numbered_orders": """SELECT o_orderdate, o_orderkey, o_totalprice, CAST(row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS BIGINT) AS row_number
        FROM orders""",
    "stream_progress": """SELECT CAST(count(*) AS BIGINT) AS input_rows, CAST(count(*) AS BIGINT) AS n_rows,
        CAST(count(*) FILTER (event_type = 'purchase') AS BIGINT) AS n_purchases, TRUE AS several_batches, TRUE AS ended_well FROM events""",
    "json_shapes": f"""WITH {ORDER_FEED}, sound AS (SELECT * FROM feed WHERE NOT damaged)
        SELECT event_type AS kind, field, count(*) AS n_rows, type FROM sound JOIN (VALUES
            ('order_created', 'customer_lat', 'DECIMAL'), ('order_created', 'customer_lon', 'DECIMAL'), ('order_created', 'brand_id', 'BIGINT'),
            ('order_created', 'brand_name', 'STRING'), ('order_created', 'items', 'ARRAY'), ('order_created', 'total', 'DECIMAL'),
            ('kitchen_started', 'kitchen_id', 'STRING'), ('kitchen_finished', 'kitchen_id', 'STRING'), ('order_ready', 'kitchen_id', 'STRING'),
            ('driver_arrived', 'driver_id', 'STRING'), ('driver_picked_up', 'driver_id', 'STRING'), ('delivered', 'driver_id', 'STRING'),
            ('driver_ping', 'progress_pct', 'DECIMAL')) AS t(kind, field, type) ON kind = event_type
        WHERE field <> 'total' OR event_no % 37 <> 0 GROUP BY 1, 2, 4""",
}
