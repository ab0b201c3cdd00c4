"""Streaming queries: each runs a stream over what is available and returns the sink's table.

The tables arrive as files in no particular order, so stateful queries replay them in event order, in several micro-batches
between which the watermark moves; `stream_late_drop` delivers some rows too late on purpose.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelayer import sources
from tidelayer.operators.guard import BLOCK_RULES, BLOCK_SCHEMA, guard, route
from tidelayer.plans import gold
from tidelayer.plans.medallion import clean_events
from tidelayer.session import run_dir
from tidelayer.sources.feed import block_feed, envelope, product_orders
from tidelayer.sources.messages import envelope_stream, unpack
from tidelayer.streaming import jobs, sinks
from tidelayer.suite.checks import redelivered
from tidelayer.suite.common import BLOCKS
from tidelayer.suite.guards import PAYLOAD, stamped

PRODUCT_SCHEMA = (
    "event_id STRING, event_type STRING, timestamp STRING, order_id STRING, customer_id STRING, product_id STRING, "
    "product_name STRING, quantity INT, unit_price DOUBLE, total DOUBLE"
)


def _messages(df: DataFrame) -> DataFrame:
    """Events as product-order messages."""
    rows = product_orders(df).withColumn("user", F.substring("customer_id", 6, 20))
    return envelope(rows, "order_id", "orders", "user", "event_id", "timestamp")


def _to_files(spark: SparkSession, stream: DataFrame, name: str, **options) -> DataFrame:
    base = run_dir(spark, name)
    sinks.append_files(stream, f"{base}/out", f"{base}/checkpoint", **options)
    return spark.read.parquet(f"{base}/out")


def _replayed(spark: SparkSession, df: DataFrame, order: list[str]) -> DataFrame:
    """Rows as a stream in a stated order, a quarter of the files at once."""
    files = jobs.files_for(df)
    path = jobs.replay_files(df, run_dir(spark, "replay"), order, files)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", max(1, files // 4)).parquet(path)


def stream_envelope(spark, sf):
    """Message files in three or four micro-batches: rows per message partition and its offsets."""
    path = run_dir(spark, "messages")
    messages = _messages(sources.read_table(spark, sf, "events"))
    files = jobs.files_for(messages)
    messages.repartition(files).write.parquet(path)
    received = _to_files(spark, envelope_stream(spark, path, max_files=max(1, files // 3)), "received")
    return received.groupBy("partition").agg(
        F.count(F.lit(1)).alias("n_messages"), F.min("offset").alias("first_offset"), F.max("offset").alias("last_offset")
    )


def stream_parse(spark, sf):
    """Messages to flat rows, time parsed, as they arrive."""
    flat = unpack(_messages(sources.stream_table(spark, sf, "events")), PRODUCT_SCHEMA, F.col("offset").alias("message_offset"))
    parsed = flat.withColumn("event_timestamp", F.to_timestamp("timestamp")).drop("timestamp", "event_id")
    return _to_files(spark, parsed, "parsed")


def stream_stateless(spark, sf):
    stream = sources.stream_table(spark, sf, "events")
    doubled = stream.withColumn("doubled", F.col("value") * 2).where(F.col("value") > 50).select("event_id", "ts", "value", "doubled")
    return _to_files(spark, doubled, "stateless")


def stream_table(spark, sf):
    """A table as a stream, its clean rows appended."""
    return _to_files(spark, clean_events(sources.stream_table(spark, sf, "events")), "rows")


def stream_incremental(spark, sf):
    """Files land in two deliveries; each run takes the new ones only. The run is kept per row."""
    base = run_dir(spark, "incremental")
    events = sources.read_table(spark, sf, "events").select("event_id", "event_type", "value")
    for run, delivery in enumerate((F.col("event_type").isin("view", "click"), ~F.col("event_type").isin("view", "click")), start=1):
        events.where(delivery).write.mode("append").parquet(f"{base}/landing")
        arriving = spark.readStream.schema(events.schema).parquet(f"{base}/landing").withColumn("run", F.lit(run))
        sinks.append_files(arriving, f"{base}/out", f"{base}/checkpoint")
    return spark.read.parquet(f"{base}/out")


def stream_to_parquet(spark, sf):
    """Orders appended to Parquet by status folders."""
    orders = sources.stream_table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus")
    return _to_files(spark, orders, "by-status", partition_by=["o_orderstatus"])


def stream_to_table(spark, sf):
    base = run_dir(spark, "table")
    table = "stream_customers_" + base.rsplit("-", 1)[1]
    rich = sources.stream_table(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    sinks.append_table(rich, table, f"{base}/out", f"{base}/checkpoint")
    return spark.table(table)


def stream_route(spark, sf):
    """Guardrails on a stream of blocks; one folder per topic."""
    messages = envelope(block_feed(sources.stream_table(spark, sf, "orders")), "block_hash", "blocks", "block_number", "block_number", "timestamp")
    blocks = unpack(messages, BLOCK_SCHEMA)
    routed = route(stamped(guard(blocks, BLOCK_RULES, ["extra_data"])), "block_hash", "validated", PAYLOAD)
    sent = _to_files(spark, routed, "routed", partition_by=["topic"])
    return sent.select("key", "topic", F.get_json_object("value", "$.decision").alias("decision"))


def stream_tumbling(spark, sf):
    """Events per five minutes and type, replayed in the order of time in about four micro-batches of one query."""
    events = sources.read_table(spark, sf, "events").select("event_id", "ts", "event_type")
    arriving = _replayed(spark, events, ["ts", "event_id"])
    base = run_dir(spark, "tumbling")
    counts = jobs.tumbling_counts(arriving, "ts", "5 minutes", "event_type", delay="10 minutes")
    sinks.upsert_files(counts, f"{base}/out", f"{base}/checkpoint")
    return sinks.latest_state(spark, f"{base}/out", ["window_start", "window_end", "event_type"])


def window_batch(spark, sf):
    """The same windows over the table at once."""
    return jobs.tumbling_counts(sources.read_table(spark, sf, "events"), "ts", "5 minutes", "event_type")


def stream_then_rollup(spark, sf):
    """Clean events taken in as a stream, counted per type by a view that is recomputed."""
    return gold.events_by_type(stream_table(spark, sf))


def stream_dedup(spark, sf):
    """A feed with copies, replayed in the order of time in about four micro-batches of one query; one row per event id kept."""
    feed = redelivered(sources.read_table(spark, sf, "events").select("event_id", "ts", "user_id", "event_type", "value"))
    once = jobs.dedup_within(_replayed(spark, feed, ["ts", "event_id"]), ["event_id"], "ts", "10 minutes")
    return _to_files(spark, once.select("event_id", "user_id", "event_type", "value"), "dedup")


def stream_replay(spark, sf):
    """Events from a day after the first one on, replayed from time-ordered files in about four micro-batches."""
    events = jobs.from_day(sources.read_table(spark, sf, "events").select("event_id", "ts", "event_type"), "ts", 1)
    return _to_files(spark, _replayed(spark, events, ["ts", "event_id"]), "replayed")


def stream_late_drop(spark, sf):
    """Windows over three deliveries: one event of ten comes a day late, in the last one; what its window's watermark has passed is gone."""
    base = run_dir(spark, "late")
    events = sources.read_table(spark, sf, "events").select("event_id", "ts", "event_type")
    late, half = F.col("event_id") % 10 == 0, F.col("event_id") % 2 == 0
    for delivery in (~late & half, ~late & ~half, late):
        events.where(delivery).write.mode("append").parquet(f"{base}/landing")
        arriving = spark.readStream.schema(events.schema).parquet(f"{base}/landing")
        counts = jobs.tumbling_counts(arriving, "ts", "5 minutes", "event_type", delay="1 day")
        sinks.upsert_files(counts, f"{base}/out", f"{base}/checkpoint")
    return sinks.latest_state(spark, f"{base}/out", ["window_start", "window_end", "event_type"])


def stream_ticks(spark, sf):
    """Customers to files, a micro-batch per tick of a clock."""
    base = run_dir(spark, "ticks")
    stream = sources.stream_table(spark, sf, "customer").select("c_custkey", "c_name")
    sinks.append_ticking(stream, f"{base}/out", f"{base}/checkpoint")
    return spark.read.parquet(f"{base}/out")


QUERIES = {
    f.__name__: f
    for f in (
        stream_envelope,
        stream_parse,
        stream_stateless,
        stream_table,
        stream_incremental,
        stream_to_parquet,
        stream_to_table,
        stream_route,
        stream_tumbling,
        window_batch,
        stream_then_rollup,
        stream_dedup,
        stream_replay,
        stream_late_drop,
        stream_ticks,
    )
}

_WINDOWS = """SELECT time_bucket(INTERVAL 5 MINUTE, ts) AS window_start, time_bucket(INTERVAL 5 MINUTE, ts) + INTERVAL 5 MINUTE AS window_end,
    event_type, count(*) AS event_count FROM events GROUP BY 1, 2, 3"""

ORACLE = {
    "stream_envelope": """SELECT CAST(user_id % 8 AS INTEGER) AS partition, count(*) AS n_messages,
        min(event_id) AS first_offset, max(event_id) AS last_offset FROM events GROUP BY 1""",
    "stream_parse": """SELECT event_id AS message_offset, event_type,
        CASE WHEN event_id % 97 <> 0 THEN 'ORD-' || CAST(event_id AS VARCHAR) END AS order_id,
        'CUST-' || CAST(user_id AS VARCHAR) AS customer_id, 'PROD-' || json_extract_string(props, '$.k') AS product_id,
        'Product ' || json_extract_string(props, '$.k') AS product_name,
        CAST(json_extract(props, '$.k') AS INTEGER) % 3 + 1 AS quantity, value AS unit_price,
        round(value * (CAST(json_extract(props, '$.k') AS INTEGER) % 3 + 1), 2) AS total,
        date_trunc('second', ts) AS event_timestamp FROM events""",
    "stream_stateless": "SELECT event_id, ts, value, value * 2 AS doubled FROM events WHERE value > 50",
    "stream_table": "SELECT event_id, event_type, user_id, ts AS event_time FROM events WHERE event_type IS NOT NULL",
    "stream_incremental": """SELECT event_id, event_type, value,
        CAST(CASE WHEN event_type IN ('view', 'click') THEN 1 ELSE 2 END AS INTEGER) AS run FROM events""",
    "stream_to_parquet": "SELECT o_orderkey, o_custkey, o_totalprice, o_orderstatus FROM orders",
    "stream_to_table": "SELECT c_custkey, c_nationkey, c_acctbal FROM customer",
    "stream_route": f"""WITH {BLOCKS} SELECT block_hash AS key,
        CASE decision WHEN 'QUARANTINE' THEN 'validated-quarantine' ELSE 'validated-allowed' END AS topic, decision FROM decided""",
    "stream_tumbling": _WINDOWS,
    "window_batch": _WINDOWS,
    "stream_then_rollup": "SELECT event_type, count(*) AS event_count FROM events WHERE event_type IS NOT NULL GROUP BY 1",
    "stream_dedup": "SELECT event_id, user_id, event_type, value FROM events",
    "stream_late_drop": """WITH w AS (SELECT epoch_ms(max(ts)) - 86400000 AS mark FROM events WHERE event_id % 10 <> 0),
        e AS (SELECT time_bucket(INTERVAL 5 MINUTE, ts) AS window_start, time_bucket(INTERVAL 5 MINUTE, ts) + INTERVAL 5 MINUTE AS window_end,
              event_id, event_type FROM events)
        SELECT window_start, window_end, event_type, count(*) AS event_count FROM e, w
        WHERE event_id % 10 <> 0 AND (event_id % 2 = 0 OR epoch_ms(window_end) > (SELECT epoch_ms(max(ts)) - 86400000 FROM events WHERE event_id % 10 <> 0 AND event_id % 2 = 0))
           OR event_id % 10 = 0 AND epoch_ms(window_end) > mark
        GROUP BY 1, 2, 3""",
    "stream_ticks": "SELECT c_custkey, c_name FROM customer",
    "stream_replay": """SELECT event_id, ts, event_type FROM events
        WHERE ts >= (SELECT date_trunc('second', min(ts)) + INTERVAL 1 DAY FROM events)""",
}
