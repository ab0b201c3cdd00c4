"""Scans and file formats. Round trips write the table below the shared folder and read it back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelayer.functions import money
from tidelayer.session import run_dir
from tidelayer.sources import catalog, formats, read_declared, read_table
from tidelayer.sources.feed import envelope, product_orders
from tidelayer.sources.messages import unpack
from tidelayer.streaming.sinks import append_files


def scan_parquet(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice", F.to_date("o_orderdate").alias("o_date"))


def scan_declared(spark: SparkSession, sf: str) -> DataFrame:
    return read_declared(spark, sf, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")


def scan_json(spark: SparkSession, sf: str) -> DataFrame:
    events = read_table(spark, sf, "events").select("event_id", "user_id", "event_type", "value", "props")
    return formats.read_json(spark, formats.write_any(events, "json", run_dir(spark, "json")))


def scan_json_multiline(spark: SparkSession, sf: str) -> DataFrame:
    """A JSON document over several lines per region: an array of its nations."""
    one = F.struct("n_nationkey", "n_name")
    documents = read_table(spark, sf, "nation").groupBy("n_regionkey").agg(F.to_json(F.collect_list(one), {"pretty": "true"}).alias("value"))
    path = formats.write_any(documents, "text", run_dir(spark, "json-documents"), partition_by=["n_regionkey"])
    return formats.read_json(spark, path, "n_nationkey INT, n_name STRING, n_regionkey INT", multiline=True)


def scan_csv(spark: SparkSession, sf: str) -> DataFrame:
    customers = read_table(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal")
    back = formats.read_csv(spark, formats.write_any(customers, "csv", run_dir(spark, "csv"), header="true"))
    return back.withColumn("c_custkey", F.col("c_custkey").cast("bigint"))


def scan_csv_schema(spark: SparkSession, sf: str) -> DataFrame:
    parts = read_table(spark, sf, "part").select("p_partkey", "p_name", "p_retailprice")
    path = formats.write_any(parts, "csv", run_dir(spark, "tsv"), header="true", sep="\t")
    return formats.read_csv(spark, path, "p_partkey BIGINT, p_name STRING, p_retailprice DOUBLE", delimiter="\t")


def scan_orc(spark: SparkSession, sf: str) -> DataFrame:
    lines = read_table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag")
    return formats.read_orc(spark, formats.write_any(lines, "orc", run_dir(spark, "orc"), compression="zlib"))


def scan_text(spark: SparkSession, sf: str) -> DataFrame:
    """Lines per event type: one text line per event."""
    lines = read_table(spark, sf, "events").select(F.concat_ws(" ", "event_type", F.col("event_id").cast("string")).alias("value"))
    back = formats.read_text(spark, formats.write_any(lines, "text", run_dir(spark, "text")))
    return back.groupBy(F.substring_index("value", " ", 1).alias("event_type")).agg(
        F.count(F.lit(1)).alias("n_lines"), F.sum(F.length("value")).alias("n_chars")
    )


def scan_generic(spark: SparkSession, sf: str) -> DataFrame:
    """One format after the other through format().load(): each holds the suppliers."""
    suppliers = read_table(spark, sf, "supplier").select("s_suppkey", "s_nationkey", "s_acctbal")
    schema = "s_suppkey BIGINT, s_nationkey INT, s_acctbal DOUBLE"
    found = None
    for fmt in ("parquet", "json", "csv", "orc"):
        path = formats.write_any(suppliers, fmt, run_dir(spark, fmt))
        rows = formats.read_any(spark, fmt, path, schema).agg(
            F.lit(fmt).alias("format"), F.count(F.lit(1)).alias("n_rows"), money.total("s_acctbal").alias("balance")
        )
        found = rows if found is None else found.unionByName(rows)
    return found


def scan_range(spark: SparkSession, sf: str) -> DataFrame:
    """Generated slots next to the order keys that fall into them; a slot may stay empty."""
    slots = spark.range(101).withColumnRenamed("id", "slot")
    orders = read_table(spark, sf, "orders").groupBy((F.col("o_orderkey") % 97).alias("slot"))
    used = orders.agg(F.count(F.lit(1)).alias("n_used"), F.max("o_orderkey").alias("last_key"))
    return slots.join(used, "slot", "left").select("slot", F.coalesce("n_used", F.lit(0)).cast("bigint").alias("n_used"), "last_key")


def envelope_parse(spark: SparkSession, sf: str) -> DataFrame:
    """Product orders as message records, unpacked again."""
    rows = product_orders(read_table(spark, sf, "events"))
    sent = rows.withColumn("user", F.substring("customer_id", 6, 20))
    messages = envelope(sent, "order_id", "orders", "user", "event_id", "timestamp")
    schema = "order_id STRING, customer_id STRING, product_id STRING, quantity INT, total DOUBLE"
    return unpack(
        messages.where(F.col("topic") == "orders"),
        schema,
        F.col("key").cast("string").alias("message_key"),
        F.col("partition").alias("message_partition"),
        F.col("offset").alias("message_offset"),
        F.col("timestamp").alias("message_time"),
    )


def sink_partitioned(spark: SparkSession, sf: str) -> DataFrame:
    """Events by type folders; read back with the partition column."""
    events = read_table(spark, sf, "events").select("event_id", "event_type", "value")
    path = formats.write_any(events, "parquet", run_dir(spark, "by-type"), partition_by=["event_type"], compression="zstd")
    return spark.read.parquet(path).groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n_rows"), money.total("value").alias("total_value")
    )


def sink_time_partitioned(spark: SparkSession, sf: str) -> DataFrame:
    """Events by day folders, read back with the day as a column."""
    events = read_table(spark, sf, "events").select("event_id", "ts", "value")
    back = spark.read.parquet(formats.write_by_time(events, run_dir(spark, "by-day"), "ts", "day"))
    return back.groupBy(F.col("ts_day").alias("event_date"), F.hour("ts").alias("event_hour")).agg(
        F.count(F.lit(1)).alias("n_rows"), money.total("value").alias("total_value")
    )


def sink_month_partitioned(spark: SparkSession, sf: str) -> DataFrame:
    """Line items by month folders; the counts per folder."""
    lines = read_table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate")
    back = spark.read.parquet(formats.write_by_time(lines, run_dir(spark, "by-month"), "l_shipdate", "month"))
    return back.groupBy(F.col("l_shipdate_month").cast("string").alias("month")).agg(F.count(F.lit(1)).alias("n_rows"))


def ctas_customer_summary(spark: SparkSession, sf: str) -> DataFrame:
    """CREATE TABLE .. AS SELECT at a path below the shared folder, then a read of the table."""
    path = run_dir(spark, "ctas")
    table = "customer_summary_" + path.rsplit("-", 1)[1]
    query = """
        SELECT user_id AS customer_id, count(*) AS total_orders,
               CAST(sum(CAST(value AS DECIMAL(38, 6))) AS DOUBLE) AS total_revenue,
               min(ts) AS first_order, max(ts) AS last_order
        FROM {events} GROUP BY user_id
    """
    catalog.create_as(spark, table, query, path, events=read_table(spark, sf, "events"))
    return spark.table(table)


def qc_direct_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of a table read by name against rows of its files read by path."""
    path = run_dir(spark, "direct")
    table = "orders_" + path.rsplit("-", 1)[1]
    catalog.replace_table(read_table(spark, sf, "orders"), table, path=path)
    by_name = spark.table(table).agg(F.count(F.lit(1)).alias("table_rows"))
    by_path = spark.read.parquet(path).agg(F.count(F.lit(1)).alias("file_rows"))
    return by_name.select("table_rows", by_path.scalar().alias("file_rows")).withColumn(
        "agree", F.col("table_rows") == F.col("file_rows")
    )


def seed_events(spark: SparkSession, sf: str) -> DataFrame:
    """Noise left out, four columns, written once and read as the seed of streams."""
    seed = read_table(spark, sf, "events").where("event_type != 'error'").select(
        "event_id", "event_type", "user_id", F.col("ts").alias("event_time")
    )
    return spark.read.parquet(formats.write_any(seed, "parquet", run_dir(spark, "seed")))


def stream_file(spark: SparkSession, sf: str) -> DataFrame:
    """JSON files as a stream with a declared schema, to Parquet."""
    base = run_dir(spark, "json-stream")
    customers = read_table(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment")
    formats.write_any(customers, "json", f"{base}/in")
    stream = spark.readStream.schema("c_custkey BIGINT, c_name STRING, c_mktsegment STRING").json(f"{base}/in")
    append_files(stream, f"{base}/out", f"{base}/checkpoint")
    return spark.read.parquet(f"{base}/out")


QUERIES = {
    f.__name__: f
    for f in (
        scan_parquet,
        scan_declared,
        scan_json,
        scan_json_multiline,
        scan_csv,
        scan_csv_schema,
        scan_orc,
        scan_text,
        scan_generic,
        scan_range,
        envelope_parse,
        sink_partitioned,
        sink_time_partitioned,
        sink_month_partitioned,
        ctas_customer_summary,
        qc_direct_scan,
        seed_events,
        stream_file,
    )
}

_SUPPLIERS = "count(*) AS n_rows, CAST(sum(CAST(round(s_acctbal * 100) AS BIGINT)) AS DOUBLE) / 100 AS balance FROM supplier"

ORACLE = {
    "scan_parquet": "SELECT o_orderkey, o_custkey, o_totalprice, CAST(o_orderdate AS DATE) AS o_date FROM orders",
    "scan_declared": "SELECT c_custkey, c_mktsegment, c_acctbal FROM customer",
    "scan_json": "SELECT event_id, event_type, props, user_id, value FROM events",
    "scan_json_multiline": "SELECT n_nationkey, n_name, n_regionkey FROM nation",
    "scan_csv": "SELECT c_custkey, c_name, c_acctbal FROM customer",
    "scan_csv_schema": "SELECT p_partkey, p_name, p_retailprice FROM part",
    "scan_orc": "SELECT l_orderkey, l_linenumber, l_quantity, l_returnflag FROM lineitem",
    "scan_text": """SELECT event_type, count(*) AS n_lines,
        CAST(sum(length(event_type || ' ' || CAST(event_id AS VARCHAR))) AS BIGINT) AS n_chars FROM events GROUP BY 1""",
    "scan_generic": " UNION ALL ".join(f"SELECT '{fmt}' AS format, {_SUPPLIERS}" for fmt in ("parquet", "json", "csv", "orc")),
    "scan_range": """SELECT slot, count(o_orderkey) AS n_used, max(o_orderkey) AS last_key
        FROM (SELECT unnest(range(101)) AS slot) LEFT JOIN orders ON o_orderkey % 97 = slot GROUP BY 1""",
    "envelope_parse": """SELECT CASE WHEN event_id % 97 <> 0 THEN 'ORD-' || CAST(event_id AS VARCHAR) END AS message_key,
        CAST(user_id % 8 AS INTEGER) AS message_partition, event_id AS message_offset,
        date_trunc('second', ts) AS message_time,
        CASE WHEN event_id % 97 <> 0 THEN 'ORD-' || CAST(event_id AS VARCHAR) END AS order_id,
        'CUST-' || CAST(user_id AS VARCHAR) AS customer_id,
        'PROD-' || json_extract_string(props, '$.k') AS product_id,
        CAST(json_extract(props, '$.k') AS INTEGER) % 3 + 1 AS quantity,
        round(value * (CAST(json_extract(props, '$.k') AS INTEGER) % 3 + 1), 2) AS total FROM events""",
    "sink_partitioned": """SELECT event_type, count(*) AS n_rows,
        CAST(sum(CAST(round(value * 100) AS BIGINT)) AS DOUBLE) / 100 AS total_value
        FROM events GROUP BY 1""",
    "sink_time_partitioned": """SELECT CAST(ts AS DATE) AS event_date, CAST(hour(ts) AS INTEGER) AS event_hour, count(*) AS n_rows,
        CAST(sum(CAST(round(value * 100) AS BIGINT)) AS DOUBLE) / 100 AS total_value
        FROM events GROUP BY 1, 2""",
    "sink_month_partitioned": "SELECT strftime(l_shipdate, '%Y-%m') AS month, count(*) AS n_rows FROM lineitem GROUP BY 1",
    "ctas_customer_summary": """SELECT user_id AS customer_id, count(*) AS total_orders,
        CAST(sum(CAST(round(value * 100) AS BIGINT)) AS DOUBLE) / 100 AS total_revenue,
        min(ts) AS first_order, max(ts) AS last_order FROM events GROUP BY 1""",
    "qc_direct_scan": "SELECT count(*) AS table_rows, count(*) AS file_rows, TRUE AS agree FROM orders",
    "seed_events": "SELECT event_id, event_type, user_id, ts AS event_time FROM events WHERE event_type <> 'error'",
    "stream_file": "SELECT c_custkey, c_name, c_mktsegment FROM customer",
}
