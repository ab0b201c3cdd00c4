"""Projections, filters, joins, aggregates, sorts and scalar functions over the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelayer.functions import geo, money, payload
from tidelayer.functions.sensitive import found
from tidelayer.functions.times import event_time_lenient, is_weekend, minutes_between
from tidelayer.operators import joins
from tidelayer.operators.grouped import count_where, earliest_per_stage, frequency
from tidelayer.operators.joins import join_dimension
from tidelayer.operators.topk import first_rows, latest
from tidelayer.plans import commerce, gold
from tidelayer.sources import read_table
from tidelayer.sources.feed import order_feed
from tidelayer.streaming.jobs import from_day
from tidelayer.suite.common import SALES, cents

K = "CAST(json_extract(props, '$.k') AS INTEGER)"


def _events(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "events")


# -- projection and filter ------------------------------------------------------------------------
def project_nested(spark, sf):
    """Struct from JSON, field path and star expansion."""
    data = F.struct(F.from_json("props", "k INT").alias("p"), F.col("value"), F.col("event_type").alias("kind"))
    return _events(spark, sf).select("event_id", data.alias("d")).select("event_id", F.col("d.p.k").alias("k"), "d.value", "d.kind")


def project_rename(spark, sf):
    return (
        read_table(spark, sf, "customer")
        .withColumnsRenamed({"c_custkey": "id", "c_name": "name", "c_acctbal": "balance"})
        .withColumns({"in_debt": F.col("balance") < 0, "segment": F.lower("c_mktsegment")})
        .drop("c_mktsegment", "c_nationkey")
    )


def filter_not_null(spark, sf):
    feed = order_feed(_events(spark, sf))
    keep = F.col("event_id").isNotNull() & F.col("order_id").isNotNull() & F.col("location_id").isNotNull()
    return feed.where(keep).select("event_id", "order_id", "location_id")


def filter_eq(spark, sf):
    return _events(spark, sf).where((F.col("event_type") == "purchase") & (F.col("user_id") != 0)).select("event_id", "user_id", "value")


def filter_range(spark, sf):
    return (
        read_table(spark, sf, "lineitem")
        .where("l_discount >= 0.05 AND l_discount <= 0.07 AND l_quantity < 24 AND l_extendedprice > 0")
        .select("l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_extendedprice")
    )


def filter_in(spark, sf):
    return (
        read_table(spark, sf, "orders")
        .where(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH") & F.col("o_orderstatus").isin("O", "P"))
        .select("o_orderkey", "o_orderpriority", "o_orderstatus")
    )


def filter_regex(spark, sf):
    """Documents with an e-mail address or a card number anywhere in the text."""
    email, card = found(F.col("text"), "PII_EMAIL"), found(F.col("text"), "PII_CREDIT_CARD")
    return read_table(spark, sf, "documents").where(email | card).select("doc_id", "source", email.alias("has_email"), card.alias("has_card"))


def filter_start_day(spark, sf):
    """Events from two days after the first one on."""
    return from_day(_events(spark, sf), "ts", 2).select("event_id", "ts", "event_type")


# -- joins ----------------------------------------------------------------------------------------
def join_broadcast_left(spark, sf):
    """Orders of the feed with the city of their place; unknown and missing places have none."""
    cities = read_table(spark, sf, "nation").select(F.col("n_nationkey").alias("location_id"), F.col("n_name").alias("city_name"))
    feed = order_feed(_events(spark, sf)).select("event_id", "location_id")
    return join_dimension(feed, cities, "location_id").select("event_id", "location_id", "city_name")


def join_left_on(spark, sf):
    """Spend per user with the customer's segment: summed before the join, key names differ."""
    spend = _events(spark, sf).groupBy("user_id").agg(F.count(F.lit(1)).alias("n_events"), money.total("value").alias("spend"))
    customers = read_table(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    return joins.join_left_on(spend, customers, spend.user_id == customers.c_custkey).select(
        "user_id", "n_events", "spend", F.col("c_mktsegment").alias("segment")
    )


def join_left(spark, sf):
    """Every order with its customer's name and segment; customers may be many and one may hold most orders."""
    orders = read_table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    customers = read_table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name", "c_mktsegment")
    return join_dimension(orders, customers, "o_custkey").select("o_orderkey", "o_custkey", "o_totalprice", "c_name", "c_mktsegment")


def join_spread(spark, sf):
    """The same join as if customers were too many to send to every task: hot customers are dealt over slots by their count."""
    orders = read_table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    customers = read_table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name", "c_mktsegment")
    spread = join_dimension(orders, customers, "o_custkey", max_bytes=0)
    return spread.select("o_orderkey", "o_custkey", "o_totalprice", "c_name", "c_mktsegment")


def net_price_by_status(spark, sf):
    """Sums of amounts with four decimals."""
    lines = commerce.with_net(read_table(spark, sf, "lineitem"))
    return lines.groupBy("l_returnflag", "l_linestatus").agg(commerce.net_price().cast("double").alias("net_price"))


def join_items_chain(spark, sf):
    return commerce.item_chain(read_table(spark, sf, "lineitem"), read_table(spark, sf, "part"), read_table(spark, sf, "supplier"))


# -- aggregates -----------------------------------------------------------------------------------
def agg_basic(spark, sf):
    return (
        read_table(spark, sf, "lineitem")
        .groupBy("l_returnflag", "l_linestatus")
        .agg(
            F.count(F.lit(1)).alias("n_lines"),
            F.count("l_shipdate").alias("n_shipped"),
            F.sum(F.col("l_quantity").cast("bigint")).alias("sum_qty"),
            money.total("l_extendedprice").alias("sum_price"),
            money.mean("l_extendedprice").alias("avg_price"),
            F.min("l_shipdate").alias("first_ship"),
            F.max("l_extendedprice").alias("max_price"),
        )
    )


def agg_distinct(spark, sf):
    """Distinct users and orders per type, next to the rows."""
    feed = order_feed(_events(spark, sf))
    return feed.groupBy("event_type").agg(F.count(F.lit(1)).alias("n_events"), F.countDistinct("order_id").alias("n_orders"))


def agg_percentile(spark, sf):
    return _events(spark, sf).groupBy("event_type").agg(
        F.percentile_approx("value", 0.5).alias("p50"), F.percentile_approx("value", 0.95).alias("p95"), F.count("value").alias("n")
    )


def agg_rounded(spark, sf):
    return _events(spark, sf).groupBy("user_id").agg(
        F.round(money.total("value"), 2).alias("total_value"), money.mean_rounded("value").alias("avg_value")
    )


def agg_global(spark, sf):
    return _events(spark, sf).agg(
        F.count(F.lit(1)).alias("n_events"),
        F.countDistinct("user_id").alias("n_users"),
        money.total("value").alias("total_value"),
        F.min("ts").alias("first_ts"),
        F.max("ts").alias("last_ts"),
    )


def agg_pivot(spark, sf):
    """Orders per priority with one column per status."""
    return read_table(spark, sf, "orders").groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).agg(F.count(F.lit(1)))


def agg_by_date(spark, sf):
    return _events(spark, sf).groupBy(F.to_date("ts").alias("event_date")).agg(
        F.count(F.lit(1)).alias("n_events"), money.total("value").alias("total_value")
    )


def agg_filtered(spark, sf):
    return gold.revenue_of_type(_events(spark, sf), "purchase")


def agg_frequency(spark, sf):
    """Rows per place; rows without a place are not counted."""
    return frequency(order_feed(_events(spark, sf)), "location_id", "n_events")


def revenue_by_region(spark, sf):
    return commerce.revenue_by_region(*(read_table(spark, sf, t) for t in ("lineitem", "orders", "customer", "nation", "region")))


# -- sort and top-k -------------------------------------------------------------------------------
def sort_desc(spark, sf):
    per_brand = read_table(spark, sf, "part").groupBy("p_brand").agg(
        F.count(F.lit(1)).alias("n_parts"), money.total("p_retailprice").alias("list_value")
    )
    return per_brand.orderBy(F.desc("list_value"), "p_brand")


def top_customers(spark, sf):
    return commerce.top_customers(read_table(spark, sf, "lineitem"), read_table(spark, sf, "orders"))


def latest_events(spark, sf):
    return latest(_events(spark, sf).select("event_id", "ts", "event_type"), "ts", "event_id")


def sort_multi(spark, sf):
    return order_feed(_events(spark, sf)).select("ts_seconds", "sequence", "event_id").orderBy("ts_seconds", "sequence", "event_id")


def limit_rows(spark, sf):
    """Preview: the first hundred orders by key."""
    return first_rows(read_table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice"), "o_orderkey")


# -- scalar functions -----------------------------------------------------------------------------
def fn_string(spark, sf):
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    return _events(spark, sf).select(
        "event_id",
        F.regexp_replace(iso, "T", " ").alias("ts_text"),
        F.concat(F.lit("CUST-"), F.col("user_id").cast("string")).alias("customer_id"),
        F.col("event_type").rlike("^(view|click)$").alias("is_browse"),
        F.length("props").alias("props_chars"),
    )


def fn_datetime(spark, sf):
    at = event_time_lenient(F.col("ts_text"))
    return (
        _events(spark, sf)
        .withColumn("ts_text", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))
        .withColumn("at", at)
        .select(
            "event_id",
            "at",
            F.to_date("at").alias("day"),
            F.hour("at").alias("hour"),
            F.dayofweek("at").alias("dow"),
            is_weekend("at").alias("is_weekend"),
            F.unix_timestamp("at").alias("epoch_s"),
            event_time_lenient(F.concat(F.lit("x"), F.col("ts_text"))).isNull().alias("junk_is_null"),
        )
    )


def fn_math(spark, sf):
    price, discount = F.col("l_extendedprice"), F.col("l_discount")
    return read_table(spark, sf, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        F.round(price * (1 - discount) * (1 + F.col("l_tax")), 6).alias("charge"),
        (F.col("l_orderkey") % 7).alias("slot"),
        (F.col("l_quantity") / 60).alias("minutes"),
    )


def fn_distance(spark, sf):
    """Way of an order on the map: places derived from the key, position after a share of the way."""
    k = F.get_json_object("props", "$.k").cast("int")
    lat, lon = F.lit(40.0) + k / F.lit(100.0), F.lit(-70.0) - k / F.lit(100.0)
    to_lat, to_lon = F.lit(40.0) + F.col("user_id") / F.lit(1000.0), F.lit(-70.0) - F.col("user_id") / F.lit(1000.0)
    share = F.col("event_id") % 100 / F.lit(100.0)
    return _events(spark, sf).select(
        "event_id",
        F.round(geo.planar_km(lat, lon, to_lat, to_lon), 6).alias("km"),
        F.round(geo.between(lat, to_lat, share), 6).alias("at_lat"),
        F.round(geo.between(lon, to_lon, share), 6).alias("at_lon"),
    )


def fn_json(spark, sf):
    events = _events(spark, sf)
    packed = F.to_json(F.struct(F.col("event_id").alias("id"), F.struct(F.col("event_type").alias("kind")).alias("meta")))
    cut = F.when(F.col("event_id") % 10 == 0, F.expr("left(props, length(props) - 1)")).otherwise(F.col("props"))
    return events.withColumns({"packed": packed, "cut": cut}).select(
        "event_id",
        F.get_json_object("props", "$.k").cast("int").alias("k"),
        F.from_json("cut", "k INT").getField("k").alias("k_cut"),
        payload.is_malformed("cut").alias("is_malformed"),
        F.get_json_object("packed", "$.meta.kind").alias("kind"),
    )


def fn_array(spark, sf):
    k = F.get_json_object("props", "$.k").cast("int")
    items = F.transform(F.sequence(F.lit(1), F.col("k") % 4 + 1), lambda i: F.struct(F.col("value").alias("price"), i.alias("quantity")))
    holes = F.array(F.when(F.col("k") < 50, F.lit("low")), F.when(F.col("k") % 2 == 0, F.lit("even")))
    return (
        _events(spark, sf)
        .withColumn("k", k)
        .withColumns({"items": items, "holes": holes})
        .select(
            "event_id",
            F.size("items").alias("n_items"),
            payload.fold_quantity("items").alias("quantity"),
            F.round(payload.fold_amount("items"), 2).alias("amount"),
            F.concat_ws(",", F.array_compact("holes")).alias("tags"),
            F.size(F.filter("holes", lambda x: x.isNotNull())).alias("n_tags"),
        )
    )


def fn_conditional(spark, sf):
    """First match names the row; none gives NULL."""
    band = F.when(F.col("o_totalprice") > 400000, "huge").when(F.col("o_totalprice") > 200000, "large").when(F.col("o_totalprice") > 50000, "middle")
    return read_table(spark, sf, "orders").select(
        "o_orderkey", band.alias("band"), F.when(F.col("o_orderstatus") == "O", True).otherwise(False).alias("is_open")
    )


def stage_minutes(spark, sf):
    """Earliest time per stage and user, and the minutes from sign-up to purchase."""
    stages = {"signup": "signup_at", "view": "view_at", "click": "click_at", "purchase": "purchase_at"}
    first = earliest_per_stage(_events(spark, sf), ["user_id"], "event_type", "ts", stages)
    return first.where(F.col("purchase_at").isNotNull()).withColumn("minutes", minutes_between("signup_at", "purchase_at"))


def count_if_types(spark, sf):
    return _events(spark, sf).groupBy("user_id").agg(
        count_where(F.col("event_type") == "purchase").alias("n_purchases"), count_where(F.col("event_type") == "error").alias("n_errors")
    )


QUERIES = {
    f.__name__: f
    for f in (
        project_nested,
        project_rename,
        filter_not_null,
        filter_eq,
        filter_range,
        filter_in,
        filter_regex,
        filter_start_day,
        join_broadcast_left,
        join_left_on,
        join_left,
        join_spread,
        net_price_by_status,
        join_items_chain,
        agg_basic,
        agg_distinct,
        agg_percentile,
        agg_rounded,
        agg_global,
        agg_pivot,
        agg_by_date,
        agg_filtered,
        agg_frequency,
        revenue_by_region,
        sort_desc,
        top_customers,
        latest_events,
        sort_multi,
        limit_rows,
        fn_string,
        fn_datetime,
        fn_math,
        fn_distance,
        fn_json,
        fn_array,
        fn_conditional,
        stage_minutes,
        count_if_types,
    )
}

# order feed columns that need no payload
_FEED = """(SELECT CAST(event_id AS VARCHAR) AS event_id, event_id AS event_no, ts,
    CASE WHEN event_id % 89 <> 0 THEN CAST(user_id % 27 AS INTEGER) END AS location_id,
    CASE WHEN event_id % 97 <> 0 THEN CAST(user_id AS VARCHAR) || '-' || CAST((day(ts) - 1) // 7 AS VARCHAR) END AS order_id,
    CAST(json_extract(props, '$.k') AS INTEGER) % 8 AS sequence FROM events)"""
_STAGE = """CASE sequence WHEN 0 THEN 'order_created' WHEN 1 THEN 'kitchen_started' WHEN 2 THEN 'kitchen_finished'
    WHEN 3 THEN 'order_ready' WHEN 4 THEN 'driver_arrived' WHEN 5 THEN 'driver_picked_up'
    WHEN 6 THEN 'delivered' ELSE 'driver_ping' END"""
_LINE = "CAST(round(l_extendedprice * (1 - l_discount) * 10000) AS BIGINT)"

ORACLE = {
    "project_nested": f"SELECT event_id, {K} AS k, value, event_type AS kind FROM events",
    "project_rename": """SELECT c_custkey AS id, c_name AS name, c_acctbal AS balance, c_acctbal < 0 AS in_debt,
        lower(c_mktsegment) AS segment FROM customer""",
    "filter_not_null": f"SELECT event_id, order_id, location_id FROM {_FEED} WHERE order_id IS NOT NULL AND location_id IS NOT NULL",
    "filter_eq": "SELECT event_id, user_id, value FROM events WHERE event_type = 'purchase' AND user_id <> 0",
    "filter_range": """SELECT l_orderkey, l_linenumber, l_quantity, l_discount, l_extendedprice FROM lineitem
        WHERE l_discount >= 0.05::DOUBLE AND l_discount <= 0.07::DOUBLE AND l_quantity < 24 AND l_extendedprice > 0""",
    "filter_in": """SELECT o_orderkey, o_orderpriority, o_orderstatus FROM orders
        WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_orderstatus IN ('O', 'P')""",
    "filter_regex": r"""SELECT * FROM (SELECT doc_id, source,
        regexp_matches(text, '(?i)[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}') AS has_email,
        regexp_matches(text, '\b(\d{4}[-\s]?){3}\d{4}\b') AS has_card FROM documents) WHERE has_email OR has_card""",
    "filter_start_day": """SELECT event_id, ts, event_type FROM events
        WHERE ts >= (SELECT date_trunc('second', min(ts)) + INTERVAL 2 DAY FROM events)""",
    "join_broadcast_left": f"""SELECT event_id, location_id, n_name AS city_name FROM {_FEED}
        LEFT JOIN nation ON location_id = n_nationkey""",
    "join_left_on": f"""SELECT user_id, count(*) AS n_events, {cents("value")} AS spend, c_mktsegment AS segment
        FROM events LEFT JOIN customer ON user_id = c_custkey GROUP BY user_id, c_mktsegment""",
    "join_left": """SELECT o_orderkey, o_custkey, o_totalprice, c_name, c_mktsegment
        FROM orders LEFT JOIN customer ON o_custkey = c_custkey""",
    "join_spread": """SELECT o_orderkey, o_custkey, o_totalprice, c_name, c_mktsegment
        FROM orders LEFT JOIN customer ON o_custkey = c_custkey""",
    "net_price_by_status": f"""SELECT l_returnflag, l_linestatus, CAST(sum({_LINE}) AS DOUBLE) / 10000 AS net_price
        FROM lineitem GROUP BY 1, 2""",
    "join_items_chain": f"""SELECT p_brand AS brand, p_type AS category, s_nationkey AS nation_id, count(*) AS lines,
        CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS quantity, CAST(sum({_LINE}) AS DOUBLE) / 10000 AS revenue
        FROM lineitem LEFT JOIN part ON l_partkey = p_partkey LEFT JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2, 3""",
    "agg_basic": f"""SELECT l_returnflag, l_linestatus, count(*) AS n_lines, count(l_shipdate) AS n_shipped,
        CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS sum_qty, {cents("l_extendedprice")} AS sum_price,
        {cents("l_extendedprice")} / count(l_extendedprice) AS avg_price, min(l_shipdate) AS first_ship,
        max(l_extendedprice) AS max_price FROM lineitem GROUP BY 1, 2""",
    "agg_distinct": f"""SELECT {_STAGE} AS event_type, count(*) AS n_events, count(DISTINCT order_id) AS n_orders
        FROM {_FEED} GROUP BY 1""",
    "agg_percentile": """SELECT event_type, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95,
        count(value) AS n FROM events GROUP BY 1""",
    "agg_rounded": f"""SELECT user_id, round({cents("value")}, 2) AS total_value,
        CAST((2 * sum(CAST(round(value * 100) AS BIGINT)) + count(value)) // (2 * count(value)) AS DOUBLE) / 100 AS avg_value
        FROM events GROUP BY 1""",
    "agg_global": f"""SELECT count(*) AS n_events, count(DISTINCT user_id) AS n_users, {cents("value")} AS total_value,
        min(ts) AS first_ts, max(ts) AS last_ts FROM events""",
    "agg_pivot": """SELECT o_orderpriority, nullif(count(*) FILTER (o_orderstatus = 'F'), 0) AS "F",
        nullif(count(*) FILTER (o_orderstatus = 'O'), 0) AS "O", nullif(count(*) FILTER (o_orderstatus = 'P'), 0) AS "P"
        FROM orders GROUP BY 1""",
    "agg_by_date": f"SELECT CAST(ts AS DATE) AS event_date, count(*) AS n_events, {cents('value')} AS total_value FROM events GROUP BY 1",
    "agg_filtered": """SELECT count(*) AS n_rows, count(*) FILTER (event_type = 'purchase') AS n_type,
        CAST(sum(CAST(round(value * 100) AS BIGINT)) FILTER (event_type = 'purchase') AS DOUBLE) / 100 AS type_revenue FROM events""",
    "agg_frequency": f"SELECT location_id, count(*) AS n_events FROM {_FEED} WHERE location_id IS NOT NULL GROUP BY 1",
    "revenue_by_region": f"""WITH {SALES}
        SELECT r_name AS region, round(CAST(sum(u) AS DOUBLE) / 10000, 2) AS total_revenue
        FROM per_customer JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
        JOIN region ON n_regionkey = r_regionkey GROUP BY 1 ORDER BY total_revenue DESC, region""",
    "sort_desc": f"SELECT p_brand, count(*) AS n_parts, {cents('p_retailprice')} AS list_value FROM part GROUP BY 1 ORDER BY list_value DESC, p_brand",
    "top_customers": f"""WITH {SALES} SELECT o_custkey AS customer_id, round(CAST(u AS DOUBLE) / 10000, 2) AS total_revenue
        FROM per_customer ORDER BY u DESC, o_custkey LIMIT 10""",
    "latest_events": "SELECT event_id, ts, event_type FROM events ORDER BY ts DESC, event_id LIMIT 5",
    "sort_multi": f"SELECT CAST(floor(epoch(ts)) AS BIGINT) AS ts_seconds, sequence, event_id FROM {_FEED} ORDER BY ALL",
    "limit_rows": "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 100",
    "fn_string": """SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts_text,
        'CUST-' || CAST(user_id AS VARCHAR) AS customer_id, event_type IN ('view', 'click') AS is_browse,
        CAST(length(props) AS INTEGER) AS props_chars FROM events""",
    "fn_datetime": """SELECT event_id, ts AS at, CAST(ts AS DATE) AS day, CAST(hour(ts) AS INTEGER) AS hour,
        CAST(dayofweek(ts) + 1 AS INTEGER) AS dow, dayofweek(ts) IN (0, 6) AS is_weekend,
        CAST(floor(epoch(ts)) AS BIGINT) AS epoch_s, TRUE AS junk_is_null FROM events""",
    "fn_math": """SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount) * (1 + l_tax), 6) AS charge,
        l_orderkey % 7 AS slot, l_quantity / 60 AS minutes FROM lineitem""",
    "fn_distance": f"""WITH p AS (SELECT event_id, 40.0::DOUBLE + {K} / 100.0::DOUBLE AS lat, -70.0::DOUBLE - {K} / 100.0::DOUBLE AS lon,
        40.0::DOUBLE + user_id / 1000.0::DOUBLE AS to_lat, -70.0::DOUBLE - user_id / 1000.0::DOUBLE AS to_lon,
        event_id % 100 / 100.0::DOUBLE AS share FROM events)
        SELECT event_id, round(sqrt((to_lat - lat) ** 2 + (to_lon - lon) ** 2) * 111, 6) AS km,
        round(lat + (to_lat - lat) * share, 6) AS at_lat, round(lon + (to_lon - lon) * share, 6) AS at_lon FROM p""",
    "fn_json": f"""SELECT event_id, {K} AS k, CASE WHEN event_id % 10 <> 0 THEN {K} END AS k_cut,
        event_id % 10 = 0 AS is_malformed, event_type AS kind FROM events""",
    "fn_array": f"""WITH e AS (SELECT *, {K} AS k FROM events)
        SELECT event_id, k % 4 + 1 AS n_items, CAST((k % 4 + 1) * (k % 4 + 2) / 2 AS INTEGER) AS quantity,
        round(value * ((k % 4 + 1) * (k % 4 + 2) / 2), 2) AS amount,
        concat_ws(',', CASE WHEN k < 50 THEN 'low' END, CASE WHEN k % 2 = 0 THEN 'even' END) AS tags,
        CAST((k < 50)::INT + (k % 2 = 0)::INT AS INTEGER) AS n_tags FROM e""",
    "fn_conditional": """SELECT o_orderkey, CASE WHEN o_totalprice > 400000 THEN 'huge' WHEN o_totalprice > 200000 THEN 'large'
        WHEN o_totalprice > 50000 THEN 'middle' END AS band, o_orderstatus = 'O' AS is_open FROM orders""",
    "stage_minutes": """WITH s AS (SELECT user_id, min(ts) FILTER (event_type = 'signup') AS signup_at,
        min(ts) FILTER (event_type = 'view') AS view_at, min(ts) FILTER (event_type = 'click') AS click_at,
        min(ts) FILTER (event_type = 'purchase') AS purchase_at FROM events GROUP BY 1)
        SELECT *, (floor(epoch(purchase_at)) - floor(epoch(signup_at))) / 60 AS minutes FROM s WHERE purchase_at IS NOT NULL""",
    "count_if_types": """SELECT user_id, count(*) FILTER (event_type = 'purchase') AS n_purchases,
        count(*) FILTER (event_type = 'error') AS n_errors FROM events GROUP BY 1""",
}
