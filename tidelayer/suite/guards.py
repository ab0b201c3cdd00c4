"""Guardrails over blocks, orders and free text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelayer.functions.sensitive import classify
from tidelayer.operators.guard import BLOCK_RULES, ORDER_RULES, decision_counts, guard, route, with_rule_flags
from tidelayer.operators.topk import first_rows
from tidelayer.sources import read_table
from tidelayer.sources.feed import block_feed
from tidelayer.suite.common import BLOCKS

PAYLOAD = [
    "block_number", "block_hash", "parent_hash", "miner", "gas_used", "gas_limit", "transaction_count", "timestamp", "total_value_wei",
    "decision", "is_quarantined", "validation_reasons", "processing_time", "message_time",
]


def _blocks(spark: SparkSession, sf: str) -> DataFrame:
    return block_feed(read_table(spark, sf, "orders"))


def guarded_blocks(spark: SparkSession, sf: str) -> DataFrame:
    return guard(_blocks(spark, sf), BLOCK_RULES, ["extra_data"])


def stamped(blocks: DataFrame) -> DataFrame:
    """With the time of the message, which is the block's, and the time it was processed."""
    return blocks.withColumns({"message_time": F.timestamp_seconds("timestamp"), "processing_time": F.current_timestamp()})


def without_clock(value: str):
    return F.regexp_replace(value, '"processing_time":"[^"]*",', "").alias(value)


def _joined(reasons: str):
    """Reasons as one text, in their order."""
    return F.concat_ws(",", reasons).alias(reasons)


def guard_rules(spark, sf):
    """One column per rule: its reason where it fires."""
    return with_rule_flags(_blocks(spark, sf), BLOCK_RULES).select("block_number", *(f"flag_{reason.lower()}" for _, reason in BLOCK_RULES))


def guard_sensitive(spark, sf):
    """Class of every document, over its whole text."""
    return read_table(spark, sf, "documents").select("doc_id", classify("text").alias("sensitive_class"))


def guard_notes(spark, sf):
    """Class of a note per event; every class occurs, and some notes come near one without being one."""
    n = F.col("event_id").cast("string")
    kind = F.col("event_id") % 8
    text = (
        F.when(kind == 0, F.concat(F.lit("key AKIA"), F.lpad(n, 16, "7"), F.lit(" in use")))
        .when(kind == 1, F.concat(F.lit("token eyJhbGciOi.eyJzdWIi"), n, F.lit(".c2ln")))
        .when(kind == 2, F.concat(F.lit("0x"), F.lpad(F.lower(F.hex("event_id")), 64, "a")))
        .when(kind == 3, F.concat(F.lit("id 219-09-"), F.lpad((F.col("event_id") % 10000).cast("string"), 4, "0")))
        .when(kind == 4, F.concat(F.lit("card 4111-1111-1111-"), F.lpad((F.col("event_id") % 10000).cast("string"), 4, "0")))
        .when(kind == 5, F.concat(F.lit("to user"), n, F.lit("@example.org")))
        .when(kind == 6, F.concat(F.lit("AKIA"), n, F.lit(" 0x12 219-09-1 4111-1111 a@b")))
    )
    return read_table(spark, sf, "events").select("event_id", text.alias("text")).select("event_id", classify("text").alias("sensitive_class"))


def guard_chats(spark, sf):
    """Class of every conversation turn."""
    return read_table(spark, sf, "conversations").select("conv_id", "turn", classify("text").alias("sensitive_class"))


def guard_decide(spark, sf):
    return guarded_blocks(spark, sf).select("block_number", _joined("validation_reasons"), "is_quarantined", "decision")


def guard_orders(spark, sf):
    """Second rule set: events as orders with a brand, a number of items and a note."""
    k = F.get_json_object("props", "$.k").cast("int")
    orders = read_table(spark, sf, "events").select(
        F.col("event_id").cast("string").alias("order_id"),
        F.col("event_type").alias("brand"),
        F.col("value").alias("total"),
        (k % 9 + 1).alias("num_items"),
        F.when(F.col("event_id") % 23 == 0, F.concat(F.lit("AKIA"), F.lpad(F.col("event_id").cast("string"), 16, "7"))).otherwise(F.lit("ok")).alias("note"),
    )
    return guard(orders, ORDER_RULES, reasons="reasons").select("order_id", "brand", "total", "decision", _joined("reasons"))


def guard_route(spark, sf):
    """Key, topic and value of what is sent; the time of processing, which no two runs share, is left out of the value here."""
    return route(stamped(guarded_blocks(spark, sf)), "block_hash", "validated", PAYLOAD).select("key", "topic", without_clock("value"))


def guard_summary(spark, sf):
    return decision_counts(guarded_blocks(spark, sf))


def guard_reasons(spark, sf):
    """Blocks per reason."""
    return guarded_blocks(spark, sf).select(F.explode("validation_reasons").alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def guard_sample(spark, sf):
    """Preview of quarantined blocks: the first twenty by number."""
    return first_rows(guarded_blocks(spark, sf).where(F.col("decision") == "QUARANTINE").select("block_number", _joined("validation_reasons")), "block_number", n=20)


QUERIES = {
    f.__name__: f
    for f in (
        guard_rules,
        guard_sensitive,
        guard_notes,
        guard_chats,
        guard_decide,
        guard_orders,
        guard_route,
        guard_summary,
        guard_reasons,
        guard_sample,
    )
}

_CLASS = r"""CASE WHEN regexp_matches(text, 'AKIA[0-9A-Z]{16}') THEN 'CREDENTIAL_AWS_KEY'
    WHEN regexp_matches(text, 'eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+') THEN 'CREDENTIAL_JWT'
    WHEN regexp_matches(text, '0x[a-fA-F0-9]{64}') THEN 'CREDENTIAL_PRIVATE_KEY'
    WHEN regexp_matches(text, '\b\d{3}-\d{2}-\d{4}\b') THEN 'PII_SSN'
    WHEN regexp_matches(text, '\b(\d{4}[-\s]?){3}\d{4}\b') THEN 'PII_CREDIT_CARD'
    WHEN regexp_matches(text, '(?i)[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}') THEN 'PII_EMAIL' END AS sensitive_class"""

ORACLE = {
    "guard_rules": f"""WITH {BLOCKS} SELECT block_number,
        CASE WHEN list_contains(reasons, 'HIGH_GAS_USAGE') THEN 'HIGH_GAS_USAGE' END AS flag_high_gas_usage,
        CASE WHEN list_contains(reasons, 'HIGH_TX_COUNT') THEN 'HIGH_TX_COUNT' END AS flag_high_tx_count,
        CASE WHEN list_contains(reasons, 'EMPTY_BLOCK') THEN 'EMPTY_BLOCK' END AS flag_empty_block,
        CASE WHEN list_contains(reasons, 'ZERO_MINER') THEN 'ZERO_MINER' END AS flag_zero_miner FROM decided""",
    "guard_sensitive": f"SELECT doc_id, {_CLASS} FROM documents",
    "guard_notes": f"""SELECT event_id, {_CLASS} FROM (SELECT event_id, CASE event_id % 8
        WHEN 0 THEN 'key AKIA' || lpad(CAST(event_id AS VARCHAR), 16, '7') || ' in use'
        WHEN 1 THEN 'token eyJhbGciOi.eyJzdWIi' || event_id || '.c2ln'
        WHEN 2 THEN '0x' || lpad(printf('%x', event_id), 64, 'a')
        WHEN 3 THEN 'id 219-09-' || lpad(CAST(event_id % 10000 AS VARCHAR), 4, '0')
        WHEN 4 THEN 'card 4111-1111-1111-' || lpad(CAST(event_id % 10000 AS VARCHAR), 4, '0')
        WHEN 5 THEN 'to user' || event_id || '@example.org'
        WHEN 6 THEN 'AKIA' || event_id || ' 0x12 219-09-1 4111-1111 a@b' END AS text FROM events)""",
    "guard_chats": f"SELECT conv_id, turn, {_CLASS} FROM conversations",
    "guard_decide": f"""WITH {BLOCKS} SELECT block_number, array_to_string(reasons, ',') AS validation_reasons, len(reasons) > 0 AS is_quarantined,
        decision FROM decided""",
    "guard_orders": """WITH e AS (SELECT *, CAST(json_extract(props, '$.k') AS INTEGER) % 9 + 1 AS num_items FROM events),
        r AS (SELECT *, list_filter([CASE WHEN value > 200 THEN 'HIGH_TOTAL' END, CASE WHEN num_items > 7 THEN 'TOO_MANY_ITEMS' END,
        CASE WHEN event_id % 23 = 0 THEN 'LEAKED_SECRET' END], lambda x: x IS NOT NULL) AS reasons FROM e)
        SELECT CAST(event_id AS VARCHAR) AS order_id, event_type AS brand, value AS total,
        CASE WHEN len(reasons) > 0 THEN 'QUARANTINE' ELSE 'ALLOW' END AS decision, array_to_string(reasons, ',') AS reasons FROM r""",
    "guard_route": f"""WITH {BLOCKS} SELECT block_hash AS key,
        CASE decision WHEN 'QUARANTINE' THEN 'validated-quarantine' ELSE 'validated-allowed' END AS topic,
        '{{"block_number":' || block_number || ',"block_hash":"' || block_hash || '","parent_hash":"' || parent_hash || '","miner":"' || miner
        || '","gas_used":' || gas_used || ',"gas_limit":' || gas_limit || ',"transaction_count":' || transaction_count
        || ',"timestamp":' || timestamp || ',"total_value_wei":"' || total_value_wei || '","decision":"' || decision
        || '","is_quarantined":' || (decision = 'QUARANTINE') || ',"validation_reasons":['
        || array_to_string(list_transform(reasons, lambda r: '"' || r || '"'), ',') || '],"message_time":"'
        || strftime(make_timestamp(timestamp * 1000000), '%Y-%m-%dT%H:%M:%S') || '.000Z"}}' AS value FROM decided""",
    "guard_summary": f"WITH {BLOCKS} SELECT decision, count(*) AS n FROM decided GROUP BY 1",
    "guard_reasons": f"WITH {BLOCKS} SELECT unnest(reasons) AS reason, count(*) AS n FROM decided GROUP BY 1",
    "guard_sample": f"""WITH {BLOCKS} SELECT block_number, array_to_string(reasons, ',') AS validation_reasons FROM decided
        WHERE decision = 'QUARANTINE' ORDER BY block_number LIMIT 20""",
}
