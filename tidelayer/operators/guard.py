"""Record guardrails: rules and sensitive text give reasons, reasons give a decision and a route.

Every step is a stateless projection, so batch and stream use the same functions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelayer.functions.payload import present
from tidelayer.functions.sensitive import classify

Rule = tuple[str, str]

# Condition, reason.
BLOCK_RULES: list[Rule] = [
    ("gas_used > gas_limit * 0.95", "HIGH_GAS_USAGE"),
    ("transaction_count > 500", "HIGH_TX_COUNT"),
    ("transaction_count = 0", "EMPTY_BLOCK"),
    ("miner = '0x0000000000000000000000000000000000000000'", "ZERO_MINER"),
]
ORDER_RULES: list[Rule] = [
    ("total > 200", "HIGH_TOTAL"),
    ("num_items > 7", "TOO_MANY_ITEMS"),
    (r"note rlike 'AKIA[0-9A-Z]{16}'", "LEAKED_SECRET"),
]
BLOCK_SCHEMA = (
    "block_number BIGINT, block_hash STRING, parent_hash STRING, miner STRING, gas_used BIGINT, "
    "gas_limit BIGINT, transaction_count BIGINT, timestamp BIGINT, total_value_wei STRING, extra_data STRING"
)
ORDER_SCHEMA = "order_id STRING, brand STRING, total DOUBLE, num_items INT, note STRING"


def rule_flags(rules: Sequence[Rule]) -> list[Column]:
    """Per rule its reason, or NULL. A condition that is NULL does not fire."""
    return [F.when(F.expr(condition), F.lit(reason)) for condition, reason in rules]


def with_rule_flags(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Rule outcomes as columns of their own, named flag_<reason>."""
    flags = {f"flag_{reason.lower()}": flag for (_, reason), flag in zip(rules, rule_flags(rules))}
    return df.withColumns(flags)


def guard(
    df: DataFrame,
    rules: Sequence[Rule],
    sensitive: Sequence[str] = (),
    reasons: str = "validation_reasons",
    malformed_if: Column | None = None,
) -> DataFrame:
    """Adds reasons (rule order, then sensitive columns), is_quarantined and decision.

    A message that did not parse has only NULLs, no rule fires and it is allowed; pass `malformed_if`
    to give it the reason MALFORMED.
    """
    flags = rule_flags(rules) + [classify(column) for column in sensitive]
    if malformed_if is not None:
        flags.append(F.when(malformed_if, F.lit("MALFORMED")))
    return (
        df.withColumn(reasons, present(flags))
        .withColumn("is_quarantined", F.size(reasons) > 0)
        .withColumn("decision", F.when(F.col("is_quarantined"), F.lit("QUARANTINE")).otherwise(F.lit("ALLOW")))
    )


def route(df: DataFrame, key: str, prefix: str, payload: Sequence[str]) -> DataFrame:
    """key, value (JSON of the payload columns) and the topic the decision leads to."""
    side = F.when(F.col("is_quarantined"), F.lit("quarantine")).otherwise(F.lit("allowed"))
    return df.select(
        F.col(key).cast("string").alias("key"),
        F.to_json(F.struct(*payload)).alias("value"),
        F.concat(F.lit(f"{prefix}-"), side).alias("topic"),
    )


def decision_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("decision").agg(F.count(F.lit(1)).alias("n"))
