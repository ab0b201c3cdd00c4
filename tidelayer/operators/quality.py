"""Data-quality checks, each one DataFrame in and one small report out."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelayer.functions import money, payload
from tidelayer.session import run_dir


def layer_totals(bronze: DataFrame, silver: DataFrame, gold: DataFrame, amount: str, gold_amount: str, gold_rows: str) -> DataFrame:
    """One row: rows and totals of three layers, whether rows agree, whether totals agree within 0.01."""

    def totals(df: DataFrame, layer: str, rows: Column, column: str) -> DataFrame:
        return df.agg(rows.cast("bigint").alias("n"), money.total_exact(column).alias("total")).select(F.lit(layer).alias("layer"), "n", "total")

    layers = (
        totals(bronze, "bronze", F.count(F.lit(1)), amount)
        .unionByName(totals(silver, "silver", F.count(F.lit(1)), amount))
        .unionByName(totals(gold, "gold", F.sum(gold_rows), gold_amount))
    )

    def pick(layer: str, column: str) -> Column:
        return F.max(F.when(F.col("layer") == layer, F.col(column)))

    return layers.agg(
        *(pick(layer, "n").alias(f"{layer}_rows") for layer in ("bronze", "silver", "gold")),
        *(pick(layer, "total").cast("double").alias(f"{layer}_total") for layer in ("bronze", "silver", "gold")),
        (pick("bronze", "n") == pick("silver", "n")).alias("rows_agree"),
        (F.abs(pick("bronze", "total") - pick("gold", "total")) < F.lit("0.01").cast("decimal(3,2)")).alias("totals_agree"),
    )


def duplicate_report(df: DataFrame, key: str) -> DataFrame:
    """One row: rows, distinct keys, whether they are equal. Rows without a key count as rows only."""
    per_key = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return per_key.agg(
        F.sum("n").alias("n_rows"),
        F.count(key).alias("n_distinct"),
        (F.sum("n") == F.count(key)).alias("exactly_once"),
    )


def repeated_keys(df: DataFrame, key: str, time: str) -> DataFrame:
    """Keys that occur more than once, with the span of their times in seconds (0: exact repeats)."""
    seconds = F.unix_timestamp(time)
    return (
        df.groupBy(key)
        .agg(F.count(F.lit(1)).alias("copies"), (F.max(seconds) - F.min(seconds)).alias("span_seconds"))
        .where(F.col("copies") > 1)
    )


def null_report(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Per column: rows, NULLs and the rate, from one pass."""
    counted = df.agg(F.count(F.lit(1)).alias("n_rows"), *(F.count_if(F.col(c).isNull()).alias(c) for c in columns))
    pairs = F.array(*(F.struct(F.lit(c).alias("field"), F.col(c).alias("n_nulls")) for c in columns))
    return counted.select("n_rows", F.inline(pairs)).select(
        "field", "n_rows", "n_nulls", (F.col("n_nulls") / F.col("n_rows")).alias("null_rate")
    )


def malformed_report(df: DataFrame, key: str, body: str) -> DataFrame:
    """Per key value: rows, rows whose JSON does not parse, and the rate."""
    bad = F.count_if(payload.is_malformed(body))
    return df.groupBy(key).agg(
        F.count(F.lit(1)).alias("n_rows"), bad.alias("n_malformed"), (bad / F.count(F.lit(1))).alias("malformed_rate")
    )


def feed_stats(df: DataFrame, id_col: str, type_col: str, place_col: str, time_col: str) -> DataFrame:
    """metric, item, n: rows, distinct ids (a missing id is one of them), time span, rows per type and place.

    Three scans that read different columns: times, ids, and types with places.
    """
    ids = df.groupBy(id_col).agg(F.lit(1)).agg(F.count(F.lit(1)))
    whole = df.agg(F.count(F.lit(1)).alias("n"), F.min(time_col).alias("lo"), F.max(time_col).alias("hi")).withColumn("ids", ids.scalar())
    no_item, no_n = F.lit(None).cast("string").alias("item"), F.lit(None).cast("bigint").alias("n")
    lines = F.array(
        F.struct(F.lit("rows").alias("metric"), no_item, F.col("n").alias("n")),
        F.struct(F.lit("unique_ids").alias("metric"), no_item, F.col("ids").alias("n")),
        F.struct(F.lit("first_ts").alias("metric"), F.col("lo").alias("item"), no_n),
        F.struct(F.lit("last_ts").alias("metric"), F.col("hi").alias("item"), no_n),
    )
    per_value = df.groupingSets([[F.col(type_col)], [F.col(place_col)]], F.col(type_col), F.col(place_col)).agg(
        F.grouping(type_col).alias("is_place"), F.count(F.lit(1)).alias("n")
    )
    values = per_value.where((F.col("is_place") == 0) | F.col(place_col).isNotNull()).select(
        F.when(F.col("is_place") == 1, F.lit("place")).otherwise(F.lit("type")).alias("metric"),
        F.when(F.col("is_place") == 1, F.col(place_col).cast("string")).otherwise(F.col(type_col)).alias("item"),
        "n",
    )
    return whole.select(F.inline(lines)).unionByName(values)


def presence(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Per input whether it has a row. Reads one row of each, never counts one."""
    checks = [df.limit(1).agg((F.count(F.lit(1)) > 0).alias("present")).select(F.lit(name).alias("input"), "present") for name, df in tables.items()]
    report = checks[0]
    for check in checks[1:]:
        report = report.unionByName(check)
    return report


def amounts_that_differ(totals: DataFrame, parts: DataFrame, key: str, total: str, price: str, quantity: str | None = None) -> DataFrame:
    """Per key its total, the sum of its parts and their difference.

    Parts are summed per key before the join, so both sides have one row per key and no key is hot.
    """
    price_of = F.col(price) * F.col(quantity) if quantity else F.col(price)
    summed = parts.groupBy(key).agg(money.total_exact(price_of).alias("part_sum"), F.count(F.lit(1)).alias("parts"))
    parts_total = F.coalesce(F.col("part_sum"), F.lit(0).cast(money.EXACT))
    return (
        totals.select(key, money.exact(total).alias("whole"))
        .join(summed, key, "left")
        .select(
            key,
            F.col("whole").cast("double").alias("total"),
            parts_total.cast("double").alias("parts_total"),
            F.coalesce(F.col("parts"), F.lit(0)).cast("bigint").alias("parts"),
            (F.col("whole") == parts_total).alias("consistent"),
        )
    )


def freshness(newest: DataFrame, registry: DataFrame, now: Column) -> DataFrame:
    """newest(layer, table_name, newest_ts) against the registry's SLA hours, as of `now`.

    A registered table without a reading is there too: it has no age and is not fresh.
    """
    hours = (F.unix_timestamp(now) - F.unix_timestamp("newest_ts")) / 3600
    return registry.join(newest, ["layer", "table_name"], "left").select(
        "layer",
        "table_name",
        "newest_ts",
        "sla_hours",
        hours.alias("age_hours"),
        F.coalesce(hours <= F.col("sla_hours"), F.lit(False)).alias("is_fresh"),
    )


def late_arrivals(df: DataFrame, arrival: str, time: str, group: str) -> DataFrame:
    """Per group: rows, rows older than some row that arrived before them, and the largest lag in seconds.

    `arrival` is a unique number or text that orders the rows. The newest time before a row is a running maximum over the
    whole feed, taken in two levels: within ranges of arrivals, one per shuffle partition, and over one row per range. The
    ranges are written once, as they are sampled and would differ in a second reading.
    """
    ranged = df.select(arrival, time, group).repartitionByRange(arrival).withColumn("_block", F.spark_partition_id())
    path = run_dir(df.sparkSession, "arrivals")
    ranged.write.parquet(path)
    blocks = df.sparkSession.read.schema(ranged.schema).parquet(path)
    tops = blocks.groupBy("_block").agg(F.max(time).alias("_top"))
    before = Window.rowsBetween(Window.unboundedPreceding, -1)
    running = tops.select("_block", F.max("_top").over(before.orderBy("_block")).alias("_before_block"))
    inside = F.max(time).over(before.partitionBy("_block").orderBy(arrival))
    lag = F.unix_micros("_newest") - F.unix_micros(time)
    return (
        blocks.withColumn("_inside", inside)
        .join(F.broadcast(running), "_block")  # a row per shuffle partition
        .withColumn("_newest", F.greatest("_inside", "_before_block"))
        .groupBy(group)
        .agg(
            F.count(F.lit(1)).alias("n_rows"),
            F.count_if(F.col(time) < F.col("_newest")).alias("n_late"),
            (F.max(F.when(lag > 0, lag)) / F.lit(1e6)).alias("max_lag_seconds"),
        )
    )
