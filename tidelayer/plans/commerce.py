"""Sales over the star schema: revenue by region, top customers, daily sales, lifetime value, products.

Line items are summed per order before they meet the orders, which reuses the shuffle of the sum. Elsewhere a dimension is
joined straight to the rows and the rows are aggregated once, with partial sums on the map side: sums per join key would
hardly reduce them. How a dimension gets to the rows is Spark's choice by its size; a hot key of a shuffled join is split at
run time. Sums of money are exact, see `functions.money`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelayer.functions import money
from tidelayer.operators.joins import join_dimension

NET = "_net_units"


def with_net(lineitem: DataFrame) -> DataFrame:
    """Lines with the units that `net_price` sums, as a column of their own."""
    return lineitem.withColumn(NET, money.net_units("l_extendedprice", "l_discount"))


def net_price() -> Column:
    """Exact sum of the net prices of lines, as a decimal."""
    return money.net_total(F.col(NET), "l_extendedprice", "l_discount")


def nations(nation: DataFrame, region: DataFrame) -> DataFrame:
    """n_nationkey, n_name, r_name."""
    named = region.select(F.col("r_regionkey").alias("n_regionkey"), "r_name")
    return join_dimension(nation, named, "n_regionkey").select("n_nationkey", "n_name", "r_name")


def revenue_per_customer(lineitem: DataFrame, orders: DataFrame) -> DataFrame:
    """o_custkey, revenue, orders: line items per order, joined to their orders, summed per customer."""
    per_order = with_net(lineitem).groupBy("l_orderkey").agg(net_price().alias("revenue"))
    placed = per_order.join(orders.select("o_orderkey", "o_custkey"), per_order.l_orderkey == F.col("o_orderkey"))
    return placed.groupBy("o_custkey").agg(F.sum("revenue").cast(money.EXACT).alias("revenue"), F.count(F.lit(1)).alias("n_orders"))


def revenue_by_region(lineitem: DataFrame, orders: DataFrame, customer: DataFrame, nation: DataFrame, region: DataFrame) -> DataFrame:
    """Revenue per region, largest first."""
    per_customer = revenue_per_customer(lineitem, orders)
    homes = customer.select("c_custkey", F.col("c_nationkey").alias("n_nationkey"))
    per_nation = (
        per_customer.join(homes, per_customer.o_custkey == F.col("c_custkey"))
        .groupBy("n_nationkey")
        .agg(F.sum("revenue").cast(money.EXACT).alias("revenue"))
    )
    named = join_dimension(per_nation, nations(nation, region), "n_nationkey")
    return (
        named.groupBy(F.col("r_name").alias("region"))
        .agg(F.round(F.sum("revenue"), 2).cast("double").alias("total_revenue"))
        .orderBy(F.desc("total_revenue"), "region")
    )


def top_customers(lineitem: DataFrame, orders: DataFrame, k: int = 10) -> DataFrame:
    """k customers with the largest revenue; ties by customer."""
    per_customer = revenue_per_customer(lineitem, orders)
    return (
        per_customer.orderBy(F.desc("revenue"), "o_custkey")
        .limit(k)
        .select(
            F.col("o_custkey").alias("customer_id"),
            F.round("revenue", 2).cast("double").alias("total_revenue"),
        )
    )


def daily_sales(orders: DataFrame, customer: DataFrame, nation: DataFrame, region: DataFrame) -> DataFrame:
    """Orders and sales per day and region."""
    homes = customer.select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("n_nationkey"))
    placed = orders.select("o_custkey", F.to_date("o_orderdate").alias("sales_date"), "o_totalprice")
    per_nation = (
        placed.join(homes, "o_custkey", "left")
        .groupBy("sales_date", "n_nationkey")
        .agg(F.count(F.lit(1)).alias("n"), money.total_exact("o_totalprice").alias("sales"))
    )
    return (
        join_dimension(per_nation, nations(nation, region), "n_nationkey")
        .groupBy("sales_date", F.col("r_name").alias("region"))
        .agg(F.sum("n").alias("order_count"), F.sum("sales").cast("double").alias("total_sales"))
    )


def customer_ltv(orders: DataFrame, customer: DataFrame) -> DataFrame:
    """Per customer: orders, lifetime value, mean order, first and last order. Customers without orders have zero."""
    value = orders.groupBy("o_custkey").agg(
        F.count(F.lit(1)).alias("n"),
        money.total_exact("o_totalprice").cast("double").alias("value"),
        F.to_date(F.min("o_orderdate")).alias("first_order"),
        F.to_date(F.max("o_orderdate")).alias("last_order"),
    )
    return customer.select("c_custkey", "c_name").join(value, F.col("c_custkey") == value.o_custkey, "left").select(
        F.col("c_custkey").alias("customer_id"),
        F.col("c_name").alias("customer_name"),
        F.coalesce("n", F.lit(0)).cast("bigint").alias("order_count"),
        F.coalesce("value", F.lit(0.0)).alias("lifetime_value"),
        (F.col("value") / F.col("n")).alias("avg_order_value"),
        "first_order",
        "last_order",
    )


def product_performance(lineitem: DataFrame, part: DataFrame) -> DataFrame:
    """Per month and brand: quantity, revenue, distinct products."""
    brands = part.select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("brand"))
    per_product = (
        with_net(lineitem).join(brands, "l_partkey", "left")
        .groupBy(F.to_date(F.date_trunc("month", "l_shipdate")).alias("period_start"), "brand", "l_partkey")
        .agg(F.sum(F.col("l_quantity").cast("bigint")).alias("quantity"), net_price().alias("revenue"))
    )
    return per_product.groupBy("period_start", "brand").agg(
        F.sum("quantity").alias("quantity"), F.sum("revenue").cast("double").alias("revenue"), F.count(F.lit(1)).alias("products")
    )


def item_chain(lineitem: DataFrame, part: DataFrame, supplier: DataFrame) -> DataFrame:
    """Item -> brand, item -> category, supplier -> nation: lines, quantity and revenue per combination."""
    kinds = part.select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("brand"), F.col("p_type").alias("category"))
    homes = supplier.select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("nation_id"))
    return (
        with_net(lineitem).join(kinds, "l_partkey", "left")
        .join(homes, "l_suppkey", "left")
        .groupBy("brand", "category", "nation_id")
        .agg(
            F.count(F.lit(1)).alias("lines"), F.sum(F.col("l_quantity").cast("bigint")).alias("quantity"), net_price().cast("double").alias("revenue")
        )
    )
