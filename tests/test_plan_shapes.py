"""What the plans must look like, so that they hold on large tables."""

import re

import pytest

from tidelayer import suite
from tidelayer.plans import commerce
from tidelayer.sources import read_table
from tidelayer.suite import checks, guards, layers, relational

BATCH = {name: query for part in (layers, relational, guards, checks) for name, query in part.QUERIES.items() if not name.startswith(("graph", "gold_from"))}


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(BATCH))
def test_no_python_no_products(spark, sf, name):
    text = plan(BATCH[name](spark, sf))
    for node in ("PythonUDF", "BatchEvalPython", "ArrowEvalPython", "MapInPandas", "CartesianProduct", "BroadcastNestedLoopJoin", "CollectList"):
        assert node not in text, node


def read_schema(text: str, table: str) -> str:
    scan = next(line for line in text.splitlines() if f"/{table}.parquet" in line)
    return re.search(r"ReadSchema: (.*)", scan).group(1)


def test_filters_and_columns_reach_the_scan(spark, sf):
    text = plan(relational.filter_eq(spark, sf))
    assert "EqualTo(event_type,purchase)" in text
    assert read_schema(text, "events") == "struct<event_id:bigint,user_id:bigint,event_type:string,value:double>"
    text = plan(relational.top_customers(spark, sf))
    assert read_schema(text, "lineitem") == "struct<l_orderkey:bigint,l_extendedprice:double,l_discount:double>"
    assert "TakeOrderedAndProject" in text


def test_small_dimension_is_broadcast(spark, sf):
    assert "BroadcastHashJoin" in plan(relational.join_broadcast_left(spark, sf))


def test_line_items_are_summed_before_the_join(spark, sf):
    """With no broadcast: one shuffle of line items, whose partitioning the join reuses."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        text = plan(commerce.revenue_per_customer(read_table(spark, sf, "lineitem"), read_table(spark, sf, "orders")))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert text.count("hashpartitioning(l_orderkey") == 1
    assert text.count("Exchange hashpartitioning") == 3


def test_lifecycle_takes_one_shuffle(spark, sf):
    assert plan(layers.order_lifecycle(spark, sf)).count("Exchange hashpartitioning") == 1


def test_type_filter_comes_before_json(spark, sf):
    text = plan(layers.created_orders(spark, sf))
    assert text.index("from_json") < text.index("order_created")  # printed top down: the filter is below


def test_top_k_and_percentiles_are_partial(spark, sf):
    assert "partial_percentile_approx" in plan(relational.agg_percentile(spark, sf))
    assert "TakeOrderedAndProject" in plan(relational.latest_events(spark, sf))


@pytest.mark.parametrize("build, tables, key", [
    (commerce.daily_sales, ("orders", "customer", "nation", "region"), "o_custkey"),
    (commerce.product_performance, ("lineitem", "part"), "l_partkey"),
    (commerce.item_chain, ("lineitem", "part", "supplier"), "l_partkey"),
])
def test_sales_shuffle_the_fact_once_before_the_first_join(spark, sf, build, tables, key):
    """With no broadcast: the rows go to the first join as they are read, by the key of the join."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        text = plan(build(*(read_table(spark, sf, t) for t in tables)))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert text.count(f"hashpartitioning({key}") - text.count(f"hashpartitioning({key}") // 2 <= 2
    below = text[text.rindex(f"SortMergeJoin [{key}") :]
    assert "HashAggregate" not in below


def test_registered_names():
    names = set(suite.queries())
    assert not [n for n in names if "pipeline" in n or re.match(r"op\d", n)]
