"""Semantics of the datasets on hand-made rows."""

import datetime as dt

from tidelayer.plans import bronze, gold, registry, silver

FEED = "event_id STRING, event_type STRING, ts STRING, ts_seconds BIGINT, location_id INT, order_id STRING, sequence INT, body STRING"
CREATED = '{"customer_lat": 1.5, "customer_lon": 2.5, "brand_id": 3, "brand_name": "b3", "items": [{"item_id": 1, "name": "n", "price": 2.0, "quantity": 2}, {"item_id": 2, "name": "m", "price": 1.0, "quantity": 1}], "total": 5.0}'


def feed(spark, rows):
    return spark.createDataFrame([(e, t, f"2024-01-06T{ts}", 0, loc, o, 0, body) for e, t, ts, loc, o, body in rows], FEED)


def places(spark):
    return spark.createDataFrame([(1, "Paris"), (2, "Rome")], "id INT, city STRING")


def test_enriched_drops_rows_without_keys_and_keeps_unknown_places(spark):
    rows = feed(
        spark,
        [
            ("e1", "order_created", "10:00:00", 1, "o1", CREATED),
            ("e2", "order_created", "10:00:00", 9, "o2", CREATED),
            ("e3", "order_created", "10:00:00", None, "o3", CREATED[:40]),
            ("e4", "order_created", "10:00:00", 1, None, CREATED),
            (None, "order_created", "10:00:00", 1, "o5", CREATED),
        ],
    )
    found = {r.event_id: r for r in silver.enriched(bronze.orders(rows), places(spark)).collect()}
    assert set(found) == {"e1", "e2", "e3"}
    assert (found["e1"].city_name, found["e2"].city_name, found["e3"].city_name) == ("Paris", None, None)
    assert (found["e1"].order_total, found["e3"].order_total, found["e1"].latitude) == (5.0, None, 1.5)
    assert (found["e1"].is_weekend, found["e1"].event_hour) == (True, 10)
    counted = {r.event_id: r for r in silver.enriched_with_items(bronze.orders(rows), places(spark)).collect()}
    assert (counted["e1"].num_items, counted["e1"].total_quantity, counted["e3"].num_items) == (2, 3, None)


def test_lifecycle(spark):
    stages = ["order_created", "kitchen_started", "kitchen_finished", "order_ready", "driver_arrived", "driver_picked_up", "delivered"]
    rows = [(f"a{i}", s, f"10:{i * 5:02d}:00.900000", 1, "a", "{}") for i, s in enumerate(stages)]
    rows += [("a9", "order_created", "10:30:00", 1, "a", "{}")]  # later copy of a stage: the first counts
    rows += [("p1", "driver_ping", "10:31:00", 1, "a", "{}"), ("p2", "driver_ping", "10:31:00", 1, "only pings", "{}")]
    rows += [("b1", "order_created", "10:00:00", 2, "b", "{}")]  # never delivered
    rows += [("c1", "order_created", "10:00:00", None, "c", "{}"), ("c2", "delivered", "10:20:00", 2, "c", "{}")]  # stage lost its place
    found = {r.order_id: r for r in silver.order_lifecycle(silver.enriched(bronze.orders(feed(spark, rows)), places(spark))).collect()}
    assert set(found) == {"a", "c"}
    a, c = found["a"], found["c"]
    assert (a.kitchen_duration_min, a.delivery_duration_min, a.total_duration_min) == (5.0, 5.0, 30.0)
    assert a.created_at == dt.datetime(2024, 1, 6, 10, 0, 0, 900000)
    assert c.created_at is None and c.total_duration_min is None


def test_gold_on_missing_totals_and_duplicates(spark):
    rows = [("e1", "order_created", "10:00:00", 1, "o1", CREATED), ("e1", "order_created", "10:00:00", 1, "o1", CREATED)]
    rows += [("e2", "order_created", "10:30:00", 1, "o2", "{broken"), ("e3", "delivered", "10:40:00", 1, "o1", "{}")]
    enriched = silver.enriched(bronze.orders(feed(spark, rows)), places(spark))
    row = gold.hourly_metrics(enriched).first()
    assert (row.order_count, row.total_revenue, row.avg_order_value, row.unique_brands) == (3, 10.0, 5.0, 1)
    paid = silver.paid_orders(silver.created_orders(feed(spark, rows)))
    assert [tuple(r) for r in gold.daily_revenue(paid).collect()] == [(dt.date(2024, 1, 6), 2, 10.0)]
    brands = spark.createDataFrame([(4, "four")], "id INT, name STRING")
    summary = {r.brand_id: r for r in gold.brand_summary(enriched, brands).collect()}
    assert summary[3].brand_name is None and summary[3].total_orders == 2 and summary[None].total_revenue is None


def test_lenient_times(spark):
    rows = feed(spark, [("e1", "order_created", "10:00:00", 1, "o", "{}")])
    assert bronze.orders_lenient(rows.withColumn("ts", bronze.F.lit("junk"))).first().event_timestamp is None


def test_empty_inputs(spark):
    enriched = silver.enriched(bronze.orders(feed(spark, [])), places(spark))
    for df in (gold.hourly_metrics(enriched), gold.delivery_performance(silver.order_lifecycle(enriched)), silver.paid_orders(silver.created_orders(feed(spark, [])))):
        assert df.count() == 0


def test_registry(spark):
    assert registry.tables(spark).count() == 10 and registry.edges(spark).count() == 5
    units = {r.table_name: r.partition_unit for r in registry.tables(spark).collect()}
    assert (units["raw_orders"], units["product_performance"], units["customers"]) == ("hour", "month", None)
    assert {r.gold_table for r in registry.two_hops(spark).collect()} == {"daily_sales", "customer_lifetime_value", "product_performance"}
