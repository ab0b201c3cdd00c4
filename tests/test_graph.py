from graphlib import CycleError

import pytest
from pyspark.sql import functions as F

from tidelayer.plans.graph import Graph, MissingUpstream
from tidelayer.plans.medallion import medallion
from tidelayer.session import run_dir


def small(spark):
    graph = Graph(spark)

    @graph.view("totals", "gold")
    def _(read):
        return read("orders").groupBy("brand").agg(F.sum("amount").alias("amount"))

    graph.sql("orders", "bronze", "SELECT id, concat('brand ', id % 5) AS brand, id * 2 AS amount FROM {numbers}")

    @graph.view("numbers", "bronze")
    def _(read):
        return spark.range(1000)

    return graph


def test_order_follows_reads_not_registration(spark):
    graph = small(spark)
    edges, errors = graph.reads()
    assert edges == {"totals": ["orders"], "orders": ["numbers"], "numbers": []} and not errors
    assert graph.order() == ["numbers", "orders", "totals"]


def test_run_reports_rows_and_can_be_repeated(spark, tmp_path):
    graph = small(spark)
    for _ in range(2):
        report = {r.dataset: (r.status, r.n_rows, r.reads) for r in graph.run(str(tmp_path)).collect()}
        assert report == {"numbers": ("completed", 1000, []), "orders": ("completed", 1000, ["numbers"]), "totals": ("completed", 5, ["orders"])}
    assert graph.table(str(tmp_path), "totals").agg(F.sum("amount")).first()[0] == 999 * 1000
    assert graph.preview(str(tmp_path), "orders", 3).count() == 3
    assert {r.layer for r in graph.layers().collect()} == {"bronze", "gold"}


def test_dry_run_names_what_is_missing_and_writes_nothing(spark, tmp_path):
    graph = small(spark)
    graph.sql("broken", "gold", "SELECT brand, sum(amount) AS revenue FROM {orderz} GROUP BY brand")
    graph.sql("typo", "gold", "SELECT brandd FROM {orders}")

    @graph.view("after", "gold")
    def _(read):
        return read("broken")

    report = {r.dataset: (r.status, r.message) for r in graph.dry_run().collect()}
    assert report["broken"][0] == "failed" and "orderz" in report["broken"][1]
    assert report["typo"][0] == "failed" and "brandd" in report["typo"][1]
    assert report["after"][0] == "failed"
    assert report["totals"] == ("valid", None)
    with pytest.raises(Exception):
        graph.run(str(tmp_path / "out"))
    assert not (tmp_path / "out").exists()


def test_cycle(spark):
    graph = Graph(spark)
    graph.sql("a", "x", "SELECT * FROM {b}")
    graph.sql("b", "x", "SELECT * FROM {a}")
    with pytest.raises(CycleError):
        graph.order()
    assert {r.status for r in graph.dry_run().collect()} == {"failed"}


def test_name_twice(spark):
    graph = small(spark)
    with pytest.raises(ValueError, match="twice"):
        graph.sql("orders", "gold", "SELECT 1")
    with pytest.raises(MissingUpstream):
        graph.table("/nowhere", "nothing")


def test_sql_files(spark, tmp_path):
    (tmp_path / "sql").mkdir()
    (tmp_path / "sql" / "by_brand.sql").write_text("SELECT brand, count(*) AS n FROM {orders} GROUP BY brand")
    graph = small(spark)
    assert [d.name for d in graph.sql_files(str(tmp_path / "sql"), "gold")] == ["by_brand"]
    assert graph.order().index("by_brand") > graph.order().index("orders")
    graph.run(str(tmp_path / "out"))
    assert {r.n for r in graph.table(str(tmp_path / "out"), "by_brand").collect()} == {200}


def test_stream_adds_and_view_recomputes(spark, tmp_path):
    landing = str(tmp_path / "landing")
    schema = "id BIGINT, kind STRING"
    graph = Graph(spark)

    @graph.stream("clean", "silver", lambda: spark.readStream.schema(schema).parquet(landing))
    def _(stream):
        return stream.where("kind IS NOT NULL")

    @graph.view("by_kind", "gold")
    def _(read):
        return read("clean").groupBy("kind").count()

    root = str(tmp_path / "out")
    spark.createDataFrame([(1, "a"), (2, None), (3, "b")], schema).write.parquet(landing)
    assert {r.dataset: r.n_rows for r in graph.run(root).collect()} == {"clean": 2, "by_kind": 2}
    assert {r.dataset: r.n_rows for r in graph.run(root).collect()} == {"clean": 2, "by_kind": 2}
    spark.createDataFrame([(4, "a"), (5, "c")], schema).write.mode("append").parquet(landing)
    assert {r.dataset: r.n_rows for r in graph.run(root).collect()} == {"clean": 4, "by_kind": 3}
    assert {r["kind"]: r["count"] for r in graph.table(root, "by_kind").collect()} == {"a": 2, "b": 1, "c": 1}
    refreshed = run_dir(spark, "refresh")
    assert {r.dataset: r.n_rows for r in graph.run(refreshed).collect()} == {"clean": 4, "by_kind": 3}


def test_medallion_is_valid(spark, sf):
    report = medallion(spark, sf).dry_run().collect()
    assert {r.status for r in report} == {"valid"}
    reads = {r.dataset: sorted(r.reads) for r in report}
    assert reads["silver_orders"] == ["bronze_locations", "bronze_orders"]
    assert reads["silver_orders_sql"] == ["bronze_locations", "bronze_orders"]
    assert reads["gold_brands"] == ["bronze_brands", "silver_orders"]
    assert reads["events_by_type"] == ["events_clean"]


def test_a_failing_dataset_is_reported_and_the_others_run(spark, tmp_path):
    graph, broken = Graph(spark), {"now": False}

    @graph.view("base", "bronze")
    def _(read):
        return spark.range(5)

    @graph.view("risky", "silver")
    def _(read):
        rows = read("base")
        return rows.select(F.raise_error(F.lit("no luck")).cast("bigint").alias("id")) if broken["now"] else rows

    @graph.view("after", "gold")
    def _(read):
        return read("risky").where("id > 1")

    @graph.view("other", "gold")
    def _(read):
        return read("base").where("id > 2")

    root = str(tmp_path / "run")
    assert {r.status for r in graph.run(root).collect()} == {"completed"}
    broken["now"] = True
    report = {r.dataset: r for r in graph.run(root).collect()}
    assert {n: r.status for n, r in report.items()} == {"base": "completed", "risky": "failed", "after": "skipped", "other": "completed"}
    assert "no luck" in report["risky"].message and report["after"].n_rows is None and report["other"].n_rows == 2
    assert graph.table(root, "risky").count() == 5 and graph.table(root, "after").count() == 3  # as the last good run left them
