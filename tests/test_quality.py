import datetime as dt
import random

from pyspark.sql import functions as F

from tidelayer.operators import quality


def test_late_arrivals_against_brute_force(spark):
    rng = random.Random(3)
    start = dt.datetime(2024, 1, 1)
    rows = [(i, start + dt.timedelta(seconds=i * 10 - rng.choice([0, 0, 0, 45, 700])), rng.choice("ab")) for i in range(2000)]
    expected = {}
    newest = None
    for _, at, group in rows:
        n, late, lag = expected.get(group, (0, 0, None))
        behind = (newest - at).total_seconds() if newest and at < newest else None
        expected[group] = (n + 1, late + (behind is not None), max(filter(None, (lag, behind)), default=None))
        newest = max(newest, at) if newest else at
    df = spark.createDataFrame(rows, "i bigint, at timestamp, g string").repartition(5)
    for blocks in (1, 4, 33):
        spark.conf.set("spark.sql.shuffle.partitions", blocks)
        found = quality.late_arrivals(df, "i", "at", "g").collect()
        sparse = quality.late_arrivals(df.withColumn("i", F.col("i") * 1_000_000), "i", "at", "g").collect()  # few numbers are used
        spark.conf.set("spark.sql.shuffle.partitions", 4)
        for rows in (found, sparse):
            assert {r.g: (r.n_rows, r.n_late, r.max_lag_seconds) for r in rows} == expected


def test_layer_totals_find_a_loss(spark):
    bronze = spark.createDataFrame([("a", 1.10), ("a", 2.20), (None, 3.30)], "c string, total double")
    silver = bronze.where("c is not null")
    gold = silver.groupBy("c").agg(F.sum("total").alias("revenue"), F.count("*").alias("n"))
    row = quality.layer_totals(bronze, silver, gold, "total", "revenue", "n").first()
    assert (row.bronze_rows, row.silver_rows, row.gold_rows) == (3, 2, 2)
    assert (row.bronze_total, row.gold_total) == (6.6, 3.3)
    assert not row.rows_agree and not row.totals_agree
    full = quality.layer_totals(silver, silver, gold, "total", "revenue", "n").first()
    assert full.rows_agree and full.totals_agree


def test_duplicates(spark):
    at = dt.datetime(2024, 1, 1)
    rows = [("a", at), ("a", at), ("b", at), ("c", at), ("c", at + dt.timedelta(seconds=7)), (None, at)]
    df = spark.createDataFrame(rows, "id string, at timestamp")
    assert {r.id: (r.copies, r.span_seconds) for r in quality.repeated_keys(df, "id", "at").collect()} == {"a": (2, 0), "c": (2, 7)}
    row = quality.duplicate_report(df, "id").first()
    assert (row.n_rows, row.n_distinct, row.exactly_once) == (6, 3, False)


def test_presence_and_nulls(spark):
    some, none = spark.range(3), spark.range(0)
    assert {r.input: r.present for r in quality.presence({"some": some, "none": none}).collect()} == {"some": True, "none": False}
    df = spark.createDataFrame([(1, None), (None, None), (3, "x")], "a int, b string")
    assert {r.field: (r.n_rows, r.n_nulls) for r in quality.null_report(df, ["a", "b"]).collect()} == {"a": (3, 1), "b": (3, 2)}


def test_amounts(spark):
    totals = spark.createDataFrame([(1, 7.5), (2, 1.0), (3, 0.0)], "k int, total double")
    parts = spark.createDataFrame([(1, 2.5, 1), (1, 2.5, 2), (2, 0.5, 1)], "k int, price double, quantity int")
    found = {r.k: (r.parts_total, r.parts, r.consistent) for r in quality.amounts_that_differ(totals, parts, "k", "total", "price", "quantity").collect()}
    assert found == {1: (7.5, 2, True), 2: (0.5, 1, False), 3: (0.0, 0, True)}
