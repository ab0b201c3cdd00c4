"""Reconciliation, layouts, mergeable summaries, incremental views, closure, numbers, progress, shapes."""

import datetime as dt
from pathlib import Path

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from tidelayer.functions import shapes, summaries
from tidelayer.operators.numbering import numbered
from tidelayer.operators.reach import closure
from tidelayer.operators.reconcile import reconcile, suspects
from tidelayer.sources import bucketed
from tidelayer.streaming import sinks
from tidelayer.streaming.progress import ProgressTable
from tidelayer.suite import mechanisms


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


# -- reconciliation -------------------------------------------------------------------------------
def layer(spark, rows):
    return spark.createDataFrame(rows, "k BIGINT, a STRING, v DOUBLE")


def found(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_opposite_errors_are_named(spark):
    rows = [(i, f"a{i}", float(i)) for i in range(500)]
    wrong = [(k, a, v + (1.0 if k == 7 else -1.0 if k == 8 else 0.0)) for k, a, v in rows]
    left, right = layer(spark, rows), layer(spark, wrong)
    assert left.agg(F.count("k"), F.sum("v")).first() == right.agg(F.count("k"), F.sum("v")).first()
    assert found(reconcile(left, right, ["k"])) == sorted(
        [(7, "a7", 7.0, 1, 0), (7, "a7", 8.0, 0, 1), (8, "a8", 8.0, 1, 0), (8, "a8", 7.0, 0, 1)], key=str
    )


def test_counts_nulls_and_order(spark):
    left = layer(spark, [(1, None, 1.0), (1, None, 1.0), (2, "x", None), (None, "n", 1.0), (None, None, None)])
    assert found(reconcile(left, left.orderBy(F.desc("a")), ["k"])) == []
    right = layer(spark, [(1, None, 1.0), (2, None, None), (None, "n", 1.0), (None, None, None), (None, None, None)])
    assert found(reconcile(left, right, ["k"])) == sorted(
        [(1, None, 1.0, 2, 1), (2, "x", None, 1, 0), (2, None, None, 0, 1), (None, None, None, 1, 2)], key=str
    )
    assert found(reconcile(left.limit(0), left.limit(0), ["k"])) == []
    assert reconcile(left, left.limit(0), ["k"]).agg(F.sum("left_rows")).first()[0] == 5


def test_only_cells_that_differ_are_compared(spark):
    left = spark.range(100_000).select(F.col("id").alias("k"), F.col("id").cast("string").alias("a"), F.rand(3).alias("v")).cache()
    right = left.withColumn("a", F.when(F.col("k").isin(5, 77_777), "other").otherwise(F.col("a")))
    ours, theirs = suspects(left, right, ["k"], left.columns)
    assert 2 <= ours.count() <= 20 and ours.count() == theirs.count()
    assert {r.k for r in reconcile(left, right, ["k"]).collect()} == {5, 77_777}


# -- layouts --------------------------------------------------------------------------------------
def test_bucketed_tables_join_without_a_shuffle(spark, sf, no_broadcast):
    text = plan(mechanisms.sales_per_order(*mechanisms.bucketed_sales(spark, sf)))
    assert "SortMergeJoin" in text and "Exchange" not in text
    assert text.count("Bucketed: true") == 2


def test_bucket_numbers(spark):
    small, large = spark.range(10), spark.range(10_000_000)
    assert bucketed.buckets_for(small) == 8
    assert bucketed.buckets_for(small, large, bytes_each=1_000_000) == 128


def scan_metrics(df, name):
    """Summed over the scans of a plan that has run without adaptive execution."""
    todo, total = [df._jdf.queryExecution().executedPlan()], {}
    while todo:
        node = todo.pop()
        if node.getClass().getSimpleName() == "FileSourceScanExec":
            place = str(node.relation().location().rootPaths().head())
            total[place] = node.metrics().apply(name).value()
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    return total


def test_folders_are_pruned_while_the_query_runs(spark, sf):
    by_day, calendar = mechanisms.by_day_and_calendar(spark, sf)
    wanted = calendar.where("day_kind = 'weekend'").count()
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df = mechanisms.of_day_kind(by_day, calendar, "weekend")
        assert "dynamicpruning" in plan(df)
        df.collect()
        read = next(n for place, n in scan_metrics(df, "numPartitions").items() if "by-day" in place)
        files = next(n for place, n in scan_metrics(df, "numFiles").items() if "by-day" in place)
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert read == wanted and files < len(by_day.inputFiles())


# -- summaries ------------------------------------------------------------------------------------
def test_merged_sketches_bound_the_rank(spark):
    rows = spark.range(300_000).select((F.col("id") % 50).alias("day"), ((F.col("id") * 7919) % 300_000).cast("double").alias("v"))
    merged = summaries.merged_sketches(summaries.quantile_sketches(rows, ["day"], "v"), [(F.col("day") % 2).alias("half")])
    for row in merged.select("half", *(summaries.quantile("sketch", q).alias(f"q{int(100 * q)}") for q in (0.05, 0.5, 0.95))).collect():
        for q in (0.05, 0.5, 0.95):
            assert abs(row[f"q{int(100 * q)}"] / 300_000 - q) < 0.005


def test_bitmaps_count_as_distinct_does(spark):
    ids = [(g, i) for g in ("a", "b") for i in (0, 1, 1, 32_767, 32_768, -1, -32_768, -32_769, 10**15, None)] + [("b", 5), ("c", None)]
    df = spark.createDataFrame(ids, "g STRING, id BIGINT").repartition(4)
    got = {r.g: r.n_distinct for r in summaries.distinct_of(summaries.id_bitmaps(df, ["g"], "id"), ["g"]).collect()}
    assert got == {r.g: r.n for r in df.groupBy("g").agg(F.countDistinct("id").alias("n")).where("n > 0").collect()}
    assert summaries.distinct_of(summaries.id_bitmaps(df, ["g"], "id"), []).first()[0] == 9


def test_bitmap_shuffle_is_bounded_by_buckets(spark):
    df = spark.range(200_000).select(F.lit("x").alias("g"), F.col("id"))
    bitmaps = summaries.id_bitmaps(df, ["g"], "id")
    assert bitmaps.count() <= 200_000 // 32_768 + 2
    assert "partial_bitmap_construct_agg" in plan(bitmaps)


# -- views kept up to date ------------------------------------------------------------------------
def files_of(path):
    return {p.parent.name: sorted(f.name for f in p.parent.glob("*.parquet")) for p in Path(path).rglob("*.parquet")}


def test_only_touched_days_are_written_again(spark, tmp_path):
    def events(*rows):
        return spark.createDataFrame([(i, dt.datetime(2024, 1, day), kind, v) for i, day, kind, v in rows], "event_id BIGINT, ts TIMESTAMP, event_type STRING, value DOUBLE")

    first, second = events((1, 1, "a", 1.5), (2, 2, "a", 2.0), (3, 2, "b", None), (4, 3, "a", 0.25)), events((5, 2, "a", 1.0), (6, 4, "b", 3.0))
    view = mechanisms.daily_view(spark, str(tmp_path))
    view.take(first, 1)
    before = files_of(tmp_path / "view")
    read = Observation()
    view.take(second.observe(read, F.count(F.lit(1)).alias("n")), 2)
    after = files_of(tmp_path / "view")
    assert {day for day in after if after[day] != before.get(day)} == {"event_date=2024-01-02", "event_date=2024-01-04"}
    assert read.get["n"] == 2
    view.take(second, 2)  # comes again
    whole = mechanisms.daily_view(spark, str(tmp_path / "whole"))
    whole.take(first.unionByName(second), 1)
    assert found(view.read()) == found(whole.read())


# -- closure --------------------------------------------------------------------------------------
def test_closure_ends_on_cycles(spark):
    edges = [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("a", "b"), ("x", "x"), ("a", "d"), (None, "a"), ("d", None)]
    got = {(r.source, r.target): r.depth for r in closure(spark.createDataFrame(edges, "source STRING, target STRING")).collect()}
    cycle = {"a": {"b": 1, "c": 2, "a": 3, "d": 1}, "b": {"c": 1, "a": 2, "b": 3, "d": 2}, "c": {"a": 1, "d": 1, "b": 2, "c": 3}}
    assert got == {(s, t): d for s, ts in cycle.items() for t, d in ts.items()} | {("x", "x"): 1}
    assert closure(spark.createDataFrame([], "source STRING, target STRING")).count() == 0


# -- row numbers ----------------------------------------------------------------------------------
def test_numbers_are_gapless(spark):
    df = spark.range(5000).select((F.col("id") * 37 % 5000).alias("id"), F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 50).alias("k")).repartition(7)
    got = numbered(df, ["k", "id"])
    expected = {r.id: n for n, r in enumerate(sorted(df.collect(), key=lambda r: (r.k, r.id)), 1)}
    assert {r.id: r.row_number for r in got.collect()} == expected
    twice = numbered(df.select("k"), ["k"]).collect()
    assert sorted(r.row_number for r in twice) == list(range(1, 5001)) and [r.k for r in sorted(twice, key=lambda r: r.row_number)] == sorted(r.k for r in twice)


def test_no_window_over_all_rows(spark):
    text = plan(numbered(spark.range(100), ["id"]))
    windows = [line for line in text.splitlines() if "Window [" in line or "Window row_number" in line or "+- Window" in line]
    assert sum("row_number()" in w for w in windows) == 1 and "_range" in next(w for w in windows if "row_number()" in w)
    assert text.index("HashAggregate") > 0  # the other window is over one row per range


# -- progress -------------------------------------------------------------------------------------
def test_progress_of_a_failing_batch_is_there(spark, tmp_path):
    for n in range(4):
        spark.range(n * 10, n * 10 + 10).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id BIGINT").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")).observe("seen", F.count(F.lit(1)).alias("n"))

    def third_fails(batch, number):
        if number == 2:
            raise RuntimeError("no more")
        batch.count()

    with ProgressTable(spark, str(tmp_path / "log")) as log:
        query = stream.writeStream.foreachBatch(third_fails).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        with pytest.raises(Exception, match="no more"):
            query.awaitTermination()
        log.wait_for(query)
        good = sinks.append_files(stream.select("id"), str(tmp_path / "out"), str(tmp_path / "c2"))
        log.wait_for(good)
    rows = log.read().collect()
    failed = [r for r in rows if r.run_id == str(query.runId)]
    assert [r.batch_id for r in failed if r.event == "progress" and r.input_rows] == [0, 1]
    assert "no more" in next(r.error for r in failed if r.event == "ended")
    passed = [r for r in rows if r.run_id == str(good.runId)]
    assert sum(r.input_rows for r in passed if r.event == "progress") == 40 and [r.error for r in passed if r.event == "ended"] == [None]


# -- shapes ---------------------------------------------------------------------------------------
def test_shapes_of_mixed_json(spark):
    bodies = [("a", '{"x": 1, "y": "s"}'), ("a", '{"x": 2.5, "z": [1, 2]}'), ("a", '{"x": 1'), ("a", None), ("b", '{"x": {"q": true}}'), ("b", "[1]"), ("c", None)]
    df = spark.createDataFrame(bodies, "kind STRING, body STRING")
    merged = {r.kind: r for r in shapes.merged_shapes(df, "kind", "body").collect()}
    assert (merged["a"].n_rows, merged["a"].n_malformed) == (4, 1) and "x: DECIMAL" in merged["a"].shape
    assert merged["c"].n_malformed == 0
    fields = {(r.kind, r.field): (r.n_rows, r.type) for r in shapes.field_shapes(df, "kind", "body").collect()}
    assert fields[("a", "x")][0] == 2 and fields[("a", "y")] == (1, "STRING") and fields[("a", "z")] == (1, "ARRAY<BIGINT>")
    assert fields[("b", "x")] == (1, "OBJECT<q: BOOLEAN>") and len(fields) == 4
