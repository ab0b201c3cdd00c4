import datetime as dt
import shutil

import pytest
from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import functions as F

from tidelayer.operators.guard import BLOCK_RULES, BLOCK_SCHEMA, guard
from tidelayer.session import run_dir, shared_dir
from tidelayer.sources import read_table, stream_table
from tidelayer.sources.feed import block_feed, envelope
from tidelayer.sources.messages import envelope_stream, unpack
from tidelayer.streaming import jobs, sinks

T0 = dt.datetime(2024, 1, 1)
SCHEMA = "id BIGINT, at TIMESTAMP, kind STRING"


def land(spark, path, rows):
    """One more file; rows are (id, minute, kind)."""
    df = spark.createDataFrame([(i, T0 + dt.timedelta(minutes=m), k) for i, m, k in rows], SCHEMA)
    df.coalesce(1).write.mode("append").parquet(path)


def arriving(spark, path, max_files=None):
    reader = spark.readStream.schema(SCHEMA)
    return (reader.option("maxFilesPerTrigger", max_files) if max_files else reader).parquet(path)


def test_shared_dir_is_the_sessions(spark):
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")
    assert run_dir(spark, "x").startswith(shared_dir(spark)) and run_dir(spark, "x") != run_dir(spark, "x")


def test_stream_needs_a_schema(spark, tmp_path):
    land(spark, str(tmp_path / "in"), [(1, 0, "a")])
    with pytest.raises(PySparkException, match="Schema must be specified"):
        spark.readStream.format("json").load(str(tmp_path / "in"))
    assert arriving(spark, str(tmp_path / "in")).isStreaming


def test_rate_source(spark, tmp_path):
    rate = spark.readStream.format("rate-micro-batch").option("rowsPerBatch", 10).option("numPartitions", 2).load()
    doubled = rate.withColumn("doubled", F.col("value") * 2).where("value > 0")
    query = doubled.writeStream.format("memory").queryName("rate_rows").trigger(processingTime="0 seconds").start()
    while not query.recentProgress:
        query.awaitTermination(0.2)
    query.stop()
    assert spark.sql("SELECT count_if(doubled = value * 2) = count(*) AND count(*) >= 9 AS ok FROM rate_rows").first().ok


def test_output_modes(spark, tmp_path):
    path = str(tmp_path / "in")
    land(spark, path, [(1, 0, "a"), (2, 1, "a")])
    land(spark, path, [(3, 2, "a"), (4, 3, "b")])
    counts = arriving(spark, path, 1).groupBy("kind").count()
    sinks.to_memory(counts, "complete_counts", "complete")
    assert {r["kind"]: r["count"] for r in spark.table("complete_counts").collect()} == {"a": 3, "b": 1}
    sinks.to_memory(counts, "update_counts", "update")
    assert sorted((r["kind"], r["count"]) for r in spark.table("update_counts").collect()) == [("a", 2), ("a", 3), ("b", 1)]
    sinks.to_memory(arriving(spark, path), "append_rows", "append")
    assert spark.table("append_rows").count() == 4
    with pytest.raises(AnalysisException):
        sinks.to_memory(counts, "append_counts", "append")


def test_console_and_progress(spark, tmp_path):
    path = str(tmp_path / "in")
    for i in range(3):
        land(spark, path, [(i, i, "a")])
    shown = sinks.progress(sinks.to_console(arriving(spark, path)))
    assert sum(b["input_rows"] for b in shown) == 3
    query = sinks.append_files(arriving(spark, path, 1), str(tmp_path / "out"), str(tmp_path / "cp"))
    batches = sinks.progress(query)
    assert [b["batch_id"] for b in batches] == [0, 1, 2] and sum(b["input_rows"] for b in batches) == 3


def test_restart_takes_only_what_is_new(spark, tmp_path):
    path, out, checkpoint = (str(tmp_path / p) for p in ("in", "out", "cp"))
    land(spark, path, [(1, 0, "a"), (2, 1, "b")])
    sinks.append_files(arriving(spark, path), out, checkpoint)
    sinks.append_files(arriving(spark, path), out, checkpoint)
    assert spark.read.parquet(out).count() == 2
    land(spark, path, [(3, 2, "c")])
    sinks.append_files(arriving(spark, path), out, checkpoint)
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == [1, 2, 3]


def test_json_sink_and_table_sink(spark, tmp_path):
    path = str(tmp_path / "in")
    land(spark, path, [(1, 0, "a"), (2, 1, "b")])
    sinks.append_files(arriving(spark, path), str(tmp_path / "json"), str(tmp_path / "cp1"), fmt="json")
    assert spark.read.json(str(tmp_path / "json")).count() == 2
    sinks.append_table(arriving(spark, path), "arrived", str(tmp_path / "t"), str(tmp_path / "cp2"))
    assert spark.table("arrived").count() == 2
    spark.sql("DROP TABLE arrived")


def test_foreach_batch(spark, tmp_path):
    path, out = str(tmp_path / "in"), str(tmp_path / "out")
    land(spark, path, [(1, 0, "a"), (2, 1, "a")])
    counts = arriving(spark, path).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))
    sinks.upsert_files(counts, out, str(tmp_path / "cp"))
    land(spark, path, [(3, 0, "a"), (4, 1, "b")])
    sinks.upsert_files(counts, out, str(tmp_path / "cp"))
    expected = {"a": 3, "b": 1}
    assert {r.kind: r.n for r in sinks.latest_state(spark, out, ["kind"]).collect()} == expected
    seen = []
    sinks.each_batch(arriving(spark, path), lambda batch, batch_id: seen.append((batch_id, batch.count())), str(tmp_path / "cp3"), "append")
    assert seen == [(0, 4)]


def test_late_rows_are_dropped_between_batches_only(spark, tmp_path):
    path = str(tmp_path / "in")
    land(spark, path, [(1, 0, "a"), (2, 60, "a"), (3, 1, "a")])
    counts = jobs.tumbling_counts(arriving(spark, path), "at", "5 minutes", "kind", delay="10 minutes")
    keys = ["window_start", "window_end", "kind"]

    def result():
        sinks.upsert_files(counts, str(tmp_path / "out"), str(tmp_path / "cp"))
        return {int((r.window_start - T0).total_seconds() // 60): r.event_count for r in sinks.latest_state(spark, str(tmp_path / "out"), keys).collect()}

    assert result() == {0: 2, 60: 1}  # minute 1 came after minute 60, within the batch
    land(spark, path, [(4, 2, "a"), (5, 55, "a"), (6, 61, "a")])
    assert result() == {0: 2, 55: 1, 60: 2}  # minute 2 is over 10 minutes late by now, minute 55 is not


def test_append_mode_emits_closed_windows(spark, tmp_path):
    path = str(tmp_path / "in")
    land(spark, path, [(1, 0, "a"), (2, 4, "a"), (3, 30, "a")])
    counts = jobs.tumbling_counts(arriving(spark, path), "at", "5 minutes", delay="10 minutes")
    sinks.append_files(counts, str(tmp_path / "out"), str(tmp_path / "cp"))
    assert [(r.window_start, r.event_count) for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [(T0, 2)]


def test_dedup_over_batches_and_shifted_copies(spark, tmp_path):
    path = str(tmp_path / "in")
    land(spark, path, [(1, 0, "a"), (1, 0, "a"), (2, 1, "b")])
    land(spark, path, [(1, 1, "a"), (3, 2, "c"), (2, 1, "b")])
    once = jobs.dedup_within(arriving(spark, path, 1), ["id"], "at", "10 minutes")
    sinks.append_files(once, str(tmp_path / "out"), str(tmp_path / "cp"))
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [1, 2, 3]


def test_replay_is_in_event_order(spark, sf, tmp_path):
    events = read_table(spark, sf, "events").select("event_id", "ts")
    path = jobs.replay_files(events, str(tmp_path / "in"), ["ts", "event_id"], 4)
    spans = [
        (r.lo, r.hi)
        for r in spark.read.parquet(path).groupBy(F.input_file_name().alias("f")).agg(F.min("ts").alias("lo"), F.max("ts").alias("hi")).orderBy("lo").collect()
    ]
    assert len(spans) == 4 and all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))


def test_from_day_counts_from_the_first_row(spark):
    at = [T0 + dt.timedelta(hours=h, milliseconds=500) for h in (5, 28, 29, 30)]
    df = spark.createDataFrame([(t,) for t in at], "at timestamp")
    assert [jobs.from_day(df, "at", day).count() for day in (0, 1, 2)] == [4, 2, 0]


def test_guard_on_a_stream_equals_batch(spark, sf, tmp_path):
    messages = envelope(block_feed(read_table(spark, sf, "orders")), "block_hash", "blocks", "block_number", "block_number", "timestamp")
    messages.repartition(3).write.parquet(str(tmp_path / "in"))
    columns = ("block_number", "decision", "validation_reasons")
    stream = guard(unpack(envelope_stream(spark, str(tmp_path / "in"), 1), BLOCK_SCHEMA), BLOCK_RULES, ["extra_data"]).select(*columns)
    sinks.append_files(stream, str(tmp_path / "out"), str(tmp_path / "cp"))
    batch = guard(block_feed(read_table(spark, sf, "orders")), BLOCK_RULES, ["extra_data"]).select(*columns)
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect())) == sorted(map(tuple, batch.collect()))


def test_unparsed_message_stays(spark):
    rows = [(b"k", b'{"block_number": 5}'), (b"k", b"{broken")]
    df = unpack(spark.createDataFrame(rows, "key binary, value binary"), BLOCK_SCHEMA, F.col("key").cast("string").alias("message_key"))
    assert sorted((r.message_key, r.block_number) for r in df.fillna(0, ["block_number"]).collect()) == [("k", 0), ("k", 5)]


def test_watermark_needs_a_zoned_timestamp(spark, sf):
    raw = spark.readStream.schema("event_id BIGINT, ts TIMESTAMP_NTZ").parquet(f"{sf}/events.parquet*")
    with pytest.raises(AnalysisException):
        raw.withWatermark("ts", "1 minute").schema
    assert dict(stream_table(spark, sf, "events").withWatermark("ts", "1 minute").dtypes)["ts"] == "timestamp"


def test_a_neighbour_of_a_table_is_not_read(spark, sf, tmp_path):
    shutil.copyfile(f"{sf}/events.parquet", tmp_path / "events.parquet")
    shutil.copyfile(f"{sf}/events.parquet", tmp_path / "events.parquet.old")
    sinks.append_files(stream_table(spark, str(tmp_path), "events"), str(tmp_path / "out"), str(tmp_path / "checkpoint"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == spark.read.parquet(f"{sf}/events.parquet").count()


def test_deliveries_cut_all_rows_in_order(spark):
    rows = spark.range(100).select(F.timestamp_seconds(F.col("id") * 60).alias("at"))
    parts = [rows.where(c).agg(F.min("at"), F.max("at"), F.count("*")).first() for c in jobs.deliveries(rows, "at")]
    assert sum(p[2] for p in parts) == 100 and len(parts) == 4 and all(a[1] < b[0] for a, b in zip(parts, parts[1:]))
    assert len(jobs.deliveries(rows.limit(0), "at")) == 1


def test_files_by_size(spark):
    assert jobs.files_for(spark.range(10)) == jobs.LEAST_FILES
    assert jobs.files_for(spark.range(10**9)) == -(-8 * 10**9 // jobs.FILE_BYTES)
