"""Stream sinks. Each takes the stream, where to write and its checkpoint, and runs until what is
available has been processed; a second run with the same checkpoint takes only what is new."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def drain(writer) -> StreamingQuery:
    """Runs a configured writer over everything available, then returns the finished query."""
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def append_files(
    stream: DataFrame, path: str, checkpoint: str, fmt: str = "parquet", partition_by: Sequence[str] = ()
) -> StreamingQuery:
    """Stream to files, exactly once through the sink's own log."""
    writer = stream.writeStream.format(fmt).outputMode("append").option("path", path).option("checkpointLocation", checkpoint)
    return drain(writer.partitionBy(*partition_by) if partition_by else writer)


def append_table(stream: DataFrame, table: str, path: str, checkpoint: str) -> StreamingQuery:
    """Stream to a catalog table at a stated path."""
    query = (
        stream.writeStream.format("parquet")
        .outputMode("append")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .toTable(table)
    )
    query.awaitTermination()
    return query


def each_batch(stream: DataFrame, callback: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "update") -> StreamingQuery:
    return drain(stream.writeStream.foreachBatch(callback).outputMode(mode).option("checkpointLocation", checkpoint))


def upsert_files(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Stream of changed aggregates: every micro-batch leaves its changes in a folder of its own.

    A repeated batch replaces its folder, so a restart neither loses nor doubles a change. Read the
    result with `latest_state`.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return each_batch(stream, write, checkpoint)


def latest_state(spark, path: str, keys: Sequence[str]) -> DataFrame:
    """Per key the values of the last batch that changed it."""
    changes = spark.read.parquet(path)
    values = [c for c in changes.columns if c not in keys and c != "batch_id"]
    last = F.max_by(F.struct(*values), "batch_id").alias("_last")
    return changes.groupBy(*keys).agg(last).select(*keys, "_last.*")


def to_kafka(stream: DataFrame, servers: str, checkpoint: str, interval: str = "0 seconds") -> StreamingQuery:
    """key, value, topic to a message log; runs until stopped. Needs the connector jar."""
    return (
        stream.writeStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("checkpointLocation", checkpoint)
        .outputMode("update")
        .trigger(processingTime=interval)
        .start()
    )


def append_ticking(stream: DataFrame, path: str, checkpoint: str, interval: str = "1 second", fmt: str = "parquet") -> StreamingQuery:
    """Stream to files by a clock: a micro-batch per interval, until what was there at the start has been processed."""
    writer = stream.writeStream.format(fmt).outputMode("append").option("path", path).option("checkpointLocation", checkpoint)
    query = writer.trigger(processingTime=interval).start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    return query


def to_console(stream: DataFrame, mode: str = "update") -> StreamingQuery:
    return drain(stream.writeStream.format("console").outputMode(mode))


def to_memory(stream: DataFrame, name: str, mode: str = "append") -> StreamingQuery:
    """A table by name in the driver: for tests and small results only."""
    return drain(stream.writeStream.format("memory").queryName(name).outputMode(mode))


def progress(query: StreamingQuery) -> list[dict]:
    """Batch id, rows read and rows per second of the last micro-batches."""
    return [
        {"batch_id": p["batchId"], "input_rows": p["numInputRows"], "rows_per_second": p["processedRowsPerSecond"]}
        for p in query.recentProgress
    ]
