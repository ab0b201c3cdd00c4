"""Stream transformations. The stateless ones are the batch functions; these keep state."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelayer.operators.joins import estimated_bytes

FILE_BYTES = 128 * 1024 * 1024


def use_rocksdb(spark: SparkSession) -> None:
    """State on disk: a window of deduplication may hold more keys than memory does. A provider that was set stays.

    A micro-batch then saves its changes only, not the whole state.
    """
    key, default = "spark.sql.streaming.stateStore.providerClass", "HDFSBackedStateStoreProvider"
    if spark.conf.get(key).endswith(default):
        spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
        spark.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")


def tumbling_counts(stream: DataFrame, time: str, width: str, *keys: str, delay: str | None = None) -> DataFrame:
    """Rows per window and key. Combined on the map side, so a hot key costs one row per task.

    With a delay, windows older than the watermark leave the state, and rows later than that are dropped.
    """
    if delay:
        use_rocksdb(stream.sparkSession)
    source = stream.withWatermark(time, delay) if delay else stream
    return (
        source.groupBy(F.window(time, width).alias("w"), *keys)
        .agg(F.count(F.lit(1)).alias("event_count"))
        .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *keys, "event_count")
    )


def dedup_within(stream: DataFrame, keys: Sequence[str], time: str, delay: str) -> DataFrame:
    """One row per key among those that arrive within the delay of each other.

    Copies often carry a shifted time, so time is no part of the key. Copies are removed in two
    steps: first within slots that part the copies of one key over the cluster, then per key on the
    few that are left, so that a key with most of the rows is not one task's work.
    """
    use_rocksdb(stream.sparkSession)
    slot = F.pmod(F.spark_partition_id(), F.lit(shuffle_partitions(stream)))
    return (
        stream.withWatermark(time, delay)
        .withColumn("_slot", slot)
        .dropDuplicatesWithinWatermark([*keys, "_slot"])
        .dropDuplicatesWithinWatermark([*keys])
        .drop("_slot")
    )


def from_day(df: DataFrame, time: str, day: int) -> DataFrame:
    """Rows from `day` times 24 hours after the first row's second on; day 0 is everything. For batch sources.

    The start is a scalar subquery and the column itself is compared, so the filter reaches the scan.
    """
    start: Column = df.agg(F.timestamp_seconds(F.unix_timestamp(F.min(time)) + day * 86_400)).scalar()
    return df.where(F.col(time) >= start)


def deliveries(df: DataFrame, time: str, parts: int = 4) -> list[Column]:
    """Conditions that cut a batch table into so many stretches of time with about as many rows each, in order."""
    micros = F.unix_micros(F.col(time).cast("timestamp"))
    cuts = df.agg(F.percentile_approx(micros, [i / parts for i in range(1, parts)])).first()[0] or []
    edges = [None, *sorted(set(cuts)), None]
    above = [F.lit(True) if low is None else micros > low for low in edges[:-1]]
    below = [F.lit(True) if high is None else micros <= high for high in edges[1:]]
    return [a & b for a, b in zip(above, below)]


def replay_files(df: DataFrame, path: str, order: Sequence[str], files: int | None = None) -> str:
    """Rows as files in event order, for a stream that replays them; by default of about FILE_BYTES, at least `LEAST_FILES`.

    Files are cut by ranges of all order columns, so one time with many rows is spread over files. They are written once, by
    tasks that end in any order; as a stream takes files by their time, these are then set in the order of the ranges.
    """
    files = files or files_for(df)
    df.repartitionByRange(files, *order).sortWithinPartitions(*order).write.mode("overwrite").parquet(path)
    order_times(df.sparkSession, path)
    return path


def order_times(spark: SparkSession, path: str) -> None:
    """Gives the data files of a folder times in the order of their names, a millisecond apart; fails where these are not kept."""
    context = spark.sparkContext
    folder = context._jvm.org.apache.hadoop.fs.Path(path)
    system = folder.getFileSystem(context._jsc.hadoopConfiguration())

    def listed():
        return sorted((s for s in system.listStatus(folder) if s.getPath().getName().startswith("part-")), key=lambda s: s.getPath().getName())

    found = listed()
    newest = max((s.getModificationTime() for s in found), default=0)
    wanted = [newest - len(found) + k for k in range(1, len(found) + 1)]
    for status, time in zip(found, wanted):
        system.setTimes(status.getPath(), time, -1)
    if [s.getModificationTime() for s in listed()] != wanted:
        raise RuntimeError(f"the file system of {path} does not keep the times that order a replay")


LEAST_FILES = 8


def files_for(df: DataFrame, bytes_each: int = FILE_BYTES) -> int:
    """Files of about that size by Spark's estimate of the rows."""
    return max(LEAST_FILES, -(-estimated_bytes(df) // bytes_each))


def shuffle_partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
