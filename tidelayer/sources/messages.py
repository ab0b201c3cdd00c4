"""A message log as source: the Kafka connector when its jar is there, files of envelopes otherwise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ENVELOPE = "key BINARY, value BINARY, topic STRING, partition INT, offset BIGINT, timestamp TIMESTAMP"


def kafka_batch(spark: SparkSession, servers: str, topic: str, start: str = "earliest", end: str = "latest") -> DataFrame:
    return (
        spark.read.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic)
        .option("startingOffsets", start)
        .option("endingOffsets", end)
        .load()
    )


def kafka_stream(spark: SparkSession, servers: str, topic: str, start: str = "earliest") -> DataFrame:
    return (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic)
        .option("startingOffsets", start)
        .option("failOnDataLoss", "false")
        .load()
    )


def envelope_stream(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """Envelope files as a stream: the same columns as the message log, replayable."""
    reader = spark.readStream.schema(ENVELOPE)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(path)


def unpack(messages: DataFrame, schema, *metadata: Column) -> DataFrame:
    """value (JSON) as flat columns, after the message columns asked for. Works on batch and stream.

    A message that does not parse stays: all of its payload columns are NULL.
    """
    payload = F.from_json(F.col("value").cast("string"), schema).alias("data")
    names = [f"`{name}`" for name in messages.select(*metadata).columns]
    return messages.select(*metadata, payload).select(*names, "data.*")
