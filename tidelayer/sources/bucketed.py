"""Tables laid out for joins: written once by buckets of a key, joined and grouped by it without a shuffle afterwards."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tidelayer.operators.joins import estimated_bytes

BUCKET_BYTES = 256 * 1024 * 1024


def buckets_for(*tables: DataFrame, bytes_each: int = BUCKET_BYTES, least: int = 8) -> int:
    """One number of buckets for tables that are joined, a power of two, so that the largest has buckets of about that size."""
    wanted = max(least, *(-(-estimated_bytes(df) // bytes_each) for df in tables))
    return 1 << (wanted - 1).bit_length()


def write_bucketed(df: DataFrame, name: str, key: str, buckets: int, path: str) -> DataFrame:
    """A catalog table of one sorted file per bucket. The shuffle deals rows as buckets do, so a task writes one file.

    A key with most of the rows makes one large bucket; tables with such a key are for `join_spread`.
    """
    dealt = df.repartition(buckets, key)
    dealt.write.bucketBy(buckets, key).sortBy(key).option("path", path).mode("overwrite").saveAsTable(name)
    return df.sparkSession.table(name)
