"""Summaries that add up: kept per day, merged per month, never computed from the rows again."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PRECISION = 1600  # of a quantile sketch: a rank is off by less than 0.3 % then, whatever the number of rows


def quantile_sketches(df: DataFrame, keys: Sequence[str | Column], value: str, name: str = "sketch") -> DataFrame:
    """A mergeable sketch of the values per group; at most some 30 KB, however many rows."""
    return df.groupBy(*keys).agg(F.kll_sketch_agg_double(F.col(value).cast("double"), F.lit(PRECISION)).alias(name))


def merged_sketches(sketches: DataFrame, keys: Sequence[str | Column], name: str = "sketch") -> DataFrame:
    """Sketches of finer groups made one per coarser group."""
    return sketches.groupBy(*keys).agg(F.kll_merge_agg_double(name).alias(name))


def quantile(sketch: str, share: float) -> Column:
    return F.kll_sketch_get_quantile_double(sketch, F.lit(share))


def id_bitmaps(df: DataFrame, keys: Sequence[str], id_col: str) -> DataFrame:
    """Whole-number ids per group as bitmaps of 32,768 neighbouring ids each, combined on the map side.

    What is shuffled is bounded by groups times buckets of ids, not by ids; that pays for ids that are dense. NULL is no id.
    """
    bucket, bit = F.bitmap_bucket_number(id_col), F.bitmap_bit_position(id_col)
    return df.where(F.col(id_col).isNotNull()).groupBy(*keys, bucket.alias("bucket")).agg(F.bitmap_construct_agg(bit).alias("bitmap"))


def distinct_of(bitmaps: DataFrame, keys: Sequence[str], name: str = "n_distinct") -> DataFrame:
    """Exact distinct ids per group of bitmaps, for any part of the keys they were made by."""
    united = bitmaps.groupBy(*keys, "bucket").agg(F.bitmap_or_agg("bitmap").alias("bitmap"))
    return united.groupBy(*keys).agg(F.sum(F.bitmap_count("bitmap")).alias(name))
