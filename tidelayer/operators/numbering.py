"""Gapless row numbers over a whole table, without a window over all of it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidelayer.session import run_dir


def numbered(df: DataFrame, order: Sequence[str], name: str = "row_number") -> DataFrame:
    """Adds 1, 2, 3, ... in the order of columns that tell all rows apart.

    Rows go to ranges of that order, which are written once (ranges are sampled and would differ in a second reading). A range
    counts its rows; the counts of those before it, one number per range, are its offset; and numbers within are a window of one
    range. No task has more than its range. Equal rows are numbered too, but in no certain order.
    """
    ranged = df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id())
    path = run_dir(df.sparkSession, "ranges")
    ranged.write.parquet(path)
    ranges = df.sparkSession.read.schema(ranged.schema).parquet(path)
    counts = ranges.groupBy("_range").agg(F.count(F.lit(1)).alias("_rows"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # over one row per range
    offsets = counts.select("_range", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset"))
    within = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return ranges.join(F.broadcast(offsets), "_range").withColumn(name, F.col("_offset") + within).drop("_range", "_offset")
