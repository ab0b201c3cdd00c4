"""Views kept up to date: each delivery adds partial aggregates, and only the days it touches are written again.

Partial aggregates lie in folders by day and delivery, the view in folders by day. A delivery that comes again with the same
rows replaces what it wrote before, so a restart neither loses nor doubles any. Nothing that came earlier is read but the partials of touched days.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DYNAMIC = ("partitionOverwriteMode", "dynamic")


class DailyView:
    """`partial` maps rows to aggregates per key, `merge` says how two partial values of one name become one.

    The day is one of the keys. Aggregates have to add up: counts, sums, minima, maxima, sketches, bitmaps.
    """

    def __init__(self, spark: SparkSession, path: str, day: str, keys: Sequence[str], partial: Callable[[DataFrame], DataFrame], merge: dict[str, Callable[[str], Column]]):
        self.spark, self.path, self.day, self.keys, self.partial, self.merge = spark, path, day, list(keys), partial, merge
        self.schema = None

    def take(self, rows: DataFrame, delivery: int) -> None:
        """Adds a delivery and brings the days it touches up to date."""
        partial = self.partial(rows).withColumn("delivery", F.lit(delivery))
        self.schema = partial.schema
        folders = [self.day, "delivery"]
        partial.hint("rebalance", self.day).write.mode("overwrite").option(*DYNAMIC).partitionBy(*folders).parquet(f"{self.path}/partials")
        partials = self._read("partials", self.schema)
        touched = partials.where(F.col("delivery") == delivery).select(self.day).distinct()
        days = F.broadcast(touched)  # days of one delivery: 3,650 in ten years
        values = [how(name).alias(name) for name, how in self.merge.items()]
        whole = partials.join(days, self.day, "left_semi").groupBy(*self.keys).agg(*values)
        whole.hint("rebalance", self.day).write.mode("overwrite").option(*DYNAMIC).partitionBy(self.day).parquet(f"{self.path}/view")

    def _read(self, name: str, schema) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")

    def read(self) -> DataFrame:
        """The view as of the last delivery."""
        view = self._read("view", self.schema)
        return view.select(*self.keys, *self.merge)
