"""What a graph of edges reaches, over any number of hops."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelayer.session import run_dir


def _kept(df: DataFrame, name: str) -> DataFrame:
    path = run_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def closure(edges: DataFrame, source: str = "source", target: str = "target") -> DataFrame:
    """`source`, `target`, `depth`: pairs joined by a path, with the length of the shortest one.

    Each round takes the pairs found in the round before one edge further and leaves out pairs that are known, so cycles end
    (a node on one reaches itself) and no path is listed. A round is a join and an anti-join; rounds are as many as the longest
    of the shortest paths. Every round is written, so plans do not grow.
    """
    step = edges.select(F.col(source).alias("source"), F.col(target).alias("target")).where("source IS NOT NULL AND target IS NOT NULL").distinct()
    step = _kept(step, "edges")
    depth = 1
    known = newest = _kept(step.withColumn("depth", F.lit(1)), "reach-1")
    while True:
        depth += 1
        onward = step.select(F.col("source").alias("target"), F.col("target").alias("next"))
        further = newest.join(onward, "target").select("source", F.col("next").alias("target")).distinct()
        newest = _kept(further.join(known, ["source", "target"], "left_anti").withColumn("depth", F.lit(depth)), f"reach-{depth}")
        if newest.isEmpty():
            return known
        known = known.unionByName(newest)
