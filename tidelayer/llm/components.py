"""Connected components of a graph whose edges are a table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelayer.llm.texts import written


def _is_done(edges: DataFrame) -> bool:
    """Whether each edge goes from a node that has no other to the smallest of its component."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down"))
    ends = ends.unionByName(edges.select(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    nodes = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return nodes.agg(F.count_if(F.expr("up > 1 OR (up = 1 AND down = 1)"))).first()[0] == 0


def components(edges: DataFrame) -> DataFrame:
    """`node` and `component` (the smallest node reachable) for each node of the edges `a`, `b`.

    A large star joins every larger neighbour of a node to the least of its neighbours, a small star the others. Nothing is
    gathered per node: both steps are a minimum per node and a join. The edges are written after each round, which cuts the
    lineage; the rounds grow with the logarithm of the largest component.
    """
    edges = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    while not _is_done(edges):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        lower = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = lower.groupBy("a").agg(F.min("b").alias("m"))
        small = lower.join(least, "a").select(F.explode(F.array(F.col("a"), F.col("b"))).alias("a"), F.col("m").alias("b"))
        edges = written(small.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component"))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots).groupBy("node").agg(F.min("component").alias("component"))
