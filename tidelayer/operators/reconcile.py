"""Reconciliation of two layers by content: which rows do they not share, and how often does each have them.

Counts and totals pass two opposite errors. Here the rows of either side are summed up per bucket of their key as a multiset
hash (a count and three sums of 21 bits each of a hash of all columns, which do not overflow below 4e12 rows a bucket), combined
on the map side. Only buckets whose sums differ are looked at again: first in finer cells of the same kind, then row by row.
Rows of buckets that agree are read, but never shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS, CELLS = 4096, 64  # the broadcast list of cells that differ has no more rows than their product


def row_hash(columns: Sequence[str], seed: int = 0) -> Column:
    """64 bits of all values; a NULL counts by its place, so (NULL, 1) and (1, NULL) differ."""
    return F.xxhash64(F.lit(seed), *(part for c in columns for part in (F.col(c).isNull(), F.col(c))))


def multiset_hash(df: DataFrame, by: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Per group: rows, and three sums that do not depend on their order but on how often each row occurs."""
    hashed = df.withColumn("_hash", row_hash(columns, seed=1))
    parts = [F.sum(F.shiftrightunsigned("_hash", 21 * k).bitwiseAND(F.lit(2**21 - 1))).alias(f"_sum{k}") for k in range(3)]
    return hashed.groupBy(*by).agg(F.count(F.lit(1)).alias("_rows"), *parts)


def differing(left: DataFrame, right: DataFrame, by: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Groups whose rows are not the same on both sides. Either side gives one row per group and task to the shuffle."""
    both = multiset_hash(left, by, columns).unionByName(multiset_hash(right, by, columns).withColumns({c: -F.col(c) for c in ("_rows", "_sum0", "_sum1", "_sum2")}))
    sums = [F.sum(c).alias(c) for c in ("_rows", "_sum0", "_sum1", "_sum2")]
    return both.groupBy(*by).agg(*sums).where("_rows != 0 OR _sum0 != 0 OR _sum1 != 0 OR _sum2 != 0").select(*by)


def suspects(left: DataFrame, right: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Rows of both sides in cells that differ: what has to be compared row by row."""
    key = row_hash(keys)
    placed = [df.select(*columns).withColumn("_bucket", F.pmod(key, F.lit(BUCKETS))).withColumn("_cell", F.pmod(F.shiftright(key, 20), F.lit(CELLS))) for df in (left, right)]
    for by in (["_bucket"], ["_bucket", "_cell"]):
        wrong = F.broadcast(differing(*placed, by, columns))  # at most BUCKETS rows, then BUCKETS * CELLS
        placed = [df.join(wrong, by, "left_semi") for df in placed]
    return tuple(df.select(*columns) for df in placed)


def reconcile(left: DataFrame, right: DataFrame, keys: Sequence[str], columns: Sequence[str] | None = None) -> DataFrame:
    """Rows that the two sides do not have equally often, with `left_rows` and `right_rows`; empty where the layers agree.

    A row that was changed comes twice, as it was and as it is. Columns are those of `left` unless given; types must agree.
    """
    columns = list(columns or left.columns)
    ours, theirs = suspects(left, right, keys, columns)
    one, none = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
    marked = ours.withColumns({"_left": one, "_right": none}).unionByName(theirs.withColumns({"_left": none, "_right": one}))
    counted = marked.groupBy(*columns).agg(F.sum("_left").alias("left_rows"), F.sum("_right").alias("right_rows"))
    return counted.where("left_rows != right_rows")
