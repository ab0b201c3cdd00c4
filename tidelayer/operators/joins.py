"""LEFT joins that hold when the right side is large or one key has a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


def estimated_bytes(df: DataFrame) -> int:
    """Spark's own estimate of a plan's size, from file sizes and schemas. Runs no job."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def broadcast_limit(df: DataFrame) -> int:
    """`spark.sql.autoBroadcastJoinThreshold` in bytes."""
    java = df.sparkSession._jsparkSession.sessionState().conf()
    return java.autoBroadcastJoinThreshold()


def join_dimension(fact: DataFrame, dim: DataFrame, on: str, max_bytes: int | None = None) -> DataFrame:
    """fact LEFT JOIN dim USING (on): Spark's broadcast when dim is within Spark's limit, else spread over the cluster.

    The limit is that of the session unless another is given; the estimate and the limit are both in bytes.
    """
    limit = broadcast_limit(dim) if max_bytes is None else max_bytes
    if estimated_bytes(dim) <= limit:
        return fact.join(dim, on, "left")
    return join_spread(fact, dim, on)


def hot_keys(df: DataFrame, on: str, per_slot: int | None = None) -> dict:
    """Keys with more rows than a slot holds, with the number of slots each needs.

    A slot holds `per_slot` rows, by default an even share of all rows per shuffle partition. Fewer keys than there are
    shares can have more than one share, so the largest so many counts are enough. One scan, which reads the key column.
    """
    shares = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counted = Observation()
    counts = df.observe(counted, F.count(F.lit(1)).alias("n")).groupBy(F.col(on).alias("key")).agg(F.count(F.lit(1)).alias("n"))
    top = counts.where("key IS NOT NULL").orderBy(F.desc("n"), "key").limit(shares).collect()
    if not top:
        return {}
    even = per_slot or max(1, counted.get["n"] // shares)
    return {row["key"]: -(-row["n"] // even) for row in top if row["n"] > even}


def join_spread(fact: DataFrame, dim: DataFrame, on: str, per_slot: int | None = None) -> DataFrame:
    """fact LEFT JOIN dim USING (on) as a shuffled join in which no key is bound to one task.

    Rows of a hot key are dealt over as many slots as its count needs, rows without a key over as many as there are shuffle
    partitions; the dimension rows of hot keys are repeated once per slot. All other keys stay in slot 0. Every row is kept.
    The slot depends on the row and on its input partition, both of which a retried task sees again, and it also parts
    copies of one row that come from different partitions.
    """
    shares = int(fact.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kind = fact.schema[on].dataType.simpleString()
    hot = fact.sparkSession.createDataFrame(list(hot_keys(fact, on, per_slot).items()), f"`{on}` {kind}, _slots INT")
    few = F.broadcast(hot)  # fewer rows than shuffle partitions
    dealt = F.pmod(F.xxhash64(*fact.columns) + F.spark_partition_id(), F.lit(2**31 - 1))
    own = F.when(F.col(on).isNull(), F.lit(shares)).otherwise(F.coalesce("_slots", F.lit(1)))
    spread_fact = fact.withColumn("_dealt", dealt).join(few, on, "left").withColumn("_slot", F.pmod("_dealt", own).cast("int")).drop("_dealt", "_slots")
    slots = F.sequence(F.lit(0), F.coalesce("_slots", F.lit(1)) - 1)
    spread_dim = dim.join(few, on, "left").withColumn("_slot", F.explode(slots)).drop("_slots")
    return spread_fact.join(spread_dim, [on, "_slot"], "left").drop("_slot")


def join_left_on(left: DataFrame, right: DataFrame, condition: Column) -> DataFrame:
    """LEFT equi-join with differing key names; Spark picks the strategy by size."""
    return left.join(right, condition, "left")
