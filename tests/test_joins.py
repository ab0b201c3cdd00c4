from pyspark.sql import functions as F

from tidelayer.operators import joins
from tidelayer.operators.grouped import keep_first
from tidelayer.operators.joins import estimated_bytes, hot_keys, join_dimension, join_spread


def skewed(spark, n=6000):
    """A third of the rows has key 7, a sixth has none, some keys are unknown."""
    key = F.when(F.col("id") % 3 == 0, F.lit(7)).when(F.col("id") % 6 == 1, F.lit(None)).otherwise(F.col("id") % 200)
    return spark.range(n).select("id", key.cast("int").alias("k"))


def dimension(spark, n=150):
    return spark.range(n).select(F.col("id").cast("int").alias("k"), F.concat(F.lit("n"), F.col("id").cast("string")).alias("name"))


def as_set(df):
    return sorted((r["id"], r["k"], r["name"]) for r in df.select("id", "k", "name").collect())


def test_bytes_decide(spark):
    small, size = dimension(spark), estimated_bytes(dimension(spark))
    assert size > 0
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "_slot" not in plan(join_dimension(skewed(spark), small, "k", max_bytes=size))
    assert "_slot" in plan(join_dimension(skewed(spark), small, "k", max_bytes=size - 1))


def test_hot_keys(spark):
    rows = skewed(spark)
    assert hot_keys(rows, "k", per_slot=1000) == {7: 3}  # about 2,000 rows and two of the others
    assert list(hot_keys(rows, "k")) == [7]
    assert hot_keys(rows.where("k is null"), "k") == {}


def test_spread_join_keeps_every_row(spark):
    plain = as_set(skewed(spark).join(dimension(spark), "k", "left"))
    assert len(plain) == 6000
    assert as_set(join_spread(skewed(spark), dimension(spark), "k", per_slot=300)) == plain
    assert as_set(join_dimension(skewed(spark), dimension(spark), "k")) == plain
    assert as_set(join_dimension(skewed(spark), dimension(spark), "k", max_bytes=0)) == plain


def test_spread_join_multiplies_matches_like_a_join(spark):
    twice = dimension(spark).unionByName(dimension(spark))
    assert as_set(join_spread(skewed(spark), twice, "k", per_slot=300)) == as_set(skewed(spark).join(twice, "k", "left"))


def test_hot_key_and_copies_are_dealt_out(spark):
    """Equal rows with one key, from several input partitions: no task gets them all."""
    copies = spark.range(4000).select(F.lit(1).alias("id"), F.lit(7).alias("k")).repartition(16)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    spark.conf.set("spark.sql.adaptive.enabled", False)
    try:
        spark.conf.set("spark.sql.shuffle.partitions", 8)
        joined = join_spread(copies, dimension(spark), "k", per_slot=40)
        sizes = [r["count"] for r in joined.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    finally:
        for key in ("autoBroadcastJoinThreshold", "adaptive.enabled"):
            spark.conf.unset(f"spark.sql.{key}")
        spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert sum(sizes) == 4000 and max(sizes) <= 2 * 4000 / 8


def test_left_join_on(spark):
    named = dimension(spark).withColumnRenamed("k", "other")
    joined = joins.join_left_on(skewed(spark), named, F.col("k") == F.col("other")).select("id", "k", "name")
    assert as_set(joined) == as_set(skewed(spark).join(dimension(spark), "k", "left"))


def test_keep_first_of_many_copies(spark):
    rows = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, F.lit(5)).otherwise(F.col("id")).alias("key"), F.col("id").alias("at"), F.lit("x").alias("v")
    )
    first = {}
    for r in rows.collect():
        first[r.key] = min(first.get(r.key, r.at), r.at)
    kept = keep_first(rows, ["key"], ["at"])
    assert kept.columns == ["key", "at", "v"]
    assert {r.key: r.at for r in kept.collect()} == first
    assert "Window" not in kept._jdf.queryExecution().toString()
