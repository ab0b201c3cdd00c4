"""Changes to tables: each query loads a table below the shared folder, changes it and reads it back."""

from __future__ import annotations

import datetime as dt
import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelayer.functions import money
from tidelayer.operators.versions import VersionedTable, rewrite_partitions, updated
from tidelayer.session import run_dir
from tidelayer.sources import catalog, read_table
from tidelayer.streaming.jobs import shuffle_partitions
from tidelayer.suite.common import cents


def _orders(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")


def _name(spark: SparkSession, kind: str) -> str:
    """A table name of its own for one run."""
    return f"{kind}_{run_dir(spark, kind).rsplit('-', 1)[1]}"


def _loaded(spark: SparkSession, df: DataFrame, name: str, partition_by: tuple[str, ...] = ()) -> VersionedTable:
    return VersionedTable.create(spark, run_dir(spark, name), df, partition_by)


def table_update(spark, sf):
    """Close open orders above an amount, and set a status where there is none."""
    table = _loaded(spark, _orders(spark, sf).withColumn("note", F.when(F.col("o_orderstatus") == "F", "done")), "update")
    table.update("o_orderstatus = 'O' AND o_totalprice > 300000", {"o_orderstatus": "'X'", "o_totalprice": "o_totalprice - 1"})
    table.update("note IS NULL", {"note": "'none'"})
    return table.read()


def table_delete(spark, sf):
    table = _loaded(spark, _orders(spark, sf), "delete")
    table.delete("o_orderstatus = 'F'")
    return table.read()


def table_add_column(spark, sf):
    """A column is added, customers of one segment are appended with it, a column gets a new name."""
    customers = read_table(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment")
    table = _loaded(spark, customers.where("c_mktsegment != 'BUILDING'"), "evolve")
    table.add_column("email", "STRING")
    late = customers.where("c_mktsegment = 'BUILDING'")
    table.append(late.withColumn("email", F.concat(F.lit("c"), F.col("c_custkey").cast("string"), F.lit("@example.com"))))
    table.rename_column("c_mktsegment", "segment")
    return table.read()


def table_time_travel(spark, sf):
    """Rows and balance of every version, each read back by its number."""
    table = _loaded(spark, read_table(spark, sf, "supplier").select("s_suppkey", "s_acctbal"), "travel")
    table.update("s_acctbal < 0", {"s_acctbal": "0"})
    table.delete("s_acctbal > 5000")

    def summary(version: int) -> DataFrame:
        return table.read(version=version).agg(
            F.lit(version).cast("bigint").alias("version"), F.count(F.lit(1)).alias("n_rows"), money.total("s_acctbal").alias("balance")
        )

    return summary(1).unionByName(summary(2)).unionByName(summary(3))


def table_history(spark, sf):
    """Operations and row counts per version."""
    table = _loaded(spark, _orders(spark, sf), "history")
    table.delete("o_totalprice < 10000")
    table.add_column("note", "STRING")
    table.compact()
    return table.history().select("version", "operation", "n_rows")


def table_partitions(spark, sf):
    """Rows per partition of a partitioned table."""
    table = _loaded(spark, _orders(spark, sf), "partitions", ("o_orderstatus",))
    return table.partitions().select("o_orderstatus", "n_rows")


def table_compact(spark, sf):
    """Many small files become few; the rows stay."""
    customers = read_table(spark, sf, "customer").select("c_custkey", "c_acctbal")
    table = _loaded(spark, customers.repartition(3 * shuffle_partitions(customers)), "compact")
    table.compact()
    return table.read()


def table_append(spark, sf):
    """Orders loaded status by status into one table."""
    orders = _orders(spark, sf)
    name = _name(spark, "append")
    catalog.replace_table(orders.where("o_orderstatus = 'F'"), name)
    for status in ("O", "P"):
        catalog.append_table(orders.where(F.col("o_orderstatus") == status), name)
    return spark.table(name)


def table_insert_select(spark, sf):
    """INSERT INTO .. SELECT and VALUES, with the time and the run that loaded a row, which hold for all rows of a run."""
    name = _name(spark, "insert")
    customers = read_table(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    spark.sql(f"CREATE TABLE {name} (c_custkey BIGINT, c_mktsegment STRING, processed_at TIMESTAMP, run_id STRING) USING parquet")
    catalog.insert_select(spark, name, "SELECT c_custkey, c_mktsegment, current_timestamp(), uuid() FROM {customers}", customers=customers)
    catalog.insert_values(spark, name, [(-1, "NONE", None, "by hand")])
    loaded = spark.table(name)
    bounds = loaded.agg(F.min("processed_at").alias("first"), F.max("processed_at").alias("last"))
    recent = bounds.select((F.col("last") <= F.current_timestamp()) & (F.col("first") == F.col("last"))).scalar()
    return loaded.select("c_custkey", "c_mktsegment", recent.alias("one_time"), (F.length("run_id") == 36).alias("has_run"))


def load_tables(spark, sf):
    """Dimensions and facts overwritten by name, twice; rows per table."""
    names = {table: _name(spark, table) for table in ("region", "nation", "customer", "orders")}
    for _ in range(2):
        catalog.load_tables({name: read_table(spark, sf, table) for table, name in names.items()})
    counts = [spark.table(name).agg(F.lit(table).alias("table_name"), F.count(F.lit(1)).alias("n_rows")) for table, name in names.items()]
    return functools.reduce(DataFrame.unionByName, counts)


def append_refused(spark, sf):
    """Rows of a table before and after appends that its schema refuses: too few columns, and another type."""
    name = _name(spark, "refused")
    suppliers = read_table(spark, sf, "supplier").select("s_suppkey", "s_nationkey")
    catalog.replace_table(suppliers, name)
    before = spark.table(name).agg(F.count(F.lit(1)).alias("rows_before"))
    refused = 0
    for rows in (suppliers.select("s_suppkey"), suppliers.withColumn("s_nationkey", F.col("s_nationkey").cast("string"))):
        try:
            catalog.append_table(rows, name)
        except ValueError:
            refused += 1
    after = spark.table(name).agg(F.count(F.lit(1)).alias("n")).scalar()
    return before.select("rows_before", after.alias("rows_after"), F.lit(refused).alias("refused"))


def table_described(spark, sf):
    """Columns of a table as the catalog describes them."""
    name = _name(spark, "described")
    catalog.replace_table(_orders(spark, sf), name)
    return catalog.columns_of(spark, name)


def table_expire(spark, sf):
    """Versions that are left when old ones are taken out, with the rows each still reads."""
    table = _loaded(spark, _orders(spark, sf), "expire")
    table.delete("o_orderstatus = 'F'")
    table.delete("o_orderstatus = 'P'")
    table.expire(dt.datetime.now() + dt.timedelta(days=1), retain_last=2)
    versions = [row["version"] for row in table.history().orderBy("version").collect()]
    counts = [table.read(version=v).agg(F.lit(v).cast("bigint").alias("version"), F.count(F.lit(1)).alias("n_rows")) for v in versions]
    return functools.reduce(DataFrame.unionByName, counts)


def table_rewrite(spark, sf):
    """An update that touches some partitions of a partitioned table and leaves the others' files alone."""
    path = run_dir(spark, "rewrite")
    _orders(spark, sf).write.partitionBy("o_orderstatus").parquet(path)
    condition = "o_orderstatus = 'P' AND o_totalprice > 100000"
    rewrite_partitions(spark, path, "o_orderstatus", condition, lambda df: updated(df, condition, {"o_custkey": "-1"}))
    return spark.read.parquet(path)


QUERIES = {
    f.__name__: f
    for f in (
        table_update,
        table_delete,
        table_add_column,
        table_time_travel,
        table_history,
        table_partitions,
        table_compact,
        table_append,
        table_insert_select,
        load_tables,
        append_refused,
        table_described,
        table_expire,
        table_rewrite,
    )
}

_BALANCE = cents("s_acctbal")

ORACLE = {
    "table_update": """SELECT o_orderkey, o_custkey,
        CASE WHEN o_orderstatus = 'O' AND o_totalprice > 300000 THEN 'X' ELSE o_orderstatus END AS o_orderstatus,
        CASE WHEN o_orderstatus = 'O' AND o_totalprice > 300000 THEN o_totalprice - 1 ELSE o_totalprice END AS o_totalprice,
        CASE WHEN o_orderstatus = 'F' THEN 'done' ELSE 'none' END AS note FROM orders""",
    "table_delete": "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderstatus <> 'F'",
    "table_add_column": """SELECT c_custkey, c_name, c_mktsegment AS segment,
        CASE WHEN c_mktsegment = 'BUILDING' THEN 'c' || CAST(c_custkey AS VARCHAR) || '@example.com' END AS email FROM customer""",
    "table_time_travel": f"""SELECT CAST(1 AS BIGINT) AS version, count(*) AS n_rows, {_BALANCE} AS balance FROM supplier
        UNION ALL SELECT 2, count(*), {cents("greatest(s_acctbal, 0)")} FROM supplier
        UNION ALL SELECT 3, count(*), {cents("greatest(s_acctbal, 0)")} FROM supplier WHERE s_acctbal <= 5000""",
    "table_history": """SELECT CAST(1 AS BIGINT) AS version, 'create' AS operation, count(*) AS n_rows FROM orders
        UNION ALL SELECT 2, 'delete', count(*) FROM orders WHERE o_totalprice >= 10000
        UNION ALL SELECT 3, 'add column', count(*) FROM orders WHERE o_totalprice >= 10000
        UNION ALL SELECT 4, 'compact', count(*) FROM orders WHERE o_totalprice >= 10000""",
    "table_partitions": "SELECT o_orderstatus, count(*) AS n_rows FROM orders GROUP BY 1",
    "table_compact": "SELECT c_custkey, c_acctbal FROM customer",
    "table_append": "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders",
    "table_insert_select": """SELECT c_custkey, c_mktsegment, TRUE AS one_time, TRUE AS has_run FROM customer
        UNION ALL SELECT -1, 'NONE', TRUE, FALSE""",
    "load_tables": " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n_rows FROM {t}" for t in ("region", "nation", "customer", "orders")),
    "append_refused": "SELECT count(*) AS rows_before, count(*) AS rows_after, CAST(2 AS INTEGER) AS refused FROM supplier",
    "table_described": """SELECT * FROM (VALUES ('o_orderkey', 'bigint'), ('o_custkey', 'bigint'), ('o_orderstatus', 'string'),
        ('o_totalprice', 'double')) AS t(column_name, column_type) WHERE EXISTS (SELECT 1 FROM orders)""",
    "table_expire": """SELECT CAST(2 AS BIGINT) AS version, count(*) AS n_rows FROM orders WHERE o_orderstatus <> 'F'
        UNION ALL SELECT 3, count(*) FROM orders WHERE o_orderstatus NOT IN ('F', 'P')""",
    "table_rewrite": """SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' AND o_totalprice > 100000 THEN -1 ELSE o_custkey END AS o_custkey,
        o_totalprice, o_orderstatus FROM orders""",
}
