"""Parquet tables of a data folder, in batch and as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import TimestampNTZType

# Declared schemas: reading with one of these costs no footer inference while a graph is analysed.
SCHEMAS = {
    "region": "r_regionkey INT, r_name STRING",
    "nation": "n_nationkey INT, n_name STRING, n_regionkey INT",
    "customer": "c_custkey BIGINT, c_name STRING, c_nationkey INT, c_acctbal DOUBLE, c_mktsegment STRING",
    "supplier": "s_suppkey BIGINT, s_name STRING, s_nationkey INT, s_acctbal DOUBLE",
    "part": "p_partkey BIGINT, p_name STRING, p_brand STRING, p_type STRING, p_size INT, p_retailprice DOUBLE",
    "orders": (
        "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE, "
        "o_orderdate TIMESTAMP_NTZ, o_orderpriority STRING"
    ),
    "lineitem": (
        "l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT, l_quantity DOUBLE, "
        "l_extendedprice DOUBLE, l_discount DOUBLE, l_tax DOUBLE, l_returnflag STRING, "
        "l_linestatus STRING, l_shipdate TIMESTAMP_NTZ"
    ),
    "events": (
        "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING"
    ),
    "documents": "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT",
    "labels": "doc_id BIGINT, quality INT, toxic INT",
    "conversations": "conv_id BIGINT, turn BIGINT, role STRING, text STRING",
}


def table_path(sf_dir: str, name: str) -> str:
    return f"{sf_dir.rstrip('/')}/{name}.parquet"


def zoned(df: DataFrame) -> DataFrame:
    """Zoneless timestamps as TIMESTAMP: watermarks and unix_timestamp accept nothing else."""
    casts = {
        field.name: F.col(field.name).cast("timestamp")
        for field in df.schema.fields
        if isinstance(field.dataType, TimestampNTZType)
    }
    return df.withColumns(casts) if casts else df


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Schema from the Parquet footer as it is now."""
    return zoned(spark.read.parquet(table_path(sf_dir, name)))


def read_declared(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Declared schema, no inference."""
    return zoned(spark.read.schema(SCHEMAS[name]).parquet(table_path(sf_dir, name)))


def is_folder(spark: SparkSession, path: str) -> bool:
    """Asked of the file system that the path belongs to."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(place).isDirectory()


def stream_table(spark: SparkSession, sf_dir: str, name: str, max_files: int | None = None) -> DataFrame:
    """The table as a file stream: its folder, or the one file of that name among its neighbours."""
    reader = spark.readStream.schema(SCHEMAS[name])
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    path = table_path(sf_dir, name)
    if is_folder(spark, path):
        return zoned(reader.parquet(path))
    return zoned(reader.option("pathGlobFilter", path.rsplit("/", 1)[1]).parquet(path.rsplit("/", 1)[0]))
