"""JSON of unknown shape: parsed once per row as VARIANT, its shape merged over all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def merged_shapes(df: DataFrame, key: str, body: str) -> DataFrame:
    """Per key: rows, rows that are no JSON, and the schema that all others fit, as a type. Combined on the map side."""
    parsed = df.select(key, F.col(body).isNotNull().alias("there"), F.try_parse_json(body).alias("doc"))
    return parsed.groupBy(key).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(F.col("there") & F.col("doc").isNull()).alias("n_malformed"),
        F.schema_of_variant_agg("doc").alias("shape"),
    )


def field_shapes(df: DataFrame, key: str, body: str) -> DataFrame:
    """Per key and field at the top: rows that have it, and the type its values share."""
    parsed = df.select(key, F.try_parse_json(body).alias("doc"))
    fields = parsed.lateralJoin(parsed.sparkSession.tvf.variant_explode(F.col("doc").outer()))
    return fields.where("key IS NOT NULL").groupBy(F.col(key).alias("kind"), F.col("key").alias("field")).agg(
        F.count(F.lit(1)).alias("n_rows"), F.schema_of_variant_agg("value").alias("type")
    )
