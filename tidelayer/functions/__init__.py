"""Column expressions. All of them are built from Spark's own functions; there is no Python UDF."""
