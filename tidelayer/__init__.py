"""tidelayer: layered event-data analytics as Spark DataFrame and SQL plans."""
