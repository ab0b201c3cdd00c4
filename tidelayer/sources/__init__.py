"""Where rows come from: Parquet tables, other file formats, and feeds derived from the tables."""

from tidelayer.sources.tables import SCHEMAS, read_declared, read_table, stream_table, table_path

__all__ = ["SCHEMAS", "read_declared", "read_table", "stream_table", "table_path"]
