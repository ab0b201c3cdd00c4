"""Operators for training-data pipelines: packing, counting, joining, searching, archiving, deduplication, mixing, scoring."""
