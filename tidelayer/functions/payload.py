"""JSON payloads in a string column, and the arrays inside them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Payload shapes of the order feed.
CREATED_BODY = (
    "customer_lat DOUBLE, customer_lon DOUBLE, brand_id INT, brand_name STRING, "
    "items ARRAY<STRUCT<item_id: INT, name: STRING, price: DOUBLE, quantity: INT>>, total DOUBLE"
)
FLAT_BODY = (
    "brand_id INT, item_ids STRING, total DOUBLE, customer_lat DOUBLE, customer_lon DOUBLE, driver_id STRING"
)
BRIEF_BODY = "brand_id INT, brand_name STRING, total DOUBLE, items ARRAY<STRUCT<quantity: INT>>"


def parse(body: str | Column, schema) -> Column:
    """JSON text to struct. What does not parse has all fields NULL; the row stays."""
    return F.from_json(body, schema)


def is_malformed(body: str | Column) -> Column:
    """True for text that is no JSON. Valid JSON without the expected keys is not malformed."""
    text = F.col(body) if isinstance(body, str) else body
    return text.isNotNull() & F.try_parse_json(text).isNull()


def fold_quantity(items: str | Column) -> Column:
    """Sum of item quantities; NULL when one of them, or the array, is missing."""
    return F.aggregate(items, F.lit(0), lambda total, item: total + item["quantity"])


def fold_amount(items: str | Column) -> Column:
    """Sum of price times quantity over the items."""
    return F.aggregate(items, F.lit(0.0), lambda total, item: total + item["price"] * item["quantity"])


def present(values: Sequence[Column]) -> Column:
    """The values that are there, in their order; an empty array when there is none."""
    return F.array_compact(F.array(*values))
