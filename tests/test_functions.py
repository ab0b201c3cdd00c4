import datetime as dt
from decimal import Decimal

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tidelayer.functions import geo, money, payload, times
from tidelayer.functions.sensitive import classify

GOOD = '{"brand_id": 3, "brand_name": "b", "total": 9.5, "items": [{"item_id": 1, "name": "x", "price": 2.0, "quantity": 2}, {"item_id": 2, "name": "y", "price": 5.5, "quantity": 1}]}'
DAMAGED = {
    "truncated": GOOD[: len(GOOD) // 2],
    "missing brace": GOOD[:-1],
    "missing quote": GOOD.replace('"', "", 1),
    "trailing comma": GOOD[:-1] + ",}",
}


def one(spark, value, expression, dtype="string"):
    return spark.createDataFrame([(value,)], f"v {dtype}").select(expression.alias("r")).first()["r"]


@pytest.mark.parametrize("body", DAMAGED.values(), ids=DAMAGED.keys())
def test_damaged_json_keeps_the_row_with_null_fields(spark, body):
    row = one(spark, body, payload.parse("v", payload.CREATED_BODY))
    assert row is not None and all(value is None for value in row)
    assert one(spark, body, payload.is_malformed("v")) is True


def test_sound_json(spark):
    row = one(spark, GOOD, payload.parse("v", payload.CREATED_BODY))
    assert (row.brand_id, row.total, len(row["items"])) == (3, 9.5, 2)
    assert one(spark, GOOD, payload.is_malformed("v")) is False
    assert one(spark, '{"other": 1}', payload.is_malformed("v")) is False
    assert one(spark, None, payload.is_malformed("v")) is False
    assert one(spark, None, payload.parse("v", payload.CREATED_BODY)) is None


def test_bad_type_nulls_only_its_field(spark):
    row = one(spark, '{"brand_id": "many", "total": 2.5}', payload.parse("v", payload.FLAT_BODY))
    assert row.brand_id is None and row.total == 2.5


def test_folds(spark):
    items = payload.parse("v", payload.CREATED_BODY).getField("items")
    assert one(spark, GOOD, payload.fold_quantity(items)) == 3
    assert one(spark, GOOD, payload.fold_amount(items)) == 9.5
    hole = '{"items": [{"quantity": 2}, {"quantity": null}]}'
    assert one(spark, hole, payload.fold_quantity(items)) is None
    assert one(spark, "{}", payload.fold_quantity(items)) is None
    assert one(spark, "{}", F.size(items)) is None


def test_event_time(spark):
    at = dt.datetime(2024, 1, 2, 3, 4, 5, 678000)
    assert one(spark, "2024-01-02T03:04:05.678000", times.event_time("v")) == at
    assert one(spark, "2024-01-02 03:04:05.678", times.event_time("v")) == at
    with pytest.raises(PySparkException):
        one(spark, "junk", times.event_time("v"))
    assert one(spark, "junk", times.event_time_lenient("v")) is None
    assert one(spark, "2024-01-02T03:04:05.678000", times.event_time_lenient("v")) == at
    assert one(spark, "2024-01-02T03:04:05", times.event_time_lenient("v")) == at.replace(microsecond=0)


def test_weekend(spark):
    rows = spark.createDataFrame([(dt.datetime(2024, 1, day),) for day in (5, 6, 7, 8)] + [(None,)], "event_timestamp timestamp")
    found = times.with_time_features(rows).collect()
    assert [r.is_weekend for r in found] == [False, True, True, False, False]
    assert [r.event_day_of_week for r in found] == [6, 7, 1, 2, None]
    assert rows.select(times.is_weekend("event_timestamp").alias("w")).collect()[-1].w is None


def test_minutes_are_whole_seconds(spark):
    row = (dt.datetime(2024, 1, 1, 0, 0, 0, 900000), dt.datetime(2024, 1, 1, 0, 1, 30, 100000))
    df = spark.createDataFrame([row, (row[0], None)], "a timestamp, b timestamp")
    assert [r.m for r in df.select(times.minutes_between("a", "b").alias("m")).collect()] == [1.5, None]


def test_money_is_exact_in_any_order(spark):
    cents = [i * 7919 % 100_003 for i in range(20_000)]
    df = spark.createDataFrame([(c / 100,) for c in cents], "v double")
    for parts in (1, 3, 7):
        row = df.repartition(parts).agg(money.total("v").alias("t"), money.mean("v").alias("m")).first()
        assert row.t == sum(cents) / 100
        assert row.m == sum(cents) / 100 / len(cents)


def summed(spark, values, dtype="double"):
    df = spark.createDataFrame([(v,) for v in values], f"v {dtype}")
    return df.agg(money.total("v").alias("t"), money.mean("v").alias("m"), money.mean_rounded("v").alias("r")).first()


def test_money_that_is_missing(spark):
    assert tuple(summed(spark, [1.25, None])) == (1.25, 1.25, 1.25)
    assert tuple(summed(spark, [None])) == (None, None, None)


@pytest.mark.parametrize("value", [float("nan"), float("inf"), 1e33])
def test_money_that_is_no_amount_fails(spark, value):
    with pytest.raises(PySparkException):
        summed(spark, [1.25, value])


def test_money_is_not_rounded_before_the_end(spark):
    assert summed(spark, [0.004] * 3).t == 0.012
    assert summed(spark, [1e17, 1.0]).t == float(10**17 + 1)
    assert summed(spark, [0.1] * 10 + [1e12, -1e12]).t == 1.0
    assert summed(spark, [-0.07, 0.01, -41.53]).t == -41.59


def test_money_beyond_bigint(spark):
    """More cents than a BIGINT holds, from amounts that are all plain."""
    df = spark.range(200_000).select(F.lit(999_999_999.99).alias("v"))
    wide = df.agg(money.total_of(money.units("v") * F.lit(10_000), money.rest("v"), 6).alias("t")).first().t
    assert wide == Decimal("999999999.99") * 200_000
    assert df.agg(money.total("v").alias("t")).first().t == float(Decimal("999999999.99") * 200_000)


def test_mean_is_rounded_half_up(spark):
    assert summed(spark, [41.54, 41.55]).r == 41.55
    assert summed(spark, [-41.54, -41.55]).r == -41.55
    assert summed(spark, [1.0, 1.0, 1.01]).r == 1.0


def test_geo(spark):
    km = geo.planar_km(F.lit(1.0), F.lit(2.0), F.lit(4.0), F.lit(6.0))
    assert one(spark, "x", km) == 5 * 111.0
    assert one(spark, "x", geo.between(F.lit(10.0), F.lit(20.0), F.lit(0.25))) == 12.5


SENSITIVE = [
    (None, None),
    ("Hello world", None),
    ("Contact: user@example.com", "PII_EMAIL"),
    ("USER@DOMAIN.ORG", "PII_EMAIL"),
    ("My SSN is 123-45-6789", "PII_SSN"),
    ("Card: 4111-1111-1111-1111", "PII_CREDIT_CARD"),
    ("Card: 4111 1111 1111 1111", "PII_CREDIT_CARD"),
    ("Card: 4111111111111111", "PII_CREDIT_CARD"),
    ("key AKIA" + "IOSFODNN7EXAMPLE", "CREDENTIAL_AWS_KEY"),
    ("token " + ".".join(["eyJhbGciOiJIUzI1NiJ9", "eyJzdWIiOiIxIn0", "abc_def-123"]), "CREDENTIAL_JWT"),
    ("Private key: 0x" + "aB3" * 21 + "f", "CREDENTIAL_PRIVATE_KEY"),
    ("a@b", None),
    ("12-34-5678 and 0x12", None),
    ("mail me@x.org, key AKIA" + "A" * 16, "CREDENTIAL_AWS_KEY"),
    ("me@x.org 123-45-6789", "PII_SSN"),
]


def test_sensitive_classes(spark):
    df = spark.createDataFrame([(i, text) for i, (text, _) in enumerate(SENSITIVE)], "i int, text string")
    found = {r.i: r.c for r in df.select("i", classify("text").alias("c")).collect()}
    assert [found[i] for i in range(len(SENSITIVE))] == [expected for _, expected in SENSITIVE]


def test_sensitive_text_at_the_end_of_a_long_text(spark):
    text = "lorem ipsum " * 20_000 + "user@example.com"
    assert one(spark, text, classify("v")) == "PII_EMAIL"


def test_time_partition(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 31, 23, 59),)], "at timestamp")
    row = df.select(*(times.time_partition("at", unit).alias(unit) for unit in ("hour", "day", "month"))).first()
    assert (row.hour, row.day, row.month) == ("2024-01-31-23", dt.date(2024, 1, 31), "2024-01")


def test_rounded_means_are_half_up(spark):
    rows = [("a", 0.01), ("a", 0.02), ("b", -0.01), ("b", -0.02), ("c", 1.0), ("c", None), ("d", None)] + [("e", v) for v in (1.0, 1.0, 1.01)]
    df = spark.createDataFrame(rows, "k string, v double").groupBy("k").agg(money.mean_rounded("v").alias("m"))
    assert {r.k: r.m for r in df.collect()} == {"a": 0.02, "b": -0.02, "c": 1.0, "d": None, "e": 1.0}
