import json

from pyspark.sql import functions as F

from tidelayer.operators.guard import BLOCK_RULES, BLOCK_SCHEMA, ORDER_RULES, ORDER_SCHEMA, guard, route

JWT = ".".join(["eyJhbGciOiJIUzI1NiJ9", "eyJzdWIiOiIxIn0", "abc_def-123"])
# number, gas used, transactions, miner is zero, text, reasons
BLOCKS = [
    (1000001, 8_000_000, 150, False, "plain", []),
    (1000002, 14_550_000, 180, False, "plain", ["HIGH_GAS_USAGE"]),
    (1000003, 0, 0, False, "plain", ["EMPTY_BLOCK"]),
    (1000004, 5_000_000, 100, False, "user@example.com", ["PII_EMAIL"]),
    (1000005, 7_500_000, 200, False, "plain", []),
    (1000006, 6_000_000, 120, True, "plain", ["ZERO_MINER"]),
    (1000007, 12_000_000, 600, False, "plain", ["HIGH_TX_COUNT"]),
    (1000008, 4_000_000, 80, False, "SSN 123-45-6789", ["PII_SSN"]),
    (1000009, 3_500_000, 90, False, "4111-1111-1111-1111", ["PII_CREDIT_CARD"]),
    (1000010, 5_500_000, 110, False, "AKIA" + "IOSFODNN7EXAMPLE", ["CREDENTIAL_AWS_KEY"]),
    (1000011, 14_800_000, 300, False, "admin@example.com", ["HIGH_GAS_USAGE", "PII_EMAIL"]),
    (1000012, 4_500_000, 95, False, JWT, ["CREDENTIAL_JWT"]),
]


def block(number, gas, transactions, zero, text):
    return (number, f"0xh{number}", "0xp", "0x" + "0" * 40 if zero else "0xminer", gas, 15_000_000, transactions, 1, "5", text)


def test_seeded_blocks(spark):
    df = spark.createDataFrame([block(*row[:5]) for row in BLOCKS], BLOCK_SCHEMA)
    found = {r.block_number: r for r in guard(df, BLOCK_RULES, ["extra_data"]).collect()}
    assert {n: found[n].validation_reasons for n in found} == {row[0]: row[5] for row in BLOCKS}
    assert {n: found[n].decision for n in found} == {row[0]: "QUARANTINE" if row[5] else "ALLOW" for row in BLOCKS}
    assert sum(r.decision == "ALLOW" for r in found.values()) == 2


def test_gas_limit_is_strict(spark):
    df = spark.createDataFrame([block(1, 14_250_000, 5, False, "x"), block(2, 14_250_001, 5, False, "x")], BLOCK_SCHEMA)
    found = {r.block_number: r.validation_reasons for r in guard(df, BLOCK_RULES).collect()}
    assert found == {1: [], 2: ["HIGH_GAS_USAGE"]}


def test_unparsed_message_is_allowed_unless_asked(spark):
    df = spark.createDataFrame([('{"block_number": 1, "transaction_count": 3}',), ('{"block_number": ',), (None,)], "value string")
    parsed = df.select("value", F.from_json("value", BLOCK_SCHEMA).alias("d")).select("value", "d.*")
    assert {r.decision for r in guard(parsed, BLOCK_RULES, ["extra_data"]).collect()} == {"ALLOW"}
    malformed = F.col("value").isNull() | F.try_parse_json("value").isNull()
    reasons = {r.value: r.validation_reasons for r in guard(parsed, BLOCK_RULES, ["extra_data"], malformed_if=malformed).collect()}
    assert reasons == {'{"block_number": 1, "transaction_count": 3}': [], '{"block_number": ': ["MALFORMED"], None: ["MALFORMED"]}


def test_order_rules(spark):
    rows = [
        ("a", "x", 200.0, 7, "ok"),
        ("b", "x", 200.01, 7, "ok"),
        ("c", "x", 10.0, 8, "AKIA" + "A" * 16),
        ("d", None, None, None, None),
    ]
    df = guard(spark.createDataFrame(rows, ORDER_SCHEMA), ORDER_RULES, reasons="reasons")
    found = {r.order_id: r.reasons for r in df.collect()}
    assert found == {"a": [], "b": ["HIGH_TOTAL"], "c": ["TOO_MANY_ITEMS", "LEAKED_SECRET"], "d": []}


def test_route(spark):
    df = spark.createDataFrame([block(*row[:5]) for row in BLOCKS], BLOCK_SCHEMA)
    sent = route(guard(df, BLOCK_RULES, ["extra_data"]), "block_hash", "out", ["block_number", "decision", "validation_reasons"]).collect()
    assert {r.topic for r in sent} == {"out-allowed", "out-quarantine"}
    values = {r.key: json.loads(r.value) for r in sent}
    assert values["0xh1000011"] == {"block_number": 1000011, "decision": "QUARANTINE", "validation_reasons": ["HIGH_GAS_USAGE", "PII_EMAIL"]}
    assert all((v["decision"] == "ALLOW") == (r.topic == "out-allowed") for r in sent for v in [json.loads(r.value)])
