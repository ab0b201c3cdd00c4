import pytest
from pyspark.errors import PySparkException

from tidelayer.sources import catalog, formats

ROWS = [(1, "oak, red", 31), (2, "\u00e9lan", -7), (3, "x", 0), (4, 'says "no"', 2_000_000), (5, "fir", 801)]
DDL = "id INT, name STRING, value INT"


@pytest.fixture()
def sample(spark):
    return spark.createDataFrame(ROWS, DDL)


def tuples(df):
    return sorted(map(tuple, df.select("id", "name", "value").collect()))


@pytest.mark.parametrize(
    "fmt,codec",
    [("parquet", "snappy"), ("parquet", "gzip"), ("parquet", "zstd"), ("orc", "snappy"), ("orc", "zlib"), ("json", "gzip"), ("csv", None)],
)
def test_round_trip(spark, sample, tmp_path, fmt, codec):
    path = formats.write_any(sample, fmt, str(tmp_path / "t"), compression=codec)
    assert tuples(formats.read_any(spark, fmt, path, DDL)) == ROWS


def test_overwrite_replaces(spark, sample, tmp_path):
    path = formats.write_any(sample, "parquet", str(tmp_path / "t"))
    formats.write_any(sample.where("id > 3"), "parquet", path)
    assert tuples(spark.read.parquet(path)) == ROWS[3:]


def test_types_stay(spark, sample, tmp_path):
    for fmt in ("parquet", "orc"):
        back = formats.read_any(spark, fmt, formats.write_any(sample, fmt, str(tmp_path / fmt)))
        assert back.dtypes == sample.dtypes


def test_csv_inferred_declared_and_tabs(spark, sample, tmp_path):
    path = formats.write_any(sample, "csv", str(tmp_path / "c"), header="true")
    assert set(formats.read_csv(spark, path).columns) == {"id", "name", "value"}
    assert formats.read_csv(spark, path).dtypes == sample.dtypes
    declared = formats.read_csv(spark, path, DDL)
    assert declared.dtypes == sample.dtypes and tuples(declared) == ROWS
    tabs = formats.write_any(sample, "csv", str(tmp_path / "t"), header="true", sep="\t")
    assert tuples(formats.read_csv(spark, tabs, DDL, delimiter="\t")) == ROWS


def test_json_lines_and_multiline(spark, sample, tmp_path):
    path = formats.write_any(sample, "json", str(tmp_path / "j"))
    assert set(formats.read_json(spark, path).columns) == {"id", "name", "value"}
    (tmp_path / "m.json").write_text('[{"id": 12,\n\n "inner":\n {"key": "deep", "more": [1, 2]}},\n {"id": 13}]')
    rows = formats.read_json(spark, str(tmp_path / "m.json"), multiline=True).select("id", "inner.key")
    assert sorted(map(tuple, rows.collect())) == [(12, "deep"), (13, None)]


def test_text(spark, sample, tmp_path):
    path = formats.write_any(sample.select("name"), "text", str(tmp_path / "t"))
    back = formats.read_text(spark, path)
    assert back.columns == ["value"] and sorted(r.value for r in back.collect()) == sorted(r[1] for r in ROWS)


def test_partition_folders(spark, tmp_path):
    rows = spark.createDataFrame([(7, "wet", 1), (8, "dry", 1), (9, "wet", 5)], "id INT, category STRING, value INT")
    path = formats.write_any(rows, "parquet", str(tmp_path / "t"), partition_by=["category"])
    assert {p.name for p in (tmp_path / "t").glob("category=*")} == {"category=wet", "category=dry"}
    plan = spark.read.parquet(path).where("category = 'wet'")
    assert plan.count() == 2
    assert "PartitionFilters: [isnotnull(category" in plan._jdf.queryExecution().explainString(
        spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    )


def test_time_folders(spark, tmp_path):
    at = spark.sql("SELECT id, timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, id) AS at FROM range(50)")
    path = formats.write_by_time(at, str(tmp_path / "t"), "at", "hour")
    assert len(list((tmp_path / "t").glob("at_hour=*"))) == 50
    assert spark.read.parquet(path).where("at_hour = '2024-01-02-01'").count() == 1


def test_catalog_tables(spark, sample):
    try:
        assert set(catalog.LAYERS) <= set(catalog.create_layers(spark))
        catalog.replace_table(sample, "bronze.items")
        catalog.replace_table(sample.where("id < 3"), "bronze.items")
        assert tuples(spark.table("bronze.items")) == ROWS[:2]
        catalog.append_table(sample.where("id = 5").select("value", "id", "name"), "bronze.items")
        assert tuples(spark.table("bronze.items")) == ROWS[:2] + ROWS[4:]
        with pytest.raises(ValueError, match="schema mismatch"):
            catalog.append_table(sample.select("id"), "bronze.items")
        spark.sql("INSERT INTO bronze.items VALUES (9, 'nine', 900)")
        spark.sql("INSERT INTO bronze.items SELECT id + 10, name, value FROM bronze.items WHERE id = 9")
        catalog.create_as(spark, "silver.big", "SELECT id FROM {items} WHERE value > 400", items=spark.table("bronze.items"))
        assert sorted(r.id for r in spark.table("silver.big").collect()) == [5, 9, 19]
        catalog.load_tables({"gold.one": sample, "gold.two": sample.limit(1)})
        assert sorted(catalog.tables_of(spark, "gold")) == ["one", "two"]
        assert catalog.preview(spark, "gold.one", 2).count() == 2
        assert {"id", "name", "value"} <= {r.col_name for r in catalog.describe(spark, "gold.one").collect()}
        spark.sql("ALTER TABLE gold.one ADD COLUMN note STRING")
        assert {r.note for r in spark.table("gold.one").collect()} == {None}
    finally:
        catalog.drop_layers(spark)
    assert not set(catalog.LAYERS) & {r[0] for r in spark.sql("SHOW NAMESPACES").collect()}


def test_message_log_connector_is_asked_for_by_name(spark):
    from tidelayer.sources.messages import kafka_batch, kafka_stream

    for read in (kafka_batch, kafka_stream):
        with pytest.raises(PySparkException, match="(?i)kafka"):
            read(spark, "localhost:1", "t")


def test_raw_events_to_orders(spark):
    raw = spark.sql(
        """SELECT * FROM VALUES ('order', '{"order_id": "o1", "amount": 100}'), ('order', '{"order_id": "o2", "amount": 200}'),
           ('click', '{"page": "x"}') AS t(kind, payload)"""
    )
    from pyspark.sql import functions as F

    from tidelayer.plans import gold

    orders = raw.where("kind = 'order'").select(F.get_json_object("payload", "$.amount").cast("double").alias("amount"))
    row = gold.order_summary(orders).first()
    assert (row.total_orders, row.total_revenue, row.avg_order_value) == (2, 300.0, 150.0)


def test_revenue_of_type(spark):
    from tidelayer.plans import gold

    events = spark.createDataFrame([("purchase", 99.99), ("refund", 49.99), ("purchase", 149.99)], "event_type string, value double")
    row = gold.revenue_of_type(events, "purchase").first()
    assert (row.n_rows, row.n_type, row.type_revenue) == (3, 2, 249.98)
