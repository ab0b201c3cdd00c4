import datetime as dt
import time

import pytest
from pyspark.sql import functions as F

from tidelayer.operators.versions import VersionedTable, remaining, rewrite_partitions, updated


def test_update_changes_only_rows_that_hold(spark):
    df = spark.createDataFrame([("p1", 9.99), ("p2", 19.99), ("p3", None)], "id string, price double")
    assert {r.id: r.price for r in updated(df, "id = 'p1'", {"price": "14.99"}).collect()} == {"p1": 14.99, "p2": 19.99, "p3": None}
    assert {r.id: r.price for r in updated(df, "price > 10", {"price": "0"}).collect()} == {"p1": 9.99, "p2": 0.0, "p3": None}
    assert {r.id: r.price for r in updated(df, "price IS NULL", {"price": "1"}).collect()}["p3"] == 1.0
    swapped = updated(spark.createDataFrame([(1, 2)], "a int, b int"), F.lit(True), {"a": "b", "b": "a"}).first()
    assert (swapped.a, swapped.b) == (2, 1)


def test_delete_keeps_rows_whose_condition_is_null(spark):
    df = spark.createDataFrame([("l1", "INFO"), ("l2", "ERROR"), ("l3", None)], "id string, level string")
    assert {r.id for r in remaining(df, "level = 'ERROR'").collect()} == {"l1", "l3"}


@pytest.fixture()
def metrics(spark, tmp_path):
    rows = spark.createDataFrame([("cpu", 50.0)], "name string, value double")
    return VersionedTable.create(spark, str(tmp_path / "metrics"), rows)


def test_time_travel(spark, metrics):
    time.sleep(0.05)
    between = dt.datetime.now()
    time.sleep(0.05)
    metrics.update("name = 'cpu'", {"value": "75.0"})
    assert metrics.read().first()["value"] == 75.0
    assert metrics.read(version=1).first()["value"] == 50.0
    assert metrics.read(as_of=between).first()["value"] == 50.0
    assert VersionedTable(spark, metrics.path).read().first()["value"] == 75.0
    with pytest.raises(LookupError):
        metrics.read(version=9)
    with pytest.raises(LookupError):
        metrics.read(as_of=dt.datetime(2001, 1, 1))


def test_create_twice_fails(spark, metrics):
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        VersionedTable.create(spark, metrics.path, metrics.read())


def test_schema_changes(spark, metrics):
    metrics.add_column("unit", "STRING")
    assert metrics.read().first().asDict() == {"name": "cpu", "value": 50.0, "unit": None}
    metrics.append(spark.createDataFrame([("mem", 1.0, "GB")], "name string, value double, unit string"))
    metrics.rename_column("value", "amount")
    assert sorted(map(tuple, metrics.read().select("name", "amount", "unit").collect())) == [("cpu", 50.0, None), ("mem", 1.0, "GB")]
    assert [(r.version, r.operation, r.n_rows) for r in metrics.history().orderBy("version").collect()] == [
        (1, "create", 1),
        (2, "add column", 1),
        (3, "append", 2),
        (4, "rename column", 2),
    ]
    assert metrics.read(version=1).columns == ["name", "value"]


def test_append_of_other_schema_is_refused(spark, metrics):
    with pytest.raises(ValueError, match="schema mismatch"):
        metrics.append(spark.createDataFrame([("x",)], "name string"))
    with pytest.raises(ValueError, match="schema mismatch"):
        metrics.append(spark.createDataFrame([("x", 1)], "name string, value int"))
    assert metrics.read().count() == 1


def test_partitioned_append_and_metadata(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "id int, category string")
    table = VersionedTable.create(spark, str(tmp_path / "t"), rows, ("category",))
    table.append(spark.createDataFrame([(4, "b"), (5, "c")], "id int, category string"))
    assert sorted(map(tuple, table.read().collect())) == [(1, "a"), (2, "a"), (3, "b"), (4, "b"), (5, "c")]
    assert {r.category: r.n_rows for r in table.partitions().collect()} == {"a": 2, "b": 2, "c": 1}
    assert table.files().agg(F.sum("n_rows")).first()[0] == 5


def test_compact_expire_orphans(spark, tmp_path):
    table = VersionedTable.create(spark, str(tmp_path / "t"), spark.range(500).repartition(20))
    assert table.files().count() == 20
    table.compact()
    assert table.files().count() == 1 and table.read().count() == 500
    later = dt.datetime.now() + dt.timedelta(days=8)
    assert table.expirable(later, retain_last=5).count() == 0
    assert [r.version for r in table.expirable(later, retain_last=1).collect()] == [1]
    assert table.expirable(dt.datetime(2001, 1, 1), retain_last=0).count() == 0
    assert table.orphans(later).count() == 0
    spark.range(3).coalesce(1).write.parquet(f"{table.path}/data/__batch=000009-{'0' * 32}")
    assert table.orphans(later).count() == 1
    assert table.read().count() == 500
    assert table.expire(later, retain_last=1) == [1]
    assert [r.version for r in table.history().collect()] == [2] and table.read().count() == 500
    assert table.orphans(later).count() == 21  # the files of the version that is gone
    with pytest.raises(LookupError):
        table.read(version=1)


def names(table, version=None):
    return {r.file.rsplit("/", 1)[1] for r in table.files(version).collect()}


def test_changes_touch_only_files_that_match(spark, tmp_path):
    rows = spark.range(100).repartitionByRange(5, "id").select("id", (F.col("id") * 2).alias("v"))
    table = VersionedTable.create(spark, str(tmp_path / "t"), rows)
    first = names(table)
    table.update("id = 3", {"v": "-1"})
    second = names(table)
    assert len(first) == 5 and len(first & second) == 4
    table.delete("id >= 90")
    assert len(second & names(table)) == 4
    assert sorted(map(tuple, table.read().collect())) == [(i, -1 if i == 3 else 2 * i) for i in range(90)]
    table.update("id > 1000", {"v": "0"})
    table.rename_column("v", "w")
    assert names(table) == names(table, 3)
    table.delete("id IS NOT NULL")
    assert table.read().count() == 0 and table.read().columns == ["id", "w"]
    assert [r.n_rows for r in table.history().orderBy("version").collect()] == [100, 100, 90, 90, 90, 0]


def test_compaction_leaves_large_files(spark, tmp_path):
    table = VersionedTable.create(spark, str(tmp_path / "t"), spark.range(200_000).repartition(2))
    for i in range(3):
        table.append(spark.range(i, i + 1))
    large = {r.file for r in table.files().collect() if r.n_rows > 1000}
    table.compact(target_bytes=100_000)
    after = {r.file for r in table.files().collect()}
    assert len(large) == 2 and large < after and len(after) == 3


def test_columns_named_like_the_folders(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "batch int, data string")
    table = VersionedTable.create(spark, str(tmp_path / "t"), rows)
    assert sorted(map(tuple, table.read().collect())) == [(1, "a"), (2, "b")]
    with pytest.raises(ValueError, match="__batch"):
        VersionedTable.create(spark, str(tmp_path / "u"), rows.withColumnRenamed("batch", "__batch"))


def test_renamed_partition_column_and_names_used_again(spark, tmp_path):
    rows = spark.createDataFrame([(1, "x y"), (2, "100%"), (3, None)], "id int, category string")
    table = VersionedTable.create(spark, str(tmp_path / "t"), rows, ("category",))
    table.rename_column("category", "kind")
    again = VersionedTable(spark, table.path)  # the partitioning is part of the history
    again.append(spark.createDataFrame([(4, "x y")], "id int, kind string"))
    again.update("kind = '100%'", {"id": "20"})
    assert {r.kind: (r.n_rows, r.n_files) for r in again.partitions().collect()} == {"x y": (2, 2), "100%": (1, 1), None: (1, 1)}
    assert sorted(map(tuple, table.read().collect())) == [(1, "x y"), (3, None), (4, "x y"), (20, "100%")]
    again.add_column("category", "int")
    assert {r.category for r in again.read().collect()} == {None}
    again.update("id = 1", {"category": "5"})
    assert {r.id: r.category for r in table.read().collect()} == {1: 5, 3: None, 4: None, 20: None}
    with pytest.raises(ValueError):
        again.add_column("id", "int")


def test_a_second_writer_is_seen(spark, metrics):
    other = VersionedTable(spark, metrics.path)
    other.append(metrics.read())
    assert metrics.read().count() == 2
    metrics.append(other.read())
    assert other.read().count() == 4


def test_rewrite_touches_only_partitions_that_match(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(90).select("id", (F.col("id") % 3).cast("int").alias("p")).write.partitionBy("p").parquet(path)

    def files():
        return {r.f: r.p for r in spark.read.parquet(path).select(F.col("_metadata.file_path").alias("f"), "p").distinct().collect()}

    before = files()
    assert rewrite_partitions(spark, path, "p", "p = 1 AND id > 50", lambda df: updated(df, "p = 1 AND id > 50", {"id": "-id"})) == [1]
    after = files()
    assert {f for f, p in before.items() if p != 1} == {f for f, p in after.items() if p != 1}
    assert not {f for f, p in before.items() if p == 1} & set(after)
    expected = sorted((-i if i % 3 == 1 and i > 50 else i, i % 3) for i in range(90))
    assert sorted(map(tuple, spark.read.parquet(path).select("id", "p").collect())) == expected


def test_rewrite_refuses_to_empty_or_move(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(30).select("id", (F.col("id") % 3).cast("int").alias("p")).write.partitionBy("p").parquet(path)
    with pytest.raises(ValueError, match="turns partitions"):
        rewrite_partitions(spark, path, "p", "p = 1", lambda df: remaining(df, "p = 1"))
    with pytest.raises(ValueError, match="turns partitions"):
        rewrite_partitions(spark, path, "p", "id = 4", lambda df: updated(df, "id = 4", {"p": "2"}))
    assert rewrite_partitions(spark, path, "p", "id > 100", lambda df: df) == []
    assert sorted(map(tuple, spark.read.parquet(path).select("id", "p").collect())) == [(i, i % 3) for i in range(30)]
    assert rewrite_partitions(spark, path, "p", "id < 2", lambda df: remaining(df, "id < 2")) == [0, 1]
    assert sorted(r.id for r in spark.read.parquet(path).collect()) == list(range(2, 30))


def test_rewrite_of_the_partition_without_a_value(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.createDataFrame([(1, "a"), (2, None), (3, None)], "id int, p string")
    rows.write.partitionBy("p").parquet(path)
    rewrite_partitions(spark, path, "p", "id = 2", lambda df: updated(df, "id = 2", {"id": "20"}))
    assert sorted(map(tuple, spark.read.parquet(path).select("id", "p").collect())) == [(1, "a"), (3, None), (20, None)]
