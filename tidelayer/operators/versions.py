"""Changes to Parquet tables: update, delete, schema change, versions, compaction.

A version is a list of Parquet files, kept below `_files`, and a schema, kept as one row in `_history` with the columns the
files are parted by. Appending writes the new rows only; adding or renaming a column writes no data, as each column keeps the
name it was stored under; an update or delete finds the files that hold matching rows, writes those anew and lists the
others again; compaction rewrites small files only. A version that was not listed does not exist for readers, so a job that
dies halfway leaves the table as it was. One writer at a time; there is no concurrency control. `rewrite_partitions` does the
like for a plain partitioned folder.
"""

from __future__ import annotations

import datetime as dt
import json
import uuid
from collections.abc import Callable, Mapping
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from tidelayer.sources.formats import clustered

HISTORY = (
    "version BIGINT, committed_at TIMESTAMP, operation STRING, n_rows BIGINT, "
    "manifest BIGINT, partition_by ARRAY<STRING>, table_schema STRING"
)
BATCH = "__batch"  # folder of one write; no column of a table may have this name
TARGET_FILE_BYTES = 128 * 1024 * 1024  # fixed value: size that compaction aims at


def holds(condition: str | Column) -> Column:
    """True where the condition is true; a condition that is NULL does not hold."""
    column = F.expr(condition) if isinstance(condition, str) else condition
    return F.coalesce(column, F.lit(False))


def updated(df: DataFrame, condition: str | Column, changes: Mapping[str, str | Column]) -> DataFrame:
    """UPDATE ... SET ... WHERE as a projection. All changes see the old row; types stay."""
    types = dict(df.dtypes)
    hit = holds(condition)
    new = {
        name: F.when(hit, (F.expr(value) if isinstance(value, str) else value).cast(types[name])).otherwise(F.col(name))
        for name, value in changes.items()
    }
    return df.withColumns(new)


def remaining(df: DataFrame, condition: str | Column) -> DataFrame:
    """What DELETE ... WHERE leaves."""
    return df.where(~holds(condition))


def rewrite_partitions(
    spark: SparkSession, path: str, partition: str, condition: str | Column, change: Callable[[DataFrame], DataFrame]
) -> list:
    """Applies `change` to the partitions that hold rows matching the condition, and to no others.

    Gives back the values of those partitions. They are named in the filter, so other folders are not
    read, and the write replaces only them (dynamic overwrite). That can neither empty a partition
    nor move rows into another one, so a change that would is refused before anything is written;
    a VersionedTable can do both.
    """
    table = spark.read.parquet(path)
    touched = {row[0] for row in table.where(holds(condition)).select(partition).distinct().collect()}
    if not touched:
        return []
    inside = F.col(partition).isin([value for value in touched if value is not None])
    changed = change(table.where(inside | F.col(partition).isNull() if None in touched else inside))
    left = {row[0] for row in changed.select(partition).distinct().collect()}
    if left != touched:
        raise ValueError(f"the change turns partitions {touched} of {path} into {left}")
    rewritten = clustered(changed.select(*table.columns), [partition])
    rewritten.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)
    return sorted(touched, key=str)


def _stored(field: StructField) -> str:
    return field.metadata.get("stored", field.name)


class VersionedTable:
    """A table at a path, with versions that can be read back by number or by time."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    @classmethod
    def create(cls, spark: SparkSession, path: str, df: DataFrame, partition_by: tuple[str, ...] = ()) -> VersionedTable:
        """A new table with df as its first version; fails where there is one already."""
        if BATCH in df.columns:
            raise ValueError(f"a table can have no column named {BATCH}")
        table = cls(spark, path)
        files, _, n_rows = table._write(df, df.schema, list(partition_by), 1)
        table._list(1, "create", n_rows, files, list(partition_by), df.schema)
        return table

    # -- reading ------------------------------------------------------------------------------
    def history(self) -> DataFrame:
        """version, committed_at, operation, n_rows, manifest, partition_by, table_schema: one row per version."""
        return self.spark.read.schema(HISTORY).parquet(f"{self.path}/_history/*")

    def _entry(self, version: int | None = None, as_of: dt.datetime | str | None = None):
        entries = self.history()
        if version is not None:
            entries = entries.where(F.col("version") == version)
        if as_of is not None:
            entries = entries.where(F.col("committed_at") <= F.lit(as_of).cast("timestamp"))
        found = entries.orderBy(F.desc("version")).limit(1).collect()
        if not found:
            raise LookupError(f"no such version of {self.path}: version={version}, as_of={as_of}")
        return found[0]

    def _schema(self, entry) -> StructType:
        return StructType.fromJson(json.loads(entry["table_schema"]))

    def _files(self, entry) -> list[str]:
        """The version's files, below the data folder. A list of names, as any reader of files has it."""
        return [row["file"] for row in self.spark.read.schema("file STRING").parquet(f"{self.path}/_files/{entry['manifest']:06d}").collect()]

    def _scan(self, entry, files: list[str] | None = None) -> DataFrame:
        """The files under the names of the version's columns, with their place in `_metadata`."""
        schema = self._schema(entry)
        stored = StructType([StructField(_stored(f), f.dataType, True) for f in schema])
        paths = [f"{self.path}/data/{file}" for file in (self._files(entry) if files is None else files)]
        if not paths:
            return self.spark.createDataFrame([], stored).select(*(F.col(f"`{_stored(f)}`").alias(f.name) for f in schema), _no_metadata())
        rows = self.spark.read.schema(stored).option("basePath", f"{self.path}/data").parquet(*paths)
        return rows.select(*(F.col(f"`{_stored(f)}`").alias(f.name) for f in schema), "_metadata")

    def read(self, version: int | None = None, as_of: dt.datetime | str | None = None) -> DataFrame:
        return self._scan(self._entry(version, as_of)).drop("_metadata")

    # -- writing ------------------------------------------------------------------------------
    def _write(self, df: DataFrame, schema: StructType, partition_by: list[str], version: int) -> tuple[list[str], str, int]:
        """One batch: its files, its name, and its rows, which the write itself counts."""
        batch = f"{version:06d}-{uuid.uuid4().hex}"
        folder = f"{self.path}/data/{BATCH}={batch}"
        counted = Observation()
        stored = df.select(*(F.col(f"`{f.name}`").alias(_stored(f)) for f in schema))
        if partition_by:
            stored = clustered(stored, partition_by)
        stored.observe(counted, F.count(F.lit(1)).alias("n_rows")).write.partitionBy(*partition_by).parquet(folder)
        written = self.spark.read.schema(stored.schema).parquet(folder).inputFiles()
        return [self._relative(file) for file in written], batch, counted.get["n_rows"]

    @staticmethod
    def _relative(file: str) -> str:
        return f"{BATCH}=" + unquote(file).split(f"/data/{BATCH}=", 1)[1]

    def _list(self, version: int, operation: str, n_rows: int, files: list[str] | int, partition_by: list[str], schema: StructType) -> int:
        """Lists a version: with new files, or with those of the version given."""
        manifest = files if isinstance(files, int) else version
        if not isinstance(files, int):
            self.spark.createDataFrame([(file,) for file in files], "file STRING").coalesce(1).write.parquet(f"{self.path}/_files/{version:06d}")
        entry = (version, dt.datetime.now(), operation, n_rows, manifest, partition_by, schema.json())
        self.spark.createDataFrame([entry], HISTORY).coalesce(1).write.parquet(f"{self.path}/_history/{version:06d}")
        return version

    def append(self, df: DataFrame) -> int:
        """Adds rows. A column list or type that differs from the table's is refused."""
        last = self._entry()
        schema = self._schema(last)
        table_types = {field.name: field.dataType.simpleString() for field in schema}
        if dict(df.dtypes) != table_types:
            raise ValueError(f"schema mismatch: table has {table_types}, rows have {dict(df.dtypes)}")
        version = last["version"] + 1
        files, _, n_rows = self._write(df, schema, last["partition_by"], version)
        return self._list(version, "append", last["n_rows"] + n_rows, [*self._files(last), *files], last["partition_by"], schema)

    def _rewrite(self, operation: str, condition: str | Column, change: Callable[[DataFrame], DataFrame]) -> int:
        """Writes the files that hold matching rows anew, changed, and lists the others again."""
        last = self._entry()
        version, schema = last["version"] + 1, self._schema(last)
        hits = self._scan(last).where(holds(condition)).select("_metadata.file_path").distinct().collect()
        touched = {self._relative(row["file_path"]) for row in hits}
        if not touched:
            return self._list(version, operation, last["n_rows"], last["manifest"], last["partition_by"], schema)
        before = Observation()
        old = self._scan(last, sorted(touched)).drop("_metadata").observe(before, F.count(F.lit(1)).alias("n"))
        files, _, n_rows = self._write(change(old), schema, last["partition_by"], version)
        kept = [file for file in self._files(last) if file not in touched]
        return self._list(version, operation, last["n_rows"] - before.get["n"] + n_rows, [*kept, *files], last["partition_by"], schema)

    def update(self, condition: str | Column, changes: Mapping[str, str | Column]) -> int:
        return self._rewrite("update", condition, lambda df: updated(df, condition, changes))

    def delete(self, condition: str | Column) -> int:
        return self._rewrite("delete", condition, lambda df: remaining(df, condition))

    def _new_schema(self, operation: str, change: Callable[[list[StructField], int], list[StructField]]) -> int:
        last = self._entry()
        version = last["version"] + 1
        schema = StructType(change(self._schema(last).fields, version))
        return self._list(version, operation, last["n_rows"], last["manifest"], last["partition_by"], schema)

    def add_column(self, name: str, dtype: str) -> int:
        """Old rows have NULL in the new column; no data is written."""

        def add(fields: list[StructField], version: int) -> list[StructField]:
            if name in (f.name for f in fields) or name == BATCH:
                raise ValueError(f"there is a column named {name} already")
            kind = StructType.fromDDL(f"`{name}` {dtype}").fields[0].dataType
            return [*fields, StructField(name, kind, True, {"stored": f"{name}__{version}"})]

        return self._new_schema("add column", add)

    def rename_column(self, old: str, new: str) -> int:
        """Another name for a column, also one that files are parted by; no data is written."""

        def rename(fields: list[StructField], _: int) -> list[StructField]:
            if old not in (f.name for f in fields) or new in (f.name for f in fields):
                raise ValueError(f"cannot rename {old} to {new}")
            return [StructField(new if f.name == old else f.name, f.dataType, f.nullable, {"stored": _stored(f)}) for f in fields]

        return self._new_schema("rename column", rename)

    def compact(self, target_bytes: int = TARGET_FILE_BYTES) -> int:
        """Same rows, with files of less than half the target size put together; others stay as they are."""
        last = self._entry()
        version, schema = last["version"] + 1, self._schema(last)
        sizes = {self._relative(row["file"]): row["bytes"] for row in self._sizes(last).collect()}
        small = sorted(file for file, size in sizes.items() if size < target_bytes / 2)
        if len(small) < 2:
            return self._list(version, "compact", last["n_rows"], last["manifest"], last["partition_by"], schema)
        rows = self._scan(last, small).drop("_metadata")
        count = max(1, round(sum(sizes[file] for file in small) / target_bytes))
        files, _, _ = self._write(rows if last["partition_by"] else rows.coalesce(count), schema, last["partition_by"], version)
        return self._list(version, "compact", last["n_rows"], [*(f for f in self._files(last) if f not in set(small)), *files], last["partition_by"], schema)

    # -- metadata -----------------------------------------------------------------------------
    def _sizes(self, entry) -> DataFrame:
        """file, bytes from a listing of the files; none is opened."""
        paths = [f"{self.path}/data/{file}" for file in self._files(entry)]
        if not paths:
            return self.spark.createDataFrame([], "file STRING, bytes BIGINT")
        return self.spark.read.format("binaryFile").load(paths).select(F.col("path").alias("file"), F.col("length").alias("bytes"))

    def files(self, version: int | None = None) -> DataFrame:
        """file, bytes, n_rows of a version."""
        meta = self._scan(self._entry(version)).select("_metadata.file_path", "_metadata.file_size")
        return meta.groupBy(F.col("file_path").alias("file"), F.col("file_size").alias("bytes")).agg(F.count(F.lit(1)).alias("n_rows"))

    def partitions(self, version: int | None = None) -> DataFrame:
        """Rows and files per partition value."""
        entry = self._entry(version)
        names = [f.name for stored in entry["partition_by"] for f in self._schema(entry) if _stored(f) == stored]
        counted = self._scan(entry).select(*names, "_metadata.file_path").groupBy(*names, "file_path").agg(F.count(F.lit(1)).alias("n"))
        return counted.groupBy(*names).agg(F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("n_files"))

    def expirable(self, older_than: dt.datetime, retain_last: int = 5) -> DataFrame:
        """Versions that are older than the date and not among the last ones."""
        newest = self._entry()["version"]
        return self.history().where(
            (F.col("committed_at") < F.lit(older_than).cast("timestamp")) & (F.col("version") <= newest - retain_last)
        )

    def expire(self, older_than: dt.datetime, retain_last: int = 5) -> list[int]:
        """Takes expirable versions out of the history. Their files stay until nothing else lists them: see `orphans`."""
        gone = sorted(row["version"] for row in self.expirable(older_than, retain_last).collect())
        jvm = self.spark.sparkContext._jvm
        for version in gone:
            folder = jvm.org.apache.hadoop.fs.Path(f"{self.path}/_history/{version:06d}")
            folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
        return gone

    def orphans(self, older_than: dt.datetime) -> DataFrame:
        """Data files that no version lists, older than the date. A report: nothing is removed."""
        found = (
            self.spark.read.format("binaryFile")
            .option("recursiveFileLookup", True)
            .option("pathGlobFilter", "*.parquet")
            .load(f"{self.path}/data")
            .select(
                F.concat(F.lit(f"{BATCH}="), F.element_at(F.split("path", f"/data/{BATCH}="), 2)).alias("name"),
                F.col("path").alias("file"),
                F.col("modificationTime").alias("modified_at"),
                F.col("length").alias("bytes"),
            )
        )
        manifests = [f"{self.path}/_files/{row['manifest']:06d}" for row in self.history().select("manifest").distinct().collect()]
        listed = self.spark.read.schema("file STRING").parquet(*manifests).select(F.col("file").alias("name")).distinct()
        return found.where(F.col("modified_at") < F.lit(older_than).cast("timestamp")).join(listed, "name", "left_anti").drop("name")


def _no_metadata() -> Column:
    """For a version without files: the column is there, without a value."""
    return F.lit(None).cast("struct<file_path: string, file_size: bigint>").alias("_metadata")
