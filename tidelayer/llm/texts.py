"""What the text operators share: input columns by safe names, white space, batches of bounded size."""

from __future__ import annotations

import contextlib
import ctypes
import os
from collections.abc import Callable, Iterator
from itertools import islice
from pathlib import Path

import pyarrow as pa
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelayer.session import run_dir

# The Unicode property White_Space, without U+001C to U+001F that Python's own \s adds.
WHITE_SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"

LONG = 4_000_000  # characters of a text that is taken in parts


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Two columns, `doc_id` and `text`, whatever else the table has; a null text is an empty one."""
    importable(docs.sparkSession)
    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def importable(spark: SparkSession) -> None:
    """Lets Python workers import this library from where the driver has it, also if they start in another folder."""
    root, env = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [env.get("PYTHONPATH"), root]))


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a table in the shared folder: cuts the lineage, and no lost executor takes them away.

    What the job has shuffled is of no use any more once the table is there, and Spark is asked to remove it then.
    """
    spark = df.sparkSession
    path = run_dir(spark, name)
    clean_up, before = "spark.sql.classic.shuffleDependency.fileCleanup.enabled", None
    with contextlib.suppress(PySparkException):  # a Spark that does not know the setting keeps the files for longer
        before = spark.conf.get(clean_up)
        spark.conf.set(clean_up, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is not None:
            spark.conf.set(clean_up, before)
    return spark.read.schema(df.schema).parquet(path)


def one_of_each(rows: DataFrame, repeated: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows, of which those with one id and one text are reduced to one: the least by its other columns, as text.

    `repeated` names them: `id` and `sha` (the SHA-256 of the text, in hex) of what occurs more than once. Others are not shuffled
    where that list is small. The least is combined on the map side, so a row that is given a million times meets in no task.
    """
    repeated = written(repeated.select(F.col("id").alias("__id"), F.col("sha").alias("__sha")), "repeated-rows")
    if repeated.isEmpty():
        return rows
    sha = F.sha2(F.coalesce(rows[text_col], F.lit("")), 256)
    same = rows[id_col].eqNullSafe(repeated["__id"]) & (sha == repeated["__sha"])
    whole = F.struct(*(rows[f"`{c}`"] for c in rows.columns))
    least = F.min_by("__row", F.to_json(F.col("__row"))).alias("__row")
    some = rows.join(repeated, same, "left_semi").select(F.struct(rows[id_col]).alias("__name"), sha.alias("__sha"), whole.alias("__row"))
    reduced = some.groupBy("__name", "__sha").agg(least).select("__row.*")
    return rows.join(repeated, same, "left_anti").unionByName(reduced)


class Remembered:
    """What is known about words, in two generations: the older one goes when the younger one is full, and what is asked for
    again stays. Bounds memory at twice `most` words and keeps frequent words."""

    def __init__(self, most: int):
        self.most, self.young, self.old = most, {}, {}

    def missing(self, words: set[str]) -> set[str]:
        """Those not known; the others can be looked up in `young` from now on."""
        new = words.difference(self.young)
        if len(self.young) + len(new) > self.most:
            self.young, self.old = {}, self.young
            new = words
        found = {w: self.old[w] for w in new if w in self.old}
        self.young.update(found)
        return new.difference(found)


def give_back() -> None:
    """Returns freed memory to the machine: Python workers outlive their tasks, and what they keep others lack."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def lean(run: Callable) -> Callable:
    """The same function of batches, which gives memory back after its last batch."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped


def slices(texts: list[str], chars: int = 2_000_000) -> Iterator[tuple[int, int]]:
    """Ranges of texts with about so many characters each: bounds what a batch holds at once."""
    start = size = 0
    for i, text in enumerate(texts):
        size += len(text)
        if size >= chars:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def chunks(items: Iterator, size: int) -> Iterator[list]:
    while part := list(islice(items, size)):
        yield part
