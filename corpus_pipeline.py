"""From raw documents to packed training sequences, in five stages.

Each stage is a function of the session, the rows its predecessor kept and the data folder. What a stage returns is written
as Parquet and read again for the next one, so a lost executor costs no more than the tasks of one stage. All stages but the
last return rows with the columns of `documents`.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tidelayer.llm.exact_dedup import without_copies
from tidelayer.llm.jaccard import without_near_copies
from tidelayer.llm.mixing import mix
from tidelayer.llm.packing import pack
from tidelayer.llm.quality import is_held_out, train, without_low_quality
from tidelayer.llm.texts import documents, written

MAX_REPETITION = 1.25


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the quality classifier does not reject; it learns from the labels of this run's documents."""
    labels = spark.read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet")
    return without_low_quality(docs, train(docs, labels, may_learn=~is_held_out()))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the largest id."""
    return without_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links of shingle similarity connect, the one with the smallest id."""
    return without_near_copies(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many words as there are, with sources flattened until one of them is repeated 1.25 times; rows may come twice."""
    return mix(docs, max_repetition=MAX_REPETITION).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents placed in sequences of 4096 tokens."""
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality", keep_quality),
    ("exact dedup", drop_copies),
    ("near dedup", drop_near_copies),
    ("mix", mix_sources),
    ("pack", pack_sequences),
]

# Tokenisation and training are beyond SQL; tests hold every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
