import hashlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidelayer.llm.exact_dedup import CountingQuotientFilter, exact_duplicates, repeated_fingerprints, without_copies


@pytest.mark.parametrize("width", [20, 40, 57, 64])
def test_filters_give_the_multiset_back(width):
    random = np.random.default_rng(width)
    for size in (0, 1, 2, 50, 3000):
        values = random.integers(0, 2**64, size, dtype=np.uint64) >> np.uint64(64 - width)
        if size == 50:
            values[:30] = values[0] + np.arange(30, dtype=np.uint64) % np.uint64(3)  # one long run
        some = np.concatenate([values, values[: size // 3], np.repeat(values[:1], 70_000 if width == 20 else 300)])
        whole = CountingQuotientFilter.of(some, width)
        again = CountingQuotientFilter.unpacked(width, *whole.packed())
        for f in (whole, again):
            found, counts = f.entries()
            assert dict(zip(found.tolist(), counts.tolist())) == Counter(some.tolist()) and (np.diff(found.astype(object)) > 0).all()


def test_filters_merge_without_loss():
    random = np.random.default_rng(3)
    values = random.integers(0, 2**50, 500, dtype=np.uint64)
    parts = [random.choice(values, n) for n in (400, 3, 90, 2000)]
    whole = CountingQuotientFilter.merged([CountingQuotientFilter.of(p, 50) for p in parts])
    assert dict(zip(*(x.tolist() for x in whole.entries()))) == Counter(np.concatenate(parts).tolist())


def test_an_entry_takes_less_than_six_bytes():
    n = int(0.75 * 2**16)
    values = np.unique(np.random.default_rng(1).integers(0, 2**48, n, dtype=np.uint64))
    whole = CountingQuotientFilter.counted(values, np.ones(len(values), np.int64), 48)
    assert whole.quotients == 16 and whole.bytes() / len(values) < 6


def test_repeated_fingerprints(spark):
    rows = spark.range(3000).select((F.col("id") % 2000).alias("fp"))
    assert {(r.fp, r.n) for r in repeated_fingerprints(rows, 3000, per_segment=10).collect()} == {(i, 2) for i in range(1000)}


def brute(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r.text or "", []).append(r.doc_id)
    out = Counter()
    for r in rows:
        ids = groups[r.text or ""]
        keep = max((i for i in ids if i is not None), default=None)
        kept = r.doc_id == keep if len(ids) > 1 else True
        out[(r.doc_id, keep, len(ids), kept, hashlib.sha256((r.text or "").encode()).hexdigest())] += 1
    return out


def test_against_brute_force(awkward):
    got = exact_duplicates(awkward).collect()
    assert Counter(map(tuple, got)) == brute(awkward.select("doc_id", "text").collect())


def test_hot_group(spark):
    rows = spark.range(6000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "same").otherwise(F.col("id").cast("string")).alias("text"))
    got = exact_duplicates(rows)
    assert got.where("NOT kept").count() == 1999
    assert {tuple(r) for r in got.where("group_size > 1").select("keep_id", "group_size").distinct().collect()} == {(5997, 2000)}


def test_filter_keeps_columns(awkward, nothing):
    kept = without_copies(awkward)
    assert kept.columns == awkward.columns
    found = [(r.doc_id, hashlib.sha256((r.text or "").encode()).hexdigest()) for r in kept.collect()]
    assert sorted(found, key=str) == sorted({(b[0], b[4]) for b in brute(awkward.collect()) if b[3]}, key=str)  # one of each
    assert without_copies(nothing).count() == 0 and exact_duplicates(nothing).count() == 0


def test_rows_given_again_go(spark):
    """A third of all rows is one row, others come two or three times, with other columns and without an id."""
    rows = [(1, "hot", f"s{i % 2}") for i in range(300)] + [(2, "hot", "a"), (3, "x", "b"), (3, "x", "a"), (3, "y", "c"), (None, "z", "d"), (None, "z", None), (4, "z", "e")]
    docs = spark.createDataFrame(rows, "doc_id BIGINT, text STRING, source STRING").repartition(5)
    assert sorted(map(tuple, without_copies(docs).collect()), key=str) == sorted([(2, "hot", "a"), (3, "x", "a"), (3, "y", "c"), (4, "z", "e")], key=str)
    only = without_copies(docs.where("doc_id = 1"))
    assert [tuple(r) for r in only.collect()] == [(1, "hot", "s0")]
