import math
import random

from pyspark.sql import functions as F

from tidelayer.llm.topk import top_k


def brute(rows, k):
    valid = [(r[0], [math.floor(64 * x) for x in r[1]]) for r in rows if r[0] is not None and r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    out, asked = [], set()
    for q, v in valid:
        if q % 5 == 0 and (q, tuple(v)) not in asked:
            asked.add((q, tuple(v)))
            scored = sorted((-sum(a * b for a, b in zip(v, w)), c) for c, w in valid if c != q)[:k]
            out += [(q, i + 1, c, -s) for i, (s, c) in enumerate(scored)]
    return sorted(out)


def table(spark, rows):
    return spark.createDataFrame(rows, "vec_id BIGINT, embedding ARRAY<DOUBLE>, score STRING, cell STRING, v STRING").repartition(3)


def test_against_brute_force(spark):
    random.seed(5)
    centres = [[random.gauss(0, 1) for _ in range(8)] for _ in range(6)]
    rows = [(i, [c + random.gauss(0, 0.3) for c in random.choice(centres)], "s", "c", "v") for i in range(500)]
    rows += [(1000 + i, rows[3][1], "s", "c", "v") for i in range(200)]  # a hot vector: ties go to the smaller id
    rows += [(None, [1.0] * 8, None, None, None), (2000, None, None, None, None), (2005, [None] * 8, "s", "c", "v"), (2010, [float("nan")] * 8, "s", "c", "v")]
    rows += [(2015, [float("inf")] * 8, "s", "c", "v"), (2020, [], "s", "c", "v"), (2025, [0.5], "s", "c", "v"), rows[10], rows[10], (15, [9.0] * 8, "s", "c", "v")]
    got = top_k(table(spark, rows), F.col("vec_id") % 5 == 0, k=7, superblock=64, block=16, chunk=20, pivots=8)
    assert sorted(map(tuple, got.collect())) == brute(rows, 7)


def test_fewer_candidates_than_asked(spark):
    rows = [(i, [float(i)], "s", "c", "v") for i in range(4)]
    got = top_k(table(spark, rows), F.col("vec_id") % 5 == 0, k=20)
    assert sorted(map(tuple, got.collect())) == brute(rows, 20)


def test_large_numbers_stay_exact(spark):
    rows = [(0, [1e7, 1e7 + 1 / 64]), (1, [1e7, -1e7]), (2, [1e7 + 1 / 64, -1e7])]
    rows = [(*r, "s", "c", "v") for r in rows]
    assert sorted(map(tuple, top_k(table(spark, rows), F.col("vec_id") % 5 == 0).collect())) == brute(rows, 20)


def test_empty(spark):
    assert top_k(table(spark, []), F.col("vec_id") % 5 == 0).count() == 0
