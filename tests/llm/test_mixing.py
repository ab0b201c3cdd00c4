import math
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tidelayer.llm.mixing import mix, source_weights, words_in


def entropy(weights):
    return -sum(w * math.log(w) for w in weights if w > 0)


def weights(spark, tokens, **aim):
    totals = spark.createDataFrame([(f"s{i}", t) for i, t in enumerate(tokens)], "key STRING, tokens BIGINT")
    return [r for r in source_weights(totals, aim.pop("budget", None), aim.pop("max_repetition", None), aim.pop("target_entropy", None)).orderBy("key").collect()]


def test_repetition_limit_is_met(spark):
    tokens = [9000, 500, 400, 100]
    rows = weights(spark, tokens, max_repetition=2.0)
    assert abs(sum(r.weight for r in rows) - 1) < 1e-9
    assert abs(max(r.weight * 10_000 / r.tokens for r in rows) - 2.0) < 1e-4
    assert sum(r.quota for r in rows) == pytest.approx(10_000, abs=4)


def test_target_entropy_is_met(spark):
    rows = weights(spark, [9000, 500, 400, 100], target_entropy=1.0)
    assert abs(entropy([r.weight for r in rows]) - 1.0) < 1e-6
    flat = weights(spark, [9000, 500, 400, 100], target_entropy=9.0)  # out of reach: as flat as can be
    assert all(abs(r.weight - 0.25) < 1e-9 for r in flat)


def test_one_aim_is_asked_for(spark):
    with pytest.raises(ValueError):
        weights(spark, [1])


def docs(spark, n=3000):
    source = F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 7 == 1, F.lit(None)).otherwise(F.concat(F.lit("s"), F.col("id") % 5))
    return spark.range(n).select(F.col("id").alias("doc_id"), F.repeat(F.lit("w "), (F.col("id") % 9).cast("int")).alias("text"), source.alias("source"))


def test_quotas_are_realised(spark):
    table = docs(spark)
    taken = mix(table, max_repetition=1.5, block_rows=64).collect()
    have, got, times = defaultdict(int), defaultdict(int), defaultdict(int)
    for r in table.withColumn("t", words_in(F.col("text"))).collect():
        have[r.source] += r.t
    for r in taken:
        got[r.source] += r["__tokens"]
        times[(r.source, r.doc_id)] += 1
    quotas = {k: round(min(w * sum(have.values()), 1.5 * have[k])) for k, w in {r.source: r["__weight"] for r in taken}.items()}
    assert set(quotas) == set(have)
    for source, quota in quotas.items():
        assert quota <= got[source] < quota + 9
        counts = {n for (s, _), n in times.items() if s == source}
        assert max(counts) - min(counts) <= 1  # whole passes, and one partial one
    assert max(times.values()) == 2


def test_budget_and_order(spark):
    table = docs(spark, 900)
    taken = mix(table, budget=900, max_repetition=1.0, block_rows=16).collect()
    assert 900 <= sum(r["__tokens"] for r in taken) <= 900 + 9 * 7
    again = mix(table.repartition(7), budget=900, max_repetition=1.0, block_rows=16).collect()
    assert sorted((r.doc_id, r["__order"]) for r in taken) == sorted((r.doc_id, r["__order"]) for r in again)
    assert sorted((r.doc_id for r in mix(table, budget=900, max_repetition=1.0, seed="other").collect())) != sorted(r.doc_id for r in taken)


def test_awkward_rows(awkward, nothing):
    taken = mix(awkward, max_repetition=1.0)
    assert taken.columns[: len(awkward.columns)] == awkward.columns
    assert taken.where("text = 'no id'").count() == 1
    assert mix(nothing, max_repetition=1.25).count() == 0


def test_native(spark):
    plan = mix(docs(spark), max_repetition=1.25)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_rows_without_ids_are_spread(spark):
    rows = [(None, f"text {i} of ten words that make it long enough", "s") for i in range(100)] + [(i, "w " * 2000, "t") for i in range(10)]
    docs = spark.createDataFrame(rows, "doc_id BIGINT, text STRING, source STRING")
    taken = mix(docs, budget=11_000, max_repetition=0.5, block_rows=8).where("source = 's'").count()
    assert 40 <= taken <= 60  # half of them, not all or none
