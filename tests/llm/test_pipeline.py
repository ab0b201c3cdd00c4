import pytest

import corpus_pipeline
from tests.llm.test_jaccard import shingles
from tidelayer.llm.packing import WordTokens
from tidelayer.llm.quality import is_held_out, score, train
from tidelayer.llm.texts import documents, written


@pytest.fixture(scope="module")
def stages(spark, sf):
    """What each stage got and gave."""
    out, docs = {}, documents(spark, sf)
    for name, stage in corpus_pipeline.STAGES:
        got = written(stage(spark, docs, sf), "test-stage")
        out[name], docs = (docs, got), got
    return out


def test_columns(stages):
    assert list(stages) == ["quality", "exact dedup", "near dedup", "mix", "pack"]
    for before, after in list(stages.values())[:-1]:
        assert after.columns == before.columns


def test_quality(spark, sf, stages):
    before, after = stages["quality"]
    model = train(before, spark.read.parquet(f"{sf}/labels.parquet"), may_learn=~is_held_out())
    assert sorted(r.doc_id for r in after.collect()) == sorted(r.doc_id for r in score(before, model).where("score >= 0.5").collect())


def test_exact_dedup(stages):
    before, after = stages["exact dedup"]
    best = {}
    for r in before.collect():
        best[r.text] = max(best.get(r.text, -1), r.doc_id)
    assert sorted(best.values()) == sorted(r.doc_id for r in after.collect())


def test_near_dedup(stages):
    before, after = stages["near dedup"]
    rows = sorted((r.doc_id, shingles(r.text)) for r in before.collect())
    parent = {i: i for i, _ in rows}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for k, (i, a) in enumerate(rows):
        for j, b in rows[:k]:
            if a and b and 100 * len(a & b) >= 80 * len(a | b) and find(i) != find(j):
                parent[max(find(i), find(j))] = min(find(i), find(j))
    assert sorted(i for i in parent if find(i) == i) == sorted(r.doc_id for r in after.collect())


def test_mix(stages):
    before, after = stages["mix"]
    ids = {r.doc_id for r in before.collect()}
    times = [r["count"] for r in after.groupBy("doc_id").count().collect()]
    assert {r.doc_id for r in after.collect()} <= ids and max(times) <= 2
    words = [sum(len((r.text or "").split()) for r in df.collect()) for df in (before, after)]
    assert abs(words[1] / words[0] - 1) < 0.5


def test_pack(stages):
    before, after = stages["pack"]
    words = WordTokens(corpus_pipeline.public_tokenizers.path("word_bpe_49k.json"))
    expected = sum(len(ids) // 4 + 1 for ids in words.encode([r.text or "" for r in before.collect()]))
    assert after.agg({"length": "sum"}).first()[0] == expected


def test_run(spark, sf, stages):
    assert corpus_pipeline.run(spark, sf).count() == stages["pack"][1].count()


def test_awkward_rows(spark, awkward, nothing, sf):
    docs = awkward.select("doc_id", "text", "lang", "source", "n_chars")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, nothing.select(*docs.columns), sf).count() == 0, name
        docs = written(stage(spark, docs, sf), "awkward-stage")
    assert docs.count() > 0


@pytest.mark.parametrize("number", range(5))
def test_each_stage_takes_awkward_rows(spark, awkward, sf, number):
    """Nulls, empty and very long texts, repeated rows and columns of odd names, given to every stage by itself."""
    name, stage = corpus_pipeline.STAGES[number]
    got = stage(spark, awkward, sf)
    rows = got.collect()
    assert name == "pack" or got.columns == awkward.columns
    if name in ("exact dedup", "near dedup"):
        assert len({(r.doc_id, r.text or "") for r in rows}) == len(rows) and any(r.doc_id is None for r in rows)
    if name == "mix":
        assert {r.text for r in rows} <= {r.text for r in awkward.collect()}
    if name == "pack":
        assert {r.doc_id for r in rows} == {r.doc_id for r in awkward.collect()} and len(rows) >= awkward.count()
