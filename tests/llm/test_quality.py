import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tidelayer.llm import quality
from tidelayer.llm.quality import FEATURES, features_of, fit, is_held_out, score, train, without_low_quality
from tidelayer.llm.texts import documents
from tidelayer.llm.words import Words, word_slices


def test_words_are_those_of_python():
    texts = ["", " a  b", "ÄÖ x", "one", "\n", "two\nlines here", "\x0b\x1cq"]
    for _, _, words in word_slices(pa.array(texts), size=8):
        assert isinstance(words, Words)
    _, _, words = next(word_slices(pa.array(texts)))
    raw = "".join(texts).encode()
    for i, text in enumerate(texts):
        a, b = words.bounds[i], words.bounds[i + 1]
        got = [raw[s:e].decode() for s, e in zip(words.starts[a:b], words.ends[a:b])]
        assert got == [w.decode() for w in text.encode().split()]
    _, _, same = next(word_slices(pa.array(["Word x", "wORD", "x"])))
    assert same.hashes[0] == same.hashes[2] and same.hashes[1] == same.hashes[3] and same.hashes[0] != same.hashes[1]


def test_features_do_not_depend_on_neighbours():
    texts = ["A first text. With lines\nand MORE!", "", "b", "$$$ x$$ | y | z 12", "same\nsame\nother"]
    _, _, together = next(word_slices(pa.array(texts)))
    alone = [features_of(next(word_slices(pa.array([t])))[2])[0] for t in texts]
    assert np.allclose(features_of(together), np.stack(alone)) and together.bounds[-1] > 0
    assert features_of(together).shape == (5, len(FEATURES))


def test_pairs_learn_what_single_features_cannot():
    random = np.random.default_rng(7)
    x = random.uniform(-1, 1, (4000, 3))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)
    model = fit(x[:3000], y[:3000])
    assert ((model.scores(x[3000:]) >= 0.5) == y[3000:]).mean() > 0.9
    assert model.pairs[0][:2] == (0, 1)


def test_one_class_or_no_rows():
    assert fit(np.empty((0, 2)), np.empty(0)).scores(np.zeros((3, 2))).tolist() == [0.5] * 3
    assert (fit(np.zeros((9, 2)), np.ones(9)).scores(np.zeros((1, 2))) > 0.8).all()


def test_held_out_accuracy(spark, sf):
    folder = sf.replace("0.001", "0.01")
    docs, labels = documents(spark, folder), spark.read.parquet(f"{folder}/labels.parquet")
    scored = score(docs, train(docs, labels, may_learn=~is_held_out())).where(is_held_out()).join(labels, "doc_id")
    right = scored.agg(F.avg(((F.col("score") >= 0.5).cast("int") == F.col("quality")).cast("double"))).first()[0]
    assert right > 0.95


def test_awkward_rows(spark, awkward, nothing):
    labels = spark.createDataFrame([(0, 1, 0), (0, None, 0), (None, 1, 0), (9, 0, 0), (10, 0, 1), (10, 0, 1)], "doc_id BIGINT, quality INT, toxic INT")
    model = train(awkward, labels)
    scores = score(awkward, model).collect()
    assert len(scores) == awkward.count() and all(0 <= r.score <= 1 for r in scores)
    kept = without_low_quality(awkward, model)
    assert kept.columns == awkward.columns and kept.count() == sum(r.score >= 0.5 for r in scores)
    assert score(nothing, model).count() == 0 and without_low_quality(nothing, model).count() == 0
    assert train(nothing, labels).scores(np.zeros((1, len(FEATURES)))).tolist() == [0.5]


def test_ids_that_come_many_times_are_bounded(spark, monkeypatch):
    docs = spark.range(3000).select(F.lit(5).cast("bigint").alias("doc_id"), F.concat_ws(" ", F.lit("some words"), F.col("id")).alias("text"))
    labels = spark.createDataFrame([(5, 1)] * 3, "doc_id BIGINT, quality INT")
    seen = []
    monkeypatch.setattr(quality, "fit", lambda x, y: seen.append(len(y)))
    quality.train(docs, labels, sample_rows=100)
    assert seen == [400]
