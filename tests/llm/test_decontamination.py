import random
import re

import pytest
from pyspark.sql import functions as F

from tidelayer.llm import decontamination
from tidelayer.llm.decontamination import contamination, without_contaminated, without_passages

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, width=10):
    windows = {}
    for item, text in items:
        w = words_of(text)
        k = min(width, len(w))
        for i in range(len(w) - k + 1 if k else 0):
            windows.setdefault(tuple(w[i : i + k]), set()).add(item)
    out = []
    for doc, text in docs:
        w, hit, met = words_of(text), set(), set()
        for k in {len(x) for x in windows}:
            for i in range(len(w) - k + 1):
                if tuple(w[i : i + k]) in windows:
                    hit.update(range(i, i + k))
                    met |= {str(x) for x in windows[tuple(w[i : i + k])] if x is not None}
        out.append((doc, len(w), tuple(sorted(hit)), tuple(sorted(met))))
    return sorted(out, key=str)


def result(found):
    return sorted(
        (
            (r.doc_id, r.n_words, tuple(w for s in r.spans for w in range(s.first_word, s.end_word)), tuple(sorted(r["items"])))
            for r in found.select("row.doc_id", "n_words", "spans", "items").collect()
        ),
        key=str,
    )


@pytest.fixture(scope="module")
def corpus():
    pick = random.Random(5)
    vocabulary = [f"w{i}" for i in range(30)] + ["É", "naïve", "x1", "你好", "Öl"]
    passages = [[pick.choice(vocabulary) for _ in range(pick.choice([0, 1, 3, 9, 10, 11, 40]))] for _ in range(60)]
    items = [(i % 50, pick.choice([" ", ", ", "\n"]).join(p)) for i, p in enumerate(passages)] + [(None, " ".join(["lost"] * 12)), (7, None), (8, "!?")]
    docs = []
    for i in range(300):
        words = [pick.choice(vocabulary).upper() if pick.random() < 0.2 else pick.choice(vocabulary) for _ in range(pick.randrange(60))]
        for _ in range(pick.randrange(3)):
            words[pick.randrange(len(words) + 1) : 0] = pick.choice(passages)
        docs.append((i % 290, pick.choice([" ", "-", ". "]).join(words)))
    docs += [(None, " ".join(["Lost"] * 13)), (1000, None), (1001, ""), (1002, " \n")]
    return docs, items


def frames(spark, docs, items):
    return (
        spark.createDataFrame(docs, "doc_id BIGINT, text STRING").withColumn("row", F.lit(1)).withColumn("items", F.lit("x")).repartition(3),
        spark.createDataFrame(items, "item_id BIGINT, text STRING"),
    )


@pytest.mark.parametrize("options", [{}, {"block_bytes": 500}])
def test_against_brute_force(spark, corpus, options):
    docs, items = frames(spark, *corpus)
    assert result(contamination(docs, items, **options)) == brute(*corpus)


def test_long_texts_in_parts(spark, corpus, monkeypatch):
    monkeypatch.setattr(decontamination, "PART", 50)
    docs, items = corpus
    windows = decontamination.Windows([str(i) for i, _ in items], [" ".join(words_of(t)).encode() for _, t in items], 10)
    whole = " ".join(t or "" for _, t in docs[:40])
    n, spans, met = decontamination._scan_text(decontamination.as_bytes(whole.encode()), windows, 9)
    expected = brute([(0, whole)], [(str(i), t) for i, t in items])[0]
    assert (n, tuple(w for a, b, _, _ in spans for w in range(a, b)), tuple(sorted(windows.items_of(met)))) == expected[1:]
    for a, b, x, y in spans:
        assert words_of(whole.encode()[x:y].decode()) == words_of(whole)[a:b]


def test_removal(spark):
    passage = " ".join(f"p{i}" for i in range(12))
    docs = spark.createDataFrame([("a", f"Öne, {passage.upper()} two"), ("b", "clean"), ("c", None), ("d", passage)], "doc_id STRING, text STRING")
    items = spark.createDataFrame([("q", passage)], "item_id STRING, text STRING")
    assert dict(without_passages(docs, items).collect()) == {"a": "Öne,  two", "b": "clean", "c": None, "d": ""}
    assert sorted(r.doc_id for r in without_contaminated(docs, items).collect()) == ["b", "c"]
    assert sorted(r.doc_id for r in without_contaminated(docs, items, max_share=0.9).collect()) == ["a", "b", "c"]


def test_awkward(spark, awkward, nothing):
    items = awkward.select(F.col("doc_id").alias("item_id"), "text", F.lit(1).alias("n_words"))
    rows = [(r.doc_id, r.text) for r in awkward.select("doc_id", "text").collect()]
    assert result(contamination(awkward, items)) == brute(rows, rows)
    assert contamination(awkward, items.limit(0)).where("size(spans) > 0 OR size(items) > 0").count() == 0
    assert contamination(nothing, items).count() == 0
    assert without_passages(awkward, items).columns == awkward.columns
