import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidelayer.llm.spelling import spelling_groups, word_counts
from tidelayer.llm.suite import op13_spelling

SCHEMA = "word STRING, n BIGINT"


def variants(word):
    """What is left without one code point, by place and without it."""
    return {(i, word[:i] + word[i + 1 :]) for i in range(len(word))}


def brute(counts):
    by_rest, near = {}, {w: set() for w in counts}
    for w in counts:
        for i, rest in variants(w):
            by_rest.setdefault((i, rest, len(w)), set()).add(w)
            if rest in near:
                near[w].add(rest)
                near[rest].add(w)
    for group in by_rest.values():
        for w in group:
            near[w] |= group - {w}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best is not None and counts[best] >= 2 * counts[w] else None
    out = []
    for w in counts:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, counts[w], len(near[w]), form[w], counts[form[w]] if form[w] else None, root))
    return sorted(out)


def vocabulary(seed, alphabet, size, longest=14):
    pick = random.Random(seed)
    stems = ["".join(pick.choice(alphabet) for _ in range(pick.randrange(5, longest))) for _ in range(size // 4)]
    words = set(stems)
    while len(words) < size:
        w, i = pick.choice(stems), pick.randrange(12)
        words.add(pick.choice([w[:i] + w[i + 1 :], w[:i] + pick.choice(alphabet) + w[i:], w[:i] + pick.choice(alphabet) + w[i + 1 :]]))
    return {w: pick.choice([3, 4, 6, 12, 50, 50, 400]) for w in words if len(w) >= 5}


def groups(spark, counts, **options):
    found = spelling_groups(spark.createDataFrame(list(counts.items()), SCHEMA).repartition(3), **options)
    return sorted(map(tuple, found.select("word", "n", "n_near", "form", "form_n", "root").collect()))


@pytest.mark.parametrize(
    ("alphabet", "options"),
    [("ab", {"frequent": 5}), ("abcdéß", {"frequent": 3}), ("ab", {"frequent": 5, "most": 2}), ("abcé𝒳", {"frequent": 10, "most": 2}), ("ab", {"longest": 2})],
)
def test_against_brute_force(spark, alphabet, options):
    counts = vocabulary(len(alphabet), alphabet, 1200)
    assert groups(spark, counts, **options) == brute(counts)


def test_runs_of_one_letter(spark):
    counts = {"a" * k: 3 * 4**k for k in range(5, 12)} | {"a" * k + "b" + "a" * (8 - k): 5 for k in range(9)} | {"x" * 3000: 3, "x" * 3001: 9}
    assert groups(spark, counts, frequent=2) == groups(spark, counts, frequent=2, most=2) == brute(counts)


def damaged_counts(rows):
    counts = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            if doc is not None and (h := zlib.crc32(f"{doc}:{w}".encode())) % 97 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            counts[w] += 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def test_query_against_brute_force(spark, tmp_path):
    pick = random.Random(9)
    stems = list(vocabulary(4, "abcdeÉé", 400, 9))
    rows = [(i, " ".join(pick.choice([str.lower, str.upper, str.title])(pick.choice(stems)) for _ in range(80)) + "-Öl×÷ ab") for i in range(400)]
    rows += [(None, "worda wordb worda worda wordb wordb"), (7, None), (8, ""), (9, "?! 12")]
    spark.createDataFrame(rows, "doc_id BIGINT, text STRING").withColumn("word", F.lit("x")).write.parquet(str(tmp_path / "documents.parquet"))
    got = op13_spelling(spark, str(tmp_path)).select("word", "n", "n_near", "form", "form_n", "root").collect()
    assert sorted(map(tuple, got)) == brute(damaged_counts(rows)) and any(r.form for r in got)


def test_awkward(spark, awkward, nothing):
    counts = damaged_counts([(None, r.text) for r in awkward.select("text").collect()])
    vocabulary_of = word_counts(awkward)
    assert {r.word: r.n for r in vocabulary_of.collect()} == counts
    found = spelling_groups(vocabulary_of)
    assert sorted(map(tuple, found.select("word", "n", "n_near", "form", "form_n", "root").collect())) == brute(counts)
    assert spelling_groups(word_counts(nothing)).count() == 0
