import re
from collections import defaultdict

from pyspark.sql import functions as F

from tests.llm.conftest import PROSE
from tidelayer.llm.components import components
from tidelayer.llm.jaccard import frequent_shingles, linked_components, send_shingles, set_keys, without_near_copies
from tidelayer.llm.texts import written


def shingles(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall("[^\x20\x09-\x0d]+", lowered)
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(rows):
    sets = [shingles(r.text) for r in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                parent[find(i)] = find(j)
    least = defaultdict(lambda: None)
    for i, r in enumerate(rows):
        if r.doc_id is not None and (least[find(i)] is None or r.doc_id < least[find(i)]):
            least[find(i)] = r.doc_id
    return sorted(((r.doc_id, len(sets[i]), least[find(i)]) for i, r in enumerate(rows)), key=repr)


def test_against_brute_force(awkward):
    got = sorted(map(tuple, linked_components(awkward).collect()), key=repr)
    assert got == brute(awkward.select("doc_id", "text").collect())


def test_chains_and_near_groups(spark):
    """Copies with edits at different places: neighbours link, the ends of a chain do not."""
    words = PROSE.split(" ")
    texts = []
    for i in range(40):
        words = list(words)
        words[i * 10] = f"edit{i}"
        texts.append(" ".join(words))
    for i in range(60):
        other = PROSE.split(" ")
        other[i * 5 + 3] = f"other{i}"
        texts.append(" ".join(other))
    docs = written(spark.createDataFrame(list(enumerate(texts)), "doc_id BIGINT, text STRING").repartition(5), "near")
    expected = brute(docs.collect())
    for hot_share in (0.4, 2.0):
        assert sorted(map(tuple, linked_components(docs, per_slice=500, hot_share=hot_share).collect()), key=repr) == expected


def test_frequent_shingles(spark):
    """A passage that a third of the texts have does not travel to one place, and links nothing by itself."""
    passage = " ".join(f"p{i}" for i in range(30))
    texts = [" ".join(f"t{i}x{j}" for j in range(60)) + (" " + passage if i % 3 == 0 else "") for i in range(300)]
    docs = written(spark.createDataFrame(list(enumerate(texts)), "doc_id BIGINT, text STRING").coalesce(2), "hot")
    hot = frequent_shingles(set_keys(docs, 5, 0), 300)
    assert sorted(hot.times.tolist()) == [100] * 26
    slices = send_shingles(docs, 5, 0, 5, hot).selectExpr("slice >= 32 AS by_key", "length(low) div 4 AS n").groupBy("by_key").sum("n").collect()
    assert dict(map(tuple, slices))[True] == 2600
    assert {r.component_id == r.doc_id for r in linked_components(docs).collect()} == {True}


def test_threshold_is_met_exactly(spark):
    """Sets of 9 shingles that share 8 of 10: linked. One shared less: not."""
    base = [f"w{i}" for i in range(14)]
    texts = [" ".join(base[:13]), " ".join(base[1:14]), " ".join(base[2:14] + ["z"])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id BIGINT, text STRING")
    assert sorted(map(tuple, linked_components(docs).collect())) == brute(docs.collect())
    assert {r.component_id for r in linked_components(docs).collect() if r.doc_id < 2} == {0}


def test_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 101), (105, 100)] + [(200 + i, 200) for i in range(50)] + [(7, 7)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a BIGINT, b BIGINT")).collect()))
    assert {got[i] for i in range(31)} == {0} and {got[i] for i in (100, 101, 105)} == {100} and {got[i] for i in range(200, 250)} == {200}
    assert components(spark.createDataFrame([], "a BIGINT, b BIGINT")).count() == 0


def test_filter(awkward, nothing):
    kept = without_near_copies(awkward.where("doc_id IS NOT NULL"))
    assert kept.columns == awkward.columns
    assert sorted(r.doc_id for r in kept.where(F.col("text").contains("word1x1")).collect()) == [0]  # though its row occurs twice
    assert linked_components(nothing).count() == 0 and without_near_copies(nothing).count() == 0


def test_filter_tells_rows_of_one_id_apart(spark):
    """Rows without an id and versions of one id go or stay by their texts, and one of each group stays."""
    def near(name, k):
        return " ".join("edit" if i == 7 * k else f"{name}{i}" for i in range(150))

    rows = [(5, near("a", 1)), (None, near("a", 2)), (None, near("b", 1))]  # a near copy and a clean text without ids
    rows += [(7, near("a", 3)), (7, near("c", 1))]  # a repeated id: a near copy and a clean text
    rows += [(None, near("d", k)) for k in range(1, 5)] + [(9, near("e", k)) for k in range(1, 4)]  # groups without an id, of one id
    rows += [(None, near("f", 1)), (11, near("f", 2)), (None, ""), (None, None)]
    kept = without_near_copies(spark.createDataFrame(rows, "doc_id BIGINT, text STRING").repartition(3)).collect()
    assert sorted((r.text or "-").split("1")[0][:1] for r in kept) == ["-", "-", "a", "b", "c", "d", "e", "f"]
    assert {r.doc_id for r in kept if (r.text or "")[:1] in ("a", "f")} == {5, 11}
    assert {(r.doc_id, r.text) for r in kept} >= {(None, near("b", 1)), (7, near("c", 1))}


def test_rows_given_again_are_one_document(spark):
    near = PROSE.split(" ")
    near[200] = "other"
    rows = [(1, PROSE), (1, PROSE), (2, " ".join(near)), (3, "alone here"), (3, "alone here"), (None, "no id at all"), (None, "no id at all")]
    got = without_near_copies(spark.createDataFrame(rows, "doc_id BIGINT, text STRING").repartition(3)).collect()
    assert sorted(map(tuple, got), key=str) == sorted([(1, PROSE), (3, "alone here"), (None, "no id at all")], key=str)
