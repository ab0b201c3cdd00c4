import random
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

from tests.llm.conftest import PROSE
from tidelayer.llm.passages import (
    SEND,
    References,
    Repeats,
    _planes,
    _ranges_of_single,
    _read_planes,
    _sliced,
    compact_windows,
    frequent_shingles,
    overlaps,
    repeated_passages,
    sequence_keys,
    shared_passages,
    similar_ranges,
    window_pairs,
)
from tidelayer.llm.texts import written
from tidelayer.llm.words import mixed
from tidelayer.session import shared_dir


def prose(seed, n):
    r = random.Random(seed)
    return [f"w{r.randint(0, 5000)}" for _ in range(n)]


def test_windows_are_those_of_the_definition():
    r = np.random.default_rng(1)
    values = r.integers(0, 60, 300).astype(np.uint64)
    first, last = np.array([0, 120, 120, 300]), np.array([120, 120, 290, 300])
    got = set(zip(*(x.tolist() for x in compact_windows(values, first, last, 10)), strict=True))
    expected = set()
    for a, b in zip(first, last):
        for c in range(a, b):
            low, high = c, c
            while low > a and values[low - 1] > values[c]:
                low -= 1
            while high + 1 < b and values[high + 1] >= values[c]:
                high += 1
            if high - low + 1 >= 10:
                expected.add((low, c, high))
    assert got == expected


def test_planted_passages(spark):
    shared, other = prose("p", 60), prose("q", 80)
    near = list(shared)
    near[30] = "edited"
    texts = {
        0: prose(0, 300) + shared + prose(1, 200),
        1: prose(2, 100) + shared + prose(3, 50),
        2: shared + prose(4, 10),
        3: prose(5, 70) + near + prose(6, 90),
        4: prose(7, 400),
        5: prose(8, 90) + shared[:30] + prose(9, 90),  # too short to count
        6: prose(10, 50) + other,
        7: other + prose(11, 50),
        8: prose(10, 50) + other,  # equal to 6
        9: prose(12, 20),
    }
    rows = [(i, " ".join(t).upper() if i == 2 else " ".join(t)) for i, t in texts.items()] + [(10, None), (11, ""), (None, " ".join(shared))]
    got = repeated_passages(spark.createDataFrame(rows, "doc_id BIGINT, text STRING").repartition(3)).collect()
    links = {(r.doc_id, r.of_doc_id) for r in got}
    named = {i for pair in links for i in pair}
    assert named == {0, 1, 2, 3, 6, 7, 8} and (8, 6) in links and (7, 6) in links
    for r in got:
        a, b = texts[r.doc_id][r.first_word : r.first_word + r.n_words], texts[r.of_doc_id][r.of_first_word : r.of_first_word + r.of_n_words]
        assert r.n_words >= 50 and r.of_n_words >= 50 and r.doc_id > r.of_doc_id
        sets = [{tuple(x[i : i + 5]) for i in range(len(x) - 4)} for x in (a, b)]
        assert abs(len(sets[0] & sets[1]) / len(sets[0] | sets[1]) - r.similarity) < 1e-12 and r.similarity >= 0.8
    exact = next(r for r in got if (r.doc_id, r.of_doc_id) == (1, 0))
    assert (exact.first_word, exact.n_words, exact.of_first_word) == (100, 60, 300)


def test_hot_passage(spark):
    shared = prose("hot", 70)
    rows = [(i, " ".join(prose(f"a{i}", 60) + shared + prose(f"b{i}", 60))) for i in range(300)]
    docs = written(spark.createDataFrame(rows, "doc_id BIGINT, text STRING").repartition(4), "hot")
    assert len(frequent_shingles(sequence_keys(docs), 300, 0.002).hashes) == 66
    for hot_share in (0.002, 2.0):  # with and without reference windows
        got = repeated_passages(docs, hot_share=hot_share).collect()
        assert {r.doc_id for r in got} | {r.of_doc_id for r in got} == set(range(300))
        assert len(got) < 300 * 6  # not the pairs of the group


def test_trimming():
    a = np.arange(200, dtype=np.uint64)
    x = np.concatenate([np.arange(900, 950), np.arange(50, 110), np.arange(990, 1000)]).astype(np.uint64)
    assert shared_passages(a, x, 46, 80) == [(50, 110, 50, 110, 1.0)]
    assert shared_passages(a, x, 61, 80) == []


def test_awkward_rows(awkward, nothing):
    got = {(r.doc_id, r.of_doc_id) for r in repeated_passages(awkward).collect()}
    assert {i for pair in got for i in pair} == {0, 8, 9, 16}
    assert repeated_passages(nothing).count() == 0
    assert PROSE


def test_long_list_of_a_common_shingle(spark):
    """Thousands of unrelated windows around one shingle, and pairs among them that share a passage: these meet whatever the list's length."""
    common = mixed(np.array([7], np.uint64))[0]
    n, rng = 6000, np.random.default_rng(3)
    near = rng.integers(0, 2**32, (n, 4)).astype("<u4")
    pairs = [(i, n - 1 - i) for i in range(1000, 1100)]
    for a, x in pairs:
        near[x] = near[a]
    key = np.arange(1, n + 1)
    held = [(key, np.full(n, common), np.full(n, -1), np.zeros(n, np.uint8), np.full(n, 60), np.full(n, 45), np.full(n, 45), near)]
    names = [c.split()[0] for c in SEND.split(", ")]
    rows = [dict(zip(names, r, strict=True)) for r in _sliced(held, 5, References([]))]
    sent = spark.createDataFrame([tuple(r[c] for c in names) for r in rows], SEND)
    got = window_pairs(sent, 5, References([])).collect()
    met = {tuple(sorted(p)) for r in got for p in zip(np.frombuffer(r.a, "<i8").tolist(), np.frombuffer(r.x, "<i8").tolist(), strict=True)}
    assert {(a + 1, x + 1) for a, x in pairs} <= met
    assert len(met) < 5 * n  # never the square of the list


def test_passage_around_a_hot_notice(spark):
    """Pairs share 48 frequent words and 10 of their own: they meet, though the texts that stand for the notice lack the 10 words."""
    notice, texts = prose("notice", 48), {}
    for i in range(240):
        own = prose(f"own{i // 2}", 10) if i >= 200 else []
        texts[i] = prose(f"a{i}", 60) + notice + own + prose(f"b{i}", 60)
    rows = [(i, " ".join(t)) for i, t in texts.items()]
    docs = written(spark.createDataFrame(rows, "doc_id BIGINT, text STRING").repartition(3), "around")
    assert len(frequent_shingles(sequence_keys(docs), 240, 0.02).hashes) == 44
    got = {(r.doc_id, r.of_doc_id) for r in repeated_passages(docs, hot_share=0.02).collect()}
    assert {(i + 1, i) for i in range(200, 240, 2)} - got == set()


def similar(a, b):
    """Whether two passages, as sets of five words, are similar enough, and long enough."""
    sets = [{tuple(x[i : i + 5]) for i in range(len(x) - 4)} for x in (a, b)]
    return min(len(a), len(b)) >= 50 and 5 * len(sets[0] & sets[1]) >= 4 * len(sets[0] | sets[1])


@pytest.mark.parametrize("hot_share", [0.002, 1.0])
def test_recall_against_all_pairs(spark, hot_share):
    """Exact and edited, frequent and rare passages of 60 words: nine of ten texts that share one are named, the others are not."""
    r = random.Random(11)
    kinds = {"frequent": [prose("f", 60)] * 300, "rare": [prose(f"r{i // 2}", 60) for i in range(100)]}
    base = prose("e", 60)
    kinds["edited"] = [base[:k] + [f"edit{i}"] + base[k + 1 :] for i in range(300) for k in [r.choice([29, 30])]]
    kinds["edited pair"] = [p if i % 2 else p[:k] + ["x"] + p[k + 1 :] for i in range(100) for p in [prose(f"p{i // 2}", 60)] for k in [r.randrange(60)]]
    kinds["none"] = [prose(f"n{i}", 60) for i in range(200)]
    passages = [(kind, p) for kind, ps in kinds.items() for p in ps]
    rows = [(i, " ".join(prose(f"a{i}", r.randrange(80)) + p + prose(f"b{i}", r.randrange(80)))) for i, (_, p) in enumerate(passages)]
    got = repeated_passages(spark.createDataFrame(rows, "doc_id BIGINT, text STRING").repartition(4), hot_share=hot_share).collect()
    named = {x.doc_id for x in got} | {x.of_doc_id for x in got}
    for kind in kinds:
        mine = [i for i, (k, _) in enumerate(passages) if k == kind]
        linked = {i for i in mine for x in mine if i != x and similar(passages[i][1], passages[x][1])}
        assert len(linked & named) >= 0.9 * len(linked), (kind, len(linked & named), len(linked))
        assert kind != "none" or not linked and not named & set(mine)


def linked_by_brute_force(a, b, least=46):
    """Whether any ranges of the two shingle sequences, of that width at least, are similar enough."""
    sets = []
    for side, other in ((a, set(b)), (b, set(a))):
        every = {frozenset(side[i:j]) for i in range(len(side) - least + 1) for j in range(i + least, len(side) + 1)}
        sets.append([s for s in every if 5 * len(s & other) >= 4 * len(s)])
    return any(5 * len(p & q) >= 4 * len(p | q) for p in sets[0] for q in sets[1])


def shingle_list(words):
    return [tuple(words[i : i + 5]) for i in range(len(words) - 4)]


def test_similar_ranges_are_found_if_there_are_any():
    r, both = random.Random(5), 0
    for k in range(120):
        base = prose(f"base{k % 9}", 62) if k % 3 else (prose(f"few{k}", 23) * 3)[:62]
        side = list(base)
        for _ in range(r.choice([0, 1, 2, 2, 3])):
            at = r.randrange(10, 55)
            side[at : at + r.choice([0, 1, 2])] = prose(r.random(), r.choice([0, 1, 2]))
        if k % 5 == 0:
            side = side[30:] + side[:30]
        a, b = shingle_list(prose(f"s{k}", r.randrange(8)) + base), shingle_list(side + prose(f"t{k}", r.randrange(8)))
        number = {s: i for i, s in enumerate(dict.fromkeys(a + b))}
        got = similar_ranges(*(np.array([number[s] for s in x], np.uint64) for x in (a, b)), 46, 80)
        assert bool(got) == linked_by_brute_force(a, b), k
        for p, q, t, u, similarity in got:
            left, right = set(a[p:q]), set(b[t:u])
            assert min(q - p, u - t) >= 46 and similarity == len(left & right) / len(left | right) >= 0.8
        both += bool(got)
    assert 20 < both < 110


def test_classes_are_those_of_brute_force(spark):
    """Edited copies of few passages, each similar to some others only: no link between two classes is left out, however few windows meet."""
    r, texts = random.Random(23), {}
    for i in range(24):
        passage = prose(f"source{i % 4}", 60)
        for at in r.sample([6, 24, 36, 54], 1 + i % 2):
            passage[at] = f"edit{i}x{at}"
        texts[i] = passage + prose(f"tail{i}", r.randrange(3))
    sides = {i: shingle_list(t) for i, t in texts.items()}
    class_of = {i: i for i in texts}
    links = [(a, x) for a in texts for x in texts if a < x and len(set(sides[a]) & set(sides[x])) >= 41 and linked_by_brute_force(sides[a], sides[x])]
    for _ in texts:
        for a, x in links:
            class_of[a] = class_of[x] = min(class_of[a], class_of[x])
    alone = set(texts) - {i for pair in links for i in pair}
    assert alone and len(set(class_of.values()) - alone) > 1
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in texts.items()], "doc_id BIGINT, text STRING").repartition(3)
    got = repeated_passages(docs, hashes=1, enough=1).collect()
    named = {i: c for row in got for i, c in ((row.doc_id, row.class_id), (row.of_doc_id, row.class_id))}
    assert named == {i: c for i, c in class_of.items() if i not in alone}


def test_ranges_without_repeats_are_those_of_brute_force():
    """Replaced, left out, added and moved values: a pair is found if any two ranges are similar, and only then."""
    r, both = random.Random(3), 0
    for _ in range(600):
        a, x, least = list(range(100, 100 + r.randrange(8, 20))), [], r.choice([4, 5, 6])
        x = list(a)
        for _ in range(r.randrange(5)):
            i, kind = r.randrange(len(x)), r.randrange(4)
            x = [x[:i] + [r.randrange(10**6, 10**9)] + x[i + 1 :], x[:i] + x[i + 1 :], x[:i] + [r.randrange(10**6, 10**9)] + x[i:], x[i:] + x[:i]][kind]
        for _ in range(r.randrange(4)):
            a[r.randrange(len(a))] = r.randrange(10**9, 10**12)
        if len(x) < least:
            continue
        got = _ranges_of_single(np.array(a), np.array(x), least, 80)
        assert bool(got) == linked_by_brute_force(a, x, least), (a, x, least)
        for p, q, t, u, similarity in got:
            left, right = set(a[p:q]), set(x[t:u])
            assert min(q - p, u - t) >= least and similarity == len(left & right) / len(left | right) >= 0.8
        both += bool(got)
    assert 200 < both < 580


def test_no_row_per_pair_of_a_group_that_stays_apart(spark):
    """Copies of one passage, each with two edits of its own: all pairs have enough in common to be looked at, none is similar."""
    r, passage, n = random.Random(4), prose("apart", 66), 160
    rows = []
    for i in range(n):
        text = list(passage)
        for at in (r.choice([20, 21, 22]), r.choice([42, 43, 44])):
            text[at] = f"edit{i}x{at}"
        rows.append((i, " ".join(prose(f"a{i}", 20) + text + prose(f"b{i}", 20))))
    folder = Path(shared_dir(spark)) / "tidelayer"
    before = set(folder.glob("*"))
    got = repeated_passages(spark.createDataFrame(rows, "doc_id BIGINT, text STRING").repartition(3))
    assert got.count() == 0
    sizes = [spark.read.parquet(str(f)).count() for f in set(folder.glob("*")) - before if list(f.glob("*.parquet"))]
    assert max(sizes) < 40 * n < n * (n - 1) / 2


def test_open_places_hold_all_ranges_that_share_enough():
    """Values that repeat count once: no range that shares enough of its distinct values is closed, and most others are."""
    r, kept, places = np.random.default_rng(8), 0, 0
    for _ in range(300):
        sizes = r.integers(4, 30, 3)
        values, shared = r.integers(0, r.integers(3, 25), sizes.sum()).astype(np.uint64), r.random(25) < r.random()
        mine, fewest = shared[values.astype(int)], int(r.integers(0, 6))
        inside = Repeats(values, sizes, 5).open(mine, 80, fewest)
        first = np.cumsum(sizes) - sizes
        for a, b in zip(first, first + sizes):
            for i in range(a, b):
                for j in range(i + 5, b + 1):
                    both, size = len(set(values[i:j][mine[i:j]].tolist())), len(set(values[i:j].tolist()))
                    if 5 * both >= 4 * size and 9 * both >= 4 * (size + fewest):
                        assert inside[i:j].all()
                        kept += 1
        places += int((~inside).sum())
    assert kept > 1000 and places > 1000


def test_repeated_lines_around_a_common_one_meet_nowhere(spark):
    """A line of its own again and again, and one that all texts have: no range is like one of another text, so none is compared."""
    common, rows = prose("common line", 24), []
    for i in range(120):
        line = prose(f"line{i}", 8)
        rows.append((i, " ".join(line * 15 + common + line * 15)))
    folder = Path(shared_dir(spark)) / "tidelayer"
    before = set(folder.glob("*"))
    assert repeated_passages(spark.createDataFrame(rows, "doc_id BIGINT, text STRING").repartition(3)).count() == 0
    assert [spark.read.parquet(str(f)).count() for f in set(folder.glob("blocks-*")) - before] == [0]


def test_overlaps_are_those_of_all_places():
    r, found = np.random.default_rng(2), 0
    for _ in range(100):
        n = int(r.integers(1, 40))
        pair, number, at = np.sort(r.integers(0, 4, n)), r.integers(0, 8, n).astype(np.uint8), r.integers(60, 160, n)
        wide = [r.integers(0, 50, n) for _ in range(4)]
        place = np.stack([at, wide[0], wide[1], at + r.integers(-15, 25, n), wide[2], wide[3]], 1).astype("<u4")
        back, on, shift = np.minimum(wide[0], wide[2]), np.minimum(wide[1], wide[3]), place[:, 3].astype(int) - at
        expected = []
        for p in set(pair.tolist()):
            mine = sorted(np.flatnonzero(pair == p).tolist(), key=lambda i: shift[i])
            groups = [[mine[0]]]
            for i in mine[1:]:
                if shift[i] - shift[groups[-1][-1]] > 10:
                    groups.append([])
                groups[-1].append(i)
            for g in groups:
                covered = [len({int(number[i]) for i in g if at[i] - back[i] <= q / 2 <= at[i] + on[i]}) >= 2 for q in range(440)]  # also between places
                edges = [q for q in range(1, 440) if covered[q] != covered[q - 1]]
                for a, b in zip(edges[::2], edges[1::2]):
                    a, b = a // 2, (b - 1) // 2
                    if b - a + 1 >= 23:
                        expected.append((p, a, b, max(0, a + min(shift[i] for i in g)), b + max(shift[i] for i in g)))
        got = sorted(zip(*(z.tolist() for z in overlaps(pair, number, place, 2, 46)), strict=True))
        assert got == sorted(expected)
        found += len(got)
    assert found > 100


def test_planes_give_numbers_back():
    numbers, rows = np.arange(7, 3000, 13).astype("<u4"), np.arange(60).astype("<u4").reshape(10, 6)
    table = pa.table({"n": [_planes(numbers[:50]), b"", _planes(numbers[50:])], "r": [_planes(rows[:4]), b"", _planes(rows[4:])]})
    assert (_read_planes(table, "n", "<u4") == numbers).all() and (_read_planes(table, "r", "<u4", 6) == rows).all()
    assert len(_read_planes(table.slice(0, 0), "n", "<u4")) == 0
