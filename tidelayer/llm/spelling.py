"""Spelling variants: words that differ by one inserted, deleted or replaced code point, found by a variable-length gram index.

Gram dictionary: a gram that occurs more than `frequent` times in the vocabulary is split further, so frequent grams are
continued by one more code point, up to `longest`, and all others end there. Only the frequent grams are kept; there are at most
2 * (places in the vocabulary) / frequent of them, and `frequent` is raised where that would be over `most_grams`.
A word is decomposed left to right: at every place the longest gram of the dictionary, unless one before it reaches as far.

Affected grams: with grams of at most q code points, an edit at place i leaves all grams that begin at i - q or before, and all
that begin behind i and end at i + q or behind: what the decomposition decides there does not depend on the edit. So each word
knows for each place which grams an edit can touch; words are sorted into classes of neighbouring lengths, and q is at most a
third of the length (two at least), which leaves a gram for every place.

List merging: two words with an edit at place i share all grams that the edit leaves. These cover a prefix and a suffix without
a gap, so the lists of all of them are merged by one key of both. Members of a list are compared in the code points between;
a pair counts only in the list of the place where it differs, so it is found once. Lists of over `most` words are parted
further by what is left when one code point of these is left out, which is exact as well.

A vocabulary is rows of `word` and `n`; words and counts come from texts by `word_counts`, where each row's share is added up
before it is shuffled. Null texts have no words. Empty tables give no rows. Lists hold each word once, however often it occurs.
Near words have the same prefix and suffix by two 64-bit hashes, and the same code points between.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelayer.llm.texts import importable, lean, slices, written
from tidelayer.llm.words import WEIGHTS, mixed

LETTERS = "A-Za-zÀ-ÿ"
SHORTEST_GRAM = 2
ROWS = "key BIGINT, check BIGINT, id BIGINT, longer BOOLEAN, begin INT, first INT, last INT, between STRING"


def word_counts(docs: DataFrame, text_col: str = "text", least_length: int = 5, least_count: int = 3, damage: Callable[[Column], Column] | None = None) -> DataFrame:
    """`word` and `n` of the maximal runs of letters with A-Z lower-cased; `damage` may change a run, given as a column."""
    runs = F.regexp_extract_all(F.coalesce(docs[text_col], F.lit("")), F.lit(f"[{LETTERS}]{{{least_length},}}"), F.lit(0))
    lower = F.translate("run", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = docs.withColumn("run", F.explode(runs)).withColumn("run", lower)
    words = words.select((damage(F.col("run")) if damage else F.col("run")).alias("word")).where(F.length("word") >= least_length)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_count)


def frequent_grams(vocabulary: DataFrame, longest: int, frequent: int, most_grams: int) -> dict[int, np.ndarray]:
    """Grams that are continued, by length, as sorted numbers of 21 bits a code point."""
    places = vocabulary.agg(F.sum(F.length("word"))).first()[0] or 0
    frequent = max(frequent, -(-(longest - SHORTEST_GRAM) * places // most_grams))
    found: dict[int, np.ndarray] = {}
    for size in range(SHORTEST_GRAM, longest):
        starts = F.when(F.length("word") >= size, F.sequence(F.lit(1), F.length("word") - size + 1)).otherwise(F.array().cast("array<int>"))
        grams = vocabulary.select("word", F.explode(starts).alias("p")).select(F.substring("word", F.col("p"), F.lit(size)).alias("gram"))
        kept = grams.groupBy("gram").count().where(F.col("count") > frequent).select("gram").collect()
        found[size] = np.sort(_packed(np.array([[ord(x) for x in r.gram] for r in kept], np.uint64).reshape(-1, size)))
    return found


def _packed(codes: np.ndarray) -> np.ndarray:
    out = np.zeros(len(codes), np.uint64)
    for k in range(codes.shape[1]):
        out = (out << np.uint64(21)) | codes[:, k]
    return out


def _is_in(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(values.shape, bool)
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


def gram_limit(length: int, longest: int) -> int:
    return min(longest, max(SHORTEST_GRAM, length // 3))


def decomposed(codes: np.ndarray, limit: int, frequent: dict[int, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """For words of one length: last place of the longest gram at each place, and whether the decomposition takes it."""
    words, length = codes.shape
    size = np.full((words, length - 1), SHORTEST_GRAM)
    goes_on = np.ones((words, length - 1), bool)
    packed = codes[:, :-1] << np.uint64(21) | codes[:, 1:]
    for k in range(SHORTEST_GRAM, limit):
        room = length - k  # places with another code point behind a gram of k
        goes_on[:, room:] = False
        goes_on[:, :room] &= _is_in(packed[:, :room], frequent[k])
        size += goes_on
        packed = packed[:, :room] << np.uint64(21) | codes[:, k:]
    end = np.arange(length - 1) + size - 1
    reach = np.maximum.accumulate(end, axis=1)
    taken = np.ones_like(goes_on)
    taken[:, 1:] = end[:, 1:] > reach[:, :-1]
    return end, taken


def _sums(codes: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all prefixes and of all suffixes."""
    words, length = codes.shape
    power = np.full(length, base, np.uint64)
    power[0] = 1
    power = np.multiply.accumulate(power)
    value = mixed(codes + np.uint64(base))
    zero = np.zeros((words, 1), np.uint64)
    before = np.concatenate([zero, np.add.accumulate(value * power, axis=1)], axis=1)
    behind = np.concatenate([np.add.accumulate((value * power[::-1])[:, ::-1], axis=1)[:, ::-1], zero], axis=1)
    return before, behind


def list_keys(codes: np.ndarray, shorter: int, limit: int, frequent: dict[int, np.ndarray]) -> tuple[np.ndarray, ...]:
    """Keys of words of one length in the class of `shorter`: word, key, check, begin and end of what is between, first and last
    place of an edit that leaves the key. Words of one code point more than `shorter` are its longer ones."""
    words, length = codes.shape
    more = length - shorter
    end, taken = decomposed(codes, limit, frequent)
    reach = np.maximum.accumulate(end, axis=1)
    place = np.arange(shorter + 1)
    begin = np.zeros((words, shorter + 1), np.int64)
    inside = place >= limit
    begin[:, inside] = reach[:, np.minimum(place[inside] - limit, length - 2)] + 1
    close = np.full((words, shorter + 1), length)
    for far in range(2 * limit, 0, -1):  # the nearest one is written last
        p = place + more + far
        ok = p < length - 1
        good = taken[:, p[ok]] & (end[:, p[ok]] >= place[ok] + more + limit)
        close[:, ok] = np.where(good, p[ok], close[:, ok])
    new = np.ones_like(begin, bool)
    new[:, 1:] = (begin[:, 1:] != begin[:, :-1]) | (close[:, 1:] != close[:, :-1])
    word, first = np.nonzero(new)
    last = np.append(first[1:] - 1, shorter)
    last[np.append(word[1:] != word[:-1], True)] = shorter
    a, b = begin[word, first], close[word, first]
    keys = []
    for base in (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03):
        before, behind = _sums(codes, base)
        shape = a.astype(np.uint64) * WEIGHTS[2] + (length - b).astype(np.uint64) * WEIGHTS[3] + np.full(len(a), shorter, np.uint64) * WEIGHTS[4]
        keys.append(mixed(before[word, a] * WEIGHTS[0] + behind[word, b] * WEIGHTS[1] + shape).view(np.int64))
    return word, *keys, a, b, first, last


def gram_index(vocabulary: DataFrame, frequent: dict[int, np.ndarray], longest: int, least_length: int) -> DataFrame:
    """A row for each list that a word (columns `id`, `word`) is in."""

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, words = batch.column("id").to_numpy(zero_copy_only=False), batch.column("word").to_pylist()
            for a, b in slices(words, 200_000):
                sizes = np.array([len(w) for w in words[a:b]])
                for length in np.unique(sizes).tolist():
                    mine = np.flatnonzero(sizes == length) + a
                    same = [words[k] for k in mine.tolist()]
                    codes = np.frombuffer("".join(same).encode("utf-32-le"), np.uint32).reshape(-1, length).astype(np.uint64)
                    for shorter in (length, length - 1):
                        if shorter < least_length:
                            continue
                        word, key, check, begin, close, first, last = list_keys(codes, shorter, gram_limit(shorter, longest), frequent)
                        between = [same[w][x:y] for w, x, y in zip(word.tolist(), begin.tolist(), close.tolist(), strict=True)]
                        longer = pa.array(np.full(len(word), length > shorter))
                        places = [pa.array(x.astype(np.int32)) for x in (begin, first, last)]
                        columns = [pa.array(key), pa.array(check), pa.array(ids[mine[word]]), longer, *places, pa.array(between, pa.string())]
                        yield pa.RecordBatch.from_arrays(columns, names=["key", "check", "id", "longer", "begin", "first", "last", "between"])

    return vocabulary.select("id", "word").mapInArrow(lean(index), ROWS)


class _Lists:
    """Members of lists, in the order of the lists: numbers of the lists and what is compared."""

    def __init__(self, batch: pa.Table):
        def column(name: str) -> np.ndarray:
            return batch.column(name).to_numpy()

        self.id, self.longer, self.begin, self.first, self.last = (column(c) for c in ("id", "longer", "begin", "first", "last"))
        texts = batch.column("between").to_pylist()
        self.size = np.array([len(t) for t in texts], np.int64)
        self.codes = np.zeros((len(texts), int(self.size.max(initial=0)) + 1), np.uint32)
        flat = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32) if any(texts) else np.empty(0, np.uint32)
        row = np.repeat(np.arange(len(texts)), self.size)
        self.codes[row, np.arange(len(flat)) - np.repeat(np.cumsum(self.size) - self.size, self.size)] = flat

    def near(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Whether members x and y, which share a list, are near, and differ at a place of this list."""
        swap = self.size[x] < self.size[y]
        x, y = np.where(swap, y, x), np.where(swap, x, y)
        left, right = self.codes[x], self.codes[y]
        differ = left != right
        at = differ.argmax(axis=1)
        replaced = ~self.longer[x] & ~self.longer[y] & (differ.sum(axis=1) == 1)
        later = np.arange(left.shape[1] - 1) >= at[:, None]
        removed = self.longer[x] & ~self.longer[y] & ~((left[:, 1:] != right[:, :-1]) & later).any(axis=1)
        place = self.begin[x] + at
        here = (place >= self.first[x]) & (place <= self.last[x]) & (place >= self.first[y]) & (place <= self.last[y])
        return (replaced | removed) & here

    def pairs(self, number: np.ndarray, rows: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Near members among `rows`, which are in the order of their lists `number`."""
        ends = np.searchsorted(number, number, "right")
        open_ = np.arange(len(rows))
        for step in range(1, len(rows)):
            open_ = open_[open_ + step < ends[open_]]
            if not len(open_):
                return
            for k in range(0, len(open_), 500_000):
                x, y = rows[open_[k : k + 500_000]], rows[open_[k : k + 500_000] + step]
                good = self.near(x, y)
                yield x[good], y[good]

    def parted(self, number: np.ndarray, rows: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The same for long lists: members meet where the same is left when one code point is left out."""
        codes, size = self.codes[rows], self.size[rows]
        forms = []
        for k in range(codes.shape[1]):
            has = np.flatnonzero(k < size)
            out = np.delete(codes[has], k, axis=1)
            short = ~self.longer[rows[has]]
            # replaced: the same place is left out of both; removed: the longer without one is the shorter as it is
            again = (k > 0) & (codes[has, k] == codes[has, k - 1]) if k else np.zeros(len(has), bool)
            forms.append((has[short], np.full(int(short.sum()), k + 1), out[short]))
            forms.append((has[~short & ~again], np.zeros(int((~short & ~again).sum()), np.int64), out[~short & ~again]))
        whole = np.flatnonzero(~self.longer[rows])
        forms.append((whole, np.zeros(len(whole), np.int64), codes[whole][:, :-1]))
        member = np.concatenate([f[0] for f in forms])
        kind = np.concatenate([f[1] for f in forms])
        value = mixed(number[member].astype(np.uint64) * WEIGHTS[5] + kind.astype(np.uint64))
        text = np.concatenate([f[2] for f in forms])
        for k in range(text.shape[1]):
            value = mixed(value * WEIGHTS[6] + text[:, k])
        order = np.argsort(value, kind="stable")
        for x, y in self.pairs(value[order], rows[member[order]]):
            yield x, y


def near_words(index: DataFrame, most: int = 1000) -> DataFrame:
    """`id` and `other` of all near words, both ways, each once."""

    def compared(table: pa.Table) -> Iterator[pa.RecordBatch]:
        key, check = table.column("key").to_numpy(), table.column("check").to_numpy()
        new = np.append(True, (key[1:] != key[:-1]) | (check[1:] != check[:-1]))
        number = np.cumsum(new) - 1
        count = np.bincount(number)
        shared = np.flatnonzero(count[number] > 1)
        if not len(shared):
            return
        lists, number = _Lists(table.take(pa.array(shared))), number[shared]
        long = count[number] > most
        rows = np.arange(len(shared))
        for run, some in ((lists.pairs, ~long), (lists.parted, long)):
            for x, y in run(number[some], rows[some]) if some.any() else ():
                if len(x):
                    both = np.concatenate([lists.id[x], lists.id[y]]), np.concatenate([lists.id[y], lists.id[x]])
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in both], names=["id", "other"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: pa.Table | None = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = pa.concat_tables([kept, table]) if kept is not None else table
            if not table.num_rows:
                continue
            key = table.column("key").to_numpy()
            cut = int(np.searchsorted(key, key[-1], "left"))  # the last list may go on
            kept = table.slice(cut).combine_chunks()
            yield from compared(table.slice(0, cut)) if cut else ()
        if kept is not None and kept.num_rows:
            yield from compared(kept)

    return index.repartition(F.col("key")).sortWithinPartitions("key", "check").mapInArrow(lean(merge), "id BIGINT, other BIGINT")


def roots(forms: DataFrame) -> DataFrame:
    """`id` and `root`: where the pointers from `id` to `form_id` end. Each round doubles how far they reach."""
    ahead = written(forms.select("id", F.col("form_id").alias("root")), "roots")
    while True:
        onward = ahead.select(F.col("id").alias("root"), F.col("root").alias("next"))
        further = written(ahead.join(onward, "root", "left").select("id", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        ahead = further.drop("moved")
        if not further.where("moved").limit(1).count():
            return ahead


def spelling_groups(
    vocabulary: DataFrame,
    ratio: float = 2.0,
    longest: int = 4,
    frequent: int = 500,
    most_grams: int = 100_000,
    least_length: int = 5,
    most: int = 1000,
) -> DataFrame:
    """`word`, `n`, `n_near`, `form` and `form_n` (near word of largest n, the smallest of equals, where its n is `ratio` times the
    word's at least) and `root` (the last form, the word itself if it has none) for distinct words of `least_length` or more."""
    if not 2 <= longest <= 4:
        raise ValueError("grams of 2 to 4 code points can be told apart by 63 bits")
    importable(vocabulary.sparkSession)
    ordered = vocabulary.select("word", "n").where(F.length("word") >= least_length).orderBy(F.desc("n"), "word")
    words = written(ordered.withColumn("id", F.monotonically_increasing_id()), "vocabulary")  # the smaller id is the better form
    grams = frequent_grams(words, longest, frequent, most_grams)
    pairs = near_words(gram_index(words, grams, longest, least_length), most)
    near = pairs.groupBy("id").agg(F.count(F.lit(1)).alias("n_near"), F.min("other").alias("form_id"))
    other = words.select(F.col("id").alias("form_id"), F.col("word").alias("form"), F.col("n").alias("form_n"))
    found = words.join(near, "id").join(other, "form_id")
    better = F.col("form_n") >= F.col("n") * ratio
    found = written(found.select("id", "n_near", *(F.when(better, F.col(c)).alias(c) for c in ("form_id", "form", "form_n"))), "near-words")
    ends = roots(found.where("form_id IS NOT NULL")).join(words.select(F.col("id").alias("root"), F.col("word").alias("root_word")), "root").select("id", "root_word")
    out = words.join(found, "id", "left").join(ends, "id", "left")
    return out.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), "form", "form_n", F.coalesce("root_word", "word").alias("root"))
