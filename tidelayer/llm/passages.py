"""Substring deduplication by compact windows: passages that two texts share, found wherever they stand.

0. Shingles are marked that two texts have; only regions where enough of them stand together are looked at from then on.
1. A text is the sequence of its word shingles. Under each of several hash functions, the Cartesian tree over the hash
   values groups all subsequences of at least the least length by their smallest value: a node at c whose range is l to r
   stands for every subsequence that starts in l..c and ends in c..r. Two texts can share a passage only if windows of
   equal value meet under enough hash functions.
2. Windows travel in packed slices of the value range. In a list of equal values every window is joined to the first one,
   and to the first one among those that also agree in 32 bits of a shingle some way ahead or behind: a list of k windows gives a few
   times k pairs, never k squared, and texts that share a whole passage meet also where others share a part of it.
   Shingles that more than one text in 500 has are found beforehand, with one text each that has it. Their windows are joined to
   that text's window, and meet by the shingle and the one 16 further on, so that a long list is split by what its texts share
   beyond the shingle; a list of more than 200,000 texts is dealt over several. All shingles have one order, frequent or not.
3. Per pair of texts, windows on nearby diagonals are intersected: where those of enough hash functions overlap on both
   sides lies a candidate.
4. Candidates are verified on the shingles of the texts themselves: the passages are trimmed to what they share, and stay if
   both have the least number of words and their sets of shingles have the least Jaccard similarity.
5. Documents that links connect are a class. What windows and star-wise lists leave out is found across classes: shingles that
   texts of two classes have are marked again, regions are cut to the parts whose distinct values can be similar to those of
   another class, and blocks of regions that have a shingle of their signatures in common are compared, pair by pair, for any
   two similar ranges. So no link between two classes is left out; inside a class not all pairs
   are listed. Pairs have no row of their own, but those of large groups that stay apart are all looked at.

Texts with equal word sequences are one text from the beginning; the result names each of them with the one that stands for
them. Texts that are null, empty or shorter than the least length share nothing. Rows without an id cannot be named and are
left out; rows of one id are versions of one text and not compared with each other. Other columns are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelayer.llm.components import components
from tidelayer.llm.jaccard import _ranges, _read, _runs
from tidelayer.llm.texts import give_back, id_and_text, lean, written
from tidelayer.llm.words import Words, mixed, word_slices

U64 = np.uint64
WIDTH = 5
AHEAD = (16, -16, 34, -34)
GRID = 32
HOT_SHARE = 0.002
LEVELS = tuple(round(f * 2**32) for f in (0, 0.1, 0.15, 0.2, 0.25, 0.3, 0.4, 0.6, 0.8))  # of the order of shingles in signatures
PER_BLOCK = 2048  # regions of a block, about
PER_LIST = 200_000  # texts of a frequent shingle that meet in one list at most
MARK = "slice BIGINT, keys BINARY, classes BINARY, sizes BINARY, counts BINARY, low BINARY, high BINARY, step BINARY"
BACK = "bucket BIGINT, keys BINARY, sizes BINARY, counts BINARY, at BINARY, shared BINARY, hashes BINARY"
REGIONS = "key BIGINT, start BIGINT, hashes BINARY, shared BINARY"
SIGNATURES = "token BIGINT, key BIGINT, start BIGINT, class BIGINT"
SEND = "slice BIGINT, keys BINARY, counts BINARY, low BINARY, high BINARY, hash BINARY, at BINARY, back BINARY, on BINARY, near BINARY"
PAIRS = "bucket BIGINT, a BINARY, x BINARY, hash BINARY, place BINARY"
SPAN = "key BIGINT, s BIGINT, e BIGINT, first BIGINT, hashes BINARY"
CANDIDATES = "a BIGINT, x BIGINT, sa BIGINT, ea BIGINT, sx BIGINT, ex BIGINT"
PASSAGES = "a BIGINT, a_first BIGINT, a_words BIGINT, x BIGINT, x_first BIGINT, x_words BIGINT, similarity DOUBLE"


def compact_windows(values: np.ndarray, first: np.ndarray, last: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nodes (l, c, r) of the Cartesian trees over ranges [first, last) of values, level by level, of at least that width."""
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    wide = last - first >= least
    a, b = first[wide], last[wide]
    while len(a):
        sizes = b - a
        starts = np.cumsum(sizes) - sizes
        v = values[np.repeat(a - starts, sizes) + np.arange(sizes.sum())]
        lowest = np.minimum.reduceat(v, starts)
        hits = np.flatnonzero(v == np.repeat(lowest, sizes))
        part = np.searchsorted(starts, hits, "right") - 1
        c = a[part] + hits - starts[part]
        new = np.append(True, part[1:] != part[:-1])
        low = np.where(new, a[part], np.append(0, c[:-1] + 1))  # of equal values the left one stands above the others
        wide = b[part] - low >= least
        found.append((low[wide], c[wide], b[part][wide] - 1))
        last_c = c[np.append(np.flatnonzero(new)[1:] - 1, len(c) - 1)]
        a, b = np.concatenate([low, last_c + 1]), np.concatenate([c, b])
        wide = b - a >= least
        a, b = a[wide], b[wide]
    if not found:
        return (np.empty(0, np.int64),) * 3
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


class Sequences:
    """Shingles in order, per text, with a key of the whole sequence (0 for texts without a shingle)."""

    def __init__(self, words: Words):
        self.hashes, owner, _ = words.shingles(WIDTH)
        count = len(words.bounds) - 1
        self.words = np.diff(words.bounds)
        self.n = np.bincount(owner, minlength=count)[:count]
        self.first = np.cumsum(self.n) - self.n
        self.last = self.first + self.n
        place = (np.arange(len(self.hashes)) - np.repeat(self.first, self.n)).astype(U64)
        sums = np.concatenate([np.zeros(1, U64), np.add.accumulate(mixed(self.hashes ^ mixed(place + U64(1))))])
        self.key = mixed(sums[self.last] - sums[self.first] + self.n.astype(U64)).view(np.int64)


def sequence_keys(rows: DataFrame, hot_share: float = HOT_SHARE) -> DataFrame:
    """`doc_id`, `key`, `words` per text; and, with `frequent` true, shingles (as `key`) that more than `hot_share` of the texts
    of some slice have, with their number there (as `words`) and one text that has it (as `doc_id`)."""
    names = ["doc_id", "key", "words", "frequent"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").to_numpy()
            for a, b, words in word_slices(batch.column("text")):
                s = Sequences(words)
                columns = [batch.column("doc_id").slice(a, b - a), pa.array(s.key), pa.array(s.words, pa.int64()), pa.array(np.zeros(b - a, bool))]
                yield pa.RecordBatch.from_arrays(columns, names=names)
                owner = np.repeat(np.arange(b - a), s.n)
                order = np.argsort(s.hashes, kind="stable")
                token, who = s.hashes[order], owner[order]
                new = np.append(True, (token[1:] != token[:-1]) | (who[1:] != who[:-1]))[: len(token)]  # once per text
                token, who = token[new], who[new]
                starts = _runs(token)
                times = np.diff(np.append(starts, len(token)))
                many = times > max(7, hot_share * (b - a))
                columns = [ids[a:b][who[starts[many]]], token[starts[many]].view(np.int64), times[many], np.ones(int(many.sum()), bool)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)

    return rows.mapInArrow(lean(run), "doc_id BIGINT, key BIGINT, words BIGINT, frequent BOOLEAN")


class References:
    """Frequent shingles, sorted, and for each and each hash function a window around it: key of its text, at, back, on."""

    def __init__(self, found: list[tuple[int, int, int]], per_list: int = PER_LIST):
        triples = sorted((shingle % 2**64, doc_id, texts) for shingle, doc_id, texts in found)
        self.hashes, self.ids = np.array([t[0] for t in triples], U64), np.array([t[1] for t in triples], np.int64)
        self.lists = np.array([-(-t[2] // per_list) for t in triples], U64)
        self.windows = np.zeros((0, 6), np.int64)
        self.cross = np.ones(len(triples), bool)

    def meet(self, regions: DataFrame) -> None:
        """Finds which of them texts of two classes have: regions come with the `class` of their text."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                r = Regions(batch)
                places, of = self.places(r.hashes), np.repeat(batch.column("class").to_numpy(), r.n)
                order = np.argsort(places, kind="stable")
                order = order[places[order] >= 0]
                starts = _runs(places[order])
                columns = [places[order][starts], *(f.reduceat(of[order], starts) if len(starts) else starts for f in (np.minimum, np.maximum))]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["place", "low", "high"])

        self.cross = np.zeros(len(self.hashes), bool)
        if len(self.hashes):
            found = regions.mapInArrow(lean(run), "place BIGINT, low BIGINT, high BIGINT").groupBy("place").agg(F.min("low").alias("low"), F.max("high").alias("high"))
            self.cross[[r["place"] for r in found.where("low < high").collect()]] = True

    def places(self, hashes: np.ndarray) -> np.ndarray:
        """The place of each hash among the frequent ones, or -1."""
        if not len(self.hashes):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, at, -1)

    def fill(self, regions: DataFrame, hashes: int, least: int) -> None:
        """Finds, for each frequent shingle, a text with it and its windows there."""
        if not len(self.hashes):
            return
        spark, salts = regions.sparkSession, mixed(np.arange(1, hashes + 1, dtype=U64))
        names = ["place", "number", "key", "at", "back", "on"]

        def having(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                r = Regions(batch)
                places = self.places(r.hashes)
                place, first = np.unique(places, return_index=True)
                key = np.repeat(r.key, r.n)[first]
                yield pa.RecordBatch.from_arrays([pa.array(place[place >= 0]), pa.array(key[place >= 0])], names=["place", "key"])

        chosen = regions.mapInArrow(having, "place BIGINT, key BIGINT").groupBy("place").agg(F.min("key").alias("key")).collect()
        self.keys = np.zeros(len(self.hashes), np.int64)
        for r in chosen:
            self.keys[r["place"]] = r["key"]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                r = Regions(batch)
                region_of, places = np.repeat(np.arange(len(r.n)), r.n), self.places(r.hashes)
                for i, salt in enumerate(salts):
                    low, at, high = compact_windows(mixed(r.hashes ^ salt), r.first, r.last, least)
                    place, region = places[at], region_of[at]
                    own = (place >= 0) & (self.keys[np.maximum(place, 0)] == r.key[region])
                    place, region, low, at, high = (x[own] for x in (place, region, low, at, high))
                    columns = [place, np.full(len(at), i), r.key[region], at - r.first[region] + r.start[region], at - low, high - at]
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)

        few = spark.createDataFrame(pa.table({"key": pa.array(np.unique([r["key"] for r in chosen]), pa.int64())}))
        found = regions.join(F.broadcast(few), "key").mapInArrow(lean(run), ", ".join(f"{c} BIGINT" for c in names))
        best = found.groupBy("place", "number").agg(F.max_by(F.struct("key", "at", "back", "on"), F.col("back") + F.col("on")).alias("w"))
        windows = best.select("place", "number", "w.*").orderBy("place", "number").collect()
        self.windows = np.array([list(r) for r in windows], np.int64).reshape(-1, 6)

    def of(self, place: np.ndarray, number: np.ndarray) -> np.ndarray:
        """The row of the window of each place and hash function, or -1."""
        if not len(self.windows):
            return np.full(len(place), -1)
        have, want = self.windows[:, 0] * 256 + self.windows[:, 1], place.astype(np.int64) * 256 + number
        at = np.minimum(np.searchsorted(have, want), len(have) - 1)
        return np.where(have[at] == want, at, -1)


def frequent_shingles(members: DataFrame, texts: int, hot_share: float) -> References:
    """Those that more than `hot_share` of all texts have: fewer than the mean number of shingles over `hot_share`."""
    counts = members.where("frequent").groupBy("key").agg(F.sum("words").alias("n"), F.min("doc_id").alias("doc_id"))
    return References([(r["key"], r["doc_id"], r["n"]) for r in counts.where(F.col("n") > hot_share * texts).collect()])


def _binary(rows: list[tuple], names: list[str], numbers: int = 1) -> list[pa.Array]:
    columns = list(zip(*rows, strict=True)) or [[] for _ in names]
    return [pa.array(c, pa.int64() if i < numbers else pa.binary()) for i, c in enumerate(columns)]


def _planes(numbers: np.ndarray) -> bytes:
    """The lowest bytes of all numbers, then the next ones, and so on: those that are all zero or all alike are compressed to next to nothing."""
    return np.ascontiguousarray(numbers.view(np.uint8).reshape(len(numbers), -1).T).tobytes()


def _read_planes(table: pa.Table, name: str, kind: str, width: int = 1) -> np.ndarray:
    """The numbers of all rows of a column; with `width`, so many as a row of an array."""
    size = np.dtype(kind).itemsize * width
    parts = [np.frombuffer(x, np.uint8).reshape(size, -1).T for x in table.column(name).to_pylist()]
    whole = np.ascontiguousarray(np.concatenate([np.empty((0, size), np.uint8), *parts])).view(kind)
    return whole if width > 1 else whole.ravel()


def _held_back(bits: int) -> np.uint64:
    """The bits of a hash that travel: 48 beside those of the slice."""
    return U64((2**64 - 1) ^ ((1 << max(0, 16 - bits)) - 1))


def _marks(held: list[tuple], bits: int, hot: References) -> list[tuple]:
    keys, classes, sizes, last, hashes, at = (np.concatenate(x) for x in zip(*held, strict=True))
    owner, known = np.repeat(np.arange(len(keys)), sizes), not np.array_equal(keys, classes)
    place = hot.places(hashes)
    by_key = (keys.view(U64) >> U64(64 - bits)) + U64(1 << bits)
    part = np.where(place >= 0, by_key[owner], hashes >> U64(64 - bits)).astype(np.uint32)
    token = np.where(place >= 0, place.astype(U64), (hashes >> U64(16 - bits)) & U64((1 << 48) - 1))
    order = np.argsort(part, kind="stable")
    part, owner, token, at = part[order], owner[order], token[order], at[order]
    new = np.append(True, (owner[1:] != owner[:-1]) | (part[1:] != part[:-1]))[: len(owner)]
    step = np.where(new, at, at - np.append(0, at[:-1])[: len(at)]).astype("<u4")
    rows, starts = [], _runs(part)
    for a, b in _ranges(starts, len(part)):
        runs = np.flatnonzero(new[a:b])
        who = owner[a:b][runs]
        counts = np.diff(np.append(runs, b - a)).astype("<u4")
        small = [_planes(x) for x in (last[who].astype("<u4"), counts)]
        small += [token[a:b].astype("<u4").tobytes(), (token[a:b] >> U64(32)).astype("<u2").tobytes(), _planes(step[a:b])]
        rows.append((int(part[a]), keys[who].tobytes(), classes[who].tobytes() if known else b"", *small))
    return rows


def send_marks(rows: DataFrame, least: int, bits: int, hot: References, batch_size: int = 2_000_000) -> DataFrame:
    """All shingles of all texts that are long enough, or of regions with the `class` of their text, by slice of the hash range.

    Classes are sent where they are not the keys of the texts.

    A text that occurs twice in a task is sent once. Frequent shingles go to further slices by the key of their text.
    """
    names, mask = [c.split()[0] for c in MARK.split(", ")], _held_back(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        held, size = [], 0
        for batch in batches:
            if "text" in batch.schema.names:
                parts = ((s.key, s.key, s.n, s.hashes & mask, np.zeros(len(s.n), np.int64), True) for _, _, w in word_slices(batch.column("text")) for s in [Sequences(w)])
            else:
                r = Regions(batch)
                parts = [(r.key, batch.column("class").to_numpy(), r.n, r.hashes, r.start, False)]
            for key, class_, n, hashes, start, once in parts:
                taken = n >= least
                for i in np.flatnonzero(taken).tolist() if once else []:
                    taken[i] = int(key[i]) not in seen
                    seen.add(int(key[i]))
                if len(seen) > 1_000_000:
                    seen.clear()
                place = np.arange(len(hashes)) - np.repeat(np.cumsum(n) - n - start, n)  # in the text
                every = np.repeat(taken, n)
                held.append((key[taken], class_[taken], n[taken], (start + n)[taken], hashes[every], place[every]))
                size += len(held[-1][4])
                if size >= batch_size:
                    yield pa.RecordBatch.from_arrays(_binary(_marks(held, bits, hot), names), names=names)
                    held, size = [], 0
        if size:
            yield pa.RecordBatch.from_arrays(_binary(_marks(held, bits, hot), names), names=names)

    return rows.mapInArrow(lean(run), MARK)


def marked(sent: DataFrame, bits: int, hot: References) -> DataFrame:
    """Shingles that texts of two classes have, and others that occur more than once, packed by bucket of the text's key."""
    names = [c.split()[0] for c in BACK.split(", ")]

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        give_back()
        slice_ = key[0].as_py()
        keys, counts, sizes = _read(table, "keys", "<i8"), _read_planes(table, "counts", "<u4").astype(np.int64), _read_planes(table, "sizes", "<u4")
        own = [k if len(c) == 0 else c for k, c in zip(table.column("keys").to_pylist(), table.column("classes").to_pylist(), strict=True)]
        classes = np.frombuffer(b"".join(own), "<i8")
        token = _read(table, "low", "<u4").astype(U64) | (_read(table, "high", "<u2").astype(U64) << U64(32))
        at = _read_planes(table, "step", "<u4").astype(np.int64)
        owner = np.repeat(np.arange(len(keys)), counts)
        begin, at = np.cumsum(counts) - counts, np.append(0, np.cumsum(at))
        at = at[1:] - np.repeat(at[begin], counts)
        once = np.zeros(len(keys), bool)  # what several tasks have sent is taken once
        once[np.unique(mixed(keys.view(U64) ^ mixed(at[begin].astype(U64))), return_index=True)[1]] = True
        taken = once[owner]
        token, at, owner = token[taken], at[taken], owner[taken]
        if slice_ >= 1 << bits:
            shared, hashes = hot.cross[token.astype(np.int64)], hot.hashes[token.astype(np.int64)]
        else:
            hashes = (U64(slice_) << U64(64 - bits)) | (token << U64(16 - bits))
            order = np.argsort(token, kind="stable")
            starts = _runs(token[order])
            of = classes[owner[order]]
            differ = np.minimum.reduceat(of, starts) != np.maximum.reduceat(of, starts)
            shared = np.empty(len(order), bool)
            shared[order] = np.repeat(differ, np.diff(np.append(starts, len(order))))
        kept = shared.copy()
        rest = np.flatnonzero(~shared)
        rest = rest[np.lexsort((keys[owner[rest]], token[rest]))]
        same = (token[rest][1:] == token[rest][:-1]) & (keys[owner[rest]][1:] == keys[owner[rest]][:-1])
        kept[rest[1:][same]] = kept[rest[:-1][same]] = True
        owner, at, shared, hashes = owner[kept], at[kept], shared[kept], hashes[kept]
        bucket = (keys.view(U64) >> U64(64 - bits)).astype(np.int64)[owner]
        order = np.argsort(bucket, kind="stable")
        owner, at, shared, hashes, bucket = (x[order] for x in (owner, at, shared, hashes, bucket))
        rows, starts = [], _runs(bucket)
        for a, b in _ranges(starts, len(bucket)):
            runs = _runs(owner[a:b])
            who = owner[a:b][runs]
            counts = np.diff(np.append(runs, b - a)).astype("<u4")
            small = (sizes[who], counts, at[a:b].astype("<u4"), shared[a:b], hashes[a:b])
            rows.append((int(bucket[a]), keys[who].tobytes(), *(_planes(x) for x in small)))
        return pa.table(_binary(rows, names), names=names)

    return sent.groupBy("slice").applyInArrow(run, BACK)


def _open(score: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Which positions lie in some range of their text whose scores add up to no less than 0."""
    first = np.append(True, text[1:] != text[:-1])[: len(text)]
    number = np.cumsum(first) - 1
    far = (np.abs(score).sum() + 1) * 2
    sums = np.cumsum(score) - far * number  # so lowest sums before and highest behind never reach into another text
    before = sums - score
    return np.minimum.accumulate(before) <= np.maximum.accumulate(sums[::-1])[::-1]


class Repeats:
    """Where the values of ranges of `sizes` places, one behind the other, stand again: `before` and `after` within the range, and how
    often (`times`); `kinds` are the distinct values of the `least` places from each on."""

    def __init__(self, values: np.ndarray, sizes: np.ndarray, least: int):
        count, self.least, self.sizes = len(values), least, sizes
        self.of = np.repeat(np.arange(len(sizes)), sizes)
        self.first = np.cumsum(sizes) - sizes
        order = np.argsort(values, kind="stable")
        order = order[np.argsort(self.of[order].astype(np.uint16 if len(sizes) < 1 << 16 else np.int64), kind="stable")]
        same = (values[order][1:] == values[order][:-1]) & (self.of[order][1:] == self.of[order][:-1])
        self.before, self.after, self.times = np.full(count, -1), np.full(count, 4 * count), np.ones(count, np.int64)
        self.before[order[1:][same]], self.after[order[:-1][same]] = order[:-1][same], order[1:][same]
        group = np.cumsum(np.append(True, ~same)[:count]) - 1
        self.times[order] = np.bincount(group)[group] if count else self.times
        self.kinds = self._distinct(np.arange(count))

    def _distinct(self, some: np.ndarray) -> np.ndarray:
        """How many distinct values, of those in the places `some`, the `least` places from each on have; right if these lie in the range."""
        first, last = self.first[self.of[some]], (self.first + self.sizes)[self.of[some]]
        low, high = np.maximum(some - self.least + 1, first), np.minimum(np.minimum(some, self.after[some] - self.least), last - self.least)
        good, count = high >= low, len(self.of) + 1
        return np.cumsum(np.bincount(low[good], minlength=count) - np.bincount(high[good] + 1, minlength=count))[:-1]

    def take(self, ranges: np.ndarray) -> tuple[Repeats, np.ndarray]:
        """The same of some ranges, which may come several times; and the places that they have here."""
        new = object.__new__(Repeats)
        new.least, new.sizes = self.least, self.sizes[ranges]
        new.first = np.cumsum(new.sizes) - new.sizes
        new.of = np.repeat(np.arange(len(ranges)), new.sizes)
        moved = np.repeat(new.first - self.first[ranges], new.sizes)
        places = np.arange(len(moved)) - moved
        new.before, new.after, new.times, new.kinds = self.before[places] + moved, self.after[places] + moved, self.times[places], self.kinds[places]
        return new, places

    def open(self, shared: np.ndarray, percent: int, fewest: np.ndarray | int = 0) -> np.ndarray:
        """The places of all parts of the ranges, of at least the least width, whose distinct values can be `percent` shared ones, and
        that can be similar to a set of `fewest` values.

        A value that is not shared counts in a part with 1 / `times` at least for each of its places. In any `least` places of such a
        part, no more values can be without a share than the shared ones of the whole part make up for. The part lies
        between places where that fails, so it is looked at again with what is shared there.
        """
        count, least = len(shared), self.least
        inside = _open(np.where(shared, (100 - percent) * 5040, -(percent * 5040 // self.times)), self.of)
        closed, place = np.append(0, np.cumsum(~inside)), np.arange(count)
        ok = (place + least <= (self.first + self.sizes)[self.of]) & (closed[np.minimum(place + least, count)] == closed[:-1])
        own = self._distinct(np.flatnonzero(~shared))
        need = self.kinds + (fewest[self.of] if isinstance(fewest, np.ndarray) else fewest)
        while True:
            at = np.flatnonzero(ok)
            new = np.flatnonzero(np.append(True, (np.diff(at) > 1) | (self.of[at][1:] != self.of[at][:-1]))[: len(at)])
            times = np.diff(np.append(new, len(at)))
            begin, size = at[new], times + least - 1
            part = np.repeat(np.arange(len(new)), size)
            places = np.arange(len(part)) - np.repeat(np.cumsum(size) - size - begin, size)
            most = np.repeat(np.bincount(part[shared[places] & (self.before[places] < begin[part])], minlength=len(new)), times)
            fits = (own[at] * percent <= (100 - percent) * most) & ((100 + percent) * most >= percent * need[at])
            if fits.all():
                break
            ok[at[~fits]] = False
        change = np.bincount(at, minlength=count + 1) - np.bincount(at + least, minlength=count + 1)
        return np.cumsum(change)[:-1] > 0


def regions_of(back: DataFrame, least: int, percent: int, distinct: bool = False) -> DataFrame:
    """Ranges of texts where a passage with a link can lie: at least `percent` of the values of some range there are shared.

    A shingle that is not gets a value of its own in its place, unless the text repeats it. `shared` has a byte per shingle. What the
    text repeats does not count against a range, unless the `distinct` values are looked at.
    """
    names = [c.split()[0] for c in REGIONS.split(", ")]

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        give_back()
        counts, sizes, at, hashes = (_read_planes(table, c, k) for c, k in (("counts", "<u4"), ("sizes", "<u4"), ("at", "<u4"), ("hashes", "<u8")))
        owner, sizes, at, shared = np.repeat(_read(table, "keys", "<i8"), counts), np.repeat(sizes.astype(np.int64), counts), at.astype(np.int64), _read(table, "shared", "?")
        order = np.lexsort((at, owner))
        starts = _runs(owner[order])
        times = np.diff(np.append(starts, len(order)))
        order = order[np.repeat(100 * times >= percent * least, times)]  # others have too few for any range
        owner, sizes, at, shared, hashes = owner[order], sizes[order], at[order], shared[order], hashes[order]
        starts = _runs(owner)
        if not len(starts):
            return pa.table(_binary([], names, 2), names=names)
        times = np.diff(np.append(starts, len(owner)))
        slack = times * (100 - percent) // percent + 1  # so many others on either side can the shared ones make up for
        low = np.maximum(0, at[starts] - slack)
        sizes = np.minimum(at[starts + times - 1] + 1 + slack, np.maximum.reduceat(sizes, starts)) - low
        begin = np.cumsum(sizes) - sizes
        place = np.repeat(begin - low, times) + at
        score, value = np.full(sizes.sum(), -percent, np.int64), np.zeros(sizes.sum(), U64)
        score[place], value[place] = np.where(shared, 100 - percent, 0), hashes
        text = np.repeat(np.arange(len(sizes)), sizes)
        real = np.zeros(len(score), bool)
        real[place] = True
        filler = np.flatnonzero(~real)
        value[filler] = mixed(mixed((filler - begin[text[filler]] + low[text[filler]]).astype(U64)) ^ owner[starts][text[filler]].view(U64))
        inside = Repeats(value, sizes, least).open(score > 0, percent) if distinct else _open(score, text)
        edge = np.flatnonzero(np.append(True, (inside[1:] != inside[:-1]) | (text[1:] != text[:-1])))
        out = []
        for a, b in _ranges(edge, len(inside)):
            if inside[a] and b - a >= least:
                out.append((int(owner[starts[text[a]]]), int(a - begin[text[a]] + low[text[a]]), value[a:b].tobytes(), (score[a:b] > 0).tobytes()))
        return pa.table(_binary(out, names, 2), names=names)

    return back.groupBy("bucket").applyInArrow(run, REGIONS)


class Regions:
    """Shingles of the regions of a batch, in order."""

    def __init__(self, batch: pa.RecordBatch):
        parts = [np.frombuffer(x, "<u8") for x in batch.column("hashes").to_pylist()]
        self.key, self.start = batch.column("key").to_numpy(), batch.column("start").to_numpy()
        self.n = np.array([len(x) for x in parts], np.int64)
        self.hashes = np.concatenate([np.zeros(0, U64), *parts])
        self.first = np.cumsum(self.n) - self.n
        self.last = self.first + self.n


def send_windows(regions: DataFrame, hashes: int, least: int, bits: int, hot: References, batch_size: int = 400_000) -> DataFrame:
    """The windows of all regions under all hash functions, by slice of their value.

    Windows around frequent shingles go to further slices, by the shingle and what stands `AHEAD[0]` shingles on: texts that share
    more than the shingle meet wherever they lie. Where that list may be too long still, it is dealt by text over several.
    """
    names = [c.split()[0] for c in SEND.split(", ")]
    salts = mixed(np.arange(1, hashes + 1, dtype=U64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            r = Regions(batch)
            region_of, places = np.repeat(np.arange(len(r.n)), r.n), hot.places(r.hashes)
            wide = (mixed(r.hashes) >> U64(32)).astype("<u4")
            for i, salt in enumerate(salts):
                values = mixed(r.hashes ^ salt)
                low, at, high = compact_windows(values, r.first, r.last, least)
                region = region_of[at]
                near = np.zeros((len(at), len(AHEAD)), "<u4")
                for j, step in enumerate(AHEAD):
                    inside = (at + step >= r.first[region]) & (at + step < r.last[region])
                    near[inside, j] = wide[at[inside] + step]
                begin = r.start[region] - r.first[region]
                held.append((r.key[region], values[at], places[at], np.full(len(at), i, np.uint8), at + begin, at - low, high - at, near))
                size += len(at)
            if size >= batch_size:
                yield pa.RecordBatch.from_arrays(_binary(_sliced(held, bits, hot), names), names=names)
                held, size = [], 0
        if size:
            yield pa.RecordBatch.from_arrays(_binary(_sliced(held, bits, hot), names), names=names)

    return regions.mapInArrow(lean(run), SEND)


def _sliced(held: list[tuple], bits: int, hot: References) -> list[tuple]:
    key, value, place, number, at, back, on, near = (np.concatenate(x) for x in zip(*held, strict=True))
    value = mixed(value)  # smallest values are small: mixed they fill all slices alike
    part = (value >> U64(64 - bits)).astype(np.int64)
    many = np.flatnonzero(place >= 0)
    if len(many):
        dealt = mixed(key[many].view(U64)) % hot.lists[place[many]]
        together = mixed(mixed(value[many] ^ mixed(near[many, 0].astype(U64))) + dealt)
        part[many] = (together >> U64(64 - bits)).astype(np.int64) + (1 << bits)
    order = np.lexsort((key, part))
    key, value, place, number, at, back, on, near, part = (x[order] for x in (key, value, place, number, at, back, on, near, part))
    token = np.where(place >= 0, place.astype(U64), (value >> U64(24 - bits)) & U64((1 << 40) - 1))
    rows, starts = [], _runs(part)
    for a, b in _ranges(starts, len(part)):
        runs = _runs(key[a:b])
        counts = np.diff(np.append(runs, b - a)).astype("<u4")
        small = [_planes(x[a:b].astype("<u4")) for x in (at, back, on)]
        parts = [token[a:b].astype("<u4").tobytes(), (token[a:b] >> U64(32)).astype(np.uint8).tobytes(), number[a:b].tobytes(), *small, near[a:b].tobytes()]
        rows.append((int(part[a]), key[a:b][runs].tobytes(), _planes(counts), *parts))
    return rows


def window_pairs(sent: DataFrame, bits: int, hot: References) -> DataFrame:
    """Windows of equal value from different texts, joined star-wise, packed by bucket of the pair of texts."""
    names = [c.split()[0] for c in PAIRS.split(", ")]

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        give_back()
        keys, counts = _read(table, "keys", "<i8"), _read_planes(table, "counts", "<u4")
        token = _read(table, "low", "<u4").astype(U64) | (_read(table, "high", "u1").astype(U64) << U64(32))
        number, at = _read(table, "hash", "u1"), _read_planes(table, "at", "<u4")
        owner = np.repeat(keys, counts)
        # a text that several tasks have sent is taken once
        same = mixed(mixed(token + number) ^ (at.astype(U64) << U64(20)) ^ owner.view(U64))
        places = np.unique(same, return_index=True)[1]
        places = places[np.argsort(token[places], kind="stable")]
        starts = _runs(token[places])
        frequent = key[0].as_py() >= 1 << bits
        if len(starts) and not frequent:
            low, high = np.minimum.reduceat(owner[places], starts), np.maximum.reduceat(owner[places], starts)
            places = places[np.repeat(low < high, np.diff(np.append(starts, len(places))))]
        owner, token, number, at = (x[places] for x in (owner, token, number, at))
        back, on, near = _read_planes(table, "back", "<u4")[places], _read_planes(table, "on", "<u4")[places], _read(table, "near", "<u4").reshape(-1, len(AHEAD))[places]
        if frequent:  # what the reference windows are to the others is appended behind them
            reference = hot.of(token, number)
            used = np.unique(reference[reference >= 0])
            own = hot.windows[used]
            centre = np.where(reference >= 0, len(owner) + np.searchsorted(used, reference), -1)
            differ = (centre >= 0) & (hot.windows[reference, 2] != owner) if len(used) else np.zeros(len(owner), bool)
            stars = [centre[differ].astype(U64) << U64(32) | np.flatnonzero(differ).astype(U64)]
            seed = mixed(token * U64(256) + number)
        else:
            own, stars, seed = np.zeros((0, 6), np.int64), [], token
        for j in range(-1, len(AHEAD)):
            group = mixed(seed) if j < 0 else mixed(seed ^ mixed(near[:, j].astype(U64) + (U64(j + 1) << U64(32))))
            order = np.lexsort((at, owner, group))
            starts = _runs(group[order])
            centre = np.repeat(order[starts], np.diff(np.append(starts, len(order))))
            differ = owner[centre] != owner[order]
            stars.append(centre[differ].astype(U64) << U64(32) | order[differ].astype(U64))
        stars = np.unique(np.concatenate(stars))
        owner = np.append(owner, own[:, 2])
        at, back, on = (np.append(x, own[:, c]).astype("<u4") for x, c in ((at, 3), (back, 4), (on, 5)))
        a, x = (stars >> U64(32)).astype(np.int64), (stars & U64(0xFFFFFFFF)).astype(np.int64)
        bucket = (mixed(owner[a].view(U64) * U64(3) + owner[x].view(U64)) >> U64(64 - bits)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        a, x, bucket = a[order], x[order], bucket[order]
        place = np.stack([at[a], back[a], on[a], at[x], back[x], on[x]], 1).astype("<u4")
        rows, starts = [], _runs(bucket)
        for i, j in _ranges(starts, len(bucket)):
            rows.append((int(bucket[i]), owner[a[i:j]].tobytes(), owner[x[i:j]].tobytes(), number[x[i:j]].tobytes(), _planes(place[i:j])))
        return pa.table(_binary(rows, names), names=names)

    return sent.groupBy("slice").applyInArrow(run, PAIRS)


def overlaps(pair: np.ndarray, number: np.ndarray, place: np.ndarray, enough: int, least: int) -> tuple[np.ndarray, ...]:
    """Where aligned windows of at least `enough` hash functions overlap, for all pairs of texts: the pair and its ranges of a and x."""
    if not len(pair):
        return (np.empty(0, np.int64),) * 5
    at_a, at_x = place[:, 0].astype(np.int64), place[:, 3].astype(np.int64)
    back, on = np.minimum(place[:, 1], place[:, 4]).astype(np.int64), np.minimum(place[:, 2], place[:, 5]).astype(np.int64)
    shift = at_x - at_a
    order = np.lexsort((shift, pair))
    group = np.cumsum(np.append(0, (np.diff(shift[order]) > 2 * WIDTH) | (np.diff(pair[order]) != 0)))[: len(order)]  # windows on nearby diagonals
    starts = _runs(group)
    low, high, of = shift[order][starts], shift[order][np.append(starts[1:], len(order)) - 1], pair[order][starts]
    begin, end, number = (at_a - back)[order], (at_a + on)[order], number[order].astype(np.int64)
    order = np.lexsort((begin, number, group))
    begin, end, group, number = begin[order], end[order], group[order], number[order]
    kind = np.cumsum(np.append(False, (np.diff(group) != 0) | (np.diff(number) != 0)))[: len(order)]
    some = np.bincount(group[_runs(kind)], minlength=len(starts))[group] >= enough
    begin, end, group, kind = begin[some], end[some], group[some], kind[some]
    far = int(end.max(initial=0)) + 1
    reach = np.maximum.accumulate(end + kind * far)
    new = np.append(True, (kind[1:] != kind[:-1]) | (begin[1:] + kind[1:] * far > reach[:-1]))[: len(kind)]  # of one hash function those that touch are one
    heads = np.flatnonzero(new)
    point = np.append(begin[heads], (reach - kind * far)[np.append(heads[1:], len(kind)) - 1] if len(heads) else heads)
    ends, group = np.repeat([0, 1], len(heads)), np.tile(group[heads], 2)
    order = np.lexsort((ends, point, group))
    point, ends, group = point[order], ends[order], group[order]
    covered = np.cumsum(1 - 2 * ends)
    first, last = (np.flatnonzero(x) for x in ((ends == 0) & (covered == enough), (ends == 1) & (covered == enough - 1)))
    wide = point[last] - point[first] + 1 >= least // 2
    start, stop, group = point[first][wide], point[last][wide], group[first][wide]
    return of[group], start, stop, np.maximum(0, start + low[group]), stop + high[group]


def candidates(pairs: DataFrame, enough: int, least: int) -> DataFrame:
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        give_back()
        a, x, number, place = _read(table, "a", "<i8"), _read(table, "x", "<i8"), _read(table, "hash", "u1"), _read_planes(table, "place", "<u4", 6)
        order = np.lexsort((x, a))
        a, x, number, place = a[order], x[order], number[order], place[order]
        new = np.append(True, (a[1:] != a[:-1]) | (x[1:] != x[:-1]))[: len(a)]
        pair, sa, ea, sx, ex = overlaps(np.cumsum(new) - 1, number, place, enough, least)
        cells = (sa // GRID * GRID, (ea // GRID + 1) * GRID, sx // GRID * GRID, (ex // GRID + 1) * GRID)
        found = np.unique(np.stack([a[new][pair], x[new][pair], *cells], 1), axis=0)
        return pa.table([pa.array(c, pa.int64()) for c in found.T], names=[c.split()[0] for c in CANDIDATES.split(", ")])

    return pairs.groupBy("bucket").applyInArrow(run, CANDIDATES)


def span_shingles(regions: DataFrame, spans: DataFrame, least: int) -> DataFrame:
    """The shingles of ranges `s` to `e` of texts, as far as regions go; `first` is where they begin."""
    names = [c.split()[0] for c in SPAN.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for key, start, hashes, wanted in zip(*(batch.column(c).to_pylist() for c in ("key", "start", "hashes", "spans")), strict=True):
                for w in wanted:
                    first, last = max(w["s"], start), min(w["e"], start + len(hashes) // 8)
                    if last - first >= least:
                        out.append((key, w["s"], w["e"], first, hashes[8 * (first - start) : 8 * (last - start)]))
            columns = list(zip(*out, strict=True)) or [[] for _ in names]
            kinds = [pa.int64()] * 4 + [pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)

    per_text = spans.groupBy("key").agg(F.collect_set(F.struct("s", "e")).alias("spans"))  # ends on a grid: a bounded number per text
    return regions.join(per_text, "key").select("key", "start", "hashes", "spans").mapInArrow(lean(run), SPAN)


def _segments(shared: np.ndarray, gap: int) -> list[tuple[int, int]]:
    """Ranges that begin and end with true and have no more than `gap` false in a row."""
    places = np.flatnonzero(shared)
    if not len(places):
        return []
    cuts = np.flatnonzero(np.diff(places) > gap + 1)
    return list(zip(places[np.append(0, cuts + 1)].tolist(), (places[np.append(cuts, len(places) - 1)] + 1).tolist(), strict=True))


def shared_passages(a: np.ndarray, x: np.ndarray, least: int, percent: int) -> list[tuple[int, int, int, int, float]]:
    """Trimmed ranges of two shingle sequences whose sets are similar enough: (a from, a to, x from, x to, similarity)."""
    found: list[tuple[int, int, int, int, float]] = []
    names, of = np.unique(np.concatenate([a, x]), return_inverse=True)
    a, x = of[: len(a)], of[len(a) :]

    def has(values: np.ndarray) -> np.ndarray:
        out = np.zeros(len(names), bool)
        out[values] = True
        return out

    in_x = has(x)[a]
    for gap in (2 * WIDTH, WIDTH, 0):
        for s, e in _segments(in_x, gap):
            if e - s < least or any(f[0] <= s and e <= f[1] for f in found):
                continue
            for t, u in _segments(has(a[s:e])[x], gap):
                if u - t < least:
                    continue
                right = has(x[t:u])
                inside = np.flatnonzero(right[a[s:e]])
                if not len(inside):
                    continue
                p, q = s + int(inside[0]), s + int(inside[-1]) + 1
                left = has(a[p:q])
                both, whole = np.count_nonzero(left & right), np.count_nonzero(left | right)
                if q - p >= least and 100 * both >= percent * whole:
                    found.append((p, q, t, u, both / whole))
    return found


def _before(values: np.ndarray) -> np.ndarray:
    """Where each value stood last, or -1."""
    order = np.argsort(values, kind="stable")
    before = np.full(len(values), -1)
    same = values[order][1:] == values[order][:-1]
    before[order[1:][same]] = order[:-1][same]
    return before


def fewest_values(values: np.ndarray, least: int) -> int:
    """The least number of distinct values of a range of that width."""
    before, begin = _before(values), np.arange(len(values) - least + 1)
    if (np.arange(len(values)) - before >= least)[before >= 0].all():
        return least
    return int((np.lib.stride_tricks.sliding_window_view(before, least) < begin[:, None]).sum(1).min())


def distinct_ranges(values: np.ndarray, shared: np.ndarray, least: int, fewest: int, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Ranges of at least that width, one for each set of values they have, that share enough values to be similar to a set of
    `fewest` values or more. Values are small numbers; `shared` is true where the other side has them.

    A range that is wider begins and ends with a shared value that it has nowhere else: without others it is more similar.
    """
    before, mine, last = _before(values), shared[values], len(values) - least
    marks = mixed(values.astype(U64) + U64(1))
    enough = mine.any() and len(np.unique(values[mine])) * 100 // percent  # no more distinct values than these can be similar
    view, found = np.lib.stride_tricks.sliding_window_view, []

    def fits(size: np.ndarray, both: np.ndarray) -> np.ndarray:
        return (both * 100 >= percent * size) & (both * (100 + percent) >= percent * (size + fewest))

    for i in range(0, last + 1, 4096):
        some = np.arange(i, min(i + 4096, last + 1))
        new = view(before, least)[some] < some[:, None]
        good = fits(new.sum(1), (new & view(mine, least)[some]).sum(1))
        name = np.where(new[good], view(marks, least)[some[good]], U64(0)).sum(1, dtype=U64)
        found.append((some[good], some[good] + least, name))
    starts = np.flatnonzero(mine[: last + 1])
    beyond, width = np.full(len(values) + 1, len(values)), len(values)
    beyond[before[before >= 0]] = np.flatnonzero(before >= 0)  # where the value of a place comes again
    starts, width = starts[beyond[starts] - starts >= least], min(width, 2 * enough + least)
    while len(starts):
        length = len(values) + width
        padded = [np.concatenate([x, fill]) for x, fill in ((before, np.full(width, length)), (mine, np.zeros(width, bool)), (marks, np.zeros(width, U64)))]
        short = []
        for i in range(0, len(starts), max(1, 1_000_000 // width)):
            some = starts[i : i + max(1, 1_000_000 // width)]
            new = view(padded[0], width)[some] < some[:, None]
            ours = new & view(padded[1], width)[some]
            size, both, step = np.cumsum(new, 1), np.cumsum(ours, 1), np.arange(width)
            good = ours & (step >= least) & (step < (beyond[some] - some)[:, None]) & fits(size, both)
            short.append(some[(size[:, -1] <= enough) & (some + width < len(values)) & (beyond[some] - some > width)])
            part, end = np.nonzero(good)
            if len(part):
                rows, at = np.unique(part, return_inverse=True)
                name = np.cumsum(np.where(new[rows], view(padded[2], width)[some[rows]], U64(0)), 1, dtype=U64)
                found.append((some[part], some[part] + end + 1, name[at, end]))
        starts, width = np.concatenate(short), 2 * width  # ranges of so few values that wider ones can be similar too
    begin, end, name = (np.concatenate(x) for x in zip(*found, strict=True))
    one = np.unique(name, return_index=True)[1]
    return begin[one], end[one]


def _ranges_of_single(a: np.ndarray, x: np.ndarray, least: int, percent: int, cells: int = 200_000) -> list[tuple[int, int, int, int, float]]:
    """`similar_ranges` of sequences in which no value stands twice: for each range of `a` that can be the best one, the best of `x`.

    What is shared counts 100 + `percent`, each place of either range takes `percent` off: ranges are similar where the sum is no
    less than 0. A best range of `a` has the least width, or begins and ends where a run that stands in `x` as well does: with more
    of that run, or without it, the sum would be greater.
    """
    order = np.argsort(a)
    found = order[np.minimum(np.searchsorted(a[order], x), len(a) - 1)]
    place = np.where(a[found] == x, found, -1)  # in a, of each value of x
    other = np.full(len(a) + 1, -2)
    other[place[place >= 0]] = np.flatnonzero(place >= 0)
    mine, follows = other[:-1] >= 0, (other[1:] >= 0) & (other[1:] == other[:-1] + 1)
    first, last = np.flatnonzero(mine & ~np.append(False, follows[:-1])), np.flatnonzero(mine & ~follows) + 1
    sums = np.append(0, np.cumsum(mine))

    def best(b: np.ndarray, e: np.ndarray) -> list[tuple[int, int, int, int, float]]:
        both, width = sums[e] - sums[b], e - b
        good = (100 * both >= percent * width) & ((100 + percent) * both >= percent * (width + least))
        b, e = b[good], e[good]
        step = max(1, cells // len(x))
        for i in range(0, len(b), step):
            from_, to = b[i : i + step, None], e[i : i + step, None]
            total = np.zeros((len(from_), len(x) + 1), np.int64)
            np.cumsum(np.where((place >= from_) & (place < to), 100, -percent), 1, out=total[:, 1:])
            most = total[:, least:] - np.minimum.accumulate(total[:, : len(x) + 1 - least], 1)
            hit = np.flatnonzero(most.max(1) >= percent * (to - from_)[:, 0])
            if len(hit):
                h = hit[0]
                p, q, u = int(from_[h, 0]), int(to[h, 0]), int(np.argmax(most[h])) + least
                t = int(np.argmin(total[h, : u - least + 1]))
                shared = int(((place[t:u] >= p) & (place[t:u] < q)).sum())
                return [(p, q, t, u, shared / (q - p + u - t - shared))]
        return []

    begin = np.arange(len(a) - least + 1)
    if links := best(begin, begin + least):
        return links
    step = max(1, cells // max(1, len(last)))
    for i in range(0, len(first), step):
        b, e = (z.ravel() for z in np.broadcast_arrays(first[i : i + step, None], last))
        wide = e - b > least
        if links := best(b[wide], e[wide]):
            return links
    return []


def similar_ranges(a: np.ndarray, x: np.ndarray, least: int, percent: int, block: int = 1000, fewest: list[int] | None = None) -> list[tuple[int, int, int, int, float]]:
    """Two ranges that are similar enough, if there are any: (a from, a to, x from, x to, similarity). All are looked at.

    `fewest` has the `fewest_values` of both, if they are known.
    """
    names, of = np.unique(np.concatenate([a, x]), return_inverse=True)
    sides = of[: len(a)], of[len(a) :]
    if min(len(a), len(x)) < least:
        return []
    if all(len(np.unique(side)) == len(side) for side in sides):
        return _ranges_of_single(*sides, least, percent)
    shared = np.isin(np.arange(len(names)), sides[0]) & np.isin(np.arange(len(names)), sides[1])
    column = np.cumsum(shared) - 1
    fewest = fewest or [fewest_values(side, least) for side in sides]
    ranges = []
    for k, side in enumerate(sides):
        often = np.bincount(side)[side] > 1
        inside = _open(np.where(shared[side], 100 - percent, np.where(often, 0, -percent)), np.zeros(len(side), np.int64))
        parts = [(s, *distinct_ranges(side[s:e], shared, least, fewest[1 - k], percent)) for s, e in _ranges(_runs(inside), len(side)) if inside[s] and e - s >= least]
        ranges.append([np.concatenate([np.zeros(0, np.int64), *(s + part[j] for s, *part in parts)]) for j in (0, 1)])
        if not len(ranges[k][0]):
            return []

    def rows(k: int, i: int) -> tuple[np.ndarray, np.ndarray]:
        begin, end = (r[i : i + block] for r in ranges[k])
        out, size = np.zeros((len(begin), int(shared.sum())), np.float32), np.zeros(len(begin), np.int64)
        for j, (s, e) in enumerate(zip(begin.tolist(), end.tolist(), strict=True)):
            value = np.unique(sides[k][s:e])
            out[j, column[value[shared[value]]]], size[j] = 1, len(value)
        return out, size

    for i in range(0, len(ranges[0][0]), block):
        left, size = rows(0, i)
        for j in range(0, len(ranges[1][0]), block):
            right, other = rows(1, j)
            both = np.rint(left @ right.T).astype(np.int64)
            whole = size[:, None] + other - both
            if (100 * both >= percent * whole).any():
                p, q = np.unravel_index(np.argmax(both / whole), both.shape)
                return [(*(int(r[i + p]) for r in ranges[0]), *(int(r[j + q]) for r in ranges[1]), float(both[p, q] / whole[p, q]))]
    return []


def verified_passages(found: DataFrame, least: int, percent: int) -> DataFrame:
    """Passages in pairs of ranges: `a`, `first_a`, `of_a` and the same of `x`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pydict()
            out = []
            for i in range(batch.num_rows):
                a, x = np.frombuffer(rows["of_a"][i], "<u8"), np.frombuffer(rows["of_x"][i], "<u8")
                for p, q, t, u, similarity in shared_passages(a, x, least, percent):
                    more = WIDTH - 1
                    out.append((rows["a"][i], rows["first_a"][i] + p, q - p + more, rows["x"][i], rows["first_x"][i] + t, u - t + more, similarity))
            columns = list(zip(*out, strict=True)) or [[] for _ in range(7)]
            kinds = [pa.int64()] * 6 + [pa.float64()]
            names = [c.split()[0] for c in PASSAGES.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)

    return found.select("a", "first_a", "x", "first_x", "of_a", "of_x").mapInArrow(lean(run), PASSAGES).distinct()


def _bits(slices: float) -> int:
    return min(16, max(5, math.ceil(math.log2(max(1, slices)))))


def _ids(passages: DataFrame, first: DataFrame) -> DataFrame:
    """The documents that stand for the texts of each passage."""
    ends = passages.select("a", "x").distinct().join(first.select(F.col("key").alias("a"), F.col("first_id").alias("id_a")), "a")
    ends = ends.join(first.select(F.col("key").alias("x"), F.col("first_id").alias("id_x")), "x")
    return ends.where("id_a <> id_x").select(F.col("id_a").alias("a"), F.col("id_x").alias("b"))


def signatures(regions: DataFrame, least: int, percent: int) -> DataFrame:
    """Rows per region, of which two similar ranges of different classes have at least one `token` in common.

    All shingles have one order: those that one class has alone come first, then by hash. Of what two similar ranges share, let t be
    the first in that order. What comes before t is not shared, so at most 100 - `percent` of a hundred in either range do. A
    shingle is taken if it lies in such a range; what comes before it is counted down to the next lower one of `LEVELS`.
    """
    names = [c.split()[0] for c in SIGNATURES.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            r = Regions(batch)
            text, shared = np.repeat(np.arange(len(r.n)), r.n), np.frombuffer(b"".join(batch.column("shared").to_pylist()), bool)
            rank = (mixed(r.hashes) >> U64(32)).astype(np.int64)
            repeats, taken = Repeats(r.hashes, r.n, least), np.zeros(len(text), bool)
            for low, high in zip(LEVELS, (*LEVELS[1:], 1 << 32), strict=True):
                some = shared & (rank >= low) & (rank < high)
                if some.any():
                    taken |= some & repeats.open(shared & (rank >= low), percent)
            pairs = np.flatnonzero(taken)
            pairs = pairs[np.lexsort((r.hashes[pairs], text[pairs]))]
            token, owner = r.hashes[pairs].view(np.int64), text[pairs]
            new = np.append(True, (token[1:] != token[:-1]) | (owner[1:] != owner[:-1]))[: len(pairs)]  # each shingle of a region once
            token, owner = token[new], owner[new]
            columns = (token, r.key[owner], r.start[owner], batch.column("class").to_numpy()[owner])
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)

    return regions.mapInArrow(lean(run), SIGNATURES)


def _may_be_similar(shared: np.ndarray, fewest: np.ndarray, least: int, percent: int) -> np.ndarray:
    """Which rows of `shared` have a range that could be similar to a set of `fewest` values or more, if no value stands twice there.

    Wide ranges are made of narrower ones, of which one shares as large a part.
    """
    sums = np.concatenate([np.zeros((len(shared), 1), np.int32), np.cumsum(shared, 1, dtype=np.int32)], 1)
    found = np.zeros(len(shared), bool)
    for width in range(least, min(2 * -(-100 * least // percent), shared.shape[1] + 1)):
        need = np.maximum(-(-percent * width // 100), -(-percent * (width + fewest) // (100 + percent)))
        found |= (sums[:, width:] - sums[:, :-width]).max(1) >= need
    return found


class Block:
    """Regions that are compared with each other: values as small numbers, and for each value the regions `posts` that have it."""

    def __init__(self, table: pa.Table, least: int, percent: int):
        self.regions, self.least, self.percent = Regions(table), least, percent
        r, count = self.regions, len(self.regions.n)
        names, values = np.unique(r.hashes, return_inverse=True)
        self.values = np.split(values, r.first[1:])
        self.repeats, self.places = Repeats(values, r.n, least), values
        self.single, self.fewest = np.ones(count, bool), np.full(count, least)
        self.single[self.repeats.of[self.repeats.times > 1]] = False
        start = np.flatnonzero(np.arange(len(values)) + least <= (r.first + r.n)[self.repeats.of])
        np.minimum.at(self.fewest, self.repeats.of[start], self.repeats.kinds[start])
        self.root = np.unique(table.column("class").to_numpy(), return_inverse=True)[1]
        pairs = np.unique(values * count + np.repeat(np.arange(count), r.n))
        self.posts, self.begin = pairs % count, np.searchsorted(pairs, np.arange(len(names) + 1) * count)

    def near(self, a: int, allowed: np.ndarray) -> np.ndarray:
        """The allowed regions of other classes that may have a range similar to one of region `a`, those that share most first."""
        value, place = np.unique(self.values[a], return_index=True)
        times = self.begin[value + 1] - self.begin[value]
        places = np.repeat(self.begin[value] - np.cumsum(times) + times, times) + np.arange(times.sum())
        posts, at = self.posts[places], np.repeat(place, times)
        both = np.bincount(posts, minlength=len(self.root))
        some = allowed & (self.root != self.root[a]) & ((100 + self.percent) * both >= self.percent * (self.fewest[a] + self.fewest))
        found = np.flatnonzero(some)
        if self.single[a] and len(found):
            row, good = np.cumsum(some) - 1, some[posts]
            posts, at = row[posts[good]], at[good]
            kept = []
            for i in range(0, len(found), 500):
                part = (posts >= i) & (posts < i + 500)
                shared = np.zeros((len(found[i : i + 500]), len(self.values[a])), bool)
                shared[posts[part] - i, at[part]] = True
                kept.append(found[i : i + 500][_may_be_similar(shared, self.fewest[found[i : i + 500]], self.least, self.percent)])
            found = np.concatenate(kept)
        else:
            found = self.kept(found, a, np.full(len(found), a), found)
        found = self.kept(found, a, found, np.full(len(found), a))
        return found[np.argsort(-both[found], kind="stable")]

    def kept(self, found: np.ndarray, a: int, mine: np.ndarray, other: np.ndarray, places: int = 200_000) -> np.ndarray:
        """Those of `found` of which the region in `mine` has a part that can be similar to one in `other`; one of both is `a`."""
        own, sizes, kept = np.zeros(len(self.begin) - 1, bool), np.cumsum(self.repeats.sizes[mine]), []
        own[self.values[a]] = True
        cuts = np.append(_runs(sizes // places), len(found)).tolist()
        for i, j in zip(cuts[:-1], cuts[1:], strict=True):
            repeats, at = self.repeats.take(mine[i:j])
            if mine[i] == a:
                shared = np.concatenate([self.has(x)[self.values[a]] for x in found[i:j].tolist()])
            else:
                shared = own[self.places[at]]
            inside = repeats.open(shared, self.percent, self.fewest[other[i:j]])
            kept.append(found[i:j][np.bincount(repeats.of[inside], minlength=j - i) > 0])
        return np.concatenate([found[:0], *kept])

    def has(self, x: int) -> np.ndarray:
        """Which values region `x` has."""
        out = np.zeros(len(self.begin) - 1, bool)
        out[self.values[x]] = True
        return out

    def links(self, left: np.ndarray, right: np.ndarray) -> Iterator[tuple[int, int, list[tuple[int, int, int, int, float]]]]:
        """Pairs of regions of classes that no pair before has connected, with their similar ranges; `left` and `right` say who is compared with whom."""
        for a in np.flatnonzero(left).tolist():
            allowed = right.copy()
            allowed[: a + 1] &= ~left[: a + 1]  # pairs of one block once
            for x in self.near(a, allowed).tolist():
                if self.root[a] == self.root[x]:
                    continue
                mine, other = self.values[a], self.values[x]
                if self.single[a] and self.single[x]:
                    both = _ranges_of_single(mine, other, self.least, self.percent)
                elif self.single[x] and not _may_be_similar(np.isin(other, mine)[None], self.fewest[a : a + 1], self.least, self.percent)[0]:
                    continue
                else:
                    both = similar_ranges(mine, other, self.least, self.percent, fewest=[int(self.fewest[a]), int(self.fewest[x])])
                if both:
                    yield a, x, shared_passages(mine, other, self.least, self.percent) or both
                    self.root[self.root == self.root[x]] = self.root[a]


def block_links(members: DataFrame, least: int, percent: int) -> DataFrame:
    """Passages that connect classes, for each pair of blocks `one` and `two` the regions that come with it."""
    names = [c.split()[0] for c in PASSAGES.split(", ")]

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        give_back()
        block, of, more = Block(table, least, percent), table.column("block").to_numpy(), WIDTH - 1
        r, out = block.regions, []
        for a, x, both in block.links(of == key[0].as_py(), of == key[1].as_py()):
            for p, q, t, u, similarity in both:
                ends = [(int(r.key[a]), int(r.start[a]) + p, q - p + more), (int(r.key[x]), int(r.start[x]) + t, u - t + more)]
                out.append((*ends[0], *ends[1], similarity))
        columns = list(zip(*out, strict=True)) or [[] for _ in names]
        kinds = [pa.int64()] * 6 + [pa.float64()]
        return pa.table([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)

    return members.groupBy("one", "two").applyInArrow(run, PASSAGES)


def across_classes(regions: DataFrame, first: DataFrame, linked: DataFrame, hot: References, bits: int, least: int, percent: int) -> DataFrame:
    """Passages that connect classes: all pairs of texts of different classes that could have one are searched, until a task knows their classes as one.

    Shingles are marked once more, now where texts of different classes have them. Regions are dealt to blocks by the shingle of
    their signature that most others have, so that what has much in common lies in one block; those of a frequent one go to several.
    A region goes to a pair of blocks if it has a shingle of its signature in common with a region of another class in the other
    block; there the pairs are compared without a row for each.
    """
    classes = first.join(linked, F.col("first_id") == F.col("node"), "left").select("key", F.coalesce("component", "first_id").alias("class"))
    rest = regions.join(classes, "key")
    hot.meet(rest)
    rest = written(regions_of(marked(send_marks(rest, least, bits, hot), bits, hot), least, percent, distinct=True).join(classes, "key"), "open")
    tokens = written(signatures(rest, least, percent), "signatures")
    names = [F.bit_xor(F.xxhash64(F.lit(seed), "key", "start")).alias(name) for seed, name in enumerate(("one", "two"))]
    lists = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.min("class").alias("low"), F.max("class").alias("high"), *names)
    lists = lists.where("low < high").groupBy("n", "one", "two").agg(F.min("token").alias("token"))  # of those that the same regions have one says it all
    tokens = tokens.join(lists.select("token", "n"), "token")
    anchors = tokens.groupBy("key", "start").agg(F.max(F.struct("n", "token"))["token"].alias("anchor"))
    tokens = written(tokens.drop("n").join(anchors, ["key", "start"]), "tokens")
    per_anchor = written(tokens.select("key", "start", "anchor").distinct().groupBy("anchor").agg(F.count(F.lit(1)).alias("n")), "anchors")
    blocks = max(1, (per_anchor.agg(F.sum("n")).first()[0] or 0) // PER_BLOCK)
    many = per_anchor.where(F.col("n") > PER_BLOCK).select("anchor", F.ceil(F.col("n") / PER_BLOCK).alias("parts"))  # fewer than there are blocks
    part = F.pmod(F.xxhash64("key"), F.coalesce("parts", F.lit(1)))
    tokens = tokens.join(F.broadcast(many), "anchor", "left").select("token", "key", "start", "class", F.pmod(F.xxhash64("anchor", part), F.lit(blocks)).alias("block"))
    lists = tokens.groupBy("token", F.col("block").alias("other")).agg(F.min("class").alias("low"), F.max("class").alias("high"))
    meet = tokens.join(lists, "token").where("low <> class OR high <> class")
    meet = meet.select("key", "start", "block", F.least("block", "other").alias("one"), F.greatest("block", "other").alias("two")).distinct()
    return block_links(written(rest.join(meet, ["key", "start"]).select("one", "two", "block", "key", "start", "class", "hashes"), "blocks"), least, percent)


def repeated_passages(
    docs: DataFrame, least_words: int = 50, percent: int = 80, hashes: int = 8, enough: int = 2, id_col: str = "doc_id", text_col: str = "text",
    per_slice: int = 500_000, hot_share: float = HOT_SHARE,
) -> DataFrame:
    """Passages of documents that repeat a passage of another one.

    `doc_id`, `first_word`, `n_words` (the passage), `of_doc_id`, `of_first_word`, `of_n_words` (what it repeats), `similarity`, `class_id`.
    """
    least = least_words - WIDTH + 1
    rows = id_and_text(docs, id_col, text_col).where("doc_id IS NOT NULL")
    members = written(sequence_keys(rows, hot_share), "members")
    hot, members = members.where("frequent"), members.where("NOT frequent")
    hot = frequent_shingles(hot, members.count(), hot_share)
    long = members.where(F.col("words") >= least_words)
    bits = _bits((long.agg(F.sum("words")).first()[0] or 0) / 2_000_000)
    hot.hashes = hot.hashes & _held_back(bits)
    regions = written(regions_of(marked(send_marks(rows, least, bits, hot), bits, hot), least, percent).drop("shared"), "regions")
    hot.fill(regions, hashes, least)
    positions = regions.agg(F.sum(F.octet_length("hashes")) / 8).first()[0] or 0
    slices = _bits(positions * 2 * hashes / least / per_slice)
    pairs = window_pairs(send_windows(regions, hashes, least, slices, hot), slices, hot)
    found = written(candidates(pairs, enough, least), "candidates")
    sides = found.select(F.col("a").alias("key"), F.col("sa").alias("s"), F.col("ea").alias("e"))
    sides = sides.unionByName(found.select(F.col("x").alias("key"), F.col("sx").alias("s"), F.col("ex").alias("e"))).distinct()
    spans = written(span_shingles(regions, sides, least), "spans")
    of_a, of_x = spans.toDF("a", "sa", "ea", "first_a", "of_a"), spans.toDF("x", "sx", "ex", "first_x", "of_x")
    passages = written(verified_passages(found.join(of_a, ["a", "sa", "ea"]).join(of_x, ["x", "sx", "ex"]), least, percent), "passages")
    first = written(long.groupBy("key").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("k")), "first")
    copies = written(long.join(first.where("k > 1"), "key").where("doc_id <> first_id").distinct(), "copies")
    linked = components(_ids(passages, first).unionByName(copies.select(F.col("doc_id").alias("a"), F.col("first_id").alias("b"))))
    more = written(across_classes(regions, first, linked, hot, bits, least, percent), "across")
    merged = components(linked.toDF("a", "b").unionByName(_ids(more, first)))
    passages = passages.unionByName(more)
    named = passages.join(first.select(F.col("key").alias("a"), F.col("first_id").alias("id_a")), "a")
    named = named.join(first.select(F.col("key").alias("x"), F.col("first_id").alias("id_x")), "x").where("id_a <> id_x")
    later = F.col("id_x") > F.col("id_a")

    def side(mine: str, other: str) -> Column:
        return F.when(later, F.col(mine)).otherwise(F.col(other))

    repeats = named.select(
        side("id_x", "id_a").alias("doc_id"), side("x_first", "a_first").alias("first_word"), side("x_words", "a_words").alias("n_words"),
        side("id_a", "id_x").alias("of_doc_id"), side("a_first", "x_first").alias("of_first_word"), side("a_words", "x_words").alias("of_n_words"),
        "similarity",
    )
    zero = F.lit(0).cast("bigint")
    copies = copies.select(
        "doc_id", zero.alias("first_word"), F.col("words").alias("n_words"), F.col("first_id").alias("of_doc_id"), zero.alias("of_first_word"),
        F.col("words").alias("of_n_words"), F.lit(1.0).alias("similarity"),
    )
    return repeats.distinct().unionByName(copies).join(merged.toDF("doc_id", "class_id"), "doc_id").select(*copies.columns, "class_id")
