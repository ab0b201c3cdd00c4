"""N-gram Jaccard join: a grouped prefix join of sets of word shingles.

1. Every text becomes the set of its shingles (hashes). Texts with equal sets are one member from here on.
2. Shingles travel in packed slices of the hash range; a slice knows in how many sets each of its shingles occurs and sends
   back, per set, those that occur in more than one. Only they can be shared. The few shingles that more than one set in 500
   has are counted where they are read and need not travel to one place.
3. Rare shingles come first in the order of a set. Two sets of Jaccard similarity t share a shingle among the first
   n - ceil(t n) + 1 of either, so sets whose first ones are all their own are done. Sets of equal size and equal prefix are
   collapsed into one group.
4. Groups that share a prefix shingle and whose sizes are near enough are paired, then expanded to members and verified by
   whole sets: first each with the group of its list that has the fewest shingles of its own, then each that is still apart
   with some group of the largest part of its lists. What links connect by then needs no further check, so groups of
   thousands of near copies cost a few checks per member.
5. All pairs that share a prefix shingle and are still apart are looked at, in blocks of bounded size: sizes, the places of
   the shared shingle and parity bits of the sets bound the overlap, and pairs that could reach the threshold are verified.

Words are runs of bytes other than space and U+0009 to U+000D, with A-Z lower-cased; a shingle is five of them, and a text
with fewer words is one shingle. A text without words (null, empty, blank) has the empty set and links with nothing. Rows
with equal ids are rows of their own. A null id takes part, but is nobody's smallest id; a component of null ids only has a
null as its id. Other columns are not looked at. An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tidelayer.llm.components import components
from tidelayer.llm.texts import give_back, id_and_text, lean, one_of_each, written
from tidelayer.llm.words import Words, by_owner, mixed, word_slices

TOKEN_BITS = 40  # of a shingle's hash, after the bits that name its slice
U64 = np.uint64
SEND = "slice BIGINT, keys BINARY, sizes BINARY, counts BINARY, low BINARY, high BINARY"
BACK = "bucket BIGINT, keys BINARY, sizes BINARY, counts BINARY, tokens BINARY"
SETS = "key BIGINT, n BIGINT, own BIGINT, prefix_group BIGINT, prefix ARRAY<BIGINT>, bits BINARY, tokens BINARY"
PARITY_BITS = 512
HOT_SHARE = 0.002


def _runs(sorted_values: np.ndarray) -> np.ndarray:
    """Where runs of equal values start."""
    return np.flatnonzero(np.append(True, sorted_values[1:] != sorted_values[:-1])) if len(sorted_values) else np.empty(0, np.int64)


def _ranges(starts: np.ndarray, size: int) -> list[tuple[int, int]]:
    ends = starts[1:].tolist() + [size]
    return list(zip(starts.tolist(), ends[: len(starts)], strict=True))


class Sets:
    """Distinct shingles of a slice of texts, sorted within each text, with a 64-bit key and a check value per set."""

    def __init__(self, words: Words, width: int, seed: int):
        hashes, owner, _ = words.shingles(width)
        order = by_owner(hashes, owner)
        hashes, owner = hashes[order], owner[order]
        new = np.append(True, (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1]))[: len(hashes)]
        self.hashes, owner = hashes[new], owner[new]
        count = len(words.bounds) - 1
        self.n = np.bincount(owner, minlength=count)[:count]
        self.first = np.cumsum(self.n) - self.n
        sums = [np.concatenate([np.zeros(1, U64), np.add.accumulate(mixed(self.hashes ^ U64(salt)))]) for salt in (2 * seed + 1, 2 * seed + 2)]
        last = self.first + self.n
        self.key, self.check = (mixed((s[last] - s[self.first]) + self.n.astype(U64)).view(np.int64) for s in sums)


def set_keys(rows: DataFrame, width: int, seed: int, hot_share: float = HOT_SHARE, chunk: int = 1_000_000) -> DataFrame:
    """`doc_id`, `n`, `key`, `check` per row: equal keys stand for equal sets where the checks are equal too.

    Besides, with `frequent` true, shingles (as `key`) that more than `hot_share` of the sets of some chunk have, with their
    number there (as `n`): what is frequent on the whole is so in some chunk.
    """
    kind = rows.schema["doc_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, sets_held, size = [], 0, 0

        def frequent() -> pa.RecordBatch:
            tokens, times = np.unique(np.concatenate(held), return_counts=True)
            many = times > max(7, hot_share * sets_held)
            columns = [pa.nulls(int(many.sum()), to_arrow_type(kind)), pa.array(times[many]), pa.array(tokens[many].view(np.int64))]
            columns += [pa.nulls(int(many.sum()), pa.int64()), pa.array(np.ones(int(many.sum()), bool))]
            return pa.RecordBatch.from_arrays(columns, names=["doc_id", "n", "key", "check", "frequent"])

        for batch in batches:
            for a, b, words in word_slices(batch.column("text")):
                sets = Sets(words, width, seed)
                columns = [batch.column("doc_id").slice(a, b - a), pa.array(sets.n, pa.int64()), pa.array(sets.key), pa.array(sets.check)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(np.zeros(b - a, bool))], names=["doc_id", "n", "key", "check", "frequent"])
                held.append(sets.hashes)
                sets_held, size = sets_held + b - a, size + len(sets.hashes)
                if size >= chunk:
                    yield frequent()
                    held, sets_held, size = [], 0, 0
        if held:
            yield frequent()

    return rows.mapInArrow(lean(run), f"doc_id {kind.simpleString()}, n BIGINT, key BIGINT, check BIGINT, frequent BOOLEAN")


class Hot:
    """The frequent shingles with their number of sets, sorted; fewer than the mean size of a set over `hot_share`."""

    def __init__(self, found: list[tuple[int, int]]):
        pairs = sorted((key % 2**64, n) for key, n in found)
        self.hashes, self.times = np.array([p[0] for p in pairs], U64), np.array([p[1] for p in pairs], np.int64)

    def places(self, hashes: np.ndarray) -> np.ndarray:
        """The place of each hash among the frequent ones, or -1."""
        if not len(self.hashes):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, at, -1)

    def tokens(self, bits: int) -> np.ndarray:
        """As they are kept per set: rarity, slice and rest of the hash."""
        return _rarity(np.maximum(self.times, 2)) << U64(56) | (self.hashes >> U64(64 - bits - TOKEN_BITS))


def frequent_shingles(members: DataFrame, sets: int, hot_share: float = HOT_SHARE) -> Hot:
    counts = members.where("frequent").groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") > hot_share * sets)
    return Hot([(row["key"], row["n"]) for row in counts.collect()])


def _sent(keys: np.ndarray, sizes: np.ndarray, owner: np.ndarray, hashes: np.ndarray, bits: int, hot: Hot) -> pa.RecordBatch:
    """Shingles (in the order of their sets) as one row per slice of the hash range.

    Frequent ones go, as their place among these, to further slices by the key of their set.
    """
    place = hot.places(hashes)
    by_key = (keys.view(U64) >> U64(64 - bits)) + U64(1 << bits)
    part = np.where(place >= 0, by_key[owner], hashes >> U64(64 - bits)).astype(np.uint16 if bits < 16 else np.uint32)
    order = np.argsort(part, kind="stable")
    token = np.where(place >= 0, place.astype(U64), (hashes >> U64(64 - bits - TOKEN_BITS)) & U64((1 << TOKEN_BITS) - 1))[order]
    part, owner = part[order], owner[order]
    low, high = token.astype("<u4"), (token >> U64(32)).astype(np.uint8)
    starts = _runs(part)
    rows = []
    for a, b in _ranges(starts, len(part)):
        runs = _runs(owner[a:b])
        who = owner[a:b][runs]
        counts = np.diff(np.append(runs, b - a)).astype("<u4")
        rows.append((int(part[a]), keys[who].tobytes(), sizes[who].astype("<u4").tobytes(), counts.tobytes(), low[a:b].tobytes(), high[a:b].tobytes()))
    names = ["slice", "keys", "sizes", "counts", "low", "high"]
    columns = list(zip(*rows, strict=True)) or [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if i else pa.int64()) for i, c in enumerate(columns)], names=names)


def send_shingles(rows: DataFrame, width: int, seed: int, bits: int, hot: Hot, batch_size: int = 2_000_000) -> DataFrame:
    """The shingles of all sets, by slice. Sets that occur twice in a task are sent once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            keys, sizes = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
            return _sent(keys, sizes, np.repeat(np.arange(len(keys)), sizes), np.concatenate([h[2] for h in held]), bits, hot)

        for batch in batches:
            for _, _, words in word_slices(batch.column("text")):
                sets = Sets(words, width, seed)
                fresh = np.zeros(len(sets.n), bool)
                for i, key in enumerate(sets.key.tolist()):
                    if sets.n[i] and key not in seen:
                        fresh[i] = True
                        seen.add(key)
                if len(seen) > 1_000_000:
                    seen.clear()
                if fresh.any():
                    held.append((sets.key[fresh], sets.n[fresh], sets.hashes[np.repeat(fresh, sets.n)]))
                    size += len(held[-1][2])
                if size >= batch_size:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    return rows.mapInArrow(lean(run), SEND)


def _read(table: pa.Table, name: str, kind: str) -> np.ndarray:
    return np.concatenate([np.frombuffer(x, kind) for x in table.column(name).to_pylist()])


def _once(keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For each shingle, whether its run is the first of its key: copies in other tasks have sent the same."""
    first = np.zeros(len(keys), bool)
    first[np.unique(keys, return_index=True)[1]] = True
    return np.repeat(first, counts)


def _rarity(times: np.ndarray) -> np.ndarray:
    """Eight bits that grow with the number of sets a shingle occurs in."""
    return np.minimum(np.floor(np.log2(times) * 6), 255).astype(U64)


def shared_shingles(sent: DataFrame, bits: int, hot: Hot) -> DataFrame:
    """Per slice, the shingles that occur in more than one set, packed by bucket of the set's key."""
    frequent = hot.tokens(bits)

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        give_back()
        keys, sizes, counts = _read(table, "keys", "<i8"), _read(table, "sizes", "<u4"), _read(table, "counts", "<u4")
        token = _read(table, "low", "<u4").astype(U64) | (_read(table, "high", "u1").astype(U64) << U64(32))
        owner = np.repeat(np.arange(len(keys), dtype=np.int32), counts)
        kept = _once(keys, counts)
        token, owner = token[kept], owner[kept]
        if key[0].as_py() >= 1 << bits:
            token = frequent[token.astype(np.int64)]
        else:
            order = np.argsort(token)
            token, owner = token[order], owner[order]
            starts = _runs(token)
            times = np.diff(np.append(starts, len(token)))
            many = np.repeat(times > 1, times)
            owner = owner[many]
            token = (token[many] | (U64(key[0].as_py()) << U64(TOKEN_BITS))) & U64((1 << 56) - 1)
            token |= _rarity(np.repeat(times[times > 1], times[times > 1])) << U64(56)
        bucket = (keys.view(U64) >> U64(64 - bits)).astype(np.int64)
        order = np.lexsort((owner, bucket[owner]))
        owner, token = owner[order], token[order]
        rows, starts = [], _runs(bucket[owner])
        for a, b in _ranges(starts, len(owner)):
            runs = _runs(owner[a:b])
            who = owner[a:b][runs]
            counts = np.diff(np.append(runs, b - a)).astype("<u4")
            rows.append((int(bucket[who[0]]), keys[who].tobytes(), sizes[who].tobytes(), counts.tobytes(), token[a:b].tobytes()))
        names = ["bucket", "keys", "sizes", "counts", "tokens"]
        columns = list(zip(*rows, strict=True)) or [[] for _ in names]
        return pa.table([pa.array(c, pa.binary() if i else pa.int64()) for i, c in enumerate(columns)], names=names)

    return sent.groupBy("slice").applyInArrow(run, BACK)


def linkable_sets(shared: DataFrame, percent: int) -> DataFrame:
    """Sets that share enough shingles with others to have a link at all.

    With the number of shingles of their `own`, the shared ones of the prefix, the parity of the shared ones in a row of bits,
    and all the shared ones; rare ones first.
    """

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        give_back()
        keys, sizes, counts = _read(table, "keys", "<i8"), _read(table, "sizes", "<u4"), _read(table, "counts", "<u4")
        tokens, owner = _read(table, "tokens", "<u8"), np.repeat(keys, counts)
        order = np.lexsort((tokens, owner))
        tokens, owner = tokens[order], owner[order]
        size_of = dict(zip(keys.tolist(), sizes.tolist(), strict=True))
        starts = _runs(owner)
        out = []
        for a, b in _ranges(starts, len(owner)):
            n = size_of[int(owner[a])]
            needed = -(-percent * n // 100)
            if b - a >= needed:
                prefix = tokens[a : b - needed + 1]
                group = int(mixed(np.array([mixed(prefix).sum(dtype=U64) + U64(n)]))[0].view(np.int64))
                parity = np.bincount((mixed(tokens[a:b]) % U64(PARITY_BITS)).astype(np.int64), minlength=PARITY_BITS) & 1
                out.append((int(owner[a]), n, n - (b - a), group, prefix.view(np.int64), np.packbits(parity.astype(bool)).tobytes(), tokens[a:b].tobytes()))
        names = [c.split()[0] for c in SETS.split(", ")]
        columns = list(zip(*out, strict=True)) or [[] for _ in names]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.binary()]
        return pa.table([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)

    return shared.groupBy("bucket").applyInArrow(run, SETS)


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs `a`, `b` of set keys that link: 100 times the intersection is at least `percent` times the union."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = ([np.frombuffer(x, "<u8") for x in batch.column(c).to_pylist()] for c in ("tokens_a", "tokens_b"))
            both = np.array([len(np.intersect1d(x, y, assume_unique=True)) for x, y in zip(a, b, strict=True)], np.int64)
            whole = batch.column("n_a").to_numpy() + batch.column("n_b").to_numpy() - both
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(100 * both >= percent * whole))

    of_a = sets.select(F.col("key").alias("a"), F.col("n").alias("n_a"), F.col("tokens").alias("tokens_a"))
    of_b = sets.select(F.col("key").alias("b"), F.col("n").alias("n_b"), F.col("tokens").alias("tokens_b"))
    return pairs.join(of_a, "a").join(of_b, "b").select("a", "b", "n_a", "n_b", "tokens_a", "tokens_b").mapInArrow(check, "a BIGINT, b BIGINT")


def _near(n: str, m: str, percent: int) -> Column:
    return (F.col(n) * 100 >= F.col(m) * percent) & (F.col(m) * 100 >= F.col(n) * percent)


def _heads(sets: DataFrame) -> DataFrame:
    return sets.groupBy("prefix_group").agg(F.min("key").alias("head"))


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _star_pairs(sets: DataFrame, postings: DataFrame, percent: int) -> DataFrame:
    """Each member with the first of its group, and per shingle the groups of near size with the one that has the fewest own shingles."""
    heads = _heads(sets)
    inside = sets.select("key", "prefix_group").join(heads, "prefix_group").select(F.col("head").alias("a"), F.col("key").alias("b"))
    band = F.floor(F.log(F.col("n")) / math.log((100 / percent) ** 0.5))  # sizes of one band are near enough
    banded = postings.withColumn("band", band)
    centres = banded.groupBy("token", "band").agg(F.min_by("prefix_group", F.struct("own", "prefix_group")).alias("centre"), F.count(F.lit(1)).alias("k"))
    groups = banded.join(centres.where("k > 1"), ["token", "band"]).where("prefix_group <> centre").select("prefix_group", "centre").distinct()
    across = groups.join(heads.toDF("centre", "a"), "centre").join(heads.toDF("prefix_group", "b"), "prefix_group").select("a", "b")
    return _ordered(inside.unionByName(across))


def _parts(sets: DataFrame, links: DataFrame) -> DataFrame:
    """The component of each linkable set so far, as `part`."""
    light = sets.select("key", "n", "own", "bits", "prefix_group").join(components(links), F.col("key") == F.col("node"), "left")
    return written(light.select("key", "n", "own", "bits", "prefix_group", F.coalesce("component", "key").alias("part")), "parts")


def _joined_parts(parts: DataFrame, links: DataFrame) -> DataFrame:
    """The parts when further links are known. Only links between parts count, so what is connected already is not walked again."""
    of_a, of_b = (parts.select(F.col("key").alias(x), F.col("part").alias(f"part_{x}")) for x in "ab")
    between = links.join(of_a, "a").join(of_b, "b").select(F.col("part_a").alias("a"), F.col("part_b").alias("b"))
    found = components(between)
    return parts.join(found, F.col("part") == F.col("node"), "left").withColumn("part", F.coalesce("component", "part")).select(parts.columns)


def _open_postings(parts: DataFrame, postings: DataFrame) -> DataFrame:
    """Members and their places, for shingles whose list holds members of more than one part."""
    spread = postings.select("token", "place", "prefix_group").join(parts, "prefix_group")
    open_tokens = spread.groupBy("token").agg(F.min("part").alias("x"), F.max("part").alias("y")).where("x < y").select("token")
    return written(spread.join(open_tokens, "token").select("token", "place", "key", "n", "own", "part", "bits"), "open")


def _second_pairs(open_: DataFrame, percent: int) -> DataFrame:
    """Per shingle, each member outside the largest part with some member of it; another one for each shingle."""
    sizes = open_.groupBy("token", "part").agg(F.count(F.lit(1)).alias("k"), F.min_by(F.struct("key", "n"), F.xxhash64("key", "token")).alias("some"))
    largest = sizes.groupBy("token").agg(F.max_by(F.struct("part", "some"), F.struct("k", "part")).alias("x"))
    largest = largest.select("token", F.col("x.part").alias("part_b"), F.col("x.some.key").alias("b"), F.col("x.some.n").alias("m"))
    return _ordered(open_.join(largest, "token").where((F.col("part") != F.col("part_b")) & _near("n", "m", percent)).select(F.col("key").alias("a"), "b"))


def _could_link(a: dict[str, np.ndarray], b: dict[str, np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of two blocks of a list that are apart and that no bound rules out."""
    whole = a["n"][:, None] + b["n"][None, :]
    overlap = -(-percent * whole // (100 + percent))  # the least intersection that links
    fits = (a["part"][:, None] != b["part"][None, :]) & (a["place"][:, None] <= a["n"][:, None] - overlap) & (b["place"][None, :] <= b["n"][None, :] - overlap)
    i, j = np.nonzero(fits)
    differ = a["own"][i] + b["own"][j] + np.bitwise_count(a["bits"][i] ^ b["bits"][j]).sum(1, dtype=np.int64)  # no more than only one of them has
    few = differ <= whole[i, j] - 2 * overlap[i, j]
    return i[few], j[few]


def _open_pairs(open_: DataFrame, percent: int, block: int = 2048) -> DataFrame:
    """All pairs that share a prefix shingle, are apart and could link. Lists are cut into blocks; a part that fills blocks has
    blocks of its own, which are not compared with each other."""

    def compare(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        one, two = key[1].as_py(), key[2].as_py()
        label = np.array(table.column("label").to_pylist(), object)
        rows = {c: table.column(c).to_numpy() for c in ("key", "n", "own", "place", "part")}
        rows["bits"] = np.frombuffer(b"".join(table.column("bits").to_pylist()), np.uint64).reshape(len(label), PARITY_BITS // 64)
        left, right = np.flatnonzero(label == one), np.flatnonzero(label == two)
        other = {c: x[right] for c, x in rows.items()}
        a, b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for start in range(0, len(left), 256):
            some = {c: x[left[start : start + 256]] for c, x in rows.items()}
            i, j = _could_link(some, other, percent)
            a.append(some["key"][i])
            b.append(other["key"][j])
        a, b = np.concatenate(a), np.concatenate(b)
        a, b = np.minimum(a, b), np.maximum(a, b)
        return pa.table([pa.array(a), pa.array(b)], names=["a", "b"]).group_by(["a", "b"]).aggregate([])

    sizes = open_.groupBy("token", "part").agg(F.count(F.lit(1)).alias("k"))
    rest = sizes.where(F.col("k") <= block).groupBy("token").agg(F.ceil(F.sum("k") / F.lit(block)).alias("mixed_blocks"))
    sizes = sizes.join(rest, "token", "left").withColumnsRenamed({"token": "t", "part": "p"})
    labelled = open_.join(sizes, (F.col("token") == F.col("t")) & (F.col("part") == F.col("p")))
    pure = F.col("k") > block
    of_part = F.concat_ws("/", F.col("part").cast("string"), F.pmod(F.xxhash64("key"), F.ceil(F.col("k") / F.lit(block))).cast("string"))
    of_rest = F.concat(F.lit("/"), F.pmod(F.xxhash64("part"), F.col("mixed_blocks")).cast("string"))
    labelled = labelled.select("token", "place", "key", "n", "own", "part", "bits", F.when(pure, of_part).otherwise(of_rest).alias("label"), F.when(pure, F.col("part")).alias("pure"))
    labelled = written(labelled, "labelled")
    blocks = labelled.select("token", "label", "pure").distinct()
    other = blocks.select("token", F.col("label").alias("two"), F.col("pure").alias("pure_two"))
    meet = blocks.withColumnRenamed("label", "one").join(other, "token").where("one <= two AND (pure IS NULL OR pure_two IS NULL OR pure <> pure_two)")
    sides = meet.select("token", "one", "two", F.explode(F.array_distinct(F.array("one", "two"))).alias("label"))
    return sides.join(labelled.drop("pure"), ["token", "label"]).groupBy("token", "one", "two").applyInArrow(compare, "a BIGINT, b BIGINT").distinct()


def _open_groups(parts: DataFrame) -> DataFrame:
    """Groups whose members are apart, as lists of their own: all of a prefix is shared there, so the first place will do."""
    split = parts.groupBy("prefix_group").agg(F.min("part").alias("x"), F.max("part").alias("y")).where("x < y").select("prefix_group")
    return parts.join(split, "prefix_group").select(F.col("prefix_group").alias("token"), F.lit(0).cast("bigint").alias("place"), "key", "n", "own", "part", "bits")


def linked_components(
    docs: DataFrame, percent: int = 80, width: int = 5, id_col: str = "doc_id", text_col: str = "text", per_slice: int = 3_000_000, hot_share: float = HOT_SHARE
) -> DataFrame:
    """`doc_id`, `n_shingles`, `component_id` for each row."""
    rows = id_and_text(docs, id_col, text_col)
    for seed in range(8):  # two sets with one key: never seen; another seed tells them apart
        members = written(set_keys(rows, width, seed, hot_share), "members")
        hot, members = members.where("frequent"), members.where("NOT frequent")
        clash = members.where("n > 0").groupBy("key").agg(F.min("check").alias("x"), F.max("check").alias("y")).where("x <> y")
        if clash.isEmpty():
            break
    total, count = members.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    bits = max(5, math.ceil(math.log2(max(1, total / per_slice))))
    hot = frequent_shingles(hot, count, hot_share)
    sets = written(linkable_sets(shared_shingles(send_shingles(rows, width, seed, bits, hot), bits, hot), percent), "sets")
    spread = sets.select("prefix_group", "n", "own", F.posexplode("prefix").alias("k", "token"))
    postings = written(spread.select("prefix_group", "n", "own", "token", (F.col("own") + F.col("k")).alias("place")).distinct(), "postings")
    asked = written(_star_pairs(sets, postings, percent), "pairs")
    parts = _parts(sets, written(verified(asked, sets, percent), "links"))
    second = _second_pairs(_open_postings(parts, postings), percent).join(asked, ["a", "b"], "left_anti")
    second = written(second, "pairs")
    asked = asked.unionByName(second)
    parts = written(_joined_parts(parts, written(verified(second, sets, percent), "links")), "parts")
    apart = _open_postings(parts, postings).unionByName(_open_groups(parts))
    rest = _open_pairs(apart, percent).join(asked, ["a", "b"], "left_anti")
    connected = _joined_parts(parts, written(verified(rest, sets, percent), "links")).select("key", F.col("part").alias("class"))
    ids = members.where("n > 0").groupBy("key").agg(F.min("doc_id").alias("first_id"))
    ids = ids.join(connected, "key", "left").select("key", F.coalesce("class", "key").alias("class"), "first_id")
    least = ids.groupBy("class").agg(F.min("first_id").alias("component_id"))
    known = ids.join(least, "class").select(F.col("key").alias("known_key"), "component_id")
    joined = members.join(known, (F.col("n") > 0) & (F.col("key") == F.col("known_key")), "left")
    own = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return joined.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"))


def without_near_copies(docs: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each component, with all its columns: the one with the smallest id, ids that are null last, and of texts
    with one id the one with the smallest SHA-256, and of rows with one id and
    one text one. Texts without words are linked with nothing, so they stay."""
    sha = F.unhex(F.sha2(F.coalesce(docs[text_col], F.lit("")), 256))
    name = F.struct(docs[id_col].isNull().alias("no_id"), docs[id_col].alias("id"), sha.alias("sha"))
    linked = linked_components(docs.select(name.alias("name"), docs[text_col].alias("text")), percent, id_col="name", text_col="text")
    gone = linked.where("NOT doc_id <=> component_id").select(F.col("doc_id.id").alias("__gone"), F.col("doc_id.sha").alias("__sha"))
    repeated = linked.where("doc_id <=> component_id AND n_shingles > 0").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    repeated = repeated.select("doc_id.id", F.lower(F.hex("doc_id.sha")).alias("sha"))
    stay = docs.join(gone, docs[id_col].eqNullSafe(F.col("__gone")) & (sha == F.col("__sha")), "left_anti")
    return one_of_each(stay, repeated, id_col, text_col)
