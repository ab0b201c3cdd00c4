"""Exact deduplication by counting quotient filters.

Every partition puts the fingerprints of its texts into counting quotient filters: a fingerprint is cut into a quotient (the slot)
and a remainder (what the slot holds), and copies within a partition cost one counter. A filter travels in segments of neighbouring
quotients; one task merges the segments of the same quotients, without loss, as each gives its fingerprints in order of their
remainders. Fingerprints have as many bits as leave 32 to the remainders of the merged filters. Only texts whose fingerprint
counts more than one go on to the byte verification, which groups them by the whole text. Fingerprints of more than a thousandth
of all rows are known as few; their texts are dealt over `spread` shares, reduced where they are read, and then meet. The documents
are read twice: for fingerprints and digests, which are written, and for the texts to be verified.

A null text is an empty one. The row with the largest id stays; ids that are null count as smallest, and `kept` is true for
each row that has the kept id, so one id given twice to equal texts stays twice. Empty tables give no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelayer.llm.texts import give_back, id_and_text, lean, one_of_each, written

REMAINDER_BITS = 32  # of the merged filters, before texts are verified
LOAD = 0.75
FILTER = "segment BIGINT, quotients INT, slots BINARY, marks BINARY"


class CountingQuotientFilter:
    """Remainders of fingerprints of `width` bits, in runs of equal quotients (their first `quotients` bits).

    A run lies at the slot of its quotient or, where that is taken, behind the run before it. Three bits tell what is where:
    quotients that occur, slots that end a run, and slots that hold no remainder but the counter of the one before (how often
    it occurs beyond once). Slots have as many whole bytes as a remainder needs; quotients are never stored.
    """

    def __init__(self, width: int, quotients: int, slots: np.ndarray, occupied: np.ndarray, ends: np.ndarray, counters: np.ndarray):
        self.width, self.quotients, self.slots = width, quotients, slots
        self.occupied, self.ends, self.counters = occupied, ends, counters

    @classmethod
    def of(cls, fingerprints: np.ndarray, width: int) -> CountingQuotientFilter:
        return cls.counted(*np.unique(fingerprints.view(np.uint64), return_counts=True), width)

    @classmethod
    def counted(cls, values: np.ndarray, counts: np.ndarray, width: int) -> CountingQuotientFilter:
        """From distinct fingerprints in order, and how often each occurs."""
        more = counts.astype(np.uint64) - np.uint64(1)
        quotients = min(width - 1, max(1, math.ceil(math.log2(max(1, (len(values) + np.count_nonzero(more)) / LOAD)))))
        bits = width - quotients
        size = -(-bits // 8)
        digits = [more >> np.uint64(k) for k in range(0, 64, 8 * size)]  # a counter takes as many slots as it needs
        long = 1 + sum((d > 0).astype(np.int64) for d in digits)  # slots of an entry
        quotient = (values >> np.uint64(bits)).astype(np.int64)
        before = np.cumsum(long) - long
        place = before + np.maximum.accumulate(quotient - before) if len(values) else before
        whole = max(1 << quotients, int(place[-1] + long[-1]) if len(values) else 0)
        numbers = np.zeros(whole, np.uint64)
        numbers[place] = values & np.uint64((1 << bits) - 1)
        counters = np.zeros(whole, bool)
        for k, rest in enumerate(digits, 1):
            some = rest > 0
            counters[place[some] + k] = True
            numbers[place[some] + k] = rest[some]  # its low bytes
        occupied, ends = np.zeros(whole, bool), np.zeros(whole, bool)
        occupied[quotient] = True
        last = np.append(quotient[1:] != quotient[:-1], True)[: len(quotient)]
        ends[place[last] + long[last] - 1] = True
        slots = numbers.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :size].copy()
        return cls(width, quotients, slots, occupied, ends, counters)

    def entries(self) -> tuple[np.ndarray, np.ndarray]:
        """Fingerprints in order and how often each occurs, by walking the runs: the k-th end belongs to the k-th quotient."""
        quotient, end = np.flatnonzero(self.occupied), np.flatnonzero(self.ends)
        start = np.maximum(quotient, np.append(0, end[:-1] + 1)[: len(end)])
        long = end - start + 1
        place = np.repeat(start - (np.cumsum(long) - long), long) + np.arange(long.sum())
        run = np.repeat(quotient, long)
        held = ~self.counters[place]
        place, run = place[held], run[held]
        size = self.slots.shape[1]
        numbers = np.zeros((len(self.slots) + 2, 8), np.uint8)
        numbers[:-2, :size] = self.slots
        numbers = numbers.view("<u8").ravel()
        flags = np.append(self.counters, [False, False])
        counts, k, some = np.ones(len(place), np.int64), 0, np.arange(len(place))
        while len(some := some[flags[place[some] + k + 1]]):
            counts[some] += (numbers[place[some] + k + 1] << np.uint64(8 * size * k)).astype(np.int64)
            k += 1
        return (run.astype(np.uint64) << np.uint64(self.width - self.quotients)) | numbers[place], counts

    @classmethod
    def merged(cls, filters: list[CountingQuotientFilter]) -> CountingQuotientFilter:
        """Lossless, whatever the sizes: each filter's runs give its fingerprints in order, and counters of equal ones add up."""
        return cls.counted(*added([f.entries() for f in filters]), filters[0].width)

    def bytes(self) -> int:
        return self.slots.nbytes + -(-3 * len(self.slots) // 8)

    def packed(self) -> tuple[int, bytes, bytes]:
        return self.quotients, self.slots.tobytes(), np.packbits(np.concatenate([self.occupied, self.ends, self.counters])).tobytes()

    @classmethod
    def unpacked(cls, width: int, quotients: int, slots: bytes, marks: bytes) -> CountingQuotientFilter:
        numbers = np.frombuffer(slots, np.uint8).reshape(-1, -(-(width - quotients) // 8))
        bits = np.unpackbits(np.frombuffer(marks, np.uint8), count=3 * len(numbers)).astype(bool)
        return cls(width, quotients, numbers, *np.split(bits, 3))


def added(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted runs of values with counts made one."""
    values, counts = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(values, kind="stable")  # a merge of sorted runs
    values, counts = values[order], counts[order]
    starts = np.flatnonzero(np.append(True, values[1:] != values[:-1])[: len(values)])
    return values[starts], np.add.reduceat(counts, starts) if len(starts) else counts


def partition_filters(fingerprints: DataFrame, width: int, bits: int, most: int = 2_000_000) -> DataFrame:
    """The filters of each partition of a column `fp`, one per segment (the first `bits` bits); sent off at `most` entries."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size = [], 0
        for batch in batches:
            parts.append(np.unique(batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64), return_counts=True))
            size += len(parts[-1][0])
            if size >= most:
                parts = [added(parts)]
                size = len(parts[0][0])
                if size >= most // 2:
                    yield _packed_batch(*parts[0], width, bits)
                    parts, size = [], 0
        if parts:
            yield _packed_batch(*added(parts), width, bits)

    return fingerprints.mapInArrow(lean(build), FILTER)


def _packed_batch(values: np.ndarray, counts: np.ndarray, width: int, bits: int) -> pa.RecordBatch:
    inner = np.uint64(width - bits)
    number = values >> inner
    cuts = np.append(np.flatnonzero(np.append(True, number[1:] != number[:-1])[: len(number)]), len(number)).tolist()
    rows = []
    for a, b in zip(cuts, cuts[1:], strict=False):
        part = CountingQuotientFilter.counted(values[a:b] & ((np.uint64(1) << inner) - np.uint64(1)), counts[a:b], width - bits)
        rows.append((int(number[a]), *part.packed()))
    columns = list(zip(*rows, strict=True)) or [[], [], [], []]
    kinds = [pa.int64(), pa.int32(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["segment", "quotients", "slots", "marks"])


def segment_bits(rows: int, per_segment: int) -> int:
    return max(5, math.ceil(math.log2(max(1, rows / per_segment))))


def repeated_fingerprints(fingerprints: DataFrame, rows: int, per_segment: int = 1_000_000, width: int = 64) -> DataFrame:
    """Fingerprints (column `fp`, of `width` bits) that count more than one over all partitions, with their count `n`."""
    bits = segment_bits(rows, per_segment)

    def merge(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[CountingQuotientFilter] = []
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("quotients", "slots", "marks")]
            parts += [CountingQuotientFilter.unpacked(width - bits, *x) for x in zip(*columns, strict=True)]
        values, counts = CountingQuotientFilter.merged(parts).entries()
        parts.clear()
        give_back()
        many = counts > 1
        found = (values[many] | np.uint64(key[0].as_py() << (width - bits))).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(counts[many])], names=["fp", "n"])

    return partition_filters(fingerprints, width, bits).groupBy("segment").applyInArrow(merge, "fp BIGINT, n BIGINT")


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", spread: int = 64) -> DataFrame:
    """`doc_id`, `keep_id`, `group_size`, `kept`, `text_sha256` for each row."""
    rows = id_and_text(docs, id_col, text_col)
    light = written(rows.select("doc_id", F.xxhash64("text").alias("hash"), F.unhex(F.sha2("text", 256)).alias("sha")), "fingerprints")
    total = light.count()
    width = min(63, REMAINDER_BITS + max(8, math.ceil(math.log2(max(1, total / LOAD)))))
    fp = F.shiftrightunsigned("hash", 64 - width)
    light = light.select("doc_id", fp.alias("fp"), "sha")
    repeated = written(repeated_fingerprints(light.select("fp"), total, width=width), "repeated")
    is_hot = F.col("n") * 1000 > total
    hot = F.broadcast(repeated.where(is_hot).select("fp", F.lit(True).alias("hot")))  # fewer than 1000, as their counts add up to no more than all
    shares = F.when(is_hot, F.sequence(F.lit(0), F.lit(spread - 1))).otherwise(F.array(F.lit(0)))
    dealt = repeated.select("fp", F.explode(shares.cast("array<bigint>")).alias("share"))
    texts = rows.select("doc_id", "text", F.shiftrightunsigned(F.xxhash64("text"), 64 - width).alias("fp")).join(hot, "fp", "left")
    texts = texts.withColumn("share", F.when(F.col("hot"), F.pmod(F.xxhash64("doc_id"), F.lit(spread))).otherwise(F.lit(0)).cast("bigint"))
    verified = (
        texts.join(dealt, ["fp", "share"], "left_semi")
        .groupBy("fp", "text", "share")
        .agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("n"))
        .groupBy("fp", "text")
        .agg(F.max("keep_id").alias("keep_id"), F.sum("n").alias("group_size"))
        .where("group_size > 1")
        .select("fp", F.unhex(F.sha2("text", 256)).alias("sha"), "keep_id", "group_size")
    )
    joined = light.join(verified, ["fp", "sha"], "left").withColumn("text_sha256", F.lower(F.hex("sha")))
    in_group = F.col("group_size").isNotNull()
    return joined.select(
        "doc_id",
        F.when(in_group, F.col("keep_id")).otherwise(F.col("doc_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("bigint").alias("group_size"),
        F.when(in_group, F.col("doc_id").eqNullSafe(F.col("keep_id"))).otherwise(True).alias("kept"),
        "text_sha256",
    )


def without_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, with all their columns: one of each text, also where a row is given more than once."""
    found = exact_duplicates(docs, id_col, text_col)
    dropped = found.where("NOT kept").select(F.col("doc_id").alias("__dropped"), F.col("text_sha256").alias("__sha"))
    is_dropped = docs[id_col].eqNullSafe(F.col("__dropped")) & (F.sha2(F.coalesce(docs[text_col], F.lit("")), 256) == F.col("__sha"))
    in_group = found.where("kept AND group_size > 1").groupBy(F.struct("doc_id").alias("name"), "text_sha256").agg(F.count(F.lit(1)).alias("n"))
    repeated = in_group.where("n > 1").select(F.col("name.doc_id").alias("id"), F.col("text_sha256").alias("sha"))
    return one_of_each(docs.join(dropped, is_dropped, "left_anti"), repeated, id_col, text_col)
