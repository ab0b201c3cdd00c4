"""Benchmark decontamination by a broadcast set of word windows.

A word is a run of bytes that are a digit, a letter or not ASCII, with A-Z lower-cased. A window is `width` consecutive words of
a benchmark item; an item of fewer words, but not none, is one window. The windows go to every worker as a sorted array of
64-bit hashes. Documents are scanned where they are read: the hashes of all their windows are looked up, what is found is
verified word by word, and the words inside of any verified window are hit. Nothing is shuffled.

The windows are broadcast in blocks of about `block_bytes` of normalised item text; long items are cut into overlapping pieces
first, so the bound holds whatever an item's length. A benchmark of b blocks costs b scans of the documents, each of which adds
to what the scan before it has found; texts of over `PART` bytes are taken in parts that overlap by one window.

A null text has no words. Items without words have no windows; those without an id mark words, but are not named. Rows that are
given twice are reported twice. An empty benchmark hits nothing; an empty table gives no rows. Ids may have any type, items are
named by their id as a string. All other columns are left alone, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelayer.llm.texts import importable, lean, written
from tidelayer.llm.words import WEIGHTS, Words, mixed

PART = 1_000_000  # bytes of text whose words are held at once
APART = ~np.isin(np.arange(256), [*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)])
SPAN = "STRUCT<first_word: BIGINT, end_word: BIGINT, first_byte: BIGINT, end_byte: BIGINT>"
FOUND = f"n_words BIGINT, spans ARRAY<{SPAN}>, items ARRAY<STRING>"


def window_hashes(words: Words, width: int, whole: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first word of each window of `width` words inside one text; with `whole`, of texts with just as many words only."""
    sizes = np.diff(words.bounds)
    counts = np.maximum(sizes - width + 1, 0) if not whole else (sizes == width).astype(np.int64)
    at = np.repeat(words.bounds[:-1] - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
    value = np.full(len(at), width, np.uint64) * WEIGHTS[63]
    for k in range(width):
        value += words.hashes[at + k] * WEIGHTS[k]
    return mixed(value), at


def as_bytes(text: bytes) -> np.ndarray:
    return np.frombuffer(text, np.uint8) if text else np.empty(0, np.uint8)


def normal_words(words: Words, a: int, b: int) -> list[bytes]:
    return [words.data[s:e].tobytes().lower() for s, e in zip(words.starts[a:b].tolist(), words.ends[a:b].tolist(), strict=True)]


class Windows:
    """The distinct windows of some items: hashes in order, the words of each, and which items have it."""

    def __init__(self, items: list[str | None], texts: list[bytes], width: int):
        self.names = sorted({i for i in items if i is not None})
        number = {name: k for k, name in enumerate(self.names)}
        owner = np.array([number.get(i, -1) for i in items], np.int32)
        self.text = b"\n".join(texts)
        offsets = np.cumsum([0, *(len(t) + 1 for t in texts)])[: len(texts)]
        words = Words(as_bytes(self.text), np.append(offsets, len(self.text)).astype(np.int64), APART)
        short = np.unique(np.diff(words.bounds))
        found = [(width, *window_hashes(words, width))]
        found += [(w, *window_hashes(words, w, whole=True)) for w in short.tolist() if 0 < w < width]
        self.widths = sorted({w for w, h, _ in found if len(h)})
        hashes, at = np.concatenate([h for _, h, _ in found]), np.concatenate([a for _, _, a in found])
        size = np.concatenate([np.full(len(h), w, np.int64) for w, h, _ in found])
        whose = owner[np.searchsorted(words.bounds, at, "right") - 1] if len(at) else np.empty(0, np.int32)
        begin, end = words.starts[at], words.ends[at + size - 1]
        order = np.argsort(hashes, kind="stable")
        hashes, begin, end, whose = hashes[order], begin[order], end[order], whose[order]
        new = np.append(True, hashes[1:] != hashes[:-1])[: len(hashes)]
        # two texts of one hash, if there ever are any, are put apart
        for k in np.flatnonzero(~new).tolist():
            if self.text[begin[k] : end[k]] != self.text[begin[k - 1] : end[k - 1]]:
                new[k] = True
        starts = np.flatnonzero(new)
        self.hashes, self.begin, self.end = hashes[starts], begin[starts], end[starts]
        self.owner, self.bounds = whose, np.append(starts, len(whose))
        self.bits = min(24, max(10, math.ceil(math.log2(len(self.hashes) + 1)) + 4))
        self.seen = np.zeros(1 << self.bits, bool)  # most windows of documents end here
        self.seen[self.hashes >> np.uint64(64 - self.bits)] = True

    def hits(self, words: Words) -> Iterator[tuple[int, int, int]]:
        """Window, first word and width of each verified hit."""
        for width in self.widths:
            hashes, at = window_hashes(words, width)
            likely = np.flatnonzero(self.seen[hashes >> np.uint64(64 - self.bits)])
            place = np.searchsorted(self.hashes, hashes[likely])
            same = self.hashes[np.minimum(place, len(self.hashes) - 1)] == hashes[likely]
            for window, first in zip(place[same].tolist(), at[likely[same]].tolist(), strict=True):
                text, value = b" ".join(normal_words(words, first, first + width)), self.hashes[window]
                while window < len(self.hashes) and self.hashes[window] == value:
                    if self.text[self.begin[window] : self.end[window]] == text:
                        yield window, first, width
                    window += 1

    def items_of(self, windows: set[int]) -> list[str]:
        found: set[int] = set()
        for w in windows:
            found.update(self.owner[self.bounds[w] : self.bounds[w + 1]].tolist())
        return [self.names[k] for k in found if k >= 0]


def parts(data: np.ndarray, overlap: int) -> Iterator[tuple[int, int, Words]]:
    """First byte, first word and words of the parts of one text; each part begins with the last `overlap` words of the one before."""
    at = first = 0
    while at < len(data):
        end = at
        while True:
            end = min(end + PART, len(data))
            gap = np.flatnonzero(APART[data[end : end + PART]])
            while not len(gap) and end < len(data):  # a word is never cut
                end = min(end + PART, len(data))
                gap = np.flatnonzero(APART[data[end : end + PART]])
            end += int(gap[0]) if len(gap) else 0
            words = Words(data[at:end], np.array([0, end - at]), APART)
            if len(words.starts) > 2 * overlap or end == len(data):
                break
        yield at, first, words
        if end == len(data):
            return
        keep = len(words.starts) - overlap
        at, first = at + int(words.starts[keep]) if overlap else end, first + keep


def _joined(spans: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """Spans that overlap or touch become one."""
    out: list[list[int]] = []
    for a, b, x, y in sorted(spans):
        if out and a <= out[-1][1]:
            if b > out[-1][1]:
                out[-1][1], out[-1][3] = b, y
        else:
            out.append([a, b, x, y])
    return [tuple(s) for s in out]


def _scan_text(data: np.ndarray, windows: Windows, overlap: int) -> tuple[int, list, set[int]]:
    spans, met, n = [], set(), 0
    for byte, word, words in parts(data, overlap):
        n = word + len(words.starts)
        for window, first, width in windows.hits(words):
            met.add(window)
            spans.append((word + first, word + first + width, byte + int(words.starts[first]), byte + int(words.ends[first + width - 1])))
    return n, _joined(spans), met


def _scan_batch(texts: pa.Array, windows: Windows, width: int) -> Iterator[tuple[int, list, set[int]]]:
    """Words, spans and windows of each text; many short texts at once, long ones in parts."""
    texts = texts.cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    whole = texts.buffers()[2]
    data = np.frombuffer(whole, np.uint8) if whole is not None else np.empty(0, np.uint8)
    a = 0
    while a < len(texts):
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + PART, "right")) - 1)
        if b == a + 1:
            yield _scan_text(data[offsets[a] : offsets[b]], windows, width - 1)
        else:
            words = Words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], APART)
            base = offsets[a : b + 1] - offsets[a]
            spans: list[list] = [[] for _ in range(b - a)]
            met: list[set[int]] = [set() for _ in range(b - a)]
            for window, first, size in windows.hits(words):
                k = int(np.searchsorted(words.bounds, first, "right")) - 1
                met[k].add(window)
                w, x = int(words.bounds[k]), int(base[k])
                spans[k].append((first - w, first - w + size, int(words.starts[first]) - x, int(words.ends[first + size - 1]) - x))
            for k, n in enumerate(np.diff(words.bounds).tolist()):
                yield n, _joined(spans[k]), met[k]
        a = b


def item_pieces(benchmark: DataFrame, item_col: str, text_col: str, width: int, words_a_piece: int = 20_000) -> DataFrame:
    """Items as `item` and `text`, their words parted by single spaces, in pieces that overlap by one window less a word."""
    importable(benchmark.sparkSession)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(batch.column("item").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), strict=True):
                words = [w for _, _, part in parts(as_bytes(text), 0) for w in normal_words(part, 0, len(part.starts))]
                bounds = range(0, max(1, len(words) - width + 1), words_a_piece) if words else []
                cuts = [b" ".join(words[a : a + words_a_piece + width - 1]) for a in bounds]
                for k in range(0, len(cuts), 50):
                    part_of = cuts[k : k + 50]
                    yield pa.RecordBatch.from_arrays([pa.array([item] * len(part_of), pa.string()), pa.array(part_of, pa.binary())], names=["item", "text"])

    rows = benchmark.select(F.col(item_col).cast("string").alias("item"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(lean(cut), "item STRING, text BINARY")


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    width: int = 10,
    block_bytes: int = 16_000_000,
) -> DataFrame:
    """For each row of docs: `row` (all its columns), `n_words`, `spans` of words that are hit (whole ones, in order, apart from
    each other, with their bytes in the UTF-8 text) and `items` (distinct ids as strings, in no order)."""
    spark = docs.sparkSession
    importable(spark)
    pieces = written(item_pieces(benchmark, item_col, item_text_col, width), "benchmark-pieces")
    size = pieces.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(size / block_bytes))
    found = T.StructType.fromDDL(FOUND).fields
    nothing = [F.lit(None).cast(f.dataType).alias(f.name) for f in found]
    out = docs.select(F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("row"), F.coalesce(docs[text_col], F.lit("")).alias("text"), *nothing)
    schema = T.StructType([out.schema["row"], out.schema["text"], *found])
    for block in range(blocks):
        mine = pieces.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == block).collect()
        windows = spark.sparkContext.broadcast(Windows([r.item for r in mine], [bytes(r.text) for r in mine], width))

        def scan(batches: Iterator[pa.RecordBatch], windows=windows) -> Iterator[pa.RecordBatch]:
            kinds = pa.schema([("n", pa.int64()), ("spans", pa.list_(pa.struct([(c, pa.int64()) for c in ("first_word", "end_word", "first_byte", "end_byte")]))), ("items", pa.list_(pa.string()))])
            for batch in batches:
                before = zip(batch.column("spans").to_pylist(), batch.column("items").to_pylist(), strict=True)
                n, spans, items = [], [], []
                for (count, hit, met), (old, known) in zip(_scan_batch(batch.column("text"), windows.value, width), before, strict=True):
                    n.append(count)
                    hit = _joined([*hit, *(tuple(s.values()) for s in old or [])])
                    spans.append([dict(zip(("first_word", "end_word", "first_byte", "end_byte"), s, strict=True)) for s in hit])
                    items.append(list({*(known or []), *windows.value.items_of(met)}))
                arrays = [pa.array(x, kinds.field(k).type) for k, x in enumerate((n, spans, items))]
                yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("text"), *arrays], names=["row", "text", "n_words", "spans", "items"])

        out = out.mapInArrow(lean(scan), schema)
        if block + 1 < blocks:
            out = written(out, "decontaminated")
    return out.select("row", "n_words", "spans", "items")


def n_hit() -> F.Column:
    """Words inside of any window, from the spans."""
    return F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["end_word"] - s["first_word"])


def without_contaminated(docs: DataFrame, benchmark: DataFrame, max_share: float = 0.0, **options) -> DataFrame:
    """Rows of which no more than `max_share` of the words are hit, with all their columns."""
    return contamination(docs, benchmark, **options).where(n_hit() <= F.col("n_words") * max_share).select("row.*")


def without_passages(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """All rows, with the hit passages cut out of the text; what stands around a passage stays. A null text stays null."""
    found = contamination(docs, benchmark, text_col=text_col, **options)
    raw = F.col(f"row.`{text_col}`").cast("binary")
    # what lies between the end of one span and the beginning of the next
    ends = F.concat(F.array(F.lit(0).cast("bigint")), F.transform("spans", lambda s: s["end_byte"]))
    begins = F.concat(F.transform("spans", lambda s: s["first_byte"]), F.array(F.octet_length(raw).cast("bigint")))
    kept = F.zip_with(ends, begins, lambda a, b: F.substring(raw, (a + 1).cast("int"), (b - a).cast("int")).cast("string"))
    cleaned = F.when(F.size("spans") > 0, F.array_join(kept, "")).otherwise(F.col(f"row.`{text_col}`"))
    return found.withColumn("row", F.col("row").withField(f"`{text_col}`", cleaned)).select("row.*")
