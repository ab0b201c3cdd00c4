"""Best-fit packing of token sequences.

Documents are tokenised where they are read; only the lengths of their pieces travel. Each packing task takes its pieces,
the long ones first, and packs them online: open bins are kept by free space, a bitset tells which free spaces occur, a
piece goes into the open bin with the least sufficient space, and when more than the allowed number of bins is open the
fullest one closes.

Null and empty texts are one piece that holds the end token alone. Rows that occur twice are packed twice. A null id is
kept as it is. An empty table gives no rows. Other columns of the input are not looked at.
"""

from __future__ import annotations

import math
import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelayer.llm.texts import LONG, WHITE_SPACE, Remembered, chunks, id_and_text, lean, slices, written

PIECES = "piece INT, start BIGINT, length BIGINT, ids_crc32 BIGINT"
PLACED = "sequence_id BIGINT, offset BIGINT"
MARK = "7"
LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
# A word, or its first letters where an ASCII sign follows: the tokenizer never joins letters to such a sign.
WORD = re.compile(rf"[{LETTERS}]+(?=[!-/:-@\[-`{{-~{WHITE_SPACE}]|\Z)|[^{WHITE_SPACE}]+")


def folded(text: str) -> str:
    """The text in lower case where that is what the tokenizer makes of it, letter by letter: Latin-1 without special tokens."""
    if "<|" in text:
        return text
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return text
    return text.lower()


class WordTokens:
    """Ids of texts by a tokenizer that drops white space, looked up word by word.

    Words the tokenizer has not seen are given to it in rows with a lone digit between them, which is a token of its own;
    words with that digit are given one by one. What it gave is kept as little-endian bytes, for up to twice `most` words.
    """

    def __init__(self, path: str, most: int = 200_000, per_row: int = 200):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.per_row = Tokenizer.from_file(path), per_row
        ids = [self.tokenizer.encode(f"x{sep}x", add_special_tokens=False).ids for sep in ("\n", f"\n{MARK}\n")]
        if len(ids[1]) != len(ids[0]) + 1:
            raise ValueError(f"{path} does not give {MARK} one token of its own")
        self.mark_id = ids[1][1]
        self.known = Remembered(most)

    def learn(self, words: set[str]) -> None:
        known = self.known.young
        alone = [w for w in words if MARK in w]
        row_of = [w for w in words if MARK not in w]
        for word, code in zip(alone, self.tokenizer.encode_batch(alone, add_special_tokens=False), strict=True):
            known[word] = np.array(code.ids, "<u4").tobytes()
        rows = [row_of[i : i + self.per_row] for i in range(0, len(row_of), self.per_row)]
        for part in chunks(iter(rows), 64):
            codes = self.tokenizer.encode_batch([f"\n{MARK}\n".join(row) for row in part], add_special_tokens=False)
            for row, code in zip(part, codes, strict=True):
                ids = np.array(code.ids, "<u4")
                ends = [*np.flatnonzero(ids == self.mark_id).tolist(), len(ids)]
                data, start = ids.tobytes(), 0
                for word, end in zip(row, ends, strict=True):
                    known[word] = data[4 * start : 4 * end]
                    start = end + 1

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        for a, b in slices(texts):
            if b - a == 1 and len(texts[a]) > LONG:  # one long text: a bounded number of words at a time
                parts = chunks((m[0] for m in WORD.finditer(texts[a])), 200_000)
                yield b"".join(self._ids(words) for words in parts)
                continue
            words = [WORD.findall(folded(text)) for text in texts[a:b]]
            have = self._have(set().union(*words))
            yield from (b"".join(map(have, each)) for each in words)

    def _have(self, words: set[str]):
        if new := self.known.missing(words):
            self.learn(new)
        return self.known.young.__getitem__

    def _ids(self, words: list[str]) -> bytes:
        return b"".join(map(self._have(set(words)), words))


@lru_cache(maxsize=2)
def word_tokens(path: str) -> WordTokens:
    """One per worker process: what it has learned serves the next task."""
    return WordTokens(path)


def token_pieces(
    docs: DataFrame, tokenizer: str, length: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False
) -> DataFrame:
    """One row per piece of a document; with `keep_ids` also its `ids` (unsigned 32-bit, little-endian, as binary)."""
    end = np.array([end_id], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = word_tokens(tokenizer)
        for batch in batches:
            names = batch.column("doc_id").to_pylist()
            rows = []
            for name, data in zip(names, words.encode(batch.column("text").to_pylist()), strict=True):
                data += end
                for k, at in enumerate(range(0, len(data), 4 * length)):
                    part = data[at : at + 4 * length]
                    rows.append((name, k, at // 4, len(part) // 4, zlib.crc32(part), *([part] if keep_ids else [])))
                if len(rows) >= 5_000:
                    yield _batch(rows, keep_ids, batch.schema.field("doc_id").type)
                    rows = []
            if rows:
                yield _batch(rows, keep_ids, batch.schema.field("doc_id").type)

    rows = id_and_text(docs, id_col, text_col)
    more = T.StructType.fromDDL(PIECES + (", ids BINARY" if keep_ids else "")).fields
    return rows.mapInArrow(lean(cut), T.StructType([rows.schema["doc_id"], *more]))


def _batch(rows: list[tuple], keep_ids: bool, id_type: pa.DataType) -> pa.RecordBatch:
    kinds = {"doc_id": id_type, "piece": pa.int32(), "start": pa.int64(), "length": pa.int64(), "ids_crc32": pa.int64()}
    kinds |= {"ids": pa.binary()} if keep_ids else {}
    columns = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds.values(), strict=True)], names=list(kinds))


class OpenBins:
    """The open bins of a task, by free space; bit f of `spaces` is set while a bin with f free tokens is open."""

    def __init__(self, capacity: int, most: int):
        self.capacity, self.most, self.count, self.made = capacity, most, 0, 0
        self.spaces, self.bins = 0, [[] for _ in range(capacity + 1)]

    def place(self, length: int) -> tuple[int, int]:
        """The bin of a piece and its offset there."""
        if length > self.capacity:
            raise ValueError(f"a piece of {length} does not fit in {self.capacity}")
        fitting = self.spaces >> length
        if fitting:
            free = length + (fitting & -fitting).bit_length() - 1
            number = self._take(free)
        else:
            free, number = self.capacity, self.made
            self.made += 1
        if free > length:
            self._keep(number, free - length)
        return number, self.capacity - free

    def _take(self, free: int) -> int:
        number = self.bins[free].pop()
        self.count -= 1
        if not self.bins[free]:
            self.spaces &= ~(1 << free)
        return number

    def _keep(self, number: int, free: int) -> None:
        self.bins[free].append(number)
        self.spaces |= 1 << free
        self.count += 1
        if self.count > self.most:
            self._take((self.spaces & -self.spaces).bit_length() - 1)  # the fullest closes


def pack_pieces(pieces: DataFrame, length: int = 4096, open_bins: int = 65_536, per_task: int = 250_000) -> DataFrame:
    """Adds `sequence_id` and `offset` to rows with doc_id, piece, start, length and ids_crc32.

    The pieces are dealt over tasks of about `per_task` by a hash of what they are, and sorted within a task: the same rows
    give the same sequences when a task is run again. Sequences do not span tasks.
    """
    dealt_by = F.xxhash64("doc_id", "piece", "start", "ids_crc32", "length")
    tasks = max(1, math.ceil(pieces.count() / per_task))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins, base = OpenBins(length, open_bins), TaskContext.get().partitionId() << 40
        for batch in batches:
            places = [bins.place(n) for n in batch.column("length").to_pylist()]
            more = [pa.array([base + p[0] for p in places], pa.int64()), pa.array([p[1] for p in places], pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*batch.schema.names, "sequence_id", "offset"])

    dealt = pieces.select("doc_id", "piece", "start", "length", "ids_crc32").repartition(tasks, dealt_by)
    schema = T.StructType([*dealt.schema.fields, *T.StructType.fromDDL(PLACED).fields])
    return dealt.sortWithinPartitions(F.desc("length"), dealt_by, "doc_id", "piece").mapInArrow(place, schema)


def pack(
    docs: DataFrame, tokenizer: str, length: int = 4096, end_id: int = 1, open_bins: int = 65_536, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Documents cut into pieces of at most `length` tokens and placed in sequences of that length, one row per piece."""
    pieces = written(token_pieces(docs, tokenizer, length, end_id, id_col, text_col), "pieces")
    return pack_pieces(pieces, length, open_bins)


def sequences(pieces: DataFrame, placed: DataFrame) -> DataFrame:
    """The packed sequences: `sequence_id`, `ids` (binary), from pieces with their ids and their places.

    Pieces are matched by document, number, length and checksum, so rows that occur twice must have been made distinct.
    """
    keys = ["doc_id", "piece", "start", "length", "ids_crc32"]
    same = [pieces[k].eqNullSafe(placed[k]) for k in keys]
    parts = placed.join(pieces, same).select("sequence_id", "offset", "ids")
    ordered = F.sort_array(F.collect_list(F.struct("offset", "ids")))  # at most `length` pieces in a sequence
    joined = F.aggregate(ordered, F.lit(b""), lambda whole, part: F.concat(whole, part["ids"]))
    return parts.groupBy("sequence_id").agg(joined.alias("ids"))
