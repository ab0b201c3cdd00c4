"""Token counts by byte-level BPE, with rank-synchronous merging of numpy arrays.

A text is split into units (white space and the word after it) that the pre-tokenisation never crosses; how many tokens a
unit has is looked up, and units not met before are merged all together: their bytes lie in one ragged array of symbols,
each round finds the lowest-rank pair of each sequence, merges all its occurrences, and drops the sequences that have none.

Null and empty texts have 0 tokens and 0 bytes. Every row is counted for itself, also if it occurs twice or has no id.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelayer.llm.texts import LONG, WHITE_SPACE, Remembered, chunks, id_and_text, lean, slices

# Fixed value: the pre-tokenisation of the vocabulary.
PRE_TOKENS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
UNIT = regex.compile(f"[{WHITE_SPACE}]*[^{WHITE_SPACE}]+|[{WHITE_SPACE}]+")
NONE = np.iinfo(np.int64).max


def byte_letters() -> list[str]:
    """The letter that stands for each byte in the vocabulary: printable Latin-1 as it is, the others from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b if b in plain else next(others)) for b in range(256)]


class RankedMerges:
    """The merges of a vocabulary file as sorted pair keys, with the rank and the merged symbol of each."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            whole = json.load(file)
        vocabulary = whole["model"]["vocab"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in whole["model"]["merges"]]
        self.specials = [t["content"] for t in whole.get("added_tokens", ()) if t["special"]]
        self.first = np.array([vocabulary[c] for c in byte_letters()], np.int64)
        self.width = max(vocabulary.values()) + 1
        key = np.array([vocabulary[a] * self.width + vocabulary[b] for a, b in merges], np.int64)
        order = np.argsort(key, kind="stable")
        self.keys = np.append(key[order], NONE)
        self.ranks = np.append(order, NONE)
        self.merged = np.append(np.array([vocabulary[a + b] for a, b in merges], np.int64)[order], -1)

    def counts(self, tokens: list[bytes]) -> np.ndarray:
        """How many symbols each pre-token has once no pair can be merged any more."""
        sizes = np.array([len(t) for t in tokens], np.int64)
        left = sizes.copy()
        if not len(tokens):
            return left
        symbols = self.first[np.frombuffer(b"".join(tokens), np.uint8)]
        owner = np.repeat(np.arange(len(tokens)), sizes)
        many = sizes[owner] > 1
        symbols, owner = symbols[many], owner[many]
        while len(symbols):
            last = np.append(owner[1:] != owner[:-1], True)
            pair = symbols * self.width + np.append(symbols[1:], 0)
            at = np.searchsorted(self.keys, pair)
            found = (self.keys[at] == pair) & ~last
            rank = np.where(found, self.ranks[at], NONE)
            starts = np.flatnonzero(np.append(True, last[:-1]))
            lowest = np.minimum.reduceat(rank, starts)
            sizes_now = np.diff(np.append(starts, len(symbols)))
            hit = found & (rank == np.repeat(lowest, sizes_now))
            hit &= ~self._second(hit, pair)
            symbols = np.where(hit, self.merged[at], symbols)
            gone = np.append(False, hit[:-1])
            left -= np.bincount(owner[gone], minlength=len(left))
            live = ~gone & np.repeat(lowest < NONE, sizes_now)
            symbols, owner = symbols[live], owner[live]
        return left

    @staticmethod
    def _second(hit: np.ndarray, pair: np.ndarray) -> np.ndarray:
        """Hits that overlap the one before, as in a run of one symbol: every second of a run, from the left."""
        follows = np.append(False, hit[1:] & hit[:-1])
        if not follows.any():
            return follows
        place = np.arange(len(hit))
        begin = np.maximum.accumulate(np.where(hit & ~follows, place, 0))
        return hit & ((place - begin) % 2 == 1)


class TokenCounter:
    """Counts whole texts; keeps the counts of up to twice `most` units."""

    def __init__(self, path: str, most: int = 400_000):
        self.merges, self.known = RankedMerges(path), Remembered(most)
        self.pre = regex.compile(PRE_TOKENS)
        self.special = regex.compile("|".join(map(regex.escape, self.merges.specials)) or r"(?!)")

    def _learn(self, units: list[str]) -> None:
        owners, tokens, fixed = [], [], np.zeros(len(units), np.int64)
        find, specials = self.pre.findall, [s[:2] for s in self.merges.specials]
        for i, unit in enumerate(units):
            parts = [unit]
            if any(s in unit for s in specials):
                parts = self.special.split(unit)
                fixed[i] = len(parts) - 1
            for part in parts:
                got = find(part)
                tokens += got
                owners += [i] * len(got)
        distinct: dict[str, int] = {}
        index = np.array([distinct.setdefault(t, len(distinct)) for t in tokens], np.int64)
        sizes = self.merges.counts([t.encode("utf-8") for t in distinct])
        counted = np.bincount(np.array(owners, np.int64), weights=sizes[index] if len(index) else None, minlength=len(units))
        self.known.young.update(zip(units, (counted[: len(units)].astype(np.int64) + fixed).tolist(), strict=True))

    def _total(self, each: list[list[str]]) -> list[int]:
        units = set().union(*each)
        for part in chunks(iter(self.known.missing(units)), 200_000):
            self._learn(part)
        have = self.known.young.__getitem__
        return [sum(map(have, x)) for x in each]

    def counts(self, texts: list[str]) -> list[int]:
        out: list[int] = []
        for a, b in slices(texts):
            if b - a == 1 and len(texts[a]) > LONG:  # one long text: a bounded number of units at a time
                parts = chunks((m[0] for m in UNIT.finditer(texts[a])), 200_000)
                out.append(sum(self._total([part])[0] for part in parts))
            else:
                out += self._total([UNIT.findall(text) for text in texts[a:b]])
        return out


@lru_cache(maxsize=2)
def token_counter(path: str) -> TokenCounter:
    """One per worker process: what it has learned serves the next task."""
    return TokenCounter(path)


def count_tokens(docs: DataFrame, vocabulary: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`doc_id`, `n_bytes`, `n_tokens`, `over_limit` per row; `vocabulary` is the path of a byte-level BPE in JSON."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = token_counter(vocabulary)
        for batch in batches:
            found = pa.array(counter.counts(batch.column("text").to_pylist()), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), found], names=["doc_id", "n_bytes", "n_tokens"])

    rows = id_and_text(docs, id_col, text_col).withColumn("n_bytes", F.octet_length("text").cast("bigint"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    counted = rows.mapInArrow(lean(count), f"doc_id {kind}, n_bytes BIGINT, n_tokens BIGINT")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
