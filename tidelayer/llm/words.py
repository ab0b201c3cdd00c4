"""Words and word shingles of many texts at once, as numpy arrays of 64-bit hashes.

A word is a run of bytes other than space and U+0009 to U+000D, with A-Z lower-cased. Word hashes are polynomials over
random values per byte, modulo 2**64, read off a running sum; shingle hashes are random combinations of word hashes.
Everything is fixed by a seed, so tasks on different machines agree.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

_random = np.random.Generator(np.random.PCG64(20260101))
BYTE_VALUE = _random.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BYTE_VALUE[65:91] = BYTE_VALUE[97:123]
BASE = np.uint64(0x9E3779B97F4A7C15 | 5)
INVERSE = np.uint64(pow(int(BASE), -1, 2**64))
WEIGHTS = _random.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SLICE = 1_000_000  # bytes of text whose words are held at once
IS_SPACE = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])


def mixed(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers_up_to(size: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(size, BASE, np.uint64), np.full(size, INVERSE, np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


_usual_powers = lru_cache(maxsize=1)(lambda: _powers_up_to(SLICE + 2))


def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and its inverse; kept for slices of the usual size only."""
    return _usual_powers() if size <= SLICE + 2 else _powers_up_to(size)


def by_owner(hashes: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """The order by owner, then hash; owners are small numbers, which sort in linear time."""
    order = np.argsort(hashes)
    small = owner.astype(np.uint16) if len(owner) and owner.max() < 1 << 16 else owner
    return order[np.argsort(small[order], kind="stable")]


class Words:
    """Words of a slice of texts: `hashes`, byte ranges `starts`/`ends`, and `bounds`: text i has words bounds[i] to bounds[i + 1]."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, apart: np.ndarray = IS_SPACE):
        """`apart` tells for each of the 256 bytes whether it stands between words."""
        self.data, self.offsets = data, offsets
        solid = ~apart[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        first = solid & (edge[:-1] | np.append(True, ~solid[:-1])[: len(data)])
        last = solid & (edge[1:] | np.append(~solid[1:], True)[: len(data)])
        self.starts, self.ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.bounds = np.searchsorted(self.starts, offsets)
        up, down = _powers(len(data) + 2)
        sums = np.concatenate([np.zeros(1, np.uint64), np.add.accumulate(BYTE_VALUE[data] * up[: len(data)])])
        self.hashes = mixed((sums[self.ends] - sums[self.starts]) * down[self.starts])

    def owners(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))

    def shingles(self, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hash, text and first word of each shingle, in order. A text with fewer words has one, of all its words."""
        sizes = np.diff(self.bounds)
        counts = np.where(sizes >= width, sizes - width + 1, np.minimum(sizes, 1))
        owner = np.repeat(np.arange(len(sizes)), counts)
        begin = np.cumsum(counts) - counts
        at = self.bounds[:-1][owner] + (np.arange(counts.sum()) - begin[owner])
        length = np.minimum(sizes, width)[owner]
        padded = np.concatenate([self.hashes, np.zeros(width, np.uint64)])
        value = length.astype(np.uint64) * WEIGHTS[63]
        for k in range(width):
            value += np.where(k < length, padded[at + k], np.uint64(0)) * WEIGHTS[k]
        return mixed(value), owner, at


def word_slices(texts: pa.Array, size: int = SLICE) -> Iterator[tuple[int, int, Words]]:
    """Words of texts (string or binary, without nulls), for ranges of about `size` bytes."""
    texts = texts.cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    whole = texts.buffers()[2]
    data = np.frombuffer(whole, np.uint8) if whole is not None else np.empty(0, np.uint8)
    a = 0
    while a < len(texts):
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + size, "right")) - 1)
        yield a, b, Words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        a = b
