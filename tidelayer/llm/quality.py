"""Quality classifier: a generalised additive model with pairwise interactions.

Each feature of a text is cut into bins. Boosting goes round the features in turn: it fits a shallow tree to what is still
unexplained along one feature and adds a small step of it to that feature's lookup table; afterwards the same for pairs of
features that explain most of the rest. A text is scored by adding the table entries of its bins, for whole batches at
once. The model is fitted on a bounded sample of labelled rows (`sample_rows`), chosen by a hash of the id; its size is
a few tables. Features come from the whole text and nothing else.

A null text is an empty one; both get a score. Without labelled rows every score is 0.5. Rows with a null id are scored,
but never learned from. Labels that are null are left out, labels that occur twice count twice.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelayer.llm.texts import id_and_text, importable, lean
from tidelayer.llm.words import Words, by_owner, word_slices

FEATURES = (
    "bytes", "words", "word_length", "upper", "digits", "symbols", "marks", "sentence_ends", "beyond_ascii", "words_per_line", "words_per_sentence",
    "distinct_words", "distinct_lines", "shouted_words", "words_ending_in_symbols", "words_without_letters", "most_frequent_word", "long_words",
)
_CLASS = np.zeros(256, np.int64)  # 0: lower-case letter
_CLASS[65:91] = 1
_CLASS[48:58] = 2
_CLASS[[ord(c) for c in "#$%&*+/<=>@\\^_`{|}~[]"]] = 3
_CLASS[[ord(c) for c in ",;:'\"()-"]] = 4
_CLASS[[ord(c) for c in ".!?"]] = 5
_CLASS[[32, 9, 10, 11, 12, 13]] = 6
_CLASS[128:] = 7
_CLASS[[*range(9), *range(14, 32), 127]] = 3


def _grouped(values: np.ndarray, owner: np.ndarray, size: int) -> np.ndarray:
    return np.bincount(owner, weights=values, minlength=size)[:size]


def _distinct(owner: np.ndarray, hashes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Per text: distinct hashes, and how often the most frequent one occurs."""
    if not len(owner):
        return np.zeros(size), np.zeros(size)
    order = by_owner(hashes, owner)
    o, h = owner[order], hashes[order]
    starts = np.flatnonzero(np.append(True, (o[1:] != o[:-1]) | (h[1:] != h[:-1])))
    runs = np.diff(np.append(starts, len(o)))
    most = np.zeros(size)
    np.maximum.at(most, o[starts], runs)
    return np.bincount(o[starts], minlength=size)[:size].astype(float), most


def features_of(words: Words) -> np.ndarray:
    """One row per text, columns as in FEATURES."""
    n = len(words.offsets) - 1
    sizes = np.diff(words.offsets).astype(float)
    text_of = np.repeat(np.arange(n), np.diff(words.offsets))
    kinds = _CLASS[words.data]
    counts = np.bincount(text_of * 8 + kinds, minlength=8 * n).reshape(n, 8).astype(float)
    solid = np.maximum(sizes - counts[:, 6], 1)
    owner, per_word = words.owners(), np.maximum(np.diff(words.bounds), 1).astype(float)
    lengths = (words.ends - words.starts).astype(float)
    distinct, most = _distinct(owner, words.hashes, n)

    running = np.concatenate([np.zeros((1, 2)), np.cumsum(np.stack([kinds == 1, (kinds == 0) | (kinds == 7)], 1), 0)])
    upper, lower = (running[words.ends] - running[words.starts]).T
    shouted = (upper >= 2) & (lower == 0)
    tail = kinds[words.ends - 1] == 3 if len(words.ends) else np.empty(0, bool)

    breaks = np.flatnonzero(words.data == 10)
    lines = np.bincount(text_of[breaks], minlength=n)[:n] + 1.0
    line_starts = np.union1d(words.offsets[:-1][np.diff(words.offsets) > 0], breaks + 1)
    line_starts = line_starts[line_starts < len(words.data)].astype(np.int64)
    line_ends = np.append(line_starts[1:], len(words.data))
    a, b = np.searchsorted(words.starts, line_starts), np.searchsorted(words.starts, line_ends)
    sums = np.concatenate([np.zeros(1, np.uint64), np.add.accumulate(words.hashes)])
    filled = b > a
    line_owner = text_of[line_starts[filled]] if len(line_starts) else np.empty(0, np.int64)
    distinct_lines, _ = _distinct(line_owner, (sums[b] - sums[a])[filled], n)
    filled_lines = np.maximum(np.bincount(line_owner, minlength=n)[:n], 1)

    return np.stack(
        [
            np.log1p(sizes), np.log1p(per_word), solid / per_word, counts[:, 1] / solid, counts[:, 2] / solid, counts[:, 3] / solid,
            counts[:, 4] / solid, counts[:, 5] / solid, counts[:, 7] / solid, np.log1p(per_word / lines), np.log1p(per_word / (counts[:, 5] + 1)),
            distinct / per_word, distinct_lines / filled_lines, _grouped(shouted, owner, n) / per_word, _grouped(tail, owner, n) / per_word,
            _grouped((upper == 0) & (lower == 0), owner, n) / per_word, most / per_word, _grouped(lengths > 20, owner, n) / per_word,
        ],
        1,
    )


@dataclass
class AdditiveModel:
    """Lookup tables over binned features and pairs of them, added up and squashed."""

    intercept: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, i], "right") for i, e in enumerate(self.edges)], 1)

    def margins(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.intercept)
        if self.tables:
            bins = self.bins(x)
            for i, table in enumerate(self.tables):
                total += table[bins[:, i]]
            for i, j, table in self.pairs:
                total += table[self.coarse[i][bins[:, i]], self.coarse[j][bins[:, j]]]
        return total

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margins(x)))


def _leaves(g: np.ndarray, h: np.ndarray, n: np.ndarray, depth: int, least: int) -> np.ndarray:
    """Leaf values of a shallow tree along one axis of gradient, curvature and row sums per bin."""
    value = np.full(len(g), g.sum() / (h.sum() + 1.0))
    if depth == 0 or len(g) < 2:
        return value
    left_g, left_h, left_n = np.cumsum(g)[:-1], np.cumsum(h)[:-1], np.cumsum(n)[:-1]
    gain = left_g**2 / (left_h + 1) + (g.sum() - left_g) ** 2 / (h.sum() - left_h + 1)
    gain = np.where((left_n >= least) & (n.sum() - left_n >= least), gain, -np.inf)
    best = int(np.argmax(gain))
    if gain[best] <= g.sum() ** 2 / (h.sum() + 1) + 1e-12:
        return value
    cut = best + 1
    return np.concatenate([_leaves(g[:cut], h[:cut], n[:cut], depth - 1, least), _leaves(g[cut:], h[cut:], n[cut:], depth - 1, least)])


def _leaves_of_pair(g: np.ndarray, h: np.ndarray, n: np.ndarray, least: int) -> np.ndarray:
    """A tree of depth two on a grid: the better first axis, then the other axis in each half."""
    best, chosen = -np.inf, np.zeros_like(g)
    for turned in (False, True):
        a, b, c = (x.T if turned else x for x in (g, h, n))
        first = _leaves(a.sum(1), b.sum(1), c.sum(1), 1, least)
        value = np.zeros_like(a)
        for level in np.unique(first):
            rows = first == level
            value[rows] = _leaves(a[rows].sum(0), b[rows].sum(0), c[rows].sum(0), 1, least)
        gain = 2 * (value * a).sum() - (value**2 * (b + 1e-9)).sum()
        if gain > best:
            best, chosen = gain, value.T if turned else value
    return chosen


def fit(x: np.ndarray, y: np.ndarray, bins: int = 64, grid: int = 12, rounds: int = 150, step: float = 0.1, pairs: int = 10, least: int = 8) -> AdditiveModel:
    """Cyclic boosting of shallow trees, first along single features, then on the pairs that explain most of the rest."""
    model = AdditiveModel(intercept=float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1))))
    if not len(y) or y.min() == y.max():
        return model
    model.edges = [np.unique(np.quantile(x[:, i], np.linspace(0, 1, bins + 1)[1:-1])) for i in range(x.shape[1])]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    model.coarse = [(np.arange(len(e) + 1) * grid) // (len(e) + 1) for e in model.edges]
    b = model.bins(x)
    margin = np.full(len(y), model.intercept)

    def state() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-margin))
        return y - p, np.maximum(p * (1 - p), 1e-6)

    for _ in range(rounds):
        for i, table in enumerate(model.tables):
            g, h = state()
            at, size = b[:, i], len(table)
            move = step * _leaves(np.bincount(at, g, size), np.bincount(at, h, size), np.bincount(at, minlength=size), 2, least)
            table += move
            margin += move[at]

    cells = [c[b[:, i]] for i, c in enumerate(model.coarse)]

    def sums(i: int, j: int, weights: np.ndarray | None) -> np.ndarray:
        return np.bincount(cells[i] * grid + cells[j], weights, grid * grid).reshape(grid, grid).astype(float)

    g, h = state()
    gains = []
    for i in range(x.shape[1]):
        for j in range(i + 1, x.shape[1]):
            a, c, n = sums(i, j, g), sums(i, j, h), sums(i, j, None)
            value = _leaves_of_pair(a, c, n, least)
            gains.append((float(2 * (value * a).sum() - (value**2 * c).sum()), i, j))
    model.pairs = [(i, j, np.zeros((grid, grid))) for _, i, j in sorted(gains, reverse=True)[:pairs]]
    for _ in range(rounds // 3):
        for i, j, table in model.pairs:
            g, h = state()
            move = step * _leaves_of_pair(sums(i, j, g), sums(i, j, h), sums(i, j, None), least)
            table += move
            margin += move[cells[i], cells[j]]
    return model


def _per_batch(rows: DataFrame, schema: str, make) -> DataFrame:
    """Rows without their text but with what `make` gives for each slice of words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [make(words) for _, _, words in word_slices(batch.column("text"))]
            if not parts:
                continue
            kept = [(c, batch.column(c)) for c in batch.schema.names if c != "text"]
            made = [(name, pa.array(np.concatenate([p[name] for p in parts]))) for name in parts[0]]
            yield pa.RecordBatch.from_arrays([a for _, a in kept + made], names=[c for c, _ in kept + made])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != "text")
    return rows.mapInArrow(lean(run), f"{kinds}, {schema}")


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", sample_rows: int = 20_000, may_learn=None, id_col: str = "doc_id", text_col: str = "text") -> AdditiveModel:
    """Fits on about `sample_rows` labelled rows; `may_learn` is a condition on `doc_id` (all rows if None).

    Ids are drawn by hash. Where ids come many times, no more than four times `sample_rows` rows reach the driver, those of the
    least hash of what they hold.
    """
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", F.col(label).cast("double").alias("y"))
    rows = id_and_text(docs, id_col, text_col)
    if may_learn is not None:
        known, rows = known.where(may_learn), rows.where(may_learn)
    share = min(1.0, sample_rows / max(1, known.count()))
    chosen = F.pmod(F.xxhash64("doc_id", F.lit(9)), F.lit(1_000_000)) < int(share * 1_000_000)
    names = [f"f{i}" for i in range(len(FEATURES))]

    def columns(words: Words) -> dict[str, np.ndarray]:
        return dict(zip(names, features_of(words).T, strict=True))

    seen = _per_batch(rows.where(chosen), ", ".join(f"{c} DOUBLE" for c in names), columns)
    joined = seen.join(known.where(chosen), "doc_id")
    bounded = joined.orderBy(F.xxhash64("doc_id", "y", *names), "doc_id", "y", *names).limit(4 * sample_rows)
    sample = bounded.orderBy("doc_id", "y", *names).toPandas()
    return fit(sample[names].to_numpy(float), sample["y"].to_numpy(float))


def score(docs: DataFrame, model: AdditiveModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`doc_id` and `score` per row."""
    return _per_batch(id_and_text(docs, id_col, text_col), "score DOUBLE", lambda words: {"score": model.scores(features_of(words))})


def without_low_quality(docs: DataFrame, model: AdditiveModel, least: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows that score `least` or more, with all their columns."""
    importable(docs.sparkSession)
    names = docs.columns

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [model.scores(features_of(words)) for _, _, words in word_slices(batch.column(names.index(text_col)).fill_null(""))]
            if parts:
                yield batch.filter(pa.array(np.concatenate(parts) >= least))

    return docs.mapInArrow(lean(keep), docs.schema)


def is_held_out() -> F.Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
