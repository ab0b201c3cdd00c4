"""Exact top-k search by inner product, with block-at-a-time pruning.

Rows are put near rows like them (by the nearest of a few pivots) and cut into superblocks, and these into blocks of
neighbouring rows. A superblock is one row of a table: its forward index (the matrix of its rows) and, per block and
component, the least and the largest value. For a query the sum over components of the larger of query times least and query
times largest bounds every score of a block.

A first pass scores each query in one superblock near it, which gives a lower bound of its k-th score. Then a query goes to
the superblocks whose bound reaches that, and there through the blocks in the order of their bounds until these fall below
its k-th score. What is left per superblock, at most k rows per query, is merged.

Components are floor(scale * x) with x as double. Rows whose id or vector is null, or whose vector holds a null or a number
that is not finite, take no part. A shorter vector counts as filled up with zeros. A query is never its own result, nor is
another row of its id; rows that occur twice are candidates twice, and a query that occurs twice with one vector is asked
once. Ties go to the smaller id. Other columns are not looked at. Without queries or candidates there are no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelayer.llm.texts import importable, written

LOWEST = np.iinfo(np.int64).min + 1  # its negative is a number too
INDEX = "superblock BIGINT, cell INT, width INT, ids BINARY, matrix BINARY, starts BINARY, least BINARY, most BINARY"
CHUNK = "chunk BIGINT, cell INT, width INT, ids BINARY, marks BINARY, matrix BINARY"


def _stacked(lists: pa.Array) -> np.ndarray:
    """Lists of integers as the rows of a matrix, filled up with zeros."""
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    sizes = np.diff(lists.offsets.to_numpy())
    out = np.zeros((len(lists), int(sizes.max(initial=1)) or 1), np.int64)
    out[np.arange(out.shape[1]) < sizes[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
    return out


def _wide(matrix: np.ndarray, width: int) -> np.ndarray:
    return np.pad(matrix, ((0, 0), (0, max(0, width - matrix.shape[1]))))


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer products of rows: in doubles where no sum can leave their integers."""
    width = max(a.shape[1], b.shape[1])
    a, b = _wide(a, width), _wide(b, width)
    if float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * width < 2**52:
        return (a.astype(float) @ b.T.astype(float)).astype(np.int64)
    return a @ b.T


def bounds(queries: np.ndarray, least: np.ndarray, most: np.ndarray) -> np.ndarray:
    """For each query and block, a number that no score in the block exceeds."""
    return _products(np.maximum(queries, 0), most) + _products(np.minimum(queries, 0), least)


def integer_vectors(table: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    v = F.col("v")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = table.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    rows = rows.where(F.col("vec_id").isNotNull() & v.isNotNull() & finite)
    return rows.select("vec_id", F.transform(v, lambda x: F.floor(x * scale)).alias("v"))


def _with_cells(rows: DataFrame, pivots: np.ndarray) -> DataFrame:
    half = (pivots**2).sum(1) / 2

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _stacked(batch.column("v")).astype(float)
            width = max(x.shape[1], pivots.shape[1])
            cell = np.argmax(_wide(x, width) @ _wide(pivots, width).T - half, 1) if len(x) else np.empty(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32))], names=["vec_id", "v", "cell"])

    return rows.mapInArrow(nearest, "vec_id BIGINT, v ARRAY<BIGINT>, cell INT")


def _parted(rows: DataFrame, size: int) -> DataFrame:
    """Adds `part`: a cell is dealt into as many parts of about `size` rows as it needs."""
    need = rows.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / F.lit(size)).alias("parts"))  # one row per pivot
    return rows.join(F.broadcast(need), "cell").withColumn("part", F.pmod(F.xxhash64("vec_id"), F.col("parts")))


def superblocks(rows: DataFrame, size: int, block: int) -> DataFrame:
    def build(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        matrix, ids = _stacked(table.column("v")), table.column("vec_id").to_numpy()
        axis = int(np.argmax(matrix.var(0)))  # neighbours along the widest component share a block
        order = np.lexsort((ids, matrix[:, axis]))
        matrix, ids = matrix[order], ids[order]
        starts = np.arange(0, len(ids), block)
        least, most = np.minimum.reduceat(matrix, starts), np.maximum.reduceat(matrix, starts)
        number = key[0].as_py() << 32 | key[1].as_py()
        values = [number, key[0].as_py(), matrix.shape[1], *(x.astype("<i8").tobytes() for x in (ids, matrix, starts, least, most))]
        names = [c.split()[0] for c in INDEX.split(", ")]
        kinds = [pa.int64(), pa.int32(), pa.int32(), *[pa.binary()] * 5]
        return pa.table([pa.array([x], t) for x, t in zip(values, kinds, strict=True)], names=names)

    return _parted(rows, size).groupBy("cell", "part").applyInArrow(build, INDEX)


def query_chunks(rows: DataFrame, size: int) -> DataFrame:
    """Queries of a cell together; `marks` tell apart queries that have one id and different vectors."""

    def build(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        matrix, ids, marks = _stacked(table.column("v")), table.column("vec_id").to_numpy(), table.column("mark").to_numpy()
        values = [key[0].as_py() << 32 | key[1].as_py(), key[0].as_py(), matrix.shape[1], *(x.astype("<i8").tobytes() for x in (ids, marks, matrix))]
        names = [c.split()[0] for c in CHUNK.split(", ")]
        kinds = [pa.int64(), pa.int32(), pa.int32(), *[pa.binary()] * 3]
        return pa.table([pa.array([x], t) for x, t in zip(values, kinds, strict=True)], names=names)

    distinct = rows.withColumn("mark", F.xxhash64("v")).dropDuplicates(["vec_id", "v"])
    return _parted(distinct, size).groupBy("cell", "part").applyInArrow(build, CHUNK)


class Best:
    """The k best candidates of each query so far: scores and ids, best first, ties to the smaller id."""

    def __init__(self, queries: int, k: int, floor: np.ndarray | None = None):
        self.k = k
        self.scores, self.ids = np.full((queries, k), LOWEST), np.full((queries, k), np.iinfo(np.int64).max)
        self.floor = np.full(queries, LOWEST) if floor is None else floor

    def kth(self) -> np.ndarray:
        return np.maximum(self.scores[:, -1], self.floor)

    def add(self, rows: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        hopeful = np.flatnonzero((scores >= self.kth()[rows][:, None]).any(1))
        for i in hopeful:
            row = rows[i]
            take = np.flatnonzero(scores[i] >= max(self.scores[row, -1], self.floor[row]))
            s, d = np.concatenate([self.scores[row], scores[i][take]]), np.concatenate([self.ids[row], ids[take]])
            order = np.lexsort((d, -s))[: self.k]
            self.scores[row], self.ids[row] = s[order], d[order]


def search_blocks(queries: np.ndarray, own: np.ndarray, ids: np.ndarray, matrix: np.ndarray, starts: np.ndarray, least: np.ndarray, most: np.ndarray, best: Best) -> None:
    """Takes each query through the blocks in the order of its bounds until these fall below its k-th score."""
    limit = bounds(queries, least, most)
    order = np.argsort(-limit, 1, kind="stable")
    ends = np.append(starts[1:], len(ids))
    for step in range(len(starts)):
        block = order[:, step]
        live = np.flatnonzero(limit[np.arange(len(queries)), block] >= best.kth())
        if not len(live):
            break
        for b in np.unique(block[live]):
            rows = live[block[live] == b]
            part = slice(starts[b], ends[b])
            scores = _products(queries[rows], matrix[part])
            scores[ids[part][None, :] == own[rows][:, None]] = LOWEST
            best.add(rows, scores, ids[part])


def _ints(data: bytes, width: int | None = None) -> np.ndarray:
    flat = np.frombuffer(data, "<i8")
    return flat if width is None else flat.reshape(-1, width)


def _searched(pairs: DataFrame, k: int, lower_bounds_only: bool) -> DataFrame:
    """Rows with a chunk (q_*) and a superblock: per query the lower bound of its k-th score, or its best rows there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                r = {c: batch.column(c)[row].as_py() for c in batch.schema.names}
                queries, own, marks = _ints(r["q_matrix"], r["q_width"]), _ints(r["q_ids"]), _ints(r["q_marks"])
                best = Best(len(own), k, None if lower_bounds_only else _ints(r["q_floor"]))
                index = [_ints(r["ids"]), _ints(r["matrix"], r["width"]), _ints(r["starts"]), _ints(r["least"], r["width"]), _ints(r["most"], r["width"])]
                search_blocks(queries, own, *index, best)
                if lower_bounds_only:
                    yield pa.RecordBatch.from_arrays([pa.array([r["q_chunk"]]), pa.array([best.scores[:, -1].tobytes()])], names=["chunk", "floor"])
                    continue
                query, place = np.nonzero(best.scores > LOWEST)
                columns = [own[query], marks[query], best.ids[query, place], best.scores[query, place]]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["query_id", "mark", "vec_id", "score"])

    return pairs.mapInArrow(run, "chunk BIGINT, floor BINARY" if lower_bounds_only else "query_id BIGINT, mark BIGINT, vec_id BIGINT, score BIGINT")


def _visits(chunks: DataFrame, index: DataFrame, groups: int) -> DataFrame:
    """Per chunk and superblock whose bound reaches a query's lower bound: those queries. Summaries travel in `groups` rows."""
    summary = index.select("superblock", "width", "least", "most")

    def gather(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        width = max(table.column("width").to_pylist())
        least, most = [], []
        for w, a, b in zip(*(table.column(c).to_pylist() for c in ("width", "least", "most")), strict=True):
            least.append(_wide(_ints(a, w).min(0)[None, :], width))
            most.append(_wide(_ints(b, w).max(0)[None, :], width))
        values = [key[0].as_py(), width, *(np.concatenate(x).astype("<i8").tobytes() for x in ([table.column("superblock").to_numpy()], least, most))]
        kinds = [pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
        return pa.table([pa.array([x], t) for x, t in zip(values, kinds, strict=True)], names=["part", "s_width", "numbers", "s_least", "s_most"])

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                r = {c: batch.column(c)[row].as_py() for c in batch.schema.names}
                queries, floor, numbers = _ints(r["q_matrix"], r["q_width"]), _ints(r["q_floor"]), _ints(r["numbers"])
                reached = bounds(queries, _ints(r["s_least"], r["s_width"]), _ints(r["s_most"], r["s_width"])) >= floor[:, None]
                own, marks = _ints(r["q_ids"]), _ints(r["q_marks"])
                for s in np.flatnonzero(reached.any(0)):
                    rows = reached[:, s]
                    values = [int(numbers[s]), r["q_chunk"], r["q_width"], *(x.astype("<i8").tobytes() for x in (own[rows], marks[rows], queries[rows], floor[rows]))]
                    kinds = [pa.int64(), pa.int64(), pa.int32(), *[pa.binary()] * 4]
                    names = ["superblock", "q_chunk", "q_width", "q_ids", "q_marks", "q_matrix", "q_floor"]
                    yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(values, kinds, strict=True)], names=names)

    grouped = summary.groupBy(F.pmod(F.xxhash64("superblock"), F.lit(groups)).alias("part")).applyInArrow(
        gather, "part BIGINT, s_width INT, numbers BINARY, s_least BINARY, s_most BINARY"
    )
    dealt = chunks.withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(groups - 1).cast("bigint"))))
    schema = "superblock BIGINT, q_chunk BIGINT, q_width INT, q_ids BINARY, q_marks BINARY, q_matrix BINARY, q_floor BINARY"
    return dealt.join(grouped, "part").mapInArrow(choose, schema)


def top_k(
    table: DataFrame, is_query: Column, k: int = 20, scale: int = 64, id_col: str = "vec_id", vector_col: str = "embedding",
    superblock: int = 4096, block: int = 256, chunk: int = 512, pivots: int = 64,
) -> DataFrame:
    """`query_id`, `rank`, `vec_id`, `score` of the k best rows per query; `is_query` is a condition on `vec_id`."""
    importable(table.sparkSession)
    rows = integer_vectors(table, id_col, vector_col, scale)
    total = max(1, rows.count())
    few = min(pivots, math.ceil(total / superblock))
    share = int(min(1.0, 20 * few / total) * 1_000_000) + 1
    sample = rows.where(F.pmod(F.xxhash64("vec_id", F.lit(4)), F.lit(1_000_000)) < share).orderBy(F.xxhash64("vec_id"), "vec_id").limit(few).select("v").collect()
    width = max([1, *(len(r["v"]) for r in sample)])
    centres = np.array([[*r["v"], *[0] * (width - len(r["v"]))] for r in sample], float) if sample else np.zeros((1, width))
    celled = written(_with_cells(rows, centres), "celled")
    index = written(superblocks(celled, superblock, block), "index")
    chunks = written(query_chunks(celled.where(is_query), chunk), "chunks")
    asked = chunks.select("cell", *[F.col(c).alias(f"q_{c}") for c in ("chunk", "width", "ids", "marks", "matrix")])
    first = index.groupBy("cell").agg(F.min("superblock").alias("superblock"))  # a query is a row too, so its cell has one
    near = asked.join(index.drop("cell").join(first, "superblock"), "cell").drop("cell", "superblock")
    floors = _searched(near, k, True).withColumnsRenamed({"chunk": "q_chunk", "floor": "q_floor"})
    asked = written(asked.drop("cell").join(floors, "q_chunk"), "asked")
    visits = _visits(asked, index, max(1, math.ceil(index.count() / 8192)))
    found = _searched(visits.join(index.drop("cell"), "superblock").drop("superblock"), k, False)
    order = Window.partitionBy("query_id", "mark").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
