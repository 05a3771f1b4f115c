"""Exact top-k inner products: norm-sorted vectors, SVD-rotated partial sums, Cauchy-Schwarz pruning.

Vectors are written once, sorted by descending length over range partitions, and packed into chunks of rows of like
length. The rotation is that of the singular vectors of the whole matrix (the eigenvectors of its Gram matrix, summed in
a distributed way), which gathers most of every inner product in the first coordinates. Queries are scored against the
longest vectors, which gives each a first k-th best score and so the least length it can use; they are sorted by that
length and packed into blocks of bounded size. Then
1. blocks meet the ranges of vectors that are long enough for any of their queries, by an ordinary join on the range
   number: a grid of (query block, range) in one plan, whatever the number of queries; the driver sees none of them;
2. in each cell the chunks are walked from long to short: partial sums over the first rotated coordinates, plus the
   product of the residual lengths, bound the score from above; only pairs that can still enter are scored in full, in
   exact integers, and the cell raises its own k-th best as it goes;
3. the cells' survivors, k a query and cell at most, meet in one ranking by query.

Defined cases: vectors that are null, or hold null or non-finite components, and rows with a null id take no part. Missing
components of shorter vectors count as zero. Rows that repeat an id are vectors of their own, as queries and as
candidates: such a query's ranks start anew for each of its rows, and only its own row is no candidate. Ties go to the
smaller id, then to the row written first. Scores must fit 64 bits. Without queries or candidates the result is empty.
Columns of the input may have any names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandlake.llm.store import batches_of, stash

#: Queries of a block, vectors of a chunk, and the longest vectors that seed the queries' bounds.
QUERY_BLOCK, CHUNK, SEEDS = 8192, 8192, 1024
#: Bytes that a block's or a chunk's vectors take at most.
PACK_BYTES = 8 << 20
#: Cells of a score matrix in memory.
CELLS = 4_000_000
#: Share of the coordinates that the partial sums take.
FRONT = 4
LEAST = np.iinfo(np.int64).min


def quantised(vector: str, scale: int = 1024) -> Column:
    return F.transform(F.col(vector), lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long"))


def usable(vector: str) -> Column:
    whole = F.forall(F.col(vector), lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return F.col(vector).isNotNull() & whole


def _matrix(column: pa.ListArray, width: int) -> np.ndarray:
    flat, ends = column.flatten().to_numpy(zero_copy_only=False), np.diff(column.offsets.to_numpy())
    out = np.zeros((len(column), width), dtype=np.int64)
    out[np.repeat(np.arange(len(column)), ends), np.arange(len(flat)) - np.repeat(np.cumsum(ends) - ends, ends)] = flat
    return out


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products of the rows: in floating point where all sums stay below 2 ** 53."""
    if a.size and b.size and float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[1] < 2**53:
        return (a.astype(float) @ b.T.astype(float)).astype(np.int64)
    return a @ b.T


def rotation(vectors: DataFrame, width: int) -> np.ndarray:
    """Singular vectors of the whole matrix, strongest first. They steer the pruning only; results do not depend on them."""

    def gram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            m = _matrix(batch.column(0), width).astype(float)
            total += m.T @ m
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width * width)), pa.array(total.ravel())], names=["cell", "value"])

    cells = vectors.select("vector").mapInArrow(gram, "cell long, value double").groupBy("cell").agg(F.sum("value").alias("value")).collect()
    total = np.zeros(width * width)
    for r in cells:  # width squared
        total[r["cell"]] = r["value"]
    return np.linalg.eigh(total.reshape(width, width))[1][:, ::-1]


class _Best:
    """The k best (score, id, row) of each query so far, ties to the smaller id, then row."""

    def __init__(self, k: int, floor: np.ndarray) -> None:
        shape = (len(floor), k)
        self.score, self.id, self.row = np.full(shape, LEAST), np.zeros(shape, dtype=np.int64), np.full(shape, -1)
        self.floor = floor

    def bar(self) -> np.ndarray:
        return np.maximum(self.floor, self.score[:, -1])

    def add(self, queries: np.ndarray, scores: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        """``queries``: query of each entry, ascending."""
        k = self.score.shape[1]
        touched, first, count = np.unique(queries, return_index=True, return_counts=True)
        for q, a, n in zip(touched.tolist(), first.tolist(), count.tolist(), strict=True):
            s, i, r = (np.concatenate((mine[q], new[a : a + n])) for mine, new in ((self.score, scores), (self.id, ids), (self.row, rows)))
            keep = np.lexsort((r, i, ~s, r < 0))[:k]  # ~s falls as s rises, without overflow
            self.score[q], self.id[q], self.row[q] = s[keep], i[keep], r[keep]


class _Pack:
    """Vectors as arrays, rotated."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, vectors: np.ndarray, turned: np.ndarray, front: int) -> None:
        self.ids, self.rows, self.vectors = ids, rows, vectors
        near = vectors.astype(float) @ turned
        self.near, self.rest = near[:, :front], np.sqrt((near[:, front:] ** 2).sum(axis=1))
        self.lengths = np.sqrt((vectors.astype(float) ** 2).sum(axis=1))


def _walk(best: _Best, q: _Pack, c: _Pack) -> None:
    """Enter the candidates ``c``, long to short, into the best of the queries ``q``."""
    step = max(64, CELLS // max(1, len(q.ids)))
    for low in range(0, len(c.ids), step):
        part = slice(low, low + step)
        bar, longest = best.bar(), c.lengths[part].max()
        live = np.flatnonzero(q.lengths * longest * (1 + 1e-9) + 1 >= bar)
        if not len(live):
            continue
        bound = q.near[live] @ c.near[part].T + q.rest[live, None] * c.rest[None, part]
        slack = 1 + 1e-9 * q.lengths[live, None] * longest
        a, b = np.nonzero(bound + slack >= bar[live, None])
        whose, b = live[a], b + low
        other = c.rows[b] != q.rows[whose]
        whose, b = whose[other], b[other]
        if not len(whose):
            continue
        if len(whose) * 8 > len(live) * step:
            exact = _products(q.vectors[live], c.vectors[part])[np.searchsorted(live, whose), b - low]
        else:
            exact = np.concatenate([np.einsum("ij,ij->i", q.vectors[whose[x : x + 65536]], c.vectors[b[x : x + 65536]]) for x in range(0, len(whose), 65536)])
        enter = exact >= bar[whose]
        best.add(whose[enter], exact[enter], c.ids[b[enter]], c.rows[b[enter]])


def search(vectors: DataFrame, queries: Column, k: int = 10, vec_id: str = "vec_id", vector: str = "embedding", scale: int = 1024) -> DataFrame:
    """(query_id, rank, vec_id, score). ``queries``: a condition on ``vec_id``, naming the rows that are queries too."""
    spark = vectors.sparkSession
    own = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.when(usable(vector), quantised(vector, scale)).alias("vector")).dropna()
    length = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    own = own.withColumn("length", length).repartitionByRange(F.desc("length"), "vec_id").sortWithinPartitions(F.desc("length"), "vec_id")
    table = stash(own.withColumns({"row": F.monotonically_increasing_id(), "part": F.spark_partition_id()}), "vectors")
    seen = table.groupBy("part").agg(F.max("length").alias("longest"), F.max(F.size("vector")).alias("width"), F.count(F.when(queries, 1)).alias("asked")).collect()  # one row a shuffle partition
    width, n_asked = max((r["width"] for r in seen), default=0), sum(r["asked"] for r in seen)
    asked = table.filter(queries)
    if not (width and n_asked):
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    turned = rotation(table, width)
    front = max(1, width // FRONT)
    seeds = table.orderBy(F.desc("length"), "vec_id", "row").limit(SEEDS).select("row", "vector").toArrow()
    seed_rows, seed_vectors = seeds["row"].to_numpy(), _matrix(seeds["vector"].combine_chunks(), width)

    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Queries with the k-th best score that the longest vectors give them, and the least length that can enter."""
        for batch in batches:
            rows, m = batch.column(1).to_numpy(), _matrix(batch.column(2), width)
            scores = _products(m, seed_vectors)
            scores[rows[:, None] == seed_rows[None, :]] = LEAST
            floor = np.partition(scores, -k, axis=1)[:, -k] if scores.shape[1] > k else np.full(len(rows), LEAST)
            lengths = batch.column(3).to_numpy()
            # a vector shorter than floor / query length cannot enter; a floor of 0 or less rules nothing out
            able = (floor > 0) & (lengths > 0)
            reach = np.where(able, floor / np.where(able, lengths, 1.0), 0.0) * (1 - 1e-9)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(floor), pa.array(reach)], names=["vec_id", "row", "vector", "floor", "reach"])

    def packed(size: int, extra: int):  # noqa: ANN202
        """Up to ``size`` rows in one: ids, rows, the last ``extra`` columns and all components as bytes."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[pa.RecordBatch] = []

            def flush() -> pa.RecordBatch:
                t = pa.Table.from_batches(held).combine_chunks()
                bits = [t.column(j).to_numpy().tobytes() for j in (0, 1)] + [_matrix(t.column(2).combine_chunks(), width).tobytes()]
                return pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in bits + [t.column(3 + j).to_numpy().tobytes() for j in range(extra)]] + [t.column(3 + extra).slice(0, 1).combine_chunks()], names=["ids", "rows", "vectors", *["floors"] * extra, "key"])

            for batch in batches:
                for low in range(0, len(batch), size):
                    held.append(batch.slice(low, size))
                    if sum(map(len, held)) >= size:
                        yield flush()
                        held.clear()
            if held:
                yield flush()

        return run

    kinds = "ids binary, rows binary, vectors binary, "
    most = max(1, PACK_BYTES // (8 * width))
    block_size, chunk_size = min(QUERY_BLOCK, most), min(CHUNK, most)
    blocks = -(-n_asked // block_size)
    bounds = asked.select("vec_id", "row", "vector", "length").mapInArrow(bounded, "vec_id long, row long, vector array<long>, floor long, reach double")
    ordered = bounds.repartitionByRange(blocks, "reach", "row").sortWithinPartitions("reach", "row").select("vec_id", "row", "vector", "floor", "reach")
    block = stash(ordered.mapInArrow(packed(block_size, 1), kinds + "floors binary, key double").withColumnRenamed("key", "reach"), "queries")
    longest = F.array(*[F.struct(F.lit(r["part"]).alias("part"), F.lit(r["longest"]).alias("longest")) for r in seen])
    reached = F.transform(F.filter(longest, lambda r: r["longest"] >= F.col("reach")), lambda r: r["part"])
    grid = block.select(F.explode(reached).alias("part"), F.col("ids").alias("q_ids"), F.col("rows").alias("q_rows"), F.col("vectors").alias("q_vectors"), "floors")
    chunks = table.select("vec_id", "row", "vector", "part").mapInArrow(packed(chunk_size, 0), kinds + "key int").withColumnRenamed("key", "part")

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, q, now = None, None, None

        def done() -> pa.RecordBatch:
            a, b = np.nonzero(best.row >= 0)
            keep = best.score[a, b] >= best.floor[a]
            a, b = a[keep], b[keep]
            return pa.RecordBatch.from_arrays([pa.array(x) for x in (q.ids[a], q.rows[a], best.id[a, b], best.row[a, b], best.score[a, b])], names=["query_id", "query_row", "vec_id", "row", "score"])

        for batch in batches:
            for j in range(len(batch)):
                part, q_ids, q_rows, q_vectors, floors, ids, rows, own_vectors = (batch.column(c)[j].as_py() for c in range(8))
                if now != (part, q_rows):  # the chunks of a cell come one after the other; if not, the cell is done in parts
                    if q is not None:
                        yield done()
                    now, best = (part, q_rows), _Best(k, np.frombuffer(floors, dtype=np.int64))
                    q = _Pack(np.frombuffer(q_ids, dtype=np.int64), np.frombuffer(q_rows, dtype=np.int64), np.frombuffer(q_vectors, dtype=np.int64).reshape(-1, width), turned, front)
                _walk(best, q, _Pack(np.frombuffer(ids, dtype=np.int64), np.frombuffer(rows, dtype=np.int64), np.frombuffer(own_vectors, dtype=np.int64).reshape(-1, width), turned, front))
        if q is not None:
            yield done()

    with batches_of(spark, 4):  # cells are megabytes each
        met = grid.join(chunks, "part").select("part", "q_ids", "q_rows", "q_vectors", "floors", "ids", "rows", "vectors")
        found = stash(met.mapInArrow(cells, "query_id long, query_row long, vec_id long, row long, score long"), "found")
    rank = F.row_number().over(Window.partitionBy("query_id", "query_row").orderBy(F.desc("score"), "vec_id", "row"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
