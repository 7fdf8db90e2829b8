"""Approximate nearest neighbours by inner product over an inverted multi-index.

Vectors are cut into halves and each half is quantised by its own codebook, fitted on a bounded,
documented sample; every row is entered in the cell of its pair of centroids. A query visits cells in
the order of the summed inner products of its halves with the centroids, by a heap over the two
sorted centroid lists, and reranks the entries of the visited cells by the exact inner product.

How many cells it visits follows from the index, not from a fixed number: with each cell's size and
each centroid's residual spread, the expected number of entries above a score is a sum of normal
tails. The score above which k entries are expected is solved for, and cells are visited until they
hold the asked share of these k. The share is held at any number of rows.

Entries are grouped by first centroid in chunks of bounded size and queries in blocks of bounded size;
each pair of chunk and block that shares a cell is one matrix product, of which each query keeps its k
best. Very frequent vectors fill chunks like any others; no cell or list is cut short.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.sampling import hashed_share
from plumbline.llm.ship import ship

SAMPLE = 10_000
SHARE = 0.97
CHUNK_ENTRIES = 8192
BLOCK_QUERIES = 2048
ROUNDS = 12


def _upper_tail(z: np.ndarray) -> np.ndarray:
    """Of the standard normal distribution, by a rational approximation with an error below 1e-7."""
    t = 1 / (1 + 0.2316419 * np.abs(z))
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    tail = poly * np.exp(-z * z / 2) / np.sqrt(2 * np.pi)
    return np.where(z >= 0, tail, 1 - tail)


def _nearest(rows: np.ndarray, book: np.ndarray) -> np.ndarray:
    return np.argmax(rows @ book.T - (book**2).sum(1) / 2, axis=1)


def codebook(rows: np.ndarray, k: int) -> np.ndarray:
    """k-means, begun from distinct rows of a fixed shuffle; centroids without rows stay where they were."""
    distinct = np.unique(rows, axis=0)
    book = distinct[np.random.Generator(np.random.PCG64(6)).permutation(len(distinct))[:k]].copy()
    for _ in range(ROUNDS):
        at = _nearest(rows, book)
        sums = np.zeros_like(book)
        np.add.at(sums, at, rows)
        count = np.bincount(at, minlength=len(book))
        book[count > 0] = sums[count > 0] / count[count > 0, None]
    return book


@dataclass
class Index:
    """Codebooks of both halves, cell sizes, and the mean squared residual of each centroid's rows."""

    half: int
    first: np.ndarray
    second: np.ndarray
    size: np.ndarray | None = None
    spread: tuple[np.ndarray, np.ndarray] | None = None

    def cells(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return _nearest(rows[:, : self.half], self.first), _nearest(rows[:, self.half :], self.second)

    def visited(self, query: np.ndarray, k: int, share: float, own: int = 0) -> list[tuple[int, int]]:
        """Cells by falling summed score, until they are expected to hold ``share`` of the k best and hold k.

        ``own`` rows, the query's and others of its id, are no neighbours. They may stand in any cell, so
        ``own`` more entries are asked for, both of the k best and of those held."""
        a, b = self.first @ query[: self.half], self.second @ query[self.half :]
        score = a[:, None] + b[None, :]
        d1, d2 = self.half, len(query) - self.half
        n1, n2 = (query[: self.half] ** 2).sum(), (query[self.half :] ** 2).sum()
        deviation = np.sqrt(n1 * self.spread[0][:, None] / d1 + n2 * self.spread[1][None, :] / max(d2, 1)) + 1e-12
        low, high = float((score - 9 * deviation).min()), float((score + 9 * deviation).max())
        total = self.size.sum()
        want = min(k + own, total)
        for _ in range(40):
            middle = (low + high) / 2
            if (self.size * _upper_tail((middle - score) / deviation)).sum() > want:
                low = middle
            else:
                high = middle
        expected = self.size * _upper_tail((low - score) / deviation)
        enough, held, entries = share * expected.sum(), 0.0, 0
        order1, order2 = np.argsort(-a, kind="stable"), np.argsort(-b, kind="stable")
        heap, seen, out = [(-(a[order1[0]] + b[order2[0]]), 0, 0)], {(0, 0)}, []
        while heap and (held < enough or entries < want or total <= k + own):
            _, i, j = heapq.heappop(heap)
            cell = int(order1[i]), int(order2[j])
            if self.size[cell]:
                out.append(cell)
                held += expected[cell]
                entries += self.size[cell]
            for i2, j2 in ((i + 1, j), (i, j + 1)):
                if i2 < len(a) and j2 < len(b) and (i2, j2) not in seen:
                    seen.add((i2, j2))
                    heapq.heappush(heap, (-(a[order1[i2]] + b[order2[j2]]), i2, j2))
        return out


def usable(vectors: DataFrame, length: int | None = None) -> DataFrame:
    """(vec_id, v): vectors as doubles, without null ids, null, empty, zero or non-finite ones, or of another length."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where("vec_id is not null and v is not null and size(v) > 0")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where(finite & F.exists("v", lambda x: x != 0))
    return rows if length is None else rows.where(F.size("v") == length)


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def built(rows: DataFrame, length: int, sample: int = SAMPLE) -> Index:
    """Codebooks from at most ``sample`` rows (those with the smallest hash of their id); sizes and spreads from all."""
    some = hashed_share(rows, "vec_id", sample).orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(sample).toPandas()
    if some.empty:  # a few rows of one hash class
        some = rows.orderBy("vec_id", "v").limit(sample).toPandas()
    data = np.stack(some["v"].to_list())
    count = rows.count()
    k = int(np.clip(2 ** np.round(np.log2(2 * max(count, 1) ** 0.25)), 1, 256))
    k = min(k, len(data))
    half = max(length // 2, 1)
    index = Index(half, codebook(data[:, :half], k), codebook(data[:, half:], k))
    k1, k2 = len(index.first), len(index.second)

    def measure(batches):
        for batch in batches:
            m = _matrix(batch.column("v"))
            i, j = index.cells(m)
            r1, r2 = ((m[:, :half] - index.first[i]) ** 2).sum(1), ((m[:, half:] - index.second[j]) ** 2).sum(1)
            cell, inverse = np.unique(i * k2 + j, return_inverse=True)
            sums = [np.bincount(inverse, w, len(cell)) for w in (None, r1, r2)]
            yield pa.RecordBatch.from_pydict({"cell": cell.astype(np.int64), "n": sums[0].astype(np.int64), "r1": sums[1].astype(float), "r2": sums[2].astype(float)})

    found = rows.mapInArrow(measure, "cell long, n long, r1 double, r2 double").groupBy("cell").agg(F.sum("n").alias("n"), F.sum("r1").alias("r1"), F.sum("r2").alias("r2")).collect()
    table = np.zeros((3, k1 * k2))
    for r in found:  # at most k * k rows
        table[:, r.cell] = r.n, r.r1, r.r2
    size, r1, r2 = table.reshape(3, k1, k2)
    index.size = size.astype(np.int64)
    index.spread = r1.sum(1) / np.maximum(size.sum(1), 1), r2.sum(0) / np.maximum(size.sum(0), 1)
    return index


def nearest(vectors: DataFrame, is_query: F.Column, k: int = 20, share: float = SHARE) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found for each row that ``is_query`` (of vec_id) selects.

    Candidates are all rows but those with the query's own id; fewer than k are returned only if there
    are fewer. Ties go to the smaller vec_id. Vectors that are null, zero, empty or hold null or
    non-finite components take no part, nor do those of another length than the most frequent one.
    Repeated rows of an id count once as a query and once each as candidates; other columns are ignored.
    """
    spark = vectors.sparkSession
    ship(spark)
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    lengths = usable(vectors).groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if lengths is None:
        return empty
    rows = usable(vectors, lengths.n)
    index = built(rows, lengths.n)
    shared = spark.sparkContext.broadcast(index)
    chunks_of = np.maximum(-(-index.size.sum(1) // CHUNK_ENTRIES), 1)
    queries = rows.where(is_query).groupBy("vec_id").agg(F.any_value("v").alias("v"), F.count("*").alias("own"))
    blocks = max(1, -(-queries.count() // BLOCK_QUERIES))

    def enter(batches):
        for batch in batches:
            i, j = shared.value.cells(_matrix(batch.column("v")))
            ids = batch.column("vec_id").to_numpy()
            chunk = ((ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) % chunks_of[i]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(chunk.astype(np.int32))], names=["vec_id", "v", "i", "j", "chunk"])

    def visit(batches):
        for batch in batches:
            ids, m, own = batch.column("vec_id").to_pylist(), _matrix(batch.column("v")), batch.column("own").to_pylist()
            for lo in range(0, len(ids), 200):
                out = []
                for r in range(lo, min(lo + 200, len(ids))):
                    lists: dict[int, list[int]] = {}
                    for i, j in shared.value.visited(m[r], k, share, own[r]):
                        lists.setdefault(i, []).append(j)
                    out += [(ids[r], m[r], i, js, c) for i, js in lists.items() for c in range(int(chunks_of[i]))]
                columns = list(zip(*out)) or [[]] * 5
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x, t) for x, t in zip(columns, (pa.int64(), pa.list_(pa.float64()), pa.int32(), pa.list_(pa.int32()), pa.int32()))],
                    names=["query_id", "q", "i", "js", "chunk"],
                )

    entries = rows.mapInArrow(enter, "vec_id long, v array<double>, i int, j int, chunk int")
    entries = entries.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    asked = queries.repartition(F.col("vec_id")).mapInArrow(visit, "query_id long, q array<double>, i int, js array<int>, chunk int")
    asked = asked.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int"))

    def rerank(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if len(left) and len(right):
            v, ids, j = _matrix(left["v"]), left["vec_id"].to_numpy(), left["j"].to_numpy()
            q, names, lists = _matrix(right["q"]), right["query_id"].to_pylist(), right["js"].to_pylist()
            for lo in range(0, len(names), 256):
                near = q[lo : lo + 256] @ v.T
                for r, name in enumerate(names[lo : lo + 256]):
                    open_cells = np.zeros(len(index.second), bool)
                    open_cells[lists[lo + r]] = True
                    at = np.flatnonzero(open_cells[j] & (ids != name))
                    s = near[r, at]
                    if len(at) > k:  # all that may be among the k best, whatever the order of summation
                        at = at[s >= np.partition(s, -k)[-k] - 1e-9 * (1 + abs(s).max())]
                    exact = (v[at] * q[lo + r]).sum(1)
                    best = np.lexsort((ids[at], -exact))[:k]
                    out += zip([name] * len(best), ids[at[best]].tolist(), exact[best].tolist())
        columns = list(zip(*out)) or [[]] * 3
        return pa.Table.from_arrays([pa.array(x, t) for x, t in zip(columns, (pa.int64(), pa.int64(), pa.float64()))], names=["query_id", "vec_id", "score"])

    keys = ["i", "chunk", "block"]
    found = entries.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(rerank, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
