"""Approximate search with an inverted multi-index.

Both halves of the vectors get their own codebook, fitted by k-means on at most
:data:`SAMPLE` rows; a row lies in the cell of its two nearest centroids, and every row is
indexed. A query walks the pairs of centroids by summed distance with a heap. Distance is
the negative inner product, so the sum over the halves is the score of the cell's centre.

How far it walks follows from the data, not from a cap: the spread of a cell around its
centre tells how many of its rows should score above any level, the level that ``k`` rows
of the whole index should exceed is found by bisection, and the walk ends once the cells
seen should hold ``recall`` of those rows. All rows of the seen cells are scored again with
their full vectors.

Rows are stored by first centroid, in shards of bounded size whatever a cell holds; a query
goes to the shards in which it looks at a cell, and there sees the rows of these cells only.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillcell.llm.topk import BLOCK, SHARD, lists_table, matrix, merge_tree, parts, ranked, tile_lists, tiles
from quillcell.session import cut_lineage

#: Rows that the codebooks are fitted on, those of the smallest hashes.
SAMPLE = 8192


def codebook(x: np.ndarray, size: int, rounds: int = 12) -> np.ndarray:
    """Centroids of k-means with the farthest rows in place of empty cells."""
    centers = x[np.linspace(0, len(x) - 1, min(size, len(x))).astype(int)].copy()
    for _ in range(rounds):
        far = (x * x).sum(axis=1)[:, None] - 2 * x @ centers.T + (centers * centers).sum(axis=1)
        cell = far.argmin(axis=1)
        count = np.bincount(cell, minlength=len(centers))
        total = np.zeros_like(centers)
        np.add.at(total, cell, x)
        filled = count > 0
        centers[filled] = total[filled] / count[filled, None]
        empty = np.flatnonzero(~filled)
        centers[empty] = x[np.argsort(-far.min(axis=1), kind="stable")[: len(empty)]]
    return centers


def nearest(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    return ((centers * centers).sum(axis=1) - 2 * x @ centers.T).argmin(axis=1)


def tail(z: np.ndarray) -> np.ndarray:
    """The upper tail of the normal distribution, to a relative error of about 1e-7."""
    x = np.abs(z) / np.sqrt(2.0)
    t = 1.0 / (1.0 + 0.5 * x)
    series = 0.17087277
    for c in (-0.82215223, 1.48851587, -1.13520398, 0.27886807, -0.18628806, 0.09678418, 0.37409196, 1.00002368, -1.26551223):
        series = c + t * series
    upper = 0.5 * t * np.exp(-x * x + series)
    return np.where(z >= 0, upper, 1.0 - upper)


class MultiIndex:
    """Codebooks, the spread around their centroids and the rows of each cell."""

    def __init__(self, sample: np.ndarray, size: int) -> None:
        self.half = (sample.shape[1] + 1) // 2
        self.books, self.spread = [], []
        for x in self.halves(sample):
            book = codebook(x, size) if x.shape[1] else np.zeros((1, 0))
            cell = nearest(x, book)
            off = ((x - book[cell]) ** 2).sum(axis=1)
            count = np.bincount(cell, minlength=len(book))
            per = np.bincount(cell, weights=off, minlength=len(book)) / np.maximum(count, 1)
            # a centroid with few rows of the sample borrows the spread of all
            self.books.append(book)
            self.spread.append((per * count + off.mean() * 4) / (count + 4) / max(1, x.shape[1]))
        self.counts = np.zeros((len(self.books[0]), len(self.books[1])), dtype=np.int64)

    def halves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return x[:, : self.half], x[:, self.half :]

    def cells(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        a, b = self.halves(x)
        return nearest(a, self.books[0]), nearest(b, self.books[1])

    def expected(self, q: np.ndarray, k: int) -> np.ndarray:
        """How many of the query's ``k`` best rows each cell should hold."""
        a, b = self.halves(q[None])
        center = (a @ self.books[0].T).T + b @ self.books[1].T
        width = np.sqrt((a * a).sum() * self.spread[0][:, None] + (b * b).sum() * self.spread[1][None]) + 1e-12
        low, high = float((center - 9 * width).min()), float((center + 9 * width).max())
        wanted = min(k, int(self.counts.sum()))
        for _ in range(24):
            level = (low + high) / 2
            if (self.counts * tail((level - center) / width)).sum() > wanted:
                low = level
            else:
                high = level
        return self.counts * tail((low - center) / width)

    def walk(self, q: np.ndarray, k: int, recall: float) -> np.ndarray:
        """The cells a query looks at, as a boolean table."""
        a, b = self.halves(q[None])
        far = [-(a @ self.books[0].T)[0], -(b @ self.books[1].T)[0]]
        order = [np.argsort(f, kind="stable") for f in far]
        d1, d2 = (f[o].tolist() for f, o in zip(far, order))
        gain = self.expected(q, k)[np.ix_(order[0], order[1])]
        rows = self.counts[np.ix_(order[0], order[1])].tolist()
        goal, held, got, gain = recall * gain.sum(), 0.0, 0, gain.tolist()
        need = min(int(self.counts.sum()), 5 * k)
        seen = np.zeros(self.counts.shape, dtype=bool)
        reached = [-1] * len(d1)
        heap = [(d1[0] + d2[0], 0, 0)]
        while heap and (held < goal or got < need):
            _, i, j = heapq.heappop(heap)
            reached[i] = j
            if rows[i][j]:
                seen[order[0][i], order[1][j]] = True
                held += gain[i][j]
                got += rows[i][j]
            if i + 1 < len(d1) and reached[i + 1] == j - 1:
                heapq.heappush(heap, (d1[i + 1] + d2[j], i + 1, j))
            if j + 1 < len(d2) and (i == 0 or reached[i - 1] > j):
                heapq.heappush(heap, (d1[i] + d2[j + 1], i, j + 1))
        return seen


def multi_index_search(queries: DataFrame, entries: DataFrame, k: int, recall: float = 0.98, sample: int = SAMPLE) -> DataFrame:
    """``query_id, rank, vec_id, score``: up to ``k`` rows of large inner product per query, its own id left out.

    Both tables are ``vec_id, v`` with one row per id and one length of vector. Ties go to
    the smaller id. Without entries or queries there are no rows. The codebooks have
    ``4 * n ** 0.25`` centroids a half, 256 at most; cell counts, at most 65 536 numbers,
    are all that the driver holds besides the sample.
    """
    entries = cut_lineage(entries)
    n, wanted = entries.count(), queries.count()
    spark = entries.sparkSession
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if not n or not wanted:
        return empty
    rows = entries.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).toArrow()
    index = MultiIndex(matrix(rows.column("v")), int(min(256, max(8, round(4 * n**0.25)))))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                a, b = index.cells(matrix(batch.column("v")))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("vec_id"), batch.column("v"), pa.array(a.astype(np.int64)), pa.array(b.astype(np.int32))],
                    ["vec_id", "v", "a", "b"])

    placed = cut_lineage(entries.mapInArrow(place, "vec_id long, v array<double>, a long, b int"))
    for r in placed.groupBy("a", "b").agg(F.count("*").alias("n")).collect():
        index.counts[r.a, r.b] = r.n
    salts = np.array([parts(int(c), SHARD) for c in index.counts.sum(axis=1)])
    first, shards, blocks = np.cumsum(salts) - salts, int(salts.sum()), parts(wanted, BLOCK)

    def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, x = batch.column("vec_id").to_numpy(), matrix(batch.column("v")) if batch.num_rows else np.zeros((0, 1))
            for at, q in enumerate(x):
                seen = index.walk(q, k + 1, recall)
                where = np.flatnonzero(seen.any(axis=1))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(where), ids[at])), pa.array([q] * len(where), pa.list_(pa.float64())), pa.array(where),
                     pa.array([np.packbits(seen[i]).tobytes() for i in where], pa.binary())], ["vec_id", "v", "a", "seen"])

    spread = F.xxhash64("vec_id")
    salt_of = F.element_at(F.lit(salts.tolist()).cast("array<long>"), (F.col("a") + 1).cast("int"))
    shard_of = F.element_at(F.lit(first.tolist()).cast("array<long>"), (F.col("a") + 1).cast("int"))
    q = (
        queries.mapInArrow(visits, "vec_id long, v array<double>, a long, seen binary")
        .groupBy("a", F.pmod(spread, F.lit(blocks)).alias("block")).agg(F.collect_list(F.struct("vec_id", "v", "seen")).alias("rows"))
        .select("block", "rows", F.explode(F.sequence(shard_of, shard_of + salt_of - 1)).alias("shard"))
    )
    e = (
        placed.groupBy((shard_of + F.pmod(spread, salt_of)).alias("shard")).agg(F.collect_list(F.struct("b", "vec_id", "v")).alias("rows"))
        .withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    )

    def run(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        block, shard = key[0].as_py(), key[1].as_py()
        if not left.num_rows or not right.num_rows:
            return lists_table(block, shard, np.zeros(0, dtype=np.int64), [])
        x, y = (t.column("rows").combine_chunks().flatten() for t in (left, right))
        ids, vecs = x.field("vec_id").to_numpy(zero_copy_only=False), matrix(x.field("v"))
        seen = np.array([np.unpackbits(np.frombuffer(s, dtype=np.uint8)) for s in x.field("seen").to_pylist()], dtype=bool)
        e_ids, e, b = y.field("vec_id").to_numpy(zero_copy_only=False), matrix(y.field("v")), y.field("b").to_numpy(zero_copy_only=False)
        lists = tile_lists(ids, vecs, e_ids, e, k, False, seen[:, b])
        return lists_table(block, shard, ids, lists)

    return ranked(merge_tree(tiles(q, e, ["block", "shard"], run), shards, k), "double")
