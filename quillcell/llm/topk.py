"""Top-k search in tiles: a block of queries against a shard of rows, then a tree of merges.

A tile is one matrix product of bounded size with a partial selection per query. Its lists
travel packed, one row per tile, and are merged sixteen shards at a time until one list per
query is left. Blocks and shards are hash parts of unique ids, so none is larger than the
others.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHARD = 8192
BLOCK = 1024
_FAN = 16
_STRIP = 128
_LISTS = "block long, shard long, query_id array<long>, length array<int>, vec_id array<long>, score array<double>"


def vectors(table: DataFrame, vec: str = "embedding", zero: bool = True) -> DataFrame:
    """``vec_id, v``: one row per id, components as doubles.

    Vectors that are null or empty or hold a null or non-finite component take no part, and
    those of zeros only if ``zero``. Nor do rows without ``vec_id``, and vectors of another
    length than most, with which no inner product exists. An id that comes several times
    stands for its smallest vector.
    """
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), F.col(vec).cast("array<double>").alias("v")).filter(
        F.col("vec_id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0)).filter(finite)
    if not zero:
        rows = rows.filter(F.exists("v", lambda x: x != 0))
    common = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).agg(F.max(F.struct("n", "d"))["d"].alias("d")).scalar()
    return rows.filter(F.size("v") == common).groupBy("vec_id").agg(F.min("v").alias("v"))


def parts(rows: int, size: int) -> int:
    return max(1, math.ceil(rows / size))


def matrix(column: pa.ChunkedArray, dtype=np.float64) -> np.ndarray:
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    return flat.astype(dtype).reshape(len(lists), -1)


def _exact_product(q: np.ndarray, e: np.ndarray) -> np.ndarray:
    """The inner products of integers held as doubles, exact or cut to the range of a long."""
    reach = float(np.abs(q).max(initial=0)) * float(np.abs(e).max(initial=0)) * q.shape[1]
    if reach < 2**53:
        return q @ e.T
    whole = np.array([[int(x) for x in row] for row in q], dtype=object) @ np.array([[int(x) for x in row] for row in e], dtype=object).T
    return np.clip(whole, -(2**63), 2**63 - 1)


def best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Positions of the ``k`` highest scores, ties to the smaller id."""
    if len(ids) > k:
        cut = np.partition(scores, len(scores) - k)[len(scores) - k]
        keep = np.flatnonzero(scores >= cut)
    else:
        keep = np.arange(len(ids))
    return keep[np.lexsort((ids[keep], -scores[keep]))][:k]


def tile_lists(q_ids: np.ndarray, q: np.ndarray, e_ids: np.ndarray, e: np.ndarray, k: int, integer: bool,
               allowed: np.ndarray | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each query its ``k`` best rows of the shard, or of those ``allowed`` to it, and their scores.

    Products of doubles are only a first look: all rows that rounding could lift over the
    limit are scored again, each as its own sum, so equal vectors have equal scores.
    """
    out = []
    slack = 0.0 if integer else 1e-13 * q.shape[1] * float(np.linalg.norm(e, axis=1).max(initial=0))
    for at in range(0, len(q), _STRIP):
        part = q[at : at + _STRIP]
        product = _exact_product(part, e) if integer else part @ e.T
        for i, row in enumerate(product):
            mine = e_ids != q_ids[at + i]
            if allowed is not None:
                mine &= allowed[at + i]
            mine = np.flatnonzero(mine)
            ids, scores = e_ids[mine], row[mine]
            if integer:
                top = best(ids, scores, k)
                out.append((ids[top], scores[top]))
                continue
            if len(ids) > k:
                near = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k] - slack * np.linalg.norm(part[i]))
            else:
                near = np.arange(len(ids))
            exact = (e[mine[near]] * part[i]).sum(axis=1)
            top = best(ids[near], exact, k)
            out.append((ids[near][top], exact[top]))
    return out


def lists_table(block: int, shard: int, q_ids: np.ndarray, lists: list[tuple[np.ndarray, np.ndarray]]) -> pa.Table:
    """One packed row of :data:`_LISTS`."""
    none = np.zeros(0)
    return pa.table({
        "block": pa.array([block], pa.int64()), "shard": pa.array([shard], pa.int64()),
        "query_id": pa.array([q_ids], pa.list_(pa.int64())),
        "length": pa.array([[len(x) for x, _ in lists]], pa.list_(pa.int32())),
        "vec_id": pa.array([np.concatenate([none.astype(np.int64), *(x for x, _ in lists)])], pa.list_(pa.int64())),
        "score": pa.array([np.concatenate([none, *(np.asarray(s, dtype=np.float64) for _, s in lists)])], pa.list_(pa.float64())),
    })


def merge_tree(lists: DataFrame, shards: int, k: int) -> DataFrame:
    """The lists of each block merged over all shards, at most sixteen rows to a task's group."""

    def merge(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        ids, vecs, scores = ([], [], [])
        for row in table.to_batches():
            for i in range(row.num_rows):
                n = row.column("length")[i].values.to_numpy(zero_copy_only=False)
                ids.append(np.repeat(row.column("query_id")[i].values.to_numpy(zero_copy_only=False), n))
                vecs.append(row.column("vec_id")[i].values.to_numpy(zero_copy_only=False))
                scores.append(row.column("score")[i].values.to_numpy(zero_copy_only=False))
        ids, vecs, scores = np.concatenate(ids), np.concatenate(vecs), np.concatenate(scores)
        order = np.lexsort((vecs, -scores, ids))
        ids, vecs, scores = ids[order], vecs[order], scores[order]
        queries, first, count = np.unique(ids, return_index=True, return_counts=True)
        kept = [(vecs[f : f + min(c, k)], scores[f : f + min(c, k)]) for f, c in zip(first, count)]
        return lists_table(key[0].as_py(), key[1].as_py(), queries, kept)

    while shards > 1:
        shards = parts(shards, _FAN)
        lists = lists.withColumn("shard", F.floor(F.col("shard") / _FAN).cast("long")).groupBy("block", "shard").applyInArrow(merge, _LISTS)
    return lists


def ranked(lists: DataFrame, score: str) -> DataFrame:
    """``query_id, rank, vec_id, score`` of merged lists."""

    def unpack(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                n = batch.column("length")[i].values.to_numpy(zero_copy_only=False)
                rank = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(batch.column("query_id")[i].values.to_numpy(zero_copy_only=False), n)),
                     pa.array(rank.astype(np.int32)), batch.column("vec_id")[i].values, batch.column("score")[i].values],
                    ["query_id", "rank", "vec_id", "score"])

    rows = lists.mapInArrow(unpack, "query_id long, rank int, vec_id long, score double")
    return rows.withColumn("score", F.col("score").cast(score))


def tiles(queries: DataFrame, entries: DataFrame, key: list[str], run: Callable[[tuple, pa.Table, pa.Table], pa.Table]) -> DataFrame:
    return queries.groupBy(*key).cogroup(entries.groupBy(*key)).applyInArrow(run, _LISTS)


def exact_top_k(queries: DataFrame, entries: DataFrame, k: int, integer: bool = False) -> DataFrame:
    """``query_id, rank, vec_id, score``: each query's ``k`` highest inner products, its own id left out.

    Both tables are ``vec_id, v`` with one row per id. ``integer`` says that all components
    are whole numbers; scores are then exact. Ties go to the smaller id; a query with fewer
    than ``k`` candidates gets them all; without entries there are no rows.
    """
    shards, blocks = parts(entries.count(), SHARD), parts(queries.count(), BLOCK)
    spread = F.xxhash64("vec_id")
    packed = F.collect_list(F.struct("vec_id", "v")).alias("rows")
    q = queries.groupBy(F.pmod(spread, F.lit(blocks)).alias("block")).agg(packed).withColumn(
        "shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))))
    e = entries.groupBy(F.pmod(spread, F.lit(shards)).alias("shard")).agg(packed).withColumn(
        "block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))

    def run(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        block, shard = key[0].as_py(), key[1].as_py()
        if not left.num_rows or not right.num_rows:
            return lists_table(block, shard, np.zeros(0, dtype=np.int64), [])
        a, b = (t.column("rows").combine_chunks().flatten() for t in (left, right))
        ids = a.field("vec_id").to_numpy(zero_copy_only=False)
        lists = tile_lists(ids, matrix(a.field("v")), b.field("vec_id").to_numpy(zero_copy_only=False), matrix(b.field("v")), k, integer)
        return lists_table(block, shard, ids, lists)

    return ranked(merge_tree(tiles(q, e, ["block", "shard"], run), shards, k), "long" if integer else "double")
