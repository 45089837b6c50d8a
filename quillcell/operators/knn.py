"""Exact k-nearest neighbours over a two-level tree of balls.

After the ball tree and Lu et al. 2012 (k-nearest-neighbour joins on MapReduce), in four Spark
steps: points go to the nearest top ball and in it to the nearest leaf; leaves next to each other
share a bin, and each point gets an upper bound of its k-th distance from its own bin; it is sent once to
each other bin with a leaf whose ball and half-space can hold something closer, looking into a top ball
only if that can; each visited bin returns its k best within the bound, as one list, and lists are merged by point.
Where many neighbours are asked for, the bins first count what they hold, which tightens the bounds.

The number of leaves grows with the square root of the number of points and that of top balls
with the square root of the leaves, so a point meets some fourth root of all at each level; the
tree that every task gets has a centre per leaf. Vectors travel once per bin, not per leaf.

Copies of one vector are one point with a short id list, so a large group of copies costs
one row. Large leaves are cut into bins of bounded size, and the visitors of a
bin into chunks of bounded size, so no task sees an unbounded group.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillcell.session import cut_lineage, written

#: Smallest and largest rows of a bin, the bins that many points make, and a chunk of visitors in bins' rows.
BLOCK, LARGEST, BINS, CHUNK = 4096, 65_536, 32, 4
#: From so many neighbours on the bounds are tightened, with so many levels.
MANY, LEVELS = 64, 16
#: Most tasks of a search; each may have several tiles.
TASKS = 2048
_PAIRS = 1 << 21
_NEAR = pa.list_(pa.struct([("dist", pa.float64()), ("dst", pa.string())]))
_SLACK = 1e-9


def distinct_points(points: DataFrame, k: int) -> DataFrame:
    """``vid, features, ids``: distinct vectors with their ``k + 1`` smallest ids.

    Spark applies the row limit of the window before the shuffle, so copies do not pile up.
    """
    w = Window.partitionBy("features").orderBy("cell")
    few = points.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= k + 1)
    return few.groupBy("features").agg(F.sort_array(F.collect_list("cell")).alias("ids")).select(
        F.col("ids")[0].alias("vid"), "features", "ids"
    )


def _vectors(column: pa.ChunkedArray) -> np.ndarray:
    """A column of lists of equal length as a matrix."""
    lists = column.combine_chunks()
    return lists.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(lists), -1) if len(lists) else np.zeros((0, 1))


def _close(q: np.ndarray, s: np.ndarray, need: int, bound: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """Row range of ``q``, then row, candidate and exact distance of the pairs within the row's bound.

    A row without a bound gets all that are no farther than its ``need``-th candidate.
    """
    squares, length = (s * s).sum(1), (q * q).sum(1)
    slack = 1e-9 * (length + squares.max(initial=0.0) + 1.0)
    step = max(1, _PAIRS // max(1, len(s)))
    for lo in range(0, len(q) if len(s) else 0, step):
        hi = min(len(q), lo + step)
        part, most = q[lo:hi], bound[lo:hi]
        rough = part @ (-2.0 * s.T)
        rough += squares[None, :]
        limit = most * most - length[lo:hi]
        free = np.flatnonzero(np.isinf(most))
        if len(free) and need < len(s):
            limit[free] = np.partition(rough[free], need - 1, axis=1)[:, need - 1]
        row, at = np.nonzero(rough <= (limit + slack[lo:hi])[:, None])
        diff = s[at] - part[row]
        far = np.sqrt((diff * diff).sum(1))
        inside = far <= most[row]
        yield lo, hi, row[inside], at[inside], far[inside]


def _nearest(q: np.ndarray, targets: pa.Table, need: int, bound: np.ndarray) -> pa.ListArray:
    """For each row of ``q`` the ``need`` smallest (distance, id) within its bound, id lists expanded."""
    s, ids = _vectors(targets.column("features")), targets.column("ids").combine_chunks()
    names = ids.flatten()
    size = ids.value_lengths().to_numpy(zero_copy_only=False)
    first = np.concatenate([[0], np.cumsum(size)])[:-1].astype(int)
    place = np.empty(len(names), int)
    place[pc.sort_indices(names).to_numpy()] = np.arange(len(names))
    counts, fars, found = np.zeros(len(q), int), [np.zeros(0)], [np.zeros(0, int)]
    for lo, hi, row, at, far in _close(q, s, need, bound):
        copies = size[at]
        if (copies > 1).any():
            start = np.cumsum(copies) - copies
            of = np.repeat(first[at] - start, copies) + np.arange(copies.sum())
            row, far = np.repeat(row, copies), np.repeat(far, copies)
        else:
            of = first[at]
        order = np.lexsort((place[of], far, row))
        row, far, of = row[order], far[order], of[order]
        keep = np.arange(len(row)) - np.searchsorted(row, row) < need
        counts[lo:hi] = np.bincount(row[keep], minlength=hi - lo)
        fars.append(far[keep])
        found.append(of[keep])
    pairs = pa.StructArray.from_arrays([pa.array(np.concatenate(fars)), names.take(pa.array(np.concatenate(found)))], ["dist", "dst"])
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pairs)


def _gaps(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of all rows of ``a`` to all rows of ``b``."""
    return np.sqrt(np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2.0 * (a @ b.T), 0.0))


class BallTree:
    """Centres of top balls and of their leaves; ``measure`` adds what the points in them span.

    A point lies in the top ball of the nearest centre, and in the leaf of the nearest centre of that ball.
    """

    def __init__(self, centres: np.ndarray):
        self.tops = centres[: max(1, math.isqrt(len(centres)))]
        home = _gaps(centres, self.tops).argmin(axis=1) if len(centres) else np.zeros(0, int)
        order = np.argsort(home, kind="stable")
        self.leaves = centres[order]
        self.ends = np.searchsorted(home[order], np.arange(len(self.tops) + 1))

    def place(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each row its leaf, and its distances to the leaf's and to the top ball's centre."""
        far = _gaps(v, self.tops)
        top = far.argmin(axis=1)
        leaf, r = np.zeros(len(v), int), np.zeros(len(v))
        for t in np.unique(top):
            at = np.flatnonzero(top == t)
            d = _gaps(v[at], self.leaves[self.ends[t] : self.ends[t + 1]])
            leaf[at], r[at] = self.ends[t] + d.argmin(axis=1), d.min(axis=1)
        return leaf, r, far[np.arange(len(v)), top]

    def measure(self, rows) -> None:
        """Takes the points, the radius and the reach from the top centre of each leaf."""
        self.size, self.radius = np.zeros(len(self.leaves), int), np.zeros(len(self.leaves))
        reach = np.zeros(len(self.leaves))
        for row in rows:
            self.size[row["leaf"]], self.radius[row["leaf"]], reach[row["leaf"]] = row["n"], row["radius"], row["reach"]
        self.reach = np.array([reach[a:b].max(initial=0.0) for a, b in zip(self.ends, self.ends[1:])])

    def fill_bins(self, block: int) -> list[tuple[int, int, int, int]]:
        """``leaf, n, bin, blocks``: leaves packed in order into bins of ``block`` rows; a larger leaf takes several of its own."""
        out, at, held = [], -1, block
        for leaf in np.flatnonzero(self.size):
            n = int(self.size[leaf])
            blocks = -(-n // block)
            if blocks > 1 or held + n > block:
                at, held = at + 1, 0
            out.append((int(leaf), n, at, blocks))
            at, held = at + blocks - 1, held + n if blocks == 1 else block
        self.bins = at + 1
        self.bin, self.blocks = np.zeros(len(self.leaves), int), np.zeros(len(self.leaves), int)
        for leaf, _, first, blocks in out:
            self.bin[leaf], self.blocks[leaf] = first, blocks
        return out

    def bins_of(self, leaves: np.ndarray, but: int) -> np.ndarray:
        """The bins of some leaves, without one."""
        bins = np.unique(np.concatenate([self.bin[leaves], *(self.bin[i] + np.arange(1, self.blocks[i]) for i in leaves[self.blocks[leaves] > 1])]))
        return bins[bins != but]

    @staticmethod
    def _open(d: np.ndarray, limit: np.ndarray, radius: np.ndarray, between: np.ndarray) -> np.ndarray:
        """Which balls can hold something within ``limit`` of each row.

        Members of a ball are nearer to its centre than to its siblings', so a row beyond the bisecting
        plane of a ball and the row's nearest sibling is at least its distance to the plane away.
        """
        slack = _SLACK * (1.0 + d)
        keep = d - radius[None, :] <= limit + slack
        own = d.argmin(axis=1)
        gap = between[own]
        ahead = d * d * (1.0 - 1e-11) - d[np.arange(len(d)), own][:, None] ** 2 * (1.0 + 1e-11)
        return keep & ~((gap > 1e-300) & (ahead > 2.0 * np.maximum(gap, 1e-300) * (limit + slack)))

    def visits(self, v: np.ndarray, bound: np.ndarray) -> list[np.ndarray]:
        """For each row the leaves that can hold something within its bound."""
        limit = bound[:, None]
        into = self._open(_gaps(v, self.tops), limit, self.reach, _gaps(self.tops, self.tops))
        found: list[list[np.ndarray]] = [[] for _ in v]
        for t in np.flatnonzero(into.any(axis=0)):
            lo, hi = self.ends[t], self.ends[t + 1]
            if lo == hi:
                continue
            at, leaves = np.flatnonzero(into[:, t]), self.leaves[lo:hi]
            keep = self._open(_gaps(v[at], leaves), limit[at], self.radius[lo:hi], _gaps(leaves, leaves)) & (self.size[lo:hi] > 0)[None, :]
            for i, row in zip(at, keep):
                found[i].append(lo + np.flatnonzero(row))
        return [np.concatenate(f) if f else np.zeros(0, int) for f in found]


def _homes(points: DataFrame, k: int, seed: int, block: int | None, leaves: int | None, by_leaf: bool) -> tuple[tuple[DataFrame, str], DataFrame, DataFrame, tuple[int, int]]:
    """The distinct points with leaf and bin and their path, the leaves, ``homes``, and the rows of a bin and the bins.

    ``homes`` is ``vid, features, near, bound, to``: the best in the own bin, the bound of the
    ``k + 1``-th, and the other bins (or all leaves, if ``by_leaf``) that can hold something closer.
    """
    spark = points.sparkSession
    need = k + 1  # a point finds itself (or a copy) among these
    unique = cut_lineage(distinct_points(points, k))
    n = unique.count()
    block = block or min(LARGEST, max(BLOCK, n // BINS, BINS * need))
    wanted = leaves or max(1, math.isqrt(n) // 2)
    chosen = unique.orderBy(F.xxhash64(F.lit(seed), "vid"), "vid").limit(wanted).select("features").collect()
    tree = BallTree(np.array([r["features"] for r in chosen], float).reshape(len(chosen), -1))
    bare = spark.sparkContext.broadcast(tree)

    @F.pandas_udf("struct<leaf:int,r:double,reach:double>")
    def place(v: pd.Series) -> pd.DataFrame:
        leaf, r, reach = bare.value.place(np.stack(v.to_list()).astype(float))
        return pd.DataFrame({"leaf": leaf.astype("int32"), "r": r, "reach": reach})

    placed = cut_lineage(unique.withColumn("_p", place("features")).select("vid", "features", "ids", "_p.leaf", "_p.r", "_p.reach"))
    rows = placed.groupBy("leaf").agg(F.count("*").alias("n"), F.max("r").alias("radius"), F.max("reach").alias("reach")).collect()
    tree.measure(rows)
    table = tree.fill_bins(block)
    full = spark.sparkContext.broadcast(tree)
    table = spark.createDataFrame(table, "leaf int, n long, bin int, blocks int")
    own = (F.col("bin") + F.pmod(F.xxhash64("vid"), F.col("blocks"))).cast("int")
    placed, path = written(placed.join(F.broadcast(table), "leaf").select("vid", "features", "ids", "leaf", own.alias("bin")), "placed")

    def home(rows: pa.Table) -> pa.Table:
        v = _vectors(rows.column("features"))
        near = _nearest(v, rows, need, np.full(len(v), np.inf))
        ends, far = near.offsets.to_numpy(), near.values.field("dist").to_numpy()
        whole = np.diff(ends) == need
        bound = np.full(len(v), np.inf)
        bound[whole] = far[ends[1:][whole] - 1]
        tree, at = full.value, rows.column("bin")[0].as_py()
        to = []
        for lo in range(0, len(v), BLOCK):
            found = tree.visits(v[lo : lo + BLOCK], bound[lo : lo + BLOCK])
            to.extend(found if by_leaf else [tree.bins_of(f, at) for f in found])
        to = pa.ListArray.from_arrays(
            pa.array(np.concatenate([[0], np.cumsum([len(t) for t in to])]).astype(np.int32)), pa.array(np.concatenate(to).astype(np.int32)))
        return pa.table({"vid": rows.column("vid"), "features": rows.column("features"), "near": near, "bound": bound, "to": to})

    kind = placed.schema["features"].dataType.simpleString()
    # bins are few rows but much work, so their tasks are not joined by size
    homes = cut_lineage(placed.repartition(2 * tree.bins, "bin").groupBy("bin").applyInArrow(
        home, f"vid string, features {kind}, near array<struct<dist:double,dst:string>>, bound double, to array<int>"))
    return (placed, path), table, homes, (block, tree.bins)


def routes(points: DataFrame, k: int, seed: int = 42, block: int | None = None, leaves: int | None = None) -> tuple[tuple[DataFrame, str], DataFrame, DataFrame]:
    """The distinct points with leaf and bin and their path, the leaves, and the leaves that can hold a neighbour of each point."""
    placed, table, homes, _ = _homes(points, k, seed, block, leaves, True)
    return placed, table, homes.select("vid", F.explode("to").alias("leaf"))


def _visit(homes: DataFrame, placed: DataFrame, path: str, shape: tuple[int, int], carried: list[str], search, schema: str) -> DataFrame:
    """``search(visitors, members)`` for each bin and chunk of its visitors, which bring the columns ``carried``."""
    spark, (block, bins) = homes.sparkSession, shape
    asks = homes.select("vid", "features", "bound", *carried, F.explode("to").alias("bin"))
    chunks = asks.groupBy("bin").agg(F.ceil(F.count("*") / (CHUNK * block)).cast("int").alias("chunks"))
    parts, parts_path = written(chunks, "parts")
    # both sides of the cogroup read the tables anew, so that no column is the same on both
    again = lambda df, at: spark.read.schema(df.schema).parquet(at)
    asks = asks.join(parts, "bin").withColumn("chunk", F.pmod(F.xxhash64("vid"), F.col("chunks")).cast("int")).drop("chunks")
    members = again(placed, path).join(again(parts, parts_path), "bin").select(
        "bin", "features", "ids", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"))
    tile, tasks = ["bin", "chunk"], min(TASKS, 2 * bins * (bins // CHUNK + 1))
    asks, members = asks.repartition(tasks, *tile), members.repartition(tasks, *tile)
    return asks.groupBy(*tile).cogroup(members.groupBy(*tile)).applyInArrow(search, schema)


def _tightened(homes: DataFrame, placed: DataFrame, path: str, shape: tuple[int, int], need: int) -> DataFrame:
    """``homes`` with bounds that hold few more than ``need`` points of all bins together.

    The distances at ranks of the own bin, each a quarter above the last, are levels; the other bins count what lies within
    each, and the first level that holds ``need`` in all is the bound. So the search sends little
    more than the result, however loose the first bound was.
    """
    ranks = [max(1, math.ceil(need * BINS ** (j / (LEVELS - 1) - 1))) for j in range(LEVELS)]
    levels = homes.withColumn("levels", F.array(*[F.when(F.size("near") == need, F.col("near")[r - 1]["dist"]).otherwise(float("inf")) for r in ranks]))

    def count(left: pa.Table, right: pa.Table) -> pa.Table:
        q, level = _vectors(left.column("features")), _vectors(left.column("levels"))
        size = right.column("ids").combine_chunks().value_lengths().to_numpy(zero_copy_only=False)
        total = np.zeros((len(q), LEVELS + 1))
        bound = left.column("bound").to_numpy()
        if len(right):
            for lo, hi, row, at, far in _close(q, _vectors(right.column("features")), need, bound):
                which = np.zeros(len(row), int)
                for j in range(LEVELS):
                    which += level[lo + row, j] < far
                total[lo:hi] = np.bincount(row * (LEVELS + 1) + which, size[at], (hi - lo) * (LEVELS + 1)).reshape(hi - lo, -1)
        held = total[:, :LEVELS].cumsum(axis=1).astype(np.int64)
        return pa.table({"vid": left.column("vid"), **{f"c{j}": held[:, j] for j in range(LEVELS)}})

    schema = "vid string, " + ", ".join(f"c{j} long" for j in range(LEVELS))
    held = _visit(levels, placed, path, shape, ["levels"], count, schema).groupBy("vid").agg(*[F.sum(f"c{j}").alias(f"c{j}") for j in range(LEVELS)])
    better = F.coalesce(*[F.when(F.col(f"c{j}") + r >= need, F.col("levels")[j]) for j, r in enumerate(ranks)], F.col("bound"))
    return cut_lineage(levels.join(held, "vid", "left").select("vid", "features", "near", better.alias("bound"), "to"))


def exact_knn(points: DataFrame, k: int, seed: int = 42, block: int | None = None, leaves: int | None = None) -> DataFrame:
    """``src, dst, rank, dist``: the ``k`` nearest other cells, ordered by distance, then id.

    ``points`` is ``cell, features``. A cell is never its own neighbour here. ``leaves`` overrides the number
    of leaves, ``block`` the rows of a bin.
    """
    need = k + 1
    (placed, path), _, homes, shape = _homes(points, k, seed, block, leaves, False)
    if need >= MANY:
        homes = _tightened(homes, placed, path, shape, need)

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left) or not len(right):
            return pa.table({"vid": pa.array([], pa.string()), "near": pa.array([], _NEAR)})
        near = _nearest(_vectors(left.column("features")), right, need, left.column("bound").to_numpy())
        some = pa.array(near.value_lengths().to_numpy(zero_copy_only=False) > 0)
        return pa.table({"vid": left.column("vid"), "near": near}).filter(some)

    found = _visit(homes, placed, path, shape, [], search, "vid string, near array<struct<dist:double,dst:string>>")
    inside = F.filter("near", lambda x: x["dist"] <= F.col("bound"))
    lists = homes.select("vid", inside.alias("near")).unionByName(found).groupBy("vid").agg(
        F.slice(F.sort_array(F.flatten(F.collect_list("near"))), 1, need).alias("near"))
    own = F.slice(F.filter("near", lambda x: x["dst"] != F.col("cell")), 1, k)
    names = points.join(homes.select("vid", "features"), "features").select("cell", "vid")
    return names.join(lists, "vid").select(
        F.col("cell").alias("src"), F.posexplode(own).alias("pos", "e")
    ).select("src", F.col("e.dst").alias("dst"), (F.col("pos") + 1).alias("rank"), F.col("e.dist").alias("dist"))


def neighbour_table(points: DataFrame, k: int, seed: int = 42) -> DataFrame:
    """The index with ``k`` columns per cell: itself first, then its ``k - 1`` nearest."""
    others = exact_knn(points, max(1, k - 1), seed)
    if k <= 1:
        others = others.limit(0)
    itself = points.select(
        F.col("cell").alias("src"), F.col("cell").alias("dst"), F.lit(1).alias("rank"), F.lit(0.0).alias("dist")
    )
    return itself.unionByName(others.withColumn("rank", F.col("rank") + 1))
