"""Two-dimensional layouts of cells (E01 t-SNE, E02 UMAP) as rounds of joins.

Forces along neighbour edges are joins and grouped sums; UMAP, which takes hundreds of rounds,
deals cells and their edges into blocks once, and a round sends each block the positions of
the cells that it has edges to, in one shuffle. Forces between all cells come
from a summary of the plane: the cells themselves while they are few, else the centres of
a fixed grid with their counts. The summary has at most ``SUMMARY`` rows whatever the
number of cells, and is the only thing that is sent to every task.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from quillcell.operators.knn import exact_knn
from quillcell.operators.ranking import hash_index
from quillcell.session import cut_lineage, discard, written

SUMMARY = 4096
#: Most cells of a block, and pairs of a cell and a row of the summary that are looked at together.
BLOCK, PAIRS = 8192, 1 << 17
# Curve of the low-dimensional membership for min_dist 0.1 and spread 1.
UMAP_A, UMAP_B = 1.576943, 0.895061


def _noise(seed: int, axis: str) -> Column:
    """A repeatable standard normal value per cell (Box-Muller on two hashes)."""
    u = [(F.pmod(F.xxhash64(F.lit(seed), F.lit(axis + s), "cell"), F.lit(2**31)) + 0.5) / 2.0**31 for s in "ab"]
    return F.sqrt(-2.0 * F.ln(u[0])) * F.cos(2.0 * math.pi * u[1])


def start_positions(points: DataFrame, seed: int, spread: float) -> DataFrame:
    return points.select(
        "cell", (_noise(seed, "x") * spread).alias("x"), (_noise(seed, "y") * spread).alias("y"),
        F.lit(0.0).alias("vx"), F.lit(0.0).alias("vy"),
    )


def summarize(state: DataFrame, n: int) -> np.ndarray:
    """Rows ``x, y, count`` that stand for all cells."""
    if n <= SUMMARY:
        return state.select("x", "y", F.lit(1.0)).toPandas().to_numpy(float)
    side = math.isqrt(SUMMARY)
    box = state.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
    gx = F.least(F.lit(side - 1), F.floor((F.col("x") - box[0]) / max(box[1] - box[0], 1e-12) * side))
    gy = F.least(F.lit(side - 1), F.floor((F.col("y") - box[2]) / max(box[3] - box[2], 1e-12) * side))
    grid = state.groupBy(gx.alias("i"), gy.alias("j")).agg(F.avg("x").alias("x"), F.avg("y").alias("y"), F.count("*").cast("double").alias("c"))
    return grid.select("x", "y", "c").toPandas().to_numpy(float)


def _pull(state: DataFrame, edges: DataFrame, force) -> DataFrame:
    """Summed force along the edges of each cell; ``force(w, d2)`` scales the difference vector."""
    a = state.select(F.col("cell").alias("src"), F.col("x").alias("ax"), F.col("y").alias("ay"))
    b = state.select(F.col("cell").alias("dst"), F.col("x").alias("bx"), F.col("y").alias("by"))
    dx, dy = F.col("ax") - F.col("bx"), F.col("ay") - F.col("by")
    f = force(F.col("w"), dx * dx + dy * dy)
    return edges.join(a, "src").join(b, "dst").groupBy(F.col("src").alias("cell")).agg(
        F.sum(f * dx).alias("px"), F.sum(f * dy).alias("py"), F.sum("w").alias("degree")
    )


def _push(summary: np.ndarray, force):
    """A vectorised function of ``x, y``: the summed ``force(d2)`` times the difference vector."""
    sx, sy, c = summary[:, 0].copy(), summary[:, 1].copy(), summary[:, 2].copy()

    @F.pandas_udf("struct<rx:double,ry:double>")
    def push(x: pd.Series, y: pd.Series) -> pd.DataFrame:
        x, y = x.to_numpy(float), y.to_numpy(float)
        rx, ry = np.empty(len(x)), np.empty(len(x))
        for lo in range(0, len(x), 1024):
            at = slice(lo, lo + 1024)
            dx, dy = x[at, None] - sx[None, :], y[at, None] - sy[None, :]
            f = force(dx * dx + dy * dy) * c[None, :]
            rx[at], ry[at] = (f * dx).sum(1), (f * dy).sum(1)
        return pd.DataFrame({"rx": rx, "ry": ry})

    return push


def affinities(neighbours: DataFrame, perplexity: float) -> DataFrame:
    """``src, dst, p``: conditional probabilities with the wanted perplexity, per short neighbour list."""
    target = math.log(perplexity)

    @F.pandas_udf("array<double>")
    def calibrate(d2: pd.Series) -> pd.Series:
        out = []
        for row in d2:
            d = np.asarray(row, float)
            d = d - d.min()
            lo, hi, beta = 0.0, np.inf, 1.0 / max(d.mean(), 1e-12)
            for _ in range(64):
                p = np.exp(-beta * d)
                total = p.sum()
                entropy = math.log(total) + beta * float((p * d).sum()) / total
                if abs(entropy - target) < 1e-6:
                    break
                if entropy > target:
                    lo, beta = beta, (beta * 2 if hi == np.inf else (beta + hi) / 2)
                else:
                    hi, beta = beta, (beta + lo) / 2
            out.append(p / total)
        return pd.Series(out)

    lists = neighbours.groupBy("src").agg(F.sort_array(F.collect_list(F.struct("rank", "dst", "dist"))).alias("e"))
    p = lists.select("src", F.col("e.dst").alias("d"), calibrate(F.transform("e.dist", lambda v: v * v)).alias("p"))
    return p.select("src", F.explode(F.arrays_zip("d", "p")).alias("z")).select("src", F.col("z.d").alias("dst"), F.col("z.p").alias("p"))


def tsne(points: DataFrame, perplexity: float = 30.0, iterations: int = 250, seed: int = 42) -> DataFrame:
    """``cell, x, y``: t-SNE with neighbour affinities (van der Maaten 2014)."""
    n = points.count()
    k = int(min(n - 1, max(2, 3 * perplexity)))
    cond = affinities(exact_knn(points, k, seed), min(perplexity, max(1.5, (n - 1) / 3)))
    both = cond.unionByName(cond.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "p"))
    edges = cut_lineage(both.groupBy("src", "dst").agg((F.sum("p") / (2.0 * n)).alias("w")))
    state = cut_lineage(start_positions(points, seed, 1e-2))
    rate = max(n / 48.0, 50.0)
    for it in range(iterations):
        early = it < iterations // 4
        boost, momentum = (12.0, 0.5) if early else (1.0, 0.8)
        summary = summarize(state, n)
        gap = ((summary[:, None, :2] - summary[None, :, :2]) ** 2).sum(2)
        z = float((summary[:, 2][:, None] * summary[:, 2][None, :] / (1.0 + gap)).sum() - n)
        pulled = _pull(state, edges, lambda w, d2: boost * w / (1.0 + d2))
        push = _push(summary, lambda d2: 1.0 / (1.0 + d2) ** 2)
        moved = state.join(pulled, "cell", "left").withColumn("_r", push("x", "y"))
        gx = 4.0 * (F.coalesce("px", F.lit(0.0)) - F.col("_r.rx") / z)
        gy = 4.0 * (F.coalesce("py", F.lit(0.0)) - F.col("_r.ry") / z)
        moved = moved.select("cell", "x", "y", (momentum * F.col("vx") - rate * gx).alias("vx"), (momentum * F.col("vy") - rate * gy).alias("vy"))
        state = cut_lineage(moved.select("cell", (F.col("x") + F.col("vx")).alias("x"), (F.col("y") + F.col("vy")).alias("y"), "vx", "vy"))
    return state.select("cell", "x", "y")


def fuzzy_graph(neighbours: DataFrame, k: int) -> DataFrame:
    """``src, dst, w``: the symmetric fuzzy neighbour graph (McInnes et al. 2018)."""
    target = math.log2(k)

    @F.pandas_udf("array<double>")
    def weights(dist: pd.Series) -> pd.Series:
        out = []
        for row in dist:
            d = np.asarray(row, float)
            above = d[d > 0]
            excess = np.maximum(d - (above.min() if len(above) else 0.0), 0.0)
            lo, hi, sigma = 0.0, np.inf, 1.0
            for _ in range(64):
                total = np.exp(-excess / sigma).sum()
                if abs(total - target) < 1e-6:
                    break
                if total > target:
                    hi, sigma = sigma, (lo + sigma) / 2
                else:
                    lo, sigma = sigma, (sigma * 2 if hi == np.inf else (sigma + hi) / 2)
            out.append(np.exp(-excess / max(sigma, 1e-12)))
        return pd.Series(out)

    lists = neighbours.groupBy("src").agg(F.sort_array(F.collect_list(F.struct("rank", "dst", "dist"))).alias("e"))
    w = lists.select("src", F.col("e.dst").alias("d"), weights("e.dist").alias("w"))
    w = w.select("src", F.explode(F.arrays_zip("d", "w")).alias("z")).select("src", F.col("z.d").alias("dst"), F.col("z.w").alias("w"))
    both = w.unionByName(w.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w"))
    joined = F.sum("w") - F.when(F.count("*") == 2, F.product("w")).otherwise(0.0)
    return both.groupBy("src", "dst").agg(joined.alias("w"))


_STATIC = "block int, src binary, at binary, w binary, slots binary, sizes binary"
_SENT = "block int, sent int, x binary, y binary, c binary, x0 double, x1 double, y0 double, y1 double"


def _keys(spark, n: int) -> list[int]:
    """``n`` numbers that Spark's hash deals to ``n`` partitions, one to each."""
    at = spark.range(64 * n + 64).select(F.col("id").cast("int").alias("key"), F.pmod(F.hash(F.col("id").cast("int")), F.lit(n)).alias("p"))
    found = [r["key"] for r in at.groupBy("p").agg(F.min("key").alias("key")).orderBy("p").collect()]
    return found if len(found) == n else list(range(n))


def _sent(block: int, x: np.ndarray, y: np.ndarray, c: np.ndarray, slots: np.ndarray, sizes: np.ndarray) -> pa.Table:
    """The state of a block (``sent`` is null), and the positions of those of its cells that other blocks have edges to."""
    rows = [(block, None, x.tobytes(), y.tobytes(), c.tobytes(), float(x.min()), float(x.max()), float(y.min()), float(y.max()))]
    ends = np.cumsum(sizes[:, 1])
    for (to, n), end in zip(sizes.tolist(), ends.tolist()):
        at = slots[end - n : end]
        rows.append((to, block, x[at].tobytes(), y[at].tobytes(), None, None, None, None, None))
    kinds = [pa.int32(), pa.int32(), *[pa.binary()] * 3, *[pa.float64()] * 4]
    return pa.table({name.split()[0]: pa.array(v, k) for name, v, k in zip(_SENT.split(", "), zip(*rows), kinds)})


def _dealt(points: DataFrame, edges: DataFrame, seed: int, spread: float) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    """``block, slot, cell, c`` of the cells (``c``: how often they come), the blocks' edges, what they send first, and the blocks.

    Edges are the same in both directions, so the cells of a block that another one has edges to are those with edges
    to that. Of a cell that comes more than once each copy pulls.
    """
    spark = points.sparkSession
    counts = points.groupBy("cell").agg(F.count("*").alias("c"))
    index = hash_index(counts, "cell", seed=seed).withColumnRenamed("cell", "_cell")
    counts = cut_lineage(counts.join(index, F.col("cell").eqNullSafe(F.col("_cell"))).drop("_cell"))
    cores = spark.sparkContext.defaultParallelism
    blocks = cores * max(1, math.ceil(counts.count() / (cores * BLOCK)))
    key = F.array(*map(F.lit, _keys(spark, blocks)))[F.pmod("index", F.lit(blocks)).cast("int")]
    place = [key.alias("block"), F.floor(F.col("index") / blocks).cast("int").alias("slot")]
    cells = cut_lineage(counts.select(*place, "cell", "c", *((_noise(seed, v) * spread).alias(v) for v in "xy")))
    end = lambda name: cells.select(F.col("cell").alias(name), *(F.col(k).alias(f"{name}_{k}") for k in ("block", "slot", "c")))
    both = edges.join(end("src"), "src").join(end("dst"), "dst").select(
        F.col("src_block").alias("block"), "src_slot", "dst_block", "dst_slot", (F.col("w") * F.col("src_c") * F.col("dst_c")).alias("w"))

    def build(left: pa.Table, right: pa.Table) -> pa.Table:
        own = left.sort_by("slot")
        src, to, there, w = (right.column(k).to_numpy() for k in ("src_slot", "dst_block", "dst_slot", "w"))
        far = np.unique(to.astype(np.int64) << 32 | there, return_inverse=True)[1]  # positions in the order in which they come
        slots = np.unique(to.astype(np.int64) << 32 | src)
        sizes = np.stack(np.unique(slots >> 32, return_counts=True), axis=1).astype(np.int64)
        block = own.column("block")[0].as_py()
        out = _sent(block, *(own.column(k).to_numpy().astype(float) for k in "xyc"), (slots & 0xFFFFFFFF).astype(np.int32), sizes)
        static = [src.astype(np.int32), far.astype(np.int32), w, (slots & 0xFFFFFFFF).astype(np.int32), sizes]
        for k, v in zip(("src", "at", "w", "slots", "sizes"), static):
            out = out.append_column(k, pa.array([v.tobytes(), *[None] * (len(out) - 1)], pa.binary()))
        return out

    first = cut_lineage(cells.groupBy("block").cogroup(both.groupBy("block")).applyInArrow(build, _SENT + _STATIC[len("block int"):]))
    static = first.filter("sent IS NULL").select(*(f.split()[0] for f in _STATIC.split(", "))).repartition(blocks, "block").persist()
    return cells, static, first.select(*(f.split()[0] for f in _SENT.split(", "))), blocks


def _state(sent: DataFrame) -> DataFrame:
    return sent.filter("sent IS NULL").select("block", "x", "y", "c")


def _places(sent: DataFrame) -> DataFrame:
    """``block, slot, x, y``: a row per cell."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                x, y = np.frombuffer(row["x"]), np.frombuffer(row["y"])
                yield pa.RecordBatch.from_pydict({"block": np.full(len(x), row["block"], np.int32), "slot": np.arange(len(x), dtype=np.int32), "x": x, "y": y})

    return _state(sent).mapInArrow(run, "block int, slot int, x double, y double")


def _summary(sent: DataFrame, n: int, box: tuple[float, float, float, float]) -> np.ndarray:
    """:func:`summarize` for blocks, whose positions lie in ``box``."""
    if n <= SUMMARY:
        rows = _state(sent).select("x", "y", "c").collect()
        return np.concatenate([np.stack([np.frombuffer(r[k]) for k in "xyc"], axis=1) for r in rows])
    side = math.isqrt(SUMMARY)

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                x, y, c = (np.frombuffer(row[k]) for k in "xyc")
                i, j = (np.minimum(side - 1, np.floor((v - lo) / max(hi - lo, 1e-12) * side)).astype(int) for v, lo, hi in ((x, *box[:2]), (y, *box[2:])))
                at, where = np.unique(i * side + j, return_inverse=True)
                yield pa.RecordBatch.from_pydict({"at": at.astype(np.int32), **{k: np.bincount(where, v) for k, v in (("x", x * c), ("y", y * c), ("c", c))}})

    grid = _state(sent).mapInArrow(run, "at int, x double, y double, c double").groupBy("at").agg(*(F.sum(k).alias(k) for k in "xyc"))
    rows = np.array([tuple(r) for r in grid.select("x", "y", "c").collect()])
    return np.stack([rows[:, 0] / rows[:, 2], rows[:, 1] / rows[:, 2], rows[:, 2]], axis=1)


def _repulsion(x: np.ndarray, y: np.ndarray, summary: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The summed push of all cells on each position; what lies just there does not push."""
    a, b, (sx, sy, c) = UMAP_A, UMAP_B, summary.T.copy()
    rx, ry, step = np.empty(len(x)), np.empty(len(x)), max(1, PAIRS // len(c))
    for lo in range(0, len(x), step):
        at = slice(lo, lo + step)
        dx, dy = x[at, None] - sx, y[at, None] - sy
        d2 = dx * dx
        d2 += dy * dy
        near = d2 <= 1e-12
        f = np.power(d2, b)
        f *= a
        f += 1.0
        d2 += 0.001
        f *= d2
        np.divide(2 * b * c, f, out=f)
        f[near] = 0.0
        rx[at], ry[at] = np.einsum("ij,ij->i", f, dx), np.einsum("ij,ij->i", f, dy)
    return rx, ry


def umap(points: DataFrame, neighbours: int = 15, epochs: int = 200, seed: int = 42, negatives: int = 5) -> DataFrame:
    """``cell, x, y``: UMAP with full-batch steps and the expected value of the negative samples."""
    spark, n = points.sparkSession, points.count()
    k = int(min(n - 1, neighbours))
    edges = cut_lineage(fuzzy_graph(exact_knn(points, k, seed), k))
    cells, static, sent, blocks = _dealt(points, edges, seed, 5.0)
    a, b, path = UMAP_A, UMAP_B, None
    box = sent.agg(F.min("x0"), F.max("x1"), F.min("y0"), F.max("y1")).first()
    for it in range(epochs):
        rate, summary = 1.0 - it / epochs, _summary(sent, n, tuple(box))

        def step(left: pa.Table, right: pa.Table) -> pa.Table:
            fixed, rows = right.to_pylist()[0], left.to_pylist()
            own = next(r for r in rows if r["sent"] is None)
            x, y, c = (np.frombuffer(own[k]) for k in "xyc")
            rows = sorted((r for r in rows if r["sent"] is not None), key=lambda r: r["sent"])
            src, at, slots = (np.frombuffer(fixed[k], np.int32) for k in ("src", "at", "slots"))
            w = np.frombuffer(fixed["w"])
            dx, dy = (v[src] - np.frombuffer(b"".join(r[k] for r in rows))[at] for v, k in ((x, "x"), (y, "y")))
            d2 = np.maximum(dx * dx + dy * dy, 1e-12)
            f = w * 2 * a * b * d2 ** (b - 1) / (1 + a * d2**b)
            degree = np.bincount(src, w, len(x))
            moved = []
            for v, d, push in zip((x, y), (dx, dy), _repulsion(x, y, summary)):
                raw = degree * negatives / float(n) * push - np.bincount(src, f * d, len(x))
                moved.append(v + rate * np.clip(raw / np.maximum(1.0, degree), -4.0, 4.0))
            return _sent(own["block"], *moved, c, slots, np.frombuffer(fixed["sizes"], np.int64).reshape(-1, 2))

        seen = Observation()
        stepped = sent.repartition(blocks, "block").groupBy("block").cogroup(static.groupBy("block")).applyInArrow(step, _SENT)
        stepped = stepped.observe(seen, F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.min("y0").alias("y0"), F.max("y1").alias("y1"))
        stale, (sent, path) = path, written(stepped, "layout")
        box = [seen.get[k] for k in ("x0", "x1", "y0", "y1")]
        if stale is not None:
            discard(spark, stale)
    static.unpersist()
    copies = cells.select("block", "slot", "cell", F.explode(F.sequence(F.lit(1), F.col("c").cast("int"))).alias("copy"))
    return _places(sent).join(copies, ["block", "slot"]).select("cell", "x", "y")
