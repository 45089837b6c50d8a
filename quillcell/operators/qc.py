"""Low-quality cells from robust distances (Q01).

The minimum covariance determinant by nested FastMCD (Rousseeuw and Van Driessen 1999), the same for
every number of cells. A hash deals the cells into disjoint subsets of some ``SUBSET`` cells. Each
subset tries random starts and concentrates them, all subsets in parallel; the best are
concentrated further on the union of a few subsets, and what is left of them on all cells until their
determinants stop falling. A step over all cells is a selection of the nearest half and one sum,
for all candidates at once; tasks send counts and sums, and it returns a vector and a matrix for each.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillcell.functions.distributions import gammainc_upper_np
from quillcell.matrix import Matrix
from quillcell.operators.aggregates import qc_features, three_sigma
from quillcell.session import cut_lineage

SUBSET = 300
#: Subsets whose union the candidates meet before all cells, and random starts in all subsets together.
MERGED = 5
TRIALS = 500
KEPT = 10
#: Bits of a distance that a selection settles at a time.
_DIGITS = (22, 21, 21)
FEATURES = ("ln_reads", "genes", "perc_rrna", "perc_mt", "perc_spike")


def chi2_quantile(q: float, df: int) -> float:
    lo, hi = 0.0, 1e4
    for _ in range(200):
        mid = (lo + hi) / 2
        below = 1.0 - float(gammainc_upper_np(np.array([df / 2.0]), np.array([mid / 2.0]))[0])
        lo, hi = (mid, hi) if below < q else (lo, mid)
    return (lo + hi) / 2


def _distances(x: np.ndarray, centre: np.ndarray, cov: np.ndarray) -> np.ndarray:
    d = x - centre
    return np.einsum("ij,jk,ik->i", d, np.linalg.pinv(cov), d)


def _concentrate(x: np.ndarray, centre: np.ndarray, cov: np.ndarray, h: int, steps: int):
    best = math.inf
    for _ in range(steps):
        keep = np.argsort(_distances(x, centre, cov), kind="stable")[:h]
        centre, cov = x[keep].mean(axis=0), np.cov(x[keep].T, bias=True).reshape(x.shape[1], -1)
        sign, logdet = np.linalg.slogdet(cov)
        logdet = logdet if sign > 0 else -math.inf
        if logdet == best or logdet == -math.inf:
            best = logdet
            break
        best = logdet
    return best, centre, cov


def half_of(n: int, p: int) -> int:
    return min(n, math.ceil(0.5 * (n + p + 1)))


def subset_candidates(x: np.ndarray, trials: int, seed: int) -> list[tuple[float, np.ndarray, np.ndarray]]:
    """The best of some random starts in one subset after two steps, by determinant."""
    n, p = x.shape
    rng = np.random.default_rng(seed)
    rough = []
    for _ in range(trials if n > p + 1 else 1):
        pick = rng.choice(n, min(n, p + 1), replace=False)
        cov = np.cov(x[pick].T, bias=True).reshape(p, -1)
        rough.append(_concentrate(x, x[pick].mean(axis=0), cov, half_of(n, p), 2))
    return sorted(rough, key=lambda r: r[0])[:KEPT]


def _starts(table: DataFrame, names: list[str], n: int, seed: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Different candidates that subsets and their union have concentrated."""
    p = len(names)
    subsets = max(1, round(n / SUBSET))
    trials = max(2, -(-TRIALS // subsets))
    dealt = table.select(F.pmod("spread", F.lit(subsets)).alias("subset"), *names)

    def tried(pdf: pd.DataFrame) -> pd.DataFrame:
        number = int(pdf["subset"].iloc[0])
        x = pdf[names].to_numpy(float)
        x = x[np.lexsort(x.T)]
        found = subset_candidates(x, trials, seed + number)
        return pd.DataFrame({"logdet": [d for d, _, _ in found], "centre": [c.tolist() for _, c, _ in found], "cov": [v.ravel().tolist() for _, _, v in found]})

    best = dealt.groupBy("subset").applyInPandas(tried, "logdet double, centre array<double>, cov array<double>")
    best = best.orderBy("logdet", "centre").limit(KEPT * MERGED).collect()
    # some MERGED * SUBSET cells, however many there are
    x = dealt.filter(F.col("subset") < MERGED).select(names).toPandas().to_numpy(float)
    x = x[np.lexsort(x.T)]
    h = half_of(len(x), p)
    rough = sorted((_concentrate(x, np.array(r["centre"]), np.array(r["cov"]).reshape(p, p), h, 2) for r in best), key=lambda r: r[0])[:KEPT]
    full = sorted((_concentrate(x, c, v, h, 30) for _, c, v in rough), key=lambda r: r[0])
    out: list[tuple[np.ndarray, np.ndarray]] = []
    for _, c, v in full:
        if not any(np.allclose(c, d, rtol=1e-9) and np.allclose(v, w, rtol=1e-9) for d, w in out):
            out.append((c, v))
    return out


def squared_distance(names: list[str], centre: np.ndarray, cov: np.ndarray) -> Column:
    """The Mahalanobis distance as a column expression."""
    inverse = np.linalg.pinv(cov)
    d = [F.col(c) - float(m) for c, m in zip(names, centre)]
    total = F.lit(0.0)
    for i in range(len(d)):
        for j in range(i, len(d)):
            total = total + d[i] * d[j] * float(inverse[i, j] * (1 if i == j else 2))
    return total


def _moments(df: DataFrame, names: list[str], centre: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean and covariance (divisor n) of the rows; sums are taken around ``centre``."""
    d = [F.col(c) - float(m) for c, m in zip(names, centre)]
    p = len(names)
    cells = [(i, j) for i in range(p) for j in range(i, p)]
    row = df.agg(*[F.avg(x) for x in d], *[F.avg(d[i] * d[j]) for i, j in cells]).first()
    shift, cov = np.array(row[:p], float), np.zeros((p, p))
    for k, (i, j) in enumerate(cells):
        cov[i, j] = cov[j, i] = row[p + k] - shift[i] * shift[j]
    return centre + shift, cov


def _tasks(table: DataFrame, names: list[str], candidates: list[tuple[np.ndarray, np.ndarray]], schema: str, found: Callable) -> DataFrame:
    """What ``found(id, x, d)`` returns for the rows ``x`` of a batch and their distances ``d`` from each candidate, summed over batches.

    It returns keys and sums. Distances are taken element by element, so a row has the same one in every batch.
    """
    p = len(names)
    centres = [c for c, _ in candidates]
    inverses = [np.linalg.pinv(v) for _, v in candidates]
    columns = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[tuple[np.ndarray, ...]]] = [[] for _ in candidates]

        def merged(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
            keys, back = np.unique(np.concatenate([q[0] for q in parts]), return_inverse=True)
            return keys, *(np.bincount(back, weights=np.concatenate(v), minlength=len(keys)) for v in zip(*(q[1:] for q in parts)))

        for batch in batches:
            rows = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(p)]
            for k, (centre, w) in enumerate(zip(centres, inverses)):
                x = [r - m for r, m in zip(rows, centre)]
                d = np.zeros(batch.num_rows)
                for i in range(p):
                    for j in range(i, p):
                        d += x[i] * x[j] * (w[i, j] * (1 if i == j else 2))
                held[k].append(found(k, x, np.maximum(d, 0.0)))
                if len(held[k]) == 64:
                    held[k] = [merged(held[k])]
        for k, parts in enumerate(held):
            keys, *sums = merged(parts) if parts else ((),)
            if len(keys):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), k)), pa.array(keys), *map(pa.array, sums)], columns)

    return table.select(*names).mapInArrow(run, schema)


def ranked_distances(table: DataFrame, names: list[str], candidates: list[tuple[np.ndarray, np.ndarray]], rank: list[int]) -> list[float]:
    """For each candidate the distance of the row that has ``rank`` (from 0) by distance from it.

    As :mod:`quantile` does, by the bits of the distances, some at a time: tasks count them by their next
    bits, and what is sent is a count per candidate and digit.
    """
    left, prefix, shift = list(rank), [0] * len(candidates), 64
    for width in _DIGITS:
        shift -= width

        def digits(k: int, x: list[np.ndarray], d: np.ndarray, known: tuple = tuple(prefix), at: int = shift, size: int = width) -> tuple[np.ndarray, ...]:
            bits = d.view(np.int64)
            if at + size < 64:
                bits = bits[(bits >> (at + size)) == known[k]]
            keys, count = np.unique(bits >> at, return_counts=True)
            return keys, count.astype(float)

        counts = _tasks(table, names, candidates, "id long, digit long, c double", digits)
        counts = counts.groupBy("id", "digit").agg(F.sum("c").cast("long").alias("c"))
        upto = F.sum("c").over(Window.partitionBy("id").orderBy("digit"))
        want = F.get(F.array(*map(F.lit, left)), F.col("id"))
        hit = counts.withColumn("upto", upto).filter((want < F.col("upto")) & (want >= F.col("upto") - F.col("c")))
        for r in hit.select("id", "digit", (F.col("upto") - F.col("c")).alias("before")).collect():
            left[r["id"]], prefix[r["id"]] = left[r["id"]] - r["before"], r["digit"]
    return np.array(prefix, dtype=np.int64).view(float).tolist()


def _step(table: DataFrame, names: list[str], candidates: list[tuple[np.ndarray, np.ndarray]], h: int) -> list[tuple[float, np.ndarray, np.ndarray]]:
    """One concentration step of all candidates over all cells: determinants, centres and covariances."""
    p = len(names)
    cells = [(i, j) for i in range(p) for j in range(i, p)]
    limits = ranked_distances(table, names, candidates, [h - 1] * len(candidates))

    def moments(k: int, x: list[np.ndarray], d: np.ndarray) -> tuple[np.ndarray, ...]:
        near = d <= limits[k]
        x = [v[near] for v in x]
        return np.zeros(1, dtype=np.int64), *(np.array([float(v)]) for v in (near.sum(), *(v.sum() for v in x), *((x[i] * x[j]).sum() for i, j in cells)))

    sums = [f"m{i}" for i in range(p)] + [f"s{k}" for k in range(len(cells))]
    schema = ", ".join(["id long", "one long", "n double", *(f"{c} double" for c in sums)])
    total = _tasks(table, names, candidates, schema, moments).groupBy("id").agg(F.sum("n").alias("n"), *[F.sum(c).alias(c) for c in sums])
    out = []
    for r in total.orderBy("id").collect():
        shift, cov = np.array([r[f"m{i}"] for i in range(p)]) / r["n"], np.zeros((p, p))
        for k, (i, j) in enumerate(cells):
            cov[i, j] = cov[j, i] = r[f"s{k}"] / r["n"] - shift[i] * shift[j]
        sign, logdet = np.linalg.slogdet(cov)
        out.append((float(logdet) if sign > 0 else -math.inf, candidates[r["id"]][0] + shift, cov))
    return out


def minimum_covariance(table: DataFrame, names: list[str], n: int, seed: int = 42) -> tuple[float, np.ndarray, np.ndarray]:
    """The log determinant, centre and covariance of the half of the rows that lies closest together.

    ``table`` has the columns ``names``, none of them constant, and a hash ``spread``.
    """
    h = half_of(n, len(names))
    going, best = _starts(table, names, n, seed), None
    before = [math.inf] * len(going)
    while going:
        steps = _step(table, names, going, h)
        best = min([*steps, *([best] if best else [])], key=lambda r: r[0])
        on = [(s, b) for s, b in zip(steps, before) if s[0] < b - 1e-9 and s[0] > -math.inf]
        # candidates that have met go on as one
        on = [(s, b) for i, (s, b) in enumerate(on) if not any(np.allclose(s[1], t[1], rtol=1e-9) and np.allclose(s[2], t[2], rtol=1e-9) for t, _ in on[:i])]
        going, before = [(c, v) for (_, c, v), _ in on], [s[0] for s, _ in on]
    return best


def robust_distances(features: DataFrame, names: list[str], seed: int = 42, key: str = "cell") -> DataFrame:
    """``key, md``: squared robust distance of every row. Constant features are left out."""
    spread = F.xxhash64(F.lit(seed), F.col(key)).alias("spread")
    table = cut_lineage(features.select(key, spread, *[F.col(c).cast("double").alias(c) for c in names]))
    counts = table.agg(F.count("*"), *[F.var_pop(c) for c in names]).first()
    n, names = counts[0], [c for c, v in zip(names, counts[1:]) if v and v > 1e-20]
    if not names:
        return table.select(key, F.lit(0.0).alias("md"))
    p = len(names)
    _, centre, cov = minimum_covariance(table, names, n, seed)
    raw = table.withColumn("_d", squared_distance(names, centre, cov))
    scale = sum(ranked_distances(table, names, [(centre, cov)] * 2, [(n - 1) // 2, n // 2])) / 2 / chi2_quantile(0.5, p)
    inner = raw.filter(F.col("_d") / scale < chi2_quantile(0.975, p)) if scale > 0 else raw.filter("_d <= 0")
    centre, cov = _moments(inner, names, centre)
    return table.select(key, squared_distance(names, centre, cov).alias("md"))


def flag_outliers(distances: DataFrame) -> DataFrame:
    """Cells whose distance is beyond three standard deviations of the mean distance."""
    b = three_sigma(distances, "md").agg(F.first(F.struct("lower", "upper"))).scalar()
    out = (F.col("md") < b.getField("lower")) | (F.col("md") > b.getField("upper"))
    return distances.withColumn("low_quality", out)


def low_quality_cells(m: Matrix, spikes: Matrix, rrna_genes: DataFrame | None = None, seed: int = 42) -> DataFrame:
    """``cell, md, low_quality`` for every cell with reads."""
    features = qc_features(m, spikes, rrna_genes)
    return flag_outliers(cut_lineage(robust_distances(features, list(FEATURES), seed)))
