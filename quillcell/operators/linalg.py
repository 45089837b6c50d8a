"""Dimension reduction of cells (P01, P02) by products with the sparse matrix alone.

Both decompositions need the leading eigenvectors of ``A = Z'Z``, where ``Z`` are the cell rows
as they are (P01) or centred and perhaps scaled (P02). A block Lanczos iteration with thick
restarts finds them: it keeps a basis of gene vectors, multiplies a few new ones by ``A`` at a
time, takes the best vectors in the span (Rayleigh-Ritz), and extends the basis by their
residuals until those are small. No gene-by-gene table is made.

A product is one pass over the stored entries. Centring and scaling are corrections of rank one:
with ``x`` a stored row, ``z'v = x'(v / s) - c'(v / s)``, so ``z`` is never formed, and the
centre's part of ``Z'u`` is the centre times the sum of ``u``. Vectors go out in panels of a
bounded size, more passes for more genes, and their partial products are summed by gene block in
tasks. As in Spark's own solver for row matrices, the driver holds the basis: numbers per gene
and component, never anything per cell.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillcell.matrix import Matrix, gene_moments
from quillcell.session import cut_lineage

#: Bytes of the vectors that one pass sends to every task.
PANEL = 64 << 20
_ENTRIES = 1 << 16
_GENES = 1024


@dataclass
class Projection:
    """Loadings of ``k`` components over ``genes``; a score is ``(x - centre) / scale @ loadings``."""

    genes: list[str]
    centre: np.ndarray
    scale: np.ndarray
    loadings: np.ndarray
    strength: np.ndarray
    #: Largest residual of an eigenpair, as a share of the largest eigenvalue, after each pass.
    residuals: list[float] = field(default_factory=list)

    def gene_table(self, spark: SparkSession) -> DataFrame:
        rows = [(g, i) for i, g in enumerate(self.genes)]
        return spark.createDataFrame(rows, "gene string, idx int")

    def apply(self, m: Matrix, cells: DataFrame | None = None) -> DataFrame:
        """``cell, features``: component scores of every cell of ``m``, or of ``cells``, which ``m`` need not all have."""
        return project(sparse_rows(m, self.gene_table(m.expr.sparkSession), cells), self)

    def loading_table(self, spark: SparkSession) -> DataFrame:
        """``gene, pc, loading`` with components numbered from 1."""
        wide = spark.createDataFrame([(g, v.tolist()) for g, v in zip(self.genes, self.loadings)], "gene string, v array<double>")
        return wide.select("gene", F.posexplode("v").alias("pc", "loading")).withColumn("pc", F.col("pc") + 1)


def index_genes(genes: DataFrame) -> tuple[list[str], DataFrame]:
    """Names in order and their positions."""
    names = sorted(r["gene"] for r in genes.select("gene").distinct().collect())
    return names, genes.sparkSession.createDataFrame([(g, i) for i, g in enumerate(names)], "gene string, idx int")


def sparse_rows(m: Matrix, positions: DataFrame, cells: DataFrame | None = None) -> DataFrame:
    """``cell, idx, val``: one sorted sparse row per cell, empty when no gene of the set is seen.

    A row has at most as many entries as ``positions`` has rows.
    """
    kept = m.expr.join(positions, "gene").groupBy("cell").agg(
        F.sort_array(F.collect_list(F.struct("idx", F.col("value").cast("double").alias("v")))).alias("e")
    )
    rows = (m.cells if cells is None else cells).join(kept, "cell", "left")
    return rows.select(
        "cell", F.coalesce("e.idx", F.array().cast("array<int>")).alias("idx"),
        F.coalesce("e.v", F.array().cast("array<double>")).alias("val"),
    )


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """A batch of sparse rows in runs of bounded size: first and last row, row starts, positions, values.

    A row with more entries than a run holds is a run of its own.
    """
    idx, val = batch.column("idx"), batch.column("val")
    offsets = np.asarray(idx.offsets)
    at, values = idx.values.to_numpy(zero_copy_only=False), val.values.to_numpy(zero_copy_only=False)
    shift = np.asarray(val.offsets)[0] - offsets[0] if len(offsets) else 0
    lo = 0
    while lo < batch.num_rows:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + _ENTRIES, side="right")) - 1)
        a, b = offsets[lo], offsets[hi]
        yield lo, hi, offsets[lo : hi + 1] - a, at[a:b], values[a + shift : b + shift]
        lo = hi


def _times(starts: np.ndarray, at: np.ndarray, values: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The products of sparse rows with the columns of ``v``."""
    out = np.zeros((len(starts) - 1, v.shape[1]))
    some = np.flatnonzero(np.diff(starts))
    if len(some):
        out[some] = np.add.reduceat(values[:, None] * v[at], starts[some], axis=0)
    return out


def multiply(rows: DataFrame, v: np.ndarray, offset: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``X'u`` and the sum of ``u`` over all cells, where ``u = X v - offset`` per row of the sparse table."""
    d, b = v.shape
    width = max(1, PANEL // (8 * max(1, d)))
    if b > width:
        parts = [multiply(rows, v[:, i : i + width], offset[i : i + width]) for i in range(0, b, width)]
        return np.hstack([p for p, _ in parts]), np.concatenate([s for _, s in parts])
    shared = rows.sparkSession.sparkContext.broadcast((v, offset))

    def passes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, offset = shared.value
        total = np.zeros((d + 1, b))
        for batch in batches:
            for _, _, starts, at, values in _runs(batch):
                u = _times(starts, at, values, v) - offset
                total[d] += u.sum(axis=0)
                if len(at):
                    order = np.argsort(at, kind="stable")
                    row = np.repeat(np.arange(len(starts) - 1), np.diff(starts))[order]
                    which, first = np.unique(at[order], return_index=True)
                    total[which] += np.add.reduceat(values[order, None] * u[row], first, axis=0)
        for block in range(0, d + 1, _GENES):
            part = total[block : block + _GENES]
            yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([part.tobytes()], pa.binary())], ["block", "part"])

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, part in zip(batch.column("block").to_pylist(), batch.column("part")):
                value = np.frombuffer(part.as_buffer(), dtype=float)
                sums[block] = sums[block] + value if block in sums else value
        for block, value in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([value.tobytes()], pa.binary())], ["block", "part"])

    schema = "block long, part binary"
    found = rows.select("idx", "val").mapInArrow(passes, schema).repartition("block").mapInArrow(summed, schema).collect()
    out = np.zeros((d + 1, b))
    for row in found:
        part = np.frombuffer(row["part"], dtype=float).reshape(-1, b)
        out[row["block"] : row["block"] + len(part)] += part
    shared.destroy()
    return out[:d], out[d]


def eigenpairs(product, d: int, k: int, seed: int = 42, tolerance: float = 1e-9, most: int = 100) -> tuple[np.ndarray, np.ndarray, list[float]]:
    """The ``k`` largest eigenvalues of a symmetric operator with no negative ones, their vectors, and the residuals by pass.

    ``product`` maps ``d x b`` vectors to the operator's product with them. The basis need not be
    exactly orthonormal: each step solves the projected problem with the basis' own inner products.
    It ends when the residuals of all ``k`` pairs are below ``tolerance`` times the largest
    eigenvalue, when the basis spans all, or after ``most`` products, with a warning.
    """
    k = min(k, d)
    if not k:
        return np.zeros(0), np.zeros((d, 0)), []
    block = min(d, k + 8)
    new = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, block)))[0]
    basis, image, trace = np.zeros((d, 0)), np.zeros((d, 0)), []
    for step in range(most):
        basis, image = np.hstack([basis, new]), np.hstack([image, product(new)])
        inner, weights = np.linalg.eigh(basis.T @ basis)
        white = weights[:, inner > 1e-12 * inner[-1]] / np.sqrt(inner[inner > 1e-12 * inner[-1]])
        projected = white.T @ (basis.T @ image) @ white
        values, vectors = np.linalg.eigh((projected + projected.T) / 2)
        values, vectors = values[::-1], white @ vectors[:, ::-1]
        lead = vectors[:, :block]
        rest = image @ lead - (basis @ lead) * values[None, : lead.shape[1]]
        size = np.linalg.norm(rest, axis=0)
        top = max(values[0], 1e-300)
        trace.append(float(size[:k].max() / top))
        open_ = np.flatnonzero(size > tolerance * top)
        if trace[-1] <= tolerance or not len(open_) or white.shape[1] >= d:
            break
        if basis.shape[1] + len(open_) > min(d, 4 * block) + block:
            keep = vectors[:, : 2 * block]
            basis, image = basis @ keep, image @ keep
        new = rest[:, open_] / size[open_]
        for _ in range(2):  # the residuals of a restart are as good as those of the whole basis
            new -= basis @ np.linalg.lstsq(basis, new, rcond=None)[0]
            scale, turn = np.linalg.eigh(new.T @ new)
            good = scale > 1e-20
            new = new @ turn[:, good] / np.sqrt(scale[good])
        if not new.shape[1]:
            break
    else:
        import warnings

        warnings.warn(f"eigenvectors stopped at a residual of {trace[-1]:.1e}", stacklevel=2)
    return np.maximum(values[:k], 0.0), basis @ vectors[:, :k], trace


def project(rows: DataFrame, p: Projection) -> DataFrame:
    """Scores straight from the sparse rows: stored entries meet only their loadings."""
    weights = p.loadings / p.scale[:, None]
    shared = rows.sparkSession.sparkContext.broadcast((weights, p.centre @ weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, offset = shared.value
        k = weights.shape[1]
        for batch in batches:
            for lo, hi, starts, at, values in _runs(batch):
                scores = _times(starts, at, values, weights) - offset
                lists = pa.ListArray.from_arrays(np.arange(hi - lo + 1, dtype=np.int32) * k, pa.array(scores.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column("cell").slice(lo, hi - lo), lists], ["cell", "features"])

    kind = rows.schema["cell"].dataType.simpleString()
    return rows.mapInArrow(run, f"cell {kind}, features array<double>")


def fix_signs(loadings: np.ndarray) -> np.ndarray:
    """Each component's largest loading is positive, so results do not depend on the solver."""
    peak = np.argmax(np.abs(loadings), axis=0)
    return loadings * np.where(loadings[peak, np.arange(loadings.shape[1])] < 0, -1.0, 1.0)


def truncated_svd(m: Matrix, genes: DataFrame, k: int, seed: int = 42) -> tuple[Projection, DataFrame]:
    """The leading ``k`` singular directions without centring; scores are ``X v``."""
    names, positions = index_genes(genes)
    rows = cut_lineage(sparse_rows(m, positions))
    d = len(names)
    none = np.zeros(d)
    values, vectors, trace = eigenpairs(lambda v: multiply(rows, v, np.zeros(v.shape[1]))[0], d, k, seed)
    p = Projection(names, none, np.ones(d), fix_signs(vectors), np.sqrt(values), trace)
    return p, project(rows, p)


def centred_pca(m: Matrix, genes: DataFrame, k: int, scale: bool = False, seed: int = 42) -> tuple[Projection, DataFrame]:
    """Principal components of the centred (and, if asked, unit-variance) gene values.

    ``strength`` is the sample variance along each component; a gene without variance keeps its scale.
    """
    names, positions = index_genes(genes)
    rows = cut_lineage(sparse_rows(m, positions))
    d = len(names)
    centre, by = np.zeros(d), np.ones(d)
    stats = positions.join(gene_moments(m), "gene").select("idx", "n", "mean", "var").collect()
    for r in stats:
        centre[r["idx"]] = r["mean"]
        if scale and r["var"]:
            by[r["idx"]] = r["var"] ** 0.5
    n = stats[0]["n"] if stats else 0

    def product(v: np.ndarray) -> np.ndarray:
        w = v / by[:, None]
        raw, total = multiply(rows, w, centre @ w)
        return (raw - centre[:, None] * total) / (by[:, None] * max(1, n - 1))

    values, vectors, trace = eigenpairs(product, d, k, seed)
    p = Projection(names, centre, by, fix_signs(vectors), values, trace)
    return p, project(rows, p)


def explode_scores(scores: DataFrame) -> DataFrame:
    """``cell, pc, score`` with components numbered from 1."""
    return scores.select("cell", F.posexplode("features").alias("pc", "score")).withColumn("pc", F.col("pc") + 1)
