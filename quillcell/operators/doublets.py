"""Doublet scores from simulated doublets."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillcell.functions.exprs import half_even
from quillcell.matrix import Matrix
from quillcell.operators.hvg import seurat
from quillcell.operators.knn import exact_knn
from quillcell.operators.linalg import centred_pca
from quillcell.operators.normalize import log_normalize, log_share
from quillcell.operators.ranking import hash_index
from quillcell.session import cut_lineage

# Expected share of doublets, simulated per observed cell, components.
DOUBLET_RATE = 0.10
SIMULATED_RATIO = 2
SHARE_SIMULATED = 0.25


def sample_pairs(cells: DataFrame, n_sim: int, seed: int) -> DataFrame:
    """``doublet, cell``: two rows per simulated doublet, cells drawn with replacement.

    The draw is a hash of the doublet number, so a re-run task draws the same cells.
    """
    spark = cells.sparkSession
    index = hash_index(cells, "cell", "at", seed)
    n = cells.select("cell").distinct().agg(F.count("*")).scalar()
    draws = spark.range(n_sim).withColumn("side", F.explode(F.array(F.lit(1), F.lit(2)))).select(
        F.concat(F.lit("doublet-"), F.col("id").cast("string")).alias("doublet"),
        F.pmod(F.xxhash64(F.lit(seed), "id", "side"), n).alias("at"),
    )
    return draws.join(index, "at").select("doublet", "cell")


def simulate_doublets(m: Matrix, n_sim: int, seed: int) -> Matrix:
    """Counts of simulated doublets: the summed counts of two cells."""
    pairs = sample_pairs(m.cells, n_sim, seed)
    summed = pairs.join(m.expr, "cell").groupBy("gene", "doublet").agg(F.sum("value").alias("value"))
    return Matrix(summed.select("gene", F.col("doublet").alias("cell"), "value"))


def normalized_doublets(m: Matrix, genes: DataFrame, n_sim: int, seed: int) -> tuple[Matrix, DataFrame]:
    """Log-normalised counts of ``genes`` in the doublets of ``simulate_doublets``, and all doublets as ``cell``.

    A doublet's reads are those of its two cells, so only entries of the genes are put together.
    """
    pairs = cut_lineage(sample_pairs(m.cells, n_sim, seed))
    reads = m.expr.groupBy("cell").agg(F.sum("value").alias("reads"))
    totals = cut_lineage(pairs.join(reads, "cell").groupBy("doublet").agg(F.sum("reads").alias("reads")))
    kept = m.expr.join(F.broadcast(genes.select("gene")), "gene")  # as many genes as an option allows
    summed = pairs.join(kept, "cell").groupBy("gene", "doublet").agg(F.sum("value").alias("value")).join(totals, "doublet")
    expr = summed.select("gene", F.col("doublet").alias("cell"), log_share(F.col("value"), F.col("reads")).alias("value"))
    return Matrix(expr), totals.select(F.col("doublet").alias("cell"))


def simulated_neighbours(points: DataFrame, k: int, seed: int) -> DataFrame:
    """``cell, n_sim``: simulated cells among the ``k - 1`` nearest of each cell."""
    near = exact_knn(points, max(1, k - 1), seed)
    return near.groupBy(F.col("src").alias("cell")).agg(F.count_if(F.col("dst").startswith("doublet-")).alias("n_sim"))


def status(cell: str = "cell"):
    return F.when(F.col(cell).startswith("doublet-"), "sim").otherwise("obs")


def scrublet(m: Matrix, hvg_n: int = 1000, components: int = 30, seed: int = 42) -> DataFrame:
    """``cell, status, n_sim, score``: likelihood-ratio doublet scores (Wolock et al. 2019).

    Components come from z-scored variable genes of the observed cells; simulated cells
    are put on the same scale and axes.
    """
    norm = Matrix(cut_lineage(log_normalize(m).expr))
    n = norm.cells.count()
    genes = cut_lineage(seurat(norm, hvg_n).select("gene"))
    projection, observed = centred_pca(norm, genes, components, scale=True)
    doublets, cells = normalized_doublets(m, genes, n * SIMULATED_RATIO, seed)
    merged = cut_lineage(observed.unionByName(projection.apply(doublets, cells)))
    k = half_even(0.5 * math.sqrt(merged.count()))
    k_adj = half_even(k * (1 + SIMULATED_RATIO))
    rho, r = DOUBLET_RATE, float(SIMULATED_RATIO)
    q = (F.col("n_sim") + 1) / float(k_adj + 2)
    score = (q * rho / r) / (1 - rho - q * (1 - rho - rho / r))
    return simulated_neighbours(merged, k_adj, seed).select("cell", status().alias("status"), "n_sim", score.alias("score"))


def doublet_finder(m: Matrix, genes: DataFrame, components: int = 10, seed: int = 42) -> DataFrame:
    """``cell, n_sim, score``: share of simulated cells among the neighbours (McGinnis et al. 2019).

    Simulated doublets are a quarter of the observed cells and are normalised together
    with them; ``genes`` bounds the component analysis.
    """
    n = m.cells.count()
    doublets = simulate_doublets(m, half_even(n * SHARE_SIMULATED), seed)
    merged = Matrix(cut_lineage(log_normalize(Matrix(m.expr.unionByName(doublets.expr))).expr))
    scores = cut_lineage(centred_pca(merged, genes, components)[1])
    k = half_even(math.sqrt(merged.cells.count()))
    found = simulated_neighbours(scores, k, seed).filter(status() == "obs")
    return found.select("cell", "n_sim", (F.col("n_sim") / float(k)).alias("score"))
