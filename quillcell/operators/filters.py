"""Row and column filters of the count matrix (F01-F14) and their guards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillcell.functions.exprs import is_mito, is_spike
from quillcell.matrix import Matrix


class MatrixError(ValueError):
    """The input matrix fails a check."""


def count_violations(m: Matrix, dataformat: str) -> DataFrame:
    """One row of counts: what breaks the declared data format.

    raw: entries that are no whole numbers. log2: cells whose values are all whole,
    and entries above 1000. rpkm is not checked.
    """
    whole = F.col("value") == F.floor("value")
    if dataformat == "raw":
        return m.expr.agg(F.count_if(~whole).alias("fractional_entries"))
    per_cell = m.expr.groupBy("cell").agg(
        F.bool_and(whole).alias("all_whole"), F.count_if(F.col("value") > 1000).alias("large")
    )
    return per_cell.agg(
        F.count_if("all_whole").alias("whole_cells"),
        F.coalesce(F.sum("large"), F.lit(0)).alias("entries_above_1000"),
    )


def validate_counts(m: Matrix, dataformat: str) -> None:
    if dataformat == "rpkm":
        return
    found = count_violations(m, dataformat).first().asDict()
    wrong = {k: v for k, v in found.items() if v}
    if wrong:
        raise MatrixError(f"data do not look like {dataformat}: {wrong}")


def remove_empty(m: Matrix) -> Matrix:
    """Cells and genes without any entry vanish with their zeros."""
    return m.drop_zeros()


def remove_mito(m: Matrix) -> Matrix:
    return m.keep(m.expr.filter(~is_mito()))


def split_spikes(m: Matrix) -> tuple[Matrix, Matrix]:
    """``(endogenous, spike-in)`` views of the matrix."""
    return m.keep(m.expr.filter(~is_spike())), m.keep(m.expr.filter(is_spike()))


def exclude_genes(m: Matrix, pattern: str | None) -> Matrix:
    return m.keep(m.expr.filter(~F.col("gene").rlike(pattern))) if pattern else m


def cells_above(m: Matrix, minreads: float) -> DataFrame:
    return m.expr.groupBy("cell").agg(F.sum("value").alias("reads")).filter(F.col("reads") > minreads)


def min_reads(m: Matrix, minreads: float) -> Matrix:
    """Keep cells with more than ``minreads`` reads."""
    return m.keep(m.expr.join(cells_above(m, minreads).select("cell"), "cell", "left_semi"))


def genes_in_enough_cells(m: Matrix, minexpgenes: float) -> DataFrame:
    """Genes seen in more than ``minexpgenes`` cells; below one it is a share of all cells."""
    seen = m.expr.groupBy("gene").agg(F.count_if(F.col("value") > 0).alias("n_exp"))
    if float(minexpgenes).is_integer():
        return seen.filter(F.col("n_exp") > int(minexpgenes))
    return seen.filter(F.col("n_exp") / m.n_cells() > minexpgenes)


def min_expressed(m: Matrix, minexpgenes: float) -> Matrix:
    if minexpgenes <= 0:
        return m
    return m.keep(m.expr.join(genes_in_enough_cells(m, minexpgenes).select("gene"), "gene", "left_semi"))


def drop_cells(m: Matrix, cells: DataFrame) -> Matrix:
    return m.keep(m.expr.join(cells.select("cell"), "cell", "left_anti"))


def keep_cells(m: Matrix, cells: DataFrame) -> Matrix:
    return m.keep(m.expr.join(cells.select("cell"), "cell", "left_semi"))


def keep_genes(m: Matrix, genes: DataFrame) -> Matrix:
    return m.keep(m.expr.join(genes.select("gene"), "gene", "left_semi"))


def drop_duplicated_genes(rows: DataFrame, gene: str = "gene") -> DataFrame:
    """Remove every copy of a gene that has more than one row."""
    twice = rows.groupBy(gene).count().filter("count > 1").select(gene)
    return rows.join(twice, gene, "left_anti")


def duplicated_genes(rows: DataFrame, gene: str = "gene") -> DataFrame:
    return rows.groupBy(gene).agg(F.count("*").alias("copies")).filter("copies > 1")


def cluster_sizes(clusters: DataFrame) -> DataFrame:
    return clusters.groupBy("cluster").agg(F.count("*").alias("size"))


def target_clusters(clusters: DataFrame, ignore_small: int) -> DataFrame:
    """Clusters with more than ``ignore_small`` cells."""
    return cluster_sizes(clusters).filter(F.col("size") > ignore_small)


def in_target_clusters(clusters: DataFrame, ignore_small: int) -> DataFrame:
    return clusters.join(target_clusters(clusters, ignore_small).select("cluster"), "cluster", "left_semi")


def highlight(cells: DataFrame, chosen: DataFrame) -> DataFrame:
    """All cells with a flag for the chosen ones."""
    marked = chosen.select("cell").distinct().withColumn("_hit", F.lit(True))
    return cells.join(marked, "cell", "left").withColumn(
        "highlighted", F.coalesce("_hit", F.lit(False))
    ).drop("_hit")


def check_minimum(df: DataFrame, at_least: int, what: str) -> None:
    """Raise unless ``df`` has ``at_least`` rows; reads no more than that many."""
    found = df.limit(at_least).count()
    if found < at_least:
        raise MatrixError(f"only {found} {what} left, need {at_least}")


def positive(col: str) -> Column:
    return F.col(col) > 0
