"""The tables behind every plot."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillcell.matrix import Matrix
from quillcell.operators.aggregates import genes_per_cell, group_moments, reads_per_cell
from quillcell.operators.ranking import count_above
from quillcell.session import cut_lineage


def _position(df: DataFrame, value: str) -> DataFrame:
    """Bars by height: one plus the number of cells with a larger value; ties share it.

    The bars are written once, so that what they are counted from is read once.
    """
    df = cut_lineage(df)
    placed = count_above(df, value).select(value, (F.col("above") + 1).alias("position"))
    return df.join(placed, value)


def read_count_bars(m: Matrix, minreads: float) -> DataFrame:
    """Reads per cell in falling order with a pass flag."""
    bars = _position(reads_per_cell(m), "reads")
    return bars.withColumn("status", F.when(F.col("reads") < minreads, "Removed").otherwise("Passed"))


def expressed_gene_bars(m: Matrix) -> DataFrame:
    """Genes detected per cell in falling order."""
    return _position(genes_per_cell(m), "genes")


def cluster_scatter(embedding: DataFrame, clusters: DataFrame, best: DataFrame) -> DataFrame:
    """Coordinates, cluster, its size, its cell type and adjusted p-value."""
    sizes = clusters.groupBy("cluster").agg(F.count("*").alias("size"))
    legend = sizes.join(best.select("cluster", "cell_type", "padj"), "cluster", "left")
    return embedding.join(clusters, "cell").join(legend, "cluster").select("cell", "x", "y", "cluster", "size", "cell_type", "padj")


def gene_overlay(m: Matrix, embedding: DataFrame, gene: str, by_symbol: bool = True) -> DataFrame:
    """Every cell of the embedding with its expression of one gene (zero when absent).

    With ``by_symbol`` the name is compared with the text before the last underscore.
    """
    name = F.upper(F.regexp_replace("gene", "_[^_]*$", "") if by_symbol else F.col("gene"))
    hits = m.expr.filter(name == gene.upper()).groupBy("cell").agg(F.sum("value").alias("value"))
    return embedding.join(hits, "cell", "left").select("cell", "x", "y", F.coalesce("value", F.lit(0.0)).alias("value"))


def genes_per_cluster(m: Matrix, clusters: DataFrame) -> DataFrame:
    """Genes detected per cell with the cell's cluster."""
    return genes_per_cell(m).join(clusters, "cell").select("cluster", "cell", "genes")


def top_genes_per_cluster(m: Matrix, clusters: DataFrame, top: int = 10, digits: int | None = None) -> DataFrame:
    """The ``top`` genes of each cluster by mean; the row limit is applied before the shuffle.

    With ``digits`` means that agree to so many places count as ties, which go by name.
    """
    means = group_moments(m, clusters).select("gene", "cluster", "mean")
    mean = F.col("mean") if digits is None else F.round("mean", digits)
    w = Window.partitionBy("cluster").orderBy(mean.desc(), F.asc("gene"))
    return means.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top)


def top_gene_values(m: Matrix, clusters: DataFrame, top: int = 10, digits: int | None = None) -> DataFrame:
    """The values of each cluster's top genes in its cells, zeros included."""
    genes = top_genes_per_cluster(m, clusters, top, digits).select("cluster", "gene", "rank")
    wanted = genes.join(clusters, "cluster")
    return wanted.join(m.expr, ["gene", "cell"], "left").select(
        "cluster", "gene", "rank", "cell", F.coalesce("value", F.lit(0.0)).alias("value")
    )


def marker_heatmap(m: Matrix, clusters: DataFrame, best: DataFrame, markers: DataFrame, extra_types: str | None = None) -> DataFrame:
    """Expression of the markers of the called cell types, with the types each gene serves.

    ``extra_types`` is a comma-separated list of further cell types whose whole marker
    lists are shown. Genes sort by their types, cells by cluster.
    """
    called = best.filter(F.col("cell_type") != "Unknown").select("cell_type", F.explode(F.split("markers", ",")).alias("gene"))
    called = called.filter(F.col("gene") != "NA")
    if extra_types:
        names = [t.strip().upper() for t in extra_types.split(",")]
        called = called.unionByName(markers.filter(F.upper("cell_type").isin(names)).select("cell_type", "gene"))
    per_gene = called.dropDuplicates(["cell_type", "gene"]).groupBy("gene").agg(
        F.concat_ws(",", F.sort_array(F.collect_set("cell_type"))).alias("cell_types")
    )
    hits = m.expr.withColumn("symbol", F.upper("gene")).join(per_gene.select(F.upper("gene").alias("symbol"), "cell_types"), "symbol")
    return hits.join(clusters, "cell").select("cell_types", "gene", "cluster", "cell", "value")
