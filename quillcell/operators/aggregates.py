"""Per-gene, per-cell and per-cluster aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillcell.functions.exprs import is_mito
from quillcell.matrix import Matrix, zero_aware
from quillcell.operators.quantile import exact_quantile
from quillcell.session import cut_lineage


def reads_per_cell(m: Matrix) -> DataFrame:
    return m.expr.groupBy("cell").agg(F.sum("value").alias("reads"))


def reads_per_gene(m: Matrix) -> DataFrame:
    return m.expr.groupBy("gene").agg(F.sum("value").alias("reads"))


def genes_per_cell(m: Matrix) -> DataFrame:
    return m.expr.groupBy("cell").agg(F.count_if(F.col("value") > 0).alias("genes"))


def dropouts(m: Matrix) -> DataFrame:
    """Per gene: cells with and without it."""
    seen = m.expr.groupBy("gene").agg(F.count_if(F.col("value") > 0).alias("n_exp"))
    return seen.withColumn("dropouts", m.n_cells() - F.col("n_exp"))


def qc_features(m: Matrix, spikes: Matrix, rrna_genes: DataFrame | None = None) -> DataFrame:
    """Per cell: ln reads, genes detected, % rRNA, % mitochondrial, % spike-in reads.

    The spike-in reads are not part of the read total they are compared with.
    """
    tagged = m.expr.withColumn("is_rrna", F.lit(False)).withColumn("is_spike", F.lit(False))
    if rrna_genes is not None:
        flags = rrna_genes.select("gene").distinct().withColumn("_r", F.lit(True))
        tagged = (
            m.expr.join(flags, "gene", "left")
            .withColumn("is_rrna", F.coalesce("_r", F.lit(False))).drop("_r")
            .withColumn("is_spike", F.lit(False))
        )
    extra = spikes.expr.withColumn("is_rrna", F.lit(False)).withColumn("is_spike", F.lit(True))
    own = ~F.col("is_spike")
    total = F.sum(F.when(own, F.col("value")))
    per_cell = tagged.unionByName(extra).groupBy("cell").agg(
        total.alias("reads"),
        F.count_if(own & (F.col("value") > 0)).alias("genes"),
        F.coalesce(F.sum(F.when(F.col("is_rrna"), F.col("value"))), F.lit(0.0)).alias("rrna"),
        F.coalesce(F.sum(F.when(own & is_mito(), F.col("value"))), F.lit(0.0)).alias("mt"),
        F.coalesce(F.sum(F.when(F.col("is_spike"), F.col("value"))), F.lit(0.0)).alias("spike"),
    )
    return per_cell.filter(F.col("reads") > 0).select(
        "cell", "reads", F.ln("reads").alias("ln_reads"), "genes",
        *[(F.col(c) / F.col("reads") * 100).alias(f"perc_{c}") for c in ("rrna", "mt", "spike")],
    )


def three_sigma(df: DataFrame, col: str) -> DataFrame:
    """One row: mean, population sd and the outlier bounds of a column."""
    return df.agg(F.avg(col).alias("mean"), F.stddev_pop(col).alias("sd")).select(
        "mean", "sd", (F.col("mean") - 3 * F.col("sd")).alias("lower"), (F.col("mean") + 3 * F.col("sd")).alias("upper")
    )


def second_moment(m: Matrix) -> DataFrame:
    per_gene = m.expr.groupBy("gene").agg(F.sum(F.col("value") * F.col("value")).alias("s"))
    return per_gene.select("gene", (F.col("s") / m.n_cells()).alias("second_moment"))


def sizes(clusters: DataFrame) -> DataFrame:
    return clusters.groupBy("cluster").agg(F.count("*").alias("n"))


def grid(m: Matrix, clusters: DataFrame) -> DataFrame:
    """Every gene with every cluster and its size: the shape of the mean and median tables.

    The cluster list is one array of cluster rows, so the grid is a per-gene explode.
    """
    rows = sizes(clusters).agg(F.sort_array(F.collect_list(F.struct("cluster", "n"))).alias("a"))
    return m.genes.withColumn("_c", F.explode(rows.scalar())).select("gene", "_c.cluster", "_c.n")


def cluster_values(m: Matrix, clusters: DataFrame) -> DataFrame:
    return m.expr.join(clusters.select("cell", "cluster"), "cell")


def group_moments(m: Matrix, clusters: DataFrame) -> DataFrame:
    """``gene, cluster, n, mean, m2``, zeros included, for the full gene x cluster grid."""
    stored = cluster_values(m, clusters).groupBy("gene", "cluster").agg(
        F.count("*").alias("z"),
        F.avg("value").alias("mean_nz"),
        (F.var_pop("value") * F.count("*")).alias("m2_nz"),
    )
    full = grid(m, clusters).join(stored, ["gene", "cluster"], "left").na.fill(0, ["z", "mean_nz", "m2_nz"])
    mean, m2 = zero_aware(F.col("n"), F.col("z"), F.col("mean_nz"), F.col("m2_nz"))
    return full.select("gene", "cluster", "n", mean.alias("mean"), m2.alias("m2"))


def group_median(m: Matrix, clusters: DataFrame) -> DataFrame:
    """``gene, cluster, median``, zeros included.

    Where more than half of the cells have nothing stored, the median is 0 by the counts alone. For the
    rest, the zeros that are not stored enter as one weighted row per gene and cluster.
    """
    stored = cluster_values(m, clusters).groupBy("gene", "cluster", "value").agg(F.count("*").alias("w"))
    have = stored.groupBy("gene", "cluster").agg(F.sum("w").alias("z"))
    counts = cut_lineage(grid(m, clusters).join(have, ["gene", "cluster"], "left").select(
        "gene", "cluster", "n", (F.col("n") - F.coalesce("z", F.lit(0))).alias("w")))
    settled = counts.filter(2 * F.col("w") > F.col("n")).select("gene", "cluster", F.lit(0.0).alias("median"))
    open_ = counts.filter(2 * F.col("w") <= F.col("n"))
    rows = stored.join(open_.select("gene", "cluster"), ["gene", "cluster"], "left_semi").unionByName(
        open_.select("gene", "cluster", F.lit(0.0).alias("value"), "w"))
    return settled.unionByName(exact_quantile(rows, "value", 0.5, ["gene", "cluster"], "w", "median"))


def to_wide(df: DataFrame, column: str, value: str, labels: list | None = None) -> DataFrame:
    """Gene rows, one column per cluster or comparison."""
    grouped = df.groupBy("gene")
    pivoted = grouped.pivot(column, labels) if labels else grouped.pivot(column)
    return pivoted.agg(F.first(value))
