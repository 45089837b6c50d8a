"""Differential expression by pairwise linear-model contrasts of clusters.

With one indicator per cluster the least-squares coefficients are the cluster means and
the inverse normal matrix is ``diag(1 / n)``, so one ``(gene, cluster)`` aggregate holds
everything the tests need.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillcell.functions.distributions import student_t_sf
from quillcell.matrix import Matrix
from quillcell.operators.aggregates import group_moments
from quillcell.operators.multiplicity import benjamini_hochberg, simes


def contrast_statistics(moments: DataFrame, compat: bool = False) -> DataFrame:
    """All ordered cluster pairs per gene: ``t_stat, df, logFC, mean_A, mean_B``.

    A gene's cluster rows are gathered in one short array (one entry per cluster), and the
    pairs, which are the result rows, come from exploding it. Genes without residual
    variance get a NULL statistic. ``compat`` reports the unmirrored sign of ``t``.
    """
    per_gene = moments.groupBy("gene").agg(
        F.collect_list(F.struct("cluster", "n", "mean")).alias("cs"),
        F.sum("m2").alias("rss"), F.sum("n").alias("total"), F.count("*").alias("k"),
    )
    sides = per_gene.withColumn("a", F.explode("cs")).withColumn("b", F.explode("cs")).filter("a.cluster <> b.cluster")
    df = F.col("total") - F.col("k")
    sigma2 = F.col("rss") / F.nullif(df, F.lit(0))
    change = F.col("a.mean") - F.col("b.mean")
    error = F.sqrt(F.nullif(sigma2, F.lit(0.0)) * (1 / F.col("a.n") + 1 / F.col("b.n")))
    t = change / error
    out = sides.select(
        F.concat("a.cluster", F.lit("_vs_"), "b.cluster").alias("comparison"),
        F.col("a.cluster").alias("cluster"), F.col("b.cluster").alias("other"), "gene", df.alias("df"),
        t.alias("t_stat"), change.alias("logFC"), F.col("a.mean").alias("mean_A"), F.col("b.mean").alias("mean_B"),
    )
    if compat:
        out = out.withColumn("t_stat", F.when(F.col("cluster") < F.col("other"), -F.col("t_stat")).otherwise(F.col("t_stat")))
    return out


def _both_orders(stats: DataFrame) -> DataFrame:
    """``stats`` of one order of two clusters, and the mirrored rows; ``0 - x`` makes no negative zero."""
    turned = {
        "comparison": F.concat("other", F.lit("_vs_"), "cluster"), "cluster": F.col("other"), "other": F.col("cluster"),
        "t_stat": F.lit(0.0) - F.col("t_stat"), "logFC": F.lit(0.0) - F.col("logFC"), "mean_A": F.col("mean_B"), "mean_B": F.col("mean_A"),
    }
    orders = F.array(F.struct(*stats.columns), F.struct(*(turned.get(c, F.col(c)).alias(c) for c in stats.columns)))
    return stats.select(F.explode(orders).alias("_o")).select("_o.*")


def _p_value(t: Column, beyond: Column, direction: str) -> Column:
    """P-value for a positive ('up'), negative ('down') or any difference from the tail beyond ``abs(t)``."""
    if direction == "up":
        return F.when(t >= 0, beyond).otherwise(1 - beyond)
    if direction == "down":
        return F.when(t <= 0, beyond).otherwise(1 - beyond)
    return 2 * beyond


def pairwise_t_tests(m: Matrix, clusters: DataFrame, direction: str = "up", compat: bool = False) -> DataFrame:
    """The long table of all contrasts with p-values and one FDR over genes and contrasts.

    The tail beyond ``abs(t)`` is taken once for both orders of two clusters.
    """
    once = contrast_statistics(group_moments(m, clusters)).filter("cluster < other")
    beyond = once.withColumn("_q", F.when(F.col("t_stat").isNotNull(), student_t_sf(F.abs("t_stat"), F.col("df").cast("double"))))
    tested = _both_orders(beyond).withColumn("p_val", _p_value(F.col("t_stat"), F.col("_q"), direction)).drop("_q")
    out = benjamini_hochberg(tested, "p_val", "FDR")
    if compat:
        out = out.withColumn("t_stat", F.when(F.col("cluster") < F.col("other"), -F.col("t_stat")).otherwise(F.col("t_stat")))
    return out.select("comparison", "cluster", "other", "gene", "p_val", "FDR", "t_stat", "logFC", "mean_A", "mean_B")


def combine_tests(tests: DataFrame) -> DataFrame:
    """Simes p-value of each gene as a marker of each cluster."""
    return simes(tests, ["cluster", "gene"], "p_val", "pvalue_simes")


def discover_markers(m: Matrix, clusters: DataFrame, direction: str = "up") -> tuple[DataFrame, DataFrame]:
    tests = pairwise_t_tests(m, clusters, direction)
    return tests, combine_tests(tests)
