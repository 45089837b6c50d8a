"""The long sparse matrix every operator works on.

One row per stored entry: ``gene, cell, value``; zeros are not stored. A statistic
over all cells therefore needs the number of cells, which is carried as a scalar
subquery and never as a driver value.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillcell.session import cut_lineage


@dataclass(frozen=True)
class Matrix:
    expr: DataFrame

    def keep(self, expr: DataFrame) -> "Matrix":
        return Matrix(expr.select("gene", "cell", "value"))

    @property
    def genes(self) -> DataFrame:
        return self.expr.select("gene").distinct()

    @property
    def cells(self) -> DataFrame:
        return self.expr.select("cell").distinct()

    def n_cells(self) -> Column:
        return self.cells.agg(F.count("*").alias("n_cells")).scalar()

    def n_genes(self) -> Column:
        return self.genes.agg(F.count("*").alias("n_genes")).scalar()

    def stored(self) -> "Matrix":
        """The matrix written once, for plans that read it several times."""
        return Matrix(cut_lineage(self.expr))

    def drop_zeros(self) -> "Matrix":
        return Matrix(self.expr.filter(F.col("value") != 0))


def zero_aware(n: Column, z: Column, mean_nz: Column, m2_nz: Column) -> tuple[Column, Column]:
    """Mean and sum of squared deviations over ``n`` values, ``z`` of them stored.

    The stored values have mean ``mean_nz`` and squared deviations ``m2_nz``; the other
    ``n - z`` values are zero.
    """
    mean = z * mean_nz / n
    m2 = m2_nz + mean_nz * mean_nz * z * (n - z) / n
    return mean, m2


def gene_moments(m: Matrix) -> DataFrame:
    """``gene, n, z, mean, m2, var`` over all cells in one aggregation."""
    stored = m.expr.groupBy("gene").agg(
        F.count("*").alias("z"),
        F.avg("value").alias("mean_nz"),
        (F.coalesce(F.var_pop("value"), F.lit(0.0)) * F.count("*")).alias("m2_nz"),
    )
    mean, m2 = zero_aware(F.col("n"), F.col("z"), F.col("mean_nz"), F.col("m2_nz"))
    return (
        stored.withColumn("n", m.n_cells())
        .select("gene", "n", "z", mean.alias("mean"), m2.alias("m2"))
        .withColumn("var", F.col("m2") / F.nullif(F.col("n") - 1, F.lit(0)))
    )
