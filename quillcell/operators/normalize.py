"""Library-size and length normalisation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillcell.functions.exprs import unversioned
from quillcell.matrix import Matrix
from quillcell.operators.aggregates import reads_per_cell


def with_cell_totals(m: Matrix) -> DataFrame:
    """Entries with their cell's total. A grouped sum and a join, not a window, so a cell
    that holds a large share of all entries is never one task's work."""
    return m.expr.join(reads_per_cell(m), "cell")


def log_share(value: Column, reads: Column, scale: float = 1e4) -> Column:
    """``log2(scale * x / cell total + 1)``."""
    return F.log2(value * scale / reads + 1)


def log_normalize(m: Matrix, scale: float = 1e4) -> Matrix:
    """``log_share`` of every entry."""
    return m.keep(with_cell_totals(m).withColumn("value", log_share(F.col("value"), F.col("reads"), scale)))


def rpkm(m: Matrix, lengths: DataFrame) -> Matrix:
    """``log2(reads per kilobase and million + 1)`` over genes with a known exon length.

    ``lengths`` is ``gene, length``; both sides are matched without version suffixes.
    """
    keyed = lengths.select(unversioned().alias("_k"), F.col("length").cast("double").alias("length"))
    matched = (
        m.expr.withColumn("_k", unversioned()).join(keyed, "_k").select("gene", "cell", "value", "length")
    )
    totals = matched.groupBy("cell").agg(F.sum("value").alias("reads"))
    per_kilobase = (F.col("value") / (F.col("reads") / 1e6)) / F.nullif(F.col("length") / 1000, F.lit(0.0))
    return m.keep(matched.join(totals, "cell").withColumn("value", F.log2(per_kilobase + 1)))


def normalize(m: Matrix, dataformat: str = "raw", lengths: DataFrame | None = None) -> Matrix:
    """The normalised matrix on the log2 scale for each input format."""
    if dataformat == "raw":
        return rpkm(m, lengths) if lengths is not None else log_normalize(m)
    if dataformat == "rpkm":
        return m.keep(m.expr.withColumn("value", F.log2(F.col("value") + 1)))
    return m


def unlog(m: Matrix) -> Matrix:
    """Back from the log2 scale: ``2^x - 1``."""
    return m.keep(m.expr.withColumn("value", F.pow(F.lit(2.0), F.col("value")) - 1))
