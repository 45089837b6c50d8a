"""Multiple-testing corrections without a global one-task sort."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillcell.session import cut_lineage


def _p_bucket(p):
    """A fixed monotone bucket of a p-value.

    Below 0.01 there are 64 buckets per factor of two of ``p``, above 0.99 as many of
    ``1 - p``, where one-sided tests crowd, and equal steps between. The bucket table has a
    constant bound whatever the data, and no bucket holds more than a sliver of the values.
    """
    small = F.floor(F.log2(F.greatest(p, F.lit(5e-324)) / 0.01) * 64)
    large = 98_001 - F.ceil(F.log2(F.greatest(1 - p, F.lit(2.0**-60)) / 0.01) * 64)
    middle = F.least(F.floor((p - 0.01) * 1e5), F.lit(98_000))
    return F.when(p < 0.01, F.least(small, F.lit(-1))).when(p > 0.99, F.greatest(large, F.lit(98_001))).otherwise(middle).cast("long")


def bh_thresholds(df: DataFrame, p: str = "p_val", q: str = "FDR") -> DataFrame:
    """``p, q`` for each distinct p-value (Benjamini and Hochberg 1995).

    With ties, only the largest rank of a tied group matters, so the ranks are running
    sums over distinct p-values: local to a bucket, plus the bucket's offset.
    """
    hist = (
        df.filter(F.col(p).isNotNull() & ~F.isnan(p))
        .groupBy(F.col(p).cast("double").alias("_p"))
        .agg(F.count("*").alias("_c"))
        .withColumn("_b", _p_bucket(F.col("_p")))
    )
    upto = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # suffix minima run in falling order: a frame that ends at the current row is one pass
    after = Window.orderBy(F.desc("_b")).rowsBetween(Window.unboundedPreceding, -1)
    local_up = Window.partitionBy("_b").orderBy("_p").rowsBetween(Window.unboundedPreceding, 0)
    local_down = Window.partitionBy("_b").orderBy(F.desc("_p")).rowsBetween(Window.unboundedPreceding, 0)
    # at most about 1.8e5 rows: the bucket range is fixed
    offsets = (
        hist.groupBy("_b").agg(F.sum("_c").alias("_bc"))
        .select("_b", F.coalesce(F.sum("_bc").over(upto), F.lit(0)).alias("_off"),
                F.sum("_bc").over(everything).alias("_m"))
    )
    raw = hist.join(offsets, "_b").withColumn(
        "_raw", F.col("_m") * F.col("_p") / (F.col("_off") + F.sum("_c").over(local_up))
    )
    later = raw.groupBy("_b").agg(F.min("_raw").alias("_bmin")).select(
        "_b", F.min("_bmin").over(after).alias("_later")
    )
    return raw.join(later, "_b").select(
        F.col("_p").alias(p),
        F.least(F.lit(1.0), F.min("_raw").over(local_down), F.col("_later")).alias(q),
    )


def benjamini_hochberg(df: DataFrame, p: str = "p_val", q: str = "FDR") -> DataFrame:
    """``df`` with the adjusted p-value ``q``; NULL and NaN p-values get NULL and are not counted.

    The p-values are written once: the ranks need several passes over them.
    """
    keyed = cut_lineage(df.withColumn("_k", F.when(~F.isnan(p), F.col(p).cast("double"))))
    table = bh_thresholds(keyed, p, q).select(F.col(p).alias("_k"), q)
    return keyed.join(table, "_k", "left").drop("_k")


def average_rank(df: DataFrame, by: list[str], value: str, name: str = "avg_rank") -> DataFrame:
    """Ranks with ties averaged, for groups whose size is bounded (comparisons of one cluster)."""
    ordered = Window.partitionBy(*by).orderBy(value)
    tied = Window.partitionBy(*by, value)
    return df.withColumn(name, F.rank().over(ordered) + (F.count("*").over(tied) - 1) / 2.0)


def simes(df: DataFrame, by: list[str], p: str = "p_val", name: str = "pvalue_simes") -> DataFrame:
    """Simes combination per group: ``min(m * p / average rank)``, at most one."""
    tested = df.filter(F.col(p).isNotNull())
    ranked = average_rank(tested, by, p, "_r")
    sized = ranked.withColumn("_m", F.count("*").over(Window.partitionBy(*by)))
    return sized.groupBy(*by).agg(
        F.least(F.lit(1.0), F.min(F.col("_m") * F.col(p) / F.col("_r"))).alias(name)
    )
