"""Count matrices and side tables derived from the benchmark tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillcell.matrix import Matrix


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def line_counts(spark: SparkSession, sf: str) -> Matrix:
    """Parts as genes, suppliers as cells, summed quantity as count."""
    li = table(spark, sf, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.sum("l_quantity").alias("value"))
    return Matrix(li.select(F.col("l_partkey").cast("string").alias("gene"),
                            F.col("l_suppkey").cast("string").alias("cell"), "value"))


def gene_names(spark: SparkSession, sf: str) -> DataFrame:
    """Part keys with names that carry mitochondrial and spike-in prefixes."""
    prefix = (
        F.when(F.col("p_name").startswith("blue"), "mt-")
        .when(F.col("p_brand") == "Brand#11", "ERCC-").otherwise("g")
    )
    return table(spark, sf, "part").select(
        F.col("p_partkey").cast("string").alias("key"),
        F.concat(prefix, F.col("p_partkey").cast("string")).alias("gene"),
        "p_type", "p_brand", "p_size", "p_name",
    )


def named_counts(spark: SparkSession, sf: str) -> Matrix:
    """``line_counts`` with prefixed gene names."""
    names = gene_names(spark, sf).select("key", F.col("gene").alias("name"))
    expr = line_counts(spark, sf).expr.join(names, F.col("gene") == F.col("key"))
    return Matrix(expr.select(F.col("name").alias("gene"), "cell", "value"))


def supplier_clusters(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers (cells) by the region of their nation."""
    nation = table(spark, sf, "nation").select("n_nationkey", "n_regionkey")
    return (
        table(spark, sf, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
        .select(F.col("s_suppkey").cast("string").alias("cell"), F.col("n_regionkey").cast("string").alias("cluster"))
    )


def token_counts(spark: SparkSession, sf: str) -> Matrix:
    """Words as genes, documents as cells.

    Texts are dealt out by document before they are split: their words are then counted, and a
    document's total is taken, where they are, and no word is sent on.
    """
    texts = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("cell"), "text").repartition("cell")
    words = texts.select(F.explode(F.split(F.lower("text"), "[ \\n\\t\\r]+")).alias("gene"), "cell").filter(F.col("gene") != "")
    return Matrix(words.groupBy("gene", "cell").agg(F.count("*").cast("double").alias("value")))


def embedding_matrix(spark: SparkSession, sf: str) -> Matrix:
    """Vector positions as genes, vectors as cells; values may be negative."""
    e = table(spark, sf, "embeddings").select(
        F.posexplode("embedding").alias("gene", "value"), F.col("vec_id").cast("string").alias("cell")
    )
    return Matrix(e.select(F.col("gene").cast("string").alias("gene"), "cell", F.col("value").cast("double").alias("value")))


def embedding_points(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").cast("string").alias("cell"), F.col("embedding").cast("array<double>").alias("features")
    )


def embedding_clusters(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").cast("string").alias("cell"), F.col("label").cast("string").alias("cluster")
    )


def brand_markers(spark: SparkSession, sf: str) -> DataFrame:
    """Gene sets: parts (genes) listed under their brand (cell type); ``ui`` follows the part size."""
    return table(spark, sf, "part").select(
        F.when(F.col("p_size") % 3 == 0, "Mm Hs").when(F.col("p_size") % 3 == 1, "Mm").otherwise("Hs").alias("species"),
        F.col("p_partkey").cast("string").alias("gene"),
        F.col("p_brand").alias("cell_type"),
        (F.col("p_size") / 1000.0).alias("ui"),
    ).unionByName(
        table(spark, sf, "part").select(
            F.lit("Mm Hs").alias("species"), F.col("p_partkey").cast("string").alias("gene"),
            F.col("p_type").alias("cell_type"), F.lit(0.01).alias("ui"),
        )
    )
