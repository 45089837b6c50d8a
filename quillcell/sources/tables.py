"""Side tables: annotations, clusterings, markers, symbols, exon lengths, barcodes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillcell.functions.exprs import unversioned
from quillcell.operators.filters import MatrixError

DEFAULT_ANNOTATION = "no annotation"


def annotations(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", schema="gene string, desc string")


def annotate(genes: DataFrame, anno: DataFrame) -> DataFrame:
    """Every gene with its description, or a default."""
    return genes.join(anno, "gene", "left").withColumn("desc", F.coalesce("desc", F.lit(DEFAULT_ANNOTATION)))


def clustering(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", schema="cell string, cluster string")


def match_clustering(cells: DataFrame, given: DataFrame) -> DataFrame:
    """A given clustering restricted to the matrix; every cell must have a cluster."""
    missing = cells.join(given, "cell", "left_anti").limit(1).count()
    if missing:
        raise MatrixError("the given clustering does not cover all cells")
    return given.join(cells, "cell", "left_semi")


def markers(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.csv(path, sep="\t", header=True)
    return raw.select(
        "species", F.col("official gene symbol").alias("gene"), F.col("cell type").alias("cell_type"),
        F.col("ubiquitousness index").cast("double").alias("ui"),
    )


def symbols(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", schema="ensembl string, symbol string")


def exon_lengths(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.csv(path, sep=" ", schema="gene string, length long")
    return raw.withColumn("gene", unversioned())


def barcodes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep=" ", schema="bc string, freq long")
