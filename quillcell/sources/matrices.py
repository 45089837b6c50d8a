"""Readers that turn matrix files into the long sparse form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillcell.matrix import Matrix
from quillcell.operators.filters import MatrixError, check_minimum, duplicated_genes
from quillcell.sources.lines import numbered_lines
from quillcell.sources.sniff import has_nul, Layout, _literal, check_columns, sniff

MTX_FILES = ("matrix.mtx", "barcodes.tsv", "genes.tsv")


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a plain, .gz or .bz2 text file."""
    return spark.read.text(path)


def wide_entries(lines: DataFrame, header: list[str] | None, layout: Layout) -> DataFrame:
    """``gene, cell, value`` of the non-zero fields of a gene-per-line text.

    Cells are columns, so each line is split and exploded in place; a schema with one
    column per cell is never built. ``header`` is the list of cell names.
    """
    body = lines.filter("value <> ''").select(F.split("value", _literal(layout.delimiter)).alias("f"))
    fields = body.select(F.element_at("f", 1).alias("gene"), F.posexplode(F.expr("slice(f, 2, size(f) - 1)")).alias("pos", "text"))
    entries = fields.withColumn("value", F.col("text").try_cast("double")).filter("value <> 0 OR value IS NULL")
    if header is None:
        cell = F.concat(F.lit("cell"), (F.col("pos") + 1).cast("string"))
    else:
        names = lines.sparkSession.createDataFrame([(header,)], "n array<string>").select("n").scalar()
        cell = F.element_at(names, F.col("pos") + 1)
    return entries.select("gene", cell.alias("cell"), "value")


def read_delimited(
    spark: SparkSession, path: str, delimiter: str = "auto", header: str = "auto", min_genes: int = 1000,
    on_duplicate: str = "error",
) -> Matrix:
    """A tab-, comma- or space-separated matrix with genes as rows, checked and made sparse."""
    lines = text_lines(spark, path)
    layout = sniff(lines, delimiter, header)
    check_columns(lines, layout)
    names = None
    body = lines
    if layout.header:
        first = lines.first()["value"]
        fields = first.split(layout.delimiter)
        names = fields[1:] if layout.id_cell else fields
        body = lines.filter(F.col("value") != first)
    genes = body.filter("value <> ''").select(F.substring_index("value", layout.delimiter, 1).alias("gene"))
    check_minimum(genes, min_genes, "genes")
    expr = wide_entries(body, names, layout)
    if expr.filter("value IS NULL").limit(1).count():
        # a file with NUL bytes is no text, whatever else fails in it
        if lines.filter(has_nul(F.col("value"))).limit(1).count():
            raise MatrixError("the file is binary and no container that can be read")
        raise MatrixError("the matrix has fields that are no numbers")
    twice = duplicated_genes(genes)
    if on_duplicate == "error":
        examples = [r["gene"] for r in twice.limit(20).collect()]
        if examples:
            raise MatrixError(f"duplicated genes: {examples}")
        return Matrix(expr)
    return Matrix(expr.join(twice.select("gene"), "gene", "left_anti"))


def read_matrix_market(spark: SparkSession, folder: str) -> Matrix:
    """The triple of coordinate entries, barcodes and genes; a gene is ``symbol_ensembl``.

    Row and column numbers are line numbers of the two name files, so both are joins.
    """
    genes = numbered_lines(spark, f"{folder}/genes.tsv", across_files=True).filter("value <> ''")
    parts = F.split("value", "\t")
    gene = F.when(F.size(parts) > 1, F.concat_ws("_", parts[1], parts[0])).otherwise(parts[0])
    genes = genes.select((F.col("line") + 1).alias("i"), gene.alias("gene"))
    cells = numbered_lines(spark, f"{folder}/barcodes.tsv", across_files=True).filter("value <> ''")
    cells = cells.select((F.col("line") + 1).alias("j"), F.split("value", "\t")[0].alias("cell"))
    lines = numbered_lines(spark, f"{folder}/matrix.mtx")
    # the size line follows the comments of the file that starts with the format line
    first = lines.filter((F.col("line") == 0) & F.col("value").startswith("%%MatrixMarket")).select("file")
    data = lines.filter(~F.col("value").startswith("%"))
    size_line = data.join(F.broadcast(first), "file", "left_semi").groupBy("file").agg(F.min("line").alias("size_line"))
    body = data.join(F.broadcast(size_line), "file", "left").filter("size_line IS NULL OR line > size_line")
    f = F.split(F.trim("value"), r"\s+")
    entries = body.select(f[0].cast("long").alias("i"), f[1].cast("long").alias("j"), f[2].cast("double").alias("value"))
    return Matrix(entries.join(genes, "i").join(cells, "j").select("gene", "cell", "value")).drop_zeros()


def read_triplets(spark: SparkSession, path: str) -> Matrix:
    """A counted ``gene, cell, count`` table with a header; repeated pairs are summed."""
    rows = spark.read.csv(path, sep="\t", header=True, schema="gene string, cell string, count long")
    return Matrix(rows.groupBy("gene", "cell").agg(F.sum("count").cast("double").alias("value")))
