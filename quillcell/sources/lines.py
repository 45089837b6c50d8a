"""Text lines with their position in the file, read in parallel."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillcell.session import cut_lineage

#: Lines of records that a task sorts.
_LINES = 1 << 18


def numbered_lines(spark: SparkSession, path: str, across_files: bool = False) -> DataFrame:
    """``file, line, value`` with 0-based line numbers, per file or through all files by name.

    Every input split numbers its own lines; the offset of a split is the line count of the
    earlier splits. Only the per-split counts go through a window.
    """
    raw = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("_id"), "value",
    )
    raw = cut_lineage(raw)
    blocks = raw.groupBy("file", "block").agg(F.count("*").alias("n"), F.min("_id").alias("first"))
    order = Window.orderBy("file", "block") if across_files else Window.partitionBy("file").orderBy("block")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    offsets = blocks.select("file", "block", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("off"))
    # a row per split; without the hint all lines of a split would meet in one task
    return raw.join(F.broadcast(offsets), ["file", "block"]).select(
        "file", (F.col("off") + F.col("_id") - F.col("first")).alias("line"), "value"
    )


def fastq(spark: SparkSession, path: str) -> DataFrame:
    """``id, seq, plus, qual`` records of four lines; .gz and .bz2 are read by suffix.

    Lines are dealt by record to as many tasks as they ask for, and sorted there and not before.
    """
    lines = numbered_lines(spark, path).withColumn("record", F.floor(F.col("line") / 4))
    lines = lines.repartition(max(1, -(-lines.count() // _LINES)), "file", "record")
    at = F.col("line") % 4
    parts = [F.max(F.when(at == i, F.col("value"))).alias(n) for i, n in enumerate(("id", "seq", "plus", "qual"))]
    return lines.groupBy("file", "record").agg(*parts).select("record", "id", "seq", "plus", "qual")


def broken_fastq(records: DataFrame) -> DataFrame:
    """Records whose first line lacks '@' or whose third lacks '+'."""
    return records.filter(~F.col("id").startswith("@") | ~F.col("plus").startswith("+") | F.col("qual").isNull())


def write_fastq(records: DataFrame, path: str) -> None:
    records.select(F.concat_ws("\n", "id", "seq", F.lit("+"), "qual").alias("value")).write.text(path)
