"""Read-level operators ahead of the count matrix: barcodes, UMIs, qualities, exons."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillcell.session import cut_lineage

# Read layout, filters and the quality ranges of the known encodings.
BARCODE_LENGTH = 12
UMI_LENGTH = 8
MAX_N = 10
MIN_MAPQ = 60
QUALITY_LOW, QUALITY_HIGH = 33, 104
ENCODINGS = (
    ("Sanger", 33, 73),
    ("Solexa", 59, 104),
    ("Illumina 1.3+", 64, 104),
    ("Illumina 1.5+", 66, 104),
    ("Illumina 1.8+", 33, 74),
)


def tag_reads(reads: DataFrame) -> DataFrame:
    """``id, seq, qual`` with the barcode and UMI cut off the read and put into the id."""
    bc = F.substring("seq", 1, BARCODE_LENGTH)
    umi = F.substring("seq", BARCODE_LENGTH + 1, UMI_LENGTH)
    start = BARCODE_LENGTH + UMI_LENGTH + 1
    return reads.select(
        F.concat_ws("_", F.regexp_extract("id", r"^(\S+)", 1), bc, umi).alias("id"), bc.alias("bc"), umi.alias("umi"),
        F.expr(f"substring(seq, {start})").alias("seq"), F.expr(f"substring(qual, {start})").alias("qual"),
    )


def barcode_counts(reads: DataFrame) -> DataFrame:
    return reads.groupBy(F.substring("seq", 1, BARCODE_LENGTH).alias("bc")).agg(F.count("*").alias("freq"))


def top_barcodes(counts: DataFrame, n: int = 10) -> DataFrame:
    return counts.orderBy(F.desc("freq"), "bc").limit(n)


def whitelist(counts: DataFrame, min_freq: int) -> DataFrame:
    """Frequent barcodes that are not one base repeated."""
    return counts.filter((F.col("freq") >= min_freq) & ~F.col("bc").rlike("^(A+|C+|G+|T+)$"))


def keep_reads(reads: DataFrame, barcodes: DataFrame) -> DataFrame:
    """Reads with a listed barcode and fewer than ten unknown bases."""
    unknown = F.length("seq") - F.length(F.replace("seq", F.lit("N"), F.lit("")))
    return (
        reads.filter(unknown < MAX_N).withColumn("bc", F.substring("seq", 1, BARCODE_LENGTH))
        .join(barcodes.select("bc"), "bc", "left_semi").drop("bc")
    )


def high_quality_alignments(alignments: DataFrame) -> DataFrame:
    return alignments.filter(F.col("mapq") >= MIN_MAPQ)


def umi_counts(tagged: DataFrame) -> DataFrame:
    """Distinct UMIs per gene and cell, as two plain aggregations."""
    return tagged.select("gene", "cell", "umi").distinct().groupBy("gene", "cell").agg(F.count("*").alias("count"))


def quality_range(reads: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Smallest and largest quality character code."""
    codes = F.transform(F.split("qual", ""), lambda c: F.ascii(c))
    codes = F.filter(codes, lambda c: c > 0)
    return reads.select(*(by or []), F.array_min(codes).alias("lo"), F.array_max(codes).alias("hi")).groupBy(*(by or [])).agg(
        F.min("lo").alias("min"), F.max("hi").alias("max")
    )


def quality_encodings(ranges: DataFrame) -> DataFrame:
    """Every encoding whose range holds the observed one; 'corrupt' outside all of them."""
    fits = F.array(*[F.when((F.col("min") >= lo) & (F.col("max") <= hi), F.lit(n)) for n, lo, hi in ENCODINGS])
    names = F.concat_ws(", ", F.array_compact(fits))
    bad = (F.col("min") < QUALITY_LOW) | (F.col("max") > QUALITY_HIGH)
    return ranges.withColumn("encodings", F.when(bad, "corrupt").otherwise(names))


def merge_intervals(intervals: DataFrame, by: str = "gene", width: int = 65536) -> DataFrame:
    """Union of ``start, stop`` ranges per key; ranges that touch become one.

    The running maximum of ``stop`` is taken inside bins of ``width`` positions and carried
    over from earlier bins, so a key with very many ranges is spread over its bins.
    """
    rows = intervals.select(by, "start", "stop").groupBy(by, "start").agg(F.max("stop").alias("stop"))
    rows = rows.withColumn("_b", F.floor(F.col("start") / width))
    earlier = Window.partitionBy(by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    carry = rows.groupBy(by, "_b").agg(F.max("stop").alias("_m")).select(by, "_b", F.max("_m").over(earlier).alias("_carry"))
    local = Window.partitionBy(by, "_b").orderBy("start")
    before = F.max("stop").over(local.rowsBetween(Window.unboundedPreceding, -1))
    marked = rows.join(carry, [by, "_b"]).withColumn("_prev", F.greatest(before, F.col("_carry"))).withColumn(
        "_new", F.when(F.col("_prev").isNull() | (F.col("_prev") < F.col("start")), 1).otherwise(0)
    )
    marked = marked.withColumn("_k", F.sum("_new").over(local.rowsBetween(Window.unboundedPreceding, 0)))
    starts = marked.groupBy(by, "_b").agg(F.sum("_new").alias("_n")).select(
        by, "_b", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_off")
    )
    return (
        marked.join(starts, [by, "_b"]).groupBy(by, (F.col("_off") + F.col("_k")).alias("_island"))
        .agg(F.min("start").alias("start"), F.max("stop").alias("stop")).drop("_island")
    )


def exon_rows(lines: DataFrame) -> DataFrame:
    """Exons of a GTF text without comments, retained introns and one-base features."""
    f = F.split("value", "\t")
    kept = lines.filter(~F.col("value").startswith("#") & ~F.col("value").contains("retained_intron"))
    rows = kept.select(
        f[0].alias("chrom"), f[2].alias("feature"), f[3].cast("long").alias("start"), f[4].cast("long").alias("stop"),
        f[6].alias("strand"),
        F.regexp_extract("value", r'gene_name "(\S+)"', 1).alias("symbol"),
        F.regexp_extract("value", r'gene_id "(\S+)\.[^"]+"', 1).alias("ensembl"),
        F.regexp_extract("value", r'transcript_type "(.*?)"', 1).alias("transcript_type"),
    )
    return rows.filter((F.col("start") != F.col("stop")) & (F.col("feature") == "exon")).select(
        F.concat_ws("_", "symbol", "ensembl").alias("gene"), "chrom", "start", "stop", "strand", "transcript_type"
    )


def metagenes(exons: DataFrame, width: int = 65536) -> DataFrame:
    """Merged exons with the gene's chromosome, strand and sorted transcript types.

    Exons that begin at one place are put together first, and written, so that their text is parsed once.
    """
    exons = cut_lineage(exons.groupBy("gene", "chrom", "start", "strand", "transcript_type").agg(F.max("stop").alias("stop")))
    about = exons.groupBy("gene").agg(
        F.min(F.struct("start", "chrom", "strand")).alias("_f"),
        F.concat_ws(",", F.sort_array(F.collect_set("transcript_type"))).alias("types"),
    ).select("gene", "_f.chrom", "_f.strand", "types")
    return merge_intervals(exons, "gene", width).join(about, "gene")


def metagene_lines(merged: DataFrame) -> DataFrame:
    """GTF text of merged exons."""
    fmt = ('%s\tGENCODE.metagenes\texon\t%s\t%s\t1000\t%s\t.\tgene_id "%s"; gene_name "%s"; '
           'transcript_id "%s"; transcript_types "%s"')
    return merged.select(
        F.format_string(fmt, "chrom", F.col("start").cast("string"), F.col("stop").cast("string"), "strand", "gene", "gene", "gene", "types").alias("value")
    )


def rrna_genes(lines: DataFrame) -> DataFrame:
    """Genes of GTF lines that mention ``"rRNA"``, without version."""
    attrs = F.split("value", "\t")[8]
    hits = lines.filter(F.col("value").contains('"rRNA"'))
    return hits.select(F.regexp_extract(attrs, r'^gene_id "(.*?)\..*";', 1).alias("gene")).filter("gene <> ''").distinct()
