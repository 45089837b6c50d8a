"""Queries for reads, barcodes, UMIs, qualities and exon intervals."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillcell.operators import reads as RD
from quillcell.plans import adapters as ad
from quillcell.plans.catalog import query
from quillcell.session import scratch_path
from quillcell.sources import lines as LN
from quillcell.sources import sinks as SK
from quillcell.sources import tables as TB

# Reads made from the orders: a short barcode alphabet so barcodes repeat.
READS = """rd AS (SELECT o_orderkey AS k, '@r' || CAST(o_orderkey AS VARCHAR) || ' x' AS id,
 repeat(substr('ACGT', CAST(o_custkey % 4 AS INTEGER) + 1, 1), 6) || translate(substr(md5(CAST(o_custkey % 11 AS VARCHAR)), 1, 6), '0123456789abcdef', 'ACGTACGTACGTACGT')
 || translate(md5(CAST(o_orderkey AS VARCHAR)), '0123456789abcdef', 'ACGTNNACGTNNACGT') AS seq,
 upper(md5(CAST(o_orderkey AS VARCHAR))) || '456789ABCDEF' AS qual FROM orders)"""


def reads(spark, sf):
    key, cust = F.col("o_orderkey").cast("string"), F.col("o_custkey")
    base = F.substr(F.lit("ACGT"), (cust % 4 + 1).cast("int"), F.lit(1))
    mid = F.translate(F.substring(F.md5((cust % 11).cast("string").cast("binary")), 1, 6), "0123456789abcdef", "ACGTACGTACGTACGT")
    tail = F.translate(F.md5(key.cast("binary")), "0123456789abcdef", "ACGTNNACGTNNACGT")
    return ad.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("k"), F.concat(F.lit("@r"), key, F.lit(" x")).alias("id"),
        F.concat(F.repeat(base, F.lit(6)), mid, tail).alias("seq"),
        F.concat(F.upper(F.md5(key.cast("binary"))), F.lit("456789ABCDEF")).alias("qual"),
    )


@query("T04_tag_reads", f"""WITH {READS} SELECT '@r' || CAST(k AS VARCHAR) || '_' || substr(seq, 1, 12) || '_' || substr(seq, 13, 8) AS id,
 substr(seq, 1, 12) AS bc, substr(seq, 13, 8) AS umi, substr(seq, 21) AS seq, substr(qual, 21) AS qual FROM rd""")
def t04(spark, sf):
    return RD.tag_reads(reads(spark, sf))


@query("A22_barcode_counts", f"WITH {READS} SELECT substr(seq, 1, 12) AS bc, count(*) AS freq FROM rd GROUP BY 1")
def a22(spark, sf):
    return RD.barcode_counts(reads(spark, sf))


@query("W16_top_barcodes", f"WITH {READS} SELECT substr(seq, 1, 12) AS bc, count(*) AS freq FROM rd GROUP BY 1 ORDER BY freq DESC, bc LIMIT 10")
def w16(spark, sf):
    return RD.top_barcodes(RD.barcode_counts(reads(spark, sf)))


LISTED = "wl AS (SELECT substr(seq, 1, 12) AS bc, count(*) AS freq FROM rd GROUP BY 1 HAVING count(*) >= 50 AND NOT regexp_matches(substr(seq, 1, 12), '^(A+|C+|G+|T+)$'))"


@query("F22_S27_whitelist", f"WITH {READS}, {LISTED} SELECT bc, freq FROM wl")
def f22(spark, sf):
    path = scratch_path(spark, "barcodes")
    SK.write_csv(RD.barcode_counts(reads(spark, sf)).select("bc", "freq"), path, " ")
    return RD.whitelist(TB.barcodes(spark, path), 50)


@query("F21_keep_reads", f"WITH {READS}, {LISTED} SELECT k, seq FROM rd WHERE substr(seq, 1, 12) IN (SELECT bc FROM wl) AND length(seq) - length(replace(seq, 'N', '')) < 10")
def f21(spark, sf):
    r = reads(spark, sf)
    return RD.keep_reads(r, RD.whitelist(RD.barcode_counts(r), 50)).select("k", "seq")


@query("F23_mapq_filter", "SELECT l_orderkey, l_linenumber, CAST(l_quantity AS BIGINT) + 30 AS mapq FROM lineitem WHERE CAST(l_quantity AS BIGINT) + 30 >= 60")
def f23(spark, sf):
    a = ad.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_quantity").cast("long") + 30).alias("mapq"))
    return RD.high_quality_alignments(a)


@query("A23_umi_counts", """SELECT CAST(l_partkey AS VARCHAR) AS gene, CAST(l_suppkey AS VARCHAR) AS cell, count(DISTINCT CAST(l_quantity AS BIGINT)) AS count FROM lineitem GROUP BY 1, 2""")
def a23(spark, sf):
    return RD.umi_counts(ad.table(spark, sf, "lineitem").select(
        F.col("l_partkey").cast("string").alias("gene"), F.col("l_suppkey").cast("string").alias("cell"), F.col("l_quantity").cast("long").alias("umi")))


@query("S26_K19_fastq_file", f"WITH {READS} SELECT id, seq, '+' AS plus, qual FROM rd")
def s26(spark, sf):
    path = scratch_path(spark, "fastq")
    LN.write_fastq(reads(spark, sf), path)
    return LN.fastq(spark, path).drop("record")


@query("S30_fastq_gzip_quality", f"""WITH {READS}, c AS (SELECT unnest(string_split(qual, '')) AS ch FROM rd)
SELECT CAST(min(ascii(ch)) AS INTEGER) AS min, CAST(max(ascii(ch)) AS INTEGER) AS max FROM c""")
def s30(spark, sf):
    path = scratch_path(spark, "fastq-gz")
    r = reads(spark, sf)
    r.select(F.concat_ws("\n", "id", "seq", F.lit("+"), "qual").alias("value")).write.option("compression", "gzip").text(path)
    return RD.quality_range(LN.fastq(spark, path))


@query("T03_quality_encodings", """WITH q AS (SELECT lang, CASE WHEN lang = 'en' THEN upper(md5(CAST(doc_id AS VARCHAR))) WHEN lang = 'de' THEN translate(md5(CAST(doc_id AS VARCHAR)), '0123456789', 'ghghghghgh') ELSE md5(CAST(doc_id AS VARCHAR)) END AS qual FROM documents),
c AS (SELECT lang, ascii(unnest(string_split(qual, ''))) AS a FROM q), r AS (SELECT lang, min(a) AS lo, max(a) AS hi FROM c GROUP BY 1)
SELECT lang, CAST(lo AS INTEGER) AS min, CAST(hi AS INTEGER) AS max, CASE WHEN lo < 33 OR hi > 104 THEN 'corrupt' ELSE concat_ws(', ',
 CASE WHEN lo >= 33 AND hi <= 73 THEN 'Sanger' END, CASE WHEN lo >= 59 AND hi <= 104 THEN 'Solexa' END, CASE WHEN lo >= 64 AND hi <= 104 THEN 'Illumina 1.3+' END,
 CASE WHEN lo >= 66 AND hi <= 104 THEN 'Illumina 1.5+' END, CASE WHEN lo >= 33 AND hi <= 74 THEN 'Illumina 1.8+' END) END AS encodings FROM r""")
def t03(spark, sf):
    h = F.md5(F.col("doc_id").cast("string").cast("binary"))
    q = F.when(F.col("lang") == "en", F.upper(h)).when(F.col("lang") == "de", F.translate(h, "0123456789", "ghghghghgh")).otherwise(h)
    docs = ad.table(spark, sf, "documents").select("lang", q.alias("qual"))
    return RD.quality_encodings(RD.quality_range(docs, ["lang"]))


SPANS = """iv AS (SELECT CAST(l_partkey % 200 AS VARCHAR) AS gene, date_diff('day', DATE '1990-01-01', CAST(l_shipdate AS DATE)) AS start,
  date_diff('day', DATE '1990-01-01', CAST(l_shipdate AS DATE)) + CAST(l_quantity AS BIGINT) % 5 AS stop FROM lineitem)"""


def spans(spark, sf):
    start = F.datediff(F.to_date("l_shipdate"), F.lit("1990-01-01").cast("date")).cast("long")
    return ad.table(spark, sf, "lineitem").select(
        (F.col("l_partkey") % 200).cast("string").alias("gene"), start.alias("start"),
        (start + F.col("l_quantity").cast("long") % 5).alias("stop"), F.col("l_returnflag").alias("transcript_type"),
        F.concat(F.lit("chr"), (F.col("l_partkey") % 7).cast("string")).alias("chrom"), F.lit("+").alias("strand"),
    )


MERGED = f"""{SPANS}, mk AS (SELECT *, max(stop) OVER (PARTITION BY gene ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM iv),
isl AS (SELECT *, sum(CASE WHEN prev IS NULL OR prev < start THEN 1 ELSE 0 END) OVER (PARTITION BY gene ORDER BY start, stop) AS k FROM mk),
mg AS (SELECT gene, min(start) AS start, max(stop) AS stop FROM isl GROUP BY gene, k)"""


@query("A25_merge_intervals", f"WITH {MERGED} SELECT gene, CAST(start AS BIGINT) AS start, CAST(stop AS BIGINT) AS stop FROM mg")
def a25(spark, sf):
    return RD.merge_intervals(spans(spark, sf), "gene", width=64)


@query("S28_K20_metagene_lines", f"""WITH {MERGED}, ex AS (SELECT DISTINCT CAST(l_partkey % 200 AS VARCHAR) AS gene, l_returnflag AS t FROM lineitem),
ty AS (SELECT gene, string_agg(t, ',' ORDER BY t) AS types FROM ex GROUP BY 1)
SELECT 'chr1' || chr(9) || 'GENCODE.metagenes' || chr(9) || 'exon' || chr(9) || CAST(start AS VARCHAR) || chr(9) || CAST(stop AS VARCHAR) || chr(9) || '1000' || chr(9) || '+' || chr(9) || '.' || chr(9)
 || 'gene_id "S' || mg.gene || '_E' || mg.gene || '"; gene_name "S' || mg.gene || '_E' || mg.gene || '"; transcript_id "S' || mg.gene || '_E' || mg.gene || '"; transcript_types "' || types || '"' AS value
FROM (WITH iv2 AS (SELECT * FROM iv WHERE start <> stop), mk2 AS (SELECT *, max(stop) OVER (PARTITION BY gene ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM iv2),
 isl2 AS (SELECT *, sum(CASE WHEN prev IS NULL OR prev < start THEN 1 ELSE 0 END) OVER (PARTITION BY gene ORDER BY start, stop) AS k FROM mk2)
 SELECT gene, min(start) AS start, max(stop) AS stop FROM isl2 GROUP BY gene, k) mg JOIN (SELECT gene, string_agg(t, ',' ORDER BY t) AS types FROM (SELECT DISTINCT CAST(l_partkey % 200 AS VARCHAR) AS gene, l_returnflag AS t FROM lineitem WHERE CAST(l_quantity AS BIGINT) % 5 <> 0) GROUP BY 1) ty ON mg.gene = ty.gene""")
def k20(spark, sf):
    """GTF text of exons, parsed, merged and written again."""
    s = spans(spark, sf)
    attrs = F.format_string('gene_id "E%s.4"; gene_name "S%s"; transcript_type "%s";', "gene", "gene", "transcript_type")
    text = s.select(F.concat_ws("\t", F.lit("chr1"), F.lit("X"), F.lit("exon"), F.col("start").cast("string"), F.col("stop").cast("string"), F.lit("."), F.lit("+"), F.lit("."), attrs).alias("value"))
    return RD.metagene_lines(RD.metagenes(RD.exon_rows(text), width=64))
