"""Queries that write derived files to the shared folder and read them back, and format checks.

Every one works on text or files that Spark derives from the tables, so its work grows
with them.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from quillcell.operators import filters as FI
from quillcell.operators.aggregates import reads_per_gene
from quillcell.operators.normalize import log_normalize
from quillcell.operators.reads import rrna_genes
from quillcell.operators.hvg import seurat
from quillcell.plans import adapters as ad
from quillcell.plans.catalog import LINE, MOMENTS, NC, NORM, R, query, r6
from quillcell.plans.stages import StageStore
from quillcell.session import scratch_path
from quillcell.sources import archives
from quillcell.sources import matrices as MX
from quillcell.sources import sinks as SK
from quillcell.sources import sniff as SN
from quillcell.sources import tables as TB

ENTRIES = f"SELECT gene, cell, {R('value')} AS value FROM"


def entries(m):
    return m.expr.select("gene", "cell", r6("value"))


def part_lines(spark, sf, sep="\t"):
    p = ad.table(spark, sf, "part")
    return p.select(F.concat_ws(sep, F.col("p_partkey").cast("string"), "p_name", "p_brand", "p_type").alias("value"))


PART_LINES = "pl AS (SELECT concat_ws(chr(9), CAST(p_partkey AS VARCHAR), p_name, p_brand, p_type) AS value FROM part)"


@query("S01_binary_content", "SELECT doc_id, contains(text, chr(10) || 'A') AS is_binary FROM documents")
def s01(spark, sf):
    # the byte test of binary inputs, on the documents with every "line break + A" made a NUL byte
    d = ad.table(spark, sf, "documents").select("doc_id", F.replace("text", F.lit("\nA"), F.lit("\x00")).cast("binary").alias("content"))
    return d.select("doc_id", SN.has_nul(F.col("content")).alias("is_binary"))


@query("S02_empty_inputs", "SELECT page_id, length(regexp_replace(html, '[^Q]', '', 'g')) = 0 AS is_empty FROM pages")
def s02(spark, sf):
    return ad.table(spark, sf, "pages").select("page_id", (F.length(F.regexp_replace("html", "[^Q]", "")) == 0).alias("is_empty"))


@query("S09_delimiter_counts", f"""WITH {PART_LINES} SELECT CAST(sum(length(value) - length(replace(value, ' ', ''))) AS BIGINT) AS space,
 CAST(sum(length(value) - length(replace(value, chr(9), ''))) AS BIGINT) AS tab, CAST(sum(length(value) - length(replace(value, ',', ''))) AS BIGINT) AS comma FROM pl""")
def s09(spark, sf):
    return SN.delimiter_counts(part_lines(spark, sf))


@query("S11_header_test", """SELECT o_orderkey, list_bool_and(list_transform(string_split(v, ' '), lambda x: regexp_matches(x, '^[0-9]*\\.?[0-9]*$') AND regexp_matches(x, '[0-9]'))) AS numeric_line
FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_custkey AS VARCHAR) || ' 7.5' WHEN o_orderkey % 3 = 1 THEN '-' || CAST(o_custkey AS VARCHAR) || ' 1' ELSE o_orderpriority || ' 2' END AS v FROM orders)""")
def s11(spark, sf):
    key = F.col("o_custkey").cast("string")
    v = F.when(F.col("o_orderkey") % 3 == 0, F.concat(key, F.lit(" 7.5"))).when(
        F.col("o_orderkey") % 3 == 1, F.concat(F.lit("-"), key, F.lit(" 1"))).otherwise(F.concat("o_orderpriority", F.lit(" 2")))
    return ad.table(spark, sf, "orders").select("o_orderkey", SN.all_numbers(F.split(v, " ")).alias("numeric_line"))


@query("S12_field_counts", "SELECT len(string_split(text, ' ')) AS fields, count(*) AS lines FROM documents WHERE text <> '' GROUP BY 1")
def s12(spark, sf):
    return SN.field_counts(ad.table(spark, sf, "documents").select(F.col("text").alias("value")), " ")


@query("S14_duplicate_genes", "SELECT p_name AS gene, count(*) AS copies FROM part GROUP BY 1 HAVING count(*) > 1")
def s14(spark, sf):
    return FI.duplicated_genes(ad.table(spark, sf, "part").select(F.col("p_name").alias("gene")))


@query("S17_drop_all_copies", """SELECT p_name || p_brand AS gene, p_size FROM part
WHERE p_name || p_brand IN (SELECT p_name || p_brand FROM part GROUP BY 1 HAVING count(*) = 1)""")
def s17(spark, sf):
    return FI.drop_duplicated_genes(ad.table(spark, sf, "part").select(F.concat("p_name", "p_brand").alias("gene"), "p_size"))


def part_nation(spark, sf):
    """Quantities by part and nation; they are summed by number, as a name takes more memory than a key."""
    nations = ad.table(spark, sf, "supplier").select("s_suppkey", "s_nationkey")
    sums = (
        ad.table(spark, sf, "lineitem").join(nations, F.col("l_suppkey") == F.col("s_suppkey"))
        .groupBy("l_partkey", "s_nationkey").agg(F.sum("l_quantity").alias("value"))
    )
    return sums.select(F.col("l_partkey").cast("string").alias("gene"), F.concat(F.lit("n"), F.col("s_nationkey").cast("string")).alias("cell"), "value")


@query("S03_S06_K21_delimited_matrix", f"""SELECT CAST(l_partkey AS VARCHAR) AS gene, 'n' || CAST(s_nationkey AS VARCHAR) AS cell, {R('sum(l_quantity)')} AS value
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2""")
def s03(spark, sf):
    """Write the dense text of a part x nation matrix as bzip2 and read it as an unknown format.

    A dense text has one column per cell, so the cells are nations, whose number is fixed.
    """
    expr = part_nation(spark, sf)
    cells = [f"n{r['n_nationkey']}" for r in ad.table(spark, sf, "nation").select("n_nationkey").orderBy("n_nationkey").collect()]
    path = scratch_path(spark, "dense")
    SK.dense_lines(expr, cells).write.option("compression", "bzip2").text(path)
    body = spark.read.text(path)
    header = spark.createDataFrame([("\t".join(["id", *cells]),)], "value string")
    layout = SN.sniff(header.unionByName(body.limit(10)))
    SN.check_columns(header.unionByName(body), layout)
    return MX.wide_entries(body, cells, layout).select("gene", "cell", r6("value"))


@query("S04_S07_S10_unpacked", f"""SELECT kind, CAST(l_partkey AS VARCHAR) AS gene, 'n' || CAST(s_nationkey AS VARCHAR) AS cell, {R('sum(l_quantity)')} AS value
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey, (VALUES ('gzip'), ('text')) AS k(kind) GROUP BY 1, 2, 3""")
def s04(spark, sf):
    """One file of a part x nation matrix as gzip and as plain text, read as unknown inputs by the pipeline's reader."""
    expr = part_nation(spark, sf)
    cells = [f"n{r['n_nationkey']}" for r in ad.table(spark, sf, "nation").select("n_nationkey").orderBy("n_nationkey").collect()]
    header = spark.createDataFrame([("\t".join(["id", *cells]),)], "value string").withColumn("body", F.lit(False))
    lines = header.unionByName(SK.dense_lines(expr, cells).withColumn("body", F.lit(True))).repartition(1).sortWithinPartitions("body", "value").select("value")
    out = None
    for codec, option in (("gzip", "auto"), ("none", "tab")):
        path = scratch_path(spark, "unknown")
        lines.write.option("compression", codec).text(path)
        kind, path = archives.unpack(spark, spark.read.text(path).inputFiles()[0])
        found = MX.read_delimited(spark, path, option, "auto", 1, "error").expr.select(F.lit(kind).alias("kind"), "gene", "cell", r6("value"))
        out = found if out is None else out.unionByName(found)
    return out


@query("S08_D16_matrix_market", f"""WITH {LINE} SELECT 'S' || gene || '_E' || gene AS gene, cell, {R('value')} AS value FROM m""")
def s08(spark, sf):
    """Write the coordinate triple and read it back through its line numbers."""
    m = ad.line_counts(spark, sf)
    out = scratch_path(spark, "mtx")
    part, supp = ad.table(spark, sf, "part"), ad.table(spark, sf, "supplier")
    key = F.col("p_partkey").cast("string")
    # keys are 0..n-1, so the sorted name files put key k on line k
    part.orderBy("p_partkey").select(F.concat(F.lit("E"), key, F.lit("\tS"), key).alias("value")).write.text(f"{out}/genes.tsv")
    supp.orderBy("s_suppkey").select(F.col("s_suppkey").cast("string").alias("value")).write.text(f"{out}/barcodes.tsv")
    i, j = (F.col("gene").cast("long") + 1).cast("string"), (F.col("cell").cast("long") + 1).cast("string")
    top = "%%MatrixMarket matrix coordinate integer general\n% counts\n0 0 0"
    spark.createDataFrame([(top,)], "value string").coalesce(1).write.text(f"{out}/matrix.mtx")
    body = m.expr.select(F.concat_ws(" ", i, j, F.col("value").cast("long").cast("string")).alias("value"))
    body.write.mode("append").text(f"{out}/matrix.mtx")
    return entries(MX.read_matrix_market(spark, out))


@query("S18_K06_annotated_hvg", f"""WITH {LINE}, g AS (SELECT gene, sum(value) AS reads FROM m GROUP BY 1 ORDER BY sum(value) DESC, gene LIMIT 200)
SELECT g.gene, {R('reads')} AS reads, p_name AS "desc" FROM g JOIN part ON g.gene = CAST(p_partkey AS VARCHAR)""")
def s18(spark, sf):
    path = scratch_path(spark, "anno")
    part = ad.table(spark, sf, "part")
    SK.write_csv(part.select(F.col("p_partkey").cast("string"), "p_name"), path, "\t")
    top = reads_per_gene(ad.line_counts(spark, sf)).orderBy(F.desc("reads"), "gene").limit(200)
    return top.join(TB.annotations(spark, path), "gene").select("gene", r6("reads"), "desc")


@query("S19_K10_clustering_file", "SELECT CAST(s_suppkey AS VARCHAR) AS cell, CAST(s_nationkey AS VARCHAR) AS cluster FROM supplier")
def s19(spark, sf):
    path = scratch_path(spark, "clusters")
    SK.write_csv(ad.table(spark, sf, "supplier").select("s_suppkey", "s_nationkey"), path, "\t")
    return TB.clustering(spark, path)


@query("S22_exon_length_file", "SELECT 'E' || CAST(p_partkey AS VARCHAR) AS gene, CAST(p_size AS BIGINT) AS length FROM part")
def s22(spark, sf):
    path = scratch_path(spark, "lengths")
    p = ad.table(spark, sf, "part")
    SK.write_csv(p.select(F.concat(F.lit("E"), F.col("p_partkey").cast("string"), F.lit(".12")), "p_size"), path, " ")
    return TB.exon_lengths(spark, path)


@query("S25_K04_stage_roundtrip", f"WITH {LINE}, {NORM} SELECT gene, cell, {R('v')} AS value FROM nrm")
def s25(spark, sf):
    # the second call finds the stage and must not build it again
    store = StageStore(spark, scratch_path(spark, "stages"))
    store.get("norm", "one", lambda: log_normalize(ad.line_counts(spark, sf)).expr)
    return store.get("norm", "one", lambda: spark.sql("SELECT raise_error('built twice') AS gene")).select("gene", "cell", r6("value"))


@query("S29_A24_triplets", f"WITH {LINE} {ENTRIES} m")
def s29(spark, sf):
    path = scratch_path(spark, "triplets")
    li = ad.table(spark, sf, "lineitem").select(F.col("l_partkey").alias("gene"), F.col("l_suppkey").alias("cell"), F.col("l_quantity").cast("long").alias("count"))
    SK.write_csv(li, path, "\t", header=True)
    return entries(MX.read_triplets(spark, path))




def gene_gtf(spark, sf):
    p = ad.table(spark, sf, "part")
    k = F.col("p_partkey").cast("string")
    attrs = F.format_string('gene_id "E%s.3"; gene_name "S%s"; gene_type "%s";', k, k,
                            F.when(F.col("p_type") == "PROMO", "rRNA").otherwise("protein_coding"))
    return p.select(F.concat_ws("\t", F.lit("chr1"), F.lit("HAVANA"), F.lit("gene"), k, k, F.lit("."), F.lit("+"), F.lit("."), attrs).alias("value"))


@query("S23_rrna_genes", "SELECT DISTINCT 'E' || CAST(p_partkey AS VARCHAR) AS gene FROM part WHERE p_type = 'PROMO'")
def s23(spark, sf):
    return rrna_genes(gene_gtf(spark, sf))


@query("K06_hvg_list", f"""WITH {LINE}, {NC}, {NORM}, {MOMENTS},
b AS (SELECT gene, var / mean AS d, CAST(greatest(1, ceil((mean - min(mean) OVER ()) / ((max(mean) OVER () - min(mean) OVER ()) / 20))) AS INTEGER) AS bin FROM gs),
zz AS (SELECT gene, (d - avg(d) OVER (PARTITION BY bin)) / nullif(stddev_samp(d) OVER (PARTITION BY bin), 0) AS z FROM b)
SELECT gene FROM zz ORDER BY round(z, 6) DESC NULLS LAST, gene LIMIT 500""")
def k06(spark, sf):
    """The variable genes as the pipeline writes them."""
    top = seurat(log_normalize(ad.line_counts(spark, sf)), 500, digits=6)
    path = scratch_path(spark, "hvg")
    SK.write_single(top.orderBy("rank").select("gene"), path)
    return spark.read.csv(path, schema="gene string")
