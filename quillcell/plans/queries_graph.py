"""Queries for neighbours, graphs, communities, layouts, doublets and plot tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillcell.operators import doublets as D
from quillcell.operators import hvg as H
from quillcell.operators import plotdata as V
from quillcell.operators import snn as S
from quillcell.operators.communities import communities, connected_components
from quillcell.operators.knn import exact_knn, neighbour_table
from quillcell.operators.layout import tsne, umap
from quillcell.operators.normalize import log_normalize
from quillcell.plans import adapters as ad
from quillcell.plans.catalog import LABELS, LINE, NORM, R, REGIONS, TOKENS, query, r6
from quillcell.plans.queries_matrix import GROUPS
from quillcell.session import scratch_path
from quillcell.sources import sinks as SK

PTS = "e AS (SELECT CAST(vec_id AS VARCHAR) AS cell, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"
KNN = f"""{PTS}, ds AS (SELECT a.cell AS src, b.cell AS dst, list_distance(a.v, b.v) AS dist FROM e a JOIN e b ON a.cell <> b.cell),
nn AS (SELECT src, dst, dist, row_number() OVER (PARTITION BY src ORDER BY dist, dst) AS rank FROM ds)"""
SETS = f"""{KNN}, nb AS (SELECT src, dst FROM nn WHERE rank <= 9 UNION ALL SELECT cell, cell FROM e),
sh AS (SELECT a.src, b.src AS dst, count(*) AS v FROM nb a JOIN nb b ON a.dst = b.dst GROUP BY 1, 2),
g AS (SELECT src, dst, v, v / (10.0 + (10 - v)) AS j FROM sh WHERE v / (10.0 + (10 - v)) > 0.067)"""


def neighbours(spark, sf, k=10):
    return neighbour_table(ad.embedding_points(spark, sf), k)


@query("G01_J13_W14_knn", f"WITH {KNN} SELECT src, dst, CAST(rank AS INTEGER) AS rank, {R('dist')} AS dist FROM nn WHERE rank <= 10")
def g01(spark, sf):
    return exact_knn(ad.embedding_points(spark, sf), 10).select("src", "dst", "rank", r6("dist"))


@query("G02_J10_F20_snn", f"WITH {SETS} SELECT src, dst, CAST(v AS INTEGER) AS shared, {R('j')} AS jaccard FROM g")
def g02(spark, sf):
    return S.snn_graph(neighbours(spark, sf), 10, 0.067).select("src", "dst", "shared", r6("jaccard"))


@query("K09_snn_file", f"WITH {SETS} SELECT src, dst FROM g")
def k09(spark, sf):
    """The edge list as the pipeline writes it."""
    path = scratch_path(spark, "snn")
    SK.write_csv(S.snn_graph(neighbours(spark, sf), 10, 0.067).select("src", "dst"), path)
    return spark.read.csv(path, schema="src string, dst string")


@query("G03_components", """WITH k AS (SELECT o_orderkey AS node, sum(CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END)
  OVER (ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS run FROM orders)
SELECT (node * 2654435761) % 4294967296 AS node,
  min((node * 2654435761) % 4294967296) OVER (PARTITION BY coalesce(run, 0)) AS component FROM k""")
def g03c(spark, sf):
    # consecutive orders are linked unless the first is urgent; an odd factor shuffles the ids, so they do not rise along a path
    def spread(key):
        return (key * 2654435761) % 4294967296

    o = ad.table(spark, sf, "orders")
    key = F.col("o_orderkey").cast("long")
    nodes = o.select(spread(key).alias("node"))
    links = o.filter("o_orderpriority <> '1-URGENT'").select(spread(key).alias("src"), spread(key + 1).alias("dst"))
    return connected_components(nodes, links.join(nodes, F.col("dst") == F.col("node"), "left_semi"))


@query("G03_K10_communities")
def g03(spark, sf):
    graph = S.snn_graph(neighbours(spark, sf), 10, 0.067)
    nodes = ad.embedding_points(spark, sf).select(F.col("cell").alias("node"))
    return communities(nodes, graph, 0.8)


@query("G03_planted_nations", """WITH c AS (SELECT c_custkey AS k, c_nationkey AS nation FROM customer)
SELECT CAST(k AS VARCHAR) AS cell, count(*) OVER (PARTITION BY nation) AS size, CAST(min(k) OVER (PARTITION BY nation) AS VARCHAR) AS first FROM c""")
def g03n(spark, sf):
    """Customers of a nation all know each other, and the first ones of two nations do so in a ring.

    A resolution at which the null expects a third of a link for each pair lies between the
    densities inside and between nations, so the nations are the best partition.
    """
    c = ad.table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), F.col("c_nationkey").alias("nation"))
    # the links are many times the customers, so those are dealt to all cores first
    a, b = c.repartition(4 * spark.sparkContext.defaultParallelism, "k").toDF("ka", "nation"), c.toDF("kb", "nation")
    inside = a.join(b, "nation").filter("ka < kb").select("ka", "kb")
    heads = c.groupBy("nation").agg(F.min("k").alias("k"))
    after = Window.orderBy("nation")  # 25 nations
    ring = heads.select(F.col("k").alias("ka"), F.lead("k").over(after).alias("kb")).filter("kb is not null")
    links = inside.unionByName(ring).select(F.col("ka").cast("string").alias("src"), F.col("kb").cast("string").alias("dst")).persist()
    n, m = c.count(), links.count()
    found = communities(c.select(F.col("k").cast("string").alias("node")), links, n * n / (6.0 * m), iterations=1)
    links.unpersist()
    w = Window.partitionBy("cluster")
    return found.select("cell", F.count("*").over(w).alias("size"), F.min(F.col("cell").cast("long")).over(w).cast("string").alias("first"))


# ---- layouts and doublets ------------------------------------------------

@query("E01_K08_tsne")
def e01(spark, sf):
    """A few rounds of t-SNE on the vectors; the number of rounds is a parameter."""
    return tsne(ad.embedding_points(spark, sf), perplexity=10.0, iterations=6)


@query("E02_umap")
def e02(spark, sf):
    return umap(ad.embedding_points(spark, sf), neighbours=15)


@query("U10_sample_pairs")
def u10(spark, sf):
    m = ad.line_counts(spark, sf)
    return D.sample_pairs(m.cells, ad.table(spark, sf, "orders").count(), 42)


@query("X01_A26_K22_scrublet")
def x01(spark, sf):
    return D.scrublet(ad.line_counts(spark, sf).stored())


@query("X02_doublet_finder")
def x02(spark, sf):
    m = ad.line_counts(spark, sf).stored()
    return D.doublet_finder(m, H.seurat(log_normalize(m)))


# ---- plot tables ---------------------------------------------------------

@query("V01_read_count_bars", f"""WITH {LINE}, t AS (SELECT cell, sum(value) AS reads FROM m GROUP BY 1)
SELECT cell, {R('reads')} AS reads, rank() OVER (ORDER BY reads DESC) AS position, CASE WHEN reads < 15000 THEN 'Removed' ELSE 'Passed' END AS status FROM t""")
def v01(spark, sf):
    return V.read_count_bars(ad.line_counts(spark, sf), 15000).select("cell", r6("reads"), "position", "status")


@query("V02_expressed_gene_bars", f"""WITH {TOKENS}, t AS (SELECT cell, count(*) AS genes FROM m GROUP BY 1) SELECT cell, genes, rank() OVER (ORDER BY genes DESC) AS position FROM t""")
def v02(spark, sf):
    return V.expressed_gene_bars(ad.token_counts(spark, sf)).select("cell", "genes", "position")


EMBED = "em AS (SELECT CAST(vec_id AS VARCHAR) AS cell, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y FROM embeddings)"


def embedding_2d(spark, sf):
    return ad.embedding_points(spark, sf).select("cell", F.col("features")[0].alias("x"), F.col("features")[1].alias("y"))


@query("V03_cluster_scatter", f"""WITH {EMBED}, {LABELS}, sz AS (SELECT cluster, count(*) AS size FROM cl GROUP BY 1)
SELECT em.cell, {R('x')} AS x, {R('y')} AS y, cl.cluster, size, CASE WHEN cl.cluster < '5' THEN 'type ' || cl.cluster END AS cell_type, CASE WHEN cl.cluster < '5' THEN CAST(0.01 AS DOUBLE) END AS padj
FROM em JOIN cl ON em.cell = cl.cell JOIN sz ON sz.cluster = cl.cluster""")
def v03(spark, sf):
    cl = ad.embedding_clusters(spark, sf)
    best = cl.filter("cluster < '5'").select("cluster", F.concat(F.lit("type "), "cluster").alias("cell_type"), F.lit(0.01).alias("padj")).distinct()
    return V.cluster_scatter(embedding_2d(spark, sf), cl, best).select("cell", r6("x"), r6("y"), "cluster", "size", "cell_type", "padj")


@query("V04_gene_overlay", f"""WITH {LINE}, em AS (SELECT CAST(s_suppkey AS VARCHAR) AS cell, s_acctbal AS x, CAST(s_nationkey AS DOUBLE) AS y FROM supplier)
SELECT em.cell, {R('x')} AS x, {R('y')} AS y, {R('coalesce(value, 0)')} AS value FROM em LEFT JOIN m ON em.cell = m.cell AND m.gene = '17'""")
def v04(spark, sf):
    m = ad.line_counts(spark, sf)
    named = m.keep(m.expr.withColumn("gene", F.concat(F.lit("gene"), "gene", F.lit("_ENS"))))
    em = ad.table(spark, sf, "supplier").select(F.col("s_suppkey").cast("string").alias("cell"), F.col("s_acctbal").alias("x"), F.col("s_nationkey").cast("double").alias("y"))
    return V.gene_overlay(named, em, "Gene17").select("cell", r6("x"), r6("y"), r6("value"))


@query("V05_genes_per_cluster", f"WITH {LINE}, {REGIONS} SELECT cluster, m.cell, count(*) AS genes FROM m JOIN cl ON m.cell = cl.cell GROUP BY 1, 2")
def v05(spark, sf):
    return V.genes_per_cluster(ad.line_counts(spark, sf), ad.supplier_clusters(spark, sf))


@query("V06_top_gene_values", f"""WITH {LINE}, {REGIONS}, {NORM}, {GROUPS},
k AS (SELECT gene, cluster, row_number() OVER (PARTITION BY cluster ORDER BY round(mean, 6) DESC, gene) AS rank FROM gm)
SELECT k.cluster, k.gene, CAST(rank AS INTEGER) AS rank, cl.cell, {R('coalesce(v, 0)')} AS value FROM k JOIN cl ON k.cluster = cl.cluster
LEFT JOIN nrm ON nrm.gene = k.gene AND nrm.cell = cl.cell WHERE rank <= 5""")
def v06(spark, sf):
    t = V.top_gene_values(log_normalize(ad.line_counts(spark, sf)), ad.supplier_clusters(spark, sf), 5, 6)
    return t.select("cluster", "gene", "rank", "cell", r6("value"))


@query("V07_marker_heatmap", f"""WITH {LINE}, {REGIONS}, mk AS (SELECT p_brand AS cell_type, CAST(p_partkey AS VARCHAR) AS gene FROM part WHERE p_brand IN ('Brand#1', 'Brand#2')
 UNION ALL SELECT p_type, CAST(p_partkey AS VARCHAR) FROM part WHERE p_type = 'PROMO'),
g AS (SELECT gene, string_agg(DISTINCT cell_type, ',' ORDER BY cell_type) AS cell_types FROM mk GROUP BY 1)
SELECT cell_types, m.gene, cluster, m.cell, {R('value')} AS value FROM m JOIN g ON m.gene = g.gene JOIN cl ON m.cell = cl.cell""")
def v07(spark, sf):
    mk = ad.brand_markers(spark, sf).select("gene", "cell_type")
    called = mk.filter("cell_type IN ('Brand#1', 'Brand#2')").groupBy("cell_type").agg(F.concat_ws(",", F.sort_array(F.collect_set("gene"))).alias("markers"))
    h = V.marker_heatmap(ad.line_counts(spark, sf), ad.supplier_clusters(spark, sf), called, mk, "promo")
    return h.select("cell_types", "gene", "cluster", "cell", r6("value"))
