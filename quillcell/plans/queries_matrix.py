"""Queries for filters, aggregates, reshaping and normalisation of the count matrix."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillcell.functions.exprs import MITO_PATTERN, equal_width_bin, unversioned
from quillcell.matrix import gene_moments
from quillcell.operators import aggregates as A
from quillcell.operators import filters as FI
from quillcell.operators.hvg import binned_dispersion, mean_cv_points, mean_density, seurat
from quillcell.operators.normalize import log_normalize, rpkm, unlog
from quillcell.operators.plotdata import top_genes_per_cluster
from quillcell.operators.quantile import exact_quantile
from quillcell.plans import adapters as ad
from quillcell.sources import tables as TB
from quillcell.plans.catalog import (
    BRANDS, EMB, LABELS, LINE, LINEAR, MOMENTS, NAMED, NC, NORM, R, REGIONS, TOKENS, query, r6,
)

ENTRIES = f"SELECT gene, cell, {R('value')} AS value FROM"


def entries(m):
    return m.expr.select("gene", "cell", r6("value"))


# ---- filters -------------------------------------------------------------

@query("F01_count_violations", f"""WITH {LINE}, {NC}, t AS (SELECT cell, sum(value) AS reads FROM m GROUP BY 1),
nrm AS (SELECT gene, m.cell, log2(value * 10000.0 / reads + 1) AS v FROM m JOIN t ON m.cell = t.cell),
c AS (SELECT cell, bool_and(v = floor(v)) AS w, sum(CASE WHEN v > 1000 THEN 1 ELSE 0 END) AS l FROM nrm GROUP BY 1)
SELECT CAST((SELECT count(*) FROM m WHERE value <> floor(value)) AS BIGINT) AS fractional_entries,
 CAST(count(*) FILTER (WHERE w) AS BIGINT) AS whole_cells, CAST(sum(l) AS BIGINT) AS entries_above_1000 FROM c""")
def f01(spark, sf):
    m = ad.line_counts(spark, sf)
    raw = FI.count_violations(m, "raw").scalar()
    return FI.count_violations(log_normalize(m), "log2").withColumn("fractional_entries", raw)


@query("F02_remove_empty", f"WITH {LINE}, h AS (SELECT gene, cell, value - 20 AS value FROM m WHERE value >= 20) {ENTRIES} h WHERE value <> 0")
def f02(spark, sf):
    m = ad.line_counts(spark, sf)
    shifted = m.keep(m.expr.filter("value >= 20").withColumn("value", F.col("value") - 20))
    return entries(FI.remove_empty(shifted))


@query("F03_remove_mito", f"WITH {NAMED} {ENTRIES} m WHERE NOT regexp_matches(gene, '(?i)^mt-')")
def f03(spark, sf):
    return entries(FI.remove_mito(ad.named_counts(spark, sf)))


@query("F04_spike_genes", f"WITH {NAMED} {ENTRIES} m WHERE regexp_matches(gene, '^ERCC[_-]\\S+$')")
def f04(spark, sf):
    return entries(FI.split_spikes(ad.named_counts(spark, sf))[1])


@query("F05_exclude_pattern", f"WITH {NAMED} {ENTRIES} m WHERE NOT regexp_matches(gene, '7|^g1')")
def f05(spark, sf):
    return entries(FI.exclude_genes(ad.named_counts(spark, sf), "7|^g1"))


@query("F06_min_reads", f"WITH {LINE}, k AS (SELECT cell FROM m GROUP BY 1 HAVING sum(value) > 15000) "
       f"{ENTRIES} m WHERE cell IN (SELECT cell FROM k)")
def f06(spark, sf):
    return entries(FI.min_reads(ad.line_counts(spark, sf), 15000))


@query("F07_min_cells_count", f"WITH {LINE}, k AS (SELECT gene FROM m GROUP BY 1 HAVING count(*) FILTER (WHERE value > 0) > 25) "
       f"{ENTRIES} m WHERE gene IN (SELECT gene FROM k)")
def f07(spark, sf):
    return entries(FI.min_expressed(ad.line_counts(spark, sf), 25.0))


@query("F08_min_cells_share", f"WITH {LINE}, {NC}, k AS (SELECT gene FROM m, nc GROUP BY gene, n "
       f"HAVING count(*) FILTER (WHERE value > 0) / CAST(n AS DOUBLE) > 0.25) {ENTRIES} m WHERE gene IN (SELECT gene FROM k)")
def f08(spark, sf):
    return entries(FI.min_expressed(ad.line_counts(spark, sf), 0.25))


@query("F09_drop_cells", f"WITH {LINE} {ENTRIES} m WHERE cell NOT IN (SELECT CAST(s_suppkey AS VARCHAR) FROM supplier WHERE s_acctbal < 0)")
def f09(spark, sf):
    low = ad.table(spark, sf, "supplier").filter("s_acctbal < 0").select(F.col("s_suppkey").cast("string").alias("cell"))
    return entries(FI.drop_cells(ad.line_counts(spark, sf), low))


@query("F11_target_clusters", f"""WITH {LINE}, {REGIONS},
k AS (SELECT cluster FROM cl GROUP BY 1 HAVING count(*) > 15)
{ENTRIES} m WHERE cell IN (SELECT cell FROM cl WHERE cluster IN (SELECT cluster FROM k))""")
def f11(spark, sf):
    cells = FI.in_target_clusters(ad.supplier_clusters(spark, sf), 15)
    return entries(FI.keep_cells(ad.line_counts(spark, sf), cells))


@query("F12_small_clusters", f"WITH {LABELS} SELECT cluster, count(*) AS size FROM cl GROUP BY 1 HAVING count(*) > 45")
def f12(spark, sf):
    return FI.target_clusters(ad.embedding_clusters(spark, sf), 45)


@query("F13_highlight_cells", "SELECT CAST(s_suppkey AS VARCHAR) AS cell, s_acctbal > 5000 AS highlighted FROM supplier")
def f13(spark, sf):
    sup = ad.table(spark, sf, "supplier").withColumn("cell", F.col("s_suppkey").cast("string"))
    return FI.highlight(sup.select("cell"), sup.filter("s_acctbal > 5000"))


@query("F14_positive_mean", f"WITH {EMB} SELECT gene, {R('avg(value)')} AS mean FROM m GROUP BY 1 HAVING avg(value) > 0")
def f14(spark, sf):
    return gene_moments(ad.embedding_matrix(spark, sf)).filter(FI.positive("mean")).select("gene", r6("mean"))


@query("F15_cells_without_spikes", f"""WITH {NAMED}, s AS (SELECT * FROM m WHERE regexp_matches(gene, '^ERCC[_-]\\S+$')),
t AS (SELECT cell, sum(value) AS reads FROM s GROUP BY 1)
SELECT gene, s.cell, {R('log2(value * 10000.0 / reads + 1)')} AS value FROM s JOIN t ON s.cell = t.cell""")
def f15(spark, sf):
    return entries(log_normalize(FI.split_spikes(ad.named_counts(spark, sf))[1]))


# ---- joins ---------------------------------------------------------------

@query("J01_exon_lengths", f"""WITH {LINE} SELECT m.gene, cell, {R('value')} AS value, CAST(p_size AS BIGINT) AS length
FROM m JOIN part ON m.gene = CAST(p_partkey AS VARCHAR)""")
def j01(spark, sf):
    m = ad.line_counts(spark, sf)
    versioned = m.keep(m.expr.withColumn("gene", F.concat("gene", F.lit(".7"))))
    lengths = ad.table(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("gene"), F.col("p_size").cast("long").alias("length"))
    return versioned.expr.withColumn("gene", unversioned()).join(lengths, "gene").select("gene", "cell", r6("value"), "length")


@query("J02_annotated_genes", f"""WITH {LINE}, g AS (SELECT gene, sum(value) AS reads FROM m GROUP BY 1)
SELECT g.gene, {R('reads')} AS reads, p_name AS "desc" FROM g JOIN part ON g.gene = CAST(p_partkey AS VARCHAR)
WHERE p_brand <> 'Brand#11'""")
def j02(spark, sf):
    anno = ad.table(spark, sf, "part").filter("p_brand <> 'Brand#11'").select(F.col("p_partkey").cast("string").alias("gene"), F.col("p_name").alias("desc"))
    named = TB.annotate(A.reads_per_gene(ad.line_counts(spark, sf)), anno)
    return named.filter(F.col("desc") != TB.DEFAULT_ANNOTATION).select("gene", r6("reads"), "desc")


@query("J03_annotation_default", f"""WITH {LINE}, g AS (SELECT DISTINCT gene FROM m)
SELECT g.gene, coalesce(p_name, 'no annotation') AS "desc" FROM g
LEFT JOIN (SELECT * FROM part WHERE p_brand <> 'Brand#11') p ON g.gene = CAST(p_partkey AS VARCHAR)""")
def j03(spark, sf):
    anno = ad.table(spark, sf, "part").filter("p_brand <> 'Brand#11'").select(F.col("p_partkey").cast("string").alias("gene"), F.col("p_name").alias("desc"))
    return TB.annotate(ad.line_counts(spark, sf).genes, anno).select("gene", "desc")


@query("J06_rrna_in_matrix", f"WITH {LINE} SELECT DISTINCT gene FROM m WHERE gene IN (SELECT CAST(p_partkey AS VARCHAR) FROM part WHERE p_type = 'PROMO')")
def j06(spark, sf):
    rrna = ad.table(spark, sf, "part").filter("p_type = 'PROMO'").select(F.col("p_partkey").cast("string").alias("gene"))
    return ad.line_counts(spark, sf).genes.join(rrna, "gene", "left_semi")


@query("J07_reindex", f"""WITH {LINE}, g AS (SELECT gene, sum(value) AS reads FROM m GROUP BY 1)
SELECT CAST(p_partkey AS BIGINT) AS pos, CAST(p_partkey AS VARCHAR) AS gene, {R('reads')} AS reads FROM part
LEFT JOIN g ON g.gene = CAST(p_partkey AS VARCHAR)""")
def j07(spark, sf):
    keys = ad.table(spark, sf, "part").select(F.col("p_partkey").alias("pos"), F.col("p_partkey").cast("string").alias("gene"))
    return keys.join(A.reads_per_gene(ad.line_counts(spark, sf)), "gene", "left").select("pos", "gene", r6("reads"))


@query("J09_G05_premade_clustering", f"""WITH {LINE}, {REGIONS}
SELECT cl.cell, cluster, (SELECT count(*) FROM cl WHERE cell NOT IN (SELECT cell FROM m)) AS without_data,
 (SELECT count(DISTINCT cell) FROM m WHERE cell NOT IN (SELECT cell FROM cl)) AS without_cluster
FROM cl WHERE cell IN (SELECT cell FROM m)""")
def j09(spark, sf):
    cells, given = ad.line_counts(spark, sf).cells, ad.supplier_clusters(spark, sf)
    extra = given.join(cells, "cell", "left_anti").agg(F.count("*")).scalar()
    missing = cells.join(given, "cell", "left_anti").agg(F.count("*")).scalar()
    covered = cells.join(given, "cell", "left_semi")
    return TB.match_clustering(covered, given).select("cell", "cluster", extra.alias("without_data"), missing.alias("without_cluster"))


# ---- aggregates ----------------------------------------------------------

@query("A01_reads_per_cell", f"WITH {LINE} SELECT cell, {R('sum(value)')} AS reads FROM m GROUP BY 1")
def a01(spark, sf):
    return A.reads_per_cell(ad.line_counts(spark, sf)).select("cell", r6("reads"))


@query("A02_reads_per_gene", f"WITH {LINE} SELECT gene, {R('sum(value)')} AS reads FROM m GROUP BY 1")
def a02(spark, sf):
    return A.reads_per_gene(ad.line_counts(spark, sf)).select("gene", r6("reads"))


@query("A03_genes_per_cell", f"WITH {TOKENS} SELECT cell, count(*) AS genes FROM m WHERE value > 0 GROUP BY 1")
def a03(spark, sf):
    return A.genes_per_cell(ad.token_counts(spark, sf))


@query("A04_dropouts", f"""WITH {TOKENS}, {NC} SELECT gene, count(*) FILTER (WHERE value > 0) AS n_exp,
 n - count(*) FILTER (WHERE value > 0) AS dropouts FROM m, nc GROUP BY gene, n""")
def a04(spark, sf):
    return A.dropouts(ad.token_counts(spark, sf))


@query("A05_qc_features", f"""WITH {NAMED}, rr AS (SELECT gene FROM names WHERE p_type = 'PROMO'),
x AS (SELECT m.gene, cell, value, regexp_matches(m.gene, '^ERCC[_-]\\S+$') AS sp, regexp_matches(m.gene, '(?i)^mt-') AS mt,
  m.gene IN (SELECT gene FROM rr) AS r FROM m),
c AS (SELECT cell, sum(value) FILTER (WHERE NOT sp) AS reads, count(*) FILTER (WHERE NOT sp AND value > 0) AS genes,
  coalesce(sum(value) FILTER (WHERE r AND NOT sp), 0) AS rr, coalesce(sum(value) FILTER (WHERE mt AND NOT sp), 0) AS mt,
  coalesce(sum(value) FILTER (WHERE sp), 0) AS sp FROM x GROUP BY 1)
SELECT cell, {R('reads')} AS reads, {R('ln(reads)')} AS ln_reads, genes, {R('rr / reads * 100')} AS perc_rrna,
  {R('mt / reads * 100')} AS perc_mt, {R('sp / reads * 100')} AS perc_spike FROM c WHERE reads > 0""")
def a05(spark, sf):
    data, spikes = FI.split_spikes(ad.named_counts(spark, sf))
    rrna = ad.gene_names(spark, sf).filter("p_type = 'PROMO'").select("gene")
    q = A.qc_features(data, spikes, rrna)
    return q.select("cell", "genes", *[r6(c) for c in ("reads", "ln_reads", "perc_rrna", "perc_mt", "perc_spike")])


@query("A06_gene_moments", f"""WITH {LINE}, {NC}, {NORM}, {MOMENTS}
SELECT gene, n, z, {R('mean')} AS mean, {R('var')} AS var, {R('sqrt(var) / mean')} AS cv FROM gs""")
def a06(spark, sf):
    g = gene_moments(log_normalize(ad.line_counts(spark, sf)))
    return g.select("gene", "n", "z", r6("mean"), r6("var"), r6(F.sqrt("var") / F.col("mean"), "cv"))


@query("A07_second_moment", f"WITH {LINE}, {NC} SELECT gene, {R('sum(value * value) / n')} AS second_moment FROM m, nc GROUP BY gene, n")
def a07(spark, sf):
    return A.second_moment(ad.line_counts(spark, sf)).select("gene", r6("second_moment"))


@query("A08_quantile", f"""WITH {LINE}, {NC}, {NORM}, {LINEAR}
SELECT {R('quantile_cont(mean, 0.8)')} AS cutoff FROM gs WHERE var / (mean * mean) > 0.3""")
def a08(spark, sf):
    g = gene_moments(unlog(log_normalize(ad.line_counts(spark, sf)))).filter(F.col("var") / (F.col("mean") * F.col("mean")) > 0.3)
    return exact_quantile(g, "mean", 0.8, name="cutoff").select(r6("cutoff"))


@query("A09_bin_dispersion", f"""WITH {LINE}, {NC}, {NORM}, {MOMENTS},
b AS (SELECT gene, var / mean AS d, CAST(greatest(1, ceil((mean - min(mean) OVER ()) / ((max(mean) OVER () - min(mean) OVER ()) / 20))) AS INTEGER) AS bin FROM gs)
SELECT bin, count(*) AS genes, {R('avg(d)')} AS bin_mean, {R('stddev_samp(d)')} AS bin_sd FROM b GROUP BY 1""")
def a09(spark, sf):
    b = binned_dispersion(log_normalize(ad.line_counts(spark, sf)))
    return b.groupBy("bin").agg(F.count("*").alias("genes"), r6(F.avg("dispersion"), "bin_mean"), r6(F.stddev_samp("dispersion"), "bin_sd"))


GROUPS = f"""g AS (SELECT DISTINCT gene FROM m), cs AS (SELECT cluster, count(*) AS n FROM cl GROUP BY 1),
x AS (SELECT nrm.gene, cluster, v FROM nrm JOIN cl ON nrm.cell = cl.cell),
s AS (SELECT gene, cluster, count(*) AS z, sum(v) AS s1, avg(v) AS mz, var_pop(v) * count(*) AS m2z FROM x GROUP BY 1, 2),
gm AS (SELECT g.gene, cs.cluster, n, coalesce(s1, 0) / n AS mean, coalesce(m2z + mz * mz * z * (n - z) / n, 0) AS m2
  FROM g CROSS JOIN cs LEFT JOIN s ON s.gene = g.gene AND s.cluster = cs.cluster)"""


@query("A10_mean_exp", f"WITH {LINE}, {REGIONS}, {NORM}, {GROUPS} SELECT gene, cluster, n, {R('mean')} AS mean FROM gm")
def a10(spark, sf):
    m = A.group_moments(log_normalize(ad.line_counts(spark, sf)).stored(), ad.supplier_clusters(spark, sf))
    return m.select("gene", "cluster", "n", r6("mean"))


MEDIANS = """dense AS (SELECT g.gene, c.cell, cluster, coalesce(v, 0) AS v FROM (SELECT DISTINCT gene FROM m) g
  CROSS JOIN cl c LEFT JOIN nrm ON nrm.gene = g.gene AND nrm.cell = c.cell),
md AS (SELECT gene, cluster, median(v) AS median FROM dense GROUP BY 1, 2)"""


@query("A11_median_exp", f"WITH {LINE}, {REGIONS}, {NORM}, {MEDIANS} SELECT gene, cluster, {R('median')} AS median FROM md")
def a11(spark, sf):
    m = A.group_median(log_normalize(ad.line_counts(spark, sf)).stored(), ad.supplier_clusters(spark, sf))
    return m.select("gene", "cluster", r6("median"))


@query("A11_median_dense", f"WITH {EMB}, {LABELS} SELECT gene, cluster, {R('median(value)')} AS median FROM m JOIN cl ON m.cell = cl.cell GROUP BY 1, 2")
def a11b(spark, sf):
    m = A.group_median(ad.embedding_matrix(spark, sf), ad.embedding_clusters(spark, sf))
    return m.select("gene", "cluster", r6("median"))


@query("A12_value_counts", f"WITH {BRANDS} SELECT gene, count(*) AS freq FROM mk GROUP BY 1")
def a12(spark, sf):
    return ad.brand_markers(spark, sf).groupBy("gene").agg(F.count("*").alias("freq"))


@query("A13_cluster_sizes", f"WITH {REGIONS} SELECT cluster, count(*) AS n FROM cl GROUP BY 1")
def a13(spark, sf):
    return A.sizes(ad.supplier_clusters(spark, sf))


@query("A14_distinct_cell_types", f"WITH {BRANDS} SELECT DISTINCT cell_type FROM mk")
def a14(spark, sf):
    return ad.brand_markers(spark, sf).select("cell_type").distinct()


@query("A15_distinct_pairs", "SELECT DISTINCT p_type AS cell_type, p_brand AS gene FROM part")
def a15(spark, sf):
    return ad.table(spark, sf, "part").select(F.col("p_type").alias("cell_type"), F.col("p_brand").alias("gene")).dropDuplicates()


@query("A16_A17_gene_sets", "SELECT p_type AS cell_type, string_agg(DISTINCT p_brand, ',' ORDER BY p_brand) AS genes FROM part GROUP BY 1")
def a16(spark, sf):
    p = ad.table(spark, sf, "part").select("p_type", "p_brand").distinct()
    return p.groupBy(F.col("p_type").alias("cell_type")).agg(F.concat_ws(",", F.sort_array(F.collect_set("p_brand"))).alias("genes"))


@query("A18_three_sigma", f"""WITH {LINE}, t AS (SELECT cell, sum(value) AS r FROM m GROUP BY 1)
SELECT {R('avg(r)')} AS mean, {R('stddev_pop(r)')} AS sd, {R('avg(r) - 3 * stddev_pop(r)')} AS lower, {R('avg(r) + 3 * stddev_pop(r)')} AS upper FROM t""")
def a18(spark, sf):
    b = A.three_sigma(A.reads_per_cell(ad.line_counts(spark, sf)), "reads")
    return b.select(*[r6(c) for c in b.columns])


@query("A19_residual_sums", f"""WITH {LINE}, {REGIONS}, {NORM}, {GROUPS}
SELECT gene, {R('sum(m2)')} AS rss, {R('sum(m2) / (sum(n) - count(*))')} AS sigma2 FROM gm GROUP BY 1""")
def a19(spark, sf):
    m = A.group_moments(log_normalize(ad.line_counts(spark, sf)).stored(), ad.supplier_clusters(spark, sf))
    return m.groupBy("gene").agg(r6(F.sum("m2"), "rss"), r6(F.sum("m2") / (F.sum("n") - F.count("*")), "sigma2"))


@query("A20_A21_extremes", f"""WITH {LINE} SELECT gene, {R('min(value)')} AS lowest, {R('max(value)')} AS highest FROM m GROUP BY 1""")
def a20(spark, sf):
    return ad.line_counts(spark, sf).expr.groupBy("gene").agg(r6(F.min("value"), "lowest"), r6(F.max("value"), "highest"))


# ---- windows, ranks, reshaping ------------------------------------------

@query("W01_z_in_bin", f"""WITH {LINE}, {NC}, {NORM}, {MOMENTS},
b AS (SELECT gene, var / mean AS d, CAST(greatest(1, ceil((mean - min(mean) OVER ()) / ((max(mean) OVER () - min(mean) OVER ()) / 20))) AS INTEGER) AS bin FROM gs)
SELECT gene, bin, {R('(d - avg(d) OVER (PARTITION BY bin)) / nullif(stddev_samp(d) OVER (PARTITION BY bin), 0)')} AS z FROM b""")
def w01(spark, sf):
    return binned_dispersion(log_normalize(ad.line_counts(spark, sf))).select("gene", "bin", r6("z"))


@query("W06_top_genes", f"""WITH {LINE} SELECT gene, {R('sum(value)')} AS reads FROM m GROUP BY 1 ORDER BY sum(value) DESC, gene LIMIT 100""")
def w06(spark, sf):
    return A.reads_per_gene(ad.line_counts(spark, sf)).orderBy(F.desc("reads"), "gene").limit(100).select("gene", r6("reads"))


@query("W08_first_in_matrix_order", f"""WITH {LINE}, g AS (SELECT gene FROM m GROUP BY 1 HAVING sum(value) > 700)
SELECT gene FROM g ORDER BY CAST(gene AS BIGINT) LIMIT 50""")
def w08(spark, sf):
    g = A.reads_per_gene(ad.line_counts(spark, sf)).filter("reads > 700")
    return g.orderBy(F.col("gene").cast("long")).limit(50).select("gene")


@query("W09_top_genes_per_cluster", f"""WITH {LINE}, {REGIONS}, {NORM}, {GROUPS},
k AS (SELECT gene, cluster, mean, row_number() OVER (PARTITION BY cluster ORDER BY round(mean, 6) DESC, gene) AS rank FROM gm)
SELECT gene, cluster, {R('mean')} AS mean, CAST(rank AS INTEGER) AS rank FROM k WHERE rank <= 10""")
def w09(spark, sf):
    m = log_normalize(ad.line_counts(spark, sf))
    return top_genes_per_cluster(m, ad.supplier_clusters(spark, sf), 10, 6).select("gene", "cluster", r6("mean"), "rank")


@query("W12_argmax", f"""WITH {LINE} SELECT gene, max_by(cell, (value, cell)) AS top_cell, min_by(cell, (value, cell)) AS low_cell FROM m GROUP BY 1""")
def w12(spark, sf):
    by = F.struct("value", "cell")
    return ad.line_counts(spark, sf).expr.groupBy("gene").agg(F.max_by("cell", by).alias("top_cell"), F.min_by("cell", by).alias("low_cell"))


GRID = f"""WITH {LINE}, {NC}, {NORM}, {LINEAR},
p AS (SELECT gene, log10(mean) AS lx FROM gs WHERE mean > 0 AND var > 0),
e AS (SELECT min(lx) AS lo, max(lx) AS hi FROM p),
grid AS (SELECT CAST(i AS INTEGER) AS i, lo + i * 0.005 AS x FROM e, unnest(generate_series(0, CAST(ceil((hi - lo) / 0.005) AS BIGINT))) AS u(i) WHERE lo + i * 0.005 < hi),
dens AS (SELECT i, x, count(*) AS genes FROM grid JOIN p ON lx >= x - 0.05 AND lx < x + 0.05 GROUP BY 1, 2)"""


@query("W13_density_difference", f"""{GRID} SELECT i, genes - lag(genes) OVER (ORDER BY i) AS step FROM dens""")
def w13(spark, sf):
    # one row per grid point; the grid spans the log10 means in fixed steps
    grid = mean_density(mean_cv_points(log_normalize(ad.line_counts(spark, sf))))
    return grid.select("i", (F.col("genes") - F.lag("genes").over(Window.orderBy("i"))).alias("step"))


@query("W17_sliding_density", f"""{GRID} SELECT i, {R('x')} AS x, genes FROM dens""")
def w17(spark, sf):
    return mean_density(mean_cv_points(log_normalize(ad.line_counts(spark, sf)))).select("i", r6("x"), "genes")


@query("U01_union_all", f"""WITH {NAMED} SELECT gene, cell, {R('value')} AS value, 'spike' AS part FROM m WHERE regexp_matches(gene, '^ERCC[_-]\\S+$')
UNION ALL SELECT gene, cell, {R('value')}, 'mito' FROM m WHERE regexp_matches(gene, '(?i)^mt-')""")
def u01(spark, sf):
    m = ad.named_counts(spark, sf)
    spikes = entries(FI.split_spikes(m)[1]).withColumn("part", F.lit("spike"))
    return spikes.unionByName(entries(m.keep(m.expr.filter(F.col("gene").rlike(MITO_PATTERN)))).withColumn("part", F.lit("mito")))


@query("U02_set_operations", f"""WITH {LINE}, {BRANDS}, e AS (SELECT gene FROM m GROUP BY 1 HAVING sum(value) > 600),
c AS (SELECT cell_type, count(*) AS size, count(*) FILTER (WHERE gene IN (SELECT gene FROM e)) AS hits FROM mk GROUP BY 1)
SELECT cell_type, hits AS in_both, size - hits AS only_set, (SELECT count(*) FROM e) - hits AS only_expressed FROM c""")
def u02(spark, sf):
    e = A.reads_per_gene(ad.line_counts(spark, sf)).filter("reads > 600").select("gene", F.lit(1).alias("hit"))
    c = ad.brand_markers(spark, sf).join(e, "gene", "left").groupBy("cell_type").agg(F.count("*").alias("size"), F.count("hit").alias("in_both"))
    n = e.agg(F.count("*")).scalar()
    return c.select("cell_type", "in_both", (F.col("size") - F.col("in_both")).alias("only_set"), (n - F.col("in_both")).alias("only_expressed"))


@query("U03_melt", f"""WITH {LINE}, t AS (SELECT gene, sum(value) AS total, max(value) AS top, min(value) AS low FROM m GROUP BY 1)
SELECT gene, 'low' AS variable, {R('low')} AS value FROM t UNION ALL SELECT gene, 'top', {R('top')} FROM t UNION ALL SELECT gene, 'total', {R('total')} FROM t""")
def u03(spark, sf):
    t = ad.line_counts(spark, sf).expr.groupBy("gene").agg(F.sum("value").alias("total"), F.max("value").alias("top"), F.min("value").alias("low"))
    return t.unpivot("gene", ["total", "top", "low"], "variable", "value").select("gene", "variable", r6("value"))


@query("U04_K14_pivot_means", f"""WITH {LINE}, {REGIONS}, {NORM}, {GROUPS} SELECT gene,
 {', '.join(f"{R(f'max(mean) FILTER (WHERE cluster = {chr(39)}{i}{chr(39)})')} AS c{i}" for i in range(5))} FROM gm GROUP BY 1""")
def u04(spark, sf):
    g = A.group_moments(log_normalize(ad.line_counts(spark, sf)).stored(), ad.supplier_clusters(spark, sf))
    wide = A.to_wide(g, "cluster", "mean", [str(i) for i in range(5)])
    return wide.select("gene", *[r6(F.col(f"`{i}`"), f"c{i}") for i in range(5)])


@query("U06_equal_width_bins", f"""WITH {LINE}, t AS (SELECT gene, sum(value) AS reads FROM m GROUP BY 1)
SELECT gene, CAST(least(20, greatest(1, ceil((reads - min(reads) OVER ()) / ((max(reads) OVER () - min(reads) OVER ()) / 20)))) AS INTEGER) AS bin FROM t""")
def u06(spark, sf):
    t = A.reads_per_gene(ad.line_counts(spark, sf))
    e = t.agg(F.struct(F.min("reads").alias("lo"), F.max("reads").alias("hi"))).scalar()
    return t.select("gene", equal_width_bin(F.col("reads"), e.getField("lo"), e.getField("hi")).cast("int").alias("bin"))


@query("U07_split_markers", "SELECT DISTINCT cell_type, unnest(string_split(genes, ',')) AS gene FROM "
       "(SELECT p_type AS cell_type, string_agg(DISTINCT p_brand, ',') AS genes FROM part GROUP BY 1)")
def u07(spark, sf):
    sets = a16(spark, sf)
    return sets.select("cell_type", F.explode(F.split("genes", ",")).alias("gene")).distinct()


# ---- normalisation and the flagship -------------------------------------

@query("N01_log_normalize", f"WITH {LINE}, {NORM} SELECT gene, cell, {R('v')} AS value FROM nrm")
def n01(spark, sf):
    return entries(log_normalize(ad.line_counts(spark, sf)))


@query("N01_log_normalize_tokens", f"WITH {TOKENS}, {NORM} SELECT gene, cell, {R('v')} AS value FROM nrm")
def n01t(spark, sf):
    return entries(log_normalize(ad.token_counts(spark, sf).stored()))


@query("N02_rpkm", f"""WITH {LINE}, j AS (SELECT m.gene, cell, value, CAST(p_size AS DOUBLE) AS len FROM m
 JOIN part ON m.gene = CAST(p_partkey AS VARCHAR) WHERE p_brand <> 'Brand#11'),
t AS (SELECT cell, sum(value) AS reads FROM j GROUP BY 1)
SELECT gene, j.cell, {R('log2((value / (reads / 1e6)) / (len / 1000) + 1)')} AS value FROM j JOIN t ON j.cell = t.cell""")
def n02(spark, sf):
    lengths = ad.table(spark, sf, "part").filter("p_brand <> 'Brand#11'").select(
        F.col("p_partkey").cast("string").alias("gene"), F.col("p_size").alias("length"))
    return entries(rpkm(ad.line_counts(spark, sf), lengths))


@query("H01_hvg_seurat", f"""WITH {LINE}, {NC}, {NORM}, {MOMENTS},
b AS (SELECT gene, mean, var / mean AS d, CAST(greatest(1, ceil((mean - min(mean) OVER ()) / ((max(mean) OVER () - min(mean) OVER ()) / 20))) AS INTEGER) AS bin FROM gs),
zz AS (SELECT gene, mean, d, bin, (d - avg(d) OVER (PARTITION BY bin)) / nullif(stddev_samp(d) OVER (PARTITION BY bin), 0) AS z FROM b)
SELECT gene, {R('mean')} AS mean, {R('d')} AS dispersion, bin, {R('z')} AS z,
  CAST(row_number() OVER (ORDER BY round(z, 6) DESC NULLS LAST, gene) AS INTEGER) AS rank FROM zz
ORDER BY round(z, 6) DESC NULLS LAST, gene LIMIT 1000""")
def h01(spark, sf):
    top = seurat(log_normalize(ad.line_counts(spark, sf)), 1000, digits=6)
    return top.select("gene", r6("mean"), r6("dispersion"), "bin", r6("z"), "rank")


def flagship(spark, sf, n=50):
    """Filter, normalise and rank the variable genes of the part x supplier matrix."""
    m = FI.min_expressed(FI.min_reads(ad.line_counts(spark, sf).stored(), 1000), 2.0).stored()
    return seurat(log_normalize(m), n, digits=6).select("gene", r6("mean"), r6("dispersion"), "bin", r6("z"), "rank")


@query("flagship_filter_normalize_hvg", f"""WITH m0 AS (
  SELECT CAST(l_partkey AS VARCHAR) AS gene, CAST(l_suppkey AS VARCHAR) AS cell, sum(l_quantity) AS value FROM lineitem GROUP BY 1, 2),
m1 AS (SELECT * FROM m0 WHERE cell IN (SELECT cell FROM m0 GROUP BY 1 HAVING sum(value) > 1000)),
m AS (SELECT * FROM m1 WHERE gene IN (SELECT gene FROM m1 GROUP BY 1 HAVING count(*) FILTER (WHERE value > 0) > 2)),
{NC}, {NORM}, {MOMENTS},
b AS (SELECT gene, mean, var / mean AS d, CAST(greatest(1, ceil((mean - min(mean) OVER ()) / ((max(mean) OVER () - min(mean) OVER ()) / 20))) AS INTEGER) AS bin FROM gs),
zz AS (SELECT gene, mean, d, bin, (d - avg(d) OVER (PARTITION BY bin)) / nullif(stddev_samp(d) OVER (PARTITION BY bin), 0) AS z FROM b)
SELECT gene, {R('mean')} AS mean, {R('d')} AS dispersion, bin, {R('z')} AS z,
  CAST(row_number() OVER (ORDER BY round(z, 6) DESC NULLS LAST, gene) AS INTEGER) AS rank FROM zz
ORDER BY round(z, 6) DESC NULLS LAST, gene LIMIT 50""")
def flagship_query(spark, sf):
    return flagship(spark, sf)
