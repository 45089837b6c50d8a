"""Queries for tests, corrections, variable genes, quality control, annotation and models."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillcell.operators import celltypes as C
from quillcell.operators import contrasts as D
from quillcell.operators import filters as FI
from quillcell.operators import glm as G
from quillcell.operators import hvg as H
from quillcell.operators import linalg as L
from quillcell.operators import qc
from quillcell.operators.aggregates import group_median, group_moments
from quillcell.operators.multiplicity import average_rank, benjamini_hochberg, simes
from quillcell.operators.normalize import log_normalize
from quillcell.plans import adapters as ad
from quillcell.plans.catalog import (
    BRANDS, EMB, LABELS, LINE, LINEAR, NC, NORM, R, REGIONS, query, r6,
)
from quillcell.plans.queries_matrix import GROUPS, MEDIANS
from quillcell.session import cut_lineage, scratch_path
from quillcell.sources import sinks as SK
from quillcell.sources import tables as TB

# ---- corrections over a p-value column made of the order prices ----------

PV = "pv AS (SELECT o_orderkey AS id, o_custkey % 97 AS grp, o_orderpriority AS c, (CAST(o_totalprice * 100 AS BIGINT) % 5000) / 5000.0 AS p FROM orders)"


def p_values(spark, sf):
    cents = F.round(F.col("o_totalprice") * 100).cast("long")
    return ad.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 97).alias("grp"), F.col("o_orderpriority").alias("c"),
        ((cents % 5000) / 5000.0).alias("p"),
    )


@query("M01_W04_benjamini_hochberg", f"""WITH {PV}, r AS (SELECT id, p, row_number() OVER (ORDER BY p) AS k, count(*) OVER () AS n FROM pv),
q AS (SELECT id, p, least(1.0, min(n * p / k) OVER (ORDER BY p DESC, k DESC ROWS UNBOUNDED PRECEDING)) AS q FROM r)
SELECT id, {R('p')} AS p, {R('q')} AS q FROM q""")
def m01(spark, sf):
    return benjamini_hochberg(p_values(spark, sf), "p", "q").select("id", r6("p"), r6("q"))


@query("F18_significant", f"""WITH {PV}, r AS (SELECT id, p, row_number() OVER (ORDER BY p) AS k, count(*) OVER () AS n FROM (SELECT id, pow(p, 12) AS p FROM pv)),
q AS (SELECT id, p, least(1.0, min(n * p / k) OVER (ORDER BY p DESC, k DESC ROWS UNBOUNDED PRECEDING)) AS q FROM r)
SELECT id, {R('q')} AS q FROM q WHERE q < 0.10""")
def f18(spark, sf):
    sharp = p_values(spark, sf).withColumn("p", F.pow("p", F.lit(12)))
    return benjamini_hochberg(sharp, "p", "q").filter("q < 0.10").select("id", r6("q"))


@query("W03_average_rank", f"""WITH {PV}, a AS (SELECT grp, c, min(p) AS p FROM pv GROUP BY 1, 2)
SELECT grp, c, {R('p')} AS p, {R('rank() OVER (PARTITION BY grp ORDER BY p) + (count(*) OVER (PARTITION BY grp, p) - 1) / 2.0')} AS avg_rank FROM a""")
def w03(spark, sf):
    a = p_values(spark, sf).groupBy("grp", "c").agg(F.min("p").alias("p"))
    return average_rank(a, ["grp"], "p").select("grp", "c", r6("p"), r6("avg_rank"))


@query("D02_simes", f"""WITH {PV}, a AS (SELECT grp, c, min(p) AS p FROM pv GROUP BY 1, 2),
r AS (SELECT grp, p, rank() OVER (PARTITION BY grp ORDER BY p) + (count(*) OVER (PARTITION BY grp, p) - 1) / 2.0 AS k, count(*) OVER (PARTITION BY grp) AS m FROM a)
SELECT grp, {R('least(1.0, min(m * p / k))')} AS pvalue_simes FROM r GROUP BY 1""")
def d02(spark, sf):
    a = p_values(spark, sf).groupBy("grp", "c").agg(F.min("p").alias("p"))
    return simes(a, ["grp"], "p").select("grp", r6("pvalue_simes"))


# ---- differential expression --------------------------------------------

CONTRASTS = """s2 AS (SELECT gene, sum(m2) / (sum(n) - count(*)) AS s2, sum(n) - count(*) AS df FROM gm GROUP BY 1),
ct AS (SELECT a.cluster || '_vs_' || b.cluster AS comparison, a.gene, df, a.mean AS mean_A, b.mean AS mean_B, a.mean - b.mean AS "logFC",
  (a.mean - b.mean) / sqrt(nullif(s2, 0) * (1.0 / a.n + 1.0 / b.n)) AS t
  FROM gm a JOIN gm b ON a.gene = b.gene AND a.cluster <> b.cluster JOIN s2 ON a.gene = s2.gene)"""
CT_OUT = f"""SELECT comparison, gene, CAST(df AS BIGINT) AS df, {R('t')} AS t_stat, {R('"logFC"')} AS "logFC", {R('mean_A')} AS "mean_A", {R('mean_B')} AS "mean_B" FROM ct"""
DENSE_GROUPS = "gm AS (SELECT gene, cluster, count(*) AS n, avg(value) AS mean, var_pop(value) * count(*) AS m2 FROM m JOIN cl ON m.cell = cl.cell GROUP BY 1, 2)"


def _contrasts(moments):
    c = D.contrast_statistics(moments)
    return c.select("comparison", "gene", F.col("df").cast("long").alias("df"), *[r6(x) for x in ("t_stat", "logFC", "mean_A", "mean_B")])


@query("D01_J11_contrasts", f"WITH {LINE}, {REGIONS}, {NORM}, {GROUPS}, {CONTRASTS} {CT_OUT}")
def d01(spark, sf):
    return _contrasts(group_moments(log_normalize(ad.line_counts(spark, sf)).stored(), ad.supplier_clusters(spark, sf)))


@query("D01_contrasts_dense", f"WITH {EMB}, {LABELS}, {DENSE_GROUPS}, {CONTRASTS} {CT_OUT}")
def d01_dense(spark, sf):
    return _contrasts(group_moments(ad.embedding_matrix(spark, sf), ad.embedding_clusters(spark, sf)))


# the upper tail of Student's t as a finite sum: powers of the cosine of atan(t / sqrt(df)), by the parity of df
TAIL = """cf AS (SELECT df, sqrt(df) AS root, df % 2 AS odd, list_transform(generate_series(0, (CAST(df AS BIGINT) - 2 - df % 2) // 2), lambda j:
    CASE WHEN df % 2 = 0 THEN exp(lgamma(j + 0.5) - lgamma(0.5) - lgamma(j + 1.0)) ELSE exp(lgamma(j + 1.0) - lgamma(j + 1.5)) * sqrt(pi()) / 2 END) AS coef
  FROM (SELECT DISTINCT CAST(df AS BIGINT) AS df FROM ct)),
an AS (SELECT ct.*, odd, coef, atan(t / root) AS th FROM ct JOIN cf ON ct.df = cf.df),
su AS (SELECT *, sin(th) * coalesce(list_sum(list_transform(coef, lambda c, i: c * pow(cos(th), 2 * (i - 1) + odd))), 0) AS s FROM an),
pv AS (SELECT *, (1 - CASE WHEN odd = 1 THEN 2 / pi() * (th + s) ELSE s END) / 2 AS p FROM su),
rp AS (SELECT *, row_number() OVER (ORDER BY p) AS k, count(p) OVER () AS n FROM pv),
qv AS (SELECT *, CASE WHEN p IS NOT NULL THEN least(1.0, min(n * p / k) OVER (ORDER BY p DESC NULLS LAST, k DESC ROWS UNBOUNDED PRECEDING)) END AS q FROM rp)"""


def _tests(spark, sf):
    return D.pairwise_t_tests(ad.embedding_matrix(spark, sf), ad.embedding_clusters(spark, sf))


@query("D01_K12_t_tests", f"""WITH {EMB}, {LABELS}, {DENSE_GROUPS}, {CONTRASTS}, {TAIL}
SELECT comparison, split_part(comparison, '_vs_', 1) AS cluster, split_part(comparison, '_vs_', 2) AS other, gene, {R('p')} AS p_val, {R('q')} AS "FDR",
  {R('t')} AS t_stat, {R('"logFC"')} AS "logFC", {R('mean_A')} AS "mean_A", {R('mean_B')} AS "mean_B" FROM qv""")
def d01_p(spark, sf):
    t = _tests(spark, sf)
    return t.select("comparison", "cluster", "other", "gene", *[r6(c) for c in ("p_val", "FDR", "t_stat", "logFC", "mean_A", "mean_B")])


@query("D01_any_direction", f"""WITH {LINE}, {REGIONS}, {NORM}, {GROUPS}, {CONTRASTS}, {TAIL}
SELECT comparison, gene, {R('2 * least(p, 1 - p)')} AS p_val FROM pv""")
def d01_any(spark, sf):
    t = D.pairwise_t_tests(log_normalize(ad.line_counts(spark, sf)).stored(), ad.supplier_clusters(spark, sf), "any")
    return t.select("comparison", "gene", r6("p_val"))


@query("K11_wide_p_values", f"""WITH {EMB}, {LABELS}, {DENSE_GROUPS}, {CONTRASTS}, {TAIL}
SELECT 'gene,' || string_agg(comparison, ',' ORDER BY comparison) AS value FROM (SELECT DISTINCT comparison FROM pv)
UNION ALL SELECT gene || ',' || string_agg(coalesce(CAST(CAST(p AS DECIMAL(9, 6)) AS VARCHAR), ''), ',' ORDER BY comparison) FROM pv GROUP BY gene""")
def k11(spark, sf):
    """The wide table of p-values, to six places."""
    return SK.wide_lines(_tests(spark, sf).withColumn("p_val", F.col("p_val").cast("decimal(9,6)")), "comparison", "p_val", ",")


@query("K11_K14_wide_lines", f"""WITH {LINE}, k AS (SELECT DISTINCT cell FROM m),
v AS (SELECT g.gene, k.cell, count(m.value) AS n FROM (SELECT DISTINCT gene FROM m) g CROSS JOIN k
  LEFT JOIN m ON m.gene = g.gene AND m.cell = k.cell GROUP BY 1, 2)
SELECT 'gene,' || string_agg(cell, ',' ORDER BY cell) AS value FROM k
UNION ALL SELECT gene || ',' || string_agg(CASE WHEN n > 0 THEN CAST(n AS VARCHAR) ELSE '' END, ',' ORDER BY cell) FROM v GROUP BY gene""")
def k11_lines(spark, sf):
    # the wide writer with a column per supplier
    return SK.wide_lines(ad.line_counts(spark, sf).expr.withColumn("n", F.lit(1)), "cell", "n", ",")


@query("K12_long_table", f"""WITH {EMB}, {LABELS}, {DENSE_GROUPS}, {CONTRASTS}, {TAIL}
SELECT comparison AS "comparison_A_vs_B", gene, {R('p')} AS p_val, {R('q')} AS "FDR", {R('t')} AS t_stat, {R('"logFC"')} AS "logFC", {R('mean_A')} AS "mean_A", {R('mean_B')} AS "mean_B" FROM qv""")
def k12(spark, sf):
    """The long table as the pipeline writes it, read back by its column names."""
    path = scratch_path(spark, "tests")
    SK.write_csv(SK.rename(_tests(spark, sf).drop("cluster", "other"), SK.LONG_NAMES), path, "\t", True)
    back = spark.read.csv(path, sep="\t", header=True)
    return back.select("comparison_A_vs_B", "gene", *[r6(F.col(f"`{c}`"), c.replace(".", "_")) for c in ("p_val", "FDR", "t_stat", "logFC", "mean.A", "mean.B")])


@query("D03_K13_discovered_markers", f"""WITH {LINE}, {REGIONS}, {NORM}, {GROUPS}, {CONTRASTS}, {TAIL},
o AS (SELECT split_part(comparison, '_vs_', 1) AS cluster, gene, p FROM pv WHERE p IS NOT NULL),
r AS (SELECT cluster, gene, p, rank() OVER (PARTITION BY cluster, gene ORDER BY p) + (count(*) OVER (PARTITION BY cluster, gene, p) - 1) / 2.0 AS k,
  count(*) OVER (PARTITION BY cluster, gene) AS m FROM o)
SELECT cluster, gene, {R('least(1.0, min(m * p / k))')} AS pvalue_simes FROM r GROUP BY 1, 2""")
def d03(spark, sf):
    """The markers as the pipeline writes them, read back by their column names."""
    found = D.discover_markers(log_normalize(ad.line_counts(spark, sf)).stored(), ad.supplier_clusters(spark, sf))[1]
    path = scratch_path(spark, "markers")
    SK.write_csv(SK.rename(found, SK.SIMES_NAMES), path, "\t", True)
    return spark.read.csv(path, sep="\t", header=True).select("cluster", "gene", r6(F.col("`pvalue.Simes`"), "pvalue_simes"))


# ---- cell types ----------------------------------------------------------

MK = f"{BRANDS}, ms AS (SELECT gene, cell_type FROM mk WHERE contains(species, 'Mm') AND ui < 0.05)"
WEIGHTS = "fr AS (SELECT gene, count(*) AS f FROM ms GROUP BY 1), wt AS (SELECT gene, f, 1 + sqrt(coalesce((max(f) OVER () - f) / CAST(nullif(max(f) OVER () - min(f) OVER (), 0) AS DOUBLE), 0)) AS w FROM fr)"
SCORES = """zs AS (SELECT gene, cluster, median, coalesce((median - avg(median) OVER (PARTITION BY cluster)) / nullif(stddev_pop(median) OVER (PARTITION BY cluster), 0), 0) AS z FROM md),
tot AS (SELECT cluster, count(*) FILTER (WHERE median > 0) AS ne, count(*) FILTER (WHERE median = 0) AS nz FROM md GROUP BY 1),
sc AS (SELECT zs.cluster, cell_type, sum(z * w) / pow(count(*), 0.3) AS activity, count(*) FILTER (WHERE median > 0) AS a,
  count(*) FILTER (WHERE median = 0) AS b, coalesce(string_agg(zs.gene, ',' ORDER BY zs.gene) FILTER (WHERE median > 0), 'NA') AS markers
  FROM zs JOIN (SELECT DISTINCT gene, cell_type FROM ms) s ON zs.gene = s.gene JOIN wt ON wt.gene = zs.gene GROUP BY 1, 2),
fx AS (SELECT sc.*, ne - a AS c, nz - b AS d FROM sc JOIN tot ON sc.cluster = tot.cluster),
fp AS (SELECT cluster, cell_type, activity, markers, a, b, c, d, least(1.0, list_sum(list_transform(generate_series(a, least(a + b, a + c)),
  lambda k: exp(lgamma(a + c + 1) + lgamma(b + d + 1) + lgamma(a + b + 1) + lgamma(c + d + 1) - lgamma(a + b + c + d + 1)
   - lgamma(k + 1) - lgamma(a + c - k + 1) - lgamma(a + b - k + 1) - lgamma(d - a + k + 1))))) AS p FROM fx),
rk AS (SELECT *, row_number() OVER (ORDER BY p) AS k, count(*) OVER () AS n FROM fp),
fq AS (SELECT *, least(1.0, min(n * p / k) OVER (ORDER BY p DESC, k DESC ROWS UNBOUNDED PRECEDING)) AS padj FROM rk)"""
CTA = f"{LINE}, {REGIONS}, {NORM}, {MEDIANS}, {MK}, {WEIGHTS}, {SCORES}"


def _markers(spark, sf):
    return C.select_markers(ad.brand_markers(spark, sf), "mouse")


def _medians(spark, sf):
    return group_median(log_normalize(ad.line_counts(spark, sf)).stored(), ad.supplier_clusters(spark, sf))


@query("C03_S20_F17_markers", f"WITH {MK} SELECT gene, cell_type, count(*) OVER (PARTITION BY gene) AS freq FROM ms")
def c03(spark, sf):
    path = scratch_path(spark, "markers")
    names = {"gene": "official gene symbol", "cell_type": "cell type", "ui": "ubiquitousness index"}
    SK.write_csv(ad.brand_markers(spark, sf).withColumnsRenamed(names), path, "\t", True)
    m = C.select_markers(TB.markers(spark, path), "mouse")
    return m.join(C.marker_weights(m).select("gene", "freq"), "gene").select("gene", "cell_type", "freq")


@query("J08_marker_weights", f"WITH {MK}, {WEIGHTS} SELECT gene, f AS freq, {R('w')} AS weight FROM wt")
def j08(spark, sf):
    return C.marker_weights(_markers(spark, sf)).select("gene", "freq", r6("weight"))


@query("W02_z_over_genes", f"WITH {CTA} SELECT gene, cluster, {R('median')} AS median, {R('z')} AS z FROM zs")
def w02(spark, sf):
    return C.standardized_medians(_medians(spark, sf)).select("gene", "cluster", r6("median"), r6("z"))


@query("C01_J12_activity", f"WITH {CTA} SELECT cluster, cell_type, {R('activity')} AS activity, a AS in_exp, b AS in_zero, c AS out_exp, d AS out_zero, markers FROM fx")
def c01(spark, sf):
    s = C.cell_type_scores(_medians(spark, sf), _markers(spark, sf))
    return s.select("cluster", "cell_type", r6("activity"), "in_exp", "in_zero", "out_exp", "out_zero", "markers")


@query("C01_K15_cell_types", f"WITH {CTA} SELECT cluster, cell_type, {R('activity')} AS activity, {R('p')} AS p_val, {R('padj')} AS padj, markers FROM fq")
def c01_full(spark, sf):
    t = C.annotate_clusters(log_normalize(ad.line_counts(spark, sf)).stored(), ad.supplier_clusters(spark, sf), _markers(spark, sf))
    return t.select("cluster", "cell_type", r6("activity"), r6("p_val"), r6("padj"), "markers")


@query("C01_K16_W05_F19_best", f"""WITH {CTA}, bst AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY round(activity, 6) DESC, cell_type) AS rn FROM fq)
SELECT cluster, CASE WHEN padj > 0.10 THEN 'Unknown' ELSE cell_type END AS cell_type, {R('activity')} AS activity, {R('p')} AS p_val, {R('padj')} AS padj, markers FROM bst WHERE rn = 1""")
def c01_best(spark, sf):
    t = C.annotate_clusters(log_normalize(ad.line_counts(spark, sf)).stored(), ad.supplier_clusters(spark, sf), _markers(spark, sf))
    return C.best_cell_types(t, 6).select("cluster", "cell_type", r6("activity"), r6("p_val"), r6("padj"), "markers")


@query("C02_S21_F16_symbols", f"""WITH {LINE}, sy AS (SELECT CAST(p_partkey AS VARCHAR) AS gene, 'SYM' || CAST(p_partkey % 1500 AS VARCHAR) AS symbol FROM part),
u AS (SELECT * FROM sy WHERE symbol IN (SELECT symbol FROM sy GROUP BY 1 HAVING count(*) = 1))
SELECT symbol AS gene, cell, {R('value')} AS value FROM m JOIN u ON m.gene = u.gene""")
def c02(spark, sf):
    m = ad.line_counts(spark, sf)
    ids = m.keep(m.expr.withColumn("gene", F.concat(F.lit("ensmusg"), "gene")))
    sy = ad.table(spark, sf, "part").select(
        F.concat(F.lit("ENSMUSG"), F.col("p_partkey").cast("string")).alias("ensembl"),
        F.concat(F.lit("Sym"), (F.col("p_partkey") % 1500).cast("string")).alias("symbol"),
    )
    path = scratch_path(spark, "symbols")
    SK.write_csv(sy, path, "\t")
    return C.map_symbols(ids, TB.symbols(spark, path)).expr.select("gene", "cell", r6("value"))


# ---- variable genes ------------------------------------------------------

@query("H02_brennecke_moments", f"WITH {LINE}, {NC}, {NORM}, {LINEAR} SELECT gene, n, {R('mean')} AS mean, {R('var')} AS var, {R('var / (mean * mean)')} AS cv2 FROM gs")
def h02m(spark, sf):
    g = H.brennecke_moments(log_normalize(ad.line_counts(spark, sf)))
    return g.select("gene", "n", r6("mean"), r6("var"), r6("cv2"))


@query("H02_hvg_brennecke")
def h02(spark, sf):
    return H.brennecke(log_normalize(ad.line_counts(spark, sf)))


def _moments_of(name, where):
    return f"""{name}m AS (SELECT * FROM m WHERE {where}), {name}t AS (SELECT cell, sum(value) AS reads FROM {name}m GROUP BY 1),
{name}n AS (SELECT count(*) AS n FROM {name}t), {name}v AS (SELECT gene, log2(value * 10000.0 / reads + 1) AS v FROM {name}m JOIN {name}t ON {name}m.cell = {name}t.cell),
{name}s AS (SELECT gene, count(*) AS z, avg(v) AS mz, coalesce(var_pop(v), 0) * count(*) AS m2z FROM {name}v GROUP BY 1),
{name}g AS (SELECT gene, z * mz / n AS mean, (m2z + mz * mz * z * (n - z) / n) / (n - 1) AS var FROM {name}s, {name}n)"""


# the quartic as a sum of polynomials that are orthogonal on the spike-in means (three-term recurrence)
QUARTIC = """pt AS (SELECT (mean - avg(mean) OVER ()) / stddev_pop(mean) OVER () AS u, ln(var) AS y FROM sg WHERE var > 0),
ab AS (SELECT avg(mean) AS mu, stddev_pop(mean) AS sd FROM sg WHERE var > 0),
k0 AS (SELECT avg(u) AS a0, count(*) AS n0, avg(y) AS c0 FROM pt),
p1 AS (SELECT u, y, u - a0 AS q1 FROM pt, k0), k1 AS (SELECT sum(u * q1 * q1) / sum(q1 * q1) AS a1, sum(q1 * q1) AS n1, sum(y * q1) / sum(q1 * q1) AS c1 FROM p1),
p2 AS (SELECT u, y, q1, (u - a1) * q1 - n1 / n0 AS q2 FROM p1, k0, k1),
k2 AS (SELECT sum(u * q2 * q2) / sum(q2 * q2) AS a2, sum(q2 * q2) AS n2, sum(y * q2) / sum(q2 * q2) AS c2 FROM p2),
p3 AS (SELECT u, y, q2, (u - a2) * q2 - n2 / n1 * q1 AS q3 FROM p2, k1, k2),
k3 AS (SELECT sum(u * q3 * q3) / sum(q3 * q3) AS a3, sum(q3 * q3) AS n3, sum(y * q3) / sum(q3 * q3) AS c3 FROM p3),
k4 AS (SELECT sum(y * q4) / sum(q4 * q4) AS c4 FROM (SELECT y, (u - a3) * q3 - n3 / n2 * q2 AS q4 FROM p3, k2, k3)),
e AS (SELECT gene, mean, var, (mean - mu) / sd AS u, k0.*, k1.*, k2.*, k3.*, k4.* FROM dg, ab, k0, k1, k2, k3, k4),
e1 AS (SELECT *, u - a0 AS q1 FROM e), e2 AS (SELECT *, (u - a1) * q1 - n1 / n0 AS q2 FROM e1), e3 AS (SELECT *, (u - a2) * q2 - n2 / n1 * q1 AS q3 FROM e2),
bv AS (SELECT gene, mean, var, var - exp(c0 + c1 * q1 + c2 * q2 + c3 * q3 + c4 * ((u - a3) * q3 - n3 / n2 * q2)) AS bio FROM e3)"""
NOT_SPIKE, SPIKE = "CAST(gene AS BIGINT) % 3 <> 0", "CAST(gene AS BIGINT) % 3 = 0"


@query("H03_hvg_scran", f"""WITH {LINE}, {_moments_of('d', NOT_SPIKE)}, {_moments_of('s', SPIKE)}, {QUARTIC}
SELECT gene, {R('mean')} AS mean, {R('var')} AS var, {R('bio')} AS bio_var, CAST(row_number() OVER (ORDER BY bio DESC NULLS LAST, gene) AS INTEGER) AS rank
FROM bv ORDER BY bio DESC NULLS LAST, gene LIMIT 1000""")
def h03(spark, sf):
    # every third part stands for a spike-in gene
    m = ad.line_counts(spark, sf)
    third = F.when(F.col("gene").cast("long") % 3 == 0, F.concat(F.lit("ERCC-"), "gene")).otherwise(F.col("gene"))
    data, spikes = FI.split_spikes(m.keep(m.expr.withColumn("gene", third)))
    return H.scran(log_normalize(data), log_normalize(spikes)).select("gene", r6("mean"), r6("var"), r6("bio_var"), "rank")


CHEN = f"""{LINE}, {NC}, {NORM}, {LINEAR},
p AS (SELECT gene, log10(mean) AS lx, log10(sqrt(var) / mean) AS ly FROM gs WHERE mean > 0 AND var > 0),
fit AS (SELECT regr_slope(ly, lx) AS k, regr_intercept(ly, lx) AS b, min(lx) AS lo, max(lx) AS hi FROM p),
g AS (SELECT i, lo + i * 0.001 AS x, k * (lo + i * 0.001) + b AS y FROM fit, unnest(generate_series(0, CAST(ceil((hi - lo) / 0.001) AS BIGINT) - 1)) AS u(i)),
d AS (SELECT gene, lx, ly, min_by((x, y, sqrt((x - lx) * (x - lx) + (y - ly) * (y - ly))), sqrt((x - lx) * (x - lx) + (y - ly) * (y - ly))) AS best
  FROM p JOIN g ON x >= lx - 0.2 AND x < lx + 0.2 GROUP BY 1, 2, 3)"""


@query("H04_chen_distance", f"WITH {CHEN} SELECT gene, {R('lx')} AS lx, {R('ly')} AS ly, {R('abs(best[3])')} AS dist FROM d")
def h04d(spark, sf):
    points = H.cut_lineage(H.mean_cv_points(log_normalize(ad.line_counts(spark, sf))))
    slope, intercept = points.agg(F.regr_slope("ly", "lx"), F.regr_intercept("ly", "lx")).first()
    return H.curve_distance(points, slope, intercept).select("gene", r6("lx"), r6("ly"), r6(F.abs("dist"), "dist"))


@query("H04_hvg_chen")
def h04(spark, sf):
    return H.chen(log_normalize(ad.line_counts(spark, sf)))


@query("H05_dropout_moments", f"""WITH {LINE}, {NC}, {NORM}, lin AS (SELECT gene, pow(2, v) - 1 AS v FROM nrm),
s AS (SELECT gene, n, 1 - count(*) FILTER (WHERE v > 0) / CAST(n AS DOUBLE) AS p, sum(v) / n AS s, sum(v * v) / n AS s2 FROM lin, nc GROUP BY gene, n)
SELECT gene, {R('p')} AS p, {R('sqrt(p * (1 - p) / n)')} AS p_err, {R('s')} AS s, {R('sqrt(greatest(0, s2 - s * s) / n)')} AS s_err FROM s""")
def h05m(spark, sf):
    g = H.dropout_moments(log_normalize(ad.line_counts(spark, sf)))
    return g.select("gene", *[r6(c) for c in ("p", "p_err", "s", "s_err")])


@query("H05_hvg_m3drop")
def h05(spark, sf):
    return H.m3drop(log_normalize(ad.token_counts(spark, sf).stored()).stored())


UMI = f"""{LINE}, ti AS (SELECT cell, sum(value) AS t FROM m GROUP BY 1), tot AS (SELECT count(*) AS nc, sum(t) AS total, sum(t * t) AS t2 FROM ti),
g AS (SELECT gene, sum(value) AS tj, sum(value * value) AS x2, sum(value * t) AS xt, count(*) AS ne FROM m JOIN ti ON m.cell = ti.cell GROUP BY 1),
v AS (SELECT gene, tj, nc, total, nc - ne AS dj, (x2 - 2 * (tj / total) * xt + (tj / total) * (tj / total) * t2) / nc AS var,
  tj * tj * (t2 / (total * total)) / ((nc - 1) * ((x2 - 2 * (tj / total) * xt + (tj / total) * (tj / total) * t2) / nc) - tj) AS size FROM g, tot)"""


@query("H06_umi_moments", f"WITH {UMI} SELECT gene, {R('tj')} AS tj, {R('var')} AS var_pop, {R('size')} AS raw_size, dj AS dropouts FROM v")
def h06m(spark, sf):
    g = H.umi_moments(ad.line_counts(spark, sf))
    return g.select("gene", r6("tj"), r6("var_pop"), r6("raw_size"), "dropouts")


@query("H06_expected_dropout", f"""WITH {UMI}, e AS (SELECT v.gene, sum(pow(1 + (tj / total) * t / 2.0, -2.0)) AS p, sum(pow(1 + (tj / total) * t / 2.0, -2.0) * (1 - pow(1 + (tj / total) * t / 2.0, -2.0))) AS q FROM v, ti GROUP BY 1)
SELECT gene, {R('p')} AS p_sum, {R('q')} AS v_sum FROM e""")
def h06e(spark, sf):
    m = ad.line_counts(spark, sf)
    g = H.umi_moments(m).select("gene", (F.col("tj") / F.col("total")).alias("rate"), F.lit(2.0).alias("size"))
    e = H.expected_dropout(g, m.expr.groupBy("cell").agg(F.sum("value").alias("t")))
    return e.select("gene", r6("p_sum"), r6("v_sum"))


# the upper tail of the normal distribution from a series without cancellation
def _upper(z):
    return f"""CASE WHEN {z} > 9 THEN 0.0 WHEN {z} < -9 THEN 1.0 ELSE 0.5 - sign({z}) * exp(-{z} * {z} / 2) / sqrt(2 * pi()) *
  list_sum(list_transform(range(0, 160), lambda k: exp((2 * k + 1) * ln(greatest(abs({z}), 1e-300)) + 0.5 * ln(pi()) - (k + 1) * ln(2.0) - lgamma(k + 1.5)))) END"""


def _adjusted(source):
    return f"""rp AS (SELECT *, row_number() OVER (ORDER BY p) AS k, count(p) OVER () AS m FROM {source}),
qv AS (SELECT *, CASE WHEN p IS NOT NULL THEN least(1.0, min(m * p / k) OVER (ORDER BY p DESC NULLS LAST, k DESC ROWS UNBOUNDED PRECEDING)) END AS q FROM rp)"""


UMI_TEST = f"""{UMI}, mx AS (SELECT max(size) AS top FROM v),
sz AS (SELECT v.*, greatest(1e-10, CASE WHEN size < 0 THEN 10 * top ELSE size END) AS sz, ln(tj / nc) AS lm FROM v, mx),
hi AS (SELECT max(sz) AS top, count(*) FILTER (WHERE log2(tj / nc) > 4) AS high FROM sz),
ft AS (SELECT regr_slope(ln(sz), lm) AS k, regr_intercept(ln(sz), lm) AS b FROM sz, hi WHERE sz < hi.top AND tj > 0 AND (high <= 2000 OR log2(tj / nc) > 4)),
tr AS (SELECT gene, tj / total AS rate, nc, dj, exp(b + k * lm) AS size FROM sz, ft),
ex AS (SELECT gene, any_value(nc) AS nc, any_value(dj) AS dj, sum(exp(-size * ln(1 + rate * t / size))) AS ps,
  sum(exp(-size * ln(1 + rate * t / size)) * (1 - exp(-size * ln(1 + rate * t / size)))) AS vs FROM tr, ti GROUP BY gene),
oe AS (SELECT gene, dj / CAST(nc AS DOUBLE) AS o, greatest(ps / nc, 1.0 / nc) AS e, nc, vs FROM ex),
zz AS (SELECT gene, o, e, (o - e) / nullif(sqrt(vs / (nc * CAST(nc AS DOUBLE)) + o * (1 - o) / nc), 0) AS z FROM oe),
zp AS (SELECT *, CASE WHEN z IS NOT NULL THEN {_upper('z')} END AS p FROM zz), {_adjusted('zp')}"""


@query("H06_hvg_m3drop_umi", f"""WITH {UMI_TEST}
SELECT gene, {R('o')} AS observed, {R('e')} AS expected, {R('z')} AS z, {R('p')} AS p_val, {R('q')} AS padj FROM qv WHERE q < 0.10""")
def h06(spark, sf):
    """All genes that pass, however many."""
    found = H.m3drop_umi(ad.line_counts(spark, sf).stored(), 2**31 - 1)
    return found.select("gene", *[r6(c) for c in ("observed", "expected", "z", "p_val", "padj")])


# ---- quality control -----------------------------------------------------

@query("Q01_K05_low_quality_cells")
def q01(spark, sf):
    data, spikes = FI.split_spikes(ad.named_counts(spark, sf))
    rrna = ad.gene_names(spark, sf).filter("p_type = 'PROMO'").select("gene")
    return qc.low_quality_cells(data, spikes, rrna)


@query("Q01_robust_distances_orders")
def q01_orders(spark, sf):
    o = ad.table(spark, sf, "lineitem").groupBy("l_orderkey").agg(
        F.sum("l_quantity").alias("q"), F.avg("l_discount").alias("d"), F.ln(F.sum("l_extendedprice")).alias("p"))
    return qc.flag_outliers(qc.robust_distances(o.withColumnRenamed("l_orderkey", "cell"), ["q", "d", "p"]))


# ---- dimension reduction -------------------------------------------------

def _rebuilt(spark, p, weights):
    """``i, j, value``: the gene-by-gene table that the components stand for."""
    w = spark.createDataFrame([(i, float(v)) for i, v in enumerate(weights, 1)], "pc int, w double")
    a = p.loading_table(spark).select(F.col("gene").alias("a"), "pc", F.col("loading").alias("la"))
    b = a.select(F.col("a").alias("b"), "pc", F.col("la").alias("lb")).join(w, "pc")
    both = a.join(b, "pc").groupBy(F.col("a").cast("int").alias("i"), F.col("b").cast("int").alias("j")).agg(F.sum(F.col("la") * F.col("lb") * F.col("w")).alias("value"))
    return both.select("i", "j", r6("value"))


def _pairs_of(expr):
    return f"""WITH {EMB} SELECT CAST(a.gene AS INTEGER) AS i, CAST(b.gene AS INTEGER) AS j, {R(expr)} AS value
FROM m a JOIN m b ON a.cell = b.cell GROUP BY 1, 2"""


@query("P01_gram", _pairs_of("sum(a.value * b.value)"))
def p01g(spark, sf):
    """All components together give back the sums of products of every two genes."""
    m = ad.embedding_matrix(spark, sf).stored()
    p = L.truncated_svd(m, m.genes, 1000)[0]
    return _rebuilt(spark, p, p.strength**2)


@query("P02_covariance", _pairs_of("covar_samp(a.value, b.value)"))
def p02c(spark, sf):
    m = ad.embedding_matrix(spark, sf).stored()
    p = L.centred_pca(m, m.genes, 1000)[0]
    return _rebuilt(spark, p, p.strength)


@query("P02_correlation", _pairs_of("corr(a.value, b.value)"))
def p02s(spark, sf):
    m = ad.embedding_matrix(spark, sf).stored()
    p = L.centred_pca(m, m.genes, 1000, scale=True)[0]
    return _rebuilt(spark, p, p.strength)


def _images(m, genes, scores):
    """``gene, pc, raw``: the sums of products of each of ``genes`` with each component.

    Entries of other genes go before they meet the scores, so a task leaves a row per gene of the set and component.
    """
    kept = m.expr.join(F.broadcast(genes.select("gene")), "gene")  # as many rows as an option allows
    each = kept.join(scores, "cell").select("gene", "value", F.posexplode("features").alias("pc", "score"))
    return each.groupBy("gene", (F.col("pc") + 1).alias("pc")).agg(F.sum(F.col("value") * F.col("score")).alias("raw"))


def _equations(spark, m, p, scores, weights, n):
    """``pc, residual, length, energy``: how well each component solves its equation; exact ones give 0, 1 and 1.

    The residual of ``Z'(Z v) = w v`` is taken over all genes of the components as a share of the largest ``w``; stored
    entries meet the scores, and the centre is one number per gene, so this does not use the solver.
    """
    scores = cut_lineage(scores)
    each = L.explode_scores(scores)
    stats = spark.createDataFrame([(g, float(c), float(s)) for g, c, s in zip(p.genes, p.centre, p.scale)], "gene string, centre double, by double")
    sums = each.groupBy("pc").agg(F.sum("score").alias("total"), F.sum(F.col("score") * F.col("score")).alias("energy"))
    w = spark.createDataFrame([(i, float(v)) for i, v in enumerate(weights, 1)], "pc int, w double").join(sums, "pc")
    full = p.loading_table(spark).join(_images(m, stats, scores), ["gene", "pc"], "left").join(stats, "gene").join(w, "pc")
    gap = (F.coalesce("raw", F.lit(0.0)) - F.col("centre") * F.col("total")) / F.col("by") / n - F.col("w") * F.col("loading")
    top = float(max(weights))
    return full.filter(F.col("w") > 1e-9 * top).groupBy("pc").agg(
        F.max(F.abs(gap / top)).alias("residual"), F.sum(F.col("loading") * F.col("loading")).alias("length"),
        F.first(F.col("energy") / n / F.col("w")).alias("energy")).select("pc", r6("residual"), r6("length"), r6("energy"))


def _solved(lost):
    """As many components as the cells have dimensions, at most 75; centring takes one of them."""
    return f"""SELECT CAST(i AS INTEGER) AS pc, 0.0::DOUBLE AS residual, 1.0::DOUBLE AS length, 1.0::DOUBLE AS energy
FROM range(1, 76) t(i) WHERE i <= (SELECT count(DISTINCT l_suppkey) FROM lineitem) - {lost}"""


@query("P01_singular_equations", _solved(0))
def p01e(spark, sf):
    m = log_normalize(ad.line_counts(spark, sf)).stored()
    p, scores = L.truncated_svd(m, H.seurat(m, 1000), 75)
    return _equations(spark, m, p, scores, p.strength**2, 1)


@query("P02_principal_equations", _solved(1))
def p02e(spark, sf):
    m = log_normalize(ad.line_counts(spark, sf)).stored()
    p, scores = L.centred_pca(m, H.seurat(m, 1000), 75, scale=True)
    return _equations(spark, m, p, scores, p.strength, m.cells.count() - 1)


@query("P01_F10_svd")
def p01(spark, sf):
    m = log_normalize(ad.line_counts(spark, sf)).stored()
    return L.explode_scores(L.truncated_svd(m, H.seurat(m, 1000), 75)[1])


@query("P02_K07_pca")
def p02(spark, sf):
    m = log_normalize(ad.line_counts(spark, sf)).stored()
    return L.explode_scores(L.centred_pca(m, H.seurat(m, 1000), 75)[1])


# ---- linear models -------------------------------------------------------

def coefficients(spark, coef, names):
    return spark.createDataFrame([(n, float(b)) for n, b in zip(["intercept", *names], coef)], "name string, estimate double")


def _prices(spark, sf):
    return ad.table(spark, sf, "lineitem").select(
        (F.col("l_extendedprice") / 1000).alias("y"), F.col("l_quantity").alias("x1"), F.col("l_discount").alias("x2"),
        (F.col("l_quantity") > 25).cast("double").alias("b"), F.col("l_tax").alias("x3"),
    )


@query("L01_L02_gaussian", f"""WITH d AS (SELECT l_extendedprice / 1000 AS y, l_quantity AS x1 FROM lineitem)
SELECT 'intercept' AS name, {R('regr_intercept(y, x1)')} AS estimate FROM d UNION ALL SELECT 'x1', {R('regr_slope(y, x1)')} FROM d""")
def l01(spark, sf):
    fit = G.fit_glm(_prices(spark, sf), ["x1"], "y", G.GAUSSIAN)
    return coefficients(spark, fit.coef, ["x1"]).select("name", r6("estimate"))


@query("L02_family_fits")
def l02(spark, sf):
    d = _prices(spark, sf).filter("y > 0")
    rows = []
    for family, label in ((G.BERNOULLI, "b"), (G.POISSON, "x1"), (G.QUASI_POISSON, "x1"), (G.GAMMA, "y"), (G.EXPONENTIAL, "y"), (G.GAMMA_MIXED_LINK, "y")):
        fit = G.fit_glm(d, ["x2", "x3"], label, family)
        for name, b, se, p in zip(["intercept", "x2", "x3"], fit.coef, fit.standard_errors, fit.p_values):
            rows.append((family.name, name, float(b), float(se), float(p), float(fit.dispersion)))
    return spark.createDataFrame(rows, "family string, name string, estimate double, std_error double, p_val double, dispersion double")


@query("L01_two_predictors", f"""WITH d AS (SELECT l_extendedprice / 1000 AS y, l_quantity AS a, l_tax AS b FROM lineitem),
s AS (SELECT avg(y) AS my, avg(a) AS ma, avg(b) AS mb, var_pop(a) AS aa, var_pop(b) AS bb, covar_pop(a, b) AS ab, covar_pop(a, y) AS ay, covar_pop(b, y) AS cy FROM d),
c AS (SELECT *, (bb * ay - ab * cy) / (aa * bb - ab * ab) AS k, (aa * cy - ab * ay) / (aa * bb - ab * ab) AS l FROM s)
SELECT 'intercept' AS name, {R('my - k * ma - l * mb')} AS estimate FROM c UNION ALL SELECT 'x1', {R('k')} FROM c UNION ALL SELECT 'x3', {R('l')} FROM c""")
def l01_two(spark, sf):
    fit = G.fit_glm(_prices(spark, sf), ["x1", "x3"], "y", G.GAUSSIAN)
    return coefficients(spark, fit.coef, ["x1", "x3"]).select("name", r6("estimate"))


FITS = ((G.BERNOULLI, "b"), (G.POISSON, "x1"), (G.QUASI_POISSON, "x1"), (G.GAMMA, "y"), (G.EXPONENTIAL, "y"))
SCORES_ZERO = " UNION ALL ".join(f"SELECT '{f.name}' AS family, '{n}' AS name, 0.0::DOUBLE AS score" for f, _ in FITS for n in ("intercept", "x2", "x3"))


@query("L02_score_equations", SCORES_ZERO)
def l02s(spark, sf):
    """What each fit leaves of the derivative of its likelihood, as a share of the sum of its absolute terms."""
    d = _prices(spark, sf).filter("y > 0")
    rows, names = [], ["intercept", "x2", "x3"]
    for family, label in FITS:
        fit = G.fit_glm(d, ["x2", "x3"], label, family)
        xs = [F.lit(1.0), F.col("x2"), F.col("x3")]
        nu = sum((float(b) * x for b, x in zip(fit.coef, xs)), F.lit(0.0))
        mu = family.inv_link(nu)
        each = [(F.col(label) - mu) * family.d_inv_link(nu, mu) / family.variance(mu) * x for x in xs]
        sums = d.agg(*[F.sum(e) / F.sum(F.abs(e)) for e in each]).first()
        rows += [(family.name, n, float(v)) for n, v in zip(names, sums)]
    out = spark.createDataFrame(rows, "family string, name string, score double")
    return out.select("family", "name", r6("score"))


def _slack(d, label, names, coef, lam, alpha, mean):
    """How far each coefficient is from its optimality condition; the intercept is not penalised."""
    xs = [F.lit(1.0), *map(F.col, names)]
    nu = sum((float(b) * x for b, x in zip(coef, xs)), F.lit(0.0))
    slope = d.agg(*[F.avg((F.col(label) - mean(nu)) * x) for x in xs]).first()
    out = [abs(slope[0])]
    for g, b in zip(slope[1:], coef[1:]):
        out.append(abs(g - lam * (alpha * (1 if b > 0 else -1) + (1 - alpha) * b)) if b else max(0.0, abs(g) - lam * alpha))
    return out


LAMBDAS = (0.5, 0.1, 0.01, 0.001)
NAMES3 = ("intercept", "x1", "x2", "x3")


def _optimal(names):
    return " UNION ALL ".join(f"SELECT {lam}::DOUBLE AS lam, '{n}' AS name, 0.0::DOUBLE AS slack" for lam in LAMBDAS for n in names)


@query("L03_optimality", _optimal(NAMES3))
def l03o(spark, sf):
    """Three correlated predictors along a path: each coefficient meets its subgradient condition."""
    d = _prices(spark, sf).withColumn("x2", F.col("x2") + F.col("x1") / 50).withColumn("x3", F.col("x3") - F.col("x1") / 100)
    path = G.elastic_net_path(d, list(NAMES3[1:]), "y", list(LAMBDAS), 0.5)
    rows = [(lam, n, float(s)) for lam, b in zip(LAMBDAS, path) for n, s in zip(NAMES3, _slack(d, "y", NAMES3[1:], b, lam, 0.5, lambda v: v))]
    return spark.createDataFrame(rows, "lam double, name string, slack double").select("lam", "name", r6("slack"))


@query("L04_optimality", _optimal(("intercept", "x2", "x3", "y")))
def l04o(spark, sf):
    d, names = _prices(spark, sf), ("x2", "x3", "y")
    path = G.glm_net_path(d, list(names), "b", G.BERNOULLI, list(LAMBDAS), 0.5)
    logistic = G.BERNOULLI.inv_link
    rows = [(lam, n, float(s)) for lam, b in zip(LAMBDAS, path) for n, s in zip(("intercept", *names), _slack(d, "b", names, b, lam, 0.5, logistic))]
    return spark.createDataFrame(rows, "lam double, name string, slack double").select("lam", "name", r6("slack"))


@query("L03_elastic_net", f"""WITH d AS (SELECT l_extendedprice / 1000 AS y, l_quantity AS x FROM lineitem),
s AS (SELECT avg(x) AS mx, avg(y) AS my, var_pop(x) AS vx, covar_pop(x, y) AS cxy FROM d),
b AS (SELECT mx, my, sign(cxy) * greatest(abs(cxy) - 0.8 * 0.5, 0) / (vx + 0.8 * 0.5) AS b FROM s)
SELECT 'intercept' AS name, {R('my - b * mx')} AS estimate FROM b UNION ALL SELECT 'x1', {R('b')} FROM b""")
def l03(spark, sf):
    return coefficients(spark, G.elastic_net(_prices(spark, sf), ["x1"], "y", 0.8, 0.5), ["x1"]).select("name", r6("estimate"))


@query("L04_glm_net_path")
def l04(spark, sf):
    lambdas = [0.1, 0.01, 0.001]
    path = G.glm_net_path(_prices(spark, sf), ["x2", "x3", "y"], "b", G.BERNOULLI, lambdas, 0.5)
    rows = [(lam, n, float(v)) for lam, b in zip(lambdas, path) for n, v in zip(["intercept", "x2", "x3", "y"], b)]
    return spark.createDataFrame(rows, "lam double, name string, estimate double")


@query("L05_simulate")
def l05(spark, sf):
    d = _prices(spark, sf)
    fit = G.fit_glm(d, ["x2"], "x1", G.POISSON)
    return G.simulate(fit, d.select("x2"), 3, 42).groupBy("sim").agg(F.count("*").alias("n"), F.avg("y_sim").alias("mean"))


@query("L05_U11_bootstrap")
def l05b(spark, sf):
    fits = G.nonparametric_bootstrap(_prices(spark, sf), ["x1"], "y", G.GAUSSIAN, 3, 42)
    fits += G.parametric_bootstrap(fits[0], _prices(spark, sf), 2, 7)
    return spark.createDataFrame([(i, float(f.coef[0]), float(f.coef[1])) for i, f in enumerate(fits)], "replicate int, intercept double, x1 double")
