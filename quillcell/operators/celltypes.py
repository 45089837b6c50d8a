"""Cell-type annotation of clusters against marker gene sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillcell.functions.distributions import fisher_greater
from quillcell.matrix import Matrix
from quillcell.operators.aggregates import group_median
from quillcell.operators.multiplicity import benjamini_hochberg

# Species tags of the marker table and its filter level.
SPECIES_TAG = {"mouse": "Mm", "human": "Hs"}
MAX_UBIQUITOUSNESS = 0.05
UNKNOWN_ABOVE = 0.10
ENSEMBL_PATTERN = r"^ENS(MUS)?G[0-9]+$"
ENSEMBL_PATTERN_COMPAT = r"^ENS(G|MUS)[0-9]+$"


def select_markers(table: DataFrame, species: str) -> DataFrame:
    """``gene, cell_type`` rows of one species that are not expressed everywhere."""
    keep = F.col("species").contains(SPECIES_TAG[species]) & (F.col("ui") < MAX_UBIQUITOUSNESS)
    return table.filter(keep).select("gene", "cell_type")


def marker_weights(markers: DataFrame) -> DataFrame:
    """Genes listed for many cell types weigh less: ``1 + sqrt((max f - f) / (max f - min f))``."""
    freq = markers.groupBy("gene").agg(F.count("*").alias("freq"))
    ends = freq.agg(F.struct(F.min("freq").alias("lo"), F.max("freq").alias("hi"))).scalar()
    lo, hi = ends.getField("lo"), ends.getField("hi")
    share = (hi - F.col("freq")) / F.nullif((hi - lo).cast("double"), F.lit(0.0))
    return freq.select("gene", "freq", (1 + F.sqrt(F.coalesce(share, F.lit(0.0)))).alias("weight"))


def map_symbols(m: Matrix, symbol_map: DataFrame, compat: bool = False) -> Matrix:
    """Upper-case gene ids; bare Ensembl ids become symbols where the symbol is unique.

    Matrices that are not keyed by Ensembl ids keep their names. The compat pattern does
    not recognise mouse ids.
    """
    upper = m.keep(m.expr.withColumn("gene", F.upper("gene")))
    bare = F.col("gene").rlike(ENSEMBL_PATTERN_COMPAT if compat else ENSEMBL_PATTERN)
    if upper.expr.filter(bare).limit(1).count() == 0:
        return upper
    repeated = symbol_map.groupBy("symbol").count().filter("count > 1").select("symbol")
    unique = symbol_map.join(repeated, "symbol", "left_anti").select(F.upper("ensembl").alias("gene"), F.upper("symbol").alias("symbol"))
    return m.keep(upper.expr.join(unique, "gene").select(F.col("symbol").alias("gene"), "cell", "value"))


def standardized_medians(medians: DataFrame) -> DataFrame:
    """Medians with their z-score over all genes of the cluster and the cluster's gene counts."""
    per_cluster = medians.groupBy("cluster").agg(
        F.avg("median").alias("_mu"), F.stddev_pop("median").alias("_sd"),
        F.count_if(F.col("median") > 0).alias("n_exp"), F.count_if(F.col("median") == 0).alias("n_zero"),
    )
    z = (F.col("median") - F.col("_mu")) / F.nullif(F.col("_sd"), F.lit(0.0))
    return medians.join(per_cluster, "cluster").select(
        "gene", "cluster", "median", F.coalesce(z, F.lit(0.0)).alias("z"), "n_exp", "n_zero"
    )


def cell_type_scores(medians: DataFrame, markers: DataFrame) -> DataFrame:
    """Per cluster and cell type: activity score, the 2 x 2 counts and the expressed markers."""
    sets = markers.select("gene", "cell_type").distinct().join(marker_weights(markers), "gene")
    hit = F.col("median") > 0
    scored = standardized_medians(medians).join(sets, "gene").groupBy("cluster", "cell_type").agg(
        (F.sum(F.col("z") * F.col("weight")) / F.pow(F.count("*"), F.lit(0.3))).alias("activity"),
        F.count_if(hit).alias("in_exp"), F.count_if(F.col("median") == 0).alias("in_zero"),
        F.first("n_exp").alias("n_exp"), F.first("n_zero").alias("n_zero"),
        F.concat_ws(",", F.sort_array(F.collect_set(F.when(hit, F.col("gene"))))).alias("markers"),
    )
    return scored.select(
        "cluster", "cell_type", "activity", "in_exp", "in_zero",
        (F.col("n_exp") - F.col("in_exp")).alias("out_exp"), (F.col("n_zero") - F.col("in_zero")).alias("out_zero"),
        F.when(F.col("markers") == "", "NA").otherwise(F.col("markers")).alias("markers"),
    )


def annotate_clusters(m: Matrix, clusters: DataFrame, markers: DataFrame) -> DataFrame:
    """The full table: activity, one-sided Fisher p-value and its BH adjustment."""
    scores = cell_type_scores(group_median(m, clusters), markers)
    tested = scores.withColumn("p_val", fisher_greater(*[F.col(c).cast("double") for c in ("in_exp", "in_zero", "out_exp", "out_zero")]))
    return benjamini_hochberg(tested, "p_val", "padj").select("cluster", "cell_type", "activity", "p_val", "padj", "markers")


def best_cell_types(table: DataFrame, digits: int | None = None) -> DataFrame:
    """The most active cell type per cluster, 'Unknown' when it is not significant.

    With ``digits`` activities that agree to so many places count as ties, which go by name.
    """
    activity = F.col("activity") if digits is None else F.round("activity", digits)
    w = Window.partitionBy("cluster").orderBy(activity.desc(), F.asc("cell_type"))
    top = table.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")
    return top.withColumn("cell_type", F.when(F.col("padj") > UNKNOWN_ABOVE, "Unknown").otherwise(F.col("cell_type")))
