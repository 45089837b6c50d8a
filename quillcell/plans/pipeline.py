"""The full analysis: matrix file to clusters, markers, cell types and plot tables."""

from __future__ import annotations

import hashlib
import logging
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillcell.matrix import Matrix
from quillcell.operators import aggregates, celltypes, contrasts, doublets, filters, hvg, linalg, plotdata, qc, reads, snn
from quillcell.operators.communities import communities
from quillcell.operators.filters import MatrixError
from quillcell.operators.knn import neighbour_table
from quillcell.operators.layout import tsne, umap
from quillcell.operators.normalize import normalize
from quillcell.params import PipelineParams
from quillcell.plans.stages import StageStore, exists, input_mark, read_text, write_text
from quillcell.sources import archives, matrices, sinks, tables

log = logging.getLogger("quillcell")

# Options that decide each stage; later stages add theirs to those of the earlier ones.
_LOAD = ("filename", "dataformat", "delimiter", "header", "on_duplicate", "remove_mito", "exclude_gene", "min_genes")
_NORM = (*_LOAD, "minreads", "minexpgenes", "qc_auto", "mrnafull", "seed", "exon_lengths", "gene_gtf", "min_cells")
_HVG = (*_NORM, "hvg", "hvg_n")
_PCA = (*_HVG, "pca", "pca_n")
_EMBED = (*_PCA, "embedding", "perplexity", "embedding_iterations")
_CLUSTER = (*_PCA, "nn_k", "prune_snn", "leiden_partition", "leiden_res", "custom_clustering")
_TARGET = (*_CLUSTER, "ignore_small_clusters")
_TESTS = (*_TARGET, "de_direction")
_TYPES = (*_TARGET, "species", "markers", "symbol_map")


@dataclass
class Loaded:
    counts: Matrix
    spikes: Matrix
    norm: Matrix
    norm_spikes: Matrix
    quality: DataFrame


def find_variable_genes(method: str, n: int, norm: Matrix, raw: Matrix | None = None, spikes: Matrix | None = None) -> DataFrame:
    """Dispatch over the six methods; the count-based one takes the raw matrix."""
    if method == "seurat":
        return hvg.seurat(norm, n)
    if method == "Brennecke2013":
        return hvg.brennecke(norm, n, spikes if spikes is not None and not spikes.expr.isEmpty() else None)
    if method == "scran":
        if spikes is None:
            raise MatrixError("this method needs spike-in genes")
        return hvg.scran(norm, spikes, n)
    if method == "Chen2016":
        return hvg.chen(norm, n)
    if method == "M3Drop_smartseq2":
        return hvg.m3drop(norm, n)
    if method == "M3Drop_UMI":
        return hvg.m3drop_umi(raw if raw is not None else norm, n)
    raise ValueError(f"unknown method {method}")


class Pipeline:
    def __init__(self, spark: SparkSession, params: PipelineParams):
        self.spark, self.p = spark, params
        self.out = params.output.rstrip("/")
        side = ("filename", "annotations", "custom_clustering", "add_celltypes", "markers", "symbol_map", "exon_lengths", "gene_gtf")
        marks = "|".join(input_mark(getattr(params, name, None)) for name in side)
        self.store = StageStore(spark, self.out, hashlib.sha256(marks.encode()).hexdigest()[:8])

    # ---- input -----------------------------------------------------------

    def check_settings(self) -> None:
        """Refuse to resume another input's output folder, then record the options."""
        path = sinks.target(self.out, "settings")
        name = self.p.filename.rsplit("/", 1)[-1]
        if exists(path):
            old = dict(line.split("\t", 1) for line in read_text(path).splitlines() if "\t" in line)
            if old.get("filename", "").rsplit("/", 1)[-1] not in ("", name):
                raise MatrixError(f"{self.out} holds results of another input")
        write_text(path, "".join(f"{k}\t{v}\n" for k, v in asdict(self.p).items()))

    def read(self) -> Matrix:
        kind, path = archives.unpack(self.spark, self.p.filename)
        if kind == "tar":
            return matrices.read_matrix_market(self.spark, path)
        return matrices.read_delimited(self.spark, path, self.p.delimiter, self.p.header, self.p.min_genes, self.p.on_duplicate)

    def load(self) -> Loaded:
        p = self.p
        key = p.digest(*_LOAD)

        def clean() -> DataFrame:
            m = self.read()
            filters.validate_counts(m, p.dataformat)
            m = filters.remove_empty(m)
            if p.remove_mito:
                m = filters.remove_mito(m)
            return filters.exclude_genes(m, p.exclude_gene).expr

        everything = Matrix(self.store.get("counts", key, clean))
        data, spikes = filters.split_spikes(everything)
        rrna = reads.rrna_genes(self.spark.read.text(p.gene_gtf)) if p.gene_gtf else None
        norm_key = p.digest(*_NORM)
        quality = self.store.get("quality", norm_key, lambda: qc.low_quality_cells(data, spikes, rrna, p.seed))
        kept = filters.min_reads(data, p.minreads) if p.dataformat == "raw" else data
        filters.check_minimum(kept.cells, p.min_cells, "cells")
        kept = filters.min_expressed(kept, p.minexpgenes)
        if p.qc_auto:
            bad = quality.filter("low_quality")
            kept, spikes = filters.drop_cells(kept, bad), filters.drop_cells(spikes, bad)
        lengths = tables.exon_lengths(self.spark, p.exon_lengths) if p.mrnafull and p.exon_lengths else None
        if p.mrnafull and lengths is None:
            raise MatrixError("full-length normalisation needs exon lengths")
        norm = self.store.get("norm", norm_key, lambda: normalize(kept, p.dataformat, lengths).expr)
        norm_spikes = self.store.get("norm_spikes", norm_key, lambda: normalize(spikes, p.dataformat).expr)
        sinks.write_csv(quality.select("cell", "md"), sinks.target(self.out, "qc"))
        return Loaded(kept, spikes, Matrix(norm), Matrix(norm_spikes), quality)

    # ---- cells -----------------------------------------------------------

    def variable_genes(self, d: Loaded) -> DataFrame:
        p = self.p
        top = self.store.get("hvg", p.digest(*_HVG), lambda: find_variable_genes(p.hvg, p.hvg_n, d.norm, d.counts, d.norm_spikes))
        listed = top.select("rank", "gene")
        columns = ["gene"]
        if p.annotations:
            listed = listed.join(tables.annotations(self.spark, p.annotations), "gene")
            columns.append("desc")
        sinks.write_single(listed.orderBy("rank").select(*columns), sinks.target(self.out, "hvg"))
        return top

    def components(self, d: Loaded, genes: DataFrame) -> DataFrame:
        p = self.p
        fit = linalg.truncated_svd if p.pca == "irlb" else linalg.centred_pca
        scores = self.store.get("pca", p.digest(*_PCA), lambda: fit(d.norm, genes, p.pca_n)[1])
        width = len(scores.first()["features"])
        sinks.write_csv(sinks.spread_array(scores, "cell", "features", width), sinks.target(self.out, "pca"))
        return scores

    def embedding(self, scores: DataFrame) -> DataFrame:
        p = self.p

        def build() -> DataFrame:
            if p.embedding == "tSNE":
                return tsne(scores, p.perplexity, p.embedding_iterations, p.seed)
            return umap(scores, 15, p.embedding_iterations, p.seed)

        points = self.store.get("embedding", p.digest(*_EMBED), build)
        sinks.write_csv(points, sinks.target(self.out, "embedding", f"{p.embedding}.csv"))
        return points

    def clusters(self, d: Loaded, scores: DataFrame) -> DataFrame:
        p = self.p
        if p.custom_clustering:
            return tables.match_clustering(d.norm.cells, tables.clustering(self.spark, p.custom_clustering))

        def graph() -> DataFrame:
            return snn.snn_graph(neighbour_table(scores, p.nn_k, p.seed), p.nn_k, p.prune_snn)

        edges = self.store.get("snn", p.digest(*_CLUSTER), graph)
        null = "er" if p.leiden_partition == "RBERVertexPartition" else "configuration"
        found = self.store.get(
            "clusters", p.digest(*_CLUSTER),
            lambda: communities(scores.select(F.col("cell").alias("node")), edges, p.leiden_res, null),
        )
        found = found.withColumn("cluster", F.col("cluster").cast("string"))
        sinks.write_csv(edges.select("src", "dst"), sinks.target(self.out, "snn"))
        sinks.write_csv(found, sinks.target(self.out, "clusters"))
        return found

    # ---- clusters --------------------------------------------------------

    def tests(self, d: Loaded, targets: DataFrame) -> tuple[DataFrame, DataFrame]:
        p = self.p
        result = self.store.get(
            "t_tests", p.digest(*_TESTS),
            lambda: contrasts.pairwise_t_tests(filters.keep_cells(d.norm, targets), targets, p.de_direction),
        )
        found = contrasts.combine_tests(result)
        long = result.drop("cluster", "other")
        if p.annotations:
            long = tables.annotate(long, tables.annotations(self.spark, p.annotations))
        sinks.write_csv(sinks.rename(long, sinks.LONG_NAMES), sinks.target(self.out, "t_tests_long"), "\t", True)
        sinks.write_lines(sinks.wide_lines(result, "comparison", "p_val", ","), sinks.target(self.out, "t_tests"))
        ordered = found.orderBy("cluster", "pvalue_simes", "gene")
        sinks.write_csv(sinks.rename(ordered, sinks.SIMES_NAMES), sinks.target(self.out, "markers"), "\t", True)
        return result, found

    def expression_tables(self, d: Loaded, targets: DataFrame) -> DataFrame:
        restricted = filters.keep_cells(d.norm, targets)
        medians = self.store.get("medians", self.p.digest(*_TARGET), lambda: aggregates.group_median(restricted, targets))
        means = aggregates.group_moments(restricted, targets).select("gene", "cluster", "mean")
        for df, value, name in ((medians, "median", "median"), (means, "mean", "mean")):
            extra = None
            if self.p.annotations:
                df = tables.annotate(df, tables.annotations(self.spark, self.p.annotations))
                extra = [c for c in df.columns if c not in ("gene", "cluster", value)]
            sinks.write_lines(sinks.wide_lines(df, "cluster", value, "\t", extra), sinks.target(self.out, name))
        return medians

    def cell_types(self, d: Loaded, targets: DataFrame) -> tuple[DataFrame, DataFrame] | None:
        p = self.p
        if p.species == "other" or not p.markers:
            log.info("no species or marker table: cell types are skipped")
            return None
        named = filters.keep_cells(d.norm, targets)
        if p.symbol_map:
            named = celltypes.map_symbols(named, tables.symbols(self.spark, p.symbol_map))
        sets = celltypes.select_markers(tables.markers(self.spark, p.markers), p.species)
        full = self.store.get("cell_types", p.digest(*_TYPES), lambda: celltypes.annotate_clusters(named, targets, sets))
        best = celltypes.best_cell_types(full)
        order = ["cluster", F.desc("activity")]
        columns = ["cluster", "activity", "cell_type", "p_val", "markers", "padj"]
        for df, name in ((full, "cell_types"), (best, "cell_types_best")):
            shown = sinks.rename(df.orderBy(*order).select(*columns), sinks.CELL_TYPE_NAMES)
            sinks.write_csv(shown, sinks.target(self.out, name), "\t", True)
        return full, best

    def plot_tables(self, d: Loaded, points: DataFrame, targets: DataFrame, types) -> dict[str, DataFrame]:
        p = self.p
        out = {
            "reads": plotdata.read_count_bars(d.counts, p.minreads),
            "expressed": plotdata.expressed_gene_bars(d.counts),
            "violin": plotdata.genes_per_cluster(d.norm, targets),
            "violin_top": plotdata.top_gene_values(d.norm, targets, p.violin_top),
        }
        none = targets.select("cluster", F.lit(None).cast("string").alias("cell_type"), F.lit(None).cast("double").alias("padj")).limit(0)
        best = types[1] if types else none
        out["scatter"] = plotdata.cluster_scatter(points, targets, best)
        if p.highlight_specific_cells:
            wanted = [c.strip() for c in p.highlight_specific_cells.split(",")]
            out["highlight"] = filters.highlight(points, points.filter(F.col("cell").isin(wanted)))
        for gene in filter(None, (p.overlay_genes or "").split(",")):
            out[f"overlay_{gene.strip()}"] = plotdata.gene_overlay(d.norm, points, gene.strip(), p.species != "other")
        if types and p.markers:
            sets = tables.markers(self.spark, p.markers).select("gene", "cell_type")
            out["heatmap"] = plotdata.marker_heatmap(d.norm, targets, types[1], sets, p.add_celltypes)
        return out

    def doublet_scores(self, d: Loaded) -> DataFrame:
        """``cell, status, score`` against doublets simulated from the raw counts."""
        p = self.p

        def build() -> DataFrame:
            if p.doublets == "scrublet":
                return doublets.scrublet(d.counts, p.hvg_n, seed=p.seed).select("cell", "status", "score")
            found = doublets.doublet_finder(d.counts, hvg.seurat(d.norm, p.hvg_n), seed=p.seed)
            return found.select("cell", F.lit("obs").alias("status"), "score")

        scores = self.store.get("doublets", p.digest(*_HVG, "doublets", "seed"), build)
        sinks.write_csv(scores, sinks.target(self.out, "doublets"), "\t", True)
        return scores

    def run(self) -> dict[str, DataFrame]:
        self.check_settings()
        d = self.load()
        genes = self.variable_genes(d)
        scores = self.components(d, genes)
        points = self.embedding(scores)
        assigned = self.clusters(d, scores)
        targets = filters.in_target_clusters(assigned, self.p.ignore_small_clusters).select("cell", "cluster")
        if filters.cluster_sizes(targets).limit(2).count() < 2:
            raise MatrixError("fewer than two clusters are large enough for contrasts")
        tests, found = self.tests(d, targets)
        self.expression_tables(d, targets)
        types = self.cell_types(d, targets)
        results = {"hvg": genes, "pca": scores, "embedding": points, "clusters": assigned, "t_tests": tests, "markers": found}
        if self.p.doublets != "none":
            results["doublets"] = self.doublet_scores(d)
        if types:
            results["cell_types"], results["cell_types_best"] = types
        for name, df in self.plot_tables(d, points, targets, types).items():
            df.write.mode("overwrite").parquet(f"{self.out}/plots/{name}")
        return results
