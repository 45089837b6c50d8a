"""Writers of the result tables.

Results that a person reads (marker lists, cluster tables) are written as one file when
they are bounded; tables that grow with cells or genes x comparisons stay partitioned.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Names of the result tables below the output folder.
OUTPUTS = {
    "settings": "settings.txt",
    "qc": "csvs/Mahalanobis.csv",
    "hvg": "csvs/highly_variable_genes.tsv",
    "pca": "csvs/pca.csv",
    "embedding": "csvs/embeddings_",
    "snn": "csvs/snn_graph.csv",
    "clusters": "csvs/clusters_leiden.csv",
    "t_tests": "csvs/all_t_tests.csv",
    "t_tests_long": "csvs/all_t_tests_long.tsv",
    "markers": "csvs/discovered_markers.tsv",
    "median": "csvs/median_exp.tsv",
    "mean": "csvs/mean_exp.tsv",
    "cell_types": "csvs/CTA_RANK_F/cell_type_pred_full_table.txt",
    "cell_types_best": "csvs/CTA_RANK_F/cell_type_pred_best.txt",
    "doublets": "score.txt",
}
LONG_NAMES = {"comparison": "comparison_A_vs_B", "mean_A": "mean.A", "mean_B": "mean.B", "desc": "annotation"}
SIMES_NAMES = {"pvalue_simes": "pvalue.Simes"}
CELL_TYPE_NAMES = {
    "activity": "activity score", "cell_type": "cell type", "p_val": "p-value", "padj": "adjusted p-value BH",
}


def target(out: str, name: str, suffix: str = "") -> str:
    return os.path.join(out, OUTPUTS[name] + suffix)


def rename(df: DataFrame, names: dict[str, str]) -> DataFrame:
    return df.withColumnsRenamed({k: v for k, v in names.items() if k in df.columns})


def write_csv(df: DataFrame, path: str, sep: str = ",", header: bool = False) -> None:
    df.write.mode("overwrite").csv(path, sep=sep, header=header)


def wide_lines(df: DataFrame, column: str, value: str, sep: str, first: list[str] | None = None) -> DataFrame:
    """One packed line per gene with a field per distinct ``column``, and the header before them.

    There is no pivot, so any number of clusters or comparisons fits; a line has as many
    fields as the table has columns. ``first`` are further columns of the gene, put after it.
    """
    lead = ["gene", *(first or [])]
    labels = df.select(F.col(column).cast("string").alias("c")).distinct().agg(F.array_sort(F.collect_set("c")).alias("labels"))
    index = labels.select(F.posexplode("labels").alias("at", "c"), F.size("labels").alias("width"))
    placed = df.join(index, F.col(column).cast("string") == F.col("c"))
    entry = F.struct((F.col("at") + 1).alias("at"), F.coalesce(F.col(value).cast("string"), F.lit("")).alias("v"))
    packed = placed.groupBy(*lead, "width").agg(F.array_sort(F.collect_set(entry)).alias("e"))
    # a field is preceded by as many separators as columns lie between it and the one before
    gap = lambda i: F.col("e")[i]["at"] - F.when(i > 0, F.col("e")[i - 1]["at"]).otherwise(0)
    fields = F.transform(F.sequence(F.lit(0), F.size("e") - 1), lambda i: F.concat(F.repeat(F.lit(sep), gap(i)), F.col("e")[i]["v"]))
    rest = F.repeat(F.lit(sep), F.col("width") - F.element_at("e", -1)["at"])
    names = F.concat_ws(sep, *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in lead))
    line = F.concat("names", F.array_join(fields, ""), rest)
    body = packed.select(F.lit(1).alias("o"), F.col("gene").alias("g"), names.alias("names"), "width", "e")
    head = labels.select(F.lit(0).alias("o"), F.lit("").alias("g"), F.concat_ws(sep, *map(F.lit, lead), "labels").alias("names"))
    # genes are sorted with their entries; a line, which is as wide as the table, is only made on its way out
    ordered = head.unionByName(body, allowMissingColumns=True).orderBy("o", "g")
    return ordered.select(F.when(F.col("o") == 0, F.col("names")).otherwise(line).alias("value"))


def write_lines(df: DataFrame, path: str) -> None:
    """Lines in their order; the header is the first line of the first file."""
    df.write.mode("overwrite").text(path)


def write_single(df: DataFrame, path: str, sep: str = "\t", header: bool = False) -> None:
    """One file; for tables bounded by a parameter (variable genes, clusters x cell types)."""
    df.coalesce(1).write.mode("overwrite").csv(path, sep=sep, header=header)


def spread_array(df: DataFrame, key: str, array: str, size: int, prefix: str = "pc_") -> DataFrame:
    """An array column as ``size`` numbered columns."""
    return df.select(key, *[F.col(array)[i].alias(f"{prefix}{i + 1}") for i in range(size)])


def dense_lines(expr: DataFrame, cells: list[str]) -> DataFrame:
    """The dense text of a matrix with a bounded list of cells: one tab-separated line per gene."""
    wide = expr.groupBy("gene").pivot("cell", cells).agg(F.sum("value"))
    fields = [F.coalesce(F.col(f"`{c}`"), F.lit(0.0)).cast("string") for c in cells]
    return wide.select(F.concat_ws("\t", "gene", *fields).alias("value"))

