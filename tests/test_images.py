"""The check of components looks at their own genes alone."""

from pyspark.sql import functions as F

from quillcell.matrix import Matrix
from quillcell.plans.queries_stats import _images


def test_only_chosen_genes_meet_the_scores(spark):
    entries = [("a", "x", 2.0), ("a", "y", 3.0), ("b", "y", 5.0)] + [(f"other{i}", "x", 1.0) for i in range(50)]
    m = Matrix(spark.createDataFrame(entries, "gene string, cell string, value double"))
    scores = spark.createDataFrame([("x", [1.0, 10.0]), ("y", [2.0, 20.0])], "cell string, features array<double>")
    genes = spark.createDataFrame([("a",), ("b",), ("unseen",)], "gene string")
    got = {(r["gene"], r["pc"]): r["raw"] for r in _images(m, genes, scores).collect()}
    assert got == {("a", 1): 8.0, ("a", 2): 80.0, ("b", 1): 10.0, ("b", 2): 100.0}
    assert _images(m, genes, scores).filter(F.col("gene").startswith("other")).isEmpty()
