"""The matrix of words and documents."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from quillcell.matrix import Matrix
from quillcell.operators.plotdata import expressed_gene_bars
from quillcell.plans import adapters as ad

TEXTS = [(1, "a b\tA\n\nc"), (1, "a c"), (2, "b  b b"), (3, None), (4, " ")]


@pytest.fixture()
def folder(spark, tmp_path):
    spark.createDataFrame(TEXTS, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def test_words_are_counted_in_all_rows_of_a_document(spark, folder):
    got = {(r["gene"], r["cell"]): r["value"] for r in ad.token_counts(spark, folder).expr.collect()}
    assert got == {("a", "1"): 3.0, ("b", "1"): 1.0, ("c", "1"): 2.0, ("b", "2"): 3.0}


def test_texts_are_sent_and_not_their_words(spark, folder):
    m = ad.token_counts(spark, folder)
    totals = m.expr.groupBy("cell").agg(F.sum("value").alias("reads"))
    plan = totals._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert plan.index("Generate explode") < plan.index("Exchange hashpartitioning")


def test_bars_read_their_matrix_once(spark):
    entries = spark.createDataFrame([("a", "x", 1.0), ("b", "x", 1.0), ("a", "y", 1.0)], "gene string, cell string, value double")
    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def value(v):
        seen.add(1)
        return v

    m = Matrix(entries.withColumn("value", value.asNondeterministic()("value")))
    bars = {r["cell"]: (r["genes"], r["position"]) for r in expressed_gene_bars(m).select("cell", "genes", "position").collect()}
    assert bars == {"x": (2, 1), "y": (1, 2)}
    assert seen.value == 3
