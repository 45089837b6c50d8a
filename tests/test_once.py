"""Costly steps are taken once: parsed lines, tails of mirrored contrasts, log-gammas of repeated values."""

import math

import numpy as np
from pyspark.sql import functions as F

from quillcell.functions import distributions as D
from quillcell.operators import contrasts, reads


def test_lines_are_parsed_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    rows = [("g1", 1, 5, "b"), ("g1", 4, 9, "a"), ("g1", 4, 6, "a"), ("g1", 20, 30, None), ("g2", 7, 8, "c")]
    exons = spark.createDataFrame(rows, "gene string, start long, stop long, transcript_type string").select(
        "gene", F.lit("chr1").alias("chrom"), "start", "stop", F.lit("+").alias("strand"), "transcript_type")
    merged = reads.metagenes(exons.mapInArrow(count, exons.schema))
    got = {(r["gene"], r["start"], r["stop"], r["types"]) for r in merged.collect()}
    assert got == {("g1", 1, 9, "a,b"), ("g1", 20, 30, "a,b"), ("g2", 7, 8, "c")}
    assert seen.value == len(rows)


def test_log_gamma_is_taken_once_for_a_value(monkeypatch):
    calls = []
    inner = math.lgamma
    monkeypatch.setattr(D.math, "lgamma", lambda x: calls.append(x) or inner(x))
    got = D._lgamma(np.full((3, 50), 7.5))
    assert got.shape == (3, 50) and (got == inner(7.5)).all() and len(calls) == 1


def test_mirrored_contrasts_have_the_p_values_of_both_directions(spark):
    rows = [("g", "a", "b", 2.5), ("g", "a", "c", -0.5), ("g", "b", "c", 0.0), ("h", "a", "b", None)]
    stats = spark.createDataFrame(rows, "gene string, cluster string, other string, t_stat double").selectExpr(
        "concat(cluster, '_vs_', other) AS comparison", "cluster", "other", "gene", "7 AS df", "t_stat", "1D AS logFC", "3D AS mean_A", "2D AS mean_B")
    both = contrasts._both_orders(stats.withColumn("_q", D.student_t_sf(F.abs("t_stat"), F.col("df").cast("double"))))
    for direction, wanted in (("up", lambda t: t), ("down", lambda t: -t)):
        got = both.withColumn("p", contrasts._p_value(F.col("t_stat"), F.col("_q"), direction)).collect()
        assert len(got) == 8
        for r in got:
            assert r["comparison"] == f"{r['cluster']}_vs_{r['other']}" and r["mean_A"] - r["mean_B"] == r["logFC"]
            if r["gene"] == "h":
                assert r["p"] is None
            else:
                assert r["p"] == float(D.student_t_sf_np(wanted(r["t_stat"]), 7.0)) and math.copysign(1, r["t_stat"]) == (1 if r["t_stat"] >= 0 else -1)
