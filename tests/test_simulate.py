"""Responses drawn from a fitted model."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillcell.operators import glm as G


def fitted(family, deviance):
    return G.GlmFit(family, ["x"], np.array([1.0, 0.5]), deviance, 1002.0, np.eye(2))


def drawn(spark, family, deviance=500.0):
    rows = spark.range(0, 40_000, 1, 4).select((F.col("id") % 4).cast("double").alias("x"))
    return G.simulate(fitted(family, deviance), rows, 2, 11)


@pytest.mark.parametrize("family, spread", [(G.POISSON, lambda mu: mu), (G.GAMMA, lambda mu: mu * mu / 0.5)])
def test_draws_have_mean_and_variance_of_the_model(spark, family, spread):
    got = drawn(spark, family).groupBy("x").agg(F.count("*").alias("n"), F.avg("y_sim").alias("mean"), F.var_samp("y_sim").alias("var")).collect()
    assert len(got) == 4
    for r in got:
        mu = float(np.exp(1 + 0.5 * r["x"]))
        assert r["n"] == 20_000
        assert r["mean"] == pytest.approx(mu, rel=0.06)
        assert r["var"] == pytest.approx(spread(mu), rel=0.12)


def test_draws_are_repeated_and_differ_between_rows(spark):
    first = drawn(spark, G.GAMMA).agg(F.sum("y_sim"), F.countDistinct("y_sim")).first()
    again = drawn(spark, G.GAMMA).agg(F.sum("y_sim"), F.countDistinct("y_sim")).first()
    assert first[0] == pytest.approx(again[0], rel=1e-12) and first[1] == again[1] > 79_000


def test_generators_are_made_by_batch(spark, monkeypatch):
    made = []
    real = np.random.default_rng
    monkeypatch.setattr(np.random, "default_rng", lambda s: made.append(s) or real(s))
    import pandas as pd

    captured = {}
    monkeypatch.setattr(F, "pandas_udf", lambda kind: lambda f: captured.setdefault("f", f) and (lambda *a: F.lit(0.0)))
    G._draw(fitted(G.POISSON, 500.0), F.lit(1.0), 3)
    out = captured["f"](pd.Series([2.0] * 1000), pd.Series(np.linspace(0.1, 0.9, 1000)))
    assert len(out) == 1000 and out.nunique() > 3 and len(made) == 1
    assert captured["f"](pd.Series([], dtype=float), pd.Series([], dtype=float)).empty
