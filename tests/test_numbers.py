"""Distribution functions, corrections, quantiles and models against brute force."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillcell.functions import distributions as D
from quillcell.functions.exprs import half_even, smallest_overlap
from quillcell.operators import glm as G
from quillcell.operators.multiplicity import benjamini_hochberg, simes
from quillcell.operators.quantile import exact_quantile, ordered_bits
from quillcell.operators.qc import chi2_quantile
from quillcell.operators.ranking import count_above, dense_rank_desc, hash_index


def test_student_t_tail_with_known_values():
    # one degree of freedom is the Cauchy law, two have a closed form
    t = np.array([-3.0, -0.5, 0.0, 0.7, 12.0])
    assert np.allclose(D.student_t_sf_np(t, 1.0), 0.5 - np.arctan(t) / math.pi, rtol=1e-11)
    assert np.allclose(D.student_t_sf_np(t, 2.0), 0.5 - t / (2 * np.sqrt(2 + t * t)), rtol=1e-10)


def test_chi_square_tail_with_even_degrees():
    x = np.array([0.0, 0.3, 4.0, 40.0])
    assert np.allclose(D.gammainc_upper_np(1.0, x / 2), np.exp(-x / 2), rtol=1e-12)
    assert np.allclose(D.gammainc_upper_np(2.0, x / 2), np.exp(-x / 2) * (1 + x / 2), rtol=1e-12)
    assert chi2_quantile(0.5, 2) == pytest.approx(2 * math.log(2))


def test_normal_tail():
    assert D.normal_sf_np(np.array([0.0, 1.959963984540054]))[1] == pytest.approx(0.025)


@settings(max_examples=30, deadline=None)
@given(st.integers(0, 8), st.integers(0, 8), st.integers(0, 8), st.integers(0, 8))
def test_fisher_equals_enumeration(a, b, c, d):
    n, drawn, marked = a + b + c + d, a + b, a + c
    want = sum(
        math.comb(marked, k) * math.comb(n - marked, drawn - k) / math.comb(n, drawn)
        for k in range(a, min(drawn, marked) + 1) if 0 <= drawn - k <= n - marked
    )
    assert D.hypergeom_upper_np([a], [drawn], [marked], [n])[0] == pytest.approx(want, abs=1e-9)


def test_benjamini_hochberg_against_numpy(spark):
    rng = np.random.default_rng(1)
    p = np.concatenate([rng.random(300) ** 4, np.repeat(1.0, 200), np.repeat(0.5, 50), [0.0, 0.0]])
    order = np.argsort(p)[::-1]
    n = len(p)
    want = np.empty(n)
    want[order] = np.minimum(1, np.minimum.accumulate(n / np.arange(n, 0, -1) * p[order]))
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(p)] + [(n, None), (n + 1, float("nan"))], "i int, p double")
    got = {r["i"]: r["q"] for r in benjamini_hochberg(df, "p", "q").collect()}
    assert got[n] is None and got[n + 1] is None
    assert np.allclose([got[i] for i in range(n)], want, rtol=1e-12)


def test_simes_with_ties(spark):
    df = spark.createDataFrame([("a", 0.02), ("a", 0.02), ("a", 0.9), ("b", 1.0)], "g string, p double")
    got = {r["g"]: r["s"] for r in simes(df, ["g"], "p", "s").collect()}
    assert got["a"] == pytest.approx(3 * 0.02 / 1.5) and got["b"] == 1.0


@pytest.mark.parametrize("q", [0.0, 0.5, 0.8, 1.0])
def test_quantiles_by_bits(spark, q):
    rng = np.random.default_rng(3)
    groups = {
        "a": rng.lognormal(0, 3, 301), "b": np.r_[rng.normal(0, 1, 40), [0.25] * 30], "c": [7.0], "d": [1e300, -1e300, 5e-324, 0.0, -5e-324],
        "e": np.r_[rng.uniform(1, 1 + 1e-12, 200), 1e18], None: [3.0, 4.0, 8.0],
    }
    rows = [(g, float(v), 1 + i % 3) for g, vs in groups.items() for i, v in enumerate(vs)] + [("a", None, 1), ("a", 5.0, 0)]
    df = spark.createDataFrame(rows, "g string, v double, w int")
    got = {r["g"]: r["quantile"] for r in exact_quantile(df, "v", q, ["g"], "w").collect()}
    assert set(got) == set(groups)
    for g, vs in groups.items():
        want = np.quantile(np.repeat(np.asarray(vs, float), [1 + i % 3 for i in range(len(vs))]), q)
        assert got[g] == pytest.approx(want, rel=1e-12, abs=0), g
    everything = exact_quantile(df.filter("g = 'e'"), "v", q).first()[0]
    assert everything == pytest.approx(np.quantile(groups["e"], q), rel=1e-12)


def test_bits_order_as_doubles_do(spark):
    rng = np.random.default_rng(9)
    values = np.concatenate([rng.integers(-(2**63), 2**63 - 1, 3000).view(float), 2.0 ** np.arange(-1074, 1024), np.nextafter(2.0 ** np.arange(-1022, 1024), 0), [0.0, np.inf]])
    values = values[~np.isnan(values)]
    values = np.concatenate([values, -values])
    df = spark.createDataFrame([(float(v),) for v in values], "v double").select("v", ordered_bits(F.col("v")).alias("bits"))
    for r in df.collect():
        bits = int(np.float64(abs(r["v"])).view(np.int64))
        assert r["bits"] == (-bits if r["v"] < 0 else bits), r["v"]


def test_global_positions(spark):
    df = spark.range(1000).select(F.concat(F.lit("c"), "id").alias("k"), (F.col("id") % 13).alias("v"))
    index = [r["index"] for r in hash_index(df, "k").collect()]
    assert sorted(index) == list(range(1000))
    above = {r["v"]: r["above"] for r in count_above(df, "v").collect()}
    values = [i % 13 for i in range(1000)]
    assert all(above[v] == sum(x > v for x in values) for v in range(13))
    far = spark.createDataFrame([(v,) for v in [1e18, 1.0, 1.0, 1.0 + 2**-52, -3.0, 0.0]], "v double")
    assert {r["v"]: r["above"] for r in count_above(far, "v").collect()} == {1e18: 0, 1.0 + 2**-52: 1, 1.0: 2, 0.0: 4, -3.0: 5}
    ranks = {r["k"]: r["n"] for r in dense_rank_desc(df, "v", "k", "n").collect()}
    assert sorted(ranks.values()) == list(range(1000))
    assert max(ranks[f"c{i}"] for i in range(1000) if i % 13 == 12) < min(ranks[f"c{i}"] for i in range(1000) if i % 13 == 11)


def test_smallest_overlap_is_strict():
    assert smallest_overlap(10, 0.067) == 2
    assert smallest_overlap(10, 0.0) == 1
    assert smallest_overlap(10, 1.0) == 11
    assert [half_even(x) for x in (0.5, 1.5, 2.5, 2.4)] == [0, 2, 2, 2]


@pytest.fixture(scope="module")
def xy(spark):
    rng = np.random.default_rng(5)
    x1, x2 = rng.normal(size=400), rng.random(400)
    rows = [
        (float(a), float(b), float(1 + 2 * a - b + rng.normal()), float(rng.poisson(math.exp(0.3 + 0.4 * a))),
         float(rng.random() < 1 / (1 + math.exp(-(0.2 + a)))), float(rng.gamma(3, (2 + b) / 3)))
        for a, b in zip(x1, x2)
    ]
    return np.array(rows), spark.createDataFrame(rows, "x1 double, x2 double, y double, n double, b double, g double").cache()


def test_gaussian_glm_is_least_squares(xy):
    a, df = xy
    design = np.column_stack([np.ones(len(a)), a[:, 0], a[:, 1]])
    fit = G.fit_glm(df, ["x1", "x2"], "y")
    want, rss = np.linalg.lstsq(design, a[:, 2], rcond=None)[:2]
    assert np.allclose(fit.coef, want)
    assert fit.dispersion == pytest.approx(rss[0] / (len(a) - 3))
    assert np.allclose(fit.standard_errors, np.sqrt(np.diag(np.linalg.inv(design.T @ design)) * fit.dispersion))


@pytest.mark.parametrize("family,label,power", [(G.POISSON, 3, 0), (G.BERNOULLI, 4, 0), (G.GAMMA, 5, 1), (G.GAMMA_IDENTITY, 5, 2), (G.GAMMA_MIXED_LINK, 5, 1)])
def test_score_equations_vanish(xy, family, label, power):
    a, df = xy
    fit = G.fit_glm(df, ["x2"], df.columns[label], family)
    assert fit.converged
    x = np.column_stack([np.ones(len(a)), a[:, 1]])
    nu = x @ fit.coef
    mu = {"bernoulli": 1 / (1 + np.exp(-nu)), "gamma_identity": nu, "gamma_mixed_link": nu}.get(family.name, np.exp(nu))
    assert np.allclose(x.T @ ((a[:, label] - mu) / mu**power) / len(a), 0, atol=1e-4)


def test_ridge_shrinks_slopes_only(xy):
    a, df = xy
    fit = G.fit_glm(df, ["x1", "x2"], "y", alpha=50.0)
    design = np.column_stack([np.ones(len(a)), a[:, 0], a[:, 1]])
    assert np.allclose(fit.coef, np.linalg.solve(design.T @ design + np.diag([0, 50, 50]), design.T @ a[:, 2]), rtol=1e-6)
    with pytest.raises(G.GlmInputError):
        fit.p_values


def test_elastic_net_optimality(xy):
    a, df = xy
    lam, alpha = 0.3, 0.4
    b = G.elastic_net(df, ["x1", "x2"], "y", lam, alpha)
    x, y = a[:, :2], a[:, 2]
    r = y - b[0] - x @ b[1:]
    assert r.mean() == pytest.approx(0, abs=1e-8)
    for j in range(2):
        grad = -(x[:, j] * r).mean() + lam * (1 - alpha) * b[j + 1]
        if b[j + 1] == 0:
            assert abs(grad) <= lam * alpha + 1e-8
        else:
            assert grad + lam * alpha * np.sign(b[j + 1]) == pytest.approx(0, abs=1e-7)


def test_glm_net_with_tiny_penalty_is_the_glm(xy):
    _, df = xy
    path = G.glm_net_path(df, ["x1"], "b", G.BERNOULLI, [1.0, 1e-9], 0.5)
    assert np.allclose(path[1], G.fit_glm(df, ["x1"], "b", G.BERNOULLI).coef, atol=1e-4)
    assert abs(path[0][1]) < abs(path[1][1])


def test_bootstrap_centres_on_the_fit(xy):
    _, df = xy
    fit = G.fit_glm(df, ["x1"], "n", G.POISSON)
    boot = G.nonparametric_bootstrap(df, ["x1"], "n", G.POISSON, 4, 1) + G.parametric_bootstrap(fit, df, 3, 9)
    assert np.allclose(np.mean([b.coef for b in boot], axis=0), fit.coef, atol=0.25)

