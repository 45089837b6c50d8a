"""Variable genes, quality control, contrasts and cell types against numpy on small matrices."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillcell.functions.distributions import normal_sf_np
from quillcell.matrix import Matrix
from quillcell.operators import celltypes, contrasts, filters, hvg, qc
from quillcell.operators.aggregates import group_median, group_moments
from quillcell.operators.normalize import log_normalize


def to_matrix(spark, x):
    rows = [(f"g{i:03d}", f"c{j:03d}", float(x[i, j])) for i, j in zip(*np.nonzero(x))]
    return Matrix(spark.createDataFrame(rows, "gene string, cell string, value double").repartition(4).cache())


@pytest.fixture(scope="module")
def counts():
    rng = np.random.default_rng(11)
    level = rng.gamma(1.0, 3.0, 120)[:, None] * rng.gamma(5.0, 0.2, 60)[None, :]
    x = rng.poisson(level).astype(float)
    x[:6, :20] += rng.poisson(25, (6, 20))
    x[10] = 0
    x[:, 0] += 1
    return x


@pytest.fixture(scope="module")
def raw(spark, counts):
    return to_matrix(spark, counts)


@pytest.fixture(scope="module")
def norm(raw):
    return log_normalize(raw)


def dense_norm(x):
    return np.log2(x / x.sum(0) * 1e4 + 1)


def test_zero_rows_are_part_of_every_mean(norm, counts):
    got = {r["gene"]: (r["mean"], r["var"]) for r in hvg.gene_moments(norm).collect()}
    d = dense_norm(counts)
    for i in range(len(d)):
        assert got[f"g{i:03d}"] == pytest.approx((d[i].mean(), d[i].var(ddof=1)))


def test_depth_adjusted_dropout_against_loops(raw, counts):
    tj, ti, n = counts.sum(1), counts.sum(0), counts.shape[1]
    total = ti.sum()
    var = np.array([np.var(counts[i] - tj[i] * ti / total) for i in range(len(counts))])
    size = tj**2 * ((ti**2).sum() / total**2) / ((n - 1) * var - tj)
    size = np.where(size < 0, 10 * size.max(), size)
    size = np.maximum(size, 1e-10)
    use = size < size.max()
    slope, intercept = np.polyfit(np.log(tj[use] / n), np.log(size[use]), 1)
    fitted = np.exp(intercept + slope * np.log(tj / n))
    p = (1 + tj[:, None] * ti[None, :] / total / fitted[:, None]) ** (-fitted[:, None])
    expected = np.maximum(p.mean(1), 1 / n)
    observed = (counts == 0).mean(1)
    z = (observed - expected) / np.sqrt((p * (1 - p)).sum(1) / n**2 + observed * (1 - observed) / n)
    got = {r["gene"]: r for r in hvg.m3drop_umi(raw, 1000).collect()}
    assert got
    for gene, r in got.items():
        assert r["z"] == pytest.approx(z[int(gene[1:])], rel=1e-6)
        assert r["p_val"] == pytest.approx(normal_sf_np(z[int(gene[1:])]).item(), rel=1e-6)


def test_michaelis_menten_constant_and_scores(norm, counts):
    lin = 2 ** dense_norm(counts) - 1
    p, s, n = (lin == 0).mean(1), lin.mean(1), lin.shape[1]
    k = hvg.michaelis_constant(hvg.dropout_moments(norm))
    loss = lambda v: ((p - 1 + s / (v + s)) ** 2).sum()
    assert loss(k) <= min(loss(k * (1 + e)) for e in (-1e-3, 1e-3, -0.3, 0.3, 3.0))
    got = hvg.m3drop(norm, 1000).collect()
    p_adj = np.where(p == 0, p[p > 0].min() / 2, p)
    kg = p_adj * s / (1 - p_adj)
    assert all(r["k_gene"] == pytest.approx(kg[int(r["gene"][1:])]) for r in got)


def test_distance_to_curve_against_grid_search(norm):
    points = hvg.mean_cv_points(norm)
    slope, intercept = points.agg(F.regr_slope("ly", "lx"), F.regr_intercept("ly", "lx")).first()
    got = hvg.curve_distance(points, slope, intercept).toPandas()
    grid = np.arange(got.lx.min(), got.lx.max(), 0.001)
    fit = slope * grid + intercept
    for r in got.itertuples():
        near = (grid >= r.lx - 0.2) & (grid < r.lx + 0.2)
        d = np.sqrt((grid[near] - r.lx) ** 2 + (fit[near] - r.ly) ** 2)
        assert abs(r.dist) == pytest.approx(d.min(), abs=1e-9)
        assert (r.dist > 0) == (fit[near][d.argmin()] < r.ly)


def test_density_mode(spark):
    rng = np.random.default_rng(4)
    v = np.concatenate([rng.normal(2.0, 0.5, 4000), rng.normal(6, 1, 1000)])
    df = spark.createDataFrame([(float(x),) for x in v], "d double")
    assert hvg.kde_mode(df, "d") == pytest.approx(2.0, abs=0.2)


def test_all_methods_return_ranked_genes(spark, raw, norm, counts):
    spiky = counts.copy()
    spikes = to_matrix(spark, spiky[60:])
    for top in (hvg.seurat(norm, 10), hvg.brennecke(norm, 10), hvg.brennecke(norm, 10, fit="mixed_link", compat=True),
                hvg.scran(norm, log_normalize(spikes), 10), hvg.chen(norm, 10)):
        ranks = [r["rank"] for r in top.collect()]
        assert sorted(ranks) == list(range(1, len(ranks) + 1)) and len(ranks) <= 10


def test_quartic_trend_is_polyfit(spark):
    x = np.linspace(0.2, 9, 60)
    y = 1 - 0.4 * x + 0.03 * x**3 + np.sin(x)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)], "x double, y double")
    coef, centre, scale = hvg.polynomial_fit(df, "x", "y", 4)
    got = sum(c * ((x - centre) / scale) ** k for k, c in enumerate(coef))
    assert np.allclose(got, np.polyval(np.polyfit(x, y, 4), x), atol=1e-6)


def test_robust_distances_flag_planted_outliers(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(300, 3))
    x[:15] += 9
    df = spark.createDataFrame([(f"c{i}", *map(float, v), 1.0) for i, v in enumerate(x)], "cell string, a double, b double, c double, k double")
    got = {r["cell"]: r["md"] for r in qc.robust_distances(df, ["a", "b", "c", "k"]).collect()}
    d = np.array([got[f"c{i}"] for i in range(300)])
    assert d[:15].min() > 5 * np.quantile(d[15:], 0.9)


@pytest.mark.parametrize("n,p", [(13, 2), (11, 1), (9, 3)])
def test_minimum_covariance_is_the_least_of_all_halves(spark, n, p):
    rng = np.random.default_rng(n)
    x = rng.normal(size=(n, p)) + 5 * (rng.random((n, 1)) < 0.3)
    names = [f"v{i}" for i in range(p)]
    df = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(x)], ["cell", *names]).withColumn("spread", F.xxhash64("cell"))
    logdet, centre, cov = qc.minimum_covariance(df, names, n)
    halves = itertools.combinations(range(n), qc.half_of(n, p))
    want = min((np.linalg.slogdet(np.cov(x[list(h)].T, bias=True).reshape(p, p))[1], h) for h in halves)
    assert logdet == pytest.approx(want[0], abs=1e-9)
    assert np.allclose(centre, x[list(want[1])].mean(0)) and np.allclose(cov, np.cov(x[list(want[1])].T, bias=True).reshape(p, p))


def test_robust_distances_over_many_subsets(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(2500, 2)) @ np.array([[2.0, 0.3], [0.0, 0.5]]) + 4
    x[:200] += 30
    df = spark.createDataFrame([(f"c{i}", *map(float, v)) for i, v in enumerate(x)], "cell string, a double, b double")
    got = {r["cell"]: r["md"] for r in qc.robust_distances(df, ["a", "b"]).collect()}
    d = np.array([got[f"c{i}"] for i in range(2500)])
    assert np.median(d[200:]) == pytest.approx(2 * math.log(2), rel=0.15)
    assert d[:200].min() > 100


def test_contrasts_are_antisymmetric_and_match_a_t_test(spark, norm, counts):
    cl = spark.createDataFrame([(f"c{j:03d}", "ab"[j % 2] if j < 40 else "z") for j in range(60)], "cell string, cluster string")
    got = {(r["comparison"], r["gene"]): r for r in contrasts.pairwise_t_tests(norm, cl, "up").collect()}
    d = dense_norm(counts)
    groups = {k: [j for j in range(60) if ("ab"[j % 2] if j < 40 else "z") == k] for k in "abz"}
    for i in (0, 5, 50):
        rss = sum(((d[i, g] - d[i, g].mean()) ** 2).sum() for g in groups.values())
        a, b = d[i, groups["a"]], d[i, groups["z"]]
        t = (a.mean() - b.mean()) / math.sqrt(rss / 57 * (1 / len(a) + 1 / len(b)))
        r, mirror = got["a_vs_z", f"g{i:03d}"], got["z_vs_a", f"g{i:03d}"]
        assert r["t_stat"] == pytest.approx(t) and mirror["t_stat"] == pytest.approx(-t)
        assert r["p_val"] + mirror["p_val"] == pytest.approx(1.0)
        assert r["FDR"] >= r["p_val"] - 1e-12


def test_constant_gene_has_no_p_value(spark):
    rows = [("flat", f"c{j}", 2.0) for j in range(6)] + [("x", f"c{j}", float(j + 1)) for j in range(6)]
    m = Matrix(spark.createDataFrame(rows, "gene string, cell string, value double"))
    cl = spark.createDataFrame([(f"c{j}", "ab"[j // 3]) for j in range(6)], "cell string, cluster string")
    got = {(r["gene"], r["cluster"]): r for r in contrasts.pairwise_t_tests(m, cl).collect()}
    assert got["flat", "a"]["p_val"] is None and got["flat", "a"]["FDR"] is None
    assert got["x", "b"]["FDR"] is not None


def test_group_tables_hold_the_whole_grid(spark, norm, counts):
    cl = spark.createDataFrame([(f"c{j:03d}", str(j % 3)) for j in range(60)], "cell string, cluster string")
    d = dense_norm(counts)
    med = {(r["gene"], r["cluster"]): r["median"] for r in group_median(norm, cl).collect()}
    mom = {(r["gene"], r["cluster"]): r["mean"] for r in group_moments(norm, cl).collect()}
    assert len(med) == len(mom) == 120 * 3
    for i in (0, 10, 77):
        for k in range(3):
            assert med[f"g{i:03d}", str(k)] == pytest.approx(np.median(d[i, k::3]))
            assert mom[f"g{i:03d}", str(k)] == pytest.approx(d[i, k::3].mean())


def test_unknown_needs_more_than_the_limit(spark):
    t = spark.createDataFrame([("0", "T", 2.0, 0.1, 0.10, "X"), ("1", "B", 2.0, 0.2, 0.11, "NA"), ("1", "T", 1.0, 0.2, 0.01, "X")],
                              "cluster string, cell_type string, activity double, p_val double, padj double, markers string")
    assert {r["cluster"]: r["cell_type"] for r in celltypes.best_cell_types(t).collect()} == {"0": "T", "1": "Unknown"}


def test_symbols_map_only_when_unique(spark):
    m = Matrix(spark.createDataFrame([("ensmusg01", "c", 1.0), ("ensmusg02", "c", 2.0), ("ensmusg03", "c", 3.0)], "gene string, cell string, value double"))
    sy = spark.createDataFrame([("ENSMUSG01", "Foo"), ("ENSMUSG02", "Bar"), ("ENSMUSG03", "Bar")], "ensembl string, symbol string")
    assert [r["gene"] for r in celltypes.map_symbols(m, sy).expr.collect()] == ["FOO"]
    plain = Matrix(spark.createDataFrame([("Xist", "c", 1.0)], "gene string, cell string, value double"))
    assert [r["gene"] for r in celltypes.map_symbols(plain, sy).expr.collect()] == ["XIST"]


def test_filters_are_strict(spark):
    m = Matrix(spark.createDataFrame([("a", "x", 5.0), ("b", "x", 5.0), ("a", "y", 11.0)], "gene string, cell string, value double"))
    assert {r["cell"] for r in filters.min_reads(m, 10).cells.collect()} == {"y"}
    assert {r["gene"] for r in filters.min_expressed(m, 1.0).genes.collect()} == {"a"}
    assert {r["gene"] for r in filters.min_expressed(m, 0.5).genes.collect()} == {"a"}
    with pytest.raises(filters.MatrixError):
        filters.validate_counts(Matrix(spark.createDataFrame([("a", "x", 1.5)], "gene string, cell string, value double")), "raw")
    with pytest.raises(filters.MatrixError):
        filters.validate_counts(m, "log2")


def test_a_concentration_step_takes_exactly_the_nearest_half(spark):
    """Ranks are met to the row, with ties and far values, and nothing is written for that."""
    rng = np.random.default_rng(5)
    for n in (50, 83):
        x = np.repeat(rng.normal(size=(n, 2)), 2, axis=0)[:n]
        x[-1] = 1e12
        df = spark.createDataFrame([tuple(map(float, r)) for r in x], "a double, b double").repartition(3)
        starts = [(np.zeros(2), np.eye(2)), (np.ones(2), np.array([[2.0, 0.5], [0.5, 1.0]]))]
        for h in (n // 2, n // 2 + 1):
            got = qc._step(df, ["a", "b"], starts, h)
            for (centre, cov), (logdet, mean, half) in zip(starts, got):
                w, y = np.linalg.inv(cov), x - centre
                d = y[:, 0] ** 2 * w[0, 0] + y[:, 0] * y[:, 1] * (2 * w[0, 1]) + y[:, 1] ** 2 * w[1, 1]
                near = x[d <= np.sort(d)[h - 1] * (1 + 1e-12)]
                assert np.allclose(mean, near.mean(axis=0)) and np.allclose(half, np.cov(near.T, bias=True))
                assert abs(logdet - np.linalg.slogdet(np.cov(near.T, bias=True))[1]) < 1e-9
            low, high = qc.ranked_distances(df, ["a", "b"], [starts[0]] * 2, [h, n - 1])
            assert (low, high) == pytest.approx((np.sort((x**2).sum(axis=1))[h], 2e24), rel=1e-12)
