"""Neighbours over bins: tightened bounds, ties, copies, and what the search sends."""

import numpy as np
import pytest

from quillcell.operators import knn


def brute(names, x, k):
    out = {}
    for i, a in enumerate(names):
        far = np.sqrt(((x - x[i]) ** 2).sum(1))
        out[a] = [b for _, b in sorted((d, b) for d, b in zip(far.tolist(), names) if b != a)[:k]]
    return out


def found(df):
    got = {}
    for r in df.orderBy("src", "rank").collect():
        got.setdefault(r["src"], []).append(r["dst"])
    return got


@pytest.mark.parametrize("k,block", [(5, 40), (90, 100), (90, 30), (300, 64)])
def test_neighbours_over_many_bins(spark, k, block):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(size=(250, 6)), np.repeat(rng.normal(size=(3, 6)), 40, axis=0), rng.integers(0, 3, (80, 6))]).astype(float)
    names = [f"p{i:03d}" for i in rng.permutation(len(x))]
    df = spark.createDataFrame(list(zip(names, x.tolist())), "cell string, features array<double>")
    assert found(knn.exact_knn(df, k, block=block)) == brute(names, x, k)


def test_a_point_goes_to_a_bin_once_and_bounds_hold_few(spark):
    """Isotropic points visit nearly all leaves; what is sent grows with bins, what comes back with the result."""
    x = np.random.default_rng(4).normal(size=(3000, 32))
    df = spark.createDataFrame([(f"p{i:04d}", v.tolist()) for i, v in enumerate(x)], "cell string, features array<double>")
    (placed, path), table, homes, shape = knn._homes(df, 99, 42, 600, 60, False)
    bins = placed.select("bin").distinct().count()
    assert table.count() > 3 * bins
    assert homes.selectExpr("max(size(to))").first()[0] < bins
    tight = knn._tightened(homes, placed, path, shape, 100)
    for r in tight.filter("vid < 'p0020'").collect():
        far = np.sqrt(((x - np.array(r["features"])) ** 2).sum(1))
        assert 100 <= (far <= r["bound"] + 1e-12).sum() <= 150
