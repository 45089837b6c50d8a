"""UMAP in blocks: the same rounds as one array makes, and all of them in its query."""

import inspect

import numpy as np
import pytest

from quillcell.operators import layout as L
from quillcell.plans import queries_graph as Q


def test_the_query_runs_all_epochs(spark, sf, monkeypatch):
    """It asked for 6 epochs; those of the operator are 200."""
    seen = []
    monkeypatch.setattr(Q, "umap", lambda *a, **kw: seen.append(inspect.signature(L.umap).bind(*a, **kw)))
    Q.e02(spark, sf)
    seen[0].apply_defaults()
    assert seen[0].arguments["epochs"] >= 200 and seen[0].arguments["neighbours"] == 15


def _summary(x, y, most):
    if len(x) <= most:
        return np.stack([x, y, np.ones(len(x))], axis=1)
    side = int(np.sqrt(most))
    i, j = (np.minimum(side - 1, np.floor((v - v.min()) / (v.max() - v.min()) * side)) for v in (x, y))
    cells = [np.flatnonzero((i == a) & (j == b)) for a, b in {*zip(i, j)}]
    return np.array([(x[at].mean(), y[at].mean(), len(at)) for at in cells])


def _rounds(names, start, edges, epochs, most):
    """The rounds as written in the paper, over all rows; a name that comes twice is two rows."""
    x, y = (np.array([start[v][k] for v in names]) for k in (0, 1))
    w = np.array([[edges.get((u, v), 0.0) for v in names] for u in names])
    a, b, n, degree = L.UMAP_A, L.UMAP_B, len(names), w.sum(1)
    for it in range(epochs):
        dx, dy = x[:, None] - x, y[:, None] - y
        d2 = np.maximum(dx**2 + dy**2, 1e-12)
        pull = w * 2 * a * b * d2 ** (b - 1) / (1 + a * d2**b)
        rows = _summary(x, y, most)
        sx, sy = x[:, None] - rows[:, 0], y[:, None] - rows[:, 1]
        s2 = sx**2 + sy**2
        push = np.where(s2 > 1e-12, 2 * b / ((0.001 + s2) * (1 + a * np.maximum(s2, 1e-12) ** b)), 0.0) * rows[:, 2]
        for v, d, s in ((x, dx, sx), (y, dy, sy)):
            raw = degree * 5 / n * (push * s).sum(1) - (pull * d).sum(1)
            v += (1 - it / epochs) * np.clip(raw / np.maximum(1.0, degree), -4, 4)
    return x, y


@pytest.mark.parametrize("most, block", [(4096, 8192), (16, 4)])
def test_blocks_make_the_rounds_of_one_array(spark, monkeypatch, most, block):
    """Also with a summary by a grid, many small blocks and a cell that comes twice."""
    monkeypatch.setattr(L, "SUMMARY", most)
    monkeypatch.setattr(L, "BLOCK", block)
    rng = np.random.default_rng(9)
    rows = [(f"c{i:02d}", (rng.standard_normal(4) + 5.0 * (i % 3)).tolist()) for i in range(60)]
    rows.append(rows[7])
    points = spark.createDataFrame(rows, "cell string, features array<double>")
    links = {(r["src"], r["dst"]): r["w"] for r in L.fuzzy_graph(L.exact_knn(points, 6, 42), 6).collect()}
    start = {r["cell"]: (r["x"], r["y"]) for r in L.start_positions(points, 42, 5.0).collect()}
    names = [name for name, _ in rows]
    x, y = _rounds(names, start, links, 5, most)
    found = L.umap(points, 6, 5).collect()
    assert sorted(r["cell"] for r in found) == sorted(names)
    got = {r["cell"]: (r["x"], r["y"]) for r in found}
    assert np.allclose([got[v] for v in names], np.stack([x, y], axis=1), atol=1e-8)


def test_two_cells_far_fewer_than_blocks(spark):
    two = spark.createDataFrame([("a", [1.0, 2.0]), ("b", [0.0, 5.0])], "cell string, features array<double>")
    found = L.umap(two, 5, 2).collect()
    assert sorted(r["cell"] for r in found) == ["a", "b"] and all(np.isfinite([r["x"], r["y"]]).all() for r in found)


def test_cells_stay_finite_where_all_lie_on_one_spot():
    x = np.zeros(3)
    assert not np.abs(L._repulsion(x, x, np.array([[0.0, 0.0, 3.0]]))).any()
