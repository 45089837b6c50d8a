"""Neighbours, graph, communities, layouts and doublets on small fixtures against brute force."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillcell.matrix import Matrix
from quillcell.operators import communities as C
from quillcell.operators import doublets, knn, linalg, snn
from quillcell.operators.layout import tsne, umap


def blobs(seed=0, copies=40):
    rng = np.random.default_rng(seed)
    centres = np.array([[0, 0, 0], [8, 0, 0], [0, 9, 0]])
    x = np.concatenate([c + rng.normal(size=(30, 3)) for c in centres] + [np.repeat([[8.0, 0.1, 0.2]], copies, axis=0)])
    return {f"p{i:03d}": row for i, row in enumerate(x)}


def as_df(spark, pts):
    return spark.createDataFrame([(k, v.tolist()) for k, v in pts.items()], "cell string, features array<double>")


def brute(pts, k):
    out = {}
    for a, v in pts.items():
        near = sorted((float(np.sqrt(((v - w) ** 2).sum())), b) for b, w in pts.items() if b != a)
        out[a] = [b for _, b in near[:k]]
    return out


@pytest.mark.parametrize("block,leaves", [(7, None), (4096, None), (4096, 40)])
def test_knn_is_exact_with_copies_and_small_blocks(spark, block, leaves):
    pts = blobs()
    got = {}
    for r in knn.exact_knn(as_df(spark, pts), 6, block=block, leaves=leaves).orderBy("src", "rank").collect():
        got.setdefault(r["src"], []).append(r["dst"])
    assert got == brute(pts, 6)


def test_tree_visits_a_small_share(spark):
    """30 000 points in 100 clusters: most pairs of leaves are never looked at, and what is left out is too far."""
    rng = np.random.default_rng(1)
    n, clusters = 30_000, 100
    x = rng.normal(size=(clusters, 8))[rng.integers(0, clusters, n)] * 4 + rng.normal(size=(n, 8)) * 0.5
    df = spark.createDataFrame([(f"p{i:05d}", v.tolist()) for i, v in enumerate(x)], "cell string, features array<double>")
    (placed, _), table, routed = knn.routes(df, 10)
    pairs = routed.join(table, "leaf").agg(F.sum("n")).first()[0]
    assert pairs / n**2 < 0.1
    home = {r["vid"]: r["leaf"] for r in placed.select("vid", "leaf").collect()}
    leaf = np.array([home[f"p{i:05d}"] for i in range(n)])
    seen = {}
    for r in routed.filter("vid in ('p00000', 'p00001', 'p00002')").collect():
        seen.setdefault(int(r["vid"][1:]), set()).add(r["leaf"])
    for i, leaves in seen.items():
        near = np.argsort(((x - x[i]) ** 2).sum(1))[:11]
        assert set(leaf[near]) <= leaves


def test_knn_with_fewer_points_than_k(spark):
    pts = {k: v for k, v in list(blobs().items())[:4]}
    rows = knn.exact_knn(as_df(spark, pts), 10).collect()
    assert len(rows) == 4 * 3


@pytest.mark.parametrize("prune,hot", [(0.067, 3), (0.0, 2048), (0.3, 5)])
def test_snn_equals_all_pairs(spark, prune, hot):
    pts, k = blobs(), 7
    sets = {a: {a, *near} for a, near in brute(pts, k - 1).items()}
    want = {}
    for a, b in itertools.combinations(sorted(pts), 2):
        v = len(sets[a] & sets[b])
        if v / (2 * k - v) > prune:
            want[a, b] = v
    table = knn.neighbour_table(as_df(spark, pts), k)
    got = {(r["src"], r["dst"]): r["shared"] for r in snn.snn_edges(table, k, prune, hot).collect()}
    assert got == want


def test_components_of_a_long_path(spark):
    nodes = spark.range(300).select(F.format_string("%03d", "id").alias("node"))
    ids = spark.range(299).filter("id not in (99, 199)")
    edges = ids.select(F.format_string("%03d", "id").alias("src"), F.format_string("%03d", F.col("id") + 1).alias("dst"))
    got = {r["node"]: r["component"] for r in C.connected_components(nodes, edges).collect()}
    assert {got["050"], got["150"], got["299"]} == {"000", "100", "200"}


def test_components_of_a_path_in_random_order(spark):
    ids = list(range(10_000))
    random.Random(7).shuffle(ids)
    edges = spark.createDataFrame(list(zip(ids, ids[1:])) + [(20_000, 20_001), (20_000, 20_000)], "src long, dst long")
    nodes = spark.range(10_000).union(spark.range(20_000, 20_003)).withColumnRenamed("id", "node")
    got = {r["component"]: r["count"] for r in C.connected_components(nodes, edges).groupBy("component").count().collect()}
    assert got == {0: 10_000, 20_000: 2, 20_002: 1}
    assert C.connected_components(nodes.limit(0), edges.limit(0)).count() == 0


def test_communities_find_blobs_and_are_connected(spark):
    pts = blobs(copies=0)
    table = knn.neighbour_table(as_df(spark, pts), 8)
    graph = snn.snn_graph(table, 8, 0.067).cache()
    nodes = as_df(spark, pts).select(F.col("cell").alias("node"))
    found = {r["cell"]: r["cluster"] for r in C.communities(nodes, graph, 0.8).collect()}
    assert len(found) == len(pts)
    names = sorted(pts)
    blob = {n: i // 30 for i, n in enumerate(names)}
    # no community mixes two blobs, and the partition beats the one of single cells
    assert all(len({blob[n] for n in names if found[n] == c}) == 1 for c in set(found.values()))
    assert len(set(found.values())) < 15
    sizes = np.bincount(list(found.values()))
    assert (np.diff(sizes) <= 0).all()


def _quality(edges, label, gamma):
    inside = sum(w for (a, b), w in edges.items() if label[a] == label[b])
    sizes = np.bincount(np.unique(list(label.values()), return_inverse=True)[1])
    return inside - gamma * float((sizes**2).sum()) / 2


def _sequential(nodes, edges, gamma, seed):
    """Local moves of one node after the other, then of whole communities, until nothing gains."""
    draw = np.random.default_rng(seed)
    label = {v: v for v in nodes}
    groups = {v: [v] for v in nodes}
    while True:
        moved_any, names = False, list(groups)
        moved = True
        home = {g: label[groups[g][0]] for g in names}
        of = {v: g for g in names for v in groups[g]}
        weight = {}
        for (a, b), w in edges.items():
            if of[a] != of[b]:
                weight.setdefault(of[a], {}).setdefault(of[b], 0.0)
                weight.setdefault(of[b], {}).setdefault(of[a], 0.0)
                weight[of[a]][of[b]] += w
                weight[of[b]][of[a]] += w
        while moved:
            moved = False
            for g in draw.permutation(names):
                mass = {}
                for h in names:
                    mass[home[h]] = mass.get(home[h], 0) + len(groups[h]) * (h != g)
                reach = {}
                for h, w in weight.get(g, {}).items():
                    reach[home[h]] = reach.get(home[h], 0.0) + w
                value = lambda c: reach.get(c, 0.0) - gamma * len(groups[g]) * mass.get(c, 0)  # noqa: B023, E731
                to = max(reach, key=value, default=home[g])
                if value(to) > value(home[g]) + 1e-9:
                    home[g], moved, moved_any = to, True, True
        label = {v: home[g] for g in names for v in groups[g]}
        if not moved_any:
            return label
        groups = {c: [v for v in nodes if label[v] == c] for c in set(label.values())}


def test_communities_are_as_good_as_sequential_ones(spark):
    rng = np.random.default_rng(11)
    n = 60
    nodes = [f"v{i:02d}" for i in range(n)]
    edges = {(nodes[i], nodes[j]): 1.0 for i in range(n) for j in range(i + 1, n) if rng.random() < (0.45 if i // 10 == j // 10 else 0.06)}
    df = spark.createDataFrame(list(edges), "src string, dst string")
    found = {r["cell"]: r["cluster"] for r in C.communities(spark.createDataFrame([(v,) for v in nodes], "node string"), df, 1.5).collect()}
    gamma = 1.5 * 2 * len(edges) / n**2
    assert set(found) == set(nodes)
    want = max(_quality(edges, _sequential(nodes, edges, gamma, s), gamma) for s in range(3))
    assert _quality(edges, found, gamma) >= want - 1e-9


def test_refinement_splits_what_is_badly_connected(spark):
    """Two cliques joined by one weak link inside one community share no part; a lone node stays alone."""
    clique = lambda names: [(a, b, 1.0) for a in names for b in names if a != b]
    left, right = [f"a{i}" for i in range(6)], [f"b{i}" for i in range(6)]
    rows = clique(left) + clique(right) + [("a0", "b0", 0.01), ("b0", "a0", 0.01)]
    nodes = spark.createDataFrame([(v, 1.0) for v in [*left, *right, "z"]], "node string, mass double")
    edges = spark.createDataFrame(rows, "src string, dst string, w double")
    member = nodes.select("node", F.lit("one").alias("community"))
    parts = {r["node"]: r["part"] for r in C._refine(nodes, edges, member, 0.3).collect()}
    assert not {parts[v] for v in left} & {parts[v] for v in right}
    assert parts["z"] == "z" and max(list(parts.values()).count(p) for p in parts.values()) > 1


def test_components_and_scores_match_numpy(spark):
    rng = np.random.default_rng(2)
    x = rng.poisson(1.0, (25, 8)).astype(float)
    x[3] = 0.0
    x[3, 0] = 1.0
    rows = [(f"g{j}", f"c{i:02d}", float(x[i, j])) for i in range(25) for j in range(8) if x[i, j]]
    m = Matrix(spark.createDataFrame(rows, "gene string, cell string, value double"))
    genes = spark.createDataFrame([(f"g{j}",) for j in range(6)], "gene string")
    p, scores = linalg.truncated_svd(m, genes, 3)
    u, s, vt = np.linalg.svd(x[:, :6], full_matrices=False)
    assert np.allclose(p.strength, s[:3])
    got = np.array([r["features"] for r in scores.orderBy("cell").collect()])
    assert np.allclose(np.abs(got), np.abs(u[:, :3] * s[:3]), atol=1e-8)
    q, centred = linalg.centred_pca(m, genes, 3)
    y = x[:, :6] - x[:, :6].mean(0)
    got = np.array([r["features"] for r in centred.orderBy("cell").collect()])
    u, s, _ = np.linalg.svd(y, full_matrices=False)
    assert np.allclose(np.abs(got), np.abs(u[:, :3] * s[:3]), atol=1e-8)
    assert np.allclose(np.array([r["features"] for r in q.apply(m).orderBy("cell").collect()]), got)


def _sparse(rng, n, d, share):
    """Random low-rank counts with noise, most of them zero."""
    x = rng.poisson(rng.gamma(1.0, 1.0, (n, 5)) @ rng.gamma(0.3, 1.0, (5, d))) * (rng.random((n, d)) < share)
    return x.astype(float)


def test_eigenpairs_agree_with_the_dense_solver():
    rng = np.random.default_rng(5)
    flat = np.linalg.qr(rng.standard_normal((120, 120)))[0]
    for values in (1.0 / np.arange(1, 121), np.concatenate([[5.0, 5.0, 5.0], np.full(117, 1.0)]), np.r_[np.ones(2), np.zeros(118)], np.linspace(2, 1, 120)):
        a = (flat * values) @ flat.T
        got, vectors, trace = linalg.eigenpairs(lambda v: a @ v, 120, 4)
        assert np.allclose(got, np.sort(values)[::-1][:4], atol=1e-8)
        assert np.allclose(vectors.T @ vectors, np.eye(4), atol=1e-8) and np.abs(a @ vectors - vectors * got).max() < 1e-6
        assert trace[-1] <= 1e-9
    assert linalg.eigenpairs(lambda v: v, 0, 3)[1].shape == (0, 0)


def test_product_in_panels_and_runs(spark, monkeypatch):
    rng = np.random.default_rng(7)
    x, v, offset = _sparse(rng, 200, 30, 0.2), rng.standard_normal((30, 5)), rng.standard_normal(5)
    at = [np.flatnonzero(r) for r in x]
    rows = spark.createDataFrame([(f"c{i}", a.tolist(), x[i, a].tolist()) for i, a in enumerate(at)], "cell string, idx array<int>, val array<double>")
    u = x @ v - offset
    for panel in (linalg.PANEL, 8 * 30 * 2):
        monkeypatch.setattr(linalg, "PANEL", panel)
        image, total = linalg.multiply(rows, v, offset)
        assert np.allclose(image, x.T @ u) and np.allclose(total, u.sum(0))


def test_wide_gene_sets_need_no_square_table(spark):
    """20 000 genes, few of them in any cell: a square table would hold 3 GB."""
    rng = np.random.default_rng(3)
    n, d = 120, 20_000
    where = [rng.choice(d, 60, replace=False) for _ in range(n)]
    x = np.zeros((n, d))
    for i, w in enumerate(where):
        x[i, w] = rng.poisson(3.0, 60) + 1.0
    rows = [(f"g{j:05d}", f"c{i:03d}", float(x[i, j])) for i, w in enumerate(where) for j in w]
    m = Matrix(spark.createDataFrame(rows, "gene string, cell string, value double"))
    genes = spark.range(d).select(F.format_string("g%05d", "id").alias("gene"))
    for fit, y in ((linalg.truncated_svd, x), (linalg.centred_pca, x - x.mean(0))):
        p, scores = fit(m, genes, 3)
        got = np.array([r["features"] for r in scores.orderBy("cell").collect()])
        values, vectors = np.linalg.eigh(y @ y.T)
        strength = p.strength**2 if fit is linalg.truncated_svd else p.strength * (n - 1)
        assert np.allclose(strength, values[::-1][:3])
        assert np.allclose(np.abs(got), np.abs(vectors[:, ::-1][:, :3] * np.sqrt(values[::-1][:3])), atol=1e-5)


@pytest.mark.parametrize("layout", ["tsne", "umap"])
def test_layouts_pull_blobs_apart(spark, layout):
    pts = blobs(copies=0)
    df = as_df(spark, pts)
    out = tsne(df, 8.0, 25) if layout == "tsne" else umap(df, 10, 25)
    xy = {r["cell"]: np.array([r["x"], r["y"]]) for r in out.collect()}
    assert set(xy) == set(pts) and all(np.isfinite(v).all() for v in xy.values())
    names = sorted(pts)
    own = np.mean([np.linalg.norm(xy[a] - xy[b]) for a, b in itertools.combinations(names[:30], 2)])
    other = np.mean([np.linalg.norm(xy[a] - xy[b]) for a in names[:30] for b in names[30:60]])
    assert other > own


def test_doublet_sampling_is_repeatable_and_whole(spark):
    cells = spark.range(20).select(F.concat(F.lit("c"), "id").alias("cell"))
    a = doublets.sample_pairs(cells, 50, 3)
    assert a.count() == 100
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, doublets.sample_pairs(cells, 50, 3).collect()))
