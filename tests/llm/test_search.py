import numpy as np

from quillcell.llm.catalog import op1_inverted_multi_index
from quillcell.llm.multi_index import multi_index_search
from quillcell.llm.topk import exact_top_k, vectors

SCHEMA = "vec_id long, embedding array<double>, label int, v string"


def _table(spark, n=300, d=6):
    x = np.random.default_rng(3).normal(size=(n, d))
    x[40:60] = x[40]
    rows = [(i, [float(c) for c in v], 1, "x") for i, v in enumerate(x)]
    odd = [(1000, None, 1, "x"), (1020, [], 1, None), (1040, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1, None), (1060, [float("nan")] * d, 1, None),
           (1080, [float("inf")] * d, None, None), (1100, [0.0] * d, 1, None), (None, [1.0] * d, 1, None), (1120, [1.0], 1, None), rows[20], rows[20]]
    return spark.createDataFrame(rows + odd, SCHEMA), x


def _brute(x, ids, k):
    out = {}
    for q in (i for i in ids if i % 20 == 0):
        score = {i: float(np.sum(x[q] * x[i])) for i in ids if i != q}
        out[q] = sorted(score, key=lambda i: (-score[i], i))[:k]
    return out


def _lists(df):
    got = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append(r.vec_id)
        assert r.rank == len(got[r.query_id])
    return got


def test_exact_and_ties(spark):
    table, x = _table(spark)
    rows = vectors(table, zero=False).cache()
    assert rows.count() == 300
    assert _lists(exact_top_k(rows.filter("vec_id % 20 = 0"), rows, 7)) == _brute(x, range(300), 7)
    whole = rows.selectExpr("vec_id", "transform(v, c -> double(floor(4 * c))) as v")
    got = exact_top_k(whole.filter("vec_id % 20 = 0"), whole, 500, integer=True)
    assert _lists(got) == _brute(np.floor(4 * x), range(300), 500) and dict(got.dtypes)["score"] == "bigint"
    assert vectors(table).count() == 301


def test_empty(spark):
    rows = vectors(spark.createDataFrame([], SCHEMA))
    assert exact_top_k(rows, rows, 3).count() == 0 and multi_index_search(rows, rows, 3).count() == 0
    one = vectors(spark.createDataFrame([(0, [1.0, 2.0], 1, None)], SCHEMA))
    assert exact_top_k(one, one, 3).count() == 0 and multi_index_search(one, one, 3).count() == 0


def test_recall(spark, sf):
    table, x = _table(spark)
    rows = vectors(table, zero=False).cache()
    got, want = _lists(multi_index_search(rows.filter("vec_id % 20 = 0"), rows, 20)), _brute(x, range(300), 20)
    assert np.mean([len(set(got[q]) & set(want[q])) / 20 for q in want]) > 0.9
    p = spark.read.parquet(f"{sf}/embeddings.parquet").toPandas().sort_values("vec_id")
    v = np.array(p.embedding.tolist(), dtype=float)
    got, want = _lists(op1_inverted_multi_index(spark, sf)), _brute(v, range(len(v)), 20)
    assert np.mean([len(set(got[q]) & set(want[q])) / 20 for q in want]) > 0.9
