import numpy as np
import pytest
from pyspark.sql import functions as F

from autotab.llm import mtree


def brute(ids, x, queries, k):
    out = {}
    for q in queries:
        at = list(ids).index(q)
        score = [(-int(x[at] @ x[j]), int(i)) for j, i in enumerate(ids) if i != q]
        out[q] = [(i, -s) for s, i in sorted(score)[:k]]
    return out


@pytest.mark.parametrize("kind", ["random", "clustered", "equal"])
def test_tree_against_brute_force(kind):
    rng = np.random.default_rng(3)
    n = 3000
    x = np.floor(rng.normal(0, 60, (n, 12)))
    if kind == "clustered":
        x = np.floor(rng.normal(0, 200, (8, 12)))[rng.integers(0, 8, n)] + np.floor(rng.normal(0, 3, (n, 12)))
    if kind == "equal":
        x[500:2500] = x[500]
    ids = rng.permutation(n)
    tree = mtree.Tree(ids, x, float((x * x).sum(axis=1).max()))
    queries = ids[:40]
    want = brute(ids, x, queries, 5)
    at = np.array([list(ids).index(q) for q in queries])

    def found(tree, rows, floor):
        best, names, work = tree.search(ids[rows], x[rows], 5, floor)
        return {int(ids[r]): [(int(i), int(s)) for i, s in zip(n, b)] for r, n, b in zip(rows, names, best)}, work

    got, work = found(tree, at, np.full(40, -np.inf))
    assert got == want
    exact = np.array([want[q][4][1] for q in queries], float)      # the exact bound changes nothing
    again, less = found(tree, at, exact)
    assert again == want and less <= work
    for r in at[:5]:      # alone or together
        assert found(tree, np.array([r]), np.array([-np.inf]))[0] == {int(ids[r]): want[ids[r]]}
    if kind == "clustered":
        assert work < 0.6 * n * len(queries) and less < 0.3 * n * len(queries)


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 AS cell", "2 AS v", "3 AS score")


def test_query_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(mtree, "CELL_ROWS", 100)
    monkeypatch.setattr(mtree, "TILE_ROWS", 64)
    monkeypatch.setattr(mtree, "QUERY_ROWS", 5)
    rng = np.random.default_rng(4)
    x = rng.normal(0, 1, (900, 6)).astype(np.float32)
    x[100:400] = x[100]
    df = frame(spark, [(i, [float(c) for c in v]) for i, v in enumerate(x)])
    want = brute(range(900), np.floor(256 * x.astype(np.float64)), range(0, 900, 50), 5)
    got = {}
    for r in sorted(mtree.top_k(df, F.col("vec_id") % 50 == 0).collect()):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert got == want


def test_null_short_repeated_and_no_rows(spark):
    rows = [(0, [1.0, 2.0]), (1, None), (2, [1.0, None]), (3, [float("nan"), 1.0]), (4, [float("inf"), 0.0]),
            (None, [9.0, 9.0]), (5, [1.0]), (6, [0.5, 0.5]), (6, [0.5, 0.5]), (50, []), (0, [1.0, 2.0])]
    got = [(r.query_id, r.rank, r.vec_id, r.score) for r in mtree.top_k(frame(spark, rows), F.col("vec_id") % 50 == 0).collect()]
    unit = 256 * 256
    assert sorted(got) == sorted([
        (0, 1, 6, int(1.5 * unit)), (0, 2, 6, int(1.5 * unit)), (0, 3, 5, unit), (0, 4, 50, 0),
        (50, 1, 0, 0), (50, 2, 0, 0), (50, 3, 5, 0), (50, 4, 6, 0), (50, 5, 6, 0)])
    assert mtree.top_k(frame(spark, []), F.col("vec_id") % 50 == 0).count() == 0
    assert mtree.top_k(frame(spark, rows), F.lit(False)).count() == 0
