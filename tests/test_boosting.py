"""Second-order boosting against plain forms of its definitions."""

import numpy as np
import pytest

from autotab import sources as IO
from autotab.operators import boosting as B


def rows(seed, n=400, d=3, k=2):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(0, 1, (n, d)), 1) + 0.0
    y = (x[:, 0] + x[:, 1] ** 2 > 0.8).astype(float) + (x[:, 2] > 1).astype(float) * (k > 2)
    return x, y


def frame(spark, x, y, parts=3):
    return spark.createDataFrame([(i, [float(v) for v in r], float(t)) for i, (r, t) in enumerate(zip(x, y))],
                                 "row_id long, features array<double>, label double").repartition(parts)


def plain_tree(x, g, h, depth, lam, gamma, least, eta, node=0, out=None):
    """{node: (feature, cut, value)} by trying every value of every feature."""
    out = {} if out is None else out
    out[node] = (-1, None, -eta * g.sum() / (h.sum() + lam))
    best = (1e-12, None, None)
    if depth:
        for f in range(x.shape[1]):
            for c in np.unique(x[:, f])[:-1]:
                at = x[:, f] <= c
                a, b = h[at].sum(), h[~at].sum()
                if a < least or b < least:
                    continue
                gain = (g[at].sum() ** 2 / (a + lam) + g[~at].sum() ** 2 / (b + lam) - g.sum() ** 2 / (h.sum() + lam)) / 2 - gamma
                if gain > best[0] + 1e-9:
                    best = (gain, f, c)
    if best[1] is not None:
        at = x[:, best[1]] <= best[2]
        out[node] = (best[1], best[2], out[node][2])
        plain_tree(x[at], g[at], h[at], depth - 1, lam, gamma, least, eta, 2 * node + 1, out)
        plain_tree(x[~at], g[~at], h[~at], depth - 1, lam, gamma, least, eta, 2 * node + 2, out)
    return out


@pytest.mark.parametrize("objective, k", [("squared", 2), ("logistic", 2), ("softmax", 3)])
def test_trees_against_every_cut(spark, objective, k):
    x, y = rows(1, k=k)
    m = B.fit(frame(spark, x, y), objective, maxIter=2, maxDepth=3, stepSize=0.5, lam=1.0, gamma=0.05, least_hessian=2.0)
    margin = np.tile(m.base, (len(x), 1))
    for trees in m.rounds:
        g, h = B.gradients(objective, margin, y, 2.0)
        step = np.zeros_like(margin)
        for c, t in enumerate(trees):
            want = plain_tree(x, g[:, c], h[:, c], 3, 1.0, 0.05, 2.0, 0.5)
            for node, (f, cut, value) in want.items():
                assert t.feature[node] == f and abs(t.value[node] - value) < 1e-9
                assert f < 0 or m.edges[f][t.cut[node]] == cut
            step[:, c] = t.value[t.leaf(m.bins(x))]
        margin += step


def test_refreshed_margins_change_nothing(spark, monkeypatch):
    x, y = rows(2)
    a = B.fit(frame(spark, x, y), "logistic", maxIter=7, maxDepth=2)
    monkeypatch.setattr(B, "REFRESH", 2)
    b = B.fit(frame(spark, x, y), "logistic", maxIter=7, maxDepth=2)
    assert np.allclose(a.margins(a.bins(x)), b.margins(b.bins(x)))


def test_sampling_and_missing_values_and_saving(spark, tmp_path):
    x, y = rows(3, n=2000, k=3)
    x[::50, 0] = np.nan
    df = frame(spark, x, y)
    m = B.fit(df, "softmax", maxIter=15, maxDepth=3, subsamplingRate=0.7, columnRate=0.6, least_hessian=0.1)
    s = {r.row_id: r for r in m.transform(df).collect()}
    assert all(abs(sum(r.probability) - 1) < 1e-9 for r in s.values())
    assert np.mean([r.prediction == r.label for r in s.values()]) > 0.9
    assert len({tuple(np.flatnonzero([(t.feature == f).any() for f in range(3)])) for trees in m.rounds for t in trees}) > 1
    IO.save_model(m, str(tmp_path / "m"), spark)
    back = IO.load_model(str(tmp_path / "m"), spark)
    assert {r.row_id: r.prediction for r in back.transform(df).collect()} == {i: r.prediction for i, r in s.items()}


def test_one_value_and_no_rows(spark):
    df = frame(spark, np.ones((5, 2)), np.full(5, 3.0))
    m = B.fit(df, "squared", maxIter=3)
    assert [r.prediction for r in m.transform(df).collect()] == [3.0] * 5
    with pytest.raises(ValueError):
        B.fit(df.limit(0), "squared")


def test_rounds_cost_no_jobs_on_few_kinds_of_rows_and_one_or_many_tasks_agree(spark, monkeypatch):
    x, y = rows(4, n=3000)
    df = frame(spark, x, y, parts=4).persist()
    sc = spark.sparkContext

    def jobs(n):
        sc.setJobGroup(f"boosting-{n}", "fit")
        m = B.fit(df, "logistic", maxIter=n, maxDepth=3)
        sc.setLocalProperty("spark.jobGroup.id", None)
        return m, len(sc.statusTracker().getJobIdsForGroup(f"boosting-{n}"))

    (few, some), (many, more) = jobs(2), jobs(25)
    assert more <= some + 2      # before: one job per level and round, 69 more
    monkeypatch.setattr(B.binned, "TASK_BYTES", 0)
    apart = B.fit(df, "logistic", maxIter=25, maxDepth=3)
    assert np.allclose(apart.margins(apart.bins(x)), many.margins(many.bins(x)))
    df.unpersist()


@pytest.mark.parametrize("depth", [1, 4, 6, 7])
def test_leaf_by_sets_of_leaves(depth):
    rng = np.random.default_rng(depth)
    t = B.Tree(depth)
    for node in range((1 << depth) - 1):
        if (not node or t.feature[(node - 1) // 2] >= 0) and rng.random() < 0.9:
            t.feature[node], t.cut[node] = rng.integers(4), rng.integers(120)
    bins = rng.integers(0, 128, (5000, 4)).astype(np.uint8)
    assert (t.leaf(bins) == t.leaf_of(np.ascontiguousarray(bins.T))).all()


@pytest.mark.parametrize("total", [True, False])
def test_rows_of_equal_bins_are_one_weighted_row(spark, total):
    from pyspark.sql import functions as F
    x, y = rows(5, n=2000)
    x = np.round(x[:, :2])
    df = frame(spark, x, y, parts=5).select(F.col("features").alias("x"), F.col("label").alias("y"))
    edges = B.quantile_edges(df, F.col("x"), 2, 32)
    table, kinds = B.binned.stored(df, edges, 2000, total)
    got = table.collect()
    keys = {tuple(r) for r in (x if total else np.column_stack([x, y]))}
    assert kinds == len(got) == len(keys) and sum(r.w for r in got) == 2000
    assert sum(r.y if total else r.y * r.w for r in got) == y.sum()
