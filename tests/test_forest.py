"""Random forests over binned rows."""

import numpy as np
import pytest

from autotab import sources as IO
from autotab.operators import forest as FO
from autotab.operators import models as MD


def frame(spark, n=3000, seed=1, digits=1):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(0, 1, (n, 4)), digits) + 0.0
    y = (x[:, 0] * x[:, 1] > 0).astype(float)
    z = 50 + 3 * x[:, 0] - 2 * np.abs(x[:, 2]) + rng.normal(0, 0.1, n)
    return spark.createDataFrame([(i, [float(v) for v in r], float(a), float(b)) for i, (r, a, b) in enumerate(zip(x, y, z))],
                                 "row_id long, features array<double>, label double, target double").repartition(4)


def share(model, df):
    return np.mean([r.prediction == r.label for r in model.transform(df).collect()])


@pytest.mark.parametrize("task_bytes", [1 << 30, 0])
def test_classes_and_means_in_one_task_or_many(spark, monkeypatch, task_bytes):
    monkeypatch.setattr(FO.binned, "TASK_BYTES", task_bytes)
    monkeypatch.setattr(FO, "PIECE_BYTES", 10_000)
    df, other = frame(spark, 2000).persist(), frame(spark, 1000, 2)
    trees = 12 if task_bytes else 6
    m = FO.fit(df, 2, numTrees=trees, maxDepth=9)
    assert len(m.trees) == trees and share(m, df) > 0.97 and share(m, other) > 0.9
    assert all(abs(sum(r.probability) - 1) < 1e-9 for r in m.transform(other).collect())
    r = FO.fit(df, 0, "target", numTrees=trees, maxDepth=9)
    got = [(x.prediction, x.target) for x in r.transform(other).collect()]
    p, t = np.array(got).T
    assert 1 - ((p - t) ** 2).sum() / ((t - t.mean()) ** 2).sum() > 0.85
    df.unpersist()


def test_nodes_passed_over_in_ranges_change_nothing(spark, monkeypatch):
    df = frame(spark, 600).persist()
    a = FO.fit(df, 2, numTrees=3, maxDepth=6)
    monkeypatch.setattr(FO, "PASS_BYTES", 5000)
    b = FO.fit(df, 2, numTrees=3, maxDepth=6)
    assert a.state() == b.state()
    df.unpersist()


def test_a_single_tree_without_bagging_is_pure_and_limits_hold(spark, monkeypatch):
    df = frame(spark, 500, digits=0).persist()
    m = FO.fit(df, 2, numTrees=8, maxDepth=30, minInstancesPerNode=20)
    rows = df.collect()
    x = np.array([r.features for r in rows])
    cols = np.ascontiguousarray(FO.binned.bin_numbers(x, m.edges).T)
    for t in FO.fit(df, 2, numTrees=4, maxDepth=2).trees:
        assert len(t.feature) <= 7
    for t in m.trees:
        leaves = t.leaf_of(cols)
        assert (t.feature[leaves] < 0).all() and len(t.feature) < 2 * 500 / 20
        assert np.allclose(t.value.sum(axis=1), 1)
    df.unpersist()


def test_cuts_against_every_cut():
    rng = np.random.default_rng(3)
    h = rng.integers(0, 6, (5, 3, 7, 3)).astype(float)
    h[..., 2] = h[..., 0] + h[..., 1]
    h[:, 1:] = h[:, :1][:, :, rng.permutation(7)]      # all features hold the same rows
    which, cut, sides = FO._cuts(h, 2, 3, True)

    def gini(s):
        return s[:2].sum() - (s[:2] ** 2).sum() / s[:2].sum()

    for i in range(5):
        best = (np.inf, None)
        for f in range(3):
            for c in range(6):
                a, b = h[i, f, :c + 1].sum(axis=0), h[i, f, c + 1:].sum(axis=0)
                if a[2] >= 3 and b[2] >= 3 and gini(a) + gini(b) < best[0] - 1e-9:
                    best = (gini(a) + gini(b), (f, c))
        assert (which[i], cut[i]) == best[1]
        assert np.allclose(sides[i].sum(axis=0), h[i, 0].sum(axis=0))


def test_few_jobs_whatever_the_depth_and_saving(spark, tmp_path):
    df, sc = frame(spark, 2000).persist(), spark.sparkContext
    df.count()
    sc.setJobGroup("forest", "fit")
    m = MD.fit_model(df, "classification", "clf_random_forest", {"numTrees": 10})
    sc.setLocalProperty("spark.jobGroup.id", None)
    assert len(sc.statusTracker().getJobIdsForGroup("forest")) < 20      # before: a pass over the rows per level of depth 30
    IO.save_model(m, str(tmp_path / "f"), spark)
    back = IO.load_model(str(tmp_path / "f"), spark)
    assert {r.row_id: r.prediction for r in back.transform(df).collect()} == {r.row_id: r.prediction for r in m.transform(df).collect()}
    weighted = MD.fit_model(df, "classification", "clf_random_forest", {"numTrees": 4, "maxDepth": 3}, weights=True)
    root = weighted.trees[0].value[0]
    assert abs(root[0] - 0.5) < 0.06
    df.unpersist()
