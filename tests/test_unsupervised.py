"""Brute-force checks of the pair-based operators and properties of the
iterative ones, on small fixtures."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from autotab.operators import anomaly as A
from autotab.operators import cluster as C
from autotab.operators import neighbours as N
from autotab.operators import reduce as RD


def _points(spark, n=120, seed=3):
    rng = np.random.default_rng(seed)
    centers = np.array([[0, 0], [5, 5], [0, 6]])
    X = np.vstack([centers[i % 3] + rng.normal(scale=0.4, size=2) for i in range(n)])
    rows = [(i, [float(a), float(b)]) for i, (a, b) in enumerate(X)]
    return spark.createDataFrame(rows, "row_id long, features array<double>"), X


def test_knn_matches_brute_force(spark):
    df, X = _points(spark)
    got = {(r.row_id, r.rank): r.neighbor for r in
           N.knn_join(df, df, 4, "row_id", exclude_self=True, block_rows=25).collect()}
    D = np.sqrt(((X[:, None] - X[None]) ** 2).sum(-1))
    np.fill_diagonal(D, np.inf)
    for i in range(len(X)):
        order = np.lexsort((np.arange(len(X)), D[i]))[:4]
        for rk, j in enumerate(order, start=1):
            assert got[(i, rk)] == j


def test_neighbour_counts_brute_force(spark):
    df, X = _points(spark)
    got = {r.row_id: r.n_within for r in N.neighbour_counts(df, 0.5, block_rows=30).collect()}
    D = np.sqrt(((X[:, None] - X[None]) ** 2).sum(-1))
    for i in range(len(X)):
        assert got[i] == int((D[i] <= 0.5).sum())


def _dbscan_brute(X, eps, min_samples):
    n = len(X)
    D = np.sqrt(((X[:, None] - X[None]) ** 2).sum(-1))
    core = (D <= eps).sum(1) >= min_samples
    comp = -np.ones(n, dtype=int)
    c = 0
    for i in range(n):
        if core[i] and comp[i] < 0:
            stack = [i]
            comp[i] = c
            while stack:
                u = stack.pop()
                for v in np.nonzero((D[u] <= eps) & core & (comp < 0))[0]:
                    comp[v] = c
                    stack.append(v)
            c += 1
    lab = comp.copy()
    for i in range(n):
        if not core[i]:
            nb = np.nonzero((D[i] <= eps) & core)[0]
            lab[i] = min(comp[nb]) if len(nb) else -1
    # renumber by smallest member
    firsts = sorted({l: min(np.nonzero(lab == l)[0]) for l in set(lab) if l >= 0}.items(),
                    key=lambda kv: kv[1])
    m = {l: k for k, (l, _) in enumerate(firsts)}
    return np.array([m.get(l, -1) for l in lab])


def test_dbscan_matches_brute_force(spark):
    df, X = _points(spark, 90)
    got = {r.row_id: r.cluster for r in C.cluster_dbscan(df, "row_id", 0.5, 4, block_rows=20).collect()}
    want = _dbscan_brute(X, 0.5, 4)
    assert [got[i] for i in range(len(X))] == list(want)


def test_silhouette_brute_force(spark):
    df, X = _points(spark, 60)
    lab = np.arange(60) % 3
    d2 = df.join(spark.createDataFrame([(i, int(l)) for i, l in enumerate(lab)], "row_id long, cluster int"),
                 "row_id")
    got = C.silhouette(d2, "row_id", "cluster", sample=None, block_rows=16).first().silhouette
    D = np.sqrt(((X[:, None] - X[None]) ** 2).sum(-1))
    s = []
    for i in range(60):
        same = (lab == lab[i]) & (np.arange(60) != i)
        a = D[i, same].mean()
        b = min(D[i, lab == c].mean() for c in set(lab) if c != lab[i])
        s.append((b - a) / max(a, b))
    assert got == pytest.approx(float(np.mean(s)))


def test_pca_orthonormal_and_variance(spark):
    df, X = _points(spark, 150)
    mean, V, ev = RD.pca_fit(df, 2)
    assert np.allclose(V.T @ V, np.eye(2), atol=1e-9)
    assert sum(ev) == pytest.approx(1.0)
    scores = RD.reduce_pca(df, ["row_id"], 2).orderBy("row_id").collect()
    S = np.array([[r.Component_1, r.Component_2] for r in scores])
    assert np.allclose(S.mean(0), 0, atol=1e-9)


def test_kmeans_cost_falls_with_k(spark):
    df, _ = _points(spark, 150)
    costs = [C.kmeans_cost(df, k) for k in (2, 3, 5)]
    assert costs[0] > costs[1] > costs[2]


def test_hierarchical_recovers_blobs(spark):
    df, X = _points(spark, 150)
    lab = {r.row_id: r.cluster for r in C.cluster_hierarchical(df, ["row_id"], 3).collect()}
    groups = {}
    for i in range(150):
        groups.setdefault(i % 3, set()).add(lab[i])
    assert all(len(g) == 1 for g in groups.values())


def test_nmf_nonnegative(spark):
    rng = np.random.default_rng(0)
    rows = [(i, [float(v) for v in rng.uniform(0, 5, 3)]) for i in range(80)]
    df = spark.createDataFrame(rows, "row_id long, features array<double>")
    out = RD.reduce_nmf(df, ["row_id"], 2, max_iter=20).collect()
    assert all(r.Component_1 >= 0 and r.Component_2 >= 0 for r in out)
    neg = spark.createDataFrame([(0, [-1.0, 2.0])], "row_id long, features array<double>")
    with pytest.raises(ValueError):
        RD.reduce_nmf(neg, ["row_id"], 2)


def test_ica_recovers_sources(spark):
    rng = np.random.default_rng(0)
    n = 600
    t = np.linspace(0, 8, n)
    S = np.c_[np.sign(np.sin(3 * t)), np.sin(5 * t)]
    Xm = S @ np.array([[1.0, 0.5], [0.4, 1.0]]).T
    df = spark.createDataFrame([(i, [float(a), float(b)]) for i, (a, b) in enumerate(Xm)],
                               "row_id long, features array<double>")
    out = RD.reduce_ica(df, ["row_id"], 2).orderBy("row_id").collect()
    Y = np.array([[r.Component_1, r.Component_2] for r in out])
    corr = np.abs(np.corrcoef(np.c_[Y, S].T)[:2, 2:])
    assert corr.max(axis=0).min() > 0.9


def _outliers(spark):
    rng = np.random.default_rng(5)
    X = rng.normal(size=(200, 2))
    X[:5] += 12
    return spark.createDataFrame([(i, [float(a), float(b)]) for i, (a, b) in enumerate(X)],
                                 "row_id long, features array<double>")


@pytest.mark.parametrize("detector", ["lof", "iforest", "elliptic", "one_class"])
def test_planted_outliers_top(spark, detector):
    df = _outliers(spark)
    fn = {"lof": lambda: A.anomaly_lof(df, "row_id", 10, 0.025),
          "iforest": lambda: A.anomaly_isolation_forest(df, "row_id", 0.025, n_trees=50),
          "elliptic": lambda: A.anomaly_elliptic(df, "row_id", 0.025),
          "one_class": lambda: A.anomaly_one_class(df, "row_id", 0.025)}[detector]
    out = fn().orderBy(F.col("anomaly_score").desc()).limit(5).collect()
    assert {r.row_id for r in out} == set(range(5))


def test_spectral_separates_blobs(spark):
    df, X = _points(spark, 90)
    lab = {r.row_id: r.cluster for r in C.cluster_spectral(df, "row_id", 3).collect()}
    groups = {}
    for i in range(90):
        groups.setdefault(i % 3, set()).add(lab[i])
    assert all(len(g) == 1 for g in groups.values())
    assert len(set(lab.values())) == 3


def test_knn_tree_merge_many_blocks(spark, monkeypatch):
    df, X = _points(spark, 150)
    monkeypatch.setattr(N, "MERGE_FANOUT", 2)
    got = {(r.row_id, r.rank): r.neighbor for r in
           N.knn_join(df, df, 3, "row_id", exclude_self=True, block_rows=10).collect()}
    D = np.sqrt(((X[:, None] - X[None]) ** 2).sum(-1))
    np.fill_diagonal(D, np.inf)
    for i in range(len(X)):
        order = np.lexsort((np.arange(len(X)), D[i]))[:3]
        for rk, j in enumerate(order, start=1):
            assert got[(i, rk)] == j


def test_reaching_blocks_split_cells_and_skip_far_ones(spark):
    """Counts stay exact when cells are small, split and mostly out of reach."""
    rng = np.random.default_rng(9)
    X = np.vstack([rng.normal(scale=0.3, size=(150, 2)), rng.normal(scale=0.3, size=(60, 2)) + 20,
                   np.repeat([[5.0, 5.0]], 60, axis=0)])
    df = spark.createDataFrame([(i, [float(a), float(b)]) for i, (a, b) in enumerate(X)],
                               "row_id long, features array<double>")
    got = {r.row_id: r.n_within for r in N.neighbour_counts(df, 0.25, block_rows=16).collect()}
    D = np.sqrt(((X[:, None] - X[None]) ** 2).sum(-1))
    assert got == {i: int((D[i] <= 0.25).sum()) for i in range(len(X))}


def _spread(spark, n, groups, seed, d=3):
    rng = np.random.default_rng(seed)
    x = rng.uniform(-100, 100, (groups, d))[rng.integers(0, groups, n)] + rng.normal(0, 0.5, (n, d))
    x[: n // 10] = x[0]      # many equal rows
    return x, spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "row_id long, features array<double>")


def test_cells_of_two_levels_give_exact_neighbours(spark, monkeypatch):
    from autotab.operators import cells
    monkeypatch.setattr(cells, "MAX_PIVOTS", 6)
    x, df = _spread(spark, 700, 12, 3)
    got = {(r.row_id, r.rank): r.neighbor for r in N.knn_join(df, df, 3, "row_id", exclude_self=True, block_rows=20).collect()}
    D = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    np.fill_diagonal(D, np.inf)
    for i in range(len(x)):
        want = sorted(range(len(x)), key=lambda j: (D[i, j], j))[:3]
        assert [got[i, r] for r in (1, 2, 3)] == want
    counts = {r.row_id: r.n_within for r in N.neighbour_counts(df, 0.8, "row_id", block_rows=20).collect()}
    np.fill_diagonal(D, 0)
    assert counts == {i: int((D[i] <= 0.8).sum()) for i in range(len(x))}


def test_copies_of_a_query_do_not_grow_on_clustered_rows(spark):
    from autotab.operators import cells
    visits = []
    for n in (400, 1600):
        rng = np.random.default_rng(1)
        centres = np.array([[i, j] for i in range(10) for j in range(n // 100)]) * 50.0      # clusters grow with the rows
        x = np.repeat(centres, 10, axis=0) + rng.normal(0, 0.5, (n, 2))
        df = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "_id long, _x array<double>")
        found, _ = cells.build(df, 20)
        row, _ = found.reached(x, np.full(n, 1.0))
        visits.append(len(row) / n)
    assert visits[1] < 1.3 * visits[0] < 8


def test_ward_on_rows_is_the_exact_tree(spark):
    """Unequal blobs, outliers that pair up early at a high cost, equal rows: as merging one pair at a time."""
    rng = np.random.default_rng(5)
    x = np.vstack([rng.normal(0, 1, (400, 2)), rng.normal([9, 0], 0.2, (40, 2)), rng.normal([0, 14], 3, (200, 2)),
                   [[60, 60], [70, 60], [-80, 5]], np.repeat([[5.0, 5.0]], 30, axis=0)])
    df = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "row_id long, features array<double>")
    keep, inv, n = np.unique(x, axis=0, return_inverse=True, return_counts=True)
    tree = C.ward_tree(keep, n)
    for k in (2, 5, 9):
        root = np.arange(len(keep))
        for i, j, _ in tree[:len(tree) - (k - 1)]:
            root[root == j] = i
        want = root[inv.ravel()]
        got = {r.row_id: r.cluster for r in C.cluster_hierarchical(df, ["row_id"], k, last=30, block_rows=150).collect()}
        pairs = {(got[i], want[i]) for i in range(len(x))}
        assert len(pairs) == k == len(set(got.values())) and got[0] == 0


def test_ward_on_no_and_one_row(spark):
    df = spark.createDataFrame([(3, [1.0, 2.0])], "row_id long, features array<double>")
    assert [tuple(r) for r in C.cluster_hierarchical(df, ["row_id"], 3).collect()] == [(3, 0)]
    assert C.cluster_hierarchical(df.limit(0), ["row_id"], 3).count() == 0
