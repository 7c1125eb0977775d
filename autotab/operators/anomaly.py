"""Anomaly detectors. Each returns (id, anomaly_score,
is_anomaly); higher scores are more anomalous and the flag marks the rows
above the (1 - contamination) quantile of the score (exact, distributed)."""

from __future__ import annotations

import math
import warnings

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from autotab.operators.neighbours import as_array, knn_join
from autotab.operators.ranking import column_quantiles
from autotab.operators.sums import moments
from autotab.session import cut_lineage, release

SEED = 42


def flag_anomalies(scored: DataFrame, id_col: str, contamination: float = 0.1,
                   score: str = "anomaly_score") -> DataFrame:
    """is_anomaly = 1 where the score exceeds its (1 - contamination)
    quantile (linear interpolation), else 0."""
    thr = column_quantiles(scored, [score], [1.0 - contamination])[score].get(1.0 - contamination)
    return scored.withColumn("is_anomaly", (F.col(score) > F.lit(thr)).cast("int"))


def anomaly_summary(flagged: DataFrame) -> DataFrame:
    return flagged.agg(F.sum("is_anomaly").cast("long").alias("n_anomalies"),
                       F.count(F.lit(1)).alias("n_rows"),
                       (F.avg("is_anomaly") * 100).alias("anomaly_pct"))


def attach_anomalies(raw: DataFrame, flagged: DataFrame, id_col: str) -> DataFrame:
    """Every raw row with its score and flag."""
    return raw.join(flagged.select(id_col, "anomaly_score", "is_anomaly"), id_col)


def top_anomalies(attached: DataFrame, id_col: str, n: int = 20) -> DataFrame:
    """The first ``n`` flagged rows, highest score first (the report's table)."""
    return (attached.filter(F.col("is_anomaly") == 1)
            .orderBy(F.col("anomaly_score").desc(), id_col).limit(n))


# ------------------------------------------------------------------- LOF
def anomaly_lof(df: DataFrame, id_col: str = "row_id", k: int = 20, contamination: float = 0.1,
                features: str = "features") -> DataFrame:
    """Local outlier factor (Breunig et al. 2000) without self-matches:
    k-distance, reachability, local reachability density and the ratio,
    all as equi-joins on neighbour ids and groupBys over the exact k-NN."""
    nb = cut_lineage(knn_join(df, df, k, id_col, features, exclude_self=True))
    kd = nb.groupBy(id_col).agg(F.max("dist").alias("kdist"))
    reach = nb.join(kd.select(F.col(id_col).alias("neighbor"), "kdist"), "neighbor").select(
        id_col, "neighbor", F.greatest("kdist", "dist").alias("rd"))
    lrd = reach.groupBy(id_col).agg((1.0 / F.avg("rd")).alias("lrd"))
    lrd = cut_lineage(lrd)
    lof = (nb.join(lrd.select(F.col(id_col).alias("neighbor"), F.col("lrd").alias("nlrd")), "neighbor")
           .groupBy(id_col).agg(F.avg("nlrd").alias("m")).join(lrd, id_col)
           .select(id_col, (F.col("m") / F.col("lrd")).alias("anomaly_score")))
    return flag_anomalies(cut_lineage(lof), id_col, contamination)


# ------------------------------------------------------- isolation forest
def _c(n: float) -> float:
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1) + 0.5772156649015329) - 2.0 * (n - 1) / n


def anomaly_isolation_forest(df: DataFrame, id_col: str = "row_id", contamination: float = 0.1,
                             n_trees: int = 100, sample: int = 256, features: str = "features",
                             seed: int = SEED) -> DataFrame:
    """Isolation forest (Liu et al. 2008). Each tree's ``sample`` training rows
    are the smallest hashes of (seed, tree, id) over the whole table: one pass
    keeps the rows whose hash for a tree lies under a bound that more than
    ``sample`` rows pass, and one grouped ``applyInPandas`` takes the smallest
    and grows that tree on the executors. The forest (at most n_trees *
    (2 * sample - 1) nodes) is shipped to every task and rows are scored by
    path length in Arrow batches."""
    data = df.select(id_col, as_array(df, features).alias("_a"))
    n = data.count()
    share = min(1.0, (sample + 8.0 * math.sqrt(sample) + 8.0) / max(n, 1))
    bound = F.lit(int(share * (1 << 62)))
    hashed = F.transform(F.sequence(F.lit(0), F.lit(n_trees - 1)), lambda t: F.struct(
        t.alias("tree"), F.shiftrightunsigned(F.xxhash64(F.lit(seed), t, F.col(id_col)), 2).alias("_h")))
    per_tree = (data.select(id_col, "_a", F.explode(F.filter(hashed, lambda x: x["_h"] < bound)).alias("t"))
                .select(id_col, "_a", "t.tree", "t._h"))
    limit = int(math.ceil(math.log2(max(sample, 2))))

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["_h", id_col]).head(sample)
        t = int(pdf["tree"].iloc[0])
        rng = np.random.default_rng(seed * 100003 + t)
        X = np.vstack(pdf["_a"].to_numpy())
        feat, thr, left, right, size = [], [], [], [], []

        def build(idx, depth):
            node = len(feat)
            feat.append(-1), thr.append(0.0), left.append(-1), right.append(-1), size.append(len(idx))
            if depth >= limit or len(idx) <= 1:
                return node
            sub = X[idx]
            lo, hi = sub.min(axis=0), sub.max(axis=0)
            cand = np.nonzero(hi > lo)[0]
            if len(cand) == 0:
                return node
            f = int(rng.choice(cand))
            s = float(rng.uniform(lo[f], hi[f]))
            feat[node], thr[node] = f, s
            mask = sub[:, f] < s
            left[node] = build(idx[mask], depth + 1)
            right[node] = build(idx[~mask], depth + 1)
            return node

        build(np.arange(len(X)), 0)
        return pd.DataFrame({"tree": [t], "feat": [feat], "thr": [thr], "left": [left],
                             "right": [right], "size": [size]})

    trees = per_tree.groupBy("tree").applyInPandas(
        grow, "tree int, feat array<int>, thr array<double>, left array<int>, right array<int>, "
              "size array<long>").collect()
    forest = [(np.asarray(r.feat), np.asarray(r.thr), np.asarray(r.left), np.asarray(r.right),
               np.array([_c(v) for v in r.size])) for r in trees]
    c_sample = _c(min(sample, n)) or 1.0
    id_type = df.schema[id_col].dataType.simpleString()

    def path_len(batches):
        for pdf in batches:
            if len(pdf) == 0:
                continue
            X = np.vstack(pdf["_a"].to_numpy())
            total = np.zeros(len(X))
            for feat, thr, left, right, size in forest:
                node = np.zeros(len(X), dtype=np.int64)
                depth = np.zeros(len(X))
                active = feat[node] >= 0
                while active.any():
                    f = feat[node[active]]
                    go_left = X[np.nonzero(active)[0], f] < thr[node[active]]
                    nxt = np.where(go_left, left[node[active]], right[node[active]])
                    node[active] = nxt
                    depth[active] += 1
                    active = feat[node] >= 0
                total += depth + size[node]
            mean = total / max(len(forest), 1)
            yield pd.DataFrame({id_col: pdf[id_col].to_numpy(),
                                "anomaly_score": np.power(2.0, -mean / c_sample)})

    scored = data.mapInPandas(path_len, f"{id_col} {id_type}, anomaly_score double")
    return flag_anomalies(cut_lineage(scored), id_col, contamination)


# ------------------------------------------------------ elliptic envelope
def anomaly_elliptic(df: DataFrame, id_col: str = "row_id", contamination: float = 0.1,
                     features: str = "features", starts: int = 4, start_rows: int = 500, tol: float = 1e-6,
                     max_steps: int = 50, seed: int = SEED) -> DataFrame:
    """Robust covariance by the minimum covariance determinant (FastMCD): from the mean
    and covariance of all rows and of ``starts`` hash-chosen subsets, C-steps keep the
    h = (n + d + 1) / 2 rows closest in Mahalanobis distance (exact h-th distance by
    selection) and re-estimate, until the determinant stops falling; every start gets two
    steps, the best one goes on to the end. The covariance is scaled so that the median distance is
    the chi-square median. Score = squared robust distance."""
    data = cut_lineage(df.select(id_col, as_array(df, features).alias("_a")))
    d = len(data.select("_a").first()[0])
    n, mu, cov = moments(data, "_a", d)
    h = (n + d + 1) // 2
    id_type = df.schema[id_col].dataType.simpleString()

    def distances(mu, cov, keep=False):
        inv = np.linalg.pinv(cov)

        def fn(batches):
            for pdf in batches:
                if len(pdf) == 0:
                    continue
                X = np.vstack(pdf["_a"].to_numpy()) - mu
                out = pd.DataFrame({id_col: pdf[id_col].to_numpy(),
                                    "anomaly_score": np.einsum("ij,jk,ik->i", X, inv, X)})
                if keep:
                    out["_a"] = pdf["_a"]
                yield out
        extra = ", _a array<double>" if keep else ""
        return data.mapInPandas(fn, f"{id_col} {id_type}, anomaly_score double{extra}")

    def step(mu, cov):
        dist = cut_lineage(distances(mu, cov, keep=True))
        at = (h - 1) / max(n - 1, 1)
        thr = column_quantiles(dist, ["anomaly_score"], [at])["anomaly_score"][at]
        _, mu, cov = moments(dist, "_a", d, F.col("anomaly_score") <= thr * (1 + 1e-12))
        release(dist)
        return mu, cov, float(np.linalg.slogdet(cov)[1])

    tried = []
    for s in range(starts + 1):
        if s:
            share = F.pmod(F.xxhash64(F.lit(seed + s), F.col(id_col)), F.lit(1 << 20)) / float(1 << 20)
            m, mu, cov = moments(data, "_a", d, share < min(1.0, max(start_rows, 10 * d) / max(n, 1)))
            if m <= d:
                continue
        for _ in range(2):
            mu, cov, det = step(mu, cov)
        tried.append((det, len(tried), mu, cov))
    det, _, mu, cov = min(tried, key=lambda t: t[:2])
    for _ in range(max_steps):
        new_mu, new_cov, new_det = step(mu, cov)
        if new_det >= det - tol * max(1.0, abs(det)):
            break
        mu, cov, det = new_mu, new_cov, new_det
    else:
        warnings.warn(f"anomaly_elliptic stopped at its limit of {max_steps} steps", stacklevel=2)
    scored = cut_lineage(distances(mu, cov))
    median = column_quantiles(scored, ["anomaly_score"], [0.5])["anomaly_score"][0.5]
    # Wilson and Hilferty's approximation of the chi-square median
    factor = median / (d * (1 - 2 / (9 * d)) ** 3) if median else 1.0
    release(data)
    return flag_anomalies(scored.withColumn("anomaly_score", F.col("anomaly_score") / factor), id_col, contamination)


# ---------------------------------------------------------- one-class SVM
def anomaly_one_class(df: DataFrame, id_col: str = "row_id", contamination: float = 0.1,
                      features: str = "features", nu: float = 0.5) -> DataFrame:
    from autotab.operators.margin import fit_one_class
    model = fit_one_class(df, features, nu)
    scored = cut_lineage(model.transform(df.select(id_col, features)).select(id_col, "anomaly_score"))
    return flag_anomalies(scored, id_col, contamination)
