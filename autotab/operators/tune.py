"""Tuning, cross-validation, ensembles, co-training and the pilot benchmark
(SURVEY §2.6). Fits are Spark jobs; the driver only loops over a bounded set
of candidates, folds or rounds and reads back one metric per fit."""

from __future__ import annotations

import hashlib
import itertools
import json
from concurrent.futures import ThreadPoolExecutor

from pyspark.ml.feature import VectorSlicer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from autotab.operators import metrics as M
from autotab.operators.models import MAX_TREE_DEPTH, fit_model, score
from autotab.operators.split import cv_plain, kfold, kfold_stratified, sample_n
from autotab.operators.starts import CentresModel, fit_starts, silhouettes
from autotab.session import cut_lineage, release

FIT_THREADS = 4
SIDE_ROWS = 8_000_000       # rows that fits side by side hold together: a fit of more has work for all cores

# Search grids per task and model, in the original's
# parameter names.
GRIDS = {
    ("classification", "clf_random_forest"): {
        "n_estimators": [100, 200], "max_depth": [10, 20, None],
        "min_samples_split": [2, 5], "min_samples_leaf": [1, 2]},
    ("classification", "clf_boosted"): {
        "n_estimators": [100, 200], "max_depth": [3, 5, 7],
        "learning_rate": [0.01, 0.1], "subsample": [0.8, 1.0]},
    ("classification", "clf_logistic"): {
        "C": [0.1, 1, 10], "penalty": ["l2"], "solver": ["lbfgs", "liblinear"]},
    ("classification", "clf_svm"): {"C": [0.1, 1, 10], "kernel": ["linear", "rbf"]},
    ("regression", "reg_random_forest"): {
        "n_estimators": [100, 200], "max_depth": [10, 20, None], "min_samples_split": [2, 5]},
    ("regression", "reg_boosted"): {
        "n_estimators": [100, 200], "max_depth": [3, 5, 7], "learning_rate": [0.01, 0.1]},
}

# Original parameter name -> Spark parameter name. Names
# mapped to None have no Spark counterpart and are dropped.
PARAM_NAMES = {
    "n_estimators": {"clf_random_forest": "numTrees", "reg_random_forest": "numTrees",
                     "clf_boosted": "maxIter", "reg_boosted": "maxIter"},
    "max_depth": "maxDepth",
    "learning_rate": "stepSize",
    "subsample": "subsamplingRate",
    "min_samples_leaf": "minInstancesPerNode",
    "min_samples_split": None,
    "solver": None,
    "penalty": None,
    "C": "C",
    "kernel": "kernel",
}


def param_grid(task: str, name: str) -> list[dict]:
    """Cross product of the grid in Spark names; duplicates (from dropped
    parameters) removed, order kept."""
    grid = GRIDS.get((task, name), {})
    keys = list(grid)
    out, seen = [], set()
    for combo in itertools.product(*[grid[k] for k in keys]):
        p = {}
        for k, v in zip(keys, combo):
            target = PARAM_NAMES.get(k, k)
            if isinstance(target, dict):
                target = target.get(name)
            if target is None:
                continue
            if target == "maxDepth" and v is None:
                v = MAX_TREE_DEPTH      # unlimited
            p[target] = v
        key = json.dumps(p, sort_keys=True)
        if key not in seen:
            seen.add(key)
            out.append(p)
    return out


def pick_candidates(grid: list[dict], n_iter: int = 5, seed: int = 42) -> list[dict]:
    """n_iter points with the smallest md5 of (seed, parameter string)."""
    def h(p):
        return hashlib.md5(f"{seed}:{json.dumps(p, sort_keys=True)}".encode()).hexdigest()
    return sorted(grid, key=h)[:n_iter]


def _metric(scored: DataFrame, task: str) -> float:
    if task == "regression":
        return float(M.metric_regression(scored).first()["r2"])
    return float(M.metric_accuracy(scored).first()["accuracy"])


def cross_validate(df: DataFrame, task: str, name: str, folds: int = 5, params: dict | None = None,
                   ids: list[str] | None = None, fold_col: str | None = None, seed: int = 42):
    """Per-fold scores (accuracy or R²) of one model: DataFrame (fold, score).
    Folds come from the hash order (stratified for classification) unless a
    fold column is given."""
    ids = ids or ["row_id"]
    spark = df.sparkSession
    if fold_col is None:
        withf = (kfold_stratified(df, "label", ids, folds, seed) if task == "classification"
                 else kfold(df, ids, folds, seed))
        fold_col = "fold"
        withf = cut_lineage(withf)
    else:
        withf = df

    def one(f):
        train = withf.filter(F.col(fold_col) != f)
        test = withf.filter(F.col(fold_col) == f)
        m = fit_model(train, task, name, dict(params or {}, **({"ids": ids} if name == "clf_knn" else {})))
        return f, _metric(score(m, test, ids), task)

    threads = max(1, min(FIT_THREADS, SIDE_ROWS // max(1, withf.count())))
    with ThreadPoolExecutor(threads) as pool:      # folds side by side, as far as their stored rows allow
        rows = list(pool.map(one, range(folds)))
    if withf is not df:
        release(withf)
    return spark.createDataFrame(rows, "fold int, score double")


def random_search(df: DataFrame, task: str, name: str, folds: int = 5, n_iter: int = 5,
                  ids: list[str] | None = None, seed: int = 42):
    """Five candidates from the grid, k folds each, best mean refit on all
    rows. Returns (best model, candidates table, winner's fold scores)."""
    ids = ids or ["row_id"]
    spark = df.sparkSession
    cands = pick_candidates(param_grid(task, name), n_iter, seed) or [{}]
    withf = cut_lineage(kfold_stratified(df, "label", ids, folds, seed) if task == "classification"
                        else kfold(df, ids, folds, seed))
    table, fold_scores = [], {}
    for i, p in enumerate(cands):
        fs = cross_validate(withf.select("*"), task, name, folds, p, ids, "fold", seed).collect()
        fold_scores[i] = fs
        vals = [r.score for r in fs]
        mean = sum(vals) / len(vals)
        std = (sum((v - mean) ** 2 for v in vals) / len(vals)) ** 0.5
        table.append((i, json.dumps(p, sort_keys=True), mean, std))
    best = max(table, key=lambda r: (r[2], -r[0]))
    model = fit_model(df, task, name, cands[best[0]])
    cand_df = spark.createDataFrame(table, "candidate int, params string, cv_mean double, cv_std double")
    winner = spark.createDataFrame([(r.fold, r.score) for r in fold_scores[best[0]]],
                                   "fold int, score double")
    return model, cand_df, winner


# ------------------------------------------------------------- ensembles
class VoteEnsemble:
    """Soft vote: mean of member probability arrays, argmax (first on ties)."""

    def __init__(self, members):
        self.members = members

    def transform(self, df: DataFrame) -> DataFrame:
        out = df
        cols = []
        for i, m in enumerate(self.members):
            out = m.transform(out).withColumnRenamed("probability", f"_prob{i}").withColumnRenamed(
                "prediction", f"_pred{i}")
            cols.append(f"_prob{i}")
        return ensemble_vote(out, cols).drop(*cols, *[f"_pred{i}" for i in range(len(cols))])


def ensemble_vote(df: DataFrame, prob_cols: list[str]) -> DataFrame:
    k = len(prob_cols)
    acc = F.col(prob_cols[0])
    for c in prob_cols[1:]:
        acc = F.zip_with(acc, F.col(c), lambda a, b: a + b)
    mean = F.transform(acc, lambda x: x / k)
    return (df.withColumn("probability", mean)
            .withColumn("prediction", (F.array_position("probability", F.array_max("probability")) - 1)
                        .cast("double")))


class MeanEnsemble:
    def __init__(self, members):
        self.members = members

    def transform(self, df: DataFrame) -> DataFrame:
        out = df
        cols = []
        for i, m in enumerate(self.members):
            out = m.transform(out).withColumnRenamed("prediction", f"_pred{i}")
            cols.append(f"_pred{i}")
        return ensemble_mean(out, cols).drop(*cols)


def ensemble_mean(df: DataFrame, pred_cols: list[str]) -> DataFrame:
    return df.withColumn("prediction", sum((F.col(c) for c in pred_cols[1:]), F.col(pred_cols[0]))
                         / len(pred_cols))


def fit_ensemble(df: DataFrame, task: str, weights: bool = False):
    """Forest + boosting + logistic (soft vote) or forest + boosting + ridge (mean);
    ``weights`` balances the classes in the members that take class weights."""
    if task == "classification":
        return VoteEnsemble([fit_model(df, task, "clf_random_forest", {"numTrees": 100}, weights),
                             fit_model(df, task, "clf_boosted", {"choice": "xgboost"}, weights),
                             fit_model(df, task, "clf_logistic", None, weights)])
    return MeanEnsemble([fit_model(df, task, "reg_random_forest", {"numTrees": 100}),
                         fit_model(df, task, "reg_boosted", {"choice": "xgboost"}),
                         fit_model(df, task, "reg_ridge")])


# ------------------------------------------------------------ co-training
class CoTrainingModel:
    def __init__(self, m1, m2, split, dim):
        self.m1, self.m2, self.split, self.dim = m1, m2, split, dim

    def views(self, df: DataFrame, features: str = "features") -> DataFrame:
        v1 = VectorSlicer(inputCol=features, outputCol="_v1", indices=list(range(self.split)))
        v2 = VectorSlicer(inputCol=features, outputCol="_v2",
                          indices=list(range(self.split, self.dim)))
        return v2.transform(v1.transform(df))

    def transform(self, df: DataFrame) -> DataFrame:
        """Average both views' probabilities; argmax."""
        out = self.views(df)
        p1 = self.m1.transform(out.withColumn("features", F.col("_v1")))
        p1 = p1.withColumnRenamed("probability", "_p1").drop("prediction")
        p2 = self.m2.transform(p1.withColumn("features", F.col("_v2")))
        p2 = p2.withColumnRenamed("probability", "_p2").drop("prediction")
        return ensemble_vote(p2, ["_p1", "_p2"]).drop("_p1", "_p2", "_v1", "_v2")


def co_training(df: DataFrame, ids: list[str], max_iter: int = 100, per_round_cap: int = 100,
                name1: str = "clf_logistic", name2: str = "clf_random_forest"):
    """Blum & Mitchell co-training on two halves of the feature vector.

    ``label`` null marks unlabelled rows. Each round both view models score
    the pool; each picks its ``min(cap, pool // 10)`` most confident rows
    (a bounded top-n); the union of the picks, labelled by the view that
    picked them (view 1 wins a row both picked), counts as labelled from then
    on; both models refit. The rows are stored once; a round adds its picks to a
    small table of ids and labels (at most 2 * cap a round), which is all that is rewritten.
    """
    from autotab.operators.models import _feature_dim
    dim = _feature_dim(df)
    split = dim // 2
    base = cut_lineage(CoTrainingModel(None, None, split, dim).views(df))
    spark = df.sparkSession
    kinds = ", ".join(f"{i} {df.schema[i].dataType.simpleString()}" for i in ids)
    given = spark.createDataFrame([], f"{kinds}, _pl double")

    def fit_views():
        lab = base.join(F.broadcast(given), ids, "left").withColumn("label", F.coalesce("label", "_pl")).drop("_pl")
        lab = lab.filter(F.col("label").isNotNull()).persist()
        m1 = fit_model(lab.withColumn("features", F.col("_v1")), "classification", name1)
        m2 = fit_model(lab.withColumn("features", F.col("_v2")), "classification", name2, {"numTrees": 20})
        n = lab.count()
        lab.unpersist()
        return m1, m2, n

    total = base.count()
    m1, m2, n_labelled = fit_views()
    picked, rounds = [], 0
    for _ in range(max_iter):
        n_add = min(per_round_cap, (total - n_labelled) // 10)
        if n_add == 0:
            break
        pool = base.filter(F.col("label").isNull()).join(F.broadcast(given.select(*ids)), ids, "left_anti")
        chosen: dict = {}
        for view, m in (("_v2", m2), ("_v1", m1)):      # view 1 last: it wins a row both picked
            s = m.transform(pool.withColumn("features", F.col(view))).withColumn("_conf", F.array_max("probability"))
            for r in s.orderBy(F.col("_conf").desc(), *ids).limit(n_add).select(*ids, "prediction").collect():
                chosen[tuple(r[i] for i in ids)] = float(r["prediction"])
        picked += [(*key, label) for key, label in chosen.items()]
        given = spark.createDataFrame(picked, f"{kinds}, _pl double")
        m1, m2, n_labelled = fit_views()
        rounds += 1
    model = CoTrainingModel(m1, m2, split, dim)
    model.rounds = rounds
    model.n_labelled = n_labelled
    release(base)
    return model


# ----------------------------------------------------------------- pilot
PILOT_MODELS = {
    "classification": [("Logistic Regression", "clf_logistic", {}),
                       ("Random Forest", "clf_random_forest", {"numTrees": 30, "maxDepth": 8}),
                       ("Gradient Boosting", "clf_gbt", {"maxIter": 30, "maxDepth": 4})],
    "regression": [("Linear Regression", "reg_linear", {}),
                   ("Random Forest", "reg_random_forest", {"numTrees": 30, "maxDepth": 8}),
                   ("Gradient Boosting", "reg_gbt", {"maxIter": 30, "maxDepth": 4})],
}


def pilot_benchmark(df: DataFrame, ids: list[str], task: str, cap: int | None = 2000, few_rows: int = 10) -> DataFrame:
    """Unshuffled 3 folds (2 below 30 rows), three representative models; (model, cv_mean,
    status, line) best first. ``cap`` bounds the labelled rows that classifiers are fitted on
    (the smallest hashes); regression takes all rows. Failures are reported as rows, not skipped;
    ``line`` is the text of the recommendation, with a note when rows are few."""
    spark = df.sparkSession
    rows_used = df if task == "regression" or cap is None else sample_n(df, ids, cap)
    head = cut_lineage(rows_used)
    n = head.count()
    schema = "model string, cv_mean double, status string, line string"
    if n < few_rows:
        return spark.createDataFrame([("pilot", None, f"too few rows (< {few_rows})", None)], schema)
    k = 2 if n < 30 else 3
    folded = cut_lineage(cv_plain(head, ids, k, label="label" if task == "classification" else None))
    note = " (few rows: treat with care)" if n < 100 else ""
    rows = []
    for title, name, params in PILOT_MODELS[task]:
        try:
            fs = cross_validate(folded, task, name, k, params, ids, "fold").collect()
            mean = sum(r.score for r in fs) / len(fs)
            shown = f"{mean * 100:.1f}%" if task == "classification" else f"{mean:.2f}"
            rows.append((title, mean, "ok", f"{title}: {shown} over {k} folds of {n} rows{note}"))
        except Exception as e:  # noqa: BLE001 - a failing model is reported, not raised
            rows.append((title, None, f"failed: {type(e).__name__}", f"{title}: no result"))
    release(head)
    out = spark.createDataFrame(rows, schema)
    return out.orderBy(F.col("cv_mean").desc_nulls_last(), "model")


def fit_auto_k(df: DataFrame, ids: list[str], k_min: int = 2, k_max: int = 10, features: str = "features",
               starts: int = 10, seed: int = 42):
    """(best fitted model, its labels, table (k, silhouette) best first) over k_min..k_max, with the
    silhouette of all rows."""
    data = cut_lineage(df.select(*ids, F.col(features).alias("_points")))
    found = fit_starts(data, list(range(k_min, k_max + 1)), starts, "_points", seed)
    labelled = data
    for k, (_, model) in found.items():
        labelled = model.transform(labelled, f"_k{k}")
    names = {f"_k{k}": k for k in found}
    points = cut_lineage(labelled.filter(F.col("_points").isNotNull()))
    score = silhouettes(points, ids[0], list(names), "_points") if found else {}
    release(points)
    rows = [(k, score[c]) for c, k in names.items()]
    table = df.sparkSession.createDataFrame(rows, "k int, silhouette double").orderBy(F.col("silhouette").desc(), "k")
    best = max(names, key=lambda c: score[c], default=None)        # the smallest k on ties
    if best is None:
        return None, data.select(*ids, F.lit(None).cast("int").alias("cluster")), table
    return (CentresModel(found[names[best]][1].centres, features),
            labelled.select(*ids, F.col(best).alias("cluster")), table)


def kmeans_auto_k(df: DataFrame, ids: list[str], k_min: int = 2, k_max: int = 10,
                  features: str = "features", starts: int = 10) -> DataFrame:
    """(k, silhouette) for each k; the best k is the first row."""
    return fit_auto_k(df, ids, k_min, k_max, features, starts)[2]
