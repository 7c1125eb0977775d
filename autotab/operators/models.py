"""Supervised models: built-in ``pyspark.ml`` estimators, configured to the
reference's choices, plus thin composites where Spark lacks the exact shape
(multiclass boosting with probabilities, kernel SVM with Platt scaling,
ensembles).

``fit_model(df, task, name, params)`` returns an object with
``transform(df)`` adding ``prediction`` and (for classifiers)
``probability``; ``score`` turns that into the tidy scored table the metrics
read.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.ml.classification import (DecisionTreeClassifier, GBTClassifier, LinearSVC,
                                       LogisticRegression, MultilayerPerceptronClassifier,
                                       NaiveBayes)
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from autotab.operators import boosting, forest
from autotab.session import spread

SEED = 42
MAX_TREE_DEPTH = 30   # what unlimited depth becomes: Spark's own limit

# Each boosting library's defaults (rounds, depth, learning rate, penalty, least
# Hessian or rows of a leaf); the leaf-wise library's 31 leaves become a depth of 5.
BOOSTED_CHOICES = {
    "xgboost": {"maxIter": 100, "maxDepth": 6, "stepSize": 0.3, "lam": 1.0, "least_hessian": 1.0},
    "lightgbm": {"maxIter": 100, "maxDepth": 5, "stepSize": 0.1, "lam": 0.0, "least_hessian": 1e-3, "least_rows": 20},
    "catboost": {"maxIter": 100, "maxDepth": 6, "stepSize": 0.03, "lam": 3.0, "least_hessian": 0.0},
}

CLASSIFIERS = ["clf_logistic", "clf_decision_tree", "clf_random_forest", "clf_gbt", "clf_boosted",
               "clf_svm", "clf_knn", "clf_gaussian_nb", "clf_mlp"]
REGRESSORS = ["reg_linear", "reg_ridge", "reg_random_forest", "reg_gbt", "reg_boosted", "reg_svr"]


# --------------------------------------------------------------- weights
def class_weights(df: DataFrame, label: str = "label", out: str = "weight") -> DataFrame:
    """'balanced' weights n / (k * n_c), joined back as a column (one row per
    class on the broadcast side)."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("_nc"))
    tot = counts.agg(F.sum("_nc").alias("_n"), F.count(F.lit(1)).alias("_k")).first()
    w = counts.select(label, (F.lit(float(tot["_n"])) / (F.lit(float(tot["_k"])) * F.col("_nc")))
                      .alias(out))
    return df.join(F.broadcast(w), label)      # by key, each class would fill one task


# ------------------------------------------------------------ composites
class ScoredModel:
    """Uniform transform: adds prediction (double) and probability (array)."""

    def __init__(self, model, prob: bool = True):
        self.model = model
        self.has_prob = prob

    def transform(self, df: DataFrame) -> DataFrame:
        out = self.model.transform(df)
        if self.has_prob and "probability" in out.columns:
            out = out.withColumn("probability", vector_to_array("probability"))
        return out.drop("rawPrediction")


class FourierFeatures:
    """Random Fourier features z(x) = sqrt(2/D) cos(Wx + b), W ~ N(0, 2*gamma)
    (Rahimi & Recht 2007): an RBF kernel approximated by a linear one. Calling it adds the
    column ``out``. W follows from the seed, so the parameters are all there is to store; it is a
    D x d matrix shipped inside the Arrow-batched UDF; rows never leave their task."""

    def __init__(self, features: str, d: int, n_components: int, gamma: float, seed: int, out: str):
        self.params = {"features": features, "d": d, "n_components": n_components, "gamma": gamma,
                       "seed": seed, "out": out}

    def mapping(self):
        """The map of a matrix of rows, for use inside tasks."""
        p = self.params
        rng = np.random.default_rng(p["seed"])
        d, k = p["d"], p["n_components"]
        W = rng.normal(0.0, math.sqrt(2 * p["gamma"]), size=(d, k))
        b = rng.uniform(0, 2 * math.pi, size=k)
        scale = math.sqrt(2.0 / k)
        return lambda X: scale * np.cos(X @ W + b)

    def __call__(self, df: DataFrame) -> DataFrame:
        return df.withColumn(self.params["out"], array_to_vector(self._mapped(df, self.mapping())))

    def dot(self, df: DataFrame, weights, intercepts) -> Column:
        """Array of z(x).w + b for each (w, b); the features stay inside the task."""
        z, w, b = self.mapping(), np.array(weights, float).T, np.array(intercepts, float)
        return self._mapped(df, lambda X: z(X) @ w + b)

    def _mapped(self, df: DataFrame, fn) -> Column:
        import pandas as pd
        from pyspark.sql.functions import pandas_udf

        from autotab.operators.neighbours import as_array

        @pandas_udf(T.ArrayType(T.DoubleType()))
        def mapped(col):
            return pd.Series(list(fn(np.stack(col.to_numpy())))) if len(col) else pd.Series([], dtype=object)

        return mapped(as_array(df, self.params["features"]))


def fourier_features(features: str, d: int, n_components: int = 100, gamma: float | None = None,
                     seed: int = SEED, out: str = "rff") -> FourierFeatures:
    return FourierFeatures(features, d, n_components, 1.0 / max(d, 1) if gamma is None else gamma, seed, out)


class PlattSVM:
    """Linear SVM (optionally on Fourier features) + Platt scaling: a
    one-feature logistic regression on the margin. One-vs-rest for k > 2.
    With a ``projector`` the members are (weights, intercept) on its features."""

    def __init__(self, members, platt, projector):
        self.members, self.platt, self.projector = members, platt, projector

    def transform(self, df: DataFrame) -> DataFrame:
        if self.projector:
            out = df.withColumn("_margins", self.projector.dot(df, *zip(*self.members)))
        else:
            out = df.withColumn("rff", F.col("features"))
        probs = []
        for i, (svm, lr) in enumerate(zip(self.members, self.platt)):
            if self.projector:
                out = out.withColumn(f"_m{i}", array_to_vector(F.array(F.col("_margins")[i])))
            else:
                s = svm.copy()
                s.setFeaturesCol("rff").setRawPredictionCol(f"_raw{i}").setPredictionCol(f"_sp{i}")
                out = s.transform(out).withColumn(f"_m{i}", array_to_vector(
                    F.array(vector_to_array(f"_raw{i}")[1])))
            p = lr.copy()
            p.setFeaturesCol(f"_m{i}").setProbabilityCol(f"_pp{i}").setPredictionCol(f"_lp{i}") \
             .setRawPredictionCol(f"_lr{i}")
            out = p.transform(out)
            probs.append(vector_to_array(f"_pp{i}")[1])
        if len(probs) == 1:
            arr = F.array(1 - probs[0], probs[0])
        else:
            tot = sum(probs[1:], probs[0])
            arr = F.array(*[x / tot for x in probs])
        out = out.withColumn("probability", arr).withColumn(
            "prediction", (F.array_position("probability", F.array_max("probability")) - 1)
            .cast("double"))
        drop = [c for c in out.columns if c.startswith(("_raw", "_sp", "_m", "_pp", "_lp", "_lr"))]
        return out.drop("rff", *drop)


def scale_gamma(df: DataFrame, features: str = "features") -> float:
    """1 / (d * variance of all feature values): the usual default RBF width."""
    from autotab.operators.neighbours import as_array
    x = df.select(F.explode(as_array(df, features)).alias("x"))
    n, var = df.count(), x.agg(F.var_pop("x")).first()[0]
    return 1.0 / (_feature_dim(df, features) * var) if n and var else 1.0


def _feature_dim(df: DataFrame, features: str = "features") -> int:
    from autotab.operators.neighbours import as_array
    return int(df.select(F.size(as_array(df, features))).first()[0])


def _n_classes(df: DataFrame, label: str = "label") -> int:
    return int(df.agg(F.max(label)).first()[0]) + 1


# ------------------------------------------------------------------- fit
def fit_model(df: DataFrame, task: str, name: str, params: dict | None = None,
              weights: bool = False, label: str = "label", features: str = "features"):
    """Fit one of the named models on (features, label). ``weights`` turns on
    balanced class weights for the estimators that accept them.

    The training rows are kept in executor storage while the fit's jobs run
    (row count, class counts, optimiser passes) so the upstream plan runs
    once, spread evenly over the cores and without other columns; k-NN keeps them, since its model is the training table.
    """
    owned = not df.is_cached
    data = df if not owned else df.persist() if name == "clf_knn" else spread(df.select(label, features))
    try:
        return _fit(data, task, name, params, weights, label, features)
    finally:
        if owned and name != "clf_knn":
            data.unpersist()


def _fit(df: DataFrame, task: str, name: str, params: dict | None, weights: bool, label: str,
         features: str):
    params = dict(params or {})
    wcol = None
    if weights and task == "classification" and name in (
            "clf_logistic", "clf_decision_tree", "clf_svm"):
        df = class_weights(df, label, "_w")
        wcol = "_w"
    n = None

    def count():
        nonlocal n
        if n is None:
            n = df.count()
        return n

    kw = {"featuresCol": features, "labelCol": label}
    if name == "clf_logistic":
        C = params.pop("C", 1.0)
        est = LogisticRegression(regParam=1.0 / (C * count()), standardization=False,
                                 maxIter=params.pop("maxIter", 2000), tol=1e-6, **kw, **params)
        if wcol:
            est.setWeightCol(wcol)
        return ScoredModel(est.fit(df))
    if name == "clf_decision_tree":
        est = DecisionTreeClassifier(maxDepth=params.pop("maxDepth", MAX_TREE_DEPTH), seed=SEED,
                                     **kw, **params)
        if wcol:
            est.setWeightCol(wcol)
        return ScoredModel(est.fit(df))
    if name == "clf_random_forest":
        return forest.fit(df, max(_n_classes(df, label), 2), label, features, balanced=weights, **({"maxDepth": MAX_TREE_DEPTH, "seed": SEED} | params))
    if name in ("clf_gbt", "clf_boosted"):
        k = _n_classes(df, label)
        if name == "clf_boosted":
            base = BOOSTED_CHOICES[params.pop("choice", "xgboost")] | params
            return boosting.fit(df, "logistic" if k <= 2 else "softmax", label, features, **base)
        base = {"maxIter": 100, "maxDepth": 3, "stepSize": 0.1} | params
        if k <= 2:
            return ScoredModel(GBTClassifier(seed=SEED, **kw, **base).fit(df))
        # multinomial deviance: one tree per class and round, Newton leaves with Hessian k/(k-1) p(1-p)
        return boosting.fit(df, "softmax", label, features, lam=0.0, least_hessian=0.0, hessian=k / (k - 1), **base)
    if name == "clf_svm":
        kernel = params.pop("kernel", "rbf")
        C = params.pop("C", 1.0)
        projector = None
        if kernel == "rbf":
            projector = fourier_features(features, _feature_dim(df, features), params.pop("n_components", 100),
                                         params.pop("gamma", None) or scale_gamma(df, features))
        k = _n_classes(df, label)
        classes = [1] if k <= 2 else list(range(k))
        members, platt = [], []
        for c in classes:
            b = df.withColumn("_bin", (F.col(label) == float(c)).cast("double"))
            svm = LinearSVC(featuresCol="rff" if projector else features, labelCol="_bin", regParam=1.0 / (C * count()),
                            maxIter=params.get("maxIter", 100))
            if wcol:
                svm.setWeightCol(wcol)
            sm = svm.fit(projector(b) if projector else b)      # keeps its own copy of the features, the only one
            if projector:
                members.append(([float(v) for v in sm.coefficients], float(sm.intercept)))
                margin = b.select(array_to_vector(F.array(projector.dot(b, *zip(members[-1]))[0])).alias("_m"), "_bin")
            else:
                members.append(sm)
                margin = sm.transform(b).withColumn("_m", array_to_vector(
                    F.array(vector_to_array("rawPrediction")[1]))).select("_m", "_bin")
            platt.append(LogisticRegression(featuresCol="_m", labelCol="_bin", regParam=0.0).fit(margin))
        return PlattSVM(members, platt, projector)
    if name == "clf_knn":
        from autotab.operators.neighbours import KNNClassifierModel
        return KNNClassifierModel(df, params.get("k", 5), params.get("ids", ["row_id"]), label,
                                  features)
    if name == "clf_gaussian_nb":
        return ScoredModel(NaiveBayes(modelType="gaussian", **kw).fit(df))
    if name == "clf_mlp":
        d = _feature_dim(df, features)
        k = _n_classes(df, label)
        est = MultilayerPerceptronClassifier(layers=[d, params.pop("hidden", 100), max(k, 2)],
                                             maxIter=params.pop("maxIter", 1000), seed=SEED, **kw)
        return ScoredModel(est.fit(df))
    if name == "reg_linear":
        return ScoredModel(LinearRegression(regParam=0.0, solver="normal", **kw).fit(df), prob=False)
    if name == "reg_ridge":
        alpha = params.pop("alpha", 1.0)
        sd = df.agg(F.stddev_pop(label)).first()[0] or 1.0
        est = LinearRegression(regParam=alpha * sd / count(), elasticNetParam=0.0,
                               standardization=False, solver="normal", **kw)
        return ScoredModel(est.fit(df), prob=False)
    if name == "reg_random_forest":
        return forest.fit(df, 0, label, features, **({"maxDepth": MAX_TREE_DEPTH, "seed": SEED} | params))
    if name == "reg_boosted":
        return boosting.fit(df, "squared", label, features, **(BOOSTED_CHOICES[params.pop("choice", "xgboost")] | params))
    if name == "reg_gbt":
        base = {"maxIter": 100, "maxDepth": 3, "stepSize": 0.1} | params
        return ScoredModel(GBTRegressor(seed=SEED, **kw, **base).fit(df), prob=False)
    if name == "reg_svr":
        from autotab.operators.margin import fit_svr
        return fit_svr(df, label, features, **params)
    raise ValueError(f"unknown model {name}")


def score(model, df: DataFrame, ids: list[str], label: str = "label") -> DataFrame:
    """Scored table: ids, label, prediction[, probability array]."""
    out = model.transform(df)
    cols = list(ids) + ([label] if label in out.columns else []) + ["prediction"]
    if "probability" in out.columns:
        cols.append("probability")
    return out.select(*cols)
