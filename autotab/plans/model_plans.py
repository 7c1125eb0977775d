"""Supervised model queries: fit on the train split of a planted
target, score the test split. Scores are checked by rows here and by quality
properties in tests; ``class_weights`` and ``reg_linear``'s coefficients have
SQL oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from autotab.operators import metrics as M
from autotab.operators import models as MD
from autotab.operators import prep as R
from autotab.operators import split as S
from autotab.plans import fixtures as X
from autotab.plans.registry import plan
from autotab.session import cut_lineage, evened


def stored_split(rows, split):
    """``split(rows)``, computed once over evenly dealt rows: its thresholds take several passes, and the preparation,
    the fit and the scores would each repeat them, in as few tasks as the file has row groups."""
    held = evened(rows).persist()
    out = cut_lineage(split(held))
    held.unpersist()
    return evened(out)      # small files are read many to a task


def lineitem_binary(spark, d):
    """lineitem -> stratified split on big_order -> preparation fitted on train."""
    li = X.lineitem(spark, d).select("row_id", "l_quantity", "l_discount", "l_tax",
                                     "l_returnflag", "l_linestatus", "big_order")
    sp = stored_split(li, lambda rows: S.split_stratified(rows, "big_order", ["row_id"], 0.2, 42))
    train = sp.filter(F.col("split") == "train").drop("split")
    test = sp.filter(F.col("split") == "test").drop("split")
    prepared, model, rep = R.prepare(train, "big_order", ids=["row_id"], task="classification")
    return prepared, model.transform(test), rep


def part_band(spark, d):
    """part -> 3-class band target from p_size (non-linear), split on band."""
    p = X.part(spark, d).select("p_partkey", "p_size", "p_retailprice", "p_type", "band")
    p = p.withColumn("row_id", F.col("p_partkey").cast("string"))
    sp = S.split_stratified(p, "band", ["row_id"], 0.2, 42)
    train = sp.filter(F.col("split") == "train").drop("split", "p_partkey")
    test = sp.filter(F.col("split") == "test").drop("split", "p_partkey")
    prepared, model, rep = R.prepare(train, "band", ids=["row_id"], task="classification")
    return prepared, model.transform(test), rep


def lineitem_regression(spark, d):
    li = X.lineitem(spark, d).select("row_id", "l_quantity", "l_discount", "l_linestatus", "y_lin")
    sp = stored_split(li, lambda rows: S.split_random(rows, ["row_id"], 0.2, 42))
    train = sp.filter(F.col("split") == "train").drop("split")
    test = sp.filter(F.col("split") == "test").drop("split")
    prepared, model, rep = R.prepare(train, "y_lin", ids=["row_id"], task="regression")
    return prepared, model.transform(test), rep


def _clf_plan(name, data=lineitem_binary, params=None, weights=False):
    def run(spark, d):
        train, test, _ = data(spark, d)
        m = MD.fit_model(train, "classification", name, params, weights)
        return M.evaluate(MD.score(m, test, ["row_id"]), "classification")
    return run


def _reg_plan(name, params=None):
    def run(spark, d):
        train, test, _ = lineitem_regression(spark, d)
        m = MD.fit_model(train, "regression", name, params)
        return M.evaluate(MD.score(m, test, ["row_id"]), "regression")
    return run


def _register(name, run, table, target):
    """The metrics query, and a query that fits on its own and holds its accuracy against the majority
    share (or its R2 against a bound), whose share SQL computes."""
    plan(name)(run)
    if target is None:
        def quality(spark, d):
            r2 = dict(tuple(r) for r in run(spark, d).collect())["r2"]
            return X.lineitem(spark, d).agg(F.count(F.lit(1)).alias("n_rows")).withColumn("r2_above_0_9", F.lit(r2 > 0.9))
        plan(f"{name}_quality", sql="SELECT count(*) AS n_rows, true AS r2_above_0_9 FROM lineitem")(quality)
        return

    def quality(spark, d):
        accuracy = dict(tuple(r) for r in run(spark, d).collect())["accuracy"]
        counts = getattr(X, table)(spark, d).groupBy(target).count()
        return counts.agg((F.max("count") / F.sum("count")).alias("majority_share")).withColumn(
            "beats_majority", F.lit(accuracy) > F.col("majority_share") + 0.05)
    source = {"lineitem": X.LINEITEM_SQL, "part": X.PART_SQL}[table]
    plan(f"{name}_quality", rnd=("majority_share",), sql=f"""
SELECT cast(max(n) as double) / sum(n) AS majority_share, true AS beats_majority
FROM (SELECT {target}, count(*) AS n FROM ({source}) GROUP BY {target})""")(quality)


for _name in ["clf_logistic", "clf_decision_tree", "clf_random_forest", "clf_gbt",
              "clf_gaussian_nb", "clf_mlp"]:
    _register(_name, _clf_plan(_name), "lineitem", "big_order")
_register("clf_boosted", _clf_plan("clf_boosted", params={"choice": "lightgbm"}), "lineitem", "big_order")
_register("clf_svm", _clf_plan("clf_svm", params={"kernel": "rbf"}), "lineitem", "big_order")
_register("clf_svm_linear", _clf_plan("clf_svm", params={"kernel": "linear"}), "lineitem", "big_order")
_register("clf_gbt_multiclass", _clf_plan("clf_gbt", data=part_band), "part", "band")
_register("clf_boosted_multiclass", _clf_plan("clf_boosted", data=part_band, params={"choice": "xgboost", "maxIter": 20}),
          "part", "band")
_register("clf_knn", _clf_plan("clf_knn", params={"k": 5, "ids": ["row_id"]}), "lineitem", "big_order")
_register("clf_logistic_weighted", _clf_plan("clf_logistic", weights=True), "lineitem", "big_order")
for _name in ["reg_linear", "reg_ridge", "reg_random_forest", "reg_gbt"]:
    _register(_name, _reg_plan(_name), "lineitem", None)
_register("reg_boosted", _reg_plan("reg_boosted", params={"choice": "xgboost"}), "lineitem", None)
_register("reg_svr", _reg_plan("reg_svr"), "lineitem", None)


@plan("class_weights", rnd=("weight",), sql="""
SELECT quality AS label, cast((SELECT count(*) FROM labels) as double)
       / ((SELECT count(DISTINCT quality) FROM labels) * count(*)) AS weight
FROM labels GROUP BY quality""")
def q_class_weights(spark, d):
    lab = X.table(spark, d, "labels").select("doc_id", F.col("quality").alias("label"))
    return MD.class_weights(lab, "label").select("label", "weight").distinct()


@plan("predict")
def q_predict(spark, d):
    train, test, _ = lineitem_binary(spark, d)
    m = MD.fit_model(train, "classification", "clf_logistic")
    return MD.score(m, test, ["row_id"]).select("row_id", "label", "prediction")


@plan("predict_proba")
def q_predict_proba(spark, d):
    train, test, _ = lineitem_binary(spark, d)
    m = MD.fit_model(train, "classification", "clf_logistic")
    return MD.score(m, test, ["row_id"]).select("row_id", "probability")


def flagship(spark, d):
    return _clf_plan("clf_logistic")(spark, d)


# ----------------------------------------------- exact checks of estimators
def _one_feature(spark, d):
    li = X.lineitem(spark, d)
    from pyspark.ml.functions import array_to_vector
    return li.select("row_id", array_to_vector(F.array(F.col("l_quantity"))).alias("features"),
                     F.col("y_lin").alias("label"))


@plan("reg_linear_coefficients", rnd=("slope", "intercept"), sql=f"""
SELECT regr_slope(y_lin, l_quantity) AS slope, regr_intercept(y_lin, l_quantity) AS intercept
FROM ({X.LINEITEM_SQL})""")
def q_reg_linear_coefficients(spark, d):
    m = MD.fit_model(_one_feature(spark, d), "regression", "reg_linear").model
    return spark.createDataFrame([(float(m.coefficients[0]), float(m.intercept))],
                                 "slope double, intercept double")


@plan("reg_ridge_coefficients", rnd=("slope", "intercept"), sql=f"""
SELECT sxy / (sxx + 1.0) AS slope, my - sxy / (sxx + 1.0) * mx AS intercept FROM (
  SELECT covar_pop(y_lin, l_quantity) * count(*) AS sxy, var_pop(l_quantity) * count(*) AS sxx,
         avg(y_lin) AS my, avg(l_quantity) AS mx FROM ({X.LINEITEM_SQL}))""")
def q_reg_ridge_coefficients(spark, d):
    m = MD.fit_model(_one_feature(spark, d), "regression", "reg_ridge", {"alpha": 1.0}).model
    return spark.createDataFrame([(float(m.coefficients[0]), float(m.intercept))],
                                 "slope double, intercept double")


NB_FEATS = ["l_quantity", "l_discount", "l_tax"]


@plan("clf_gaussian_nb_params", rnd=("mean", "variance", "prior"), digits=5, sql=" UNION ALL ".join(
    f"""SELECT cast(l_linenumber - 1 as double) AS label, {i} AS feature, avg({c}) AS mean,
        var_pop({c}) AS variance, count(*) / (SELECT count(*) FROM lineitem) AS prior
        FROM lineitem GROUP BY l_linenumber""" for i, c in enumerate(NB_FEATS)))
def q_clf_gaussian_nb_params(spark, d):
    import math
    from pyspark.ml.functions import array_to_vector
    li = X.table(spark, d, "lineitem").select(
        array_to_vector(F.array(*NB_FEATS)).alias("features"),
        (F.col("l_linenumber") - 1).cast("double").alias("label"))
    m = MD.fit_model(li, "classification", "clf_gaussian_nb").model
    theta, sigma, pi = m.theta.toArray(), m.sigma.toArray(), m.pi.toArray()
    rows = [(float(c), j, float(theta[c, j]), float(sigma[c, j]), math.exp(float(pi[c])))
            for c in range(theta.shape[0]) for j in range(theta.shape[1])]
    return spark.createDataFrame(rows, "label double, feature int, mean double, variance double, "
                                       "prior double")


EMB_SPLIT = """(SELECT vec_id, embedding::DOUBLE[] AS v, label,
  row_number() OVER (ORDER BY md5(concat_ws(':', '42', vec_id)), vec_id)
    <= ceil((SELECT count(*) FROM embeddings) * 0.2) AS is_test FROM embeddings)"""


@plan("clf_knn_votes", sql=f"""
WITH s AS {EMB_SPLIT},
nb AS (SELECT * FROM (
  SELECT a.vec_id, b.label AS nl, row_number() OVER (PARTITION BY a.vec_id
         ORDER BY list_distance(a.v, b.v), b.vec_id) AS rk
  FROM s a JOIN s b ON a.is_test AND NOT b.is_test) WHERE rk <= 5),
votes AS (SELECT vec_id, nl, count(*) AS n FROM nb GROUP BY vec_id, nl)
SELECT vec_id, cast(arg_max(nl, n * 1000 - nl) as double) AS prediction FROM votes GROUP BY vec_id""")
def q_clf_knn_votes(spark, d):
    from autotab.operators import split as S
    e = X.table(spark, d, "embeddings").select(
        "vec_id", F.col("embedding").cast("array<double>").alias("features"),
        F.col("label").cast("double").alias("label"))
    sp = S.split_random(e, ["vec_id"], 0.2, 42)
    train = sp.filter(F.col("split") == "train").drop("split")
    test = sp.filter(F.col("split") == "test").drop("split")
    m = MD.fit_model(train, "classification", "clf_knn", {"k": 5, "ids": ["vec_id"]})
    return MD.score(m, test, ["vec_id"]).select("vec_id", "prediction")


# ------------------------------------------------- the first boosted tree
def _level_sql(rows: str, stats: str, nodes: str, parents: str) -> str:
    """CTEs that cut every node of ``parents`` (node, g, h): sums per (node, feature, value) of ``rows`` (node, x0, x1, g),
    running sums up to each value, the largest gain (ties: first feature, lowest cut)."""
    return f"""
{stats} AS (
  SELECT node, f, x, sum(sum(g)) OVER w AS gl, sum(count(*)) OVER w AS hl
  FROM (SELECT node, 0 AS f, x0 AS x, g FROM {rows} UNION ALL SELECT node, 1, x1, g FROM {rows})
  GROUP BY node, f, x WINDOW w AS (PARTITION BY node, f ORDER BY x)),
{nodes} AS (
  SELECT * FROM (
    SELECT s.*, p.g - gl AS gr, p.h - hl AS hr, (gl * gl / (hl + 1) + (p.g - gl) * (p.g - gl) / (p.h - hl + 1) - p.g * p.g / (p.h + 1)) / 2 AS gain,
      row_number() OVER (PARTITION BY s.node ORDER BY round((gl * gl / (hl + 1) + (p.g - gl) * (p.g - gl) / (p.h - hl + 1)) / 2, 6) DESC, f, x) AS nth
    FROM {stats} s JOIN {parents} p USING (node) WHERE p.h > hl) AS t WHERE nth = 1 AND gain > 1e-12)"""


@plan("boosting_first_tree", rnd=("gain", "value"), digits=4, sql=f"""
WITH li AS (SELECT l_quantity AS x0, l_discount AS x1, y_lin AS y FROM ({X.LINEITEM_SQL})),
r0 AS (SELECT 0 AS node, x0, x1, (SELECT avg(y) FROM li) - y AS g FROM li),
p0 AS (SELECT 0 AS node, sum(g) AS g, count(*) AS h FROM r0),{_level_sql("r0", "s0", "n0", "p0")},
r1 AS (SELECT CASE WHEN CASE n0.f WHEN 0 THEN x0 ELSE x1 END <= n0.x THEN 1 ELSE 2 END AS node, x0, x1, g FROM r0, n0),
p1 AS (SELECT node, sum(g) AS g, count(*) AS h FROM r1 GROUP BY node),{_level_sql("r1", "s1", "n1", "p1")},
leaves AS (
  SELECT 2 * node + 1 AS node, gl AS g, hl AS h FROM n1 UNION ALL SELECT 2 * node + 2, gr, hr FROM n1)
SELECT t.node, coalesce(n.f, -1) AS feature, n.x AS cut, coalesce(n.gain, 0) AS gain, -t.g / (t.h + 1) AS value, CAST(t.h AS BIGINT) AS n_rows
FROM (SELECT * FROM p0 UNION ALL SELECT * FROM p1 UNION ALL SELECT * FROM leaves) t
LEFT JOIN (SELECT node, f, x, gain FROM n0 UNION ALL SELECT node, f, x, gain FROM n1) n ON n.node = t.node""")
def q_boosting_first_tree(spark, d):
    """Splits, gains and leaf values of the first tree (two levels, lambda 1, learning rate 1)."""
    from autotab.operators import boosting
    li = X.lineitem(spark, d).select(F.array("l_quantity", "l_discount").alias("features"), F.col("y_lin").alias("label"))
    m = boosting.fit(li, "squared", maxIter=1, maxDepth=2, stepSize=1.0, lam=1.0, least_hessian=0.0)
    return spark.createDataFrame(m.table(), "node int, feature int, cut double, gain double, value double, n_rows long")
