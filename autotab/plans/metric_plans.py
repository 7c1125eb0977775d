"""Evaluation queries on planted scored tables, with oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from autotab.operators import metrics as M
from autotab.operators import split as S
from autotab.plans import fixtures as X
from autotab.plans.registry import plan

SB = f"({X.SCORED_BINARY_SQL})"
SM = f"({X.SCORED_MULTI_SQL})"
SR = f"({X.SCORED_REGRESSION_SQL})"


@plan("metric_accuracy", rnd=("accuracy",), sql=f"""
SELECT avg(CASE WHEN label = prediction THEN 1.0 ELSE 0.0 END) AS accuracy FROM {SB}""")
def q_metric_accuracy(spark, d):
    return M.metric_accuracy(X.scored_binary(spark, d))


PRF_SQL = f"""
WITH cls AS (SELECT label AS c FROM {SM} UNION SELECT prediction FROM {SM}),
per AS (
  SELECT c,
    (SELECT count(*) FROM {SM} s WHERE s.label = c) AS support,
    (SELECT count(*) FROM {SM} s WHERE s.prediction = c) AS npred,
    (SELECT count(*) FROM {SM} s WHERE s.label = c AND s.prediction = c) AS tp FROM cls),
m AS (SELECT support,
    CASE WHEN npred > 0 THEN tp / npred ELSE 0 END AS p,
    CASE WHEN support > 0 THEN tp / support ELSE 0 END AS r FROM per)
SELECT sum(p * support) / sum(support) AS precision_weighted,
       sum(r * support) / sum(support) AS recall_weighted,
       sum(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END * support) / sum(support)
         AS f1_weighted FROM m"""


@plan("metric_prf_weighted", rnd=("precision_weighted", "recall_weighted", "f1_weighted"),
      sql=PRF_SQL)
def q_metric_prf_weighted(spark, d):
    return M.metric_prf_weighted(X.scored_multi(spark, d))


@plan("confusion_matrix", sql=f"""
WITH cls AS (SELECT label AS c FROM {SM} UNION SELECT prediction FROM {SM})
SELECT a.c AS actual, p.c AS predicted,
  (SELECT count(*) FROM {SM} s WHERE s.label = a.c AND s.prediction = p.c) AS n
FROM cls a, cls p""")
def q_confusion_matrix(spark, d):
    return M.confusion_matrix(X.scored_multi(spark, d))


def _rank_auc_sql(source: str) -> str:
    return f"""
SELECT (sum(CASE WHEN y = 1 THEN r END) - cast(count_if(y = 1) as double) * (count_if(y = 1) + 1) / 2)
       / (cast(count_if(y = 1) as double) * count_if(y = 0)) AS roc_auc
FROM (SELECT y, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0 AS r
      FROM {source})"""


@plan("roc_auc_binary", rnd=("roc_auc",), sql=_rank_auc_sql(
    f"(SELECT label AS y, score AS s FROM {SB})"))
def q_roc_auc_binary(spark, d):
    return M.roc_auc_binary(X.scored_binary(spark, d))


@plan("roc_auc_ovr", rnd=("roc_auc_ovr",), sql=f"""
SELECT avg(roc_auc) AS roc_auc_ovr FROM (
  {_rank_auc_sql(f"(SELECT CASE WHEN label = 0 THEN 1 ELSE 0 END AS y, probability[1] AS s FROM {SM})")}
  UNION ALL
  {_rank_auc_sql(f"(SELECT CASE WHEN label = 1 THEN 1 ELSE 0 END AS y, probability[2] AS s FROM {SM})")}
  UNION ALL
  {_rank_auc_sql(f"(SELECT CASE WHEN label = 2 THEN 1 ELSE 0 END AS y, probability[3] AS s FROM {SM})")})""")
def q_roc_auc_ovr(spark, d):
    return M.roc_auc_ovr(X.scored_multi(spark, d))


def _curve_sql(source: str, curve: str) -> str:
    return f"""
SELECT {curve} AS curve, 0.0 AS fpr, 0.0 AS tpr, CAST(NULL AS DOUBLE) AS threshold
UNION ALL
SELECT {curve}, sum(neg) OVER (ORDER BY s DESC) / (SELECT count_if(y = 0) FROM {source}),
       sum(pos) OVER (ORDER BY s DESC) / (SELECT count_if(y = 1) FROM {source}), s
FROM (SELECT s, count_if(y = 1) AS pos, count_if(y = 0) AS neg FROM {source} GROUP BY s)"""


CURVE_B = _curve_sql(f"(SELECT label AS y, score AS s FROM {SB})", "1")


@plan("roc_curve", rnd=("fpr", "tpr", "threshold"), sql=CURVE_B)
def q_roc_curve(spark, d):
    return M.roc_curve(X.scored_binary(spark, d))


MICRO_SRC = (f"(SELECT CASE WHEN label = cast(k - 1 as double) THEN 1 ELSE 0 END AS y, probability[k] AS s "
             f"FROM {SM}, range(1, 4) t(k))")


@plan("roc_curve_micro", rnd=("fpr", "tpr", "threshold"), sql=_curve_sql(MICRO_SRC, "-1"))
def q_roc_curve_micro(spark, d):
    return M.roc_curve(X.scored_multi(spark, d), prob="probability", average="micro")


CLASS_CURVES = " UNION ALL ".join("(" + _curve_sql(
    f"(SELECT CASE WHEN label = {k}.0 THEN 1 ELSE 0 END AS y, probability[{k + 1}] AS s FROM {SM})", str(k)) + ")"
    for k in range(3))


@plan("roc_curve_classes", rnd=("fpr", "tpr", "threshold"), sql=CLASS_CURVES)
def q_roc_curve_classes(spark, d):
    return M.roc_curve(X.scored_multi(spark, d), prob="probability")


@plan("auc_trapezoid", rnd=("auc",), sql=f"""
SELECT curve, sum((fpr - px) * (tpr + py) / 2) AS auc FROM (
  SELECT curve, fpr, tpr, lag(fpr) OVER (ORDER BY threshold DESC NULLS FIRST) AS px,
         lag(tpr) OVER (ORDER BY threshold DESC NULLS FIRST) AS py FROM ({CURVE_B}))
WHERE px IS NOT NULL GROUP BY curve""")
def q_auc_trapezoid(spark, d):
    return M.auc_trapezoid(M.roc_curve(X.scored_binary(spark, d)))


@plan("metric_regression", rnd=("r2", "mse", "rmse", "mae", "explained_variance"), sql=f"""
SELECT 1 - sum((label - prediction) ^ 2) / (var_pop(label) * count(*)) AS r2,
       avg((label - prediction) ^ 2) AS mse, sqrt(avg((label - prediction) ^ 2)) AS rmse,
       avg(abs(label - prediction)) AS mae,
       1 - var_pop(label - prediction) / var_pop(label) AS explained_variance FROM {SR}""")
def q_metric_regression(spark, d):
    return M.metric_regression(X.scored_regression(spark, d))


@plan("actual_vs_predicted", rnd=("actual", "predicted", "diag_lo", "diag_hi"), sql=f"""
SELECT row_id, label AS actual, prediction AS predicted,
  (SELECT least(min(label), min(prediction)) FROM {SR}) AS diag_lo,
  (SELECT greatest(max(label), max(prediction)) FROM {SR}) AS diag_hi FROM {SR}""")
def q_actual_vs_predicted(spark, d):
    return M.actual_vs_predicted(X.scored_regression(spark, d), ["row_id"])


@plan("cv_summary", rnd=("cv_mean", "cv_std"), sql=f"""
SELECT avg(acc) AS cv_mean, stddev_pop(acc) AS cv_std, count(*) AS n_folds FROM (
  SELECT fold, avg(CASE WHEN label = prediction THEN 1.0 ELSE 0.0 END) AS acc FROM (
    SELECT label, prediction,
      (row_number() OVER (ORDER BY md5(concat_ws(':', '42', row_id)), row_id) - 1) % 5 AS fold
    FROM {SB}) GROUP BY fold)""")
def q_cv_summary(spark, d):
    folds = S.kfold(X.scored_binary(spark, d), ["row_id"], 5, 42)
    per_fold = folds.groupBy("fold").agg(
        F.avg((F.col("label") == F.col("prediction")).cast("double")).alias("score"))
    return M.cv_summary(per_fold, [])


@plan("evaluate", rnd=("value",), sql=f"""
SELECT * FROM (
  SELECT 'accuracy' AS metric, avg(CASE WHEN label = prediction THEN 1.0 ELSE 0.0 END) AS value
  FROM {SM}
  UNION ALL SELECT 'precision_weighted', precision_weighted FROM ({PRF_SQL})
  UNION ALL SELECT 'recall_weighted', recall_weighted FROM ({PRF_SQL})
  UNION ALL SELECT 'f1_weighted', f1_weighted FROM ({PRF_SQL}))""")
def q_evaluate(spark, d):
    return M.evaluate(X.scored_multi(spark, d), "classification", prob=None)


@plan("report", rnd=("value",), sql=f"""
WITH cls AS (SELECT label AS c FROM {SM} UNION SELECT prediction FROM {SM}),
ev AS (SELECT 'accuracy' AS item, avg(CASE WHEN label = prediction THEN 1.0 ELSE 0.0 END) AS value FROM {SM}
  UNION ALL SELECT 'precision_weighted', precision_weighted FROM ({PRF_SQL})
  UNION ALL SELECT 'recall_weighted', recall_weighted FROM ({PRF_SQL})
  UNION ALL SELECT 'f1_weighted', f1_weighted FROM ({PRF_SQL}))
SELECT 'metric' AS section, item, value FROM ev
UNION ALL SELECT 'confusion', cast(cast(a.c as integer) as varchar) || ':' || cast(cast(p.c as integer) as varchar),
  (SELECT count(*) FROM {SM} s WHERE s.label = a.c AND s.prediction = p.c) FROM cls a, cls p
UNION ALL SELECT 'cv', 'cv_mean', 0.75 UNION ALL SELECT 'cv', 'cv_std', 0.05""")
def q_report(spark, d):
    """The whole report of one scored table with its fold scores."""
    folds = spark.createDataFrame([(0, 0.7), (1, 0.8)], "fold int, score double")
    return M.report(X.scored_multi(spark, d), "classification", prob=None, cv=folds)
