"""Insight, calibration and scalar-function queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from autotab.functions import scalars as SC
from autotab.operators import insight as I
from autotab.plans import fixtures as X
from autotab.plans.profile_plans import LI
from autotab.plans.registry import plan

INS_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
EV = f"({X.EVENTS_SQL})"
ES = f"({X.ESTIMATES_SQL})"


@plan("nonzero_share", rnd=("nonzero_share",), sql=f"""
SELECT nz / (n * 4.0) AS nonzero_share, nz / (n * 4.0) < 0.2 AS sparse FROM (
  SELECT cast({' + '.join(f'count_if(coalesce({c} <> 0, true))' for c in INS_COLS)} as double) AS nz,
         count(*) AS n FROM lineitem)""")
def q_nonzero_share(spark, d):
    return I.nonzero_share(X.table(spark, d, "lineitem"), INS_COLS)


@plan("max_abs_feature", rnd=("max_abs",), sql=f"""
SELECT greatest({', '.join(f'max(abs({c}))' for c in INS_COLS)}) AS max_abs,
       greatest({', '.join(f'max(abs({c}))' for c in INS_COLS)}) > 1000 AS wide_ranges FROM lineitem""")
def q_max_abs_feature(spark, d):
    return I.max_abs_feature(X.table(spark, d, "lineitem"), INS_COLS)


KURT_COLS = ["value", "spiked", "user_id"]


@plan("mean_kurtosis", rnd=("mean_kurtosis",), digits=4, sql=f"""
SELECT avg(k) AS mean_kurtosis, avg(k) > 3 AS outliers FROM (
  {' UNION ALL '.join(f'SELECT kurtosis_pop({c}) AS k FROM {EV}' for c in KURT_COLS)})""")
def q_mean_kurtosis(spark, d):
    return I.mean_kurtosis(X.events(spark, d), KURT_COLS)


def _mi_sql(cols, target, source):
    parts = []
    for c in cols:
        q = f"(SELECT list_distinct(quantile_cont(cast({c} as double), [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])) FROM {source})"
        b = f"len(list_filter({q}, lambda e: e < {c}))"
        parts.append(f"""
SELECT '{c}' AS feature, sum(nxy / n * ln(nxy * n / (nx * ny))) AS mi FROM (
  SELECT nxy, sum(nxy) OVER (PARTITION BY b) AS nx, sum(nxy) OVER (PARTITION BY y) AS ny,
         sum(nxy) OVER () AS n
  FROM (SELECT {b} AS b, cast({target} as varchar) AS y, cast(count(*) as double) AS nxy
        FROM {source} GROUP BY 1, 2))""")
    return " UNION ALL ".join(parts)


@plan("mutual_information", rnd=("mi",), sql=_mi_sql(INS_COLS, "big_order", LI))
def q_mutual_information(spark, d):
    return I.mutual_information(X.lineitem(spark, d), "big_order", INS_COLS)


def _near_sql(cols, target, source, k=3):
    """Nearest-neighbour information by row-wise windows; psi(n) as a harmonic number less Euler's constant
    (the constant cancels: two psi are added and two taken)."""
    beside = ", ".join(f"abs(x - {f}(x, {o}) OVER c)" for f in ("lag", "lead") for o in range(1, k + 1))
    one = [f"""
SELECT '{c}' AS feature, greatest(0, any_value(hn.h) + avg(ha.h - hs.h - hb.h)) AS mi FROM (
  SELECT size, n, count(*) OVER (PARTITION BY y ORDER BY x RANGE BETWEEN q PRECEDING AND q FOLLOWING) AS inside,
         count(*) OVER (ORDER BY x RANGE BETWEEN q PRECEDING AND q FOLLOWING) AS everyone FROM (
    SELECT *, list_sort(list_filter(d, lambda v: v IS NOT NULL))[least({k}, size - 1)] * (1 - 1e-6) AS q, count(*) OVER () AS n FROM (
      SELECT x, y, count(*) OVER (PARTITION BY y) AS size, [{beside}] AS d
      FROM (SELECT cast({c} as double) AS x, cast({target} as varchar) AS y FROM {source} WHERE {c} IS NOT NULL AND {target} IS NOT NULL)
      WINDOW c AS (PARTITION BY y ORDER BY x)) WHERE size > 1))
JOIN h hn ON hn.i = n JOIN h ha ON ha.i = inside JOIN h hs ON hs.i = size JOIN h hb ON hb.i = everyone""" for c in cols]
    return f"""
WITH h AS (SELECT i, coalesce(sum(1.0::DOUBLE / (i - 1)) FILTER (i > 1) OVER (ORDER BY i), 0) AS h
           FROM (SELECT unnest(range(1, (SELECT count(*) + 2 FROM {source}))) AS i))
""" + " UNION ALL ".join(one)


@plan("neighbour_information", rnd=("mi",), sql=_near_sql(INS_COLS, "big_order", LI))
def q_neighbour_information(spark, d):
    return I.neighbour_information(X.lineitem(spark, d), "big_order", INS_COLS)


#: The texts that the rules must give, written out here apart from the code under test.
SPARSE_TEXT = "High Sparsity (", "): Linear models or Sparse-friendly ensembles recommended."
WIDE_TEXT = "Wide feature ranges detected: Scaling is critical (StandardScaler applied)."
COMPACT_TEXT = "Low Kurtosis: Data is relatively compact, but subtle local outliers may still exist."
NONLINEAR_TEXT = "Strong Non-linear patterns detected: Tree-based models (XGBoost, RF) will likely outperform linear models."
HIGH_TEXT = ("High Kurtosis (", ") detected: Significant outlier potential identified. Robust "
             "models like Isolation Forest recommended.")
LINEAR_TEXT = "Data exhibits potential linear trends: Regularized Linear models may generalize better."


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _rules_sql(cols, source):
    """The sparsity and range rules over ``cols`` as rows, and what they read."""
    share = (f"(SELECT cast({' + '.join(f'count_if(coalesce({c} <> 0, true))' for c in cols)} as double) "
             f"/ (count(*) * {len(cols)}.0) FROM {source})")
    top = f"(SELECT greatest({', '.join(f'max(abs({c}))::DOUBLE' for c in cols)}) FROM {source})"
    sparse = SPARSE_TEXT
    return f"""
SELECT 'sparsity' AS rule, v < 0.2 AS fired, v AS value,
  CASE WHEN v < 0.2 THEN {_quoted(sparse[0])} || printf('%.1f%%', v * 100) || {_quoted(sparse[1])} END AS message
FROM (SELECT {share} AS v)
UNION ALL SELECT 'wide_ranges', v > 1000, v, CASE WHEN v > 1000 THEN {_quoted(WIDE_TEXT)} END FROM (SELECT {top} AS v)"""


def _kurtosis_sql():
    high = HIGH_TEXT
    return f"""
SELECT 'kurtosis', k > 3, k, CASE WHEN k > 3 THEN {_quoted(high[0])} || printf('%.1f', k) || {_quoted(high[1])}
  ELSE {_quoted(COMPACT_TEXT)} END
FROM (SELECT avg(k) AS k FROM ({' UNION ALL '.join(f'SELECT kurtosis_pop({c}) AS k FROM {EV}' for c in KURT_COLS)}))"""


def _nonlinear_sql():
    return f"""
SELECT 'nonlinearity', m > 0.15, m, CASE WHEN m > 0.15 THEN {_quoted(NONLINEAR_TEXT)} ELSE {_quoted(LINEAR_TEXT)} END
FROM (SELECT avg(mi) AS m FROM ({_near_sql(INS_COLS, "big_order", LI)}))"""


@plan("dataset_insights", rnd=("value",), digits=4,
      sql=_rules_sql(KURT_COLS, EV) + " UNION ALL " + _kurtosis_sql())
def q_dataset_insights(spark, d):
    return I.dataset_insights(X.events(spark, d), KURT_COLS, None, "anomaly_detection")


@plan("dataset_insights_supervised", rnd=("value",), digits=4,
      sql=_rules_sql(INS_COLS, LI) + " UNION ALL " + _nonlinear_sql())
def q_dataset_insights_supervised(spark, d):
    return I.dataset_insights(X.lineitem(spark, d), INS_COLS, "big_order", "classification")


PARSE_SQL = """
CASE WHEN estimate IS NULL THEN 0.5
     WHEN contains(estimate, '-') THEN
       CASE WHEN TRY_CAST(string_split(replace(estimate, '%', ''), '-')[1] AS DOUBLE) IS NULL
              OR TRY_CAST(string_split(replace(estimate, '%', ''), '-')[2] AS DOUBLE) IS NULL THEN 0.5
            ELSE (TRY_CAST(string_split(replace(estimate, '%', ''), '-')[1] AS DOUBLE)
                  + TRY_CAST(string_split(replace(estimate, '%', ''), '-')[2] AS DOUBLE))
                 / CASE WHEN contains(estimate, '%') THEN 200.0 ELSE 2.0 END END
     WHEN contains(estimate, '%') THEN coalesce(TRY_CAST(replace(estimate, '%', '') AS DOUBLE) / 100.0, 0.5)
     ELSE coalesce(TRY_CAST(estimate AS DOUBLE), 0.5) END"""


@plan("parse_estimate", rnd=("value",), sql=f"SELECT event_id, estimate, {PARSE_SQL} AS value FROM {ES}")
def q_parse_estimate(spark, d):
    e = X.estimates(spark, d)
    return e.select("event_id", "estimate", SC.parse_estimate("estimate").alias("value"))


FACTOR_SQL = ("CASE task_type WHEN 'classification' THEN 0.85 WHEN 'regression' THEN 0.90 "
              "WHEN 'clustering' THEN 0.80 WHEN 'dimensionality_reduction' THEN 0.85 "
              "WHEN 'anomaly_detection' THEN 0.75 ELSE 0.85 END")


@plan("calibrate_estimate", rnd=("calibrated",), sql=f"""
SELECT event_id, CASE WHEN actual IS NOT NULL AND abs(c - actual) > 0.15 THEN actual ELSE c END
  AS calibrated FROM (SELECT event_id, actual, ({PARSE_SQL}) * {FACTOR_SQL} AS c FROM {ES})""")
def q_calibrate_estimate(spark, d):
    e = X.estimates(spark, d)
    return I.calibrate_estimate(e, "estimate", "task_type", "actual").select("event_id", "calibrated")


CH = f"({X.CAL_HISTORY_SQL})"


@plan("calibration_history", rnd=("estimated", "actual", "ratio"), sql=f"""
SELECT task_type, seq, estimated, actual, actual / estimated AS ratio FROM {CH} WHERE estimated > 0""")
def q_calibration_history(spark, d):
    return I.calibration_history(X.cal_history(spark, d))


@plan("calibration_factors", rnd=("factor",), sql=f"""
SELECT task_type, count(*) AS n_obs,
  pow(0.7, count(*)) * {FACTOR_SQL.replace('task_type', 'any_value(task_type)')}
  + sum(0.3 * pow(0.7, m - i) * r) AS factor
FROM (SELECT task_type, least(greatest(actual / estimated, 0.5), 1.5) AS r,
             row_number() OVER (PARTITION BY task_type ORDER BY seq) AS i,
             count(*) OVER (PARTITION BY task_type) AS m
      FROM {CH} WHERE estimated > 0) GROUP BY task_type""")
def q_calibration_factors(spark, d):
    return I.calibration_factors(X.cal_history(spark, d))


BAND_SQL = """
CASE WHEN contains(estimate, '%') AND TRY_CAST(trim(replace(estimate, '%', '')) AS DOUBLE) IS NOT NULL THEN
       concat(cast(greatest(0, trunc(TRY_CAST(trim(replace(estimate, '%', '')) AS DOUBLE) / 100.0 * 100) - 4) as bigint), '-',
              cast(least(100, trunc(TRY_CAST(trim(replace(estimate, '%', '')) AS DOUBLE) / 100.0 * 100) + 4) as bigint), '%')
     WHEN contains(estimate, '%') THEN estimate
     WHEN contains(estimate, '-') THEN estimate
     WHEN TRY_CAST(trim(estimate) AS DOUBLE) IS NOT NULL THEN
       concat(cast(greatest(0, trunc(TRY_CAST(trim(estimate) AS DOUBLE) * 100) - 4) as bigint), '-',
              cast(least(100, trunc(TRY_CAST(trim(estimate) AS DOUBLE) * 100) + 4) as bigint), '%')
     ELSE estimate END"""


@plan("format_band", sql=f"SELECT event_id, {BAND_SQL} AS band FROM {ES}")
def q_format_band(spark, d):
    return X.estimates(spark, d).select("event_id", SC.format_band("estimate").alias("band"))


@plan("format_metric", sql=f"""
SELECT event_id, CASE task_type WHEN 'classification' THEN b WHEN 'regression' THEN 'R²: ' || b
  WHEN 'clustering' THEN 'Silhouette: ' || b WHEN 'dimensionality_reduction' THEN 'Variance: ' || b
  WHEN 'anomaly_detection' THEN 'Precision: ' || b ELSE 'N/A' END AS metric_text
FROM (SELECT event_id, task_type, {BAND_SQL} AS b FROM {ES})""")
def q_format_metric(spark, d):
    return X.estimates(spark, d).select("event_id", SC.format_metric("estimate", "task_type")
                                        .alias("metric_text"))


@plan("format_calibrated", sql=f"""
SELECT event_id, CASE WHEN task_type = 'classification' THEN
    concat(cast(greatest(50, trunc((c - 0.05) * 100)) as bigint), '-',
           cast(least(95, trunc((c + 0.05) * 100)) as bigint), '%')
  WHEN task_type = 'regression' THEN
    concat(printf('%.2f', greatest(0.1, c - 0.1)), '-', printf('%.2f', least(0.95, c + 0.1))) END
  AS calibrated_text
FROM (SELECT event_id, task_type, ({PARSE_SQL}) * {FACTOR_SQL} AS c FROM {ES})""")
def q_format_calibrated(spark, d):
    e = I.calibrate_estimate(X.estimates(spark, d), "estimate", "task_type")
    return e.select("event_id", SC.format_calibrated("calibrated", "task_type").alias("calibrated_text"))


@plan("truncate_reason", sql="""
SELECT doc_id, CASE WHEN length(text) > 100 THEN concat(substring(text, 1, 100), '...') ELSE text END
  AS reason FROM documents""")
def q_truncate_reason(spark, d):
    return X.table(spark, d, "documents").select("doc_id", SC.truncate_reason("text").alias("reason"))


@plan("quality_band", sql="""
SELECT event_id, CASE WHEN event_id % 101 >= 70 THEN 'High Quality' WHEN event_id % 101 >= 50
  THEN 'Standard' ELSE 'Action Required' END AS band FROM events""")
def q_quality_band(spark, d):
    e = X.table(spark, d, "events")
    return e.select("event_id", SC.quality_band(F.col("event_id") % 101).alias("band"))


@plan("file_extension", sql="""
SELECT page_id, lower(split_part(url, '.', -1)) AS extension FROM pages""")
def q_file_extension(spark, d):
    return X.table(spark, d, "pages").select("page_id", SC.file_extension("url").alias("extension"))
