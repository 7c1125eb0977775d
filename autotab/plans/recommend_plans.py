"""Reply-reading queries: parse, summary, rank, compare."""

from __future__ import annotations

from pyspark.sql import functions as F

from autotab.operators import recommend as RC
from autotab.plans import fixtures as X
from autotab.plans.insight_plans import FACTOR_SQL
from autotab.plans.registry import plan

RP = f"({X.REPLIES_SQL})"


def _parse_sql_of(col):
    return f"""
CASE WHEN {col} IS NULL THEN 0.5
     WHEN contains({col}, '-') THEN
       CASE WHEN TRY_CAST(string_split(replace({col}, '%', ''), '-')[1] AS DOUBLE) IS NULL
              OR TRY_CAST(string_split(replace({col}, '%', ''), '-')[2] AS DOUBLE) IS NULL THEN 0.5
            ELSE (TRY_CAST(string_split(replace({col}, '%', ''), '-')[1] AS DOUBLE)
                  + TRY_CAST(string_split(replace({col}, '%', ''), '-')[2] AS DOUBLE))
                 / CASE WHEN contains({col}, '%') THEN 200.0 ELSE 2.0 END END
     WHEN contains({col}, '%') THEN coalesce(TRY_CAST(replace({col}, '%', '') AS DOUBLE) / 100.0, 0.5)
     ELSE coalesce(TRY_CAST({col} AS DOUBLE), 0.5) END"""


#: The fallback rows, written out for the oracle apart from the code under test.
FB_VALUES = """
('classification', 0, 'Random Forest', '65-75%', 'Good for most classification tasks'),
('classification', 1, 'XGBoost', '70-80%', 'Excellent for complex patterns'),
('classification', 2, 'Logistic Regression', '60-70%', 'Good baseline model'),
('regression', 0, 'Random Forest', '0.60-0.75', 'Robust for regression problems'),
('regression', 1, 'XGBoost', '0.65-0.80', 'High accuracy with complex data'),
('regression', 2, 'Linear Regression', '0.50-0.65', 'Simple baseline model'),
('clustering', 0, 'K-Means', '0.3-0.5', 'Good for spherical clusters'),
('clustering', 1, 'DBSCAN', '0.2-0.4', 'Finds arbitrary shaped clusters'),
('dimensionality_reduction', 0, 'PCA', '60-75%', 'Standard linear reduction'),
('dimensionality_reduction', 1, 'UMAP', '65-80%', 'Good for visualization'),
('anomaly_detection', 0, 'Isolation Forest', '75-85%', 'Effective for high dimensions'),
('anomaly_detection', 1, 'Local Outlier Factor', '70-80%', 'Good for varying densities')"""

PARSE_SQL = f"""
WITH r AS {RP},
j AS (SELECT reply_id, regexp_extract(reply, '\\{{.*\\}}', 0, 's') AS js FROM r),
good AS (SELECT reply_id, json_extract(js, '$.algorithm_recommendations') AS recs
         FROM j WHERE js <> '' AND json_valid(js)),
t AS (SELECT reply_id, recs, unnest(json_keys(recs)) AS task FROM good),
a AS (SELECT reply_id, task, json_extract(recs, '$."' || task || '"') AS arr FROM t),
e AS (SELECT reply_id, task, arr, unnest(range(CAST(json_array_length(arr) AS BIGINT))) AS pos FROM a),
items AS (SELECT reply_id, task, CAST(pos AS INTEGER) AS position,
                 json_extract(arr, '$[' || pos || ']') AS it FROM e),
parsed AS (SELECT reply_id, task, position, it->>'algorithm' AS algorithm,
  CASE task WHEN 'classification' THEN coalesce(it->>'estimated_accuracy', '60%')
            WHEN 'regression' THEN coalesce(it->>'estimated_r2', '0.5')
            WHEN 'clustering' THEN it->>'estimated_silhouette'
            WHEN 'dimensionality_reduction' THEN it->>'estimated_variance'
            WHEN 'anomaly_detection' THEN it->>'estimated_precision' END AS estimate,
  it->>'reason' AS reason, false AS fallback, true AS cal FROM items),
fb(task, position, algorithm, estimate, reason) AS (VALUES {FB_VALUES}),
bad AS (SELECT reply_id, js = '' AS cal FROM j WHERE js = '' OR NOT json_valid(js)),
fall AS (SELECT reply_id, task, CAST(position AS INTEGER) AS position, algorithm, estimate, reason,
                true AS fallback, cal FROM bad, fb),
rows_ AS (SELECT * FROM parsed UNION ALL SELECT * FROM fall),
c AS (SELECT *, CASE WHEN cal AND task IN ('classification', 'regression')
                     THEN ({_parse_sql_of('estimate')}) * {FACTOR_SQL.replace('task_type', 'task')} END
                AS calibrated FROM rows_)
SELECT reply_id, task, position, algorithm, estimate, reason, fallback, calibrated,
  CASE WHEN task = 'classification' THEN
    concat(cast(greatest(50, trunc((calibrated - 0.05) * 100)) as bigint), '-',
           cast(least(95, trunc((calibrated + 0.05) * 100)) as bigint), '%')
  WHEN task = 'regression' THEN
    concat(printf('%.2f', greatest(0.1, calibrated - 0.1)), '-', printf('%.2f', least(0.95, calibrated + 0.1)))
  END AS calibrated_text
FROM c"""


@plan("parse_recommendations", rnd=("calibrated",), sql=PARSE_SQL)
def q_parse_recommendations(spark, d):
    return RC.parse_recommendations(X.replies(spark, d))


@plan("summary_section", sql=f"""
SELECT reply_id, CASE WHEN sec <> '' THEN
    CASE WHEN strpos(sec, chr(10) || '##') > 0 THEN left(sec, strpos(sec, chr(10) || '##') - 1) ELSE sec END
  ELSE '## Summary' || chr(10) || regexp_replace(split_part(reply, '}}', -1), '^\\s+|\\s+$', '', 'g') END
  AS summary
FROM (SELECT reply_id, reply, regexp_extract(reply, '(?is)## Summary.*', 0) AS sec FROM {RP})""")
def q_summary_section(spark, d):
    return RC.summary_section(X.replies(spark, d)).select("reply_id", "summary")


RANK_SQL = f"""
SELECT * FROM (
  SELECT reply_id, task, position, algorithm, calibrated,
    cast(row_number() OVER (PARTITION BY reply_id, task ORDER BY coalesce(calibrated, 0.5) DESC, position)
         as integer) AS rank
  FROM ({PARSE_SQL})) WHERE rank <= 5"""


@plan("rank_recommendations", rnd=("calibrated",), sql=RANK_SQL)
def q_rank_recommendations(spark, d):
    recs = RC.parse_recommendations(X.replies(spark, d))
    return RC.rank_recommendations(recs).select("reply_id", "task", "position", "algorithm",
                                                "calibrated", "rank")


@plan("actual_vs_estimate", rnd=("calibrated", "actual", "difference"), sql=f"""
SELECT b.reply_id, b.algorithm, b.calibrated, r.actual, r.actual - coalesce(b.calibrated, 0.5) AS difference,
       abs(r.actual - coalesce(b.calibrated, 0.5)) > 0.15 AS warning
FROM ({RANK_SQL}) b JOIN {RP} r USING (reply_id) WHERE b.rank = 1 AND b.task = 'classification'""")
def q_actual_vs_estimate(spark, d):
    rp = X.replies(spark, d)
    best = (RC.rank_recommendations(RC.parse_recommendations(rp), top=1)
            .filter(F.col("task") == "classification")
            .select("reply_id", "algorithm", "calibrated"))
    return RC.actual_vs_estimate(best.join(rp.select("reply_id", "actual"), "reply_id")).select(
        "reply_id", "algorithm", "calibrated", "actual", "difference", "warning")
