"""Driver tables plus the planted columns of FIXTURES.md.

Each planted column is written twice on purpose: once with the DataFrame API
(what the Spark queries run) and once as DuckDB SQL text (what the oracle
runs). Both follow the same written rule, so a mismatch points at an operator,
not at the fixture.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def u(id_col: Column, seed: int) -> Column:
    """Integer hash fraction in [0, 1): ((id*7919 + seed*104729) % 1009) / 1009."""
    return ((id_col * 7919 + seed * 104729) % 1009).cast("double") / F.lit(1009.0)


def u_sql(id_expr: str, seed: int) -> str:
    return (f"(cast(({id_expr} * 7919 + {seed} * 104729) % 1009 as double)"
            f" / cast(1009 as double))")


# ---------------------------------------------------------------- lineitem
LINEITEM_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


def lineitem_row_id() -> Column:
    return F.concat_ws(":", *[F.col(c).cast("string") for c in LINEITEM_KEY])


def lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    big = ((F.col("l_quantity") + 200 * F.col("l_discount")) > 35).cast("int")
    return li.withColumns({
        "row_id": lineitem_row_id(),
        "qty_null": F.when(F.col("l_orderkey") % 17 == 0, F.lit(None).cast("double"))
                     .otherwise(F.col("l_quantity")),
        "flag_null": F.when(F.col("l_partkey") % 13 == 0, F.lit(None).cast("string"))
                      .otherwise(F.col("l_returnflag")),
        "constant": F.lit(1),
        "rare_cat": F.when(F.col("l_orderkey") % 499 == 0, F.lit("rare")).otherwise(F.lit("common")),
        "big_order": big,
        "y_lin": 3 * F.col("l_quantity") - 40 * F.col("l_discount") + u(F.col("l_orderkey"), 1),
        "semi_label": F.when(F.col("l_orderkey") % 5 != 0, F.lit(None).cast("int")).otherwise(big),
    })


LINEITEM_SQL = f"""
SELECT *,
  concat_ws(':', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS row_id,
  CASE WHEN l_orderkey % 17 = 0 THEN NULL ELSE l_quantity END AS qty_null,
  CASE WHEN l_partkey % 13 = 0 THEN NULL ELSE l_returnflag END AS flag_null,
  1 AS constant,
  CASE WHEN l_orderkey % 499 = 0 THEN 'rare' ELSE 'common' END AS rare_cat,
  CASE WHEN l_quantity + 200 * l_discount > 35 THEN 1 ELSE 0 END AS big_order,
  3 * l_quantity - 40 * l_discount + {u_sql('l_orderkey', 1)} AS y_lin,
  CASE WHEN l_orderkey % 5 <> 0 THEN NULL
       ELSE CASE WHEN l_quantity + 200 * l_discount > 35 THEN 1 ELSE 0 END END AS semi_label
FROM lineitem"""


# -------------------------------------------------------------------- part
def part(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    c = F.col("p_partkey") % 3
    return p.withColumns({
        "band": F.when(F.col("p_size") <= 15, "S").when(F.col("p_size") <= 35, "M").otherwise("L"),
        "y_step": 10 * F.floor(F.col("p_size").cast("double") / 10) + u(F.col("p_partkey"), 2),
        "blob": c.cast("int"),
        "x": 10 * c + u(F.col("p_partkey"), 3),
        "y": -10 * c + u(F.col("p_partkey"), 4),
    })


PART_SQL = f"""
SELECT *,
  CASE WHEN p_size <= 15 THEN 'S' WHEN p_size <= 35 THEN 'M' ELSE 'L' END AS band,
  10 * floor(cast(p_size as double) / 10) + {u_sql('p_partkey', 2)} AS y_step,
  cast(p_partkey % 3 as integer) AS blob,
  10 * (p_partkey % 3) + {u_sql('p_partkey', 3)} AS x,
  -10 * (p_partkey % 3) + {u_sql('p_partkey', 4)} AS y
FROM part"""


# ------------------------------------------------------------------ events
def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    hit = F.col("event_id") % 97 == 0
    return e.withColumns({
        "spiked": F.when(hit, F.col("value") + 5000).otherwise(F.col("value")),
        "truth": hit.cast("int"),
    })


EVENTS_SQL = """
SELECT *,
  CASE WHEN event_id % 97 = 0 THEN value + 5000 ELSE value END AS spiked,
  CASE WHEN event_id % 97 = 0 THEN 1 ELSE 0 END AS truth
FROM events"""


TASK_NAMES = ["classification", "regression", "clustering", "dimensionality_reduction",
              "anomaly_detection"]


def cal_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calibration observations derived from every events row.

    task by event_id % 5, estimated 0.5 + u(id,5)/2, actual u(id,6), in
    event_id order.
    """
    e = table(spark, sf_dir, "events")
    names = F.array(*[F.lit(t) for t in TASK_NAMES])
    return e.select(
        F.element_at(names, (F.col("event_id") % 5 + 1).cast("int")).alias("task_type"),
        F.col("event_id").alias("seq"),
        (F.lit(0.5) + u(F.col("event_id"), 5) / 2).alias("estimated"),
        u(F.col("event_id"), 6).alias("actual"),
    )


CAL_HISTORY_SQL = f"""
SELECT (['{"','".join(TASK_NAMES)}'])[cast(event_id % 5 + 1 as integer)] AS task_type,
  event_id AS seq,
  0.5 + {u_sql('event_id', 5)} / 2 AS estimated,
  {u_sql('event_id', 6)} AS actual
FROM events"""


# -------------------------------------------------------- scored (metrics)
def scored_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    score = F.col("l_discount") * 10
    return li.select(
        lineitem_row_id().alias("row_id"),
        (F.col("l_returnflag") == "R").cast("double").alias("label"),
        (score > 0.5).cast("double").alias("prediction"),
        score.alias("score"),
    )


SCORED_BINARY_SQL = """
SELECT concat_ws(':', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS row_id,
  CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END AS label,
  CASE WHEN l_discount * 10 > 0.5 THEN 1.0 ELSE 0.0 END AS prediction,
  l_discount * 10 AS score
FROM lineitem"""


STATUS = ["F", "O", "P"]


def scored_multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three-class scored table from orders: label = o_orderstatus code,
    per-class raw scores from u(o_orderkey, 7..9), probabilities normalised,
    prediction = argmax (first on ties)."""
    o = table(spark, sf_dir, "orders")
    status = F.array(*[F.lit(s) for s in STATUS])
    raw = [u(F.col("o_orderkey"), 7 + i) + F.when(F.col("o_orderstatus") == s, 0.3).otherwise(0.0)
           for i, s in enumerate(STATUS)]
    total = raw[0] + raw[1] + raw[2]
    probs = F.array(*[r / total for r in raw])
    return o.select(
        F.col("o_orderkey").cast("string").alias("row_id"),
        (F.array_position(status, F.col("o_orderstatus")) - 1).cast("double").alias("label"),
        probs.alias("probability"),
    ).withColumn("prediction", (F.array_position(F.col("probability"),
                                                  F.array_max("probability")) - 1).cast("double"))


def _multi_raw_sql(i: int, s: str) -> str:
    return f"({u_sql('o_orderkey', 7 + i)} + CASE WHEN o_orderstatus = '{s}' THEN 0.3 ELSE 0.0 END)"


SCORED_MULTI_SQL = f"""
SELECT row_id, label, probability,
  cast(list_position(probability, list_max(probability)) - 1 as double) AS prediction
FROM (
  SELECT cast(o_orderkey as varchar) AS row_id,
    cast(list_position(['F','O','P'], o_orderstatus) - 1 as double) AS label,
    [{_multi_raw_sql(0, 'F')} / ({' + '.join(_multi_raw_sql(i, s) for i, s in enumerate(STATUS))}),
     {_multi_raw_sql(1, 'O')} / ({' + '.join(_multi_raw_sql(i, s) for i, s in enumerate(STATUS))}),
     {_multi_raw_sql(2, 'P')} / ({' + '.join(_multi_raw_sql(i, s) for i, s in enumerate(STATUS))})]
      AS probability
  FROM orders)"""


def scored_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = lineitem(spark, sf_dir)
    return li.select("row_id", F.col("y_lin").alias("label"),
                     (3 * F.col("l_quantity") - 40 * F.col("l_discount") + 0.5).alias("prediction"))


SCORED_REGRESSION_SQL = f"""
SELECT row_id, y_lin AS label, 3 * l_quantity - 40 * l_discount + 0.5 AS prediction
FROM ({LINEITEM_SQL})"""


def estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Estimate texts in every form the parser meets, one per events row:
    'a-b%', '0.x-0.y', 'a%', '0.xx', 'n/a', '-a' (by event_id % 6)."""
    e = table(spark, sf_dir, "events")
    a = (F.col("event_id") % 40 + 55).cast("string")
    b = (F.col("event_id") % 40 + 60).cast("string")
    d2 = F.lpad((F.col("event_id") % 100).cast("string"), 2, "0")
    k = F.col("event_id") % 6
    text = (F.when(k == 0, F.concat(a, F.lit("-"), b, F.lit("%")))
            .when(k == 1, F.concat(F.lit("0."), (F.col("event_id") % 5 + 4).cast("string"), F.lit("-0."),
                                   (F.col("event_id") % 4 + 6).cast("string")))
            .when(k == 2, F.concat(a, F.lit("%")))
            .when(k == 3, F.concat(F.lit("0."), d2))
            .when(k == 4, F.lit("n/a"))
            .otherwise(F.concat(F.lit("-"), a)))
    names = F.array(*[F.lit(t) for t in TASK_NAMES])
    return e.select("event_id", text.alias("estimate"),
                    F.element_at(names, (F.col("event_id") % 5 + 1).cast("int")).alias("task_type"),
                    F.when(F.col("event_id") % 3 == 0, u(F.col("event_id"), 8)).alias("actual"))


ESTIMATES_SQL = f"""
SELECT event_id,
  CASE event_id % 6
    WHEN 0 THEN concat(cast(event_id % 40 + 55 as varchar), '-', cast(event_id % 40 + 60 as varchar), '%')
    WHEN 1 THEN concat('0.', cast(event_id % 5 + 4 as varchar), '-0.', cast(event_id % 4 + 6 as varchar))
    WHEN 2 THEN concat(cast(event_id % 40 + 55 as varchar), '%')
    WHEN 3 THEN concat('0.', lpad(cast(event_id % 100 as varchar), 2, '0'))
    WHEN 4 THEN 'n/a'
    ELSE concat('-', cast(event_id % 40 + 55 as varchar)) END AS estimate,
  (['{"','".join(TASK_NAMES)}'])[cast(event_id % 5 + 1 as integer)] AS task_type,
  CASE WHEN event_id % 3 = 0 THEN {u_sql('event_id', 8)} END AS actual
FROM events"""


def replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One saved reply per events row, by event_id % 4: JSON only, JSON in
    prose with a summary, no JSON, broken JSON. Estimates and names come
    from the row."""
    e = table(spark, sf_dir, "events")
    a = (F.col("event_id") % 30 + 60).cast("string")
    b = (F.col("event_id") % 30 + 65).cast("string")
    r2 = F.lpad((F.col("event_id") % 90 + 10).cast("string"), 2, "0")
    body = F.concat(
        F.lit('{"algorithm_recommendations": {"classification": [{"algorithm": "Random Forest", '
              '"estimated_accuracy": "'), a, F.lit("-"), b, F.lit('%", "reason": "events of type '),
        F.col("event_type"), F.lit('"}, {"algorithm": "Logistic Regression", "estimated_accuracy": "0.'),
        r2, F.lit('"}], "regression": [{"algorithm": "Ridge", "estimated_r2": "0.'), r2,
        F.lit('", "reason": "user '), F.col("user_id").cast("string"),
        F.lit('"}], "clustering": [{"algorithm": "K-Means", "estimated_silhouette": "0.4"}]}}'))
    k = F.col("event_id") % 4
    text = (F.when(k == 0, body)
            .when(k == 1, F.concat(F.lit("Here is the analysis:\n"), body,
                                   F.lit("\nThanks.\n## Summary\nUser "), F.col("user_id").cast("string"),
                                   F.lit(" looks fine.\n## Next steps\nTrain.")))
            .when(k == 2, F.concat(F.lit("No structured answer for user "), F.col("user_id").cast("string"),
                                   F.lit(".")))
            .otherwise(F.concat(F.lit('Partial: {"algorithm_recommendations": {"classification": [{'
                                      '"algorithm": "X", }'), F.lit(" trailing } text "),
                                F.col("event_type"))))
    return e.select(F.col("event_id").alias("reply_id"), text.alias("reply"),
                    u(F.col("event_id"), 9).alias("actual"))


REPLIES_SQL = f"""
SELECT event_id AS reply_id,
  CASE event_id % 4
    WHEN 0 THEN BODY
    WHEN 1 THEN 'Here is the analysis:' || chr(10) || BODY || chr(10) || 'Thanks.' || chr(10)
                || '## Summary' || chr(10) || 'User ' || cast(user_id as varchar) || ' looks fine.'
                || chr(10) || '## Next steps' || chr(10) || 'Train.'
    WHEN 2 THEN 'No structured answer for user ' || cast(user_id as varchar) || '.'
    ELSE 'Partial: {{"algorithm_recommendations": {{"classification": [{{"algorithm": "X", }}'
         || ' trailing }} text ' || event_type END AS reply,
  {u_sql('event_id', 9)} AS actual
FROM events""".replace("BODY", """(
  '{"algorithm_recommendations": {"classification": [{"algorithm": "Random Forest", "estimated_accuracy": "'
  || cast(event_id % 30 + 60 as varchar) || '-' || cast(event_id % 30 + 65 as varchar)
  || '%", "reason": "events of type ' || event_type
  || '"}, {"algorithm": "Logistic Regression", "estimated_accuracy": "0.'
  || lpad(cast(event_id % 90 + 10 as varchar), 2, '0')
  || '"}], "regression": [{"algorithm": "Ridge", "estimated_r2": "0.'
  || lpad(cast(event_id % 90 + 10 as varchar), 2, '0') || '", "reason": "user ' || cast(user_id as varchar)
  || '"}], "clustering": [{"algorithm": "K-Means", "estimated_silhouette": "0.4"}]}}')""")
