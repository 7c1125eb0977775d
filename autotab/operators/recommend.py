"""Reading saved recommendation replies: a column of reply
texts -> one row per (reply, task, algorithm), with calibrated estimates.
Pure column expressions plus explode; nothing per row in Python."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from autotab.functions.scalars import format_calibrated, parse_estimate, task_factor

TASKS = ["classification", "regression", "clustering", "dimensionality_reduction",
         "anomaly_detection"]

# The estimate field of each task and its default when missing
# (only the two calibrated tasks have defaults).
ESTIMATE_FIELD = {
    "classification": ("estimated_accuracy", "60%"),
    "regression": ("estimated_r2", "0.5"),
    "clustering": ("estimated_silhouette", None),
    "dimensionality_reduction": ("estimated_variance", None),
    "anomaly_detection": ("estimated_precision", None),
}
CALIBRATED_TASKS = ("classification", "regression")

# The conservative table used when a reply holds no readable JSON.
FALLBACK = [
    ("classification", 0, "Random Forest", "65-75%", "Good for most classification tasks"),
    ("classification", 1, "XGBoost", "70-80%", "Excellent for complex patterns"),
    ("classification", 2, "Logistic Regression", "60-70%", "Good baseline model"),
    ("regression", 0, "Random Forest", "0.60-0.75", "Robust for regression problems"),
    ("regression", 1, "XGBoost", "0.65-0.80", "High accuracy with complex data"),
    ("regression", 2, "Linear Regression", "0.50-0.65", "Simple baseline model"),
    ("clustering", 0, "K-Means", "0.3-0.5", "Good for spherical clusters"),
    ("clustering", 1, "DBSCAN", "0.2-0.4", "Finds arbitrary shaped clusters"),
    ("dimensionality_reduction", 0, "PCA", "60-75%", "Standard linear reduction"),
    ("dimensionality_reduction", 1, "UMAP", "65-80%", "Good for visualization"),
    ("anomaly_detection", 0, "Isolation Forest", "75-85%", "Effective for high dimensions"),
    ("anomaly_detection", 1, "Local Outlier Factor", "70-80%", "Good for varying densities"),
]

_ITEM = ("struct<algorithm:string, reason:string, "
         + ", ".join(f"{f}:string" for f, _ in ESTIMATE_FIELD.values()) + ">")
_SCHEMA = f"struct<algorithm_recommendations: map<string, array<{_ITEM}>>>"


def fallback_recommendations(spark) -> DataFrame:
    return spark.createDataFrame(FALLBACK, "task string, position int, algorithm string, "
                                           "estimate string, reason string")


def _estimate(item, task):
    out = None
    for t, (field, default) in ESTIMATE_FIELD.items():
        v = item[field] if default is None else F.coalesce(item[field], F.lit(default))
        out = F.when(task == t, v) if out is None else out.when(task == t, v)
    return out


def parse_recommendations(df: DataFrame, reply: str = "reply", reply_id: str = "reply_id") -> DataFrame:
    """(reply_id, task, position, algorithm, estimate, reason, fallback,
    calibrated, calibrated_text). The outermost ``{...}`` of the reply is read
    as JSON; no JSON or unreadable JSON gives the fallback table (a reply
    without any JSON is still calibrated, an unreadable one is not, as in the
    original); JSON without any listed
    algorithm counts as unreadable."""
    js = F.regexp_extract(F.col(reply), r"(?s)\{.*\}", 0)
    read = F.from_json(js, _SCHEMA)
    # JSON without a list under the expected key counts as unreadable, so no reply is lost
    listed = F.coalesce(F.exists(F.map_values(read["algorithm_recommendations"]), lambda a: F.size(a) > 0), F.lit(False))
    parsed = df.select(reply_id, js.alias("_js"),
                       (F.try_parse_json(js).isNotNull() & listed).alias("_valid"),
                       read.alias("_p"))
    good = parsed.filter((F.col("_js") != "") & F.col("_valid"))
    items = (good.select(reply_id, F.explode("_p.algorithm_recommendations").alias("task", "_arr"))
             .select(reply_id, "task", F.posexplode("_arr").alias("position", "_it"))
             .select(reply_id, "task", F.col("position").cast("int"),
                     F.col("_it.algorithm").alias("algorithm"),
                     _estimate(F.col("_it"), F.col("task")).alias("estimate"),
                     F.col("_it.reason").alias("reason"),
                     F.lit(False).alias("fallback"), F.lit(True).alias("_cal")))
    bad = parsed.filter((F.col("_js") == "") | ~F.col("_valid")).select(
        reply_id, (F.col("_js") == "").alias("_cal"))
    fb = F.array(*[F.struct(F.lit(t).alias("task"), F.lit(p).alias("position"),
                            F.lit(a).alias("algorithm"), F.lit(e).alias("estimate"),
                            F.lit(r).alias("reason")) for t, p, a, e, r in FALLBACK])
    fall = bad.select(reply_id, "_cal", F.inline(fb)).select(
        reply_id, "task", "position", "algorithm", "estimate", "reason",
        F.lit(True).alias("fallback"), "_cal")
    rows = items.unionByName(fall)
    calibrate = F.col("_cal") & F.col("task").isin(*CALIBRATED_TASKS)
    cal = F.when(calibrate, parse_estimate(F.col("estimate")) * task_factor(F.col("task")))
    return (rows.withColumn("calibrated", cal)
            .withColumn("calibrated_text", format_calibrated(F.col("calibrated"), F.col("task")))
            .drop("_cal"))


def summary_section(df: DataFrame, reply: str = "reply") -> DataFrame:
    """'## Summary' up to the next '##' heading (case-insensitive); else
    '## Summary' + the stripped text after the last '}'."""
    sec = F.regexp_extract(F.col(reply), r"(?is)## Summary.*?(?=\n##|\z)", 0)
    tail = F.regexp_replace(F.substring_index(F.col(reply), "}", -1), r"^\s+|\s+$", "")
    return df.withColumn("summary", F.when(sec != "", sec).otherwise(
        F.concat(F.lit("## Summary\n"), tail)))


def rank_recommendations(recs: DataFrame, reply_id: str = "reply_id", top: int = 5) -> DataFrame:
    """Rank inside (reply, task) by calibrated value (missing = 0.5), first
    listed wins ties; keeps the first ``top``. Groups hold a few rows."""
    w = Window.partitionBy(reply_id, "task").orderBy(
        F.coalesce(F.col("calibrated"), F.lit(0.5)).desc(), "position")
    return recs.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top)


def actual_vs_estimate(best: DataFrame, actual: str = "actual", limit: float = 0.15) -> DataFrame:
    est = F.coalesce(F.col("calibrated"), F.lit(0.5))
    return (best.withColumn("difference", F.col(actual) - est)
            .withColumn("warning", F.abs(F.col("difference")) > limit))
