"""Evaluation of scored tables ``(row_id, label, prediction[, score | probability])``.

Every metric is an aggregate (or a running sum in score order computed by
:func:`global_cumsum`), never a collect of predictions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from autotab.operators.ranking import global_cumsum, global_rank

MAX_CLASSES = 10_000


def metric_accuracy(scored: DataFrame, label: str = "label", pred: str = "prediction") -> DataFrame:
    return scored.agg(F.avg((F.col(label) == F.col(pred)).cast("double")).alias("accuracy"))


def _classes(scored: DataFrame, label: str, pred: str) -> list:
    cls = (scored.select(F.col(label).alias("c")).union(scored.select(F.col(pred).alias("c")))
           .distinct())
    vals = [r.c for r in cls.limit(MAX_CLASSES + 1).collect()]
    if len(vals) > MAX_CLASSES:
        raise ValueError("too many classes for a confusion table")
    return sorted(v for v in vals if v is not None)


def confusion_matrix(scored: DataFrame, label: str = "label", pred: str = "prediction") -> DataFrame:
    """(actual, predicted, n) for every pair of seen classes, zeros included.

    Counts are a distributed groupBy; the k x k grid comes from the class
    list (k bounded and checked), exploded, and left-joined to the counts.
    """
    classes = _classes(scored, label, pred)
    counts = scored.groupBy(F.col(label).alias("actual"), F.col(pred).alias("predicted")).agg(
        F.count(F.lit(1)).alias("n"))
    one = scored.sparkSession.createDataFrame([(c,) for c in classes], f"c {scored.schema[label].dataType.simpleString()}")
    # the grid is the result: one row per pair of classes
    grid = one.select(F.col("c").alias("actual")).join(one.select(F.col("c").alias("predicted")), F.lit(True))
    return (grid.join(counts, ["actual", "predicted"], "left")
            .select("actual", "predicted", F.coalesce("n", F.lit(0)).cast("long").alias("n")))


def per_class_prf(scored: DataFrame, label: str = "label", pred: str = "prediction") -> DataFrame:
    """(class, support, precision, recall, f1); undefined ratios are 0."""
    tp = scored.groupBy(F.col(label).alias("cls")).agg(
        F.count(F.lit(1)).alias("support"),
        F.count_if(F.col(label) == F.col(pred)).alias("tp"))
    pc = scored.groupBy(F.col(pred).alias("cls")).agg(F.count(F.lit(1)).alias("npred"))
    t = tp.join(pc, "cls", "full").fillna(0, ["support", "tp", "npred"])
    p = F.coalesce(F.try_divide(F.col("tp").cast("double"), F.col("npred").cast("double")), F.lit(0.0))
    r = F.coalesce(F.try_divide(F.col("tp").cast("double"), F.col("support").cast("double")),
                   F.lit(0.0))
    return (t.withColumn("precision", p).withColumn("recall", r)
            .withColumn("f1", F.when(F.col("precision") + F.col("recall") > 0,
                                     2 * F.col("precision") * F.col("recall") /
                                     (F.col("precision") + F.col("recall"))).otherwise(0.0))
            .select(F.col("cls").alias("class"), "support", "precision", "recall", "f1"))


def metric_prf_weighted(scored: DataFrame, label: str = "label",
                        pred: str = "prediction") -> DataFrame:
    pc = per_class_prf(scored, label, pred)
    tot = F.sum("support").cast("double")
    return pc.agg(*[(F.sum(F.col(m) * F.col("support")) / tot).alias(f"{m}_weighted")
                    for m in ("precision", "recall", "f1")])


def _score_table(scored: DataFrame, label: str, score: str, positive=1.0) -> DataFrame:
    """One row per distinct score: positives and negatives at that score."""
    is_pos = (F.col(label) == F.lit(positive))
    return scored.groupBy(F.col(score).cast("double").alias("score")).agg(
        F.count_if(is_pos).cast("double").alias("pos"),
        F.count_if(~is_pos).cast("double").alias("neg"))


def _auc_from_counts(counts: DataFrame, group: list[str] | None = None) -> DataFrame:
    """Area under ROC with ties counted half: sum over distinct scores (in
    descending order) of neg * (2 * tps - pos) / (2 P N)."""
    cum = global_cumsum(counts, [F.col("score").desc()], ["pos"], group_cols=group)
    g = group or []
    return cum.groupBy(*g).agg(
        (F.sum(F.col("neg") * (2 * F.col("pos_cum") - F.col("pos")))
         / (2 * F.sum("pos") * F.sum("neg"))).alias("roc_auc"))


def roc_auc_binary(scored: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    return _auc_from_counts(_score_table(scored, label, score))


def _ovr_counts(scored: DataFrame, label: str, prob: str) -> DataFrame:
    ex = scored.select(F.col(label).alias("_y"), F.posexplode(prob).alias("class", "_p"))
    is_pos = F.col("_y") == F.col("class").cast("double")
    return ex.groupBy("class", F.col("_p").cast("double").alias("score")).agg(
        F.count_if(is_pos).cast("double").alias("pos"),
        F.count_if(~is_pos).cast("double").alias("neg"))


def roc_auc_ovr(scored: DataFrame, label: str = "label", prob: str = "probability") -> DataFrame:
    """Unweighted mean of one-vs-rest AUCs over the classes."""
    per = _auc_from_counts(_ovr_counts(scored, label, prob), ["class"])
    return per.agg(F.avg("roc_auc").alias("roc_auc_ovr"))


def roc_curve(scored: DataFrame, label: str = "label", score: str = "score",
              prob: str | None = None, average: str | None = None) -> DataFrame:
    """(curve, fpr, tpr, threshold): the origin plus one point per distinct
    threshold, descending. ``prob`` set: one curve per class
    (``curve`` = class index) or, with ``average='micro'``, one curve over
    all (row, class) pairs (``curve`` = -1). Binary: ``curve`` = 1."""
    if prob is None:
        counts = _score_table(scored, label, score).withColumn("curve", F.lit(1))
    elif average == "micro":
        counts = (_ovr_counts(scored, label, prob).groupBy("score")
                  .agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
                  .withColumn("curve", F.lit(-1)))
    else:
        counts = _ovr_counts(scored, label, prob).withColumnRenamed("class", "curve")
    cum = global_cumsum(counts, [F.col("score").desc()], ["pos", "neg"], group_cols=["curve"])
    tot = F.broadcast(counts.groupBy("curve").agg(F.sum("pos").alias("P"), F.sum("neg").alias("N")))
    pts = cum.join(tot, "curve").select(
        F.col("curve").cast("int").alias("curve"),
        F.try_divide(F.col("neg_cum"), F.col("N")).alias("fpr"),
        F.try_divide(F.col("pos_cum"), F.col("P")).alias("tpr"),
        F.col("score").alias("threshold"))
    origin = tot.select(F.col("curve").cast("int").alias("curve"), F.lit(0.0).alias("fpr"),
                        F.lit(0.0).alias("tpr"), F.lit(None).cast("double").alias("threshold"))
    return origin.unionByName(pts)


def auc_trapezoid(curve: DataFrame, x: str = "fpr", y: str = "tpr",
                  group: str = "curve", order: str = "threshold") -> DataFrame:
    """Trapezoid area over the points of each curve, in descending threshold
    order (origin first). Neighbours are paired by an equi-join on
    consecutive global ranks, so no window has to see a whole curve."""
    pts = curve.withColumn("_o", F.coalesce(-F.col(order), F.lit(float("-inf"))))
    ranked = global_rank(pts, ["_o"], [x, y], group_cols=[group], rank_col="_r")
    prev = ranked.select(group, (F.col("_r") + 1).alias("_r"), F.col(x).alias("_px"),
                         F.col(y).alias("_py"))
    return (ranked.join(prev, [group, "_r"])
            .groupBy(group).agg(F.sum((F.col(x) - F.col("_px")) * (F.col(y) + F.col("_py")) / 2)
                                .alias("auc")))


def metric_regression(scored: DataFrame, label: str = "label", pred: str = "prediction") -> DataFrame:
    """R², MSE, RMSE, MAE and explained variance in one aggregate."""
    e = F.col(label) - F.col(pred)
    agg = scored.agg(F.sum(e * e).alias("sse"), F.avg(e * e).alias("mse"),
                     F.avg(F.abs(e)).alias("mae"), F.var_pop(F.col(label)).alias("vy"),
                     F.var_pop(e).alias("ve"), F.count(F.lit(1)).alias("n"))
    sst = F.col("vy") * F.col("n")
    r2 = (F.when(sst > 0, 1 - F.col("sse") / sst)
          .when(F.col("sse") == 0, 1.0).otherwise(0.0))
    ev = (F.when(F.col("vy") > 0, 1 - F.col("ve") / F.col("vy"))
          .when(F.col("ve") == 0, 1.0).otherwise(0.0))
    return agg.select(r2.alias("r2"), F.col("mse"), F.sqrt("mse").alias("rmse"), F.col("mae"),
                      ev.alias("explained_variance"))


def actual_vs_predicted(scored: DataFrame, ids: list[str], label: str = "label",
                        pred: str = "prediction") -> DataFrame:
    """Scatter points plus the diagonal's range (two scalars from one small
    aggregate, attached as literals)."""
    lo, hi = scored.agg(F.least(F.min(label), F.min(pred)), F.greatest(F.max(label), F.max(pred))
                        ).first()
    return scored.select(*ids, F.col(label).alias("actual"), F.col(pred).alias("predicted"),
                         F.lit(lo).cast("double").alias("diag_lo"),
                         F.lit(hi).cast("double").alias("diag_hi"))


def cv_summary(scores: DataFrame, by: list[str], score: str = "score") -> DataFrame:
    return scores.groupBy(*by).agg(F.avg(score).alias("cv_mean"), F.stddev_pop(score).alias("cv_std"),
                                   F.count(F.lit(1)).alias("n_folds"))


def evaluate(scored: DataFrame, task: str, label: str = "label", pred: str = "prediction",
             prob: str | None = "probability") -> DataFrame:
    """One tidy (metric, value) table for the task.

    The scored rows are kept in executor storage while the few metric jobs
    run, and the metrics (a handful of numbers) come back as a small table,
    so the model and its inputs are evaluated once, not once per metric.
    """
    spark = scored.sparkSession
    data = scored.persist()
    try:
        if task == "regression":
            r = metric_regression(data, label, pred).first().asDict()
        else:
            r = metric_accuracy(data, label, pred).first().asDict()
            r.update(metric_prf_weighted(data, label, pred).first().asDict())
            if prob and prob in data.columns:
                first = data.select(F.size(prob)).first()
                k = first[0] if first else 0
                if k == 2:
                    bin_scored = data.select(F.col(label), F.element_at(F.col(prob), 2).alias("_s"))
                    r.update(roc_auc_binary(bin_scored, label, "_s").first().asDict())
                elif k and k > 2:
                    r.update(roc_auc_ovr(data, label, prob).first().asDict())
    finally:
        data.unpersist()
    return spark.createDataFrame([(k, None if v is None else float(v)) for k, v in r.items()],
                                 "metric string, value double")


def report(scored: DataFrame, task: str, label: str = "label", pred: str = "prediction",
           prob: str | None = "probability", cv: DataFrame | None = None) -> DataFrame:
    """(section, item, value): the metrics, for classification the confusion counts
    ('actual:predicted'), and with fold scores ``cv`` their mean and deviation."""
    out = evaluate(scored, task, label, pred, prob).select(F.lit("metric").alias("section"),
                                                           F.col("metric").alias("item"), "value")
    if task == "classification":
        name = F.concat_ws(":", *[F.col(c).cast("int").cast("string") for c in ("actual", "predicted")])
        out = out.unionByName(confusion_matrix(scored, label, pred).select(
            F.lit("confusion").alias("section"), name.alias("item"), F.col("n").cast("double").alias("value")))
    if cv is not None:
        folds = cv_summary(cv, []).select(F.inline(F.array(*[
            F.struct(F.lit("cv").alias("section"), F.lit(c).alias("item"), F.col(c).alias("value"))
            for c in ("cv_mean", "cv_std")])))
        out = out.unionByName(folds)
    return out
