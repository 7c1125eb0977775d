"""Dataset insights and estimate calibration as aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from autotab.functions.scalars import DEFAULT_FACTORS, parse_estimate, task_factor
from autotab.operators.profile import numeric_columns
from autotab.operators.ranking import ROWS_PER_RANGE, column_quantiles, global_cumsum, global_rank
from autotab.session import cut_lineage

# Thresholds of the four insight rules.
SPARSE_BELOW = 0.2
NONLINEAR_MI_ABOVE = 0.15
WIDE_RANGE_ABOVE = 1000
KURTOSIS_ABOVE = 3
MI_BINS = 10
MI_NEIGHBOURS = 3
RUN = 4096            # values of one class that a window holds


def nonzero_share(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Share of cells that are not 0 (nulls count as non-zero)."""
    cols = numeric_columns(df, cols)
    nz = sum((F.count_if(F.coalesce(F.col(c) != 0, F.lit(True))) for c in cols), F.lit(0))
    return (df.agg(nz.cast("double").alias("_nz"), F.count(F.lit(1)).alias("_n"))
            .select((F.col("_nz") / (F.col("_n") * len(cols))).alias("nonzero_share"))
            .withColumn("sparse", F.col("nonzero_share") < SPARSE_BELOW))


def max_abs_feature(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    cols = numeric_columns(df, cols)
    return (df.agg(F.greatest(*[F.max(F.abs(F.col(c))).cast("double") for c in cols])
                   .alias("max_abs"))
            .withColumn("wide_ranges", F.col("max_abs") > WIDE_RANGE_ABOVE))


def column_kurtosis(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Excess population kurtosis per column (null for a constant column)."""
    cols = numeric_columns(df, cols)
    wide = df.agg(*[F.when(F.stddev_pop(c) > 0, F.kurtosis(c)).alias(c) for c in cols])
    return wide.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col(f"`{c}`").alias("kurtosis")) for c in cols])))


def mean_kurtosis(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    return (column_kurtosis(df, cols).agg(F.avg("kurtosis").alias("mean_kurtosis"))
            .withColumn("outliers", F.col("mean_kurtosis") > KURTOSIS_ABOVE))


def mutual_information(df: DataFrame, target: str, cols: list[str] | None = None,
                       bins: int = MI_BINS, target_bins: int | None = None) -> DataFrame:
    """(feature, mi): plug-in MI in nats between each feature cut at its quantiles into ``bins`` bins and
    the target (cut too into ``target_bins`` when set, for regression). Exact quantiles, so one outlier
    moves one row; a value lies above the distinct cuts below it. Contingency counts are a distributed
    groupBy with map-side combine; nothing is sampled."""
    cols = [c for c in numeric_columns(df, cols) if c != target]
    shares = {b: [i / b for i in range(1, b)] for b in {bins, target_bins or bins}}
    cuts = {bins: column_quantiles(df, cols, shares[bins])}
    if target_bins:
        cuts[target, target_bins] = column_quantiles(df, [target], shares[target_bins])

    def binned(c, at):
        x = F.col(c).cast("double")
        above = [F.when(x > e, 1).otherwise(0) for e in sorted(set(at.get(c, {}).values()))]
        return F.when(x.isNotNull(), sum(above, F.lit(0)))

    y = binned(target, cuts[target, target_bins]) if target_bins else F.col(target).cast("string")
    long_df = df.select(y.alias("_y"), F.explode(F.array(*[
        F.struct(F.lit(c).alias("feature"), binned(c, cuts[bins]).alias("_b")) for c in cols])).alias("kv")
    ).select("kv.*", "_y").filter(F.col("_b").isNotNull() & F.col("_y").isNotNull())
    joint = long_df.groupBy("feature", "_b", "_y").agg(F.count(F.lit(1)).cast("double").alias("nxy"))
    px = joint.groupBy("feature", "_b").agg(F.sum("nxy").alias("nx"))
    py = joint.groupBy("feature", "_y").agg(F.sum("nxy").alias("ny"))
    n = joint.groupBy("feature").agg(F.sum("nxy").alias("n"))
    j = joint.join(px, ["feature", "_b"]).join(py, ["feature", "_y"]).join(n, "feature")
    term = (F.col("nxy") / F.col("n")) * F.log(F.col("nxy") * F.col("n") / (F.col("nx") * F.col("ny")))
    return j.groupBy("feature").agg(F.sum(term).alias("mi"))


def digamma(n: Column) -> Column:
    """psi(n) of a count n >= 1: the asymptotic series at n + 6, stepped down by six reciprocals."""
    n = n.cast("double")
    at = n + 6
    inv = 1 / (at * at)
    series = F.log(at) - 0.5 / at - inv * (1 / 12 - inv * (1 / 120 - inv * (1 / 252 - inv * (1 / 240 - inv / 132))))
    return series - sum(1 / (n + j) for j in range(6))


def neighbour_information(df: DataFrame, target: str, cols: list[str] | None = None, k: int = MI_NEIGHBOURS,
                          target_bins: int | None = None) -> DataFrame:
    """(feature, mi): mutual information in nats by nearest neighbours (Ross 2014), at least 0.

    A row's radius is the distance to its ``k``-th nearest row of its class in one feature; mi compares the
    rows of its class with all rows inside that radius:
    psi(N) + mean(psi(inside, class) - psi(class size) - psi(inside, all)).  Without ties ``inside, class`` is ``k``
    (the row itself counted, the ``k``-th not); a value held by more than ``k`` rows of a class has radius 0 and
    compares the copies, which is the plug-in form.  Inside means within (1 - 1e-6) of the radius, so rounding
    of sums cannot bring the ``k``-th row in.  Classes of one row, nulls and NaN take no part; a numeric target is cut
    at its quantiles into ``target_bins`` classes when set.  A feature without rows has no row here.

    All rows count, as distinct values with weights (partial sums before the shuffle).  Neighbours come from windows
    of ``RUN`` ranked values that overlap by ``k``, the counts of all rows from running sums over one sort of the
    values and of both ends of every radius.
    """
    cols = [c for c in numeric_columns(df, cols) if c != target]
    if target_bins:
        cuts = sorted(set(column_quantiles(df, [target], [i / target_bins for i in range(1, target_bins)])[target].values()))
        t = F.col(target).cast("double")
        y = F.when(t.isNotNull() & ~F.isnan(t), sum([F.when(t > e, 1).otherwise(0) for e in cuts], F.lit(0)))
    else:
        y = F.col(target)
    values = (df.select(y.cast("string").alias("y"), F.explode(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(f"`{c}`").cast("double").alias("x")) for c in cols])).alias("kv"))
        .select("kv.feature", "y", "kv.x").filter("x IS NOT NULL AND NOT isnan(x) AND y IS NOT NULL")
        .groupBy("feature", "y", "x").agg(F.count(F.lit(1)).alias("w")))
    ranked = cut_lineage(global_rank(values, ["x"], [], ["feature", "y"], "r"))
    # once per span of ranks: joined by class alone, all rows of a class would meet in one task and stay there
    sizes = ranked.groupBy("feature", "y").agg(F.sum("w").alias("size"), F.max("r").alias("last")).filter("size > 1").select(
        "feature", "y", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(last - 1) div {ROWS_PER_RANGE}"))).alias("span"))
    ranked = ranked.withColumn("span", F.expr(f"(r - 1) div {ROWS_PER_RANGE}")).join(sizes, ["feature", "y", "span"]).drop("span")
    at = F.expr(f"(r - 1) div {RUN}")
    runs = F.array_distinct(F.array(at, F.greatest(F.expr(f"(r - 1 - {k}) div {RUN}"), F.lit(0)), F.expr(f"(r - 1 + {k}) div {RUN}")))
    order = Window.partitionBy("feature", "y", "run").orderBy("r")
    beside = [f(F.struct("x", "w"), o).over(order) for f in (F.lag, F.lead) for o in range(1, k + 1)]
    near = (ranked.withColumn("own", at).withColumn("run", F.explode(runs))
            .withColumn("near", F.array_compact(F.array(*beside))).filter("run = own"))
    far = F.array_sort(F.concat(F.array(F.struct(F.lit(0.0).alias("d"), (F.col("w") - 1).alias("n"))), F.transform(
        "near", lambda v: F.struct(F.abs(v["x"] - F.col("x")).alias("d"), v["w"].alias("n")))))
    want = F.least(F.lit(k).cast("long"), F.col("size") - 1)
    reach = F.aggregate(far, F.struct(F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("d")),
                        lambda s, v: F.when(s["n"] >= want, s).otherwise(F.struct((s["n"] + v["n"]).alias("n"), v["d"].alias("d"))))["d"]
    inside = 1 + F.aggregate(F.filter("far", lambda v: v["d"] <= F.col("q")), F.lit(0).cast("long"), lambda s, v: s + v["n"])
    rows = (near.withColumn("far", far).withColumn("q", reach * (1 - 1e-6)).withColumn("inside", inside)
            .select("feature", "y", "x", "w", "size", "q", "inside"))
    # before all values equal to it (0), the values themselves (1), behind them (2)
    marks = rows.select("*", F.inline(F.array(
        F.struct((F.col("x") - F.col("q")).alias("pos"), F.lit(0).alias("kind"), F.lit(0.0).alias("add")),
        F.struct(F.col("x").alias("pos"), F.lit(1).alias("kind"), F.col("w").cast("double").alias("add")),
        F.struct((F.col("x") + F.col("q")).alias("pos"), F.lit(2).alias("kind"), F.lit(0.0).alias("add")))))
    upto = global_cumsum(marks, ["pos", "kind"], ["add"], ["feature"], ["y", "x"])
    ends = upto.filter("kind <> 1").groupBy("feature", "y", "x", "w", "size", "inside").agg(
        F.sum(F.when(F.col("kind") == 2, F.col("add_cum")).otherwise(-F.col("add_cum"))).alias("all"))
    term = F.col("w") * (digamma(F.col("inside")) - digamma(F.col("size")) - digamma(F.col("all")))
    return ends.groupBy("feature").agg(F.greatest(F.lit(0.0), digamma(F.sum("w")) + F.sum(term) / F.sum("w")).alias("mi"))


# Insight messages.
MSG_SPARSE = "High Sparsity ({:.1%}): Linear models or Sparse-friendly ensembles recommended."
MSG_NONLINEAR = ("Strong Non-linear patterns detected: Tree-based models (XGBoost, RF) will likely "
                 "outperform linear models.")
MSG_LINEAR = "Data exhibits potential linear trends: Regularized Linear models may generalize better."
MSG_WIDE = "Wide feature ranges detected: Scaling is critical (StandardScaler applied)."
MSG_KURT = ("High Kurtosis ({:.1f}) detected: Significant outlier potential identified. Robust "
            "models like Isolation Forest recommended.")
MSG_COMPACT = "Low Kurtosis: Data is relatively compact, but subtle local outliers may still exist."


def dataset_insights(df: DataFrame, cols: list[str] | None = None, target: str | None = None,
                     task: str = "classification", least_supervised: int = 100,
                     least_unsupervised: int = 50) -> DataFrame:
    """The four rules as rows (rule, fired, value, message). Every statistic
    is one Spark aggregate; the rule texts are formatted from its result."""
    cols = [c for c in numeric_columns(df, cols) if c != target]
    n = df.count()
    rows = []
    nz = nonzero_share(df, cols).first()
    rows.append(("sparsity", bool(nz.sparse), float(nz.nonzero_share),
                 MSG_SPARSE.format(nz.nonzero_share) if nz.sparse else None))
    if target is not None and n > least_supervised:
        mi_df = neighbour_information(df, target, cols, target_bins=MI_BINS if task == "regression" else None)
        mi = mi_df.agg(F.avg("mi")).first()[0]
        fired = mi is not None and mi > NONLINEAR_MI_ABOVE
        rows.append(("nonlinearity", fired, mi, MSG_NONLINEAR if fired else MSG_LINEAR))
    ma = max_abs_feature(df, cols).first()
    rows.append(("wide_ranges", bool(ma.wide_ranges), ma.max_abs,
                 MSG_WIDE if ma.wide_ranges else None))
    if target is None and n > least_unsupervised:
        k = mean_kurtosis(df, cols).first()
        fired = k.mean_kurtosis is not None and k.mean_kurtosis > KURTOSIS_ABOVE
        msg = MSG_KURT.format(k.mean_kurtosis) if fired else (
            MSG_COMPACT if task == "anomaly_detection" else None)
        rows.append(("kurtosis", fired, k.mean_kurtosis, msg))
    return df.sparkSession.createDataFrame(
        rows, "rule string, fired boolean, value double, message string")


# ----------------------------------------------------------- calibration
def calibrate_estimate(df: DataFrame, estimate: str, task: str, actual: str | None = None,
                       out: str = "calibrated") -> DataFrame:
    """estimate (text or number) x factor of the task (default factors;
    unknown task 0.85); with an actual value more than 0.15 away, the
    actual wins."""
    est = (parse_estimate(F.col(estimate)) if df.schema[estimate].dataType.simpleString() == "string"
           else F.col(estimate).cast("double"))
    cal = est * task_factor(F.col(task))
    if actual:
        cal = F.when(F.col(actual).isNotNull() & (F.abs(cal - F.col(actual)) > 0.15),
                     F.col(actual)).otherwise(cal)
    return df.withColumn(out, cal)


def calibration_history(history: DataFrame) -> DataFrame:
    """Observations that update a factor (estimated > 0) with their ratio."""
    return (history.filter(F.col("estimated") > 0)
            .withColumn("ratio", F.col("actual") / F.col("estimated")))


def calibration_factors(history: DataFrame, start: dict | None = None) -> DataFrame:
    """Final factor per task after folding f <- 0.7 f + 0.3 clip(a/e, .5, 1.5)
    over the history in ``seq`` order.

    Closed form f_m = 0.7^m f_0 + sum_i 0.3 * 0.7^(m-i) * r_i, with i the
    rank inside the task from the distributed rank (a task holding most of
    the rows is still spread over many tasks), then one groupBy.
    """
    start = start or DEFAULT_FACTORS
    h = calibration_history(history).withColumn(
        "_r", F.least(F.greatest(F.col("ratio"), F.lit(0.5)), F.lit(1.5)))
    ranked = global_rank(h.select("task_type", "seq", "_r"), ["seq"], ["_r"], group_cols=["task_type"],
                         rank_col="_i")
    m = ranked.groupBy("task_type").agg(F.count(F.lit(1)).alias("_m"))
    f0 = F.create_map(*[x for k, v in start.items() for x in (F.lit(k), F.lit(v))])
    return (ranked.join(m, "task_type")
            .groupBy("task_type", "_m")
            .agg(F.sum(0.3 * F.pow(F.lit(0.7), F.col("_m") - F.col("_i")) * F.col("_r")).alias("_s"))
            .select("task_type", F.col("_m").alias("n_obs"),
                    (F.pow(F.lit(0.7), F.col("_m")) * F.coalesce(F.element_at(f0, F.col("task_type")),
                                                                 F.lit(0.85)) + F.col("_s"))
                    .alias("factor")))
