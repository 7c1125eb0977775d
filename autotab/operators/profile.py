"""Dataset profiling: one aggregate pass per question, long (tidy) results.

Every statistic over many columns is computed in a single ``agg`` (one scan,
map-side partial aggregation) and unpivoted to one row per column, instead of
one job per column.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from autotab.operators.ranking import column_quantiles_with
from autotab.operators.sums import array_sums, stacked

NUMERIC_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType,
                 T.DoubleType, T.DecimalType)
STRING_TYPES = (T.StringType, T.VarcharType, T.CharType)


def role_of(dtype: T.DataType) -> str:
    if isinstance(dtype, NUMERIC_TYPES):
        return "numeric"
    if isinstance(dtype, STRING_TYPES):
        return "categorical"
    return "other"


def numeric_columns(df: DataFrame, cols: list[str] | None = None) -> list[str]:
    cols = cols or df.columns
    return [f.name for f in df.schema.fields if f.name in cols and role_of(f.dataType) == "numeric"]


def categorical_columns(df: DataFrame, cols: list[str] | None = None) -> list[str]:
    cols = cols or df.columns
    return [f.name for f in df.schema.fields
            if f.name in cols and role_of(f.dataType) == "categorical"]


def is_missing(df: DataFrame, name: str) -> Column:
    """Null, or NaN for floating columns (pandas counts both as missing)."""
    c = F.col(name)
    if isinstance(df.schema[name].dataType, (T.FloatType, T.DoubleType)):
        return c.isNull() | F.isnan(c)
    return c.isNull()


def _unpivot(row_df: DataFrame, cols: list[str], value_name: str, value_type: str) -> DataFrame:
    """One-row wide aggregate -> (column_name, value) long table."""
    return row_df.select(
        F.inline(F.array(*[F.struct(F.lit(c).alias("column_name"),
                                    F.col(f"`{c}`").cast(value_type).alias(value_name))
                           for c in cols])))


# ------------------------------------------------------------------ shape
def table_shape(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n_rows")).withColumn("n_cols", F.lit(len(df.columns)))


def column_types(df: DataFrame) -> DataFrame:
    """Type name and role per column (built from the schema, no data scan)."""
    rows = [(i, f.name, f.dataType.simpleString(), role_of(f.dataType))
            for i, f in enumerate(df.schema.fields)]
    return df.sparkSession.createDataFrame(
        rows, "position int, column_name string, data_type string, role string")


def column_figures(df: DataFrame) -> DataFrame:
    """``column_types`` and, from one aggregate over the table, per column the number of rows
    with a value and the approximate number of distinct values (HyperLogLog, 5 % deviation)."""
    held = [F.when(~is_missing(df, c), F.col(c)) for c in df.columns]
    wide = df.agg(*[F.count(h).alias(f"n{i}") for i, h in enumerate(held)],
                  *[F.approx_count_distinct(h).alias(f"d{i}") for i, h in enumerate(held)])
    return wide.select(F.inline(F.array(*[
        F.struct(F.lit(i).alias("position"), F.lit(f.name).alias("column_name"),
                 F.lit(f.dataType.simpleString()).alias("data_type"), F.lit(role_of(f.dataType)).alias("role"),
                 F.col(f"n{i}").alias("n_values"), F.col(f"d{i}").alias("approx_distinct"))
        for i, f in enumerate(df.schema.fields)])))


def null_counts(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    cols = cols or df.columns
    wide = df.agg(*[F.count_if(is_missing(df, c)).alias(c) for c in cols])
    return _unpivot(wide, cols, "null_count", "long")


def missing_ratio(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    cols = cols or df.columns
    missing = sum((F.count_if(is_missing(df, c)) for c in cols), F.lit(0).cast("long"))
    return (df.agg(missing.alias("missing_cells"), F.count(F.lit(1)).alias("n_rows"))
            .select("missing_cells",
                    (F.col("n_rows") * len(cols)).alias("total_cells"),
                    F.try_divide(F.col("missing_cells").cast("double"),
                                 (F.col("n_rows") * len(cols)).cast("double")).alias("missing_ratio")))


def duplicate_rows(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Rows equal to an earlier row (first kept); nulls compare equal.

    groupBy on all columns: partial counts are combined map-side, so one
    value repeated in a third of all rows is still one small record per task.
    """
    cols = cols or df.columns
    return (df.groupBy(*cols).count()
            .agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).cast("long").alias("n_duplicates"),
                 F.count(F.lit(1)).alias("n_distinct_rows")))


# ----------------------------------------------------------- descriptive
DESCRIBE_QS = (0.25, 0.5, 0.75)


def describe_numeric(df: DataFrame, cols: list[str] | None = None,
                     key: list[str] | None = None) -> DataFrame:
    """count, mean, sample std, min, 25/50/75 %, max per numeric column.

    Moments come from one aggregate; quantiles are exact (linear
    interpolation) from the two-pass bounded search in ``column_quantiles``
    (no sort, no row key needed; ``key`` is accepted and unused).
    """
    cols = numeric_columns(df, cols)
    spark = df.sparkSession
    moments = [F.struct(
        F.count(c).alias("count"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"),
        F.min(c).cast("double").alias("min"), F.max(c).cast("double").alias("max")).alias(f"m_{i}")
        for i, c in enumerate(cols)]
    # moments ride along in the quantile sketch scan
    qv, row = column_quantiles_with(df, cols, list(DESCRIBE_QS), moments)
    rows = []
    for i, c in enumerate(cols):
        m = row[f"m_{i}"]
        rows.append((c, m["count"], m["mean"], m["std"], m["min"],
                     *[qv.get(c, {}).get(q) for q in DESCRIBE_QS], m["max"]))
    return spark.createDataFrame(rows, "column_name string, count long, mean double, std double, "
                                       "min double, p25 double, p50 double, p75 double, max double")


def correlation_matrix(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Pearson correlation, pairwise-complete rows, long form (f1, f2, i, j, corr).

    Masked Gram sums: with missing values as zeros, the products of the value, square and presence
    matrices give every pair's count, sums and cross product at once, added up per task and
    then over tasks; one row per table row, whatever the number of columns. Values are
    taken relative to the column means, so large means do not cancel. Constant columns give null.
    """
    cols = numeric_columns(df, cols)
    p = len(cols)
    x = [F.col(f"`{c}`").cast("double") for c in cols]
    means = df.agg(*[F.avg(F.when(~F.isnan(v), v)).alias(f"m{i}") for i, v in enumerate(x)]).first()
    shift = np.array([m if m is not None else 0.0 for m in means])
    data = df.select(F.array(*[F.coalesce(v, F.lit(float("nan"))) for v in x]).alias("a"))

    def sums(pdf):
        v = stacked(pdf["a"]) - shift
        there = np.isfinite(v)
        v, m = np.where(there, v, 0.0), there.astype(float)
        return {"n": m.T @ m, "s": v.T @ m, "q": (v * v).T @ m, "c": v.T @ v}

    t = array_sums(data, ["a"], sums, {k: (p, p) for k in "nsqc"})
    n = np.maximum(t["n"], 1)
    mean = t["s"] / n                       # [i, j]: mean of i where j is there too
    dev = np.sqrt(np.maximum(t["q"] / n - mean * mean, 0))
    cov = t["c"] / n - mean * mean.T
    rows = []
    for i in range(p):
        for j in range(p):
            scale = dev[i, j] * dev[j, i]
            flat = dev[i, j] <= 1e-12 * max(abs(shift[i]), 1e-300) or dev[j, i] <= 1e-12 * max(abs(shift[j]), 1e-300)
            if t["n"][i, j]:
                rows.append((cols[i], cols[j], i, j, None if flat or scale == 0 else float(cov[i, j] / scale)))
    return df.sparkSession.createDataFrame(rows, "f1 string, f2 string, i int, j int, corr double")


def top_correlations(corr: DataFrame, k: int = 5) -> DataFrame:
    """Strongest upper-triangle pairs by |corr|; k is the report size."""
    return (corr.filter((F.col("i") < F.col("j")) & F.col("corr").isNotNull())
            .orderBy(F.abs("corr").desc(), "i", "j").limit(k)
            .select("f1", "f2", "corr"))


# ----------------------------------------------------------------- target
def target_summary(df: DataFrame, target: str) -> DataFrame:
    dtype = df.schema[target].dataType
    return df.agg(
        F.lit(target).alias("target"),
        F.lit(dtype.simpleString()).alias("data_type"),
        F.count_distinct(F.col(target)).alias("n_distinct"),
        F.count_if(is_missing(df, target)).alias("n_null"))


def value_counts(df: DataFrame, col: str) -> DataFrame:
    """Count per value, largest first, nulls excluded (ties by value)."""
    return (df.filter(F.col(col).isNotNull()).groupBy(F.col(col).alias("value"))
            .agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "value"))


def infer_task(df: DataFrame, target: str | None = None) -> DataFrame:
    """clustering without a target; numeric with > 10 distinct -> regression;
    otherwise classification."""
    spark = df.sparkSession
    if target is None:
        return spark.range(1).select(F.lit(None).cast("string").alias("target"),
                                     F.lit("clustering").alias("task"))
    numeric = role_of(df.schema[target].dataType) == "numeric"
    n_distinct = F.count_distinct(F.col(target))
    task = F.when(F.lit(numeric) & (n_distinct > 10), "regression").otherwise("classification")
    return df.agg(F.lit(target).alias("target"), task.alias("task"))


def quality_flags(df: DataFrame) -> DataFrame:
    """rows < 100; columns > rows; missing share > 0.1 -> (flag, fired)."""
    m = missing_ratio(df)
    row = m.select(
        (F.col("total_cells") / len(df.columns)).alias("n_rows"), "missing_ratio")
    return row.select(F.inline(F.array(
        F.struct(F.lit("few_rows").alias("flag"), (F.col("n_rows") < 100).alias("fired")),
        F.struct(F.lit("more_columns_than_rows").alias("flag"),
                 (F.lit(len(df.columns)) > F.col("n_rows")).alias("fired")),
        F.struct(F.lit("many_missing").alias("flag"), (F.col("missing_ratio") > 0.1).alias("fired")),
    )))


def class_imbalance(df: DataFrame, target: str, threshold: float = 3.0) -> DataFrame:
    counts = df.filter(F.col(target).isNotNull()).groupBy(target).count()
    return counts.agg(
        F.count(F.lit(1)).alias("n_classes"),
        F.max("count").alias("max_count"), F.min("count").alias("min_count"),
        (F.max("count") / F.min("count")).alias("imbalance_ratio"),
    ).withColumn("imbalanced", F.col("imbalance_ratio") > threshold)


def majority_share(df: DataFrame, target: str, threshold: float = 0.7) -> DataFrame:
    counts = df.filter(F.col(target).isNotNull()).groupBy(target).count()
    return (counts.agg((F.max("count") / F.sum("count")).alias("majority_share"))
            .withColumn("use_class_weights", F.col("majority_share") > threshold))


def mode_share(df: DataFrame, col: str) -> DataFrame:
    """Distinct count, most frequent value (ties -> smallest) and its share of all rows.

    Counts per value are a distributed groupBy; the pick of the top value is
    one more aggregate over those counts (``min_by`` on (-count, value)).
    """
    counts = df.groupBy(F.col(col).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    present = F.col("value").isNotNull()
    return counts.agg(
        F.count("value").alias("n_distinct"),
        F.min_by(F.col("value"), F.when(present, F.struct((-F.col("n")).alias("k"),
                                                           F.col("value").alias("v")))
                 ).cast("string").alias("mode_value"),
        (F.max(F.when(present, F.col("n"))) / F.sum("n")).alias("mode_share"))


def target_histogram(df: DataFrame, target: str, bins: int = 30) -> DataFrame:
    """Equal-width bins over [min, max]; the top edge falls in the last bin.

    min and max are one small aggregate brought to the driver as two scalars;
    the binning is then a plain map + groupBy.
    """
    v = F.col(target).cast("double")
    base = df.select(v.alias("v")).filter(F.col("v").isNotNull() & ~F.isnan("v"))
    lo, hi = base.agg(F.min("v"), F.max("v")).first()
    spark = df.sparkSession
    if lo is None:
        return spark.createDataFrame([], "bin int, bin_lo double, bin_hi double, n long")
    width = hi - lo
    idx = (F.least(F.floor((F.col("v") - F.lit(lo)) / F.lit(width) * bins), F.lit(bins - 1))
           if width > 0 else F.lit(0))
    counted = base.groupBy(idx.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    edges = spark.range(bins).select(F.col("id").cast("int").alias("bin"))
    return (edges.join(counted, "bin", "left")
            .select("bin",
                    (F.lit(lo) + F.lit(width) * F.col("bin") / bins).alias("bin_lo"),
                    (F.lit(lo) + F.lit(width) * (F.col("bin") + 1) / bins).alias("bin_hi"),
                    F.coalesce("n", F.lit(0)).cast("long").alias("n")))


def target_stats(df: DataFrame, target: str, key: list[str] | None = None) -> DataFrame:
    """mean, std, min, 25 %, 50 %, 75 %, max of one column as 7 rows."""
    d = describe_numeric(df.select(target, *(key or [])), [target], key=key)
    order = ["mean", "std", "min", "p25", "p50", "p75", "max"]
    return d.select(F.inline(F.array(*[
        F.struct(F.lit(i).alias("pos"), F.lit(s).alias("stat"), F.col(s).cast("double").alias("value"))
        for i, s in enumerate(order)])))


def group_describe(df: DataFrame, by: str, cols: list[str] | None = None,
                   max_cols: int | None = None) -> DataFrame:
    """mean, std, min, max of the numeric columns (the first ``max_cols`` when given) per group."""
    cols = [c for c in numeric_columns(df, cols) if c != by][:max_cols]
    wide = df.groupBy(by).agg(*[F.struct(
        F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"),
        F.min(c).cast("double").alias("min"), F.max(c).cast("double").alias("max")).alias(c)
        for c in cols])
    return wide.select(by, F.inline(F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col(f"`{c}`.*")) for c in cols])))
