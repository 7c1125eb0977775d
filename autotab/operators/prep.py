"""Preparation: pruning, label coding, imputation, scaling, one-hot, assembly,
variance filter -- fitted once, applied as a persistable ``PipelineModel``.

Fitting reads only small aggregates (one row per column or category) back to
the driver. The fitted model consists of built-in stages only
(``SQLTransformer`` with the fitted constants, ``StringIndexerModel``,
``OneHotEncoderModel``, ``VectorAssembler``, ``VectorSlicer``), so
``PipelineModel.save/load`` works and ``transform`` is a plain projection.
"""

from __future__ import annotations

import datetime
import decimal
from dataclasses import dataclass, field

from pyspark.ml import PipelineModel
from pyspark.ml.feature import (OneHotEncoder, SQLTransformer, StringIndexer, StringIndexerModel, VectorAssembler,
                                VectorSlicer)
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from autotab.operators.profile import (categorical_columns, is_missing, numeric_columns,
                                       role_of)
from autotab.operators.ranking import column_quantiles, column_quantiles_with
from autotab.session import spread

MAX_CLASSES = 10_000          # label table is broadcast; bounded by this check
HIGH_CARDINALITY = 50
VARIANCE_THRESHOLD = 0.01
VARIANCE_MIN_FEATURES = 10


def _q(name: str) -> str:
    return f"`{name}`"


# ------------------------------------------------------------- pruning
def constant_columns(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """(column_name, is_constant): at most one distinct non-null value.

    min == max (or no value at all) decides it in one cheap pass; no
    distinct counting needed.
    """
    cols = cols or df.columns
    orderable = [c for c in cols if not isinstance(
        df.schema[c].dataType, (T.ArrayType, T.MapType, T.StructType))]
    wide = df.agg(*[((F.count(c) == 0) | (F.min(c) == F.max(c))).alias(c) for c in orderable])
    return wide.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col(_q(c)).alias("is_constant"))
        for c in orderable])))


def high_cardinality_columns(df: DataFrame, cols: list[str] | None = None,
                             limit: int = HIGH_CARDINALITY) -> DataFrame:
    """(column_name, high_cardinality) for string columns: > ``limit`` distinct.

    A HyperLogLog pass (``approx_count_distinct``, rsd 5 %) settles columns far
    from the limit; only columns whose estimate is within 25 % of it (five
    standard errors) get an exact distributed count (groupBy + count), so wide
    or huge tables never run one exact distinct per column.
    """
    cols = categorical_columns(df, cols)
    if not cols:
        return df.sparkSession.createDataFrame([], "column_name string, high_cardinality boolean")
    est = df.agg(*[F.approx_count_distinct(c, 0.05).alias(c) for c in cols]).first().asDict()
    return df.sparkSession.createDataFrame(
        sorted(_settle_cardinality(df, est, limit).items()), "column_name string, high_cardinality boolean")


def _settle_cardinality(df: DataFrame, estimates: dict, limit: int) -> dict:
    """{column: more than ``limit`` distinct values} from HyperLogLog estimates, with an exact
    distributed count for those near the limit."""
    out = {}
    for c, est in estimates.items():
        if limit * 0.75 <= est <= limit * 1.25:
            out[c] = df.select(c).filter(F.col(c).isNotNull()).distinct().count() > limit
        else:
            out[c] = est > limit
    return out


def _pruned(df: DataFrame, candidates: list[str], limit: int = HIGH_CARDINALITY) -> tuple[set, set]:
    """(constant columns, string columns of high cardinality) from one scan of the table."""
    plain = [c for c in candidates if not isinstance(df.schema[c].dataType, (T.ArrayType, T.MapType, T.StructType))]
    cats = categorical_columns(df, candidates)
    row = df.agg(*[((F.count(c) == 0) | (F.min(c) == F.max(c))).alias(f"k{i}") for i, c in enumerate(plain)],
                 *[F.approx_count_distinct(c, 0.05).alias(f"d{i}") for i, c in enumerate(cats)]).first()
    constant = {c for i, c in enumerate(plain) if row[f"k{i}"]}
    wide = _settle_cardinality(df, {c: row[f"d{i}"] for i, c in enumerate(cats) if c not in constant}, limit)
    return constant, {c for c, high in wide.items() if high}


def drop_constant(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    flags = constant_columns(df).filter("is_constant").collect()
    return df.drop(*[r.column_name for r in flags if r.column_name not in keep])


def drop_high_cardinality(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    flags = high_cardinality_columns(df).filter("high_cardinality").collect()
    return df.drop(*[r.column_name for r in flags if r.column_name not in keep])


def drop_null_target(df: DataFrame, target: str) -> DataFrame:
    return df.filter(~is_missing(df, target))


# ------------------------------------------------------------ label code
def label_classes(df: DataFrame, target: str) -> DataFrame:
    """(label, value): sorted distinct classes in the column's own type order
    coded 0..k-1. Distinct is a distributed aggregate; the numbering window
    runs over the class table only, whose size is checked."""
    classes = df.select(F.col(target).alias("value")).filter(F.col("value").isNotNull()).distinct()
    n = classes.count()
    if n > MAX_CLASSES:
        raise ValueError(f"{target}: {n} classes exceed {MAX_CLASSES}; not a classification target")
    return classes.select((F.dense_rank().over(Window.orderBy("value")) - 1).cast("double")
                          .alias("label"), "value")


def encode_label(df: DataFrame, target: str, classes: DataFrame | None = None,
                 out: str = "label") -> DataFrame:
    classes = classes if classes is not None else label_classes(df, target)
    small = classes.select(F.col("value").alias("_cls"), F.col("label").alias(out))
    return df.join(small, F.col(target) == F.col("_cls"), "left").drop("_cls")


def decode_label(df: DataFrame, classes: DataFrame, code: str = "prediction",
                 out: str = "predicted_value") -> DataFrame:
    small = classes.select(F.col("label").alias("_code"), F.col("value").alias(out))
    return df.join(small, F.col(code) == F.col("_code"), "left").drop("_code")


# --------------------------------------------------------- fitted stats
def column_medians(df: DataFrame, cols: list[str], key: list[str] | None = None) -> dict:
    """Exact median per numeric column (NaN and null ignored)."""
    qv = column_quantiles(df, cols, [0.5])
    return {c: qv[c].get(0.5) for c in cols}


def column_modes(df: DataFrame, cols: list[str]) -> dict:
    """Most frequent non-null value per column, ties -> smallest.

    Distributed counts per (column, value); the pick is one aggregate per
    column over those counts."""
    if not cols:
        return {}
    long_df = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value"))
        for c in cols])).alias("kv")).select("kv.*").filter(F.col("value").isNotNull())
    counts = long_df.groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("n"))
    top = counts.groupBy("column_name").agg(
        F.min_by("value", F.struct((-F.col("n")).alias("k"), F.col("value").alias("v"))).alias("mode"))
    return {r.column_name: r.mode for r in top.collect()}


def category_counts(df: DataFrame, cols: list[str]) -> dict:
    """{column: {value: rows}} of string columns of few values (pruned before)."""
    if not cols:
        return {}
    counts = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value"))
        for c in cols])).alias("kv")).select("kv.*").groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("n"))
    out: dict = {c: {} for c in cols}
    for r in counts.collect():
        out[r.column_name][r.value] = r.n
    return out


def _fitted_numbers(df: DataFrame, num: list[str]) -> tuple[dict, dict, int]:
    """(medians, {column: (mean, population std) after filling in the median}, rows): the moments
    ride along in the first scan of the quantile search; filling adds a group of equal values."""
    extra = [F.count(F.lit(1)).alias("rows")]
    for i, c in enumerate(num):
        x = F.when(~is_missing(df, c), F.col(c).cast("double"))
        extra.append(F.struct(F.count(x).alias("n"), F.avg(x).alias("m"), F.var_pop(x).alias("v")).alias(f"m{i}"))
    if not num:
        return {}, {}, df.count()
    found, row = column_quantiles_with(df, num, [0.5], extra)
    medians = {c: found[c].get(0.5) for c in num}
    stats = {}
    for i, c in enumerate(num):
        n, mean, var = row[f"m{i}"]
        if not n:
            stats[c] = (None, None)
            continue
        gap, total = row["rows"] - n, row["rows"]
        filled = (n * mean + gap * medians[c]) / total
        second = (n * (var + (mean - filled) ** 2) + gap * (medians[c] - filled) ** 2) / total
        stats[c] = (filled, second ** 0.5)
    return medians, stats, row["rows"]


def impute_median(df: DataFrame, cols: list[str], key: list[str] | None = None,
                  medians: dict | None = None) -> DataFrame:
    medians = medians if medians is not None else column_medians(df, cols, key)
    return df.withColumns({c: F.when(is_missing(df, c), F.lit(medians.get(c)))
                           .otherwise(F.col(c).cast("double")) for c in cols})


def impute_mode(df: DataFrame, cols: list[str], modes: dict | None = None) -> DataFrame:
    modes = modes if modes is not None else column_modes(df, cols)
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(modes.get(c))) for c in cols})


def scale_stats(df: DataFrame, cols: list[str]) -> dict:
    if not cols:
        return {}
    row = df.agg(*[F.struct(F.avg(c).alias("m"), F.stddev_pop(c).alias("s")).alias(c)
                   for c in cols]).first()
    return {c: (row[c]["m"], row[c]["s"]) for c in cols}


def standard_scale(df: DataFrame, cols: list[str], stats: dict | None = None) -> DataFrame:
    """(x - mean) / population std; a zero std divides by 1."""
    stats = stats if stats is not None else scale_stats(df, cols)
    return df.withColumns({c: (F.col(c) - F.lit(stats[c][0])) /
                           F.lit(stats[c][1] if stats[c][1] else 1.0) for c in cols})


# --------------------------------------------------------------- prepare
@dataclass
class PrepReport:
    target: str | None
    task: str
    numeric: list[str]
    categorical: list[str]
    dropped_constant: list[str]
    dropped_high_cardinality: list[str]
    dropped_type: list[str]
    raw_feature_names: list[str]
    kept_indices: list[int]
    feature_names: list[str]
    variances: list[float] = field(default_factory=list)
    scoring_model: object = None   # same transform without the label (for unlabelled rows)


def infer_task_value(df: DataFrame, target: str | None) -> str:
    if target is None:
        return "clustering"
    if role_of(df.schema[target].dataType) == "numeric":
        n = df.agg(F.count_distinct(target)).first()[0]
        return "regression" if n > 10 else "classification"
    return "classification"


def sql_literal(v) -> str:
    """A SQL literal of the value's own type."""
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return "TRUE" if v else "FALSE"
    if isinstance(v, str):
        return "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'"
    if isinstance(v, datetime.datetime):
        return f"TIMESTAMP '{v.isoformat(sep=' ')}'"
    if isinstance(v, datetime.date):
        return f"DATE '{v.isoformat()}'"
    if isinstance(v, int):
        return str(v)
    if isinstance(v, decimal.Decimal):
        return f"{v}BD"
    return repr(float(v)) + "D"


def prepare(df: DataFrame, target: str | None = None, ids: list[str] | None = None,
            select: bool = True, fit_on: DataFrame | None = None, task: str | None = None,
            classes: DataFrame | None = None, vector_col: str | None = None):
    """Fit the preparation on ``fit_on`` (default ``df``) and apply it to ``df``.

    Returns ``(prepared, model, report)``; ``prepared`` holds ``ids``,
    ``features`` and, with a target, ``label``.
    """
    ids = list(ids or [])
    fit_df = fit_on if fit_on is not None else df
    keep = tuple(ids) + ((target,) if target else ())
    if target:
        fit_df = drop_null_target(fit_df, target)
        df = drop_null_target(df, target)
    # The fit reads the training rows about five times (pruning, quantile scans, category
    # counts): keep them in executor storage for the duration; lost blocks are recomputed.
    owned = not fit_df.is_cached
    if owned:
        fit_df = spread(fit_df)
    candidates = [c for c in df.columns if c not in keep and c != vector_col]

    const, hi_card = _pruned(fit_df, candidates)
    cand3 = [c for c in candidates if c not in const and c not in hi_card]
    num = numeric_columns(fit_df, cand3)
    cat = categorical_columns(fit_df, cand3)
    other = [c for c in cand3 if c not in num and c not in cat]

    task = task or infer_task_value(fit_df, target)
    medians, stats, n_rows = _fitted_numbers(fit_df, num)
    counts = category_counts(fit_df, cat)
    modes = {c: min(((-n, v) for v, n in counts[c].items() if v is not None), default=(0, None))[1] for c in cat}

    # One projection carries every fitted constant: impute, scale, mode-fill.
    exprs = []
    for c in num:
        m, s = stats[c]
        miss = f"({_q(c)} IS NULL" + (f" OR isnan({_q(c)}))" if isinstance(
            fit_df.schema[c].dataType, (T.FloatType, T.DoubleType)) else ")")
        exprs.append(f"(CASE WHEN {miss} THEN {sql_literal(medians.get(c))} ELSE "
                     f"CAST({_q(c)} AS DOUBLE) END - {sql_literal(m)}) / "
                     f"{sql_literal(s if s else 1.0)} AS {_q('__n_' + c)}")
    for c in cat:
        exprs.append(f"coalesce({_q(c)}, {sql_literal(modes.get(c))}) AS {_q('__c_' + c)}")
    label_expr = ""
    if target and task == "classification":
        classes = classes if classes is not None else label_classes(fit_df, target)
        cases = " ".join(f"WHEN {_q(target)} = {sql_literal(r.value)} THEN {r.label!r}D"
                         for r in classes.orderBy("label").collect())
        label_expr = f", CASE {cases} END AS label"
    elif target:
        label_expr = f", CAST({_q(target)} AS DOUBLE) AS label"
    select_cols = ", ".join([_q(i) for i in ids] + exprs + ([_q(vector_col)] if vector_col else []))
    sql_stage = SQLTransformer(statement=f"SELECT {select_cols}{label_expr} FROM __THIS__")

    stages = [sql_stage]
    assembled = [f"__n_{c}" for c in num]
    names = list(num)
    if cat:
        labels_of = [sorted(v for v in counts[c] if v is not None) for c in cat]
        indexers = [StringIndexerModel.from_labels(labels, inputCol=f"__c_{c}", outputCol=f"__i_{c}",
                                                   handleInvalid="keep") for c, labels in zip(cat, labels_of)]
        ohe = OneHotEncoder(inputCols=[f"__i_{c}" for c in cat], outputCols=[f"__o_{c}" for c in cat],
                            dropLast=True)
        # reads the labels, no rows
        ohe_model = ohe.fit(PipelineModel(stages=[sql_stage, *indexers]).transform(fit_df))
        stages += [*indexers, ohe_model]
        assembled += [f"__o_{c}" for c in cat]
        for c, labels in zip(cat, labels_of):
            names += [f"{c}_{v}" for v in labels]
    if vector_col:
        assembled.append(vector_col)
        dim = len(fit_df.select(vector_col).first()[0])
        names += [f"{vector_col}_{i}" for i in range(dim)]
    stages.append(VectorAssembler(inputCols=assembled, outputCol="__raw_features",
                                  handleInvalid="keep"))

    kept = list(range(len(names)))
    variances = []
    if select and len(names) > VARIANCE_MIN_FEATURES:
        # standardised columns vary by 1 (or not at all), a 0/1 column by p (1 - p)
        variances = [1.0 if stats[c][1] else 0.0 for c in num]
        for c, labels in zip(cat, labels_of if cat else []):
            for v in labels:
                hits = counts[c][v] + (counts[c].get(None, 0) if v == modes[c] else 0)
                variances.append(hits / n_rows * (1 - hits / n_rows))
        if vector_col:
            summ = fit_df.select(Summarizer.metrics("variance", "count").summary(F.col(vector_col)).alias("s")).first()["s"]
            variances += [float(v) * (summ["count"] - 1) / max(summ["count"], 1) for v in summ["variance"]]
        kept = [i for i, v in enumerate(variances) if v > VARIANCE_THRESHOLD]
    final = stages + [VectorSlicer(inputCol="__raw_features", outputCol="features", indices=kept),
                      SQLTransformer(statement="SELECT " + ", ".join(
                          [_q(i) for i in ids] + ["features"] + (["label"] if target else []))
                          + " FROM __THIS__")]
    model = PipelineModel(stages=final)
    no_label = SQLTransformer(statement=f"SELECT {select_cols} FROM __THIS__")
    scoring = PipelineModel(stages=[no_label] + final[1:-1] + [SQLTransformer(
        statement="SELECT " + ", ".join([_q(i) for i in ids] + ["features"]) + " FROM __THIS__")])
    if owned:
        fit_df.unpersist()
    report = PrepReport(target, task, num, cat, sorted(const), sorted(hi_card), other, names, kept,
                        [names[i] for i in kept], variances, scoring)
    return model.transform(df), model, report


def one_hot(df: DataFrame, cols: list[str], keep: list[str] | None = None,
            fit_on: DataFrame | None = None) -> DataFrame:
    """Wide 0/1 columns ``<col>_<category>``, categories sorted, none dropped;
    a value unseen at fit time (or null) gives all zeros. Built-in
    ``StringIndexer(alphabetAsc, keep)`` + ``OneHotEncoder(dropLast)``: the
    dropped last slot is exactly the "unseen" bucket."""
    from pyspark.ml.functions import vector_to_array
    fit_on = fit_on if fit_on is not None else df
    idx = StringIndexer(inputCols=cols, outputCols=[f"__i_{c}" for c in cols],
                        stringOrderType="alphabetAsc", handleInvalid="keep").fit(fit_on)
    ohe = OneHotEncoder(inputCols=[f"__i_{c}" for c in cols], outputCols=[f"__o_{c}" for c in cols],
                        dropLast=True).fit(idx.transform(fit_on))
    out = ohe.transform(idx.transform(df))
    sel = []
    for c, labels in zip(cols, idx.labelsArray):
        arr = vector_to_array(F.col(f"__o_{c}"))
        sel += [arr[i].alias(f"{c}_{v}") for i, v in enumerate(labels)]
    return out.select(*(keep or []), *sel)
