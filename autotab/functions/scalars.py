"""Column functions: pure expressions, evaluated inside
whole-stage codegen, no Python per row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Default calibration factor per task type and the fallback.
DEFAULT_FACTORS = {
    "classification": 0.85,
    "regression": 0.90,
    "clustering": 0.80,
    "dimensionality_reduction": 0.85,
    "anomaly_detection": 0.75,
}
DEFAULT_FACTOR = 0.85

# Metric prefix per task type in formatted estimates.
METRIC_PREFIX = {
    "regression": "R²: ",
    "clustering": "Silhouette: ",
    "dimensionality_reduction": "Variance: ",
    "anomaly_detection": "Precision: ",
}

# Quality score bands.
QUALITY_BANDS = [(70, "High Quality"), (50, "Standard")]
QUALITY_LOW = "Action Required"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


#: A number as text: no type suffixes (Spark's cast would take "3d" or "0.3f").
NUMBER_TEXT = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"


def _num(s: Column) -> Column:
    return F.when(s.rlike(NUMBER_TEXT), s.try_cast("double"))


def parse_estimate(text) -> Column:
    """'85-90%' -> 0.875; '0.6-0.7' -> 0.65; '80%' -> 0.8; '0.5' -> 0.5;
    anything unreadable (or a leading minus, read as a range) -> 0.5."""
    s = _c(text)
    parts = F.split(F.replace(s, F.lit("%"), F.lit("")), "-")
    p0 = _num(F.try_element_at(parts, F.lit(1)))
    p1 = _num(F.try_element_at(parts, F.lit(2)))
    has_pct = F.contains(s, F.lit("%"))
    rng = F.when(p0.isNull() | p1.isNull(), F.lit(0.5)).otherwise(
        (p0 + p1) / F.when(has_pct, F.lit(200.0)).otherwise(F.lit(2.0)))
    pct = _num(F.replace(s, F.lit("%"), F.lit("")))
    return (F.when(s.isNull(), F.lit(0.5))
            .when(F.contains(s, F.lit("-")), rng)
            .when(has_pct, F.coalesce(pct / 100.0, F.lit(0.5)))
            .otherwise(F.coalesce(_num(s), F.lit(0.5))))


def _trunc100(x: Column) -> Column:
    return (x * 100).try_cast("long")


def format_band(value) -> Column:
    """Estimate -> 'low-high%' with +-4 points clamped to 0..100; a text
    range without '%' passes through; unreadable text passes through."""
    s = _c(value).cast("string")
    pct = _num(F.trim(F.replace(s, F.lit("%"), F.lit("")))) / 100.0
    n = (F.when(F.contains(s, F.lit("%")), pct)
         .when(F.contains(s, F.lit("-")), F.lit(None).cast("double"))
         .otherwise(_num(F.trim(s))))
    band = F.concat(F.greatest(F.lit(0), _trunc100(n) - 4).cast("string"), F.lit("-"),
                    F.least(F.lit(100), _trunc100(n) + 4).cast("string"), F.lit("%"))
    return F.when(n.isNull(), s).otherwise(band)


def format_metric(value, task) -> Column:
    """format_band with the task's metric prefix."""
    t = _c(task)
    band = format_band(value)
    out = F.when(t == "classification", band)
    for k, p in METRIC_PREFIX.items():
        out = out.when(t == k, F.concat(F.lit(p), band))
    return out.otherwise(F.lit("N/A"))


def format_calibrated(value, task) -> Column:
    """classification: 'max(50,low)-min(95,high)%' with low/high = trunc of
    (c -+ 0.05) * 100; regression: 'max(0.1,c-0.1)-min(0.95,c+0.1)' to 2
    decimals."""
    c = _c(value)
    cls = F.concat(F.greatest(F.lit(50), ((c - 0.05) * 100).try_cast("long")).cast("string"),
                   F.lit("-"),
                   F.least(F.lit(95), ((c + 0.05) * 100).try_cast("long")).cast("string"),
                   F.lit("%"))
    # format_number rounds half-even on the exact binary value, like Python's
    # "{:.2f}" (format_string rounds half-up); values stay below 1000, so no
    # grouping separator appears.
    reg = F.concat(F.format_number(F.greatest(F.lit(0.1), c - 0.1), 2), F.lit("-"),
                   F.format_number(F.least(F.lit(0.95), c + 0.1), 2))
    t = _c(task)
    return F.when(t == "classification", cls).when(t == "regression", reg)


def truncate_reason(text, n: int = 100) -> Column:
    s = _c(text)
    return F.when(F.length(s) > n, F.concat(F.substring(s, 1, n), F.lit("..."))).otherwise(s)


def quality_band(score) -> Column:
    s = _c(score)
    out = None
    for lo, name in QUALITY_BANDS:
        out = F.when(s >= lo, name) if out is None else out.when(s >= lo, name)
    return out.otherwise(QUALITY_LOW)


def file_extension(path) -> Column:
    return F.lower(F.substring_index(_c(path), ".", -1))


def task_factor(task) -> Column:
    m = F.create_map(*[x for k, v in DEFAULT_FACTORS.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(F.element_at(m, _c(task)), F.lit(DEFAULT_FACTOR))
