"""Profiling queries with their DuckDB oracles."""

from __future__ import annotations

from autotab.operators import profile as P
from autotab.plans import fixtures as X
from autotab.plans.registry import plan

LI = f"({X.LINEITEM_SQL}) AS li"
LI_COLS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
           "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus",
           "l_shipdate", "row_id", "qty_null", "flag_null", "constant", "rare_cat",
           "big_order", "y_lin", "semi_label"]
LI_DOUBLE = {"l_quantity", "l_extendedprice", "l_discount", "l_tax", "qty_null", "y_lin"}
LI_NUMERIC = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
              "l_extendedprice", "l_discount", "l_tax", "qty_null", "constant", "big_order",
              "y_lin", "semi_label"]
CORR_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "qty_null", "constant",
             "y_lin"]


def _missing_sql(c: str) -> str:
    return f"({c} IS NULL OR isnan({c}))" if c in LI_DOUBLE else f"{c} IS NULL"


@plan("table_shape", sql=f"SELECT count(*) AS n_rows, {len(LI_COLS)} AS n_cols FROM {LI}")
def q_table_shape(spark, d):
    return P.table_shape(X.lineitem(spark, d))


@plan("column_types")
def q_column_types(spark, d):
    return P.column_figures(X.lineitem(spark, d))


@plan("null_counts", sql=" UNION ALL ".join(
    f"SELECT '{c}' AS column_name, cast(count_if({_missing_sql(c)}) as bigint) AS null_count FROM {LI}"
    for c in LI_COLS))
def q_null_counts(spark, d):
    return P.null_counts(X.lineitem(spark, d))


@plan("missing_ratio", rnd=("missing_ratio",), sql=f"""
SELECT missing_cells, n_rows * {len(LI_COLS)} AS total_cells,
       cast(missing_cells as double) / cast(n_rows * {len(LI_COLS)} as double) AS missing_ratio
FROM (SELECT cast({' + '.join(f'count_if({_missing_sql(c)})' for c in LI_COLS)} as bigint)
             AS missing_cells, count(*) AS n_rows FROM {LI})""")
def q_missing_ratio(spark, d):
    return P.missing_ratio(X.lineitem(spark, d))


DUP_COLS = ["l_returnflag", "l_quantity", "l_discount"]


@plan("duplicate_rows", sql=f"""
SELECT cast(coalesce(sum(n - 1), 0) as bigint) AS n_duplicates, count(*) AS n_distinct_rows
FROM (SELECT count(*) AS n FROM lineitem GROUP BY {', '.join(DUP_COLS)})""")
def q_duplicate_rows(spark, d):
    return P.duplicate_rows(X.table(spark, d, "lineitem").select(*DUP_COLS))


def _describe_sql(cols, source):
    return " UNION ALL ".join(
        f"""SELECT '{c}' AS column_name, count({c}) AS count, avg({c}) AS mean,
            stddev_samp({c}) AS std, cast(min({c}) as double) AS min,
            quantile_cont({c}, 0.25) AS p25, quantile_cont({c}, 0.5) AS p50,
            quantile_cont({c}, 0.75) AS p75, cast(max({c}) as double) AS max FROM {source}"""
        for c in cols)


DESC_R = ("mean", "std", "min", "p25", "p50", "p75", "max")


@plan("describe_numeric", rnd=DESC_R, sql=_describe_sql(LI_NUMERIC, LI))
def q_describe_numeric(spark, d):
    li = X.lineitem(spark, d)
    return P.describe_numeric(li, LI_NUMERIC, key=["row_id"])


def _corr_sql():
    parts = []
    for i, a in enumerate(CORR_COLS):
        for j, b in enumerate(CORR_COLS):
            if j < i:
                continue
            both = f"{a} IS NOT NULL AND {b} IS NOT NULL"
            x = f"CASE WHEN {both} THEN cast({a} as double) END"
            y = f"CASE WHEN {both} THEN cast({b} as double) END"
            corr = (f"CASE WHEN stddev_pop({x}) > 0 AND stddev_pop({y}) > 0 THEN "
                    f"covar_pop({x}, {y}) / (stddev_pop({x}) * stddev_pop({y})) END")
            parts.append(f"SELECT '{a}' AS f1, '{b}' AS f2, {i} AS i, {j} AS j, {corr} AS corr FROM {LI}")
            if i != j:
                parts.append(f"SELECT '{b}' AS f1, '{a}' AS f2, {j} AS i, {i} AS j, {corr} AS corr FROM {LI}")
    return " UNION ALL ".join(parts)


CORR_SQL = _corr_sql()


@plan("correlation_matrix", rnd=("corr",), sql=CORR_SQL)
def q_correlation_matrix(spark, d):
    return P.correlation_matrix(X.lineitem(spark, d), CORR_COLS)


@plan("top_correlations", rnd=("corr",), sql=f"""
SELECT f1, f2, corr FROM ({CORR_SQL}) WHERE i < j AND corr IS NOT NULL
ORDER BY abs(corr) DESC, i, j LIMIT 5""")
def q_top_correlations(spark, d):
    return P.top_correlations(P.correlation_matrix(X.lineitem(spark, d), CORR_COLS), 5)


@plan("target_summary", sql="""
SELECT 'o_orderstatus' AS target, 'string' AS data_type,
       count(DISTINCT o_orderstatus) AS n_distinct,
       cast(count_if(o_orderstatus IS NULL) as bigint) AS n_null FROM orders""")
def q_target_summary(spark, d):
    return P.target_summary(X.table(spark, d, "orders"), "o_orderstatus")


@plan("value_counts", sql=f"""
SELECT flag_null AS value, count(*) AS n FROM {LI} WHERE flag_null IS NOT NULL
GROUP BY flag_null ORDER BY n DESC, value""")
def q_value_counts(spark, d):
    return P.value_counts(X.lineitem(spark, d), "flag_null")


INFER_TARGETS = [("l_discount", True), ("l_linenumber", True), ("flag_null", False),
                 ("y_lin", True)]


@plan("infer_task", sql=" UNION ALL ".join(
    f"""SELECT '{t}' AS target, CASE WHEN {'true' if num else 'false'} AND count(DISTINCT {t}) > 10
        THEN 'regression' ELSE 'classification' END AS task FROM {LI}""" for t, num in INFER_TARGETS))
def q_infer_task(spark, d):
    li = X.lineitem(spark, d)
    out = None
    for t, _ in INFER_TARGETS:
        r = P.infer_task(li, t)
        out = r if out is None else out.unionByName(r)
    return out


@plan("quality_flags", sql="""
SELECT * FROM (
  SELECT 'few_rows' AS flag, n < 100 AS fired FROM (SELECT count(*) AS n FROM labels)
  UNION ALL SELECT 'more_columns_than_rows', 3 > n FROM (SELECT count(*) AS n FROM labels)
  UNION ALL SELECT 'many_missing', cast(m as double) / (n * 3) > 0.1 FROM (
    SELECT count(*) AS n, count_if(doc_id IS NULL) + count_if(quality IS NULL)
           + count_if(toxic IS NULL) AS m FROM labels))""")
def q_quality_flags(spark, d):
    return P.quality_flags(X.table(spark, d, "labels"))


@plan("class_imbalance", rnd=("imbalance_ratio",), sql="""
SELECT count(*) AS n_classes, max(n) AS max_count, min(n) AS min_count,
       cast(max(n) as double) / min(n) AS imbalance_ratio,
       cast(max(n) as double) / min(n) > 3 AS imbalanced
FROM (SELECT quality, count(*) AS n FROM labels WHERE quality IS NOT NULL GROUP BY quality)""")
def q_class_imbalance(spark, d):
    return P.class_imbalance(X.table(spark, d, "labels"), "quality")


@plan("majority_share", rnd=("majority_share",), sql="""
SELECT cast(max(n) as double) / sum(n) AS majority_share,
       cast(max(n) as double) / sum(n) > 0.7 AS use_class_weights
FROM (SELECT quality, count(*) AS n FROM labels WHERE quality IS NOT NULL GROUP BY quality)""")
def q_majority_share(spark, d):
    return P.majority_share(X.table(spark, d, "labels"), "quality")


@plan("mode_share", rnd=("mode_share",), sql=f"""
SELECT (SELECT count(DISTINCT flag_null) FROM {LI}) AS n_distinct,
       (SELECT flag_null FROM {LI} WHERE flag_null IS NOT NULL GROUP BY flag_null
        ORDER BY count(*) DESC, flag_null LIMIT 1) AS mode_value,
       (SELECT cast(max(n) as double) FROM (SELECT count(*) AS n FROM {LI}
         WHERE flag_null IS NOT NULL GROUP BY flag_null)) / (SELECT count(*) FROM {LI}) AS mode_share""")
def q_mode_share(spark, d):
    return P.mode_share(X.lineitem(spark, d), "flag_null")


@plan("target_histogram", rnd=("bin_lo", "bin_hi"), digits=4, sql="""
WITH r AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders),
b AS (SELECT cast(least(floor((o_totalprice - lo) / (hi - lo) * 30), 29) as integer) AS bin
      FROM orders, r),
c AS (SELECT bin, count(*) AS n FROM b GROUP BY bin)
SELECT g.bin, lo + (hi - lo) * g.bin / 30 AS bin_lo, lo + (hi - lo) * (g.bin + 1) / 30 AS bin_hi,
       cast(coalesce(c.n, 0) as bigint) AS n
FROM (SELECT cast(range as integer) AS bin FROM range(30)) g CROSS JOIN r
LEFT JOIN c ON c.bin = g.bin""")
def q_target_histogram(spark, d):
    return P.target_histogram(X.table(spark, d, "orders"), "o_totalprice", 30)


@plan("target_stats", rnd=("value",), digits=4, sql="""
SELECT * FROM (
  SELECT 0 AS pos, 'mean' AS stat, avg(o_totalprice) AS value FROM orders
  UNION ALL SELECT 1, 'std', stddev_samp(o_totalprice) FROM orders
  UNION ALL SELECT 2, 'min', min(o_totalprice) FROM orders
  UNION ALL SELECT 3, 'p25', quantile_cont(o_totalprice, 0.25) FROM orders
  UNION ALL SELECT 4, 'p50', quantile_cont(o_totalprice, 0.5) FROM orders
  UNION ALL SELECT 5, 'p75', quantile_cont(o_totalprice, 0.75) FROM orders
  UNION ALL SELECT 6, 'max', max(o_totalprice) FROM orders)""")
def q_target_stats(spark, d):
    return P.target_stats(X.table(spark, d, "orders"), "o_totalprice", key=["o_orderkey"])


GD_COLS = ["event_id", "user_id", "value", "spiked"]


@plan("group_describe", rnd=("mean", "std", "min", "max"), digits=4, sql=" UNION ALL ".join(
    f"""SELECT truth, '{c}' AS column_name, avg({c}) AS mean, stddev_samp({c}) AS std,
        cast(min({c}) as double) AS min, cast(max({c}) as double) AS max
        FROM ({X.EVENTS_SQL}) GROUP BY truth""" for c in GD_COLS))
def q_group_describe(spark, d):
    return P.group_describe(X.events(spark, d).select("truth", *GD_COLS), "truth")
