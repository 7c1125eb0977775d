"""Preparation and split queries with DuckDB oracles."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from autotab.operators import prep as R
from autotab.operators import split as S
from autotab.plans import fixtures as X
from autotab.plans.profile_plans import LI, LI_COLS
from autotab.plans.registry import plan

PART_STR = ["p_name", "p_brand", "p_type"]


@plan("drop_constant", sql=" UNION ALL ".join(
    f"SELECT '{c}' AS column_name, (count({c}) = 0 OR min({c}) = max({c})) AS is_constant FROM {LI}"
    for c in LI_COLS))
def q_drop_constant(spark, d):
    return R.constant_columns(X.lineitem(spark, d))


@plan("drop_high_cardinality", sql=" UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count(DISTINCT {c}) > 50 AS high_cardinality FROM part"
    for c in PART_STR))
def q_drop_high_cardinality(spark, d):
    return R.high_cardinality_columns(X.table(spark, d, "part").select(*PART_STR))


DROP_COLS = ["row_id", "l_quantity", "constant", "l_returnflag"]


@plan("drop_constant_applied", sql=f"SELECT row_id, l_quantity, l_returnflag FROM {LI}")
def q_drop_constant_applied(spark, d):
    return R.drop_constant(X.lineitem(spark, d).select(*DROP_COLS), keep=("row_id",))


@plan("drop_high_cardinality_applied", sql="SELECT p_partkey, p_brand FROM part")
def q_drop_high_cardinality_applied(spark, d):
    """p_name goes (one value per part), p_brand stays (25 values)."""
    return R.drop_high_cardinality(X.table(spark, d, "part").select("p_partkey", "p_name", "p_brand"))


@plan("drop_null_target", sql=f"SELECT row_id, semi_label FROM {LI} WHERE semi_label IS NOT NULL")
def q_drop_null_target(spark, d):
    return R.drop_null_target(X.lineitem(spark, d), "semi_label").select("row_id", "semi_label")


CLASSES_SQL = """(SELECT value, cast(dense_rank() OVER (ORDER BY value) - 1 as double) AS label
  FROM (SELECT DISTINCT o_orderstatus AS value FROM orders))"""


@plan("encode_label", sql=f"""
SELECT o_orderkey, o_orderstatus, c.label FROM orders JOIN {CLASSES_SQL} c
ON orders.o_orderstatus = c.value""")
def q_encode_label(spark, d):
    o = X.table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    return R.encode_label(o, "o_orderstatus")


@plan("decode_label", sql=f"""
SELECT s.row_id, s.prediction, c.value AS predicted_value
FROM ({X.SCORED_MULTI_SQL}) s LEFT JOIN {CLASSES_SQL} c ON s.prediction = c.label""")
def q_decode_label(spark, d):
    classes = R.label_classes(X.table(spark, d, "orders"), "o_orderstatus")
    s = X.scored_multi(spark, d).select("row_id", "prediction")
    return R.decode_label(s, classes, "prediction", "predicted_value")


@plan("impute_median", rnd=("qty_null",), sql=f"""
SELECT row_id, coalesce(qty_null, (SELECT quantile_cont(qty_null, 0.5) FROM {LI})) AS qty_null
FROM {LI}""")
def q_impute_median(spark, d):
    li = X.lineitem(spark, d).select("row_id", "qty_null")
    return R.impute_median(li, ["qty_null"], key=["row_id"])


@plan("impute_mode", sql=f"""
SELECT row_id, coalesce(flag_null, (SELECT flag_null FROM {LI} WHERE flag_null IS NOT NULL
  GROUP BY flag_null ORDER BY count(*) DESC, flag_null LIMIT 1)) AS flag_null FROM {LI}""")
def q_impute_mode(spark, d):
    return R.impute_mode(X.lineitem(spark, d).select("row_id", "flag_null"), ["flag_null"])


SCALE_COLS = ["l_quantity", "l_extendedprice", "l_tax", "constant"]


@plan("standard_scale", rnd=tuple(SCALE_COLS), sql="SELECT row_id, " + ", ".join(
    f"({c} - avg({c}) OVER ()) / coalesce(nullif(stddev_pop({c}) OVER (), 0), 1) AS {c}"
    for c in SCALE_COLS) + f" FROM {LI}")
def q_standard_scale(spark, d):
    li = X.lineitem(spark, d).select("row_id", *SCALE_COLS)
    return R.standard_scale(li, SCALE_COLS)


OHE = {"l_returnflag": ["A", "N", "R"], "l_linestatus": ["F", "O"]}


@plan("one_hot", sql="SELECT row_id, " + ", ".join(
    f"CASE WHEN {c} = '{v}' THEN 1.0 ELSE 0.0 END AS {c}_{v}" for c, vs in OHE.items() for v in vs)
    + f" FROM {LI}")
def q_one_hot(spark, d):
    li = X.lineitem(spark, d)
    return R.one_hot(li, list(OHE), keep=["row_id"])


PREP_NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "qty_null"]
PREP_CAT = ["l_returnflag", "l_linestatus", "flag_null", "rare_cat"]


def _prep_input(spark, d):
    return X.lineitem(spark, d).select("row_id", *PREP_NUM, "constant", *PREP_CAT, "big_order")


def _variance_sql():
    med = f"(SELECT quantile_cont(qty_null, 0.5) FROM {LI})"
    mode = (f"(SELECT flag_null FROM {LI} WHERE flag_null IS NOT NULL GROUP BY flag_null "
            f"ORDER BY count(*) DESC, flag_null LIMIT 1)")
    imp = (f"(SELECT l_quantity, l_extendedprice, l_discount, l_tax, coalesce(qty_null, {med}) AS qty_null, "
           f"l_returnflag, l_linestatus, coalesce(flag_null, {mode}) AS flag_null, rare_cat FROM {LI}) AS imp")
    parts = []
    pos = 0
    for c in PREP_NUM:
        parts.append(f"SELECT {pos} AS position, '{c}' AS feature, "
                     f"var_pop(({c} - m) / coalesce(nullif(s, 0), 1)) AS variance FROM "
                     f"(SELECT {c}, avg({c}) OVER () AS m, stddev_pop({c}) OVER () AS s FROM {imp})")
        pos += 1
    cats = {"l_returnflag": ["A", "N", "R"], "l_linestatus": ["F", "O"],
            "flag_null": ["A", "N", "R"], "rare_cat": ["common", "rare"]}
    for c, vs in cats.items():
        for v in vs:
            parts.append(f"SELECT {pos} AS position, '{c}_{v}' AS feature, "
                         f"var_pop(CASE WHEN {c} = '{v}' THEN 1.0 ELSE 0.0 END) AS variance FROM {imp}")
            pos += 1
    return (f"SELECT position, feature, variance, variance > 0.01 AS kept FROM ("
            + " UNION ALL ".join(parts) + ")")


@plan("variance_filter", rnd=("variance",), sql=_variance_sql())
def q_variance_filter(spark, d):
    _, _, rep = R.prepare(_prep_input(spark, d), "big_order", ids=["row_id"])
    rows = [(i, n, float(v), i in rep.kept_indices)
            for i, (n, v) in enumerate(zip(rep.raw_feature_names, rep.variances))]
    return spark.createDataFrame(rows, "position int, feature string, variance double, kept boolean")


def _prepared_sql():
    """Imputed columns and, per raw feature in order, its expression."""
    med = f"(SELECT quantile_cont(qty_null, 0.5) FROM {LI})"
    mode = (f"(SELECT flag_null FROM {LI} WHERE flag_null IS NOT NULL GROUP BY flag_null "
            f"ORDER BY count(*) DESC, flag_null LIMIT 1)")
    imp = (f"(SELECT row_id, big_order, l_quantity, l_extendedprice, l_discount, l_tax, "
           f"coalesce(qty_null, {med}) AS qty_null, l_returnflag, l_linestatus, "
           f"coalesce(flag_null, {mode}) AS flag_null, rare_cat FROM {LI}) AS imp")
    exprs = [f"({c} - avg({c}) OVER ()) / coalesce(nullif(stddev_pop({c}) OVER (), 0), 1)" for c in PREP_NUM]
    cats = {"l_returnflag": ["A", "N", "R"], "l_linestatus": ["F", "O"],
            "flag_null": ["A", "N", "R"], "rare_cat": ["common", "rare"]}
    exprs += [f"CASE WHEN {c} = '{v}' THEN 1.0 ELSE 0.0 END" for c, vs in cats.items() for v in vs]
    return imp, exprs


def _features_sql(extra: str, kept: bool) -> str:
    imp, exprs = _prepared_sql()
    row = ", ".join(f"round(cast({e} as double), 5)" for e in exprs)
    src = f"(SELECT row_id, big_order, [{row}] AS v FROM {imp})"
    if not kept:
        return f"SELECT row_id, v AS features{extra} FROM {src}"
    return (f"SELECT row_id, list_filter(v, lambda x, i: list_contains(k, i)) AS features{extra} FROM {src}, "
            f"(SELECT list(position + 1) AS k FROM ({_variance_sql()}) WHERE kept)")


def _rounded():
    # adding 0.0 turns a rounded -0.0 into 0.0, which hash alike nowhere else
    return F.transform(vector_to_array("features"), lambda x: F.round(x, 5) + 0.0).alias("features")


@plan("feature_names", sql=f"""
SELECT cast(row_number() OVER (ORDER BY position) - 1 as integer) AS position, feature
FROM ({_variance_sql()}) WHERE kept""")
def q_feature_names(spark, d):
    _, _, rep = R.prepare(_prep_input(spark, d), "big_order", ids=["row_id"])
    return spark.createDataFrame(list(enumerate(rep.feature_names)), "position int, feature string")


@plan("prepare", sql=_features_sql(", cast(big_order as double) AS label", True))
def q_prepare(spark, d):
    out, _, _ = R.prepare(_prep_input(spark, d), "big_order", ids=["row_id"])
    return out.select("row_id", _rounded(), "label")


@plan("assemble_features", sql=_features_sql("", False))
def q_assemble_features(spark, d):
    out, _, _ = R.prepare(_prep_input(spark, d), "big_order", ids=["row_id"], select=False)
    return out.select("row_id", _rounded())


# ------------------------------------------------------------------ splits
H = "md5(concat_ws(':', '42', row_id))"


@plan("split_random", sql=f"""
SELECT row_id, CASE WHEN row_number() OVER (ORDER BY {H}, row_id)
  <= (SELECT ceil(count(*) * 0.2) FROM lineitem) THEN 'test' ELSE 'train' END AS split FROM {LI}""")
def q_split_random(spark, d):
    li = X.lineitem(spark, d).select("row_id")
    return S.split_random(li, ["row_id"], 0.2, 42)


STRAT_SQL = f"""
WITH base AS (SELECT row_id, big_order, {H} AS h FROM {LI}),
cnt AS (SELECT big_order, count(*) AS n FROM base GROUP BY big_order),
q AS (SELECT big_order, floor(n * 0.2) AS b, n * 0.2 - floor(n * 0.2) AS r,
             sum(n) OVER () AS tot, sum(floor(n * 0.2)) OVER () AS sb FROM cnt),
q2 AS (SELECT big_order, b + CASE WHEN row_number() OVER (ORDER BY r DESC, big_order)
              <= ceil(tot * 0.2) - sb THEN 1 ELSE 0 END AS quota FROM q)
SELECT row_id, big_order, CASE WHEN row_number() OVER (PARTITION BY big_order ORDER BY h, row_id)
  <= quota THEN 'test' ELSE 'train' END AS split FROM base JOIN q2 USING (big_order)"""


@plan("split_stratified", sql=STRAT_SQL)
def q_split_stratified(spark, d):
    li = X.lineitem(spark, d).select("row_id", "big_order")
    return S.split_stratified(li, "big_order", ["row_id"], 0.2, 42)


@plan("kfold", sql=f"""
SELECT row_id, cast((row_number() OVER (ORDER BY {H}, row_id) - 1) % 5 as integer) AS fold FROM {LI}""")
def q_kfold(spark, d):
    return S.kfold(X.lineitem(spark, d).select("row_id"), ["row_id"], 5, 42)


@plan("kfold_stratified", sql=f"""
SELECT row_id, big_order, cast((row_number() OVER (PARTITION BY big_order ORDER BY {H}, row_id) - 1) % 5
  as integer) AS fold FROM {LI}""")
def q_kfold_stratified(spark, d):
    return S.kfold_stratified(X.lineitem(spark, d).select("row_id", "big_order"), "big_order",
                              ["row_id"], 5, 42)


@plan("cv_plain", sql="""
SELECT o_orderkey, cast(floor((row_number() OVER (ORDER BY o_orderkey) - 1) * 3
  / (SELECT count(*) FROM orders)) as integer) AS fold FROM orders""")
def q_cv_plain(spark, d):
    return S.cv_plain(X.table(spark, d, "orders").select("o_orderkey"), ["o_orderkey"], 3)


@plan("sample_n", sql=f"SELECT row_id, l_quantity FROM {LI} ORDER BY {H}, row_id LIMIT 1000")
def q_sample_n(spark, d):
    return S.sample_n(X.lineitem(spark, d).select("row_id", "l_quantity"), ["row_id"], 1000, 42)


@plan("head_n", sql="""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity FROM lineitem
ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey LIMIT 2000""")
def q_head_n(spark, d):
    li = X.table(spark, d, "lineitem").select(*X.LINEITEM_KEY, "l_quantity")
    return S.head_n(li, X.LINEITEM_KEY, 2000)


@plan("rows_of_split", sql=f"""
SELECT row_id, l_orderkey, l_quantity, l_returnflag FROM ({STRAT_SQL}) s JOIN {LI} USING (row_id)
WHERE s.split = 'test'""")
def q_rows_of_split(spark, d):
    li = X.lineitem(spark, d)
    sp = S.split_stratified(li.select("row_id", "big_order"), "big_order", ["row_id"], 0.2, 42)
    return S.rows_of_split(li.select("row_id", "l_orderkey", "l_quantity", "l_returnflag"), sp,
                           ["row_id"], "test")
