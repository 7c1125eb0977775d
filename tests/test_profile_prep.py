"""Hand-worked cases (FIXTURES.md) and invariants of profile / prep / split."""

import math

import pytest
from pyspark.sql import functions as F

from autotab.operators import prep as R
from autotab.operators import profile as P
from autotab.operators import split as S
from autotab.operators.ranking import global_rank


def test_median_even_count(spark):
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate([1, 2, 3, 10])], "id int, x double")
    assert R.column_medians(df, ["x"], ["id"]) == {"x": 2.5}


def test_quartiles(spark):
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate([1, 2, 3.5, 10])], "id int, x double")
    row = P.describe_numeric(df, ["x"], key=["id"]).first()
    assert row.p25 == pytest.approx(1.75)
    assert row.p75 == pytest.approx(5.125)


def test_mode_tie_smallest(spark):
    df = spark.createDataFrame([(v,) for v in "babac"], "s string")
    assert R.column_modes(df, ["s"]) == {"s": "a"}
    assert P.mode_share(df, "s").first().mode_value == "a"


def test_unseen_category_all_zeros(spark):
    fit = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id int, c string")
    new = spark.createDataFrame([(4, "zz"), (5, None), (6, "b")], "id int, c string")
    out = {r.id: (r.c_a, r.c_b, r.c_c) for r in R.one_hot(new, ["c"], ["id"], fit_on=fit).collect()}
    assert out[4] == (0.0, 0.0, 0.0)
    assert out[5] == (0.0, 0.0, 0.0)
    assert out[6] == (0.0, 1.0, 0.0)


def test_population_variance_edge(spark):
    # population variance of 0,0,0,2 is exactly 0.75: a 0.75 threshold keeps nothing
    df = spark.createDataFrame([(float(v),) for v in [0, 0, 0, 2]], "x double")
    v = df.agg(F.var_pop("x")).first()[0]
    assert v == pytest.approx(0.75)


def test_kurtosis(spark):
    from autotab.operators.insight import column_kurtosis
    df = spark.createDataFrame([(float(v),) for v in [1, 2, 2, 3, 14]], "x double")
    assert column_kurtosis(df, ["x"]).first().kurtosis == pytest.approx(0.165913, abs=1e-5)


def test_task_rule(spark):
    ten = spark.createDataFrame([(float(i),) for i in range(10)], "y double")
    eleven = spark.createDataFrame([(float(i),) for i in range(11)], "y double")
    assert P.infer_task(ten, "y").first().task == "classification"
    assert P.infer_task(eleven, "y").first().task == "regression"
    assert P.infer_task(ten).first().task == "clustering"


def test_standard_scale_zero_std(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "a double, b double")
    rows = R.standard_scale(df, ["a", "b"]).collect()
    assert sorted(r.a for r in rows) == [-1.0, 1.0]
    assert all(r.b == 0.0 for r in rows)


def test_global_rank_matches_sort_under_repartition(spark):
    df = spark.range(0, 1000).select(F.col("id"), (F.col("id") * 7919 % 101).alias("v"))
    for parts in (1, 7):
        r = global_rank(df.repartition(parts), ["v"], ["id"], rank_col="r")
        got = [x.id for x in r.orderBy("r").collect()]
        want = [x.id for x in df.orderBy("v", "id").collect()]
        assert got == want
        assert [x.r for x in r.orderBy("r").collect()] == list(range(1, 1001))


def test_grouped_rank_restarts(spark):
    df = spark.range(0, 300).select("id", (F.col("id") % 3).alias("g"))
    r = global_rank(df, ["id"], [], group_cols=["g"], rank_col="r").collect()
    by_g = {}
    for x in r:
        by_g.setdefault(x.g, []).append((x.id, x.r))
    for g, items in by_g.items():
        items.sort()
        assert [rk for _, rk in items] == list(range(1, 101))


def test_split_sizes_and_repeatability(spark):
    df = spark.range(0, 503).select(F.col("id").cast("string").alias("row_id"),
                                    (F.col("id") % 4 == 0).cast("int").alias("y"))
    a = S.split_random(df, ["row_id"], 0.2)
    assert a.filter("split = 'test'").count() == math.ceil(503 * 0.2)
    b = S.split_random(df.repartition(5), ["row_id"], 0.2)
    assert sorted(r.row_id for r in a.filter("split='test'").collect()) == \
        sorted(r.row_id for r in b.filter("split='test'").collect())
    st = S.split_stratified(df, "y", ["row_id"], 0.2)
    assert st.filter("split = 'test'").count() == math.ceil(503 * 0.2)
    shares = {r.y: r.n for r in st.filter("split='test'").groupBy("y").agg(F.count("*").alias("n")).collect()}
    assert abs(shares[1] - 126 * 0.2) <= 1


def test_kfold_balanced(spark):
    df = spark.range(0, 103).select(F.col("id").cast("string").alias("row_id"))
    sizes = sorted(r["count"] for r in S.kfold(df, ["row_id"], 5).groupBy("fold").count().collect())
    assert sizes == [20, 20, 21, 21, 21]


def test_constant_and_high_cardinality(spark):
    df = spark.range(0, 120).select(F.lit(1).alias("k"), F.col("id").cast("string").alias("s"),
                                    (F.col("id") % 3).cast("string").alias("t"))
    flags = {r.column_name: r.is_constant for r in R.constant_columns(df).collect()}
    assert flags == {"k": True, "s": False, "t": False}
    hc = {r.column_name: r.high_cardinality for r in R.high_cardinality_columns(df).collect()}
    assert hc == {"s": True, "t": False}


def test_prepare_never_drops_target_and_reports(spark, sf):
    from autotab.plans import fixtures as X
    li = X.lineitem(spark, sf).select("row_id", "l_quantity", "constant", "rare_cat", "l_returnflag",
                                      "big_order")
    out, model, rep = R.prepare(li, "big_order", ids=["row_id"])
    assert "constant" in rep.dropped_constant
    assert out.count() == li.count()
    assert set(out.columns) == {"row_id", "features", "label"}


def test_column_types_query_reads_the_table(spark, sf):
    from autotab.plans.profile_plans import q_column_types
    df = spark.createDataFrame([(1, 1.5, "a"), (2, float("nan"), None), (2, None, "b")], "i int, x double, s string")
    assert [tuple(r) for r in P.column_figures(df).collect()] == [
        (0, "i", "int", "numeric", 3, 2), (1, "x", "double", "numeric", 1, 1), (2, "s", "string", "categorical", 2, 2)]
    assert [tuple(r) for r in P.column_figures(df.limit(0)).select("n_values", "approx_distinct").collect()] == [(0, 0)] * 3
    got = {r.column_name: r for r in q_column_types(spark, sf).collect()}
    n = spark.read.parquet(f"{sf}/lineitem.parquet").count()
    assert got["row_id"].n_values == n and got["qty_null"].n_values < n and got["constant"].approx_distinct == 1
