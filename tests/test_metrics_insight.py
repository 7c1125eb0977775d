import pytest
from pyspark.sql import functions as F

from autotab.functions import scalars as SC
from autotab.operators import insight as I
from autotab.operators import metrics as M


def test_auc_ties_and_curve(spark):
    rows = [(1.0, 0.9), (0.0, 0.9), (1.0, 0.8), (0.0, 0.1), (1.0, 0.1), (0.0, 0.05)]
    df = spark.createDataFrame(rows, "label double, score double")
    auc = M.roc_auc_binary(df).first().roc_auc
    # brute force: P(s+ > s-) + 0.5 P(=)
    pos = [s for y, s in rows if y == 1]
    neg = [s for y, s in rows if y == 0]
    want = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    assert auc == pytest.approx(want)
    trap = M.auc_trapezoid(M.roc_curve(df)).first().auc
    assert trap == pytest.approx(want)


def test_confusion_and_prf(spark):
    df = spark.createDataFrame([(0.0, 0.0), (0.0, 1.0), (1.0, 1.0), (2.0, 1.0)],
                               "label double, prediction double")
    cm = {(r.actual, r.predicted): r.n for r in M.confusion_matrix(df).collect()}
    assert len(cm) == 9 and cm[(0.0, 1.0)] == 1 and cm[(2.0, 2.0)] == 0
    prf = M.metric_prf_weighted(df).first()
    # class 0: p=1 r=.5; class 1: p=1/3 r=1; class 2: p=0 (undefined -> 0) r=0
    assert prf.recall_weighted == pytest.approx(0.5)
    assert prf.precision_weighted == pytest.approx((2 * 1 + 1 / 3 + 0) / 4)


def test_regression_metrics(spark):
    df = spark.createDataFrame([(1.0, 1.5), (2.0, 2.0), (3.0, 2.5)], "label double, prediction double")
    r = M.metric_regression(df).first()
    assert r.mse == pytest.approx(1 / 6)
    assert r.r2 == pytest.approx(1 - 0.5 / 2)


def test_parse_estimate_literals(spark):
    cases = {"85-90%": 0.875, "0.6-0.7": 0.65, "80%": 0.8, "0.5": 0.5, "n/a": 0.5, "-5": 0.5}
    df = spark.createDataFrame([(k,) for k in cases], "s string")
    got = {r.s: r.v for r in df.select("s", SC.parse_estimate("s").alias("v")).collect()}
    for k, v in cases.items():
        assert got[k] == pytest.approx(v)


def test_format_band(spark):
    df = spark.createDataFrame([("0.875",), ("85-90%",), ("80%",), ("0.6-0.7",), ("x",)], "s string")
    got = [r.b for r in df.select(SC.format_band("s").alias("b")).collect()]
    assert got == ["83-91%", "85-90%", "76-84%", "0.6-0.7", "x"]


def test_calibration_fold(spark):
    h = spark.createDataFrame([("classification", 1, 0.5, 1.0)],
                              "task_type string, seq long, estimated double, actual double")
    f = I.calibration_factors(h).first().factor
    assert f == pytest.approx(0.7 * 0.85 + 0.3 * 1.5)


def test_calibration_sequence_matches_fold(spark):
    import random
    rnd = random.Random(1)
    rows = [("regression", i, 0.2 + rnd.random(), rnd.random()) for i in range(50)]
    h = spark.createDataFrame(rows, "task_type string, seq long, estimated double, actual double")
    f = 0.90
    for _, _, e, a in rows:
        f = 0.7 * f + 0.3 * min(max(a / e, 0.5), 1.5)
    assert I.calibration_factors(h).first().factor == pytest.approx(f)


def test_mutual_information_independent_is_small(spark):
    df = spark.range(0, 2000).select((F.col("id") % 10).cast("double").alias("x"),
                                     (F.floor(F.col("id") / 10) % 2).alias("y"))
    mi = I.mutual_information(df, "y", ["x"]).first().mi
    assert mi < 0.01


def test_mutual_information_is_not_moved_by_one_outlier(spark):
    rows = [(float(i), int(i >= 1000)) for i in range(2000)]
    plain = I.mutual_information(spark.createDataFrame(rows, "x double, y int"), "y", ["x"]).first().mi
    odd = I.mutual_information(spark.createDataFrame(rows + [(1e9, 1)], "x double, y int"), "y", ["x"]).first().mi
    assert plain > 0.65 and abs(plain - odd) < 0.01
