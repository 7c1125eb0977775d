"""Model quality on planted targets, persistence, co-training bookkeeping."""

import pytest
from pyspark.sql import functions as F

from autotab import sources as IO
from autotab.operators import metrics as M
from autotab.operators import models as MD
from autotab.plans.model_plans import lineitem_binary, lineitem_regression, part_band


@pytest.fixture(scope="module")
def binary(spark, sf):
    train, test, _ = lineitem_binary(spark, sf)
    return train.persist(), test.persist()


@pytest.mark.parametrize("name", ["clf_logistic", "clf_random_forest", "clf_gaussian_nb"])
def test_classifier_beats_majority(spark, binary, name):
    train, test = binary
    m = MD.fit_model(train, "classification", name)
    acc = M.metric_accuracy(MD.score(m, test, ["row_id"])).first().accuracy
    share = test.agg(F.avg("label")).first()[0]
    majority = max(share, 1 - share)
    assert acc > majority + 0.05


def test_logistic_planted_linear(spark, binary):
    train, test = binary
    m = MD.fit_model(train, "classification", "clf_logistic")
    assert M.metric_accuracy(MD.score(m, test, ["row_id"])).first().accuracy > 0.95


def test_multiclass_boosting_probabilities(spark, sf):
    train, test, _ = part_band(spark, sf)
    m = MD.fit_model(train, "classification", "clf_gbt", {"maxIter": 10})
    s = MD.score(m, test, ["row_id"])
    sums = s.select(F.aggregate("probability", F.lit(0.0), lambda a, x: a + x).alias("t")).collect()
    assert all(abs(r.t - 1) < 1e-9 for r in sums)
    assert M.metric_accuracy(s).first().accuracy > 0.8


def test_regression_linear(spark, sf):
    train, test, _ = lineitem_regression(spark, sf)
    m = MD.fit_model(train, "regression", "reg_linear")
    assert M.metric_regression(MD.score(m, test, ["row_id"])).first().r2 > 0.99


def test_save_load_same_predictions(spark, binary, tmp_path):
    train, test = binary
    m = MD.fit_model(train, "classification", "clf_logistic")
    path = str(tmp_path / "m")
    IO.save_model(m, path, spark)
    back = IO.load_model(path, spark)
    a = MD.score(m, test, ["row_id"]).select("row_id", F.col("prediction").alias("a"))
    b = MD.score(back, test, ["row_id"]).select("row_id", F.col("prediction").alias("b"))
    assert a.join(b, "row_id").filter("a != b").count() == 0


def test_co_training_keeps_every_row(spark, sf):
    from autotab.plans.tune_plans import _semi
    from autotab.operators.tune import co_training
    data = _semi(spark, sf).drop("truth")
    n_lab = data.filter(F.col("label").isNotNull()).count()
    m = co_training(data, ["row_id"], max_iter=2, per_round_cap=20)
    assert m.n_labelled <= n_lab + 2 * 20 * 2
    assert m.n_labelled > n_lab


def test_co_training_queries_end_by_themselves(spark, sf, monkeypatch):
    from autotab.operators import tune
    from autotab.plans import tune_plans

    class Flat:
        def transform(self, df):
            return df.selectExpr("*", "array(0.25D, 0.75D) AS probability", "1.0D AS prediction")

    fits, semi = [], tune_plans._semi(spark, sf).orderBy("row_id").limit(60).persist()
    monkeypatch.setattr(tune_plans, "_semi", lambda *_: semi)
    monkeypatch.setattr(tune, "fit_model", lambda *a, **k: fits.append(a[2]) or Flat())
    n, n_labelled = semi.count(), semi.filter("label IS NOT NULL").count()
    rounds = 0
    while rounds < 100 and (add := min(100, (n - n_labelled) // 10)):
        n_labelled, rounds = n_labelled + add, rounds + 1      # both views pick the same rows
    assert rounds > 5
    got = tune_plans.q_co_training(spark, sf).first()
    assert (got.rounds, got.n_labelled) == (rounds, n_labelled)
    assert len(fits) == 2 * (rounds + 1)
    assert {r.metric for r in tune_plans.q_co_training_predict(spark, sf).collect()} >= {"accuracy"}
    assert len(fits) == 4 * (rounds + 1)      # each query fits


def test_read_csv_types(spark, tmp_path):
    p = tmp_path / "t.csv"
    p.write_text("a,b,c,d\n1,1.5,True,x\n2,NA,false,\n,3,TRUE,y\n")
    df = IO.read_table(spark, str(p))
    types = dict(df.dtypes)
    assert types == {"a": "bigint", "b": "double", "c": "boolean", "d": "string"}
    rows = df.orderBy("b").collect()
    assert sum(r.b is None for r in rows) == 1


def test_stream_scoring(spark, binary, tmp_path):
    from autotab.operators import prep as R
    from autotab.streaming import read_stream, score_stream
    from autotab.plans import fixtures as X
    li = X.lineitem(spark, "/root/testdata/sf0.001").select(
        "row_id", "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "big_order")
    prepared, _, rep = R.prepare(li, "big_order", ids=["row_id"])
    prep_model = rep.scoring_model
    m = MD.fit_model(prepared, "classification", "clf_logistic")
    src = str(tmp_path / "in")
    li.drop("big_order").limit(500).write.parquet(src)
    stream = read_stream(spark, src, li.drop("big_order").schema)
    q = score_stream(stream, prep_model, m, ["row_id"], str(tmp_path / "out"),
                     checkpoint=str(tmp_path / "ck"))
    q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 500


def test_svr_and_every_saved_model(spark, sf, binary, tmp_path):
    from autotab.operators import prep as R
    from autotab.operators.tune import CoTrainingModel
    from autotab.plans import fixtures as X
    train, test = binary
    rtrain, rtest, _ = lineitem_regression(spark, sf)
    svr = MD.fit_model(rtrain, "regression", "reg_svr")
    assert M.metric_regression(MD.score(svr, rtest, ["row_id"])).first().r2 > 0.9
    small = train.limit(300).persist()
    logistic = MD.fit_model(small, "classification", "clf_logistic")
    cases = [(svr, rtest), (MD.fit_model(small, "classification", "clf_svm", {"maxIter": 5}), test),
             (MD.fit_model(small, "classification", "clf_knn", {"k": 3, "ids": ["row_id"]}), test.limit(50))]
    for i, (m, rows) in enumerate(cases):
        path = str(tmp_path / f"m{i}")
        IO.save_model(m, path, spark)
        a = MD.score(m, rows, ["row_id"]).select("row_id", F.col("prediction").alias("a"))
        b = MD.score(IO.load_model(path, spark), rows, ["row_id"]).select("row_id", F.col("prediction").alias("b"))
        assert a.join(b, "row_id").filter(F.abs(F.col("a") - F.col("b")) > 1e-9).count() == 0
    raw = X.lineitem(spark, sf).select("row_id", "l_quantity", "l_discount", "l_tax", "l_returnflag",
                                       "l_linestatus", "big_order")
    prepared, _, rep = R.prepare(raw, "big_order", ids=["row_id"], task="classification")
    m = MD.fit_model(prepared, "classification", "clf_logistic")
    IO.save_model(m, str(tmp_path / "p"), spark, preparation=rep.scoring_model)
    out = IO.load_model(str(tmp_path / "p"), spark).transform(raw.drop("big_order").limit(20))
    assert out.filter("prediction IS NOT NULL").count() == 20
    co = CoTrainingModel(logistic, logistic, 2, 4)
    IO.save_model(co, str(tmp_path / "co"), spark)
    assert IO.load_model(str(tmp_path / "co"), spark).split == 2


def test_csv_quotes_newlines_and_suffixes(spark, tmp_path):
    p = tmp_path / "q.csv"
    p.write_text('a,b,c\n1,"x ""y"" z",3d\n2,"two\nlines",4f\n')
    df = IO.read_table(spark, str(p))
    assert [tuple(r) for r in df.orderBy("a").collect()] == [(1, 'x "y" z', "3d"), (2, "two\nlines", "4f")]
    from autotab.functions.scalars import parse_estimate
    got = spark.createDataFrame([("80d%",), ("0.3f",), ("85-90%",)], "s string").select(parse_estimate("s").alias("v"))
    assert [r.v for r in got.collect()] == [0.5, 0.5, 0.875]


def test_every_reply_gives_rows(spark):
    from autotab.operators.recommend import parse_recommendations
    rows = [(1, '{"other": 1}'), (2, '{"algorithm_recommendations": {"classification": "text"}}'), (3, None),
            (4, '{"algorithm_recommendations": {"classification": [{"algorithm": "A"}]}}')]
    got = parse_recommendations(spark.createDataFrame(rows, "reply_id int, reply string"))
    assert {r.reply_id: r.fallback for r in got.collect()} == {1: True, 2: True, 3: True, 4: False}


def test_boolean_and_date_targets(spark):
    import datetime

    from autotab.operators import prep as R
    df = spark.createDataFrame([(i, float(i % 7), i % 2 == 0, datetime.date(2020, 1, 1 + i % 2)) for i in range(40)],
                               "row_id int, x double, t boolean, day date")
    for target in ("t", "day"):
        out = R.prepare(df.select("row_id", "x", target), target, ids=["row_id"])[0]
        assert sorted(r["count"] for r in out.groupBy("label").count().collect()) == [20, 20]


def test_grid_depth_is_unlimited_above_the_others():
    from autotab.operators.tune import param_grid
    depths = {p["maxDepth"] for p in param_grid("classification", "clf_random_forest")}
    assert depths == {10, 20, 30}


def test_splits_do_not_depend_on_partitions(spark, sf):
    from autotab.operators import split as S
    from autotab.plans import fixtures as X
    li = X.lineitem(spark, sf).select("row_id", "big_order")
    for fn in (lambda d: S.split_random(d, ["row_id"]), lambda d: S.split_stratified(d, "big_order", ["row_id"]),
               lambda d: S.sample_n(d, ["row_id"], 100)):
        assert sorted(fn(li).collect()) == sorted(fn(li.repartition(9)).collect())


def test_margin_models_close_their_duality_gap(spark, sf, recwarn):
    from autotab.operators import margin
    train, test, _ = lineitem_regression(spark, sf)
    m = MD.fit_model(train, "regression", "reg_svr")
    assert 0 <= m.gap <= 1e-3 and M.metric_regression(MD.score(m, test, ["row_id"])).first().r2 > 0.99
    one = margin.fit_one_class(train, nu=0.3)
    assert 0 <= one.gap <= 1e-3
    outside = one.transform(train).filter("anomaly_score > 0").count() / train.count()
    assert abs(outside - 0.3) < 0.05      # nu bounds the share outside
    assert not [w for w in recwarn if "linear_margin" in str(w.message)]
