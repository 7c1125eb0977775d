"""Rows of a fit lie in many partitions, whatever the file or the classes."""

import pytest
from pyspark.sql import functions as F

from autotab.operators import models as MD
from autotab.operators import split as S
from autotab.plans import model_plans as P
from autotab.session import evened, spread


def sizes(df):
    return [r["count"] for r in df.groupBy(F.spark_partition_id().alias("p")).count().collect()]


def two_classes(spark, n, parts):
    return spark.range(0, n, 1, parts).select(F.col("id").cast("string").alias("row_id"), (F.col("id") % 2).cast("int").alias("label"),
                                              F.col("id").cast("double").alias("x"))


def test_stratified_split_does_not_gather_classes(spark):
    out = S.split_stratified(two_classes(spark, 4000, 8), "label", ["row_id"])
    assert len(sizes(out)) == 8 and max(sizes(out)) == 500
    assert {(r["label"], r["split"]): r["count"] for r in out.groupBy("label", "split").count().collect()} == {
        (0, "test"): 400, (0, "train"): 1600, (1, "test"): 400, (1, "train"): 1600}


def test_class_weights_do_not_gather_classes(spark):
    assert max(sizes(MD.class_weights(two_classes(spark, 4000, 8), "label"))) == 500


def test_spread_moves_rows_of_one_partition(spark):
    cores = spark.sparkContext.defaultParallelism
    one = two_classes(spark, 20_000, 1)
    out = spread(one)
    assert len(sizes(out)) == 2 * cores and out.is_cached
    assert out.agg(F.count("x"), F.sum("x")).first() == one.agg(F.count("x"), F.sum("x")).first()
    out.unpersist()


def test_spread_leaves_even_rows_and_small_tables(spark):
    cores = spark.sparkContext.defaultParallelism
    for n, parts in ((20_000, cores), (100, 1)):
        out = spread(two_classes(spark, n, parts))
        assert len(sizes(out)) == parts
        out.unpersist()


def test_evened_moves_rows_of_one_partition_only(spark):
    cores = spark.sparkContext.defaultParallelism
    assert len(sizes(evened(two_classes(spark, 20_000, 1)))) == 2 * cores
    for n, parts in ((20_000, cores), (100, 1)):
        assert len(sizes(evened(two_classes(spark, n, parts)))) == parts


@pytest.mark.parametrize("data", [P.lineitem_binary, P.lineitem_regression])
def test_training_rows_of_one_row_group_use_all_cores(spark, tmp_path, data):
    """A file of one row group is one task; the prepared rows of a fit are not, and their split is already stored."""
    n, k = 20_000, F.col("id")
    li = spark.range(0, n, 1, 1).select(
        k.alias("l_orderkey"), F.lit(1).alias("l_linenumber"), k.alias("l_partkey"), k.alias("l_suppkey"),
        (k % 50 + 1).cast("double").alias("l_quantity"), (k % 11 / 100).alias("l_discount"), (k % 9 / 100).alias("l_tax"),
        F.when(k % 3 == 0, "A").otherwise("R").alias("l_returnflag"), F.when(k % 2 == 0, "O").otherwise("F").alias("l_linestatus"))
    li.write.parquet(f"{tmp_path}/lineitem.parquet")
    train, test, _ = data(spark, str(tmp_path))
    even = n / spark.sparkContext.defaultParallelism
    assert max(sizes(train)) <= 2 * even and len(train.select("row_id").distinct().collect()) == 0.8 * n
    assert test.count() == 0.2 * n
    assert not any(f.startswith(str(tmp_path.as_uri())) for f in train.inputFiles())


def test_a_fit_stores_its_features_and_labels_only(spark, monkeypatch):
    held = []
    monkeypatch.setattr(MD, "spread", lambda df: held.append(df.columns) or spread(df))
    df = two_classes(spark, 200, 2).withColumn("label", F.col("label").cast("double")).withColumn(
        "features", MD.array_to_vector(F.array("x")))
    m = MD.fit_model(df, "classification", "clf_logistic", weights=True)
    assert held == [["label", "features"]]
    assert MD.score(m, df, ["row_id"]).count() == 200


@pytest.mark.parametrize("side, most", [(8_000_000, 4), (300, 1)])
def test_folds_of_many_rows_are_fitted_one_after_the_other(spark, monkeypatch, side, most):
    import threading
    import time

    from autotab.operators import tune

    class Flat:
        def transform(self, df):
            return df.selectExpr("*", "1.0D AS prediction")

    running, seen, lock = [0], [], threading.Lock()

    def fit(*_):
        with lock:
            running[0] += 1
            seen.append(running[0])
        time.sleep(1)
        with lock:
            running[0] -= 1
        return Flat()

    monkeypatch.setattr(tune, "fit_model", fit)
    monkeypatch.setattr(tune, "SIDE_ROWS", side)
    df = two_classes(spark, 200, 2).withColumn("label", F.col("label").cast("double"))
    got = tune.cross_validate(df, "classification", "clf_logistic", 4).collect()
    assert len(got) == 4 and (max(seen) == 1 if most == 1 else max(seen) > 1)
