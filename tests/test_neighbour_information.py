"""Nearest-neighbour mutual information against its plain form."""

import math

import numpy as np
import pytest

from autotab.operators import insight as I

EULER = 0.5772156649015329


def psi(n):
    return sum(1 / i for i in range(1, n)) - EULER


def plain(x, y, k=3):
    keep = np.array([np.sum(y == c) > 1 for c in y], bool)
    x, y = x[keep], y[keep]
    terms = []
    for i in range(len(x)):
        own = np.abs(x[y == y[i]] - x[i])
        r = np.sort(own)[min(k, len(own) - 1)] * (1 - 1e-6)
        terms.append(psi(int((own <= r).sum())) - psi(len(own)) - psi(int((np.abs(x - x[i]) <= r).sum())))
    return max(0.0, psi(len(x)) + np.mean(terms))


def test_digamma_of_counts(spark):
    got = spark.range(1, 200).select("id", I.digamma(I.F.col("id")).alias("p")).collect()
    assert all(abs(r["p"] - psi(r["id"])) < 1e-9 for r in got)


@pytest.mark.parametrize("run", [4096, 7])
def test_equals_the_plain_form_with_ties_nulls_and_lone_classes(spark, monkeypatch, run):
    monkeypatch.setattr(I, "RUN", run)
    rng = np.random.default_rng(5)
    y = rng.integers(0, 3, 150)
    cols = {"apart": y + rng.normal(size=150) * 0.2, "free": rng.normal(size=150),
            "ties": np.round(y * 2 + rng.normal(size=150)), "same": np.full(150, 4.0)}
    y = np.where(np.arange(150) == 149, 9, y)                     # a class of one row
    rows = [(*(float(cols[c][i]) for c in cols), int(y[i])) for i in range(150)]
    rows += [(None, None, float("nan"), None, 1), (1.0, 1.0, 1.0, 1.0, None)]
    df = spark.createDataFrame(rows, "apart double, free double, ties double, same double, y int")
    got = {r["feature"]: r["mi"] for r in I.neighbour_information(df, "y").collect()}
    assert got.keys() == cols.keys()
    assert all(abs(got[c] - plain(cols[c], y)) < 1e-9 for c in cols)
    assert got["apart"] > 0.8 and got["free"] < 0.2 and got["same"] == pytest.approx(0, abs=1e-9)


def test_one_outlier_moves_little_and_an_empty_table_has_no_rows(spark):
    rows = [(float(i), int(i >= 500)) for i in range(1000)]
    mi = [I.neighbour_information(spark.createDataFrame(r, "x double, y int"), "y", ["x"]).first().mi
          for r in (rows, rows + [(1e9, 1)])]
    assert mi[0] == pytest.approx(math.log(2), abs=0.02) and abs(mi[0] - mi[1]) < 0.01
    assert I.neighbour_information(spark.createDataFrame([], "x double, y int"), "y", ["x"]).collect() == []


def test_numeric_target_is_cut_at_its_quantiles(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=300)
    df = spark.createDataFrame([(float(a), float(b), float(a) * 3) for a, b in zip(x, rng.normal(size=300))],
                               "x double, noise double, y double")
    got = {r["feature"]: r["mi"] for r in I.neighbour_information(df, "y", ["x", "noise"], target_bins=10).collect()}
    assert got["x"] > 1.5 and got["noise"] < 0.3
