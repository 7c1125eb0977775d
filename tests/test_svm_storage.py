"""The RBF SVM stores its projected features once (inside LinearSVC), and its model keeps weights only."""

import numpy as np
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from autotab import sources
from autotab.operators import models as MD


def rows(spark):
    x = F.col("id") % 10 / 5.0 - 1
    y = F.floor(F.col("id") / 10) % 10 / 5.0 - 1
    return spark.range(400).select(F.col("id").cast("string").alias("row_id"), F.array(x, y).alias("a"),
                                   (x * x + y * y < 0.6).cast("double").alias("label")).select(
        "row_id", MD.array_to_vector("a").alias("features"), "label")


def test_rbf_svm_stores_no_second_copy(spark, monkeypatch, tmp_path):
    df = rows(spark)
    cached = []
    kept = type(df).cache

    def cache(self):
        cached.append(self.columns)
        return kept(self)

    monkeypatch.setattr(type(df), "cache", cache)
    m = MD.fit_model(df, "classification", "clf_svm", {"kernel": "rbf", "maxIter": 20, "n_components": 30})
    assert not [c for c in cached if "rff" in c]
    scored = MD.score(m, df, ["row_id"]).persist()
    assert scored.filter("label = prediction").count() > 300
    w, b = m.members[0]
    z = m.projector(df).select("row_id", vector_to_array("rff").alias("z")).collect()
    margin = {r["row_id"]: float(np.dot(r["z"], w) + b) for r in z}
    got = df.select("row_id", m.projector.dot(df, [w], [b])[0].alias("m")).collect()
    assert max(abs(margin[r["row_id"]] - r["m"]) for r in got) < 1e-9
    sources.save_model(m, str(tmp_path / "svm"))
    again = MD.score(sources.load_model(str(tmp_path / "svm")), df, ["row_id"])
    pairs = scored.select("row_id", F.col("probability")[1].alias("p")).join(
        again.select("row_id", F.col("probability")[1].alias("q")), "row_id")
    assert pairs.filter("abs(p - q) > 1e-9").count() == 0 and pairs.count() == 400
    assert not [c for c in scored.columns if c.startswith("_")]
    assert set(m.transform(df).columns) == {"row_id", "features", "label", "probability", "prediction"}
