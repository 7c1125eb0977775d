"""Model persistence with Spark ML writers (works on any Hadoop path).

Built-in models and ``PipelineModel`` use their own ``save``; the composites
here (one model plus probability handling, boosted trees, ensembles, margin
models on Fourier features, co-training views, k-NN with its training table)
store each member in a sub-folder plus a one-row manifest table. A model may be
saved with the preparation it was fitted on, so the loaded pair scores raw rows.
"""

from __future__ import annotations

import importlib
import json

from pyspark.ml import PipelineModel
from pyspark.sql import SparkSession


def _manifest(spark: SparkSession, path: str, info: dict) -> None:
    spark.createDataFrame([(json.dumps(info),)], "info string").coalesce(1) \
        .write.mode("overwrite").json(f"{path}/manifest")


def _read_manifest(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.json(f"{path}/manifest").first()["info"])


def _cls_name(obj) -> str:
    return f"{type(obj).__module__}.{type(obj).__name__}"


def _load_cls(name: str):
    mod, cls = name.rsplit(".", 1)
    return getattr(importlib.import_module(mod), cls)


class PreparedModel:
    """A preparation and the model fitted on its output: scores raw rows."""

    def __init__(self, preparation, model):
        self.preparation, self.model = preparation, model

    def transform(self, df):
        return self.model.transform(self.preparation.transform(df))


def save_model(model, path: str, spark: SparkSession | None = None, preparation=None) -> None:
    """Write ``model``; with ``preparation`` (a ``PipelineModel``, usually the report's
    ``scoring_model``) the loaded object takes raw rows."""
    from autotab.operators.margin import LinearScore
    from autotab.operators.boosting import BoostedTrees
    from autotab.operators.forest import Forest
    from autotab.operators.models import PlattSVM, ScoredModel
    from autotab.operators.neighbours import KNNClassifierModel
    from autotab.operators.starts import CentresModel
    from autotab.operators.tune import CoTrainingModel, MeanEnsemble, VoteEnsemble
    spark = spark or SparkSession.getActiveSession()

    def projector(p):
        return None if p is None else p.params

    if preparation is not None or isinstance(model, PreparedModel):
        if isinstance(model, PreparedModel):
            preparation, model = model.preparation, model.model
        preparation.write().overwrite().save(f"{path}/preparation")
        save_model(model, f"{path}/prepared", spark)
        _manifest(spark, path, {"kind": "prepared"})
    elif isinstance(model, ScoredModel):
        model.model.write().overwrite().save(f"{path}/model")
        _manifest(spark, path, {"kind": "scored", "class": _cls_name(model.model),
                                "prob": model.has_prob})
    elif isinstance(model, BoostedTrees):
        _manifest(spark, path, {"kind": "boosted", "model": model.state()})
    elif isinstance(model, Forest):
        _manifest(spark, path, {"kind": "forest", "model": model.state()})
    elif isinstance(model, (VoteEnsemble, MeanEnsemble)):
        for i, m in enumerate(model.members):
            save_model(m, f"{path}/member{i}", spark)
        _manifest(spark, path, {"kind": "vote" if isinstance(model, VoteEnsemble) else "mean",
                                "n": len(model.members)})
    elif isinstance(model, PlattSVM):
        for i, (m, p) in enumerate(zip(model.members, model.platt)):
            if not model.projector:
                m.write().overwrite().save(f"{path}/member{i}")
            p.write().overwrite().save(f"{path}/platt{i}")
        _manifest(spark, path, {"kind": "svm", "n": len(model.members), "classes": [
            _cls_name(model.members[0]), _cls_name(model.platt[0])], "projector": projector(model.projector), "members": [
                [[float(v) for v in w], float(b)] for w, b in model.members] if model.projector else None})
    elif isinstance(model, CentresModel):
        _manifest(spark, path, {"kind": "centres", "centres": model.centres.tolist(), "features": model.features})
    elif isinstance(model, LinearScore):
        _manifest(spark, path, {"kind": "linear", "w": [float(v) for v in model.w], "b": float(model.b),
                                "out": model.out, "projector": projector(model.projector)})
    elif isinstance(model, CoTrainingModel):
        save_model(model.m1, f"{path}/member0", spark)
        save_model(model.m2, f"{path}/member1", spark)
        _manifest(spark, path, {"kind": "co_training", "split": model.split, "dim": model.dim})
    elif isinstance(model, KNNClassifierModel):
        model.train.write.mode("overwrite").parquet(f"{path}/train")
        _manifest(spark, path, {"kind": "knn", "k": model.k, "ids": [model.id], "label": model.label,
                                "features": model.features})
    elif hasattr(model, "write"):
        model.write().overwrite().save(f"{path}/model")
        _manifest(spark, path, {"kind": "spark", "class": _cls_name(model)})
    else:
        raise TypeError(f"cannot save {type(model).__name__}")


def load_model(path: str, spark: SparkSession | None = None):
    from autotab.operators.margin import LinearScore
    from autotab.operators.boosting import BoostedTrees
    from autotab.operators.forest import Forest
    from autotab.operators.models import FourierFeatures, PlattSVM, ScoredModel
    from autotab.operators.neighbours import KNNClassifierModel
    from autotab.operators.starts import CentresModel
    from autotab.operators.tune import CoTrainingModel, MeanEnsemble, VoteEnsemble
    spark = spark or SparkSession.getActiveSession()
    info = _read_manifest(spark, path)
    kind = info["kind"]
    projector = FourierFeatures(**info["projector"]) if info.get("projector") else None
    if kind == "prepared":
        return PreparedModel(PipelineModel.load(f"{path}/preparation"), load_model(f"{path}/prepared", spark))
    if kind == "spark":
        return _load_cls(info["class"]).load(f"{path}/model")
    if kind == "scored":
        return ScoredModel(_load_cls(info["class"]).load(f"{path}/model"), info["prob"])
    if kind == "boosted":
        return BoostedTrees.of_state(json.loads(info["model"]) if isinstance(info["model"], str) else info["model"])
    if kind == "forest":
        return Forest.of_state(info["model"])
    if kind == "svm":
        svm, platt = map(_load_cls, info["classes"])
        return PlattSVM(info.get("members") or [svm.load(f"{path}/member{i}") for i in range(info["n"])],
                        [platt.load(f"{path}/platt{i}") for i in range(info["n"])], projector)
    if kind == "centres":
        return CentresModel(info["centres"], info["features"])
    if kind == "linear":
        return LinearScore(projector, info["w"], info["b"], info["out"])
    if kind == "co_training":
        return CoTrainingModel(load_model(f"{path}/member0", spark), load_model(f"{path}/member1", spark),
                               info["split"], info["dim"])
    if kind == "knn":
        return KNNClassifierModel(spark.read.parquet(f"{path}/train"), info["k"], info["ids"], info["label"],
                                  info["features"])
    members = [load_model(f"{path}/member{i}", spark) for i in range(info["n"])]
    return VoteEnsemble(members) if kind == "vote" else MeanEnsemble(members)
