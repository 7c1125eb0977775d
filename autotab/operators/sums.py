"""Sums of small arrays over all rows, added up on the executors first."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

FANIN = 32


def array_sums(df: DataFrame, cols: list[str], fn, shapes: dict[str, tuple]) -> dict[str, np.ndarray]:
    """{name: array} of the sums over all Arrow batches of ``fn(pdf)``, a dict of arrays
    of the given ``shapes``.

    Every task adds up its own batches; when there are many tasks their sums (one row each)
    are added in ``FANIN`` further tasks, so the driver reads few rows whatever the number of
    partitions.
    """
    names = list(shapes)
    schema = ", ".join(f"{n} array<double>" for n in names)

    def frame(total):
        return pd.DataFrame({n: [total[n].ravel().tolist()] for n in names})

    def part(batches):
        total = {n: np.zeros(s) for n, s in shapes.items()}
        for pdf in batches:
            if len(pdf):
                for n, v in fn(pdf).items():
                    total[n] += v
        yield frame(total)

    def add(batches):
        total = {n: np.zeros(max(1, math.prod(s))) for n, s in shapes.items()}
        for pdf in batches:
            for n in names:
                for v in pdf[n]:
                    total[n] += np.asarray(v)
        yield frame(total)

    parts = df.select(*cols).mapInPandas(part, schema)
    if parts.rdd.getNumPartitions() > 2 * FANIN:
        parts = parts.repartition(FANIN).mapInPandas(add, schema)
    rows = parts.collect()
    return {n: np.sum([np.asarray(r[n]) for r in rows], axis=0).reshape(s) for n, s in shapes.items()}


def stacked(series: pd.Series) -> np.ndarray:
    return np.vstack(series.to_numpy())


def moments(df: DataFrame, arr: str, d: int, where=None) -> tuple[int, np.ndarray, np.ndarray]:
    """(n, mean, population covariance) of an array column of width ``d``.

    The mean comes first and the products are taken of deviations from it, so large
    means do not cancel the covariance.
    """
    src = df if where is None else df.filter(where)
    first = array_sums(src, [arr], lambda p: {"n": len(p), "s": stacked(p[arr]).sum(axis=0)}, {"n": (), "s": (d,)})
    n = int(first["n"])
    if n == 0:
        return 0, np.zeros(d), np.zeros((d, d))
    mean = first["s"] / n

    def products(p):
        x = stacked(p[arr]) - mean
        return {"xx": x.T @ x}

    return n, mean, array_sums(src, [arr], products, {"xx": (d, d)})["xx"] / n
