"""Numeric rows as packed bytes: Arrow hands a whole batch to numpy without a Python
object per row, so passes over a training table cost little more than their arithmetic."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

FANIN = 32


def matrix(col: pa.Array, dtype=np.float64) -> np.ndarray:
    """[rows, width] view of a binary column whose values are equally long."""
    n = len(col)
    ends = np.frombuffer(col.buffers()[1], np.int32)[col.offset:col.offset + n + 1]
    data = col.buffers()[2]
    flat = np.frombuffer(data, np.uint8)[ends[0]:ends[-1]] if data is not None else np.zeros(0, np.uint8)
    return np.ascontiguousarray(flat).view(dtype).reshape(n, -1) if n else np.zeros((0, 0), dtype)


def binary(x: np.ndarray) -> pa.Array:
    """The rows of ``x`` as a binary column."""
    x = np.ascontiguousarray(x)
    width = x.shape[1] * x.itemsize
    ends = np.arange(len(x) + 1, dtype=np.int32) * np.int32(width)
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(ends), pa.py_buffer(x.tobytes())])


def lists(col: pa.Array, width: int) -> np.ndarray:
    """[rows, width] doubles of a list column without nulls."""
    return col.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(col), width)


def sums(df: DataFrame, fn, shapes: dict[str, tuple], tasks: int) -> dict[str, np.ndarray]:
    """{name: array} of the sums of ``fn(batch)`` over all Arrow batches of ``df``, which is read in ``tasks`` tasks.

    Every task adds up its own batches; the sums of many tasks are added in ``FANIN`` further tasks, so
    the driver reads few rows whatever their number.
    """
    names = list(shapes)
    schema = ", ".join(f"{n} binary" for n in names)

    def rows(total):
        return pa.RecordBatch.from_arrays([pa.array([total[n].tobytes()], pa.binary()) for n in names], names=names)

    def part(batches):
        total = {n: np.zeros(s) for n, s in shapes.items()}
        for b in batches:
            if b.num_rows:
                for n, v in fn(b).items():
                    total[n] += v
        yield rows(total)

    def add(batches):
        total = {n: np.zeros(max(1, math.prod(s))) for n, s in shapes.items()}
        for b in batches:
            for n in names:
                for v in b.column(n).to_pylist():
                    total[n] += np.frombuffer(v)
        yield rows(total)

    parts = df.mapInArrow(part, schema)
    if tasks > 2 * FANIN:
        parts = parts.repartition(FANIN).mapInArrow(add, schema)
    got = parts.collect()
    return {n: np.sum([np.frombuffer(r[n]) for r in got], axis=0).reshape(s) if got else np.zeros(s) for n, s in shapes.items()}
