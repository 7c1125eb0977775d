"""Training rows as histogram trees see them: the bins of their features, a target and a weight.

Rows whose bins agree cannot be told apart by any tree, so they are held as one row with their number as weight: first inside
each task, and over all tasks when that at least halved the rows. With as many kinds of rows as rows, they stay as
they are.  The rows then lie in executor storage in blocks of columns, so that a pass is numpy over whole columns.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from autotab.operators import packed
from autotab.session import ROWS_PER_TASK, cut_lineage, release

BLOCK_ROWS = 32_768
GROUP_ROWS = 500_000        # rows of a task that are grouped together
LEAST_ROWS = 20_000         # of a task that reads grouped rows
TASK_BYTES = 16 << 20       # of rows that one task works on alone


def bin_numbers(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    """Bin of every value: below 256, since a feature counted as having few values has not many more."""
    out = np.empty(x.shape, np.uint8)
    for j, e in enumerate(edges):
        out[:, j] = np.searchsorted(e, x[:, j], side="left")
    return out


def quantile_edges(df: DataFrame, x, d: int, max_bins: int) -> list[np.ndarray]:
    """Per feature the values at which bins end (a value belongs to the first bin whose end reaches it): every
    value of a feature that has about ``max_bins`` at most, quantiles of a sketch otherwise.  Two aggregates
    over all features."""
    value = [F.when(~F.isnan(x[j]), x[j]) for j in range(d)]
    few = df.agg(*[F.approx_count_distinct(v).alias(f"f{j}") for j, v in enumerate(value)]).first()
    share = [i / max_bins for i in range(1, max_bins)]
    row = df.agg(*[F.struct(F.min(v).alias("lo"), F.max(v).alias("hi"), (
        F.collect_set(v) if few[j] <= max_bins else F.percentile_approx(v, share, 10_000)).alias("q")).alias(f"f{j}")
        for j, v in enumerate(value)]).first()
    out = []
    for lo, hi, q in row:
        e = np.unique(np.array([] if lo is None else [lo, *(q or [])], float))
        out.append(e[e < hi] if lo is not None else e)
    return out


def stored(src: DataFrame, edges: list[np.ndarray], n: int, total: bool) -> tuple[DataFrame, int]:
    """(table, its rows): (b, y, w) of the ``n`` rows of ``src`` (x, y), stored: bins as bytes, target, number of rows.

    Rows of equal bins are one row, with the sum of their targets when ``total`` (all that squared and logistic losses need),
    otherwise one for each of their targets.
    """
    d, keys = len(edges), ["b"] if total else ["b", "y"]
    values = ["y", "w"] if total else ["w"]

    def pack(batches):
        held, rows = [], 0
        for b in batches:
            if b.num_rows:
                held.append(pa.table({"b": packed.binary(bin_numbers(packed.lists(b.column("x"), d), edges)), "y": b.column("y"),
                                      "w": np.ones(b.num_rows)}))
                rows += b.num_rows
            if rows >= GROUP_ROWS:
                yield from group(held)
                held, rows = [], 0
        if held:
            yield from group(held)

    def group(held):
        t = pa.concat_tables(held).combine_chunks().group_by(keys, use_threads=False).aggregate([(v, "sum") for v in values])
        t = t.rename_columns([c.removesuffix("_sum") for c in t.column_names]).select(["b", "y", "w"])
        yield from t.to_batches(max_chunksize=BLOCK_ROWS)

    out = cut_lineage(src.mapInArrow(pack, "b binary, y double, w double"))
    kinds = out.count()
    if 2 * kinds <= n:
        own, tasks = out, even_tasks(out, kinds)
        out = cut_lineage(own.repartition(tasks, "b").groupBy(*keys).agg(*[F.sum(v).alias(v) for v in values]).select("b", "y", "w"))
        release(own)
        kinds = out.count()
    return out, kinds


def even_tasks(df: DataFrame, rows: int) -> int:
    """Tasks to read ``rows`` rows in: of ``LEAST_ROWS`` rows at least, of ``ROWS_PER_TASK`` at most, else one per core."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return max(1, math.ceil(rows / min(ROWS_PER_TASK, max(LEAST_ROWS, math.ceil(rows / cores)))))


def blocks(df: DataFrame, columns: list[str]) -> RDD:
    """``df`` (b, and columns of doubles) as elements (bins [features, rows], *columns [rows])."""
    def pack(batches):
        for b in batches:
            for s in range(0, b.num_rows, BLOCK_ROWS):
                part = b.slice(s, BLOCK_ROWS)
                arrays = [np.ascontiguousarray(packed.matrix(part.column("b"), np.uint8).T), *[
                    part.column(c).to_numpy(zero_copy_only=False) for c in columns]]
                yield pa.RecordBatch.from_arrays([pa.array([part.num_rows], pa.int32()), *[
                    pa.array([a.tobytes()], pa.binary()) for a in arrays]], names=["n", "b", *columns])

    def opened(r):
        return (np.frombuffer(r["b"], np.uint8).reshape(-1, r["n"]), *[np.frombuffer(r[c]) for c in columns])

    schema = "n int, b binary, " + ", ".join(f"{c} binary" for c in columns)
    return df.select("b", *columns).mapInArrow(pack, schema).rdd.map(opened)


class OneTask:
    """Blocks that all lie in the task that works on them."""

    def __init__(self, blocks):
        self.blocks = blocks

    def sums(self, fn, shapes: dict[str, tuple]) -> dict[str, np.ndarray]:
        """{name: array} of the sums of ``fn(*block)`` over all blocks."""
        total = {k: np.zeros(s) for k, s in shapes.items()}
        for block in self.blocks:
            for k, v in fn(*block).items():
                total[k] += v
        return total

    def each(self, fn, shape: tuple, pieces: int, choose) -> list:
        """[choose(sums)]: the sums of ``fn(*block)``, an array of ``shape``, cut into ranges of the first axis."""
        return [choose(self.sums(lambda *block: {"a": fn(*block)}, {"a": shape})["a"])]

    def map(self, fn) -> OneTask:
        """The blocks ``fn(*block)``; these are given up."""
        self.blocks = [fn(*b) for b in self.blocks]
        return self

    def release(self):
        self.blocks = []


class ManyTasks:
    """Blocks in executor storage; a pass is a job."""

    def __init__(self, rdd: RDD):
        self.rdd, self.own = rdd.persist(StorageLevel.MEMORY_AND_DISK), True

    def sums(self, fn, shapes: dict[str, tuple]) -> dict[str, np.ndarray]:
        def part(it):
            return OneTask(it).sums(fn, shapes)

        def add(a, b):
            return {k: a[k] + b[k] for k in a}

        tasks, most = self.rdd.getNumPartitions(), packed.FANIN
        if tasks > 2 * most:      # added in further tasks first, so the driver reads few
            got = self.rdd.mapPartitionsWithIndex(lambda i, it: [(i % most, part(it))]).reduceByKey(add, most).values().collect()
        else:
            got = self.rdd.mapPartitions(lambda it: [part(it)]).collect()
        return {k: sum((t[k] for t in got), np.zeros(s)) for k, s in shapes.items()}

    def each(self, fn, shape: tuple, pieces: int, choose) -> list:
        """Every range is added up in a task of its own, and only what ``choose`` makes of it is read."""
        ends = [round(i * shape[0] / pieces) for i in range(pieces + 1)]

        def part(it):
            total = OneTask(it).sums(lambda *block: {"a": fn(*block)}, {"a": shape})["a"]
            return [(i, total[ends[i]:ends[i + 1]]) for i in range(pieces)]

        got = self.rdd.mapPartitions(part).reduceByKey(lambda a, b: a + b, pieces).mapValues(choose).collect()
        return [v for _, v in sorted(got, key=lambda x: x[0])]

    def kept(self) -> ManyTasks:
        """The same blocks, which stay when the result gives its own up."""
        out = ManyTasks(self.rdd)
        out.own = False
        return out

    def map(self, fn) -> ManyTasks:
        out = ManyTasks(self.rdd.map(lambda block: fn(*block)))
        out.rdd.count()
        self.release()
        return out

    def release(self):
        if self.own:
            self.rdd.unpersist()


def work(rdd: RDD, size: int, job):
    """``job(rows)`` on the blocks of ``rdd``, ``size`` bytes in all: on the driver with jobs for passes, or, when
    the rows fit ``TASK_BYTES``, inside one task, where passes cost no jobs."""
    if size <= TASK_BYTES:
        return rdd.coalesce(1).mapPartitions(lambda it: [job(OneTask(list(it)))]).collect()[0]
    rows = ManyTasks(rdd)
    return job(rows)
