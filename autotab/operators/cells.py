"""Metric cells: rows meet only where the triangle inequality leaves a chance.

Reference rows are dealt to cells in two levels: at most ``MAX_PIVOTS`` top pivots, and inside every large
top cell pivots of its own, so the number of cells grows with the rows until all pivots take
``PIVOT_BYTES`` (the bound of what every task is sent); cells that stay large are split by a hash of the id.
A query row goes to the cells with d(row, pivot) - radius <= reach, found top level first.  Its reach is a
number, or a column of its own.  Queries of one cell are cut into blocks, so a group holds about
``block_rows`` rows of each side, whatever lies in one place.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from autotab.session import cut_lineage

MAX_PIVOTS = 1024
PIVOT_BYTES = 256 << 20
ROUTE_VISITS = 1_000_000    # visits looked at together in a task
ROUTE_ROWS = 8192           # copies of queries a task hands over at once


def stack(series: pd.Series, dim: int | None = None) -> np.ndarray:
    if len(series) == 0:
        return np.zeros((0, dim or 0))
    return np.vstack([np.asarray(v, dtype=np.float64) for v in series])


def _far(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """[rows, pivots] distances, by direct differences, a few rows at a time."""
    out = np.empty((len(x), len(pivots)))
    step = max(1, 2_000_000 // max(1, pivots.size))
    for s in range(0, len(x), step):
        diff = x[s:s + step, None, :] - pivots[None]
        out[s:s + step] = np.sqrt(np.einsum("ijk,ijk->ij", diff, diff))
    return out


@dataclass
class Cells:
    """Pivots of both levels with the radii and row counts of their cells."""

    top: np.ndarray                                # [top cells, d]
    inner: list                                    # per top cell its pivots [cells, d]
    first: np.ndarray = None                       # number of the first cell of each top cell
    top_radius: np.ndarray = None
    radius: np.ndarray = None                      # per cell; -1: empty
    rows: np.ndarray = None
    split: np.ndarray = field(default=None)        # hash parts of each cell

    def __post_init__(self):
        self.first = np.concatenate([[0], np.cumsum([len(p) for p in self.inner])])

    def assign(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(cell, distance to its pivot, top cell, distance to the top pivot) of each row."""
        far = _far(x, self.top)
        top = far.argmin(axis=1)
        cell, apart = np.empty(len(x), np.int64), np.empty(len(x))
        for t in np.unique(top):
            at = np.flatnonzero(top == t)
            d = _far(x[at], self.inner[t])
            near = d.argmin(axis=1)
            cell[at], apart[at] = self.first[t] + near, d[np.arange(len(at)), near]
        return cell, apart, top, far[np.arange(len(x)), top]

    def reached(self, x: np.ndarray, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, cell) of all cells that may hold something within each row's reach."""
        slack = 1e-9 * (1 + np.where(np.isfinite(reach), reach, 0))
        far = _far(x, self.top)
        maybe = far - self.top_radius <= (reach + slack)[:, None] + 1e-9 * far
        rows, cells = [], []
        for t in np.flatnonzero(maybe.any(axis=0)):
            at = np.flatnonzero(maybe[:, t])
            own = slice(self.first[t], self.first[t + 1])
            d = _far(x[at], self.inner[t])
            i, j = np.nonzero((d - self.radius[own] <= (reach + slack)[at][:, None] + 1e-9 * d) & (self.rows[own] > 0))
            rows.append(at[i])
            cells.append(self.first[t] + j)
        if not rows:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate(rows), np.concatenate(cells)

    def home(self, x: np.ndarray, least: int) -> np.ndarray:
        """A near cell of ``least`` rows or more for each row: in its own top cell, else in any; -1 if there is none."""
        out, top = np.full(len(x), -1), _far(x, self.top).argmin(axis=1)
        for t in np.unique(top):
            at = np.flatnonzero(top == t)
            own = np.flatnonzero(self.rows[self.first[t]:self.first[t + 1]] >= least)
            if len(own):
                out[at] = self.first[t] + own[_far(x[at], self.inner[t][own]).argmin(axis=1)]
        rest = np.flatnonzero(out < 0)
        big = np.flatnonzero(self.rows >= least)
        if len(rest) and len(big):
            pivots = np.concatenate(self.inner)[big[:MAX_PIVOTS]]
            out[rest] = big[_far(x[rest], pivots).argmin(axis=1)]
        return out


def build(ref: DataFrame, block_rows: int) -> tuple[Cells | None, DataFrame]:
    """(cells, the rows of ``ref`` (_id, _x, ...) with ``_cell``), stored once; None for an empty ``ref``."""
    spark = ref.sparkSession
    n = ref.count()
    if not n:
        return None, ref.withColumn("_cell", F.lit(0).cast("long"))
    hashed = F.xxhash64("_id")
    some = ref.select("_x").orderBy(hashed, "_id").limit(int(min(MAX_PIVOTS, max(1, -(-n // block_rows) * 2)))).collect()
    top = np.unique(stack(pd.Series([r["_x"] for r in some])), axis=0)
    held = spark.sparkContext.broadcast(top)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ref.schema.fields)

    def topped(batches):
        for pdf in batches:
            if len(pdf):
                yield pdf.assign(_top=_far(stack(pdf["_x"]), held.value).argmin(axis=1).astype(np.int32))

    counts = {}
    inner = [p[None] for p in top]
    if n > len(top) * block_rows:      # a second level where the first does not reach
        rows = ref.mapInPandas(topped, f"{kinds}, _top int")
        counts = dict(rows.groupBy("_top").count().collect())
        most = max(1, PIVOT_BYTES // (8 * top.shape[1]) // max(1, len(top)))
        share = spark.createDataFrame([(int(t), float(min(MAX_PIVOTS, most, -(-c // block_rows) * 2)) / c) for t, c in counts.items()
                                       if c > block_rows], "_top int, _share double")
        u = F.pmod(F.xxhash64(F.lit(11), "_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
        chosen = rows.join(share, "_top").filter(u < F.col("_share")).select("_top", "_x").collect()
        for t in {r["_top"] for r in chosen}:
            inner[t] = np.unique(np.vstack([inner[t], *[np.asarray(r["_x"], float)[None] for r in chosen if r["_top"] == t]]), axis=0)
    cells = Cells(top, inner)
    sent = spark.sparkContext.broadcast(cells)

    def dealt(batches):
        for pdf in batches:
            if len(pdf):
                cell, apart, t, far = sent.value.assign(stack(pdf["_x"]))
                yield pdf.assign(_cell=cell, _apart=apart, _top=t.astype(np.int32), _far=far)

    out = cut_lineage(ref.mapInPandas(dealt, f"{kinds}, _cell long, _apart double, _top int, _far double"))
    total = int(cells.first[-1])
    cells.top_radius, cells.radius, cells.rows = np.full(len(top), -1.0), np.full(total, -1.0), np.zeros(total, np.int64)
    for r in out.groupBy("_top", "_cell").agg(F.count("*").alias("n"), F.max("_apart").alias("r"), F.max("_far").alias("f")).collect():
        cells.rows[r["_cell"]], cells.radius[r["_cell"]] = r["n"], r["r"]
        cells.top_radius[r["_top"]] = max(cells.top_radius[r["_top"]], r["f"])
    cells.split = np.maximum(1, -(-cells.rows // block_rows))
    return cells, out.drop("_apart", "_top", "_far")


def visits(pdf: pd.DataFrame, cells: Cells, send):
    """The rows of ``pdf`` once per visit that ``send`` gives, in pieces of bounded size whatever the number of cells."""
    step = max(1, ROUTE_VISITS // max(1, int(cells.split.sum())))
    for s in range(0, len(pdf), step):
        some = pdf.iloc[s:s + step]
        row, cell, part = send(some, cells)
        if part is None:
            copies = cells.split[cell]
            part = np.arange(copies.sum()) - np.repeat(np.cumsum(copies) - copies, copies)
            row, cell = np.repeat(row, copies), np.repeat(cell, copies)
        for at in range(0, len(row), ROUTE_ROWS):
            own = slice(at, at + ROUTE_ROWS)
            yield some.iloc[row[own]].assign(_cell=cell[own], _part=part[own].astype(np.int64))


def meet(cells: Cells, dealt: DataFrame, query: DataFrame, send, fn, schema: str, block_rows: int,
         query_extra: list[str], ref_extra: list[str]) -> DataFrame:
    """Run ``fn(qdf, rdf)`` where queries meet cells.  ``send(pdf, cells)`` gives (row, cell, part) of
    the queries' visits; ``part`` None means all hash parts of the cell."""
    spark = query.sparkSession
    held = spark.sparkContext.broadcast(cells)
    cols = ["_id", "_x", *query_extra]
    kinds = ", ".join(f"`{c}` {query.schema[c].dataType.simpleString()}" for c in cols)

    def route(batches):
        for pdf in batches:
            yield from visits(pdf, held.value, send)

    routed = cut_lineage(query.select(*cols).mapInPandas(route, f"{kinds}, _cell long, _part long"))
    # blocks of queries per cell, as a table joined by cell
    busy = routed.groupBy("_cell", "_part").agg(F.ceil(F.count("*") / F.lit(block_rows)).cast("int").alias("_blocks"))
    q = routed.join(busy.select(*[F.col(c).alias(c) for c in ("_cell", "_part", "_blocks")]), ["_cell", "_part"]).withColumn(
        "_qb", F.pmod(F.xxhash64("_id"), F.col("_blocks")).cast("int")).drop("_blocks")
    table = spark.createDataFrame([(int(c), int(s)) for c, s in enumerate(cells.split) if cells.rows[c]], "_cell long, _split long")
    r = dealt.select(F.col("_id").alias("_r_id"), F.col("_x").alias("_r_x"), *[F.col(c).alias(f"_r_{c}") for c in ref_extra], "_cell").join(
        table, "_cell").withColumn("_part", F.pmod(F.xxhash64("_r_id"), F.col("_split"))).drop("_split").join(
        busy, ["_cell", "_part"]).withColumn("_qb", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))).drop("_blocks")
    back = {"_r_id": "_id", "_r_x": "_x", **{f"_r_{c}": c for c in ref_extra}}

    def run(qdf: pd.DataFrame, rdf: pd.DataFrame) -> pd.DataFrame:
        return fn(qdf, rdf.rename(columns=back))

    keys = ["_cell", "_part", "_qb"]
    return q.groupBy(*keys).cogroup(r.groupBy(*keys)).applyInPandas(run, schema)


def within(reach: float | str):
    """``send`` to all cells within ``reach``: a number, or the name of the queries' own column."""
    def send(pdf, cells):
        far = pdf[reach].to_numpy(float) if isinstance(reach, str) else np.full(len(pdf), float(reach))
        row, cell = cells.reached(stack(pdf["_x"]), far)
        return row, cell, None
    return send
