"""Exact nearest-neighbour work on Spark without emitting row pairs.

Rows are cut into blocks by a hash of their id. Every (query block, reference
block) pair meets once in a cogrouped ``applyInPandas`` call, where numpy
computes the block's distances in memory and returns only a bounded summary
per query row (its k best candidates, its neighbour count, per-cluster
distance sums, ...). Block sizes are set from the row counts so each group
holds at most ``block_rows`` rows from each side, whatever the key skew
(ids are unique, so hashing them spreads evenly). The work is the inherent
O(n^2) of exact search, spread over (n / block_rows)^2 tasks; nothing goes
through the driver and no pair table is materialised.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from autotab.operators import cells

BLOCK_ROWS = 4096
MERGE_FANOUT = 64
_CHUNK_CELLS = 4_000_000  # query-chunk x block x dim doubles per numpy step


def as_array(df: DataFrame, features: str) -> Column:
    dt = df.schema[features].dataType
    if isinstance(dt, T.ArrayType):
        return F.col(features).cast("array<double>")
    return vector_to_array(features)


def _stack(series: pd.Series, dim: int | None = None) -> np.ndarray:
    if len(series) == 0:
        return np.zeros((0, dim or 0))
    return np.vstack([np.asarray(v, dtype=np.float64) for v in series])


def pair_distances(X: np.ndarray, Y: np.ndarray):
    """Yield (row_slice, distance matrix) chunks; direct differences, no
    |x|^2 + |y|^2 - 2xy cancellation."""
    if len(X) == 0:
        return
    step = max(1, _CHUNK_CELLS // max(1, len(Y) * max(1, X.shape[1])))
    for s in range(0, len(X), step):
        diff = X[s:s + step, None, :] - Y[None, :, :]
        yield slice(s, s + step), np.sqrt(np.einsum("ijk,ijk->ij", diff, diff))


def blocked(query: DataFrame, ref: DataFrame, fn, schema: str, block_rows: int = BLOCK_ROWS,
            query_extra: list[str] | None = None, ref_extra: list[str] | None = None,
            counts: tuple[int, int] | None = None, reach: float | None = None) -> DataFrame:
    """Run ``fn(qdf, rdf) -> pandas`` once per (query block, reference block).

    ``query``/``ref`` carry ``_id`` and ``_x`` (array<double>) plus extras.
    Each query row is copied to every reference block and vice versa, so a
    group holds about ``block_rows`` rows of each side. With ``reach`` only pairs within that
    distance matter to ``fn``: blocks are then metric cells (:mod:`autotab.operators.cells`) and a
    query row goes only to cells that the triangle inequality cannot rule out.
    """
    nq, nr = counts or (query.count(), ref.count())
    if reach is not None and nr > block_rows:
        return _reaching(query, ref, fn, schema, block_rows, query_extra, ref_extra, reach)
    qb_n = max(1, math.ceil(nq / block_rows))
    rb_n = max(1, math.ceil(nr / block_rows))
    q = (query.select("_id", "_x", *(query_extra or []))
         .withColumn("_qb", F.pmod(F.xxhash64("_id"), F.lit(qb_n)).cast("int"))
         .withColumn("_rb", F.explode(F.sequence(F.lit(0), F.lit(rb_n - 1)))))
    # The reference side gets its own column names so a self-join (same
    # DataFrame on both sides) cannot confuse the two inputs.
    extras = list(ref_extra or [])
    r = (ref.select(F.col("_id").alias("_r_id"), F.col("_x").alias("_r_x"),
                    *[F.col(c).alias(f"_r_{c}") for c in extras])
         .withColumn("_rb", F.pmod(F.xxhash64("_r_id"), F.lit(rb_n)).cast("int"))
         .withColumn("_qb", F.explode(F.sequence(F.lit(0), F.lit(qb_n - 1)))))
    back = {"_r_id": "_id", "_r_x": "_x", **{f"_r_{c}": c for c in extras}}

    def run(qdf: pd.DataFrame, rdf: pd.DataFrame) -> pd.DataFrame:
        return fn(qdf, rdf.rename(columns=back))

    return q.groupBy("_qb", "_rb").cogroup(r.groupBy("_qb", "_rb")).applyInPandas(run, schema)


def _reaching(query: DataFrame, ref: DataFrame, fn, schema: str, block_rows: int, query_extra, ref_extra,
              reach: float) -> DataFrame:
    """``blocked`` over metric cells: a query row meets only cells within ``reach``."""
    found, dealt = cells.build(ref, block_rows)
    return cells.meet(found, dealt, query, cells.within(reach), fn, schema, block_rows, list(query_extra or []), list(ref_extra or []))


def _prepare_side(df: DataFrame, id_col: str, features: str, extra: list[str] | None = None):
    return df.select(F.col(id_col).alias("_id"), as_array(df, features).alias("_x"), *(extra or []))


def knn_join(query: DataFrame, ref: DataFrame, k: int, id_col: str = "row_id",
             features: str = "features", exclude_self: bool = False,
             block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Exact k nearest reference rows per query row by Euclidean distance.

    Returns (row_id, neighbor, rank, dist); ties broken by neighbour id.
    ``exclude_self`` drops the pair with equal ids (self-join use).

    Reference rows are dealt to metric cells.  A query first visits one cell near it, whose k-th distance is
    its reach, and then only the cells that the triangle inequality cannot rule out, so on clustered rows its
    copies do not grow with the table.  Without any cell of k rows it visits them all.
    """
    id_type = query.schema[id_col].dataType.simpleString()
    schema = f"_qid {id_type}, _nid {id_type}, dist double, _blk long"
    q, r = _prepare_side(query, id_col, features), _prepare_side(ref, id_col, features)
    found, dealt = cells.build(r, block_rows)
    if found is None:
        return query.sparkSession.createDataFrame([], f"{id_col} {id_type}, neighbor {id_type}, rank int, dist double")
    least = k + 1 if exclude_self else k

    def first(pdf, c):
        """One hash part of a near cell of enough rows."""
        at = c.home(_stack(pdf["_x"]), least)
        row = np.flatnonzero(at >= 0)
        return row, at[row], pdf.index.to_numpy()[row] % c.split[at[row]]

    def nearest(qdf, rdf):
        """(distances, order) of the k nearest rows of ``rdf``, a chunk of queries at a time."""
        rid, qid = rdf["_id"].to_numpy(), qdf["_id"].to_numpy()
        rid_order = np.argsort(np.argsort(rid, kind="stable"), kind="stable").astype(np.float64)
        for sl, D in pair_distances(_stack(qdf["_x"]), _stack(rdf["_x"])):
            if exclude_self:
                D = np.where(qid[sl, None] == rid[None, :], np.inf, D)
            order = np.lexsort((np.broadcast_to(rid_order, D.shape), D), axis=-1)[:, :min(k, D.shape[1])]
            yield sl, np.take_along_axis(D, order, axis=1), order

    def kth(qdf: pd.DataFrame, rdf: pd.DataFrame) -> pd.DataFrame:
        reach = np.full(len(qdf), np.inf)
        if len(qdf) and len(rdf) >= k:
            for sl, d, _ in nearest(qdf, rdf):
                reach[sl] = d[:, k - 1]
        return pd.DataFrame({"_qid": qdf["_id"].to_numpy(), "_reach": reach})

    def top(qdf: pd.DataFrame, rdf: pd.DataFrame) -> pd.DataFrame:
        if len(qdf) == 0 or len(rdf) == 0:
            return pd.DataFrame({"_qid": [], "_nid": [], "dist": [], "_blk": []})
        blk = int(qdf["_cell"].iloc[0]) * 64 + int(qdf["_part"].iloc[0]) % 64
        rid, qid, out = rdf["_id"].to_numpy(), qdf["_id"].to_numpy(), []
        for sl, d, order in nearest(qdf, rdf):
            ok = np.isfinite(d)
            out.append(pd.DataFrame({"_qid": np.repeat(qid[sl], ok.sum(axis=1)), "_nid": rid[order][ok], "dist": d[ok]}))
        return pd.concat(out).assign(_blk=blk)

    near = cells.meet(found, dealt, q, first, kth, f"_qid {id_type}, _reach double", block_rows, [], [])
    asked = q.join(near.withColumnRenamed("_qid", "_id"), "_id", "left").withColumn(
        "_reach", F.coalesce("_reach", F.lit(float("inf"))))
    cand = cells.meet(found, dealt, asked, cells.within("_reach"), top, schema, block_rows, ["_reach"], [])
    # Merge the candidates of many cells in a tree: each window sees at most k x MERGE_FANOUT rows of a cell group.
    n_blocks = int(found.first[-1]) * 64
    while n_blocks > MERGE_FANOUT * MERGE_FANOUT:
        w = Window.partitionBy("_qid", F.expr(f"_blk div {MERGE_FANOUT}")).orderBy("dist", "_nid")
        cand = (cand.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= k)
                .withColumn("_blk", F.expr(f"_blk div {MERGE_FANOUT}")).drop("_r"))
        n_blocks = math.ceil(n_blocks / MERGE_FANOUT)
    w = Window.partitionBy("_qid").orderBy("dist", "_nid")
    return (cand.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
            .select(F.col("_qid").alias(id_col), F.col("_nid").alias("neighbor"),
                    F.col("rank").cast("int").alias("rank"), "dist"))


def neighbour_counts(df: DataFrame, eps: float, id_col: str = "row_id",
                     features: str = "features", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(row_id, n_within): rows within ``eps`` of each row, itself included."""
    id_type = df.schema[id_col].dataType.simpleString()

    def cnt(qdf, rdf):
        if len(qdf) == 0 or len(rdf) == 0:
            return pd.DataFrame({"_qid": [], "n": []})
        X, Y = _stack(qdf["_x"]), _stack(rdf["_x"])
        n = np.zeros(len(X), dtype=np.int64)
        for sl, D in pair_distances(X, Y):
            n[sl] = (D <= eps).sum(axis=1)
        return pd.DataFrame({"_qid": qdf["_id"].to_numpy(), "n": n})

    side = _prepare_side(df, id_col, features)
    part = blocked(side, side, cnt, f"_qid {id_type}, n long", block_rows, reach=eps)
    return part.groupBy(F.col("_qid").alias(id_col)).agg(F.sum("n").alias("n_within"))


class KNNClassifierModel:
    """k-NN vote: labels of the k nearest training rows; ties -> smaller
    label; probability = vote share per class."""

    def __init__(self, train: DataFrame, k: int, ids: list[str], label: str, features: str):
        self.train, self.k, self.id = train, k, ids[0]
        self.label, self.features = label, features
        self.n_classes = int(train.agg(F.max(label)).first()[0]) + 1

    def transform(self, df: DataFrame) -> DataFrame:
        nb = knn_join(df, self.train, self.k, self.id, self.features)
        labels = self.train.select(F.col(self.id).alias("neighbor"), F.col(self.label).alias("_nl"))
        votes = nb.join(labels, "neighbor").groupBy(self.id, "_nl").agg(F.count(F.lit(1)).alias("_v"))
        probs = votes.groupBy(self.id).agg(
            F.max_by("_nl", F.struct(F.col("_v"), -F.col("_nl"))).alias("prediction"),
            F.map_from_entries(F.collect_list(F.struct(F.col("_nl").cast("int"), "_v"))).alias("_m"),
            F.sum("_v").alias("_t"))
        arr = F.array(*[F.coalesce(F.col("_m")[c], F.lit(0)) / F.col("_t")
                        for c in range(self.n_classes)])
        probs = probs.select(self.id, "prediction", arr.alias("probability"))
        return df.join(probs, self.id, "left")
