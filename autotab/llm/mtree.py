"""Exact top-k inner products by best-first search of M-trees.

Vectors are scaled and floored to integers.  A further component that brings
every stored vector to the same length turns the largest inner products into the
smallest Euclidean distances, so metric bounds apply.  Rows are dealt to cells
around a bounded set of pivots, large cells are split by hash into tiles, and
every tile becomes one M-tree: paged nodes with a routing vector, a covering
radius and the distances of their entries to the routing vector.  A query first
visits a tile of its nearest cell, whose k-th score is its floor, then, in blocks, the other
tiles whose cell could hold a result; a block is searched best page first, and each of its queries
skips entries by |d(q, router) - d(entry, router)| before its distance to them
counts.  Scores are exact integers; bounds are applied with a margin
for rounding, so pruning never changes a result.

Defined cases: null ids, null vectors and vectors holding null or non-finite
components take no part; shorter vectors count as padded with zeros; a query never
finds rows of its own id; of several rows with a query's id the smallest vector asks;
repeated rows are candidates each; ties go to the smaller id; an empty table
gives no rows; other columns of the input are not read.  Components of 2^31 or
more after scaling, and vectors of a squared length of 2^52 or more, raise an error.
"""

from __future__ import annotations

import heapq
import pickle
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from autotab.llm.common import stored

PIVOTS = 1024         # at most; the bound of everything sent to the tasks
CELL_ROWS = 4096      # rows per pivot aimed at
TILE_ROWS = 8192      # rows per tree
QUERY_ROWS = 2048     # queries per block
PAGE = 256
FANOUT = 16


def prepared(df: DataFrame, id_col: str, vec_col: str, scale: float) -> DataFrame:
    """(vec_id, v): ids and integer components of the rows that take part."""
    x = F.col(vec_col).cast("array<double>")
    whole = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    big = F.raise_error(F.lit("a component is too large for integer scores"))
    return (df.filter(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull()).filter(whole)
            .select(F.col(id_col).cast("long").alias("vec_id"), F.transform(x, lambda c: F.when(
                F.abs(c * scale) < 2.0**31, F.floor(c * scale).cast("int")).otherwise(big.cast("int"))).alias("v")))


def matrix(vectors, width: int) -> np.ndarray:
    """[rows, width] doubles from integer lists, padded with zeros."""
    out = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        out[i, :len(v)] = v
    return out


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """[rows of a, rows of b] Euclidean."""
    square = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * a @ b.T
    return np.sqrt(np.maximum(square, 0))


def levelled(x: np.ndarray, top: float) -> np.ndarray:
    """``x`` with a component that brings every row to the squared length ``top``."""
    return np.concatenate([x, np.sqrt(np.maximum(top - (x * x).sum(axis=1, keepdims=True), 0))], axis=1)


@dataclass
class Node:
    router: np.ndarray        # levelled routing vector
    radius: float             # covers everything below
    apart: np.ndarray         # distances of the entries' routers (or rows) to ``router``
    children: list            # Nodes, or empty in a leaf
    rows: np.ndarray          # row numbers of a leaf


class Tree:
    """An M-tree over one tile."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, top: float):
        self.ids, self.x, self.top = ids, x, top
        wide = levelled(x, top)
        self.root = self._build(np.arange(len(ids)), wide, wide[0])

    def _build(self, rows: np.ndarray, wide: np.ndarray, router: np.ndarray) -> Node:
        apart = distances(wide[rows], router[None])[:, 0]
        radius = float(apart.max())
        if len(rows) <= PAGE:
            return Node(router, radius, apart, [], rows)
        routers, near = [int(rows[apart.argmax()])], None
        while True:    # farthest-first routing rows
            d = distances(wide[rows], wide[routers[-1]][None])[:, 0]
            if near is None:
                near, own = d, np.zeros(len(rows), np.int64)
            else:
                closer = d < near
                near, own = np.where(closer, d, near), np.where(closer, len(routers) - 1, own)
            if len(routers) == FANOUT or near.max() < 1e-6:
                break
            routers.append(int(rows[near.argmax()]))
        if len(routers) == 1:    # equal rows: plain pages
            parts = [rows[i:i + PAGE] for i in range(0, len(rows), PAGE)]
            children = [self._build(p, wide, wide[p[0]]) for p in parts]
        else:
            children = [self._build(rows[own == j], wide, wide[r]) for j, r in enumerate(routers) if (own == j).any()]
        between = distances(np.stack([c.router for c in children]), router[None])[:, 0]
        return Node(router, radius, between, children, rows[:0])

    def search(self, own: np.ndarray, q: np.ndarray, k: int, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """(scores, ids) [queries, k] of the k best rows but each query's ``own``, best first and
        with -inf where there are fewer, and the number of distances and products that bounds left to do.

        Queries are searched together: the page with the smallest bound of any of them comes first, its products with
        all queries it can still matter to are one matrix product, and each query leaves by its
        own bounds.  ``floor`` holds scores that k rows are known to reach.
        """
        m = len(q)
        wide, square = np.concatenate([q, np.zeros((m, 1))], axis=1), (q * q).sum(axis=1)
        slack = 1e-9 * (square + self.top) + 1e-6
        best, names = np.full((m, k), -np.inf), np.full((m, k), np.iinfo(np.int64).max)
        kth = np.asarray(floor, float).copy()

        def reach(at):
            """Largest distance that could still matter to a query."""
            with np.errstate(invalid="ignore"):
                return np.where(np.isneginf(kth[at]), np.inf, np.sqrt(np.maximum(
                    square[at] + self.top - 2 * (kth[at] - slack[at]), 0))) + 1e-6

        at = np.arange(m)
        d = distances(wide, self.root.router[None])[:, 0]
        queue, tie, work = [(0.0, 0, self.root, at, d)], 0, m
        while queue:
            _, _, node, at, d = heapq.heappop(queue)
            limit = reach(at)
            alive = d - node.radius <= limit
            at, d, limit = at[alive], d[alive], limit[alive]
            if not len(at):
                continue
            if node.children:
                radius = np.array([c.radius for c in node.children])
                near = np.abs(d[:, None] - node.apart) - radius <= limit[:, None]
                far = distances(wide[at], np.stack([c.router for c in node.children]))
                work += int(near.sum())
                bound = np.maximum(far - radius, 0)
                near &= bound <= limit[:, None]
                for j, child in enumerate(node.children):
                    own_at = np.flatnonzero(near[:, j])
                    if len(own_at):
                        tie += 1
                        heapq.heappush(queue, (float(bound[own_at, j].min()), tie, child, at[own_at], far[own_at, j]))
                continue
            near = np.abs(d[:, None] - node.apart) <= limit[:, None]
            some = near.any(axis=0)
            rows, near = node.rows[some], near[:, some]
            if not len(rows):
                continue
            work += int(near.sum())
            near &= self.ids[rows] != own[at][:, None]
            score = np.where(near, q[at] @ self.x[rows].T, -np.inf)
            least = np.partition(score, -k, axis=1)[:, -k] if len(rows) > k else np.full(len(at), -np.inf)
            i, j = np.nonzero((score >= np.maximum(kth[at], least)[:, None]) & near)
            if not len(i):
                continue
            hit = np.unique(i)      # queries that may change: their lists and the new rows are sorted together
            who = np.concatenate([np.repeat(hit, k), i])
            scores = np.concatenate([best[at[hit]].ravel(), score[i, j]])
            ids = np.concatenate([names[at[hit]].ravel(), self.ids[rows[j]]])
            order = np.lexsort((ids, -scores, who))
            start = np.flatnonzero(np.diff(who[order], prepend=-1))
            take = order[start[:, None] + np.arange(k)]
            best[at[hit]], names[at[hit]] = scores[take], ids[take]
            kth[at[hit]] = np.maximum(kth[at[hit]], best[at[hit], -1])
        return best, names, work


def top_k(df: DataFrame, is_query: Column, *, id_col: str = "vec_id", vec_col: str = "embedding",
          scale: float = 256.0, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best rows of ``df`` for each of its rows
    that satisfy ``is_query`` (a condition on the id column)."""
    spark = df.sparkSession
    rows = prepared(df, id_col, vec_col, scale)
    norm = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x)
    n, width, top = rows.agg(F.count("*"), F.max(F.size("v")), F.max(norm)).first()
    schema = "query_id long, rank int, vec_id long, score long"
    if not n:
        return spark.createDataFrame([], schema)
    if top >= 2.0**52:
        raise ValueError("vectors are too long for exact integer scores in doubles")
    width, top = max(width, 1), float(top)
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(max(1, min(PIVOTS, n // CELL_ROWS, n))).collect()
    pivot_ids, pivots = np.array([r.vec_id for r in sample]), matrix([r.v for r in sample], width)
    held = spark.sparkContext.broadcast((pivot_ids, pivots, levelled(pivots, top)))    # at most PIVOTS vectors

    def deal(batches):
        for b in batches:
            x = matrix(b.column("v").to_pylist(), width)
            d = distances(levelled(x, top), held.value[2])
            cell = d.argmin(axis=1)
            yield pa.RecordBatch.from_arrays(
                [pa.array(cell, pa.int32()), pa.array(d[np.arange(len(d)), cell], pa.float64()), b.column("vec_id"),
                 b.column("v")], names=["cell", "apart", "vec_id", "v"])

    dealt = rows.mapInArrow(deal, "cell int, apart double, vec_id long, v array<int>")
    cells = dealt.groupBy("cell").agg(F.count("*").alias("n"), F.max("apart").alias("radius")).collect()
    tiles = {r.cell: -(-r.n // TILE_ROWS) for r in cells}
    parts = F.element_at(F.create_map(*[F.lit(v) for r in tiles.items() for v in r]), F.col("cell"))
    tiled = dealt.withColumn("tile", F.pmod(F.xxhash64("vec_id", "v"), parts).cast("int"))

    def build(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("vec_id", kind="stable")
        tree = Tree(pdf["vec_id"].to_numpy(), matrix(list(pdf["v"]), width), top)
        return pd.DataFrame({"cell": [key[0]], "tile": [key[1]], "tree": [pickle.dumps(tree)]})

    trees = stored(tiled.groupBy("cell", "tile").applyInPandas(build, "cell int, tile int, tree binary"))
    asking = df.filter(is_query).select(*dict.fromkeys([id_col, vec_col]))
    queries = prepared(asking, id_col, vec_col, scale).groupBy("vec_id").agg(F.min("v").alias("v"))
    blocks = max(1, -(-queries.count() // QUERY_ROWS))
    order = sorted(cells, key=lambda r: r.cell)
    radii, counts = np.array([r.radius for r in order]), [tiles[r.cell] for r in order]
    numbers = np.array([r.cell for r in order])
    none = F.lit(float("-inf"))

    def bounds(b, floor):
        """[queries, cells] whether a cell may hold a row that reaches the floor, and the distances to the cells."""
        x = matrix(b.column("v").to_pylist(), width)
        square = (x * x).sum(axis=1)
        far = distances(np.concatenate([x, np.zeros((len(x), 1))], axis=1), held.value[2][numbers])
        low = np.maximum(far - radii, 0)
        upper = (square[:, None] + top - low * low) / 2
        return upper + 1e-9 * (square[:, None] + top) + 1e-6 >= floor[:, None], far

    def sent(b, cell, tile, which, floor):
        return pa.RecordBatch.from_arrays(
            [pa.array(cell, pa.int32()), pa.array(tile, pa.int32()),
             *[b.column(c).take(pa.array(which, pa.int64())) for c in ("vec_id", "v")], pa.array(floor, pa.float64())],
            names=["cell", "tile", "vec_id", "v", "floor"])

    def home(own, nearest):
        """The one tile of its nearest cell that a query visits first."""
        return np.abs(own) % np.array(counts)[nearest]

    def first(batches):
        for b in batches:
            nearest = bounds(b, np.full(b.num_rows, -np.inf))[1].argmin(axis=1)
            own = b.column("vec_id").to_numpy(zero_copy_only=False)
            yield sent(b, numbers[nearest], home(own, nearest), np.arange(b.num_rows), np.full(b.num_rows, -np.inf))

    def rest(batches):
        for b in batches:
            own, floor = b.column("vec_id").to_numpy(zero_copy_only=False), b.column("floor").to_numpy(zero_copy_only=False)
            near, far = bounds(b, floor)
            nearest = far.argmin(axis=1)
            i, c = np.nonzero(near)
            copies = np.array(counts)[c]
            which, cell = np.repeat(i, copies), np.repeat(c, copies)
            tile = np.arange(len(which)) - np.repeat(np.cumsum(copies) - copies, copies)
            new = ~((cell == nearest[which]) & (tile == home(own, nearest)[which]))
            which, cell, tile = which[new], cell[new], tile[new]
            yield sent(b, numbers[cell], tile, which, floor[which])

    def find(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        tree, own = pickle.loads(left["tree"].iloc[0]), right["vec_id"].to_numpy()
        best, names, _ = tree.search(own, matrix(list(right["v"]), width), k, right["floor"].to_numpy())
        full = np.isfinite(best)
        return pd.DataFrame({"query_id": np.repeat(own, full.sum(axis=1)), "vec_id": names[full], "score": best[full].astype(np.int64)})

    keys, kind = ["cell", "tile", "block"], "query_id long, vec_id long, score long"
    parts_ = max(int(spark.conf.get("spark.sql.shuffle.partitions")), len(cells))

    def visited(routed: DataFrame) -> DataFrame:
        """What the routed queries find; a tree goes only to blocks with a query for it."""
        routed = stored(routed.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")))
        needed = trees.join(routed.select(*[F.col(c).alias(c) for c in keys]).distinct(), ["cell", "tile"])
        return stored(needed.repartition(parts_, *keys).groupBy(*keys)
                      .cogroup(routed.repartition(parts_, *keys).groupBy(*keys)).applyInPandas(find, kind))

    shape = "cell int, tile int, vec_id long, v array<int>, floor double"
    queries = stored(queries)
    near = visited(queries.mapInArrow(first, shape))
    floors = near.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("s")).select(
        F.col("query_id").alias("vec_id"), F.when(F.col("n") >= k, F.col("s").cast("double")).otherwise(none).alias("floor"))
    asked = queries.join(floors, "vec_id", "left").withColumn("floor", F.coalesce("floor", none))
    found = near.union(visited(asked.mapInArrow(rest, shape)))
    ranked = found.withColumn("rank", F.row_number().over(
        Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
