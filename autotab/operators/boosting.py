"""Second-order histogram boosting.

Features are cut at quantiles into at most ``max_bins`` bins.  A tree grows level by level: one pass
adds up gradient, Hessian and row count per (class, node, feature, bin) on the executors, and the
driver, which reads those sums only, takes for every node the cut of the largest gain

    1/2 (GL^2/(HL+lambda) + GR^2/(HR+lambda) - G^2/(H+lambda)) - gamma

(ties: the first feature, the lowest cut); leaves are worth -eta G/(H+lambda).  Rows and columns can be
sampled per tree.  More than two classes are one softmax model with one tree per class and
round, grown in the same passes.

Rows are stored once by their bins (:mod:`autotab.operators.binned`): without sampling rows of equal bins are one row with a
weight, since their margins and so their gradients' sums stay the same.  Every ``REFRESH`` rounds the margins are brought
up to date, so a pass evaluates few trees.  Missing feature values go to the right.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from autotab.operators import binned, packed
from autotab.operators.binned import quantile_edges
from autotab.session import cut_lineage, release

REFRESH = 10
SCAN_ROWS = 32_768
MASK_DEPTH = 6              # a set of the leaves of a deeper tree does not fit one number
_DEBRUIJN = np.uint64(0x03F79D71B4CB0A89)
_BIT = np.zeros(64, np.int64)       # number of a single set bit, by its product with the constant
_BIT[[((1 << _i) * int(_DEBRUIJN) & (1 << 64) - 1) >> 58 for _i in range(64)]] = np.arange(64)


@dataclass
class Tree:
    """A complete binary tree in level order: feature (-1: leaf), cut (bins up to it go left), value, gain, rows."""

    depth: int
    feature: np.ndarray = None
    cut: np.ndarray = None
    value: np.ndarray = None
    gain: np.ndarray = None
    rows: np.ndarray = None

    def __post_init__(self):
        n = (2 << self.depth) - 1
        if self.feature is None:
            self.feature, self.cut = np.full(n, -1), np.zeros(n, np.int64)
            self.value, self.gain, self.rows = np.zeros(n), np.zeros(n), np.zeros(n)

    def leaf(self, bins: np.ndarray) -> np.ndarray:
        """Node that each row ends in."""
        node, at = np.zeros(len(bins), np.int64), np.arange(len(bins))
        for _ in range(self.depth):
            f = self.feature[node]
            inner = f >= 0
            if not inner.any():
                break
            right = bins[at, np.maximum(f, 0)] > self.cut[node]
            node = np.where(inner, 2 * node + 1 + right, node)
        return node

    def leaf_of(self, cols: np.ndarray) -> np.ndarray:
        """:meth:`leaf` for bins [features, rows].

        Every bin of a feature rules out the leaves on the other sides of that feature's cuts, as a set of bits; a row's
        leaf is the first that none of its features rules out.  So a row costs one look-up per feature, not per level.
        """
        if self.depth > MASK_DEPTH:
            return self.leaf(cols.T)
        leaves = 1 << self.depth
        inner = np.flatnonzero(self.feature >= 0)
        if not len(inner):
            return np.zeros(cols.shape[1], np.int64)
        left = {}
        for node in inner:
            level = (int(node) + 1).bit_length() - 1
            half = leaves >> level + 1
            out = ((1 << half) - 1) << (int(node) + 1 - (1 << level)) * 2 * half
            own = left.setdefault(int(self.feature[node]), np.full(256, (1 << 64) - 1, np.uint64))
            own[self.cut[node] + 1:] &= np.uint64((1 << 64) - 1 - out)
        at = np.zeros(leaves, np.int64)
        for level in range(self.depth):
            at = np.where(self.feature[at] >= 0, 2 * at + 1 + (np.arange(leaves) >> self.depth - 1 - level & 1), at)
        held = None
        for f, own in left.items():
            got = own[cols[f]]
            held = got if held is None else held & got
        return at[_BIT[(held & (~held + np.uint64(1))) * _DEBRUIJN >> np.uint64(58)]]


def sigmoid(m: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(m, -500, 500)))


def softmax(m: np.ndarray) -> np.ndarray:
    e = np.exp(m - m.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def gradients(objective: str, m: np.ndarray, y: np.ndarray, hessian: float) -> tuple[np.ndarray, np.ndarray]:
    """(gradient, Hessian) [rows, outputs] of the loss at margins ``m``; ``hessian`` scales that of softmax."""
    if objective == "squared":
        return m - y[:, None], np.ones_like(m)
    if objective == "logistic":
        p = sigmoid(m)
        return p - y[:, None], np.maximum(p * (1 - p), 1e-16)
    p = softmax(m)
    return p - (y[:, None] == np.arange(m.shape[1])), np.maximum(hessian * p * (1 - p), 1e-16)


@dataclass
class BoostedTrees:
    """A fitted model; ``transform`` adds prediction and, for classifiers, probability."""

    objective: str
    features: str
    edges: list
    base: list
    rounds: list = field(default_factory=list)      # per round one tree per output

    def bins(self, x: np.ndarray) -> np.ndarray:
        return binned.bin_numbers(x, self.edges)

    def margins(self, bins: np.ndarray, first: int = 0) -> np.ndarray:
        """Sum of the trees from round ``first`` on."""
        return self.margins_of(np.ascontiguousarray(bins.T), first)

    def margins_of(self, cols: np.ndarray, first: int = 0) -> np.ndarray:
        """:meth:`margins` for bins [features, rows]."""
        out = np.zeros((cols.shape[1], len(self.base)))
        for s in range(0, len(out), SCAN_ROWS):
            own, some = out[s:s + SCAN_ROWS], cols[:, s:s + SCAN_ROWS]
            for trees in self.rounds[first:]:
                for c, t in enumerate(trees):
                    own[:, c] += t.value[t.leaf_of(some)]
        return out

    def transform(self, df: DataFrame) -> DataFrame:
        import pandas as pd
        from pyspark.sql.functions import pandas_udf

        from autotab.operators.neighbours import as_array
        held = df.sparkSession.sparkContext.broadcast(self)      # trees and edges

        @pandas_udf(T.ArrayType(T.DoubleType()))
        def outputs(col):
            model = held.value
            if not len(col):
                return pd.Series([], dtype=object)
            m = model.margins(model.bins(np.vstack(col.to_numpy()))) + np.array(model.base)
            if model.objective == "logistic":
                p = sigmoid(m)
                m = np.hstack([1 - p, p])
            elif model.objective == "softmax":
                m = softmax(m)
            return pd.Series(list(m))

        got = outputs(as_array(df, self.features))
        if self.objective == "squared":
            return df.withColumn("prediction", got[0])
        best = F.array_position("probability", F.array_max("probability")) - 1
        return df.withColumn("probability", got).withColumn("prediction", best.cast("double"))

    def table(self, round_: int = 0, output: int = 0) -> list[tuple]:
        """(node, feature, cut, gain, value, rows) of the reached nodes of one tree; cut in the feature's own units."""
        t, out = self.rounds[round_][output], []
        for i in range(len(t.feature)):
            if t.rows[i]:
                f = int(t.feature[i])
                out.append((i, f, float(self.edges[f][t.cut[i]]) if f >= 0 else None, float(t.gain[i]), float(t.value[i]), int(t.rows[i])))
        return out

    def state(self) -> dict:
        return {"objective": self.objective, "features": self.features, "edges": [e.tolist() for e in self.edges], "base": list(self.base),
                "rounds": [[{"depth": t.depth} | {k: getattr(t, k).tolist() for k in ("feature", "cut", "value", "gain", "rows")}
                            for t in trees] for trees in self.rounds]}

    @staticmethod
    def of_state(s: dict) -> "BoostedTrees":
        rounds = [[Tree(t["depth"], *[np.array(t[k]) for k in ("feature", "cut", "value", "gain", "rows")]) for t in trees]
                  for trees in s["rounds"]]
        return BoostedTrees(s["objective"], s["features"], [np.array(e) for e in s["edges"]], s["base"], rounds)


def split(g: np.ndarray, h: np.ndarray, n: np.ndarray, lam: float, gamma: float, least_hessian: float, least_rows: int):
    """(gain, feature, cut, sums left, sums in all) of the best cut of one node from its histograms [features, bins]."""
    left = [np.cumsum(x, axis=1) for x in (g, h, n)]
    total = [x[0, -1] for x in left]
    right = [t - x for t, x in zip(total, left)]
    ok = (left[1] >= least_hessian) & (right[1] >= least_hessian) & (left[2] >= max(least_rows, 1)) & (right[2] >= max(least_rows, 1))
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = (left[0]**2 / (left[1] + lam) + right[0]**2 / (right[1] + lam) - total[0]**2 / (total[1] + lam)) / 2 - gamma
    gain = np.where(ok, gain, -np.inf)
    top = gain.max()
    best = int((gain >= top - 1e-9 * max(1.0, abs(top))).argmax()) if np.isfinite(top) else 0      # equal but for rounding: the first
    f, cut = divmod(best, gain.shape[1])
    return gain[f, cut], f, cut, [x[f, cut] for x in left], total


def fit(df: DataFrame, objective: str, label: str = "label", features: str = "features", *, maxIter: int = 100, maxDepth: int = 6,
        stepSize: float = 0.3, lam: float = 1.0, gamma: float = 0.0, least_hessian: float = 1.0, least_rows: int = 1,
        subsamplingRate: float = 1.0, columnRate: float = 1.0, hessian: float = 2.0, max_bins: int = 128, seed: int = 42) -> BoostedTrees:
    """Boosted trees for ``objective`` squared, logistic (labels 0 and 1) or softmax (labels 0 to k-1)."""
    from autotab.operators.neighbours import as_array
    src = df.select(as_array(df, features).alias("x"), F.col(label).cast("double").alias("y"))
    width, n, mean, classes = src.agg(F.max(F.size("x")), F.count("*"), F.avg("y"), F.max("y")).first()
    if not n:
        raise ValueError("no rows to fit on")
    d = int(width)
    outputs = int(classes) + 1 if objective == "softmax" else 1
    base = [0.0] * outputs
    if objective == "squared":
        base = [float(mean)]
    elif objective == "logistic":
        p = min(max(mean, 1e-6), 1 - 1e-6)
        base = [math.log(p / (1 - p))]
    model = BoostedTrees(objective, features, quantile_edges(src, F.col("x"), d, max_bins), base)
    edges = max(len(e) for e in model.edges) + 1
    if subsamplingRate < 1:
        held, kinds, columns = _single(src, model.edges), n, ["y", "w", "u"]
    else:
        (held, kinds), columns = binned.stored(src, model.edges, n, total=objective != "softmax"), ["y", "w"]

    def begun(b, y, w, u=None):
        if u is None and objective != "softmax":
            y = y / w
        return b, y, w, u if u is None else u.view(np.uint64), np.tile(base, (len(y), 1))

    sampled = {"share": subsamplingRate, "column_rate": columnRate, "seed": seed, "every": REFRESH}
    leaves = {"eta": stepSize, "lam": lam, "gamma": gamma, "least_hessian": least_hessian, "least_rows": least_rows}

    def grow(rows):
        return _rounds(rows, model, maxIter, maxDepth, edges, hessian, sampled, leaves)

    model.rounds = binned.work(binned.blocks(held, columns).map(lambda block: begun(*block)), kinds * (d + 8 * (3 + outputs)), grow)
    release(held)
    return model


def _rounds(rows, model: BoostedTrees, rounds: int, depth: int, edges: int, hessian: float, sampled: dict, leaves: dict) -> list:
    """The trees of all rounds, grown on blocks (bins, y, w, u, margins)."""
    d, outputs = len(model.edges), len(model.base)
    rng = np.random.default_rng(sampled["seed"])
    model = BoostedTrees(model.objective, model.features, model.edges, model.base)
    done = 0      # rounds that the stored margins hold
    for number in range(rounds):
        columns = np.sort(rng.permutation(d)[:max(1, math.ceil(sampled["column_rate"] * d))])
        salt = int(rng.integers(0, 1 << 62))
        trees = [Tree(depth) for _ in range(outputs)]
        for level in range(depth):
            first = (1 << level) - 1
            open_ = [[i for i in range(first, 2 * first + 1) if not level or trees[c].feature[(i - 1) // 2] >= 0] for c in range(outputs)]
            if not any(open_):
                break
            got = _histograms(rows, model, trees, open_, columns, done, salt, sampled["share"], hessian, edges)
            for c in range(outputs):
                for k, node in enumerate(open_[c]):
                    _grow(trees[c], node, columns, [got[x][c, k] for x in "ghn"], **leaves)
        model.rounds.append(trees)
        if (number + 1) % sampled["every"] == 0 and number + 1 < rounds:
            rows = _refreshed(rows, model, done)
            done = number + 1
    rows.release()
    return model.rounds


def _single(src: DataFrame, edges: list) -> DataFrame:
    """(b, y, w, u), stored: every row on its own, with a number to sample it by (its bits as a double)."""
    def pack(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([packed.binary(binned.bin_numbers(packed.lists(b.column("x"), len(edges)), edges)), b.column("y"),
                                              pa.array(np.ones(b.num_rows)), b.column("u")], names=["b", "y", "w", "u"])

    return cut_lineage(src.withColumn("u", F.xxhash64(F.monotonically_increasing_id())).mapInArrow(
        pack, "b binary, y double, w double, u long"))


def _grow(tree: Tree, node: int, columns: np.ndarray, hist: list, eta: float, lam: float, gamma: float, least_hessian: float, least_rows: int):
    """Cut ``node`` at its best place, if any gains, and give values to it and its children."""
    gain, f, cut, left, total = split(*hist, lam, gamma, least_hessian, least_rows)

    def worth(g, h):
        return -eta * g / (h + lam) if h + lam > 0 else 0.0

    if not node:
        tree.value[0], tree.rows[0] = worth(*total[:2]), total[2]
    if not gain > 1e-12:
        return
    tree.feature[node], tree.cut[node], tree.gain[node] = columns[f], cut, gain
    for child, (g, h, n) in ((2 * node + 1, left), (2 * node + 2, [t - x for t, x in zip(total, left)])):
        tree.value[child], tree.rows[child] = worth(g, h), n


def _histograms(rows, model, trees, open_, columns, done, salt, share, hessian, edges) -> dict[str, np.ndarray]:
    """Sums of gradient, Hessian and rows [outputs, open nodes, columns, bins]."""
    outputs, most = len(trees), max(map(len, open_))
    shape = (outputs, most, len(columns), edges)
    objective = model.objective
    nodes = (2 << trees[0].depth) - 1
    place = np.full((outputs, nodes), -1)
    for c, own in enumerate(open_):
        place[c, own] = np.arange(len(own))
    recent = BoostedTrees(objective, model.features, [], model.base, model.rounds[done:])

    def part(b, y, w, u, m):
        m = m + recent.margins_of(b)
        if share < 1:
            u = u ^ np.uint64(salt)
            u = (u ^ (u >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
            keep = (u >> np.uint64(11)).astype(float) * 2.0**-53 < share
            b, y, w, m = b[:, keep], y[keep], w[keep], m[keep]
        g, h = gradients(objective, m, y, hessian)
        out = {k: np.zeros(shape) for k in "ghn"}
        for c, tree in enumerate(trees):
            at, cols = place[c, tree.leaf_of(b)], b
            weights = [g[:, c] * w, w if objective == "squared" else h[:, c] * w, w]
            here = at >= 0
            if not here.all():
                at, cols, weights = at[here], b[:, here], [x[here] for x in weights]
            at = at * edges
            for i, j in enumerate(columns):
                key = at + cols[j]
                for k, x in zip("ghn", weights):
                    if k == "n" and objective == "squared":
                        out[k][c, :, i] = out["h"][c, :, i]
                    else:
                        out[k][c, :, i] = np.bincount(key, x, most * edges).reshape(most, edges)
        return out

    return rows.sums(part, {k: shape for k in "ghn"})


def _refreshed(rows, model: BoostedTrees, done: int):
    """The rows with the trees since round ``done`` added to their margins."""
    recent = BoostedTrees(model.objective, model.features, [], model.base, model.rounds[done:])
    return rows.map(lambda b, y, w, u, m: (b, y, w, u, m + recent.margins_of(b)))
