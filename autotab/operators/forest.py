"""Random forests over binned rows.

Every tree takes each row a Poisson(1) number of times, every node looks at a random part of the features, cuts at the bin
of the largest fall of impurity (Gini, or variance for a regression) and ends when nothing falls, at the depth limit or
where a side would keep fewer than ``least_rows`` rows.  Rows come from :mod:`autotab.operators.binned`: one row stands for
all rows of equal bins (a sum of n Poisson(1) numbers is a Poisson(n) number), so the forest is that of all rows.

Few kinds of rows are sent to tasks that grow some trees each.  Otherwise batches of trees grow level by level over
all tasks, whose state (a number of times and an open node per row and tree) is at most ``STATE_BYTES`` per core; histograms are
added up by ranges of nodes, whose best cuts are chosen there, so the driver reads cuts only.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from autotab.operators import binned
from autotab.operators.binned import quantile_edges
from autotab.session import release

STATE_BYTES = 64 << 20
PASS_BYTES = 32 << 20       # histograms of the nodes that a pass looks at
PIECE_BYTES = 4 << 20       # of which one task adds up and cuts so many


@dataclass
class ForestTree:
    """Nodes in the order they were opened: feature (-1: leaf), cut (bins up to it go left), left child (the right one follows), value."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    value: np.ndarray

    def leaf_of(self, cols: np.ndarray) -> np.ndarray:
        """Leaf of each row of bins [features, rows]."""
        node, live = np.zeros(cols.shape[1], np.int64), np.arange(cols.shape[1])
        while len(live):
            at = node[live]
            f = self.feature[at]
            inner = f >= 0
            live, at, f = live[inner], at[inner], f[inner]
            node[live] = self.left[at] + (cols[f, live] > self.cut[at])
        return node


@dataclass
class Forest:
    """A fitted forest; ``transform`` adds prediction and, for classifiers, probability."""

    classes: int                # 0: regression
    features: str
    edges: list
    trees: list = field(default_factory=list)

    def outputs(self, x: np.ndarray) -> np.ndarray:
        """[rows, classes or 1]: mean over the trees of the leaves' class shares or means."""
        cols = np.ascontiguousarray(binned.bin_numbers(x, self.edges).T)
        return sum(t.value[t.leaf_of(cols)] for t in self.trees) / len(self.trees)

    def transform(self, df: DataFrame) -> DataFrame:
        import pandas as pd
        from pyspark.sql.functions import pandas_udf

        from autotab.operators.neighbours import as_array
        held = df.sparkSession.sparkContext.broadcast(self)

        @pandas_udf(T.ArrayType(T.DoubleType()))
        def outputs(col):
            return pd.Series(list(held.value.outputs(np.vstack(col.to_numpy()))) if len(col) else [], dtype=object)

        got = outputs(as_array(df, self.features))
        if not self.classes:
            return df.withColumn("prediction", got[0])
        best = F.array_position("probability", F.array_max("probability")) - 1
        return df.withColumn("probability", got).withColumn("prediction", best.cast("double"))

    def state(self) -> dict:
        return {"classes": self.classes, "features": self.features, "edges": [e.tolist() for e in self.edges],
                "trees": [{k: getattr(t, k).tolist() for k in ("feature", "cut", "left", "value")} for t in self.trees]}

    @staticmethod
    def of_state(s: dict) -> "Forest":
        trees = [ForestTree(*[np.array(t[k]) for k in ("feature", "cut", "left", "value")]) for t in s["trees"]]
        return Forest(s["classes"], s["features"], [np.array(e) for e in s["edges"]], trees)


def fit(df: DataFrame, classes: int, label: str = "label", features: str = "features", *, numTrees: int = 100, maxDepth: int = 30,
        minInstancesPerNode: int = 1, balanced: bool = False, max_bins: int = 32, seed: int = 42) -> Forest:
    """A forest for ``classes`` classes (labels from 0) or a regression (0); ``balanced`` weighs the classes to equal sums.
    A node looks at the square root of the number of features (a third in a regression, all for a single tree)."""
    from autotab.operators.neighbours import as_array
    src = df.select(as_array(df, features).alias("x"), F.col(label).cast("double").alias("y"))
    width, n, mean = src.agg(F.max(F.size("x")), F.count("*"), F.avg("y")).first()
    if not n:
        raise ValueError("no rows to fit on")
    d = int(width)
    model = Forest(classes, features, quantile_edges(src, F.col("x"), d, max_bins))
    table, kinds = binned.stored(src, model.edges, n, total=not classes)
    value = None
    if balanced and classes:
        counts = dict(table.groupBy("y").agg(F.sum("w")).collect())
        value = np.array([n / (len(counts) * counts[c]) if c in counts else 0.0 for c in range(classes)])
    take = d if numTrees == 1 else math.ceil(math.sqrt(d)) if classes else math.ceil(d / 3)
    how = {"classes": classes, "bins": max(len(e) for e in model.edges) + 1, "d": d, "take": take, "depth": maxDepth,
           "least": minInstancesPerNode, "value": value, "mean": float(mean), "seed": seed}
    rows = binned.blocks(table, ["y", "w"]).mapPartitionsWithIndex(lambda i, it: ((*block, (i, j)) for j, block in enumerate(it)))
    sc, size = df.sparkSession.sparkContext, kinds * (d + 16)
    cores = sc.defaultParallelism
    if size <= binned.TASK_BYTES:
        sent = sc.broadcast(rows.collect())
        parts = [list(range(i, numTrees, 2 * cores)) for i in range(min(numTrees, 2 * cores))]
        grown = sc.parallelize(parts, len(parts)).map(lambda ids: (ids, _grow(binned.OneTask(list(sent.value)), ids, how, 1))).collect()
        found = {t: tree for ids, trees in grown for t, tree in zip(ids, trees)}
        model.trees = [found[t] for t in range(numTrees)]
        sent.unpersist()
    else:
        held = binned.ManyTasks(rows)
        step = max(1, int(cores * STATE_BYTES // (6 * kinds)))
        for s in range(0, numTrees, step):
            model.trees += _grow(held.kept(), list(range(s, min(numTrees, s + step))), how, cores)
        held.release()
    release(table)
    return model


def _grow(rows, ids: list[int], how: dict, cores: int) -> list[ForestTree]:
    """The trees numbered ``ids``, grown together on blocks (bins, y, w, number)."""
    k, bins, d, take, seed = how["classes"], how["bins"], how["d"], how["take"], how["seed"]
    width = (k or 1) + 1                       # sums of classes (or of the target), rows
    value, mean = how["value"], how["mean"]

    def begin(b, y, w, number):
        times = np.array([np.random.default_rng([seed, t, *number]).poisson(w) for t in ids], np.int32)
        if not k:
            y = y / w - mean
        return b, y, times, np.where(times > 0, 0, -1).astype(np.int32)

    rows = rows.map(begin)
    trees = [{"feature": [-1], "cut": [0], "left": [0], "value": [None]} for _ in ids]
    open_ = [np.array([0]) for _ in ids]       # per tree the nodes of this level
    draw = np.random.default_rng([seed, 1, ids[0]])
    most = max(1, PASS_BYTES // (8 * take * bins * width))
    for level in range(how["depth"] + 1):
        ends = np.concatenate([[0], np.cumsum([len(o) for o in open_])])
        total = int(ends[-1])
        if not total:
            break
        looked = np.sort(draw.random((total, d)).argpartition(take - 1, axis=1)[:, :take], axis=1).astype(np.int32)
        got = []
        for lo in range(0, total, most):
            hi = min(total, lo + most)

            def part(b, y, times, node, lo=lo, hi=hi):
                out = np.zeros(((hi - lo) * take * bins, width))
                for t, first in enumerate(ends[:-1]):
                    if first >= hi or ends[t + 1] <= lo:
                        continue
                    at = node[t] + first
                    row = np.flatnonzero((node[t] >= 0) & (at >= lo) & (at < hi))
                    at, c = at[row], times[t][row].astype(float)
                    # nodes of this tree only, so that adding up costs no more than its own histograms
                    a, z = max(first, lo), min(int(ends[t + 1]), hi)
                    own = out[(a - lo) * take * bins:(z - lo) * take * bins]
                    target = y[row]
                    kind = target.astype(np.int64) if k else None
                    weight = (c if value is None else c * value[kind]) if k else c * target
                    for s in range(take):
                        key = ((at - a) * take + s) * bins + b[looked[at, s], row]
                        if k:
                            own[:, :k] += np.bincount(key * k + kind, weight, len(own) * k).reshape(-1, k)
                        else:
                            own[:, 0] += np.bincount(key, weight, len(own))
                        own[:, -1] += np.bincount(key, c, len(own))
                return out.reshape(hi - lo, take, bins, width)

            pieces = max(1, min(cores, math.ceil((hi - lo) * take * bins * width * 8 / PIECE_BYTES)))
            got += rows.each(part, (hi - lo, take, bins, width), pieces, lambda h: _cuts(h, k, how["least"], level < how["depth"]))
        which, cut, sides = (np.concatenate([g[i] for g in got]) for i in range(3))
        moves, nxt = [], []
        for t, (tree, nodes) in enumerate(zip(trees, open_)):
            own = slice(ends[t], ends[t + 1])
            f = np.where(which[own] >= 0, looked[own][np.arange(len(nodes)), np.maximum(which[own], 0)], -1)
            child = np.full((len(nodes), 2), -1)
            later = []
            for i, node in enumerate(nodes):
                if not level:
                    tree["value"][0] = sides[own][i].sum(axis=0)
                if f[i] < 0:
                    continue
                tree["feature"][node], tree["cut"][node], tree["left"][node] = int(f[i]), int(cut[own][i]), len(tree["feature"])
                for side in (0, 1):
                    s = sides[own][i, side]
                    if level + 1 < how["depth"] and s[-1] >= 2 * how["least"] and s[-1] > 1 and (not k or (s[:k] > 0).sum() > 1):
                        child[i, side] = len(later)
                        later.append(len(tree["feature"]))
                    tree["feature"].append(-1)
                    tree["cut"].append(0)
                    tree["left"].append(0)
                    tree["value"].append(s)
            moves.append((f, cut[own], child))
            nxt.append(np.array(later, np.int64))
        open_ = nxt
        if not any(map(len, open_)):
            break

        def move(b, y, times, node, moves=moves):
            node = node.copy()
            for t, (f, cut, child) in enumerate(moves):
                row = np.flatnonzero(node[t] >= 0)
                at = node[t][row]
                right = b[np.maximum(f[at], 0), row] > cut[at]
                node[t][row] = np.where(f[at] >= 0, child[at, right.astype(np.int64)], -1)
            return b, y, times, node

        rows = rows.map(move)
    rows.release()
    out = []
    for tree in trees:
        s = np.array([v if v is not None else np.zeros(width) for v in tree["value"]])
        if k:
            worth = s[:, :k] / np.maximum(s[:, :k].sum(axis=1, keepdims=True), 1e-300)
        else:
            worth = mean + s[:, :1] / np.maximum(s[:, 1:], 1e-300)
        out.append(ForestTree(np.array(tree["feature"], np.int32), np.array(tree["cut"], np.int32), np.array(tree["left"], np.int64), worth))
    return out


def _cuts(h: np.ndarray, k: int, least: int, may: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(which of the features looked at, cut, sums [left, right]) of the best cut of each node from its histograms
    [nodes, features, bins, sums]; the feature is -1 where no cut lowers the impurity (ties: first feature, lowest cut)."""
    left = h.cumsum(axis=2)
    whole = left[:, :1, -1:, :]
    right = whole - left
    right[np.abs(right) < 1e-12 * np.abs(whole)] = 0

    def purity(s):
        top, n = ((s[..., :k]**2).sum(axis=-1), s[..., :k].sum(axis=-1)) if k else (s[..., 0]**2, s[..., 1])
        return np.divide(top, n, out=np.zeros_like(top), where=n > 0)

    before = purity(whole)
    gain = purity(left) + purity(right) - before
    ok = (left[..., -1] >= max(least, 1)) & (right[..., -1] >= max(least, 1)) & (gain > 1e-10 * np.maximum(before, 1e-6)) & may
    gain = np.where(ok, gain, -np.inf).reshape(len(h), -1)
    best = gain.argmax(axis=1)
    which, cut = np.divmod(best, h.shape[2])
    node = np.arange(len(h))
    sides = np.stack([left[node, which, cut], right[node, which, cut]], axis=1)
    return np.where(np.isfinite(gain[node, best]), which, -1), cut, sides
