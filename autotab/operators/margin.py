"""Linear margin models on (random Fourier) features: ``linear_margin`` minimises hinge losses by Newton steps on
smoothed hinges; epsilon-insensitive regression (``fit_svr``) and the one-class SVM are two uses of it. Every
step is a pass whose sums are added up on the executors; the weights (length d) go back to the tasks in the
next step's closure. A solution is accepted when its duality gap is small enough; reaching the limit warns."""

from __future__ import annotations

import warnings

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from autotab.operators import packed
from autotab.session import cut_lineage, release

#: Tried in one pass: lengths of the Newton step, and steps damped by multiples of the full curvature's diagonal.
LENGTHS = np.array([1.0, 0.5, 0.25, 0.1, 0.03])
DAMPING = 10.0 ** np.arange(-6, 3)


def packed_rows(df: DataFrame, x: str, width: int, constant: float, y=None) -> DataFrame:
    """(z, y) stored: the array column ``x`` followed by ``constant`` as bytes, and the target."""
    def run(batches):
        for b in batches:
            v = packed.lists(b.column("x"), width)
            yield pa.RecordBatch.from_arrays([packed.binary(np.hstack([v, np.full((len(v), 1), constant)])), b.column("y")],
                                             names=["z", "y"])

    src = df.select(F.col(x).alias("x"), (F.lit(0.0) if y is None else y).cast("double").alias("y"))
    return cut_lineage(src.mapInArrow(run, "z binary, y double")).persist()


def linear_margin(data: DataFrame, hinges, ridge: np.ndarray, weight: float, linear: np.ndarray, start: np.ndarray,
                  tol: float = 1e-3, steps: int = 200, dual=None) -> tuple[np.ndarray, float]:
    """(w, gap) of min 1/2 w'Rw + linear'w + weight * sum of max(0, s * w.z + o) over rows (z, y) and hinges.

    ``hinges(y)`` gives the (s, o) of each hinge; R is the diagonal ``ridge``. Hinges are smoothed over a width
    mu (quadratic between 0 and mu), minimised by damped Newton steps, and mu shrinks threefold from solution to
    solution, from the mean size of the hinges' arguments at ``start`` on. The slopes of the smoothed hinges, within [0, weight], are a feasible point of the dual, whose value
    comes from the same pass:  sum of a * o - 1/2 v'R^-1 v  with v = linear + sum of a * s * z; a problem with an
    equality in its dual gives ``dual(sum of slope * s * z)`` instead. The search ends when primal minus dual is at most ``tol`` times the primal's size (``gap``, relative).
    """
    d, w = len(ridge), np.asarray(start, float)
    tasks = data.rdd.getNumPartitions()

    def sizes(b):
        t = [np.abs(s * (packed.matrix(b.column("z")) @ w) + o) for s, o in hinges(b.column("y").to_numpy())]
        return {"t": sum(x.sum() for x in t), "n": sum(map(len, t)), "b": (packed.matrix(b.column("z"))**2).sum(axis=0)}

    first = packed.sums(data, sizes, {"t": (), "n": (), "b": (d,)}, tasks)
    base = weight * first["b"]
    mu = float(first["t"] / max(first["n"], 1)) or 1.0

    def at(w, mu):
        def part(b):
            z, out = packed.matrix(b.column("z")), {"h": np.zeros((d, d)), "g": np.zeros(d), "p": 0.0, "s": 0.0, "o": 0.0}
            m = z @ w
            for s, o in hinges(b.column("y").to_numpy()):
                t = s * m + o
                slope = np.clip(t / mu, 0, 1)
                inside = (t > 0) & (t < mu)
                out["h"] += z[inside].T @ z[inside] / mu
                out["g"] += z.T @ (s * slope)
                out["p"] += np.maximum(t, 0).sum()
                out["s"] += (slope * t - mu * slope**2 / 2).sum()
                out["o"] += (slope * o).sum()
            return out

        return packed.sums(data, part, {"h": (d, d), "g": (d,), "p": (), "s": (), "o": ()}, tasks)

    def losses(tries, mu):
        """Smoothed loss at each row of ``tries``."""
        def part(b):
            m, total = packed.matrix(b.column("z")) @ tries.T, np.zeros(len(tries))
            for s, o in hinges(b.column("y").to_numpy()):
                t = s * m + np.reshape(o, (-1, 1))
                slope = np.clip(t / mu, 0, 1)
                total += (slope * t - mu * slope**2 / 2).sum(axis=0)
            return {"f": total}

        return packed.sums(data, part, {"f": (len(tries),)}, tasks)["f"]

    def smooth(w, loss):
        return (ridge * w * w).sum(axis=-1) / 2 + w @ linear + weight * loss

    best, bound, gap = (np.inf, w), -np.inf, np.inf
    for _ in range(steps):
        t = at(w, mu)
        quad = float((ridge * w * w).sum() / 2 + linear @ w)
        primal = quad + weight * float(t["p"])
        size = max(abs(primal), 1e-12)
        v = linear + weight * t["g"]
        bound = max(bound, dual(t["g"]) if dual else weight * float(t["o"]) - float((v * v / ridge).sum()) / 2)
        best = min(best, (primal, w), key=lambda x: x[0])
        gap = (best[0] - bound) / max(abs(best[0]), 1e-12)
        if gap <= tol:
            return best[1], gap
        grad = ridge * w + v
        curve = np.diag(ridge) + weight * t["h"]
        step = np.linalg.solve(curve, -grad)
        decrease = -float(grad @ step)
        if decrease > 1e-9 * size:
            tries = w + np.vstack([LENGTHS[:, None] * step] + [
                np.linalg.solve(curve + np.diag(x * base), -grad) for x in DAMPING])
            tried = smooth(tries, losses(tries, mu))
            i = int(tried.argmin())
            if tried[i] < smooth(w, float(t["s"])):
                w = tries[i]
            else:
                mu /= 3
        if decrease <= 1e-6 * size:      # solved for this width
            mu /= 3
    warnings.warn(f"linear_margin stopped at its limit of {steps} steps with a gap of {gap:.1e}", stacklevel=2)
    return best[1], gap


class LinearScore:
    """Applies x.w + params[0] (through the same feature map) as ``prediction``."""

    def __init__(self, projector, w, b, out="prediction"):
        self.projector, self.w, self.b, self.out = projector, w, b, out

    def transform(self, df: DataFrame) -> DataFrame:
        z = self.projector(df)
        w = F.array(*[F.lit(float(v)) for v in self.w])
        dot = F.aggregate(F.zip_with(vector_to_array("rff"), w, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
        return z.withColumn(self.out, dot + float(self.b)).drop("rff")


def fit_svr(df: DataFrame, label: str = "label", features: str = "features", epsilon: float = 0.1,
            C: float = 1.0, n_components: int = 100, gamma: float | None = None, tol: float = 1e-3):
    """RBF support vector regression: Fourier features, 1/2 |w|^2 + C sum max(0, |y - f| - epsilon).
    The target is standardised inside the fit (C and epsilon hold on that scale) and the output
    is scaled back."""
    from autotab.operators.models import _feature_dim, fourier_features, scale_gamma
    d = _feature_dim(df, features)
    proj = fourier_features(features, d, n_components, gamma or scale_gamma(df, features))
    mean, sd = df.agg(F.avg(label), F.stddev_pop(label)).first()
    sd = sd or 1.0
    rows = proj(df).withColumn("_z", vector_to_array("rff"))
    data = packed_rows(rows, "_z", n_components, 1.0, (F.col(label) - mean) / sd)
    w, gap = linear_margin(data, lambda y: [(-1.0, y - epsilon), (1.0, -y - epsilon)], np.append(np.ones(n_components), 1e-2),
                           C, np.zeros(n_components + 1), np.zeros(n_components + 1), tol=tol)
    data.unpersist()
    release(data)
    out = LinearScore(proj, w[:-1] * sd, w[-1] * sd + mean)
    out.gap = gap
    return out


def fit_one_class(df: DataFrame, features: str = "features", nu: float = 0.5,
                  n_components: int = 100, gamma: float | None = None, tol: float = 1e-3):
    """One-class SVM in Fourier-feature space: minimise 1/2|w|^2 +
    1/(nu n) sum max(0, rho - w.z) - rho. Score = rho - w.z (higher = more
    anomalous)."""
    from autotab.operators.models import _feature_dim, fourier_features, scale_gamma
    d = _feature_dim(df, features)
    proj = fourier_features(features, d, n_components, gamma or scale_gamma(df, features))
    data = packed_rows(proj(df).withColumn("_z", vector_to_array("rff")), "_z", n_components, -1.0)

    def total(b):
        z = packed.matrix(b.column("z"))
        return {"n": len(z), "z": z.sum(axis=0)}

    s = packed.sums(data, total, {"n": (), "z": (n_components + 1,)}, data.rdd.getNumPartitions())
    n, mean = float(s["n"]), s["z"][:-1] / s["n"]
    whole = s["z"][:-1]

    def dual(g):
        """-|sum a z|^2 / (2 nu n) at the slopes moved to sum a = nu n: scaled down, or up towards 1."""
        total, az = g[-1], -g[:-1]
        if total >= nu * n:
            az = az * (nu * n / total)
        else:
            az = az + (nu * n - total) / (n - total) * (whole - az)
        return -float(az @ az) / (2 * nu * n)

    # (w, rho) against (z, -1); the whole objective times nu n, from the mean direction with rho at its mean margin
    w, gap = linear_margin(data, lambda y: [(-1.0, 0.0)], nu * n * np.append(np.ones(n_components), 1e-6), 1.0,
                           nu * n * np.append(np.zeros(n_components), -1.0), np.append(mean, mean @ mean), tol=tol, dual=dual)
    data.unpersist()
    release(data)
    out = LinearScore(proj, -w[:-1], w[-1], out="anomaly_score")
    out.gap = gap
    return out
