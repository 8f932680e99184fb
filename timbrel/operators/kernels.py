"""Kernel methods on Spark rows: a Nystroem feature map for margins, and one-class weights for outlier scores.

Both rest on a bounded sample of rows (``LANDMARKS``, ``SUPPORT``), the first by hash of their ids; whatever is
scored or trained on is every row. With no more rows than the bound the kernel is exact.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from multiprocessing.pool import ThreadPool

import numpy as np
import pandas as pd
from pyspark import inheritable_thread_target
from pyspark.ml.classification import LinearSVC
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timbrel.operators.metrics import all_metrics, class_weights
from timbrel.operators.splits import scatter
from timbrel.operators.vectors import kernel_width
from timbrel.session import materialise, steps

LANDMARKS = 512  # rows that span the feature map
SUPPORT = 2048  # rows that the one-class weights are fitted on
CELLS = 1 << 19  # of one row-by-support matrix held at a time in a Python worker


def gaussian(x: np.ndarray, z: np.ndarray, gamma: float) -> np.ndarray:
    d2 = (x * x).sum(axis=1)[:, None] + (z * z).sum(axis=1)[None, :] - 2 * x @ z.T
    return np.exp(-gamma * np.maximum(d2, 0.0))


def _in_slices(score, x: np.ndarray, width: int) -> np.ndarray:
    """``score`` of all rows, of so many at once that a matrix of ``width`` columns stays small."""
    step = max(1, CELLS // max(1, width))
    parts = [score(x[lo : lo + step]) for lo in range(0, len(x), step)]
    return np.concatenate(parts) if parts else score(x)


def sampled_rows(df: DataFrame, most: int, ident: str, vec: str, seed: int = 42) -> np.ndarray:
    """The ``most`` rows of least hash (fewer if there are no more), in that order."""
    rows = df.where(F.col(vec).isNotNull()).select(scatter(ident, seed).alias("h"), F.col(ident).alias("i"), F.col(vec).cast("array<double>").alias("x"))
    found = rows.orderBy("h", "i").limit(most).select("x").toArrow()["x"].to_pylist()
    return np.array(found, float).reshape(len(found), -1)


def _stacked(x: pd.Series, d: int) -> np.ndarray:
    return np.stack(x.to_numpy()).astype(float) if len(x) else np.zeros((0, d))


@dataclass(frozen=True)
class KernelMap:
    """phi(x) = K(x, landmarks) root, so that phi(x) . phi(z) is the kernel's projection on the landmarks."""

    landmarks: np.ndarray
    root: np.ndarray
    gamma: float

    def map(self, x: np.ndarray) -> np.ndarray:
        return gaussian(x, self.landmarks, self.gamma) @ self.root

    def apply(self, vec: str = "features") -> Column:
        """The mapped vector as array<double>, a matrix product per Arrow batch."""
        @F.pandas_udf("array<double>")
        def run(x: pd.Series) -> pd.Series:
            rows = _stacked(x, self.landmarks.shape[1])
            return pd.Series(list(_in_slices(self.map, rows, len(self.landmarks))), dtype=object)

        return run(F.col(vec).cast("array<double>"))


def kernel_map(df: DataFrame, gamma: float | str = "scale", landmarks: int = LANDMARKS, ident: str = "vec_id", vec: str = "features") -> KernelMap:
    """A map whose inner products are the Gaussian kernel; ``gamma`` a number, "scale" (1 / (d var)) or "auto" (1 / d)."""
    return kernel_maps(df, [gamma], landmarks, ident, vec)[gamma]


def kernel_maps(df: DataFrame, gammas: Sequence[float | str], landmarks: int = LANDMARKS, ident: str = "vec_id", vec: str = "features") -> dict[float | str, KernelMap]:
    """The map of every ``gamma``, all over the same landmarks."""
    z = sampled_rows(df, landmarks, ident, vec)
    maps = {}
    for gamma in gammas:
        width = gamma
        if gamma == "scale":
            width = kernel_width(df.where(F.col(vec).isNotNull()), vec)
        elif gamma == "auto":
            width = 1.0 / max(1, z.shape[1])
        values, vectors = np.linalg.eigh(gaussian(z, z, width))
        kept = values > 1e-10 * max(values.max(initial=0.0), 1e-300)
        maps[gamma] = KernelMap(z, vectors[:, kept] / np.sqrt(values[kept]), float(width))
    return maps


@dataclass(frozen=True)
class KernelMargin:
    """A margin in the kernel's space (``space`` None: in the features' own)."""

    space: KernelMap | None
    weights: np.ndarray
    intercept: float

    def score(self, df: DataFrame, vec: str = "features") -> DataFrame:
        """``df`` with ``margin``."""
        @F.pandas_udf("double")
        def run(x: pd.Series) -> pd.Series:
            rows = _stacked(x, 0 if self.space is None else self.space.landmarks.shape[1])
            z = rows if self.space is None else _in_slices(self.space.map, rows, len(self.space.landmarks))
            return pd.Series(z @ self.weights + self.intercept if len(x) else [], dtype=float)

        return df.withColumn("margin", run(F.col(vec).cast("array<double>")))


MIXED = 1 << 22  # kernel values of mixed rows held at once


class KernelProbability:
    """The logistic of a kernel margin, for feature matrices and for rows mixed with centres.

    A mixed row's squared distance to a landmark is the sum of the row's part over a coalition and the centre's part
    over the rest, so its kernel value is the product of two factors. The row's serve all centres, the centres' all rows.
    """

    def __init__(self, model: KernelMargin):
        self.landmarks, self.gamma = model.space.landmarks, model.space.gamma
        self.weights, self.intercept = model.space.root @ model.weights, model.intercept

    def _logistic(self, margin: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-(margin + self.intercept)))

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return self._logistic(gaussian(x, self.landmarks, self.gamma) @ self.weights)

    def _factors(self, z: np.ndarray, x: np.ndarray) -> np.ndarray:
        """(coalitions, rows, landmarks): exp of -gamma times the squared distance over the coalition's features."""
        n, m = len(x), len(self.landmarks)
        apart = -self.gamma * (x[:, None, :] - self.landmarks[None]) ** 2
        out = z @ apart.reshape(n * m, -1).T
        return np.exp(out, out=out).reshape(len(z), n, m)

    def over_coalitions(self, x: np.ndarray, centres: np.ndarray, shares: np.ndarray, z: np.ndarray) -> np.ndarray:
        """(rows, coalitions): the mean score, by the centres' shares, of each row's features in a coalition and a centre's elsewhere."""
        out = np.zeros((len(x), len(z)))
        m = max(1, len(self.landmarks))
        coalitions = max(1, MIXED // (m * max(1, len(centres))))
        for a in range(0, len(z), coalitions):
            part = z[a : a + coalitions]
            rest = (self._factors(1.0 - part, centres) * self.weights).transpose(0, 2, 1)
            rows = max(1, MIXED // (m * len(part)))
            for lo in range(0, len(x), rows):
                margins = self._factors(part, x[lo : lo + rows]) @ rest  # coalitions, rows, centres
                out[lo : lo + rows, a : a + coalitions] = (self._logistic(margins) @ shares).T
        return out


def fit_margin(
    df: DataFrame, cost: float = 1.0, gamma: float | str = "scale", kernel: str = "rbf", ident: str = "vec_id", vec: str = "features",
    label: str = "y", rounds: int = 100, landmarks: int = LANDMARKS,
) -> KernelMargin:
    """A balanced hinge-loss margin: half the squared norm plus ``cost`` times the weighted hinge losses of all rows."""
    space = kernel_map(df, gamma, landmarks, ident, vec) if kernel == "rbf" else None
    rows = _mapped(df, space, class_weights(df.select(F.col(label).alias("y"))), vec, label)
    return _hinge(rows, space, cost, max(1, rows.count()), rounds)


def _mapped(df: DataFrame, space: KernelMap | None, weights: dict[int, float], vec: str, label: str) -> DataFrame:
    """The written (label, weight, vector) of the rows with a label and features, in the kernel's space."""
    w = F.lit(1.0)
    for k, v in weights.items():
        w = F.when(F.col(label) == k, v).otherwise(w)
    x = space.apply(vec) if space else F.col(vec).cast("array<double>")
    rows = df.where(F.col(label).isNotNull() & F.col(vec).isNotNull()).select(F.col(label).cast("double").alias("label"), w.alias("weight"), array_to_vector(x).alias("vector"))
    return materialise(rows, "kernel")


def _hinge(rows: DataFrame, space: KernelMap | None, cost: float, n: int, rounds: int) -> KernelMargin:
    """The margin of ``n`` mapped rows for one cost."""
    svc = LinearSVC(featuresCol="vector", labelCol="label", weightCol="weight", maxIter=rounds, regParam=1.0 / (cost * n), standardization=False)
    model = svc.fit(rows)
    return KernelMargin(space, model.coefficients.toArray(), float(model.intercept))


# The search space of the kernel margin.
GRID = [
    {"cost": c, "gamma": g, "kernel": k}
    for c in (0.1, 0.5, 1.0, 2.0, 5.0, 10.0, 20.0) for g in ("scale", "auto", 0.001, 0.01, 0.1) for k in ("rbf", "linear")
]


TASK_CELLS = 1 << 21  # of the mapped rows that a task of a fit holds at least


def _margins(space: KernelMap | None, models: Sequence[KernelMargin], vec: str) -> Column:
    """The margins of all models of one space: a row is mapped once."""
    @F.pandas_udf("array<double>")
    def run(x: pd.Series) -> pd.Series:
        rows = _stacked(x, 0 if space is None else space.landmarks.shape[1])
        if not len(x):
            return pd.Series([], dtype=object)
        z = rows if space is None else _in_slices(space.map, rows, len(space.landmarks))
        return pd.Series(list(np.column_stack([z @ m.weights + m.intercept for m in models])), dtype=object)

    return run(F.col(vec).cast("array<double>"))


def search_margin(
    df: DataFrame, grid: Sequence[dict], fold: str = "fold", ident: str = "vec_id", vec: str = "features", label: str = "y", rounds: int = 100,
    landmarks: int = LANDMARKS,
) -> DataFrame:
    """(cell, cost, gamma, kernel, roc_auc): the mean area over the folds for every cell of the grid, best first.

    Every cell is fitted on the training side of each fold and scores its held-out side. The rows of a side are mapped
    once for all costs, and cells that give one fit (the linear kernel has no gamma) share it. While the mapped rows fill
    fewer tasks than there are cores, fits of several costs run side by side.
    """
    spark = df.sparkSession
    folds = [r[0] for r in df.select(fold).distinct().orderBy(fold).collect()]
    places = [(g["gamma"] if g["kernel"] == "rbf" else None, g["cost"]) for g in grid]  # gamma None: the features' own space
    fits = list(dict.fromkeys(places))
    gammas = list(dict.fromkeys(g for g, _ in fits))
    parts = []
    for k in folds:
        train, held = df.where(F.col(fold) != k), df.where(F.col(fold) == k)
        weights = class_weights(train.select(F.col(label).alias("y")))
        maps = kernel_maps(train, [g for g in gammas if g is not None], landmarks, ident, vec)
        for gamma in gammas:
            costs = [c for g, c in fits if g == gamma]
            space = maps.get(gamma)
            with steps(spark) as keep:
                rows = _mapped(train, space, weights, vec, label)
                size = rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.max(F.size(vector_to_array("vector"))), F.lit(0)).alias("d")).first()
                n = max(1, size["n"])
                tasks = max(1, math.ceil(n * size["d"] / TASK_CELLS))
                rows = rows.coalesce(tasks)
                with ThreadPool(min(len(costs), max(1, spark.sparkContext.defaultParallelism // tasks))) as pool:
                    models = pool.map(inheritable_thread_target(spark)(lambda cost: _hinge(rows, space, cost, n, rounds)), costs)  # noqa: B023
                named = F.array(*[F.lit(fits.index((gamma, c))) for c in costs])
                margin = F.explode(F.arrays_zip(named.alias("fit"), _margins(space, models, vec).alias("margin"))).alias("m")
                scored = held.select(F.col(fold).cast("long").alias("fold"), F.col(label).cast("long").alias("y"), margin)
                p = 1.0 / (1.0 + F.exp(-F.col("m.margin")))
                parts.append(keep(scored.select("m.fit", "fold", "y", p.alias("p")), "search"))
    scores = parts[0]
    for x in parts[1:]:
        scores = scores.unionByName(x)
    means = all_metrics(scores, ["fit", "fold"]).groupBy("fit").agg(F.avg("roc_auc").alias("roc_auc"))
    cells = spark.createDataFrame(
        [(fits.index(at), i, float(g["cost"]), str(g["gamma"]), g["kernel"]) for i, (g, at) in enumerate(zip(grid, places, strict=True))],
        "fit int, cell int, cost double, gamma string, kernel string")
    return cells.join(means, "fit").drop("fit").orderBy(F.desc("roc_auc"), "cell")


# --- one class ---------------------------------------------------------------------------------


def one_class_weights(k: np.ndarray, nu: float = 0.05, tolerance: float = 1e-6, rounds: int = 200_000) -> tuple[np.ndarray, float]:
    """(weights, offset) of the one-class problem: least w' K w / 2 with 0 <= w <= 1 and sum w = nu n.

    Pairs of weights that break the optimality conditions most are moved against each other, which keeps the
    sum. The offset is where the score of a row that is neither inside nor at its bound lies.
    """
    n = len(k)
    total = nu * n
    w = np.zeros(n)
    w[: int(total)] = 1.0
    if int(total) < n:
        w[int(total)] = total - int(total)
    g = k @ w
    for _ in range(rounds):
        up = np.where(w < 1.0 - 1e-12, g, np.inf)  # the least score that may still grow
        down = np.where(w > 1e-12, g, -np.inf)  # the greatest that may still shrink
        i, j = int(up.argmin()), int(down.argmax())
        if not down[j] - up[i] > tolerance:
            break
        curve = max(k[i, i] + k[j, j] - 2 * k[i, j], 1e-12)
        step = min((g[j] - g[i]) / curve, 1.0 - w[i], w[j])
        w[i], w[j] = w[i] + step, w[j] - step
        g += step * (k[:, i] - k[:, j])
    free = (w > 1e-9) & (w < 1 - 1e-9)
    low, high = g[w >= 1 - 1e-9], g[w <= 1e-9]
    offset = g[free].mean() if free.any() else (low.max(initial=-np.inf) + high.min(initial=np.inf)) / 2 if n else 0.0
    return w, float(offset)


@dataclass(frozen=True)
class OneClass:
    """Support rows with their weights; ``offset`` is the score on the edge of the class."""

    support: np.ndarray
    weights: np.ndarray
    gamma: float
    offset: float

    def score(self, df: DataFrame, vec: str = "embedding") -> DataFrame:
        """``df`` with ``raw``: the weighted sum of kernels with the support rows."""
        @F.pandas_udf("double")
        def run(x: pd.Series) -> pd.Series:
            raw = lambda rows: gaussian(rows, self.support, self.gamma) @ self.weights
            return pd.Series(_in_slices(raw, _stacked(x, self.support.shape[1]), len(self.support)) if len(x) else [], dtype=float)

        return df.withColumn("raw", run(F.col(vec).cast("array<double>")))


def one_class(df: DataFrame, nu: float = 0.05, most: int = SUPPORT, ident: str = "vec_id", vec: str = "embedding") -> OneClass:
    """Fitted weights over the first ``most`` rows by hash; gamma is 1 / (d var) over all rows."""
    x = sampled_rows(df, most, ident, vec)
    gamma = kernel_width(df.where(F.col(vec).isNotNull()), vec)
    w, offset = one_class_weights(gaussian(x, x, gamma), nu)
    return OneClass(x[w > 0], w[w > 0], gamma, offset)
