"""Trees grown from histograms: regularised second-order boosting and class-balanced forests.

Rows stay where they are, with their features written once as bin numbers of a byte. For every level each task adds up two sums (gradient and curvature, or weighted
label and weight) per tree, node, feature and bin; one grouped aggregation joins the tasks' sums, and the best
cut of every node is read from a table whose size the parameters bound, whatever the rows. Random draws come
from a stable hash of row id and tree, so a lost task draws the same again. All trees of a forest
grow level by level in the same passes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timbrel.session import materialise

U = np.uint64


def uniform(ids: np.ndarray, draw: int) -> np.ndarray:
    """Numbers in [0, 1) fixed by hashed row ids and the number of the draw."""
    x = ids.astype(np.int64).view(U) + U((draw * 0x9E3779B97F4A7C15) & (2**64 - 1))
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> U(shift))) * U(factor)
    return ((x ^ (x >> U(31))) >> U(11)).astype(np.float64) / float(1 << 53)


def poisson(ids: np.ndarray, draw: int, rate: np.ndarray) -> np.ndarray:
    """Poisson counts of the given rates, fixed as ``uniform`` is."""
    u = uniform(ids, draw)
    out, term = np.zeros(len(ids)), np.exp(-rate)
    reached = term.copy()
    for k in range(1, 40):
        more = u >= reached
        if not more.any():
            break
        out += more
        term = term * rate / k
        reached = reached + term
    return out


@dataclass(frozen=True)
class Trees:
    """Complete binary trees in arrays of (tree, node); node i has the children 2 i + 1 and 2 i + 2.

    ``feature`` is -1 where a node is a leaf; values up to ``cut`` go left.
    """

    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray

    def leaves(self, x: np.ndarray, tree: int) -> np.ndarray:
        at = np.zeros(len(x), np.int64)
        rows = np.arange(len(x))
        while True:
            f = self.feature[tree, at]
            inner = f >= 0
            if not inner.any():
                return at
            right = x[rows, np.maximum(f, 0)] > self.cut[tree, at]
            at = np.where(inner, 2 * at + 1 + right, at)

    def values(self, x: np.ndarray) -> np.ndarray:
        """The sum of the leaf values of all trees, per row."""
        out = np.zeros(len(x))
        for t in range(len(self.feature)):
            out += self.value[t, self.leaves(x, t)]
        return out

    def coded(self, cuts: Sequence[np.ndarray]) -> Trees:
        """The same trees over bin numbers: a value lies above a cut where its bin number is above the cut's place."""
        cut = self.cut.copy()
        for t, n in zip(*np.nonzero(self.feature >= 0)):
            cut[t, n] = np.searchsorted(cuts[self.feature[t, n]], self.cut[t, n])
        return Trees(self.feature, cut, self.value)

    def join(self, other: Trees) -> Trees:
        return Trees(*(np.concatenate([getattr(self, n), getattr(other, n)]) for n in ("feature", "cut", "value")))


def empty(depth: int, trees: int = 0) -> Trees:
    shape = (trees, 2 ** (depth + 1) - 1)
    return Trees(np.full(shape, -1, np.int64), np.zeros(shape), np.zeros(shape))


@dataclass(frozen=True)
class Growth:
    depth: int = 6
    bins: int = 64
    reg_lambda: float = 0.0  # added to the curvature of a leaf
    reg_alpha: float = 0.0  # taken from the gradient of a leaf
    min_child: float = 1.0  # curvature (or weight) that a child holds at least
    min_gain: float = 1e-12
    features: float | str = 1.0  # share of features, "sqrt" or "log2"
    per_node: bool = False  # features are drawn for every node, else for every tree
    seed: int = 42

    def width(self, d: int) -> int:
        n = {"sqrt": d**0.5, "log2": np.log2(max(d, 2))}.get(self.features)
        return max(1, int(n if n is not None else self.features * d + 1e-9))


def cut_points(df: DataFrame, bins: int, vec: str = "features") -> list[np.ndarray]:
    """Per feature the distinct quantiles that separate its bins."""
    first = df.select(F.size(vec).alias("d")).first()
    d = first["d"] if first else 0
    shares = [k / bins for k in range(1, bins)]
    wide = df.select(*(F.col(vec)[i].alias(f"x{i}") for i in range(d)))
    found = wide.approxQuantile(wide.columns, shares, 0.1 / bins) if d else []
    return [np.unique(x) for x in found]


def _code_type(bins: int) -> np.dtype:
    return np.min_scalar_type(-max(1, bins))


def binned(rows: DataFrame, cuts: Sequence[np.ndarray], bins: int, name: str) -> DataFrame:
    """``rows`` written with ``codes``, the bin number of each feature in binary, in place of ``features``.

    A missing value or NaN has the number -1: cuts send it left, while it counts in the last bin.
    """
    d, kind = len(cuts), _code_type(bins)
    others = [n for n in rows.columns if n != "features"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix(b["features"], d)
            codes = np.empty(x.shape, kind)
            for i, edges in enumerate(cuts):
                codes[:, i] = np.searchsorted(edges, x[:, i])
            codes[np.isnan(x)] = -1
            width = codes.itemsize * d
            raw = pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(np.arange(len(x) + 1, dtype=np.int32) * np.int32(width)), pa.py_buffer(codes.tobytes())])
            yield pa.RecordBatch.from_arrays([*(b[n] for n in others), raw], names=[*others, "codes"])

    schema = ", ".join(f"{n} {rows.schema[n].dataType.simpleString()}" for n in others) + ", codes binary"
    return materialise(rows.select(*others, "features").mapInArrow(run, schema), name)


def _codes(column: pa.Array, d: int, bins: int) -> np.ndarray:
    """The matrix of bin numbers of a batch."""
    lo, hi = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, column.offset * 4)[[0, -1]] if len(column) else (0, 0)
    kind = _code_type(bins)
    flat = np.frombuffer(column.buffers()[2], kind, (hi - lo) // kind.itemsize, lo) if hi > lo else np.zeros(0, kind)
    return flat.reshape(len(column), d)


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, d)


def drawn_features(growth: Growth, d: int, tree: int, node: int) -> np.ndarray:
    """The features that a node may be cut by."""
    rng = np.random.default_rng([growth.seed, tree, node if growth.per_node else 0])
    return np.sort(rng.choice(d, growth.width(d), replace=False))


Stats = Callable[[pa.RecordBatch, np.ndarray, int], tuple[np.ndarray, np.ndarray]]


def _level_sums(rows: DataFrame, trees: Trees, first: int, level: int, cuts, growth: Growth, stats: Stats) -> dict[str, np.ndarray]:
    """The two sums by cell, the cell being (tree, node of the level, drawn feature, bin); ``rows`` as ``binned`` gives them."""
    d, bins = len(cuts), growth.bins
    nodes, width = 2**level, growth.width(len(cuts))
    count = len(trees.feature)
    drawn = np.array([[drawn_features(growth, d, first + t, nodes - 1 + n) for n in range(nodes)] for t in range(count)])
    size = nodes * width * bins
    last = np.array([len(x) for x in cuts], _code_type(bins))
    coded = trees.coded(cuts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, count, size))
        for b in batches:
            x = _codes(b["codes"], d, bins)
            place = np.where(x < 0, last, x) if len(x) and x.min(initial=0) < 0 else x
            for t in range(count):
                at = coded.leaves(x, t) - (nodes - 1)
                g, h = stats(b, x, first + t)
                live = (at >= 0) & ((g != 0) | (h != 0))
                n = at[live]
                cell = (n[:, None] * width + np.arange(width)) * bins + np.take_along_axis(place[live], drawn[t, n], 1)
                for k, v in enumerate((g[live], h[live])):
                    sums[k, t] += np.bincount(cell.ravel(), np.repeat(v, width), minlength=size)
        flat = sums.reshape(2, -1)
        used = np.flatnonzero((flat != 0).any(axis=0))
        for lo in range(0, len(used), 1 << 16):
            some = used[lo : lo + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(some), *(pa.array(flat[k, some]) for k in (0, 1))], names=["cell", "g", "h"])

    table = rows.mapInArrow(run, "cell long, g double, h double").groupBy("cell").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).toArrow()
    out = np.zeros((2, count * size))
    cell = table["cell"].to_numpy()
    out[0, cell], out[1, cell] = table["g"].to_numpy(), table["h"].to_numpy()
    return {"g": out[0].reshape(count, nodes, width, bins), "h": out[1].reshape(count, nodes, width, bins), "drawn": drawn}


def _shrunk(g: np.ndarray, growth: Growth) -> np.ndarray:
    return np.sign(g) * np.maximum(np.abs(g) - growth.reg_alpha, 0.0)


def _score(g: np.ndarray, h: np.ndarray, growth: Growth) -> np.ndarray:
    whole = h + growth.reg_lambda
    return np.divide(_shrunk(g, growth) ** 2, whole, out=np.zeros_like(g), where=whole > 0)


def best_cuts(sums: dict[str, np.ndarray], growth: Growth) -> tuple[np.ndarray, ...]:
    """Per (tree, node): gain, drawn slot and bin of the best cut (the first of equal ones), and (g, h) left and whole."""
    g, h = np.cumsum(sums["g"], axis=3), np.cumsum(sums["h"], axis=3)
    all_g, all_h = g[..., -1:], h[..., -1:]
    gain = _score(g, h, growth) + _score(all_g - g, all_h - h, growth) - _score(all_g, all_h, growth)
    allowed = (h >= growth.min_child) & (all_h - h >= growth.min_child)
    gain = np.where(allowed, gain, -np.inf).reshape(*gain.shape[:2], -1)
    best = gain.argmax(axis=2)
    pick = lambda a: np.take_along_axis(a.reshape(*gain.shape), best[..., None], 2)[..., 0]
    return pick(gain), best // g.shape[3], best % g.shape[3], pick(g), pick(h), all_g[:, :, 0, 0], all_h[:, :, 0, 0]


def grow(rows: DataFrame, cuts, growth: Growth, stats: Stats, trees: int, first: int, leaf: Callable) -> Trees:
    """``trees`` trees at once; ``leaf`` gives a leaf's value from its two sums."""
    out = empty(growth.depth, trees)
    for level in range(growth.depth):
        sums = _level_sums(rows, out, first, level, cuts, growth, stats)
        gain, slot, cut_bin, g, h, all_g, all_h = best_cuts(sums, growth)
        at = 2**level - 1 + np.arange(2**level)
        if level == 0:
            out.value[:, 0] = leaf(all_g[:, 0], all_h[:, 0])
        split = gain > growth.min_gain
        for t, n in zip(*np.nonzero(split)):
            f = sums["drawn"][t, n, slot[t, n]]
            if cut_bin[t, n] >= len(cuts[f]):
                continue
            node = at[n]
            out.feature[t, node], out.cut[t, node] = f, cuts[f][cut_bin[t, n]]
            out.value[t, 2 * node + 1] = leaf(g[t, n], h[t, n])
            out.value[t, 2 * node + 2] = leaf(all_g[t, n] - g[t, n], all_h[t, n] - h[t, n])
        if not split.any():
            break
    return out


# --- boosting ----------------------------------------------------------------------------------


@dataclass(frozen=True)
class Boosting:
    """Rounds, shrinkage, sampling and the growth of each tree; defaults are those of the reference's search space."""

    rounds: int = 100
    rate: float = 0.1
    subsample: float = 0.8
    positive_weight: float = 1.0
    refresh: int = 10  # rounds after which margins are written
    growth: Growth = field(default_factory=lambda: Growth(depth=3, reg_lambda=1.0, min_child=1.0, features=0.8))


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -500, 500)))


def boost(df: DataFrame, spec: Boosting = Boosting(), ident: str = "vec_id", vec: str = "features", label: str = "y") -> tuple[Trees, float]:
    """(trees, first margin): logistic loss, second-order leaves, every round on its own draw of rows and features.

    Rows with a null label or vector are left out.
    """
    rows = df.where(F.col(label).isNotNull() & F.col(vec).isNotNull()).select(
        F.xxhash64(ident).alias("id"), F.col(label).cast("double").alias("y"), F.col(vec).cast("array<double>").alias("features"))
    rows = materialise(rows.withColumn("margin", F.lit(0.0)), "boost")
    w = F.when(F.col("y") == 1, spec.positive_weight).otherwise(1.0)
    share = rows.agg(F.sum(w * F.col("y")) / F.sum(w)).first()[0] or 0.5
    base = float(np.log(share / (1 - share))) if 0 < share < 1 else 0.0
    cuts = cut_points(rows, spec.growth.bins)
    rows = binned(rows, cuts, spec.growth.bins, "binned")
    model, since = empty(spec.growth.depth), empty(spec.growth.depth)
    lam, rate = spec.growth, spec.rate
    leaf = lambda g, h: -rate * _shrunk(g, lam) / (h + lam.reg_lambda + 1e-300)
    for t in range(spec.rounds):
        def stats(b: pa.RecordBatch, x: np.ndarray, tree: int, since=since) -> tuple[np.ndarray, np.ndarray]:
            y = b["y"].to_numpy()
            p = sigmoid(base + b["margin"].to_numpy() + since.values(x))
            used = np.where(y == 1, spec.positive_weight, 1.0) * (uniform(b["id"].to_numpy(), tree) < spec.subsample)
            return (p - y) * used, np.maximum(p * (1 - p), 1e-16) * used

        new = grow(rows, cuts, spec.growth, stats, 1, t, leaf)
        model, since = model.join(new), since.join(new.coded(cuts))
        if (t + 1) % spec.refresh == 0 and t + 1 < spec.rounds:
            rows = _with_margin(rows, since, len(cuts), spec.growth.bins)
            since = empty(spec.growth.depth)
    return model, base


def _with_margin(rows: DataFrame, since: Trees, d: int, bins: int) -> DataFrame:
    """``rows`` written with the leaf values of coded trees added to ``margin``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            margin = b["margin"].to_numpy() + since.values(_codes(b["codes"], d, bins))
            yield b.set_column(b.schema.get_field_index("margin"), "margin", pa.array(margin))

    return materialise(rows.mapInArrow(run, rows.schema), "margin")


def tree_sum(trees: Trees, vec: str = "features") -> Column:
    """The sum of the leaf values, as a column."""
    @F.pandas_udf("double")
    def run(x: pd.Series) -> pd.Series:
        return pd.Series(trees.values(np.stack(x.to_numpy()).astype(float)) if len(x) else [], dtype=float)

    return run(F.col(vec).cast("array<double>"))


def boosted_probability(df: DataFrame, model: tuple[Trees, float], vec: str = "features") -> DataFrame:
    """``df`` with ``p``."""
    trees, base = model
    return df.withColumn("p", 1.0 / (1.0 + F.exp(-(tree_sum(trees, vec) + base))))


# --- forest ------------------------------------------------------------------------------------


FOREST = Growth(depth=6, bins=32, min_child=1.0, features="sqrt", per_node=True)


def draw_rates(df: DataFrame, label: str = "y") -> dict[int, float]:
    """The expected number of times that a row of each class is drawn: classes come out even."""
    sizes = {int(r[label]): r["count"] for r in df.where(F.col(label).isNotNull()).groupBy(label).count().collect()}
    return {k: min(sizes.values()) / n for k, n in sizes.items()}


def balanced_forest(
    df: DataFrame, trees: int = 200, growth: Growth = FOREST, ident: str = "vec_id", vec: str = "features", label: str = "y",
    together: int = 50,
) -> Trees:
    """A forest in which every tree draws its own rows, as many of each class, all by stable hashes.

    ``together`` trees grow in the same passes, which bounds a task's sums. Leaves hold the share of class 1; rows with
    a null label or vector are left out. Scores are ``tree_sum`` divided by the number of trees.
    """
    known = df.where(F.col(label).isNotNull() & F.col(vec).isNotNull())
    rates = draw_rates(known, label)
    rate = F.lit(0.0)
    for k, v in rates.items():
        rate = F.when(F.col(label) == k, v).otherwise(rate)
    rows = materialise(known.select(
        F.xxhash64(ident).alias("id"), F.col(label).cast("double").alias("y"), rate.alias("rate"), F.col(vec).cast("array<double>").alias("features")), "forest")
    cuts = cut_points(rows, growth.bins)
    rows = binned(rows, cuts, growth.bins, "binned")

    def stats(b: pa.RecordBatch, x: np.ndarray, tree: int) -> tuple[np.ndarray, np.ndarray]:
        w = poisson(b["id"].to_numpy(), growth.seed * 1_000_003 + tree, b["rate"].to_numpy())
        return w * b["y"].to_numpy(), w

    leaf = lambda g, h: np.divide(g, h, out=np.zeros_like(np.asarray(g, float)), where=np.asarray(h) > 0)
    out = empty(growth.depth)
    for first in range(0, trees, together):
        out = out.join(grow(rows, cuts, growth, stats, min(together, trees - first), first, leaf))
    return out


def forest_probability(df: DataFrame, model: Trees, vec: str = "features") -> DataFrame:
    """``df`` with ``p``."""
    return df.withColumn("p", tree_sum(model, vec) / float(max(1, len(model.feature))))
