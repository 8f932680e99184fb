"""Attributions by weighted coalitions (Shapley kernel), for any scorer of feature matrices.

Coalitions of features and their weights are the same for every row, so the weighted normal equations are inverted once:
a row's attributions are one matrix product with its coalitions' scores. The background is a few weighted
centres; a coalition's score is the weighted mean over all of them. A scorer may bring ``over_coalitions``, which gives
the same means without the mixed rows, if its form allows to share the work between them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PROBES = 1 << 16  # rows that a scorer is given at once
ROWS_PER_TASK = 4096
Scorer = Callable[[np.ndarray], np.ndarray]


def coalitions(d: int, most: int = 2048, seed: int = 42) -> tuple[np.ndarray, np.ndarray]:
    """(members as a 0/1 matrix, weights): all coalitions if they are no more than ``most``.

    Otherwise sizes are taken whole from the smallest and largest inwards while they fit, and the rest of the weight
    is shared by drawn coalitions and their complements of the sizes between.
    """
    if d < 2:
        return np.zeros((0, d)), np.zeros(0)
    weight = {s: (d - 1) / (s * (d - s)) for s in range(1, d)}  # of all coalitions of a size together
    rows, weights, left = [], [], most
    whole = 0
    for s in range(1, d // 2 + 1):
        sizes = sorted({s, d - s})
        if sum(comb(d, x) for x in sizes) > left:
            break
        for x in sizes:
            for members in combinations(range(d), x):
                rows.append(members)
                weights.append(weight[x] / comb(d, x))
        left -= sum(comb(d, x) for x in sizes)
        whole = s
    z = np.zeros((len(rows), d))
    for i, members in enumerate(rows):
        z[i, list(members)] = 1
    between = [s for s in range(whole + 1, d - whole) if s >= 1]
    if not between:
        return z, np.array(weights)
    rng = np.random.default_rng(seed)
    share = np.array([weight[s] for s in between])
    sizes = rng.choice(between, max(1, left // 2), p=share / share.sum())
    drawn = np.zeros((len(sizes), d))
    for i, s in enumerate(sizes):
        drawn[i, rng.choice(d, s, replace=False)] = 1
    drawn = np.concatenate([drawn, 1 - drawn])
    return np.concatenate([z, drawn]), np.concatenate([weights, np.full(len(drawn), share.sum() / len(drawn))])


def solver(z: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The matrix that turns a row's (coalition scores - base, whole score - base) into its attributions.

    Weighted least squares under the condition that the attributions add up to the whole.
    """
    d = z.shape[1]
    inverse = np.linalg.pinv((z.T * weights) @ z)
    spread = inverse @ (z.T * weights)
    ones = np.ones(d)
    lean = inverse @ ones / (ones @ inverse @ ones)
    return np.column_stack([spread - np.outer(lean, ones @ spread), lean])


def attributions_of(x: np.ndarray, score: Scorer, centres: np.ndarray, shares: np.ndarray, z: np.ndarray, solve: np.ndarray) -> np.ndarray:
    """(rows, features): attributions that add up to score(x) minus the background's mean score."""
    n, d = x.shape
    base = float(shares @ score(centres))
    whole = score(x) - base
    if d == 1:
        return whole[:, None]
    if hasattr(score, "over_coalitions"):
        return np.column_stack([score.over_coalitions(x, centres, shares, z) - base, whole]) @ solve.T
    out = np.zeros((n, len(z)))
    step = max(1, PROBES // max(1, len(z)))
    for lo in range(0, n, step):
        rows = x[lo : lo + step]
        for centre, share in zip(centres, shares):
            probes = np.where(z[None] > 0, rows[:, None, :], centre).reshape(-1, d)
            out[lo : lo + step] += share * score(probes).reshape(len(rows), -1)
    return np.column_stack([out - base, whole]) @ solve.T


def kernel_attributions(
    df: DataFrame, ident: str, score: Scorer, base: Sequence[tuple[Sequence[float], float]], vec: str = "features", most: int = 2048, seed: int = 42,
) -> DataFrame:
    """(ident, i, value) for every row with a vector; ``base`` are (centre, share) pairs.

    The scorer runs on numpy matrices inside the tasks. A row's coalitions live and end in its batch.
    """
    centres = np.array([b[0] for b in base], float)
    shares = np.array([b[1] for b in base], float)
    shares = shares / shares.sum()
    d = centres.shape[1]
    z, weights = coalitions(d, most, seed)
    solve = solver(z, weights) if d > 1 else np.zeros((1, 1))
    kind = df.schema[ident].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b[1].flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, d)
            value = attributions_of(x, score, centres, shares, z, solve)
            at = np.repeat(np.arange(len(x)), d)
            yield pa.RecordBatch.from_arrays(
                [b[0].take(pa.array(at)), pa.array(np.tile(np.arange(d, dtype=np.int32), len(x))), pa.array(value.ravel())],
                names=[ident, "i", "value"])

    rows = df.where(F.col(vec).isNotNull()).select(ident, F.col(vec).cast("array<double>").alias("features"))
    # a row takes long and few bytes: files would put all rows into a few tasks
    parts = max(df.sparkSession.sparkContext.defaultParallelism, rows.count() // ROWS_PER_TASK)
    rows = rows.repartition(parts)
    return rows.mapInArrow(run, f"`{ident}` {kind}, i int, value double")
