"""Vector analytics: centroids, similarity, exact nearest references, density, covariance.

Comparing every row with every reference is brute force by nature. It runs as matrix products
on Arrow batches and never emits pairs: a batch gives its k best (or its sums) per row. The
reference side is broadcast only when its measured size fits ``BROADCAST_BYTES``; beyond it,
references and rows meet block by block and the partial answers are merged. References are made
ready once per block, and rows are dealt over all cores: files would put them into a few tasks.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from timbrel.functions import fixed
from timbrel.functions.rules import cohort_match
from timbrel.functions.scalars import (
    cosine,
    dot,
    half_even,
    norm,
    quadratic_form,
    two_way_share,
)
from timbrel.operators.ordered import quantiles
from timbrel.operators.spectral import constant_rows, project, total

BROADCAST_BYTES = 64 * 1024 * 1024
ROWS_PER_BLOCK = 8192
ROWS_PER_MEETING = 65536  # that share one copy of a block of references
# Cells of one row-by-reference matrix held at a time in a Python worker.
CELLS = 2_000_000
TILE, WIDE = 64, 2048  # rows and references of a piece that stays in a processor's cache
FEW = 16  # new best values of a row, on average, up to which they are sorted singly
GROUP = 64  # cells of a row whose greatest stands for them


def mean_vector(df: DataFrame, keys: Sequence[str], vec: str = "embedding") -> DataFrame:
    """Element-wise mean per key, combined map-side: (keys, vector, n)."""
    v = array_to_vector(F.col(vec))
    return df.groupBy(*keys).agg(
        vector_to_array(Summarizer.mean(v)).alias("vector"), F.count(F.lit(1)).alias("n")
    )


# --- rows against references ---------------------------------------------------------------


def _stack(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64)


def _tiles(n: int, refs: int):
    """(rows, references) slices of a matrix of ``n`` rows, all references of some rows in a row."""
    for lo in range(0, n, TILE):
        yield slice(lo, lo + TILE), [slice(a, a + WIDE) for a in range(0, refs, WIDE)]


def against_references(
    rows: DataFrame,
    refs: DataFrame,
    row_id: str,
    ref_id: str,
    vec: str,
    prepare: Callable[[pd.DataFrame, np.ndarray], tuple],
    partial: Callable[[np.ndarray, np.ndarray, tuple], pd.DataFrame],
    schema: str,
    extras: Sequence[str] = (),
    limit: int = BROADCAST_BYTES,
) -> DataFrame:
    """Partial answers of ``partial(row ids, row matrix, prepare(ref table, ref matrix))``.

    One partial answer per row and reference block; the caller merges them (with a single
    block that merge finds one part per row).
    """
    rows = rows.select(row_id, vec)
    refs = refs.select(ref_id, *extras, vec)
    size = refs.agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.max(F.size(vec)), F.lit(0)).alias("d")
    ).first()
    need = size["n"] * size["d"] * 8
    n_rows = rows.count()
    cores = 2 * rows.sparkSession.sparkContext.defaultParallelism
    if need <= limit:
        local = refs.toPandas()
        matrix = _stack(local[vec]) if len(local) else np.zeros((0, 0))
        shared = rows.sparkSession.sparkContext.broadcast((local.drop(columns=vec), matrix))

        def batch(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            table, matrix = shared.value
            ready = prepare(table, matrix) if len(table) else None
            for part in parts:
                if len(part) and len(table):
                    yield partial(part[row_id].to_numpy(), _stack(part[vec]), ready)

        return rows.repartition(max(cores, n_rows // ROWS_PER_BLOCK)).mapInPandas(batch, schema)

    ref_blocks = math.ceil(need / limit)
    row_blocks = max(math.ceil(cores / ref_blocks), math.ceil(n_rows / ROWS_PER_MEETING))

    def spread(df: DataFrame, own: str, own_n: int, key: Sequence[str], other: str, other_n: int):
        every = F.sequence(F.lit(0).cast("long"), F.lit(other_n - 1).cast("long"))
        return df.withColumn(own, F.pmod(F.xxhash64(*key), F.lit(own_n))).withColumn(
            other, F.explode(every)
        )

    # both sides may come from one table, and a cogroup loses what its sides share: rows get columns of their own
    rows = rows.select(F.col(row_id).alias("_row_id"), F.col(vec).alias("_row_vec"))
    left = spread(rows, "_rb", row_blocks, ["_row_id", "_row_vec"], "_fb", ref_blocks)
    right = spread(refs, "_fb", ref_blocks, [ref_id, vec], "_rb", row_blocks)

    def block(part: pd.DataFrame, table: pd.DataFrame) -> pd.DataFrame:
        if not len(part) or not len(table):
            return pd.DataFrame({c.strip().split()[0]: [] for c in schema.split(",")})
        matrix = _stack(table.pop(vec))
        return partial(part["_row_id"].to_numpy(), _stack(part.pop("_row_vec")), prepare(table, matrix))

    return (
        left.groupBy("_rb", "_fb").cogroup(right.groupBy("_rb", "_fb")).applyInPandas(block, schema)
    )


def _unit(m: np.ndarray) -> np.ndarray:
    return m / (np.linalg.norm(m, axis=1, keepdims=True) + 1e-10)


def _best(sims: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k largest per row, by (value descending, id ascending)."""
    by_id = np.argsort(ids, kind="stable")
    return by_id[_greatest(sims[:, by_id], k)]


def _greatest(sims: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k largest per row, by (value descending, column ascending).

    The k groups of columns with the greatest maxima hold them; only these are looked into.
    """
    if sims.shape[1] <= (k + 1) * GROUP:
        return np.argsort(-sims, axis=1, kind="stable")[:, :k]
    if sims.shape[1] % GROUP:
        sims = np.pad(sims, [(0, 0), (0, -sims.shape[1] % GROUP)], constant_values=-np.inf)
    n, width = sims.shape
    groups = width // GROUP  # a group takes every ``groups``-th column
    top = sims.reshape(n, GROUP, groups).max(axis=1)
    chosen = np.argpartition(-top, k - 1, axis=1)[:, :k]
    least = np.take_along_axis(top, chosen, axis=1).min(axis=1)
    at = np.sort((chosen[:, :, None] + groups * np.arange(GROUP)).reshape(n, -1), axis=1)
    values = np.take_along_axis(sims, at, axis=1)
    order = np.argsort(-values, axis=1, kind="stable")[:, :k]
    best = np.take_along_axis(at, order, axis=1)
    # a group left out may hold an equal value of a lower column
    for i in np.flatnonzero((top >= least[:, None]).sum(axis=1) > k):
        cand = np.flatnonzero(sims[i] >= least[i])
        best[i] = cand[np.argsort(-sims[i, cand], kind="stable")[:k]]
    return best


def _merge(value: np.ndarray, place: np.ndarray, new: np.ndarray, row: np.ndarray, col: np.ndarray, found: np.ndarray):
    """Take what was found in columns ``col`` for the rows ``new[row]`` into their best values and places, in place.

    Every one of these rows has a find, and all finds lie right of the places kept so far, so equal values stay behind.
    """
    k = value.shape[1]
    who = np.concatenate([np.repeat(np.arange(len(new)), k), row])
    values, places = np.concatenate([value[new].ravel(), found]), np.concatenate([place[new].ravel(), col])
    order = np.lexsort([-values, who])  # stable: kept ones first, then finds by column
    at = np.searchsorted(who[order], np.arange(len(new)))[:, None] + np.arange(k)
    value[new], place[new] = values[order][at], places[order][at]


def nearest_references(
    rows: DataFrame,
    refs: DataFrame,
    k: int = 5,
    row_id: str = "row_id",
    ref_id: str = "vec_id",
    vec: str = "embedding",
    skip_self: bool = False,
    limit: int = BROADCAST_BYTES,
) -> DataFrame:
    """Exact k most similar references by cosine: (row_id, rank, ref_id, cohort, similarity).

    Ties go to the lower reference id. ``skip_self`` leaves out the equal id.
    """

    def prepare(table, ref_m):
        order = np.argsort(table[ref_id].to_numpy(), kind="stable")
        return table[ref_id].to_numpy()[order], table["cohort"].to_numpy()[order], _unit(ref_m[order])

    def partial(ids, m, ready):
        ref_ids, cohorts, unit = ready
        clean = np.isfinite(unit).all() and np.isfinite(m).all()
        found = []
        for at, tiles in _tiles(len(m), len(unit)):
            own, rows_ = ids[at], _unit(m[at])
            value, place = np.full((len(own), k), -np.inf), np.zeros((len(own), k), np.int64)
            for tile in tiles:
                sims = rows_ @ unit[tile].T
                if skip_self:
                    low, high = (np.searchsorted(ref_ids[tile], own, side) for side in ("left", "right"))
                    for i in np.flatnonzero(low < high):
                        sims[i, low[i] : high[i]] = -np.inf
                if not clean:
                    sims[np.isnan(sims)] = -np.inf
                # an equal value of a later tile has a higher id
                new = np.flatnonzero(sims.max(axis=1) > value[:, -1])
                if not len(new):
                    continue
                sims = sims[new]
                row, col = np.nonzero(sims > value[new, -1:])
                if len(row) <= FEW * len(new):
                    _merge(value, place, new, row, col + tile.start, sims[row, col])
                    continue
                top = _greatest(sims, k)
                both = np.hstack([value[new], np.take_along_axis(sims, top, axis=1)])
                ids_ = np.hstack([place[new], top + tile.start])
                order = np.argsort(-both, axis=1, kind="stable")[:, :k]
                value[new], place[new] = (np.take_along_axis(x, order, axis=1) for x in (both, ids_))
            keep = np.isfinite(value).ravel()
            found.append(pd.DataFrame(
                {
                    "row_id": np.repeat(own, value.shape[1])[keep],
                    "ref_id": ref_ids[place].ravel()[keep],
                    "cohort": cohorts[place].ravel()[keep],
                    "similarity": value.ravel()[keep],
                }
            ))
        return pd.concat(found)

    parts = against_references(
        rows, refs, row_id, ref_id, vec, prepare, partial,
        "row_id long, ref_id long, cohort long, similarity double", ["cohort"], limit,
    )
    w = Window.partitionBy("row_id").orderBy(F.desc("similarity"), "ref_id")
    return (
        parts.withColumn("rank", F.row_number().over(w).cast("long"))
        .filter(F.col("rank") <= k)
        .select("row_id", "rank", "ref_id", "cohort", "similarity")
    )


def mean_top_similarity(rows: DataFrame, neighbours: DataFrame, row_id: str, k: int = 5):
    """Mean of the k best similarities, 1.0 where there is no reference."""
    means = neighbours.filter(F.col("rank") <= k).groupBy(F.col("row_id").alias(row_id)).agg(
        F.avg("similarity").alias("similarity")
    )
    return rows.join(means, row_id, "left").withColumn(
        "similarity", F.coalesce("similarity", F.lit(1.0))
    )


def nearest_within(
    rows: DataFrame, points: DataFrame, radius: float, row_id: str = "row_id",
    ref_id: str = "point_id", vec: str = "xy", limit: int = BROADCAST_BYTES,
) -> DataFrame:
    """Nearest point strictly nearer than ``radius``: (row_id, ref_id, distance)."""

    def prepare(table, ref_m):
        """Strips as wide as the radius along the first coordinate, ordered by the last one."""
        ref_ids = table[ref_id].to_numpy()
        if np.isnan(ref_m).any():  # no distance is the least then: the block has no answers
            return {}
        finite = np.isfinite(ref_m).all(axis=1)
        ref_ids, ref_m = ref_ids[finite], ref_m[finite]
        strip = np.floor(ref_m[:, 0] / radius)
        order = np.lexsort([ref_m[:, -1], strip])
        ref_ids, ref_m, strip = ref_ids[order], ref_m[order], strip[order]
        names, starts = np.unique(strip, return_index=True)
        ends = [*starts[1:], len(strip)]
        return {s: (ref_ids[a:b], ref_m[a:b]) for s, a, b in zip(names, starts, ends, strict=True)}

    def partial(ids, m, strips):
        finite = np.isfinite(m).all(axis=1)
        ids, m = ids[finite], m[finite]
        own = np.floor(m[:, 0] / radius)
        best, ref = np.full(len(m), np.inf), np.zeros(len(m), np.int64)
        order = np.lexsort([m[:, -1], own])
        cuts = np.flatnonzero(np.diff(own[order])) + 1
        # a strip's edge is rounded, so rows on it may lie a strip farther off
        wide = radius * (1 + 1e-9)
        for of_strip in np.split(order, cuts):
            for lo in range(0, len(of_strip), TILE):
                some = of_strip[lo : lo + TILE]
                for aside in (-2, -1, 0, 1, 2):
                    ref_ids, ref_m = strips.get(own[some[0]] + aside, (None, None))
                    if ref_ids is None or not len(some):
                        continue
                    a, b = np.searchsorted(ref_m[:, -1], [m[some[0], -1] - wide, m[some[-1], -1] + wide])
                    for at in range(a, b + 1, WIDE):
                        near = slice(at, min(at + WIDE, b + 1))
                        if near.start >= len(ref_ids):
                            continue
                        d = np.sqrt(((m[some][:, None, :] - ref_m[near][None, :, :]) ** 2).sum(axis=2))
                        least = d.min(axis=1)
                        first = np.where(d == least[:, None], ref_ids[near][None, :], np.iinfo(np.int64).max).min(axis=1)
                        won = (least < best[some]) | ((least == best[some]) & (first < ref[some]))
                        best[some[won]], ref[some[won]] = least[won], first[won]
        keep = best < radius
        return pd.DataFrame({"row_id": ids[keep], "ref_id": ref[keep], "distance": best[keep]})

    # copies of a point are one point: keep the first id of each
    unique = points.groupBy(vec).agg(F.min(ref_id).alias(ref_id))
    parts = against_references(
        rows, unique, row_id, ref_id, vec, prepare, partial,
        "row_id long, ref_id long, distance double", limit=limit,
    )
    return parts.groupBy("row_id").agg(
        F.min(F.struct("distance", "ref_id")).alias("_b")
    ).select("row_id", "_b.ref_id", "_b.distance")


def density_score(
    rows: DataFrame, refs: DataFrame, gamma: float, weight: float = 0.05,
    row_id: str = "row_id", ref_id: str = "vec_id", vec: str = "embedding",
    limit: int = BROADCAST_BYTES,
) -> DataFrame:
    """(row_id, raw): weighted sum of Gaussian kernels over all references."""

    def prepare(table, ref_m):
        # two more columns, so that one product gives the exponents
        return (np.column_stack([ref_m, np.ones(len(ref_m)), -gamma * (ref_m * ref_m).sum(axis=1)]),)

    def partial(ids, m, ready):
        (wide,) = ready
        m = np.column_stack([2 * gamma * m, -gamma * (m * m).sum(axis=1), np.ones(len(m))])
        raw = np.zeros(len(m))
        for at, tiles in _tiles(len(m), len(wide)):
            for tile in tiles:
                e = m[at] @ wide[tile].T
                np.exp(np.minimum(e, 0.0, out=e), out=e)
                raw[at] += e.sum(axis=1)
        return pd.DataFrame({"row_id": ids, "raw": weight * raw})

    parts = against_references(
        rows, refs, row_id, ref_id, vec, prepare, partial, "row_id long, raw double", limit=limit
    )
    return parts.groupBy("row_id").agg(F.sum("raw").alias("raw"))


def kernel_width(refs: DataFrame, vec: str = "embedding") -> float:
    """1 / (dimensions * variance over all elements), from one pass of sums per row."""
    v = F.col(vec)
    row = refs.agg(
        F.sum(total(v)).alias("s"), F.sum(dot(v, v)).alias("q"), F.sum(F.size(v)).alias("n"),
        F.max(F.size(v)).alias("d"),
    ).first()
    mean = row["s"] / row["n"]
    return 1.0 / (row["d"] * (row["q"] / row["n"] - mean * mean))


def density_threshold(scores: DataFrame, p: float = 0.05) -> float:
    return quantiles(scores, [], "raw", {"p": p}).first()["p"]


# --- cohorts ---------------------------------------------------------------------------------


def centroid_pair(refs: DataFrame, vec: str = "embedding") -> tuple[list[float], list[float]]:
    """Mean vectors of cohort 0 and cohort 1 (two rows of fixed length)."""
    rows = {r["cohort"]: list(r["vector"]) for r in mean_vector(refs, ["cohort"], vec).collect()}
    d = len(next(iter(rows.values()))) if rows else 0
    return rows.get(0, [0.0] * d), rows.get(1, [0.0] * d)


def constant_vector(values: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def cohort_similarity(
    df: DataFrame, healthy: Sequence[float], pathology: Sequence[float], vec: str = "embedding"
) -> DataFrame:
    """Attach sim_h, sim_p (cosines), similarity_healthy / _parkinsons (%), nearest, confidence."""

    def length(v: Sequence[float]) -> Column:
        return F.lit(float(np.linalg.norm(np.asarray(v))))

    own = norm(F.col(vec))
    withs = df.withColumns(
        {
            "sim_h": cosine(F.col(vec), constant_vector(healthy), own, length(healthy)),
            "sim_p": cosine(F.col(vec), constant_vector(pathology), own, length(pathology)),
        }
    )
    share = two_way_share(F.col("sim_p"), F.col("sim_h"))
    return (
        withs.withColumn("_m", cohort_match(F.col("sim_p"), F.col("sim_h")))
        .withColumns(
            {
                "similarity_parkinsons": half_even(share, 1),
                "similarity_healthy": half_even(100.0 - share, 1),
                "nearest": F.col("_m.nearest"),
                "confidence": F.col("_m.confidence"),
            }
        )
        .drop("_m")
    )


def cohort_name(label: Column) -> Column:
    return F.when(label == 1, fixed.COHORTS[1]).otherwise(fixed.COHORTS[0])


def mahalanobis(diff: Column, inverse: Sequence[Sequence[float]]) -> Column:
    return F.sqrt(quadratic_form(diff, constant_rows(inverse)))


def minus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


# --- covariance and projections ----------------------------------------------------------------


@dataclass
class Moments:
    n: int
    mean: np.ndarray
    cov: np.ndarray
    quartic: float


def covariances(df: DataFrame, key: str, vec: str) -> DataFrame:
    """(key, i, j, n, cov, quartic): population covariance per key.

    Means first, then one pass of centred partial products per partition; what is shuffled is
    d*d sums per partition and key, whatever the number of rows.
    """
    means = {
        r[key]: np.asarray(r["vector"]) for r in mean_vector(df, [key], vec).collect()
    }

    def batch(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict = {}
        for part in parts:
            for k, group in part.groupby(key):
                m = _stack(group[vec]) - means[k]
                got = sums.setdefault(k, [np.zeros((m.shape[1],) * 2), 0, 0.0])
                got[0] += m.T @ m
                got[1] += len(m)
                got[2] += float(((m * m).sum(axis=1) ** 2).sum())
        for k, (products, n, quartic) in sums.items():
            d = len(products)
            i, j = np.divmod(np.arange(d * d), d)
            yield pd.DataFrame(
                {key: k, "i": i, "j": j, "n": n, "s": products.ravel(), "q": quartic}
            )

    schema = f"{key} long, i long, j long, n long, s double, q double"
    return (
        df.select(key, vec)
        .mapInPandas(batch, schema)
        .groupBy(key, "i", "j")
        .agg(
            F.sum("n").alias("n"),
            (F.sum("s") / F.sum("n")).alias("cov"),
            F.sum("q").alias("quartic"),
        )
    )


def ledoit_wolf(moments: Moments) -> np.ndarray:
    """Covariance shrunk towards a scaled identity (Ledoit and Wolf 2004)."""
    cov, n, p = moments.cov, moments.n, len(moments.cov)
    mu = np.trace(cov) / p
    delta = ((cov**2).sum() - 2 * mu * np.trace(cov) + p * mu**2) / p
    beta = min((moments.quartic / n - (cov**2).sum()) / (p * n), delta)
    s = 0.0 if beta <= 0 or delta == 0 else beta / delta
    return (1 - s) * cov + s * mu * np.eye(p)


def shrunk_inverses(df: DataFrame, key: str, vec: str, ridge: float = 1e-4):
    """{key: (mean, inverse of the shrunk covariance + ridge)}: d*d numbers per key."""
    means = {r[key]: np.asarray(r["vector"]) for r in mean_vector(df, [key], vec).collect()}
    cells = covariances(df, key, vec).toPandas()
    out = {}
    for k, part in cells.groupby(key):
        d = int(part["i"].max()) + 1
        cov = np.zeros((d, d))
        cov[part["i"], part["j"]] = part["cov"]
        m = Moments(int(part["n"].iloc[0]), means[k], cov, float(part["quartic"].iloc[0]))
        out[int(k)] = (means[k], np.linalg.inv(ledoit_wolf(m) + ridge * np.eye(d)))
    return out


@dataclass
class Projection:
    mean: list[float]
    rows: list[list[float]]

    def apply(self, vec: str = "embedding") -> Column:
        return project(minus(F.col(vec), constant_vector(self.mean)), self.rows)


def fit_projection(df: DataFrame, k: int, vec: str = "embedding") -> Projection:
    """Principal components of the centred vectors; the largest loading of each is positive."""
    mean = df.select(
        vector_to_array(Summarizer.mean(array_to_vector(F.col(vec)))).alias("m")
    ).first()["m"]
    centred = df.select(array_to_vector(minus(F.col(vec), constant_vector(mean))).alias("f"))
    pc = PCA(k=k, inputCol="f", outputCol="p").fit(centred).pc.toArray().T
    pc = pc * np.sign(pc[np.arange(k), np.abs(pc).argmax(axis=1)])[:, None]
    return Projection(list(mean), pc.tolist())


def half_sum_projection(vec: str = "embedding") -> Column:
    """struct(x, y): sums of both halves over the length, times ten."""
    v = F.col(vec)
    half = F.floor(F.size(v) / 2).cast("int")
    length = norm(v)
    return F.struct(
        (total(F.slice(v, F.lit(1), half)) / length * 10).alias("x"),
        (total(F.slice(v, half + 1, F.size(v) - half)) / length * 10).alias("y"),
    )


@dataclass
class Scaler:
    mean: list[float]
    std: list[float]

    def apply(self, vec: str = "features") -> Column:
        safe = [s if s > 0 else 1.0 for s in self.std]
        return F.zip_with(
            minus(F.col(vec), constant_vector(self.mean)), constant_vector(safe),
            lambda a, s: a / s,
        )


def fit_scaler(df: DataFrame, vec: str = "features") -> Scaler:
    """Mean and population deviation per element."""
    v = array_to_vector(F.col(vec))
    row = df.select(
        Summarizer.metrics("mean", "variance", "count").summary(v).alias("s")
    ).select("s.mean", "s.variance", "s.count").first()
    shrink = (row["count"] - 1) / row["count"] if row["count"] else 0.0
    return Scaler(
        list(map(float, row["mean"])), [math.sqrt(float(x) * shrink) for x in row["variance"]]
    )
