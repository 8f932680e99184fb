"""Cells around pivots and the grid against comparing everything."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from timbrel.operators import cells as CE

RNG = np.random.default_rng(11)
CENTRES = RNG.normal(size=(8, 6)) * 4
X = np.vstack([CENTRES[i % 8] + 0.05 * RNG.normal(size=6) for i in range(240)])
X[20:60] = X[20]  # many copies of one vector
X[100] = 0.0
X[101] = 0.0
SCHEMA = "vec_id long, cohort long, embedding array<double>"


def vectors(spark, x, skip=()):
    rows = [(i, i % 2, None if i in skip else v.tolist()) for i, v in enumerate(x)]
    return spark.createDataFrame(rows, SCHEMA)


def brute(x, k, skip_self, members=None):
    u = x / (np.linalg.norm(x, axis=1, keepdims=True) + 1e-10)
    out = {}
    for i in range(len(x)):
        sims = (u * u[i]).sum(axis=1)
        allowed = [j for j in (members or range(len(x))) if not (skip_self and j == i)]
        out[i] = sorted(((-sims[j], j) for j in allowed))[:k]
    return out


def collected(df):
    got = {}
    for r in df.orderBy("row_id", "rank").collect():
        assert r["cohort"] == r["ref_id"] % 2
        got.setdefault(r["row_id"], []).append((-r["similarity"], r["ref_id"]))
    return got


@pytest.mark.parametrize("k, skip_self, pivots, block", [
    (5, True, 2048, 8192), (5, False, 2048, 40), (3, True, 3, 16), (1, False, 1, 7),
])
def test_pruned_nearest_equals_brute_force(spark, k, skip_self, pivots, block):
    df = vectors(spark, X)
    got = collected(CE.nearest_pruned(
        df, df, k, row_id="vec_id", skip_self=skip_self, max_pivots=pivots, block=block))
    want = brute(X, k, skip_self)
    for i, best in want.items():
        assert [j for _, j in got[i]] == [j for _, j in best], i
        assert np.allclose([s for s, _ in got[i]], [s for s, _ in best], atol=1e-12)


def test_groups_apart_are_not_compared(spark):
    df = vectors(spark, X)
    parts = CE.visits(df, df, 5, row_id="vec_id", skip_self=True, max_pivots=64)
    seen = {r["row_id"]: r["n"] for r in
            parts.groupBy("row_id").agg(F.sum("visited").alias("n")).collect()}
    # lines without a row count the comparisons that found nothing nearer
    assert set(seen) - {None} == set(range(240)) and sum(seen.values()) >= 5 * 240
    # eight groups: far less than all pairs are compared
    assert sum(seen.values()) < 0.6 * 240 * 240


def test_uniform_vectors_and_few_references(spark):
    x = RNG.normal(size=(70, 6))
    df = vectors(spark, x)
    want = brute(x, 5, True)
    got = collected(CE.nearest_pruned(df, df, 5, row_id="vec_id", skip_self=True))
    assert {i: [j for _, j in b] for i, b in got.items()} == {i: [j for _, j in b] for i, b in want.items()}
    few = df.filter("vec_id < 3")
    got = collected(CE.nearest_pruned(df, few, 5, row_id="vec_id", skip_self=True))
    want = brute(x, 5, True, members=[0, 1, 2])
    assert {i: [j for _, j in b] for i, b in got.items()} == {i: [j for _, j in b] for i, b in want.items()}


def test_null_vectors_and_empty_tables(spark):
    df = vectors(spark, X[:30], skip=(3, 4))
    got = collected(CE.nearest_pruned(df, df, 2, row_id="vec_id"))
    assert set(got) == set(range(30)) - {3, 4}
    assert not {j for b in got.values() for _, j in b} & {3, 4}
    none = df.filter("vec_id < 0")
    assert CE.nearest_pruned(df, none, 2, row_id="vec_id").count() == 0
    assert CE.nearest_pruned(none, df, 2, row_id="vec_id").count() == 0


def test_ids_beyond_doubles_stay_whole(spark):
    big = 2**60 + 1
    df = vectors(spark, X[:12]).withColumn("vec_id", F.col("vec_id") + F.lit(big))
    out = CE.visits(df, df, 1, row_id="vec_id", block=3)
    ids = {r["ref_id"] for r in out.filter("ref_id is not null").collect()}
    assert ids <= set(range(big, big + 12)) and ids


def flat(spark, pts, ident):
    return spark.createDataFrame(
        [(i, float(x), float(y)) for i, (x, y) in enumerate(pts)], f"{ident} long, x double, y double")


@pytest.mark.parametrize("leaf", [1, 4, 1024])
def test_grid_equals_brute_force(spark, leaf):
    pts = np.vstack([RNG.uniform(-3, 3, size=(60, 2)), 1 + 0.01 * RNG.normal(size=(80, 2))])
    pts[9] = pts[5]
    rows = np.vstack([pts[:50] + 0.2, 1 + 0.01 * RNG.normal(size=(30, 2)), [[50, 50], [0.0, -0.0]]])
    got = {r["row_id"]: (r["ref_id"], r["distance"]) for r in
           CE.nearest_on_grid(flat(spark, rows, "row_id"), flat(spark, pts, "point_id"), 0.4, leaf=leaf).collect()}
    d = np.sqrt(((rows[:, None] - pts[None]) ** 2).sum(axis=2))
    assert {i: r for i, (r, _) in got.items()} == {
        i: int(d[i].argmin()) for i in range(len(rows)) if d[i].min() < 0.4}
    assert all(np.isclose(dist, d[i].min()) for i, (_, dist) in got.items())


def test_grid_is_strict_and_breaks_ties_by_id(spark):
    pts = [(1.0, 0.0), (-1.0, 0.0), (0.0, 1.0), (10.0, 0.0), (10.0, 2.0)]
    rows = [(0.0, 0.0), (10.0, 1.0), (8.0, 0.0)]
    p, r = flat(spark, pts, "point_id"), flat(spark, rows, "row_id")
    for leaf in (1, 1024):
        got = {x["row_id"]: x["ref_id"] for x in CE.nearest_on_grid(r, p, 2.0, leaf=leaf).collect()}
        assert got == {0: 0, 1: 3}  # the third row has a point at exactly the radius


def test_grid_without_coordinates_or_points(spark):
    p = flat(spark, [(0, 0), (1, 1)], "point_id")
    odd = spark.createDataFrame([(0, None, 1.0), (1, float("nan"), 0.0), (2, float("inf"), 0.0), (3, 0.1, 0.0)],
                                "row_id long, x double, y double")
    assert [x["row_id"] for x in CE.nearest_on_grid(odd, p, 0.5).collect()] == [3]
    assert CE.nearest_on_grid(odd, p.filter("x > 5"), 0.5).count() == 0
    assert CE.nearest_on_grid(odd.filter("row_id > 9"), p, 0.5).count() == 0
