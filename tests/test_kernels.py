from itertools import combinations
from math import factorial

import numpy as np
import pytest

from timbrel.operators import coalitions as C
from timbrel.operators import kernels as K
from timbrel.plans import models as M


def table(spark, n=300, d=6, seed=1):
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, d))
    y = (np.sqrt((x[:, :2] ** 2).sum(axis=1)) > 1.2).astype(int)  # a ring: no line parts it
    return x, y, spark.createDataFrame([(i, int(y[i]), x[i].tolist()) for i in range(n)], "vec_id long, y long, features array<double>").repartition(3)


def test_map_gives_the_kernel(spark):
    x, _, df = table(spark)
    whole = K.kernel_map(df, 0.1)
    gram = np.exp(-0.1 * ((x[:, None] - x[None]) ** 2).sum(axis=2))
    got = {r.vec_id: r.z for r in df.select("vec_id", whole.apply().alias("z")).collect()}
    z = np.array([got[i] for i in range(300)])
    assert np.abs(z @ z.T - gram).max() < 1e-6  # every row is a landmark
    some = K.kernel_map(df, 0.1, landmarks=100)
    z = some.map(x)
    lost = 1 - (z * z).sum(axis=1)  # of every row's own kernel; bounds the error of each pair
    assert some.landmarks.shape == (100, 6) and lost.min() > -1e-9 and np.abs(z @ z.T - gram).mean() < 0.005
    assert (np.abs(z @ z.T - gram) <= np.sqrt(np.outer(lost + 1e-9, lost + 1e-9)) + 1e-9).all()
    assert abs(K.kernel_map(df).gamma - 1 / (6 * x.var())) < 1e-9 and K.kernel_map(df, "auto").gamma == 1 / 6


def test_margin_parts_what_no_line_does(spark):
    x, y, df = table(spark)
    model, flat = K.fit_margin(df, cost=5.0), K.fit_margin(df, cost=5.0, kernel="linear")
    hits = [np.mean([(r.margin > 0) == r.y for r in m.score(df).collect()]) for m in (model, flat)]
    assert hits[0] > 0.93 and hits[1] < 0.75
    # no other weights nearby have less of the objective that is stated
    z = model.space.map(x)
    w = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (1 - y).sum()))
    cost = lambda v, b: v @ v / 2 + 5.0 * (w * np.maximum(0, 1 - (2 * y - 1) * (z @ v + b))).sum()
    least = cost(model.weights, model.intercept)
    r = np.random.default_rng(0)
    for _ in range(30):
        assert cost(model.weights + 0.05 * r.normal(size=len(model.weights)), model.intercept + 0.05 * r.normal()) > least * 0.999


def test_search_orders_the_grid(spark):
    _, _, df = table(spark, 150)
    folded = df.selectExpr("*", "vec_id % 3 as fold")
    found = K.search_margin(folded, [{"cost": 1.0, "gamma": "scale", "kernel": "linear"}, {"cost": 5.0, "gamma": "scale", "kernel": "rbf"}], rounds=40).collect()
    assert [r.cell for r in found] == [1, 0] and found[0].roc_auc > 0.9 > found[1].roc_auc
    assert len(K.GRID) == 70


def test_search_takes_every_cell(spark, folder, monkeypatch):
    seen = []
    monkeypatch.setattr(K, "search_margin", lambda df, grid: seen.extend(grid) or df.selectExpr("0.5d as roc_auc").limit(1))
    M.m10_kernel(spark, folder).collect()
    assert seen == K.GRID and len({tuple(g.values()) for g in seen}) == 70


def test_cells_share_maps_and_fits(spark, monkeypatch):
    """Areas are those of one fit a cell; a linear cell's gamma makes no fit of its own."""
    x, y, df = table(spark, 120)
    folded = df.selectExpr("*", "vec_id % 3 as fold")
    grid = [{"cost": c, "gamma": g, "kernel": k} for c, g, k in (
        (0.5, "scale", "rbf"), (5.0, "scale", "rbf"), (5.0, "scale", "linear"), (5.0, "auto", "linear"), (5.0, "auto", "rbf"), (0.5, 0.1, "linear"))]
    fits, hinge = [], K._hinge
    monkeypatch.setattr(K, "_hinge", lambda rows, space, cost, *more: fits.append((space and space.gamma, cost)) or hinge(rows, space, cost, *more))
    found = {r.cell: r for r in K.search_margin(folded, grid, rounds=20, landmarks=40).collect()}
    assert len(fits) == 15 and sorted(found) == list(range(6))
    for i, g in enumerate(grid):
        assert (found[i].cost, found[i].gamma, found[i].kernel) == (g["cost"], str(g["gamma"]), g["kernel"])
    for i in (0, 2, 4):
        areas = []
        for k in range(3):
            model = K.fit_margin(folded.where(f"fold != {k}"), rounds=20, landmarks=40, **grid[i])
            rows = model.score(folded.where(f"fold = {k}")).collect()
            above = [(a.margin > b.margin) + (a.margin == b.margin) / 2 for a in rows for b in rows if a.y > b.y]
            areas.append(np.mean(above))
        assert abs(found[i].roc_auc - np.mean(areas)) < 2e-3
    assert found[2].roc_auc == found[3].roc_auc


@pytest.mark.parametrize("nu", [0.05, 0.3, 0.9])
def test_one_class_conditions_hold(spark, nu):
    x, _, _ = table(spark, 200)
    k = K.gaussian(x, x, 0.2)
    w, offset = K.one_class_weights(k, nu)
    g = k @ w
    assert abs(w.sum() - nu * 200) < 1e-9 and w.min() >= 0 and w.max() <= 1
    assert (g[w <= 1e-9] >= offset - 1e-5).all() and (g[w >= 1 - 1e-9] <= offset + 1e-5).all()
    inner = (w > 1e-9) & (w < 1 - 1e-9)
    assert np.abs(g[inner] - offset).max(initial=0) < 1e-5
    assert (w > 0).mean() >= nu - 1e-9 and (g < offset - 1e-5).mean() <= nu


def test_one_class_scores_every_row(spark):
    x, _, df = table(spark, 200)
    model = K.one_class(df, 0.1, vec="features")
    got = {r.vec_id: r.raw for r in model.score(df, "features").collect()}
    w, offset = K.one_class_weights(K.gaussian(x, x, model.gamma), 0.1)
    assert np.allclose([got[i] for i in range(200)], K.gaussian(x, x, model.gamma) @ w, atol=1e-4) and abs(offset - model.offset) < 1e-4


def exact(f, x, centres, shares):
    d = len(x)
    def v(s):
        rows = centres.copy()
        rows[:, list(s)] = x[list(s)]
        return shares @ f(rows)
    out = np.zeros(d)
    for i in range(d):
        rest = [j for j in range(d) if j != i]
        for k in range(d):
            for s in combinations(rest, k):
                out[i] += factorial(k) * factorial(d - k - 1) / factorial(d) * (v((*s, i)) - v(s))
    return out


def test_attributions_are_shapley_values(spark):
    r = np.random.default_rng(5)
    x = r.normal(size=(6, 8))
    f = lambda m: np.tanh(m[:, 0] * m[:, 1]) + m[:, 2] ** 2 - m[:, 3] * (m[:, 4] > 0) + m[:, 7]
    base = [(r.normal(size=8).tolist(), s) for s in (0.5, 0.3, 0.2)]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(99, None)], "vec_id long, features array<double>")
    got = np.zeros((6, 8))
    for row in C.kernel_attributions(df, "vec_id", f, base).collect():
        got[row.vec_id, row.i] = row.value
    centres, shares = np.array([b[0] for b in base]), np.array([b[1] for b in base])
    for i in range(6):
        assert np.allclose(got[i], exact(f, x[i], centres, shares), atol=1e-8)


@pytest.mark.parametrize("d,most", [(8, 300), (20, 400), (64, 1500), (2, 50), (1, 9)])
def test_attributions_add_up(d, most):
    r = np.random.default_rng(2)
    x, w = r.normal(size=(5, d)), r.normal(size=d)
    f = lambda m: m @ w
    z, weights = C.coalitions(d, most)
    assert len(z) <= most
    centres, shares = r.normal(size=(3, d)), np.array([0.2, 0.5, 0.3])
    got = C.attributions_of(x, f, centres, shares, z, C.solver(z, weights) if d > 1 else np.zeros((1, 1)))
    assert np.allclose(got.sum(axis=1), f(x) - shares @ f(centres))
    assert np.allclose(got, (x - shares @ centres) * w)  # a linear model's attributions are known


def test_mixed_rows_are_scored_from_shared_factors(spark, monkeypatch):
    """The mean score over coalitions equals that of the mixed rows themselves, in blocks too; rows are dealt over all cores."""
    x, _, df = table(spark, 60)
    d = x.shape[1]
    model = K.KernelProbability(K.fit_margin(df, landmarks=20))
    z, _ = C.coalitions(d, 40)
    centres, shares = x[:3] + 0.1, np.array([0.2, 0.5, 0.3])
    want = np.array([[shares @ model(np.where(c > 0, row, centres)) for c in z] for row in x])
    assert np.allclose(model.over_coalitions(x, centres, shares, z), want, atol=1e-12)
    monkeypatch.setattr(K, "MIXED", 300)
    assert np.allclose(model.over_coalitions(x, centres, shares, z), want, atol=1e-12)
    base = list(zip(centres.tolist(), shares))
    out = C.kernel_attributions(df.coalesce(1), "vec_id", model, base)
    assert out.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert out.count() == 60 * d


def test_scores_hold_few_kernel_values_at_once(monkeypatch):
    """Whatever the size of a batch, a matrix of rows by support rows has no more cells than the bound."""
    x = np.random.default_rng(3).normal(size=(500, 4))
    sizes = []
    def score(rows):
        sizes.append(len(rows))
        return K.gaussian(rows, x[:50], 0.3) @ np.ones(50)
    monkeypatch.setattr(K, "CELLS", 1000)
    got = K._in_slices(score, x, 50)
    assert max(sizes) * 50 <= 1000 and sum(sizes) == 500
    assert np.allclose(got, K.gaussian(x, x[:50], 0.3) @ np.ones(50))
    assert K._in_slices(score, x[:0], 50).shape == (0,)
