import numpy as np
import pytest

from timbrel.operators import trees as T


def data(spark, n=500, d=5, seed=3):
    r = np.random.default_rng(seed)
    x = np.round(r.normal(size=(n, d)), 2)
    y = ((x[:, 0] * x[:, 1] > 0) ^ (r.random(n) < 0.05)).astype(int)
    rows = [(i, int(y[i]), x[i].tolist()) for i in range(n)]
    return x, y, spark.createDataFrame(rows, "vec_id long, y long, features array<double>").repartition(3)


def brute_tree(x, g, h, growth, leaf):
    """Every distinct value of every feature is tried as a cut."""
    out = T.empty(growth.depth, 1)
    stack = [(0, np.arange(len(x)), 0)]
    out.value[0, 0] = leaf(g.sum(), h.sum())
    score = lambda a, b: a * a / (b + growth.reg_lambda)
    while stack:
        node, at, level = stack.pop()
        if level == growth.depth:
            continue
        best = (growth.min_gain, None, None)
        for f in range(x.shape[1]):
            for v in np.unique(x[at, f]):
                left = at[x[at, f] <= v]
                right = at[x[at, f] > v]
                if h[left].sum() < growth.min_child or h[right].sum() < growth.min_child:
                    continue
                gain = score(g[left].sum(), h[left].sum()) + score(g[right].sum(), h[right].sum()) - score(g[at].sum(), h[at].sum())
                if gain > best[0] + 1e-9:
                    best = (gain, f, v)
        if best[1] is None:
            continue
        out.feature[0, node], out.cut[0, node] = best[1], best[2]
        for child, part in ((2 * node + 1, at[x[at, best[1]] <= best[2]]), (2 * node + 2, at[x[at, best[1]] > best[2]])):
            out.value[0, child] = leaf(g[part].sum(), h[part].sum())
            stack.append((child, part, level + 1))
    return out


def test_boosting_cuts_where_a_search_over_all_values_does(spark):
    x, y, df = data(spark)
    growth = T.Growth(depth=3, bins=4000, reg_lambda=1.0, min_child=2.0)
    spec = T.Boosting(rounds=3, rate=0.3, subsample=1.0, refresh=2, growth=growth)
    model, base = T.boost(df, spec)
    margin = np.full(len(y), base)
    for t in range(3):
        p = T.sigmoid(margin)
        want = brute_tree(x, p - y, p * (1 - p), growth, lambda g, h: -0.3 * g / (h + 1.0))
        one = T.Trees(model.feature[t : t + 1], model.cut[t : t + 1], model.value[t : t + 1])
        assert np.allclose(one.values(x), want.values(x))
        margin += one.values(x)
    got = {r.vec_id: r.p for r in T.boosted_probability(df, (model, base)).collect()}
    assert np.allclose([got[i] for i in range(len(y))], T.sigmoid(margin))


def test_boosting_samples_rows_and_features_and_learns(spark):
    x, y, df = data(spark)
    spec = T.Boosting(rounds=25, rate=0.3, growth=T.Growth(depth=3, reg_lambda=1.0, features=0.6))
    model, base = T.boost(df, spec)
    p = T.sigmoid(base + model.values(x))
    assert ((p > 0.5) == y).mean() > 0.9
    for t in range(25):
        used = set(model.feature[t][model.feature[t] >= 0].tolist())
        assert used <= set(T.drawn_features(spec.growth, 5, t, 0).tolist()) and len(T.drawn_features(spec.growth, 5, t, 0)) == 3
    ids = np.arange(-5000, 5000)
    u = T.uniform(ids, 3)
    assert np.array_equal(u[::-1], T.uniform(ids[::-1], 3)) and abs(u.mean() - 0.5) < 0.02 and 0 <= u.min() and u.max() < 1
    assert abs(np.corrcoef(u, T.uniform(ids, 4))[0, 1]) < 0.05


def test_every_tree_draws_its_own_rows_evenly(spark):
    r = np.random.default_rng(0)
    ids = r.integers(-(2**62), 2**62, 4000)
    y = (np.arange(4000) < 400).astype(int)
    rate = np.where(y == 1, 1.0, 400 / 3600)
    draws = np.array([T.poisson(ids, t, rate) for t in range(60)])
    assert len({d.tobytes() for d in draws}) == 60
    assert (draws.sum(axis=0) > 0).mean() > 0.99
    ones, zeros = draws[:, y == 1].sum(axis=1), draws[:, y == 0].sum(axis=1)
    assert abs(ones.mean() - 400) < 15 and abs(zeros.mean() - 400) < 15
    assert abs(draws[:, y == 1].var() - 1) < 0.05


def test_balanced_forest(spark):
    x, y, df = data(spark, 400)
    rare = df.where("y = 0 or vec_id % 4 = 0")
    rates = T.draw_rates(rare)
    assert min(rates.values()) < 0.5 and max(rates.values()) == 1.0
    growth = T.Growth(depth=6, bins=32, features="sqrt", per_node=True)
    model = T.balanced_forest(rare, trees=30, growth=growth, together=20)
    assert model.feature.shape == (30, 127) and len({f.tobytes() for f in model.feature}) == 30
    assert ((model.value >= 0) & (model.value <= 1)).all()
    got = {r.vec_id: r.p for r in T.forest_probability(df, model).collect()}
    p = np.array([got[i] for i in range(400)])
    hit = (p > 0.5) == y
    assert hit.mean() > 0.8 and hit[y == 1].mean() > 0.7  # the rare class is not given up


@pytest.mark.parametrize("one", [True, False])
def test_rows_without_values_and_constant_labels(spark, one):
    rows = [(1, None, [1.0]), (2, 1, None), (3, 1, [2.0]), (4, 1 if one else 0, [5.0])]
    df = spark.createDataFrame(rows, "vec_id long, y long, features array<double>")
    growth = T.Growth(depth=2, bins=8, min_child=0.01)
    model, base = T.boost(df, T.Boosting(rounds=2, growth=growth))
    assert np.isfinite(model.value).all() and np.isfinite(base)
    T.balanced_forest(df, trees=2, growth=growth)


def test_rows_keep_bin_numbers_that_route_as_their_values_do(spark):
    x = np.array([[0.0, 5.0], [1.0, np.nan], [2.0, 7.0], [1.5, 6.0]])
    cuts = [np.array([0.5, 1.5]), np.array([5.0, 6.5])]
    df = spark.createDataFrame([(i, [None if np.isnan(v) else float(v) for v in r]) for i, r in enumerate(x)], "id long, features array<double>")
    rows = T.binned(df, cuts, 8, "binned")
    assert rows.columns == ["id", "codes"]  # passes over the rows read one byte a feature
    got = {r.id: np.frombuffer(r.codes, np.int8).tolist() for r in rows.collect()}
    assert got == {0: [0, 0], 1: [1, -1], 2: [2, 2], 3: [1, 1]}
    trees = T.Trees(np.array([[0, -1, -1], [1, -1, -1]]), np.array([[1.5, 0, 0], [5.0, 0, 0]]), np.zeros((2, 3)))
    codes = np.array([got[i] for i in range(4)], np.int8)
    for t in range(2):
        assert (trees.coded(cuts).leaves(codes, t) == trees.leaves(x, t)).all()
