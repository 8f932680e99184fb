"""Vectors, metrics, splits and models against numpy."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from timbrel.operators import metrics as ME
from timbrel.operators import models as MO
from timbrel.operators import patients as PA
from timbrel.operators import splits as SP
from timbrel.operators import vectors as VE

RNG = np.random.default_rng(3)
N, D = 90, 6
X = RNG.normal(size=(N, D))
X[10] = X[11] = X[12]  # copies of one vector
Y = (X[:, 0] + 0.3 * RNG.normal(size=N) > 0.4).astype(int)


@pytest.fixture(scope="module")
def refs(spark):
    rows = [(i, int(Y[i]), X[i].tolist()) for i in range(N)]
    return spark.createDataFrame(rows, "vec_id long, cohort long, embedding array<double>").cache()


@pytest.fixture(scope="module")
def table(spark):
    rows = [(i, i % 12, int(Y[i]), X[i].tolist()) for i in range(N)]
    return spark.createDataFrame(
        rows, "vec_id long, subject long, y long, features array<double>").cache()


def test_similarity_at_the_centroids(spark):
    e = np.eye(8)
    df = spark.createDataFrame([(0, e[1].tolist())], "vec_id long, embedding array<double>")
    row = VE.cohort_similarity(df, e[0].tolist(), e[1].tolist()).first()
    assert row["nearest"] == "Parkinson's Cluster" and row["confidence"] == "High"
    assert row["similarity_parkinsons"] > 90


@pytest.mark.parametrize("limit", [VE.BROADCAST_BYTES, 1500])
def test_nearest_references_both_ways(refs, limit):
    got = {}
    for r in VE.nearest_references(refs, refs, 5, row_id="vec_id", limit=limit).collect():
        got.setdefault(r["row_id"], {})[r["rank"]] = (r["ref_id"], r["similarity"])
    u = X / (np.linalg.norm(X, axis=1, keepdims=True) + 1e-10)
    for i in range(N):
        sims = np.round(u @ u[i], 12)
        want = sorted(range(N), key=lambda j: (-sims[j], j))[:5]
        if i not in (10, 11, 12):
            assert [got[i][k][0] for k in range(1, 6)] == want
        assert np.allclose([got[i][k][1] for k in range(1, 6)], sims[want])


@pytest.mark.parametrize("limit", [VE.BROADCAST_BYTES, 1500])
def test_density_both_ways(refs, limit):
    gamma = VE.kernel_width(refs)
    assert np.isclose(gamma, 1 / (D * X.var()))
    got = {r["row_id"]: r["raw"] for r in
           VE.density_score(refs, refs, gamma, row_id="vec_id", limit=limit).collect()}
    d2 = ((X[:, None] - X[None]) ** 2).sum(axis=2)
    assert np.allclose([got[i] for i in range(N)], 0.05 * np.exp(-gamma * d2).sum(axis=1))


@pytest.mark.parametrize("limit", [VE.BROADCAST_BYTES, 300])
def test_nearest_within_radius(spark, limit):
    pts = RNG.uniform(0, 5, size=(60, 2))
    pts[7] = pts[3]
    df = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(pts)], "point_id long, xy array<double>")
    rows = spark.createDataFrame([(i, (p + 0.2).tolist()) for i, p in enumerate(pts)], "row_id long, xy array<double>")
    got = {r["row_id"]: r["ref_id"] for r in VE.nearest_within(rows, df, 0.4, limit=limit).collect()}
    d = np.linalg.norm((pts + 0.2)[:, None] - pts[None], axis=2)
    assert got == {i: int(d[i].argmin()) for i in range(60) if d[i].min() < 0.4}


def test_best_breaks_ties_by_id():
    sims = np.array([[0.5, 0.9, 0.5, 0.5, 0.1]])
    assert VE._best(sims, np.array([9, 4, 3, 7, 1]), 3).tolist() == [[1, 2, 3]]


def test_covariance_and_shrinkage(refs):
    models = VE.shrunk_inverses(refs, "cohort", "embedding")
    for k in (0, 1):
        m = X[Y == k]
        c = m - m.mean(axis=0)
        emp = c.T @ c / len(m)
        mu = np.trace(emp) / D
        delta = ((emp - mu * np.eye(D)) ** 2).sum() / D
        beta = min(sum(((np.outer(r, r) - emp) ** 2).sum() for r in c) / len(m) ** 2 / D, delta)
        want = (1 - beta / delta) * emp + beta / delta * mu * np.eye(D)
        assert np.allclose(models[k][0], m.mean(axis=0))
        assert np.allclose(models[k][1], np.linalg.inv(want + 1e-4 * np.eye(D)))


def test_projection_is_centred_and_signed(refs):
    fit = VE.fit_projection(refs, 2)
    got = np.array([r["p"] for r in refs.orderBy("vec_id").select(fit.apply().alias("p")).collect()])
    c = X - X.mean(axis=0)
    _, _, vt = np.linalg.svd(c, full_matrices=False)
    v = vt[:2] * np.sign(vt[[0, 1], np.abs(vt[:2]).argmax(axis=1)])[:, None]
    assert np.allclose(got, c @ v.T)


def test_scaler_uses_population_deviation(table):
    s = VE.fit_scaler(table)
    assert np.allclose(s.mean, X.mean(axis=0)) and np.allclose(s.std, X.std(axis=0))


def auc_by_hand(y, p):
    pos, neg = p[y == 1], p[y == 0]
    return np.mean([(a > b) + 0.5 * (a == b) for a in pos for b in neg])


def test_metrics(spark):
    y = RNG.integers(0, 2, 200)
    p = np.round(np.clip(RNG.uniform(size=200) + 0.2 * y - 0.1, 0, 1), 2)
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, p)], "y long, p double")
    assert np.isclose(ME.roc_auc(df).first()["roc_auc"], auc_by_hand(y, p))
    thresholds = sorted(set(p), reverse=True)
    ap, last = 0.0, 0.0
    for t in thresholds:
        hit = p >= t
        recall = (y[hit] == 1).sum() / y.sum()
        ap += (recall - last) * (y[hit] == 1).mean()
        last = recall
    assert np.isclose(ME.average_precision(df).first()["pr_auc"], ap)
    one = df.filter("y = 1")
    assert ME.roc_auc(one).first()["roc_auc"] == 0.0
    m = ME.confusion_metrics(df.withColumn("p", F.lit(0.0))).first()
    assert (m["precision"], m["recall"], m["f1"]) == (0.0, 0.0, 0.0)
    sure = spark.createDataFrame([(1, 0.0), (0, 0.0)], "y long, p double")
    assert ME.log_loss(sure).first()["loss"] == 50.0


def test_splits_keep_subjects_apart(table):
    df = table.withColumn("label", F.col("y"))
    held = SP.test_subjects(df)
    train, test = SP.subject_split(df, held)
    a = {r["subject"] for r in train.select("subject").distinct().collect()}
    b = {r["subject"] for r in test.select("subject").distinct().collect()}
    assert not a & b and train.count() + test.count() == N
    folds = SP.group_folds(df, "vec_id", 3)
    per = {r["subject"]: r["f"] for r in folds.groupBy("subject").agg(F.collect_set("fold").alias("f")).collect()}
    assert len(per) == 12 and all(len(f) == 1 for f in per.values())
    few = SP.group_folds(df.withColumn("subject", F.col("vec_id") % 3), "vec_id", 3)
    sizes = [r["count"] for r in few.groupBy("label", "fold").count().collect()]
    assert len(sizes) == 6
    split = SP.stratified_split(df, "vec_id", "y").groupBy("y").agg(
        F.sum(F.col("test").cast("int")).alias("t"), F.count(F.lit(1)).alias("n")).collect()
    assert all(r["t"] == int(r["n"] * 0.2) for r in split)


def test_oversampling_evens_classes_on_segments(refs):
    made = SP.oversample(refs).collect()
    small = 1 if Y.sum() < N - Y.sum() else 0
    assert len(made) == abs(N - 2 * Y.sum())
    lo, hi = X[Y == small].min(axis=0), X[Y == small].max(axis=0)
    for r in made:
        assert r["cohort"] == small
        v = np.array(r["embedding"])
        assert (v >= lo - 1e-9).all() and (v <= hi + 1e-9).all()


def test_l1_selection_finds_the_signal(table):
    top = MO.top_coefficients(MO.l1_selection(table)).collect()
    assert len(top) <= 12 and top[0]["i"] == 0 and top[0]["rank"] == 1


def test_calibration_and_attributions(table):
    p = {r["vec_id"]: r["p"] for r in MO.calibrated_scores(table, table, "vec_id").collect()}
    assert auc_by_hand(Y, np.array([p[i] for i in range(N)])) > 0.85
    scaler = VE.fit_scaler(table)
    model = MO.estimators()["random_forest"].fit(MO.prepared(table, scaler))
    score = MO.probability(model)
    scaled = table.select("vec_id", scaler.apply().alias("features"))
    base = [([0.0] * D, 1.0)]
    parts = MO.sampled_attributions(scaled, "vec_id", score, base)
    sums = {r["vec_id"]: r["s"] for r in parts.groupBy("vec_id").agg(F.sum("value").alias("s")).collect()}
    full = {r["vec_id"]: r["p"] for r in score(MO.prepared(table, scaler)).collect()}
    zero = score(MO.prepared(table.limit(1).withColumn("features", F.array(*[F.lit(0.0)] * D)))).first()["p"]
    assert all(np.isclose(sums[i], full[i] - zero) for i in range(N))


def test_missing_feature_is_an_error(spark):
    with pytest.raises(ValueError):
        MO.align(spark.createDataFrame([(1.0,)], "a double"), ["a", "b"])


def test_patient_round_trip(spark):
    e0, e1 = [0.5, 1.0, 1.0], [-1.0, 0.2, 0.4]
    df = spark.createDataFrame(
        [("p", "s1", 1, e0), ("p", "s2", 2, e1), ("q", "s3", 1, e1)],
        "patient_id string, screening_id string, us long, embedding array<double>")
    base = PA.baselines(df)
    assert {r["patient_id"]: r["baseline"][0] for r in base.collect()} == {"p": 0.5, "q": -1.0}
    drift = {r["screening_id"]: r["drift"] for r in PA.with_drift(df, base).collect()}
    cos = np.dot(e0, e1) / np.linalg.norm(e0) / np.linalg.norm(e1)
    assert drift["s1"] is None and drift["s3"] is None and np.isclose(drift["s2"], 1 - cos)
    kept = PA.first_wins(base, df.withColumn("embedding", F.array(F.lit(9.0))))
    assert {r["baseline"][0] for r in kept.collect()} == {0.5, -1.0}
    twice = df.unionByName(df.withColumn("us", F.col("us") + 10))
    assert {r["us"] for r in PA.last_wins(twice).collect()} == {11, 12}


def test_greatest_by_groups_equals_a_full_sort():
    r = np.random.default_rng(4)
    for width in (5, 320, 321, 383, 1000, 4096):
        for sims in (r.normal(size=(20, width)), r.integers(0, 9, (20, width)) / 9.0, np.ones((20, width))):
            sims[3, : width // 2] = -np.inf
            assert (VE._greatest(sims, 5) == np.argsort(-sims, axis=1, kind="stable")[:, :5]).all()


def test_references_are_made_ready_once_a_task(spark, refs, monkeypatch):
    """Small tiles, ties and several tasks from one file: the answer is that of one matrix, each block made ready once."""
    monkeypatch.setattr(VE, "WIDE", 70)
    monkeypatch.setattr(VE, "GROUP", 4)
    monkeypatch.setattr(VE, "TILE", 7)
    r = np.random.default_rng(6)
    x = r.normal(size=(400, 4)).round(1)
    x[300:] = x[:100]
    df = spark.createDataFrame([(i, i % 2, v.tolist()) for i, v in enumerate(x)], "vec_id long, cohort long, embedding array<double>").coalesce(1)
    made = spark.sparkContext.accumulator(0)
    unit = VE._unit
    monkeypatch.setattr(VE, "_unit", lambda m: made.add(len(m) == 400) or unit(m))
    found = VE.nearest_references(df, df, 5, row_id="vec_id", skip_self=True)
    got = {}
    for row in found.collect():
        got.setdefault(row.row_id, []).append((row["rank"], row.ref_id, row.similarity))
    u = unit(x)
    sims = u @ u.T
    np.fill_diagonal(sims, -np.inf)
    assert sorted(got) == list(range(400))
    for i in range(400):
        best = [s for _, _, s in sorted(got[i])]
        assert np.allclose(best, np.sort(sims[i])[::-1][:5]) and all(abs(sims[i, j] - s) < 1e-12 for _, j, s in got[i])
    assert 1 < made.value <= 2 * spark.sparkContext.defaultParallelism  # a task's rows are spread, its references made ready once


@pytest.mark.parametrize("limit", [VE.BROADCAST_BYTES, 3000])
def test_nearest_within_by_strips(spark, limit):
    r = np.random.default_rng(8)
    pts = np.concatenate([r.normal(0, 3, (300, 2)).round(1), [[np.inf, 1.0], [0.5, 0.5], [-0.5, 0.5]]])
    points = spark.createDataFrame([(1000 - i, p.tolist()) for i, p in enumerate(pts)], "point_id long, xy array<double>")
    own = np.concatenate([r.normal(0, 3, (200, 2)).round(1), [[0.0, 0.5], [np.inf, 0.0]]])
    rows = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(own)], "row_id long, xy array<double>")
    got = {x.row_id: (x.ref_id, x.distance) for x in VE.nearest_within(rows, points, 0.5, limit=limit).collect()}
    want = {}
    for i, p in enumerate(own[:-1]):
        d = np.sqrt(((p - pts) ** 2).sum(axis=1))
        at = min((d[j], 1000 - j) for j in range(len(pts)) if not np.isnan(d[j]))
        if at[0] < 0.5:
            want[i] = (at[1], at[0])
    assert got == want and len(want) > 100


@pytest.mark.parametrize("skip_self", [False, True])
def test_blocks_of_one_table_meet_themselves(spark, tmp_path, skip_self):
    """k2's rows and references are one table: block by block they give what one matrix gives."""
    r = np.random.default_rng(12)
    x = r.normal(size=(700, 4)).round(1)
    x[600:] = x[:100]
    made = spark.createDataFrame([(i, i % 3, v.tolist()) for i, v in enumerate(x)], "vec_id long, label int, embedding array<float>")
    made.write.parquet(f"{tmp_path}/embeddings.parquet")
    refs = spark.read.parquet(f"{tmp_path}/embeddings.parquet").select(
        "vec_id", (F.col("label") >= 1).cast("long").alias("cohort"), F.col("embedding").cast("array<double>").alias("embedding"))
    rows = refs.select(F.col("vec_id").alias("row_id"), "embedding").withColumnRenamed("row_id", "vec_id")
    found = VE.nearest_references(rows, refs, 5, row_id="vec_id", skip_self=skip_self, limit=3000)
    means = VE.mean_top_similarity(refs.select("vec_id"), found, "vec_id")
    got = {a.vec_id: a.similarity for a in means.collect()}
    u = VE._unit(x.astype(np.float32).astype(float))
    sims = u @ u.T
    if skip_self:
        np.fill_diagonal(sims, -np.inf)
    assert np.allclose([got[i] for i in range(700)], np.sort(sims, axis=1)[:, -5:].mean(axis=1))
    gamma = VE.kernel_width(refs)
    raw = {a.row_id: a.raw for a in VE.density_score(refs, refs, gamma, row_id="vec_id", limit=3000).collect()}
    whole = {a.row_id: a.raw for a in VE.density_score(refs, refs, gamma, row_id="vec_id").collect()}
    assert np.allclose([raw[i] for i in range(700)], [whole[i] for i in range(700)])


def test_few_finds_are_merged_as_many_are(monkeypatch):
    """Whether a tile's finds are sorted singly or as a matrix, ties included, the answer is the same."""
    taken = {}
    monkeypatch.setattr(VE, "against_references", lambda *a: taken.update(prepare=a[5], partial=a[6]) or a[0])
    monkeypatch.setattr(VE, "WIDE", 100)
    with pytest.raises(AttributeError):
        VE.nearest_references(None, None, 5, skip_self=True)
    r = np.random.default_rng(13)
    x = r.integers(-2, 3, size=(900, 3)).astype(float)
    ready = taken["prepare"](pd.DataFrame({"vec_id": np.arange(900), "cohort": 0}), x)
    answers = []
    for few in (0, 1, 16, 900):
        monkeypatch.setattr(VE, "FEW", few)
        answers.append(taken["partial"](np.arange(900), x, ready))
    assert len(answers[0]) == 4500 and all(a.equals(answers[0]) for a in answers)


def test_oversampling_block_by_block(spark, tmp_path, monkeypatch):
    """m15 oversamples folds whose smaller class is too large to be broadcast: the synthetic rows are the same."""
    r = np.random.default_rng(14)
    x = r.normal(size=(300, 4))
    made = spark.createDataFrame([(i, i % 12, int(i % 3 == 0), v.tolist()) for i, v in enumerate(x)], "vec_id long, subject long, y long, features array<double>")
    made.write.parquet(f"{tmp_path}/rows")
    rows = spark.read.parquet(f"{tmp_path}/rows")
    whole = {(a.source, a.copy): a.features for a in SP.oversample(rows, "vec_id", "y", "features").collect()}
    monkeypatch.setattr(SP, "nearest_references", lambda *a, **b: VE.nearest_references(*a, **b, limit=1000))
    parts = {(a.source, a.copy): a.features for a in SP.oversample(rows, "vec_id", "y", "features").collect()}
    assert len(whole) == 100 and parts.keys() == whole.keys()
    assert all(np.allclose(parts[k], whole[k]) for k in whole)
