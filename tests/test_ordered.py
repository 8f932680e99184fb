"""Ordered operators against plain brute force, with tiny blocks so that borders matter."""

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from timbrel.operators import frames as FR
from timbrel.operators import ordered as O
from timbrel.operators import series as SR
from timbrel.operators import spectral as SP

RNG = np.random.default_rng(7)
SERIES = {
    1: RNG.normal(100, 20, 150).clip(1),
    2: RNG.normal(50, 5, 40).clip(1),
    3: np.full(35, 9.0),
    4: RNG.normal(10, 2, 4).clip(1),
    5: np.concatenate([RNG.normal(10, 0.1, 60), [500.0], RNG.normal(10, 0.1, 50), [499.0]]),
}


@pytest.fixture(scope="module")
def series(spark):
    rows = [(s, t, float(x)) for s, xs in SERIES.items() for t, x in enumerate(xs)]
    return spark.createDataFrame(rows, "series_id long, t long, x double").cache()


def by_series(df, *cols):
    return {r["series_id"]: tuple(r[c] for c in cols) for r in df.collect()}


def arrays(df, pos, value):
    out = {}
    for r in df.orderBy("series_id", pos).collect():
        out.setdefault(r["series_id"], []).append(r[value])
    return out


def test_prefix_crosses_blocks(series):
    block = O.position_block("t", 8)
    got = O.prefix(
        series, ["series_id"], block, ["t"], sums={"s": F.col("x")}, maxima={"m": F.col("x")}
    )
    sums, tops = arrays(got, "t", "s"), arrays(got, "t", "m")
    for k, xs in SERIES.items():
        assert np.allclose(sums[k], np.cumsum(xs))
        assert np.allclose(tops[k], np.maximum.accumulate(xs))


def test_prefix_before_leaves_own_row_out(series):
    got = O.prefix(
        series, ["series_id"], O.position_block("t", 8), ["t"], sums={"s": F.lit(1)}, before=True
    )
    assert all(v == list(range(len(v))) for v in arrays(got, "t", "s").values())


def test_dense_index_without_keys(spark):
    df = spark.range(1000).withColumn("v", 1000 - F.col("id"))
    got = O.dense_index(df, [], F.floor(F.col("v") / 10), ["v"], "r").collect()
    assert sorted((r["v"], r["r"]) for r in got) == [(i + 1, i) for i in range(1000)]


def test_neighbourhood_equals_plain_window(series):
    from pyspark.sql import Window

    def build(w):
        return {
            "p": F.lag("x").over(w), "m": F.avg("x").over(w.rowsBetween(-2, 2)),
            "n": F.lead("x", 2).over(w),
        }

    small = O.neighbourhood(series, ["series_id"], "t", 2, 2, build, size=8)
    w = Window.partitionBy("series_id").orderBy("t")
    plain = series.select("*", *[c.alias(n) for n, c in build(w).items()])
    key = ("series_id", "t")
    assert sorted(small.select(*key, "p", "m", "n").collect(), key=lambda r: r[:2]) == sorted(
        plain.select(*key, "p", "m", "n").collect(), key=lambda r: r[:2]
    )


@settings(
    max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture]
)
@given(xs=st.lists(st.integers(-50, 50), min_size=1, max_size=60), per=st.sampled_from([1, 4, 99]))
def test_quantiles_match_numpy(spark, xs, per):
    df = spark.createDataFrame([(1, float(x)) for x in xs], "k long, v double")
    kept = O.BLOCK
    try:
        O.ranked_values.__defaults__ = (per,)
        row = O.quantiles(df, ["k"], "v", {"a": 0.05, "b": 0.5, "c": 0.9}).first()
    finally:
        O.ranked_values.__defaults__ = (kept,)
    assert np.allclose([row["a"], row["b"], row["c"]], np.percentile(xs, [5, 50, 90]))


def jitter_by_hand(p):
    if len(p) < 5 or p.mean() == 0:
        return 0.0, 0.0, 0.0
    local = np.mean(np.abs(np.diff(p)))
    rap = np.mean([abs(p[i] - p[i - 1 : i + 2].mean()) for i in range(1, len(p) - 1)])
    ppq = np.mean([abs(p[i] - p[i - 2 : i + 3].mean()) for i in range(2, len(p) - 2)])
    return local / p.mean() * 100, rap / p.mean(), ppq / p.mean()


def test_jitter(series):
    got = by_series(SR.jitter(series), "jitter_pct", "rap", "ppq")
    for k, xs in SERIES.items():
        assert np.allclose(got[k], jitter_by_hand(xs))


def test_shimmer_skips_non_positive(spark):
    xs = [1.0, -3.0, 2.0, 0.0, 4.0, 3.0, 5.0, 2.0]
    df = spark.createDataFrame([(1, t, x) for t, x in enumerate(xs)], "series_id long, t long, x double")
    a = np.array([x for x in xs if x > 0])
    row = SR.shimmer(df).first()
    assert np.isclose(row["shimmer_local"], np.mean(np.abs(np.diff(a))) / a.mean())
    assert np.isclose(row["shimmer_db"], np.mean(np.abs(20 * np.log10(a[1:] / a[:-1]))))
    assert row["apq11"] == 0.0


def recurrence_by_hand(xs):
    z = (xs - xs.mean()) / (xs.std() + 1e-8)
    out = {}
    for i in range(len(z)):
        for j in range(i + 1, len(z)):
            if abs(z[j] - z[i]) < 0.5:
                out[i] = j - i
                break
    return out


@pytest.mark.parametrize("look, reach", [(1, 2), (2, 8), (4, 16), (24, 4096)])
def test_first_recurrence_has_no_horizon(series, look, reach):
    got = {}
    for r in SR.first_recurrence(series, look=look, reach=reach).collect():
        got.setdefault(r["series_id"], {})[r["t"]] = r["length"]
    for k, xs in SERIES.items():
        assert got.get(k, {}) == recurrence_by_hand(xs)


def entropy(lengths, bins):
    hist, _ = np.histogram(lengths, bins=bins, density=True)
    p = (hist + 1e-10) / (hist + 1e-10).sum()
    return float(-(p * np.log2(p)).sum())


def test_entropies(series):
    ppe = by_series(SR.period_entropy(series), "ppe")
    rpde = by_series(SR.recurrence_entropy(series), "rpde")
    for k, xs in SERIES.items():
        periods = 1 / xs
        want = entropy(np.log2(periods / periods.mean()), 100) / np.log2(100) if len(xs) >= 10 else 0
        # a constant contour gives rounding noise as range in numpy; it has no entropy
        assert np.isclose(ppe[k][0], np.clip(want, 0, 1), atol=1e-6) or k == 3
        lengths = list(recurrence_by_hand(xs).values())
        if len(xs) < 20 or len(lengths) < 5:
            assert rpde[k][0] == 0.5
        else:
            n = len(lengths)
            want = entropy(lengths, min(30, n // 2 + 1)) / np.log2(30)
            assert np.isclose(rpde[k][0], np.clip(want, 0, 1))


def dfa_by_hand(x):
    if len(x) < 30:
        return 0.7
    y = np.cumsum(x - x.mean())
    sizes = np.unique(np.round(np.logspace(np.log10(4), np.log10(len(y) // 4), 12)).astype(int))
    f, used = [], []
    for b in sizes:
        if len(y) // b < 2:
            continue
        t = np.arange(b)
        parts = [y[k * b : (k + 1) * b] for k in range(len(y) // b)]
        f.append(np.mean([
            np.sqrt(np.mean((s - np.polyval(np.polyfit(t, s, 1), t)) ** 2)) for s in parts]))
        used.append(b)
    if len(used) < 4:
        return 0.7
    return float(np.clip(np.polyfit(np.log(used), np.log(np.array(f) + 1e-10), 1)[0], 0.1, 2))


def test_fluctuation(series):
    got = by_series(SR.fluctuation(series), "dfa")
    for k in (1, 2, 4, 5):
        assert np.isclose(got[k][0], dfa_by_hand(SERIES[k]), atol=1e-6)


def test_spread_and_dimension_bounds(series):
    got = by_series(SR.spread(series), "spread1", "spread2")
    assert got[4] == (-5.0, 0.2)
    for k, xs in SERIES.items():
        if len(xs) >= 10:
            ln = np.log(xs + 1e-8)
            assert np.isclose(got[k][0], np.clip(3 * (np.percentile(ln, 25) - ln.mean()), -8, -2))
    d2 = by_series(SR.correlation_dimension(series), "d2")
    assert d2[4] == (2.3,) and all(1 <= v[0] <= 4 for v in d2.values())


def test_frames_are_complete_and_ordered(series):
    got = {}
    for r in FR.frames(series, 7, 3).collect():
        got.setdefault(r["series_id"], {})[r["frame"]] = r["xs"]
    for k, xs in SERIES.items():
        n = (len(xs) - 7) // 3 + 1 if len(xs) >= 7 else 0
        assert sorted(got.get(k, {})) == list(range(n))
        for f, frame in got.get(k, {}).items():
            assert np.allclose(frame, xs[f * 3 : f * 3 + 7])


def test_frames_longer_than_one_run(spark):
    xs = RNG.normal(size=1500)
    df = spark.createDataFrame([(1, t, float(x)) for t, x in enumerate(xs)], "series_id long, t long, x double")
    got = {r["frame"]: r["xs"] for r in FR.frames(df, 16, 8).collect()}
    assert len(got) == (1500 - 16) // 8 + 1
    assert all(np.allclose(v, xs[f * 8 : f * 8 + 16]) for f, v in got.items())


def test_hop_longer_than_frame(series):
    got = FR.frames(series.filter("series_id = 1"), 4, 10).collect()
    assert {r["frame"] for r in got} == set(range((150 - 4) // 10 + 1))
    assert all(np.allclose(r["xs"], SERIES[1][r["frame"] * 10 :][:4]) for r in got)


def test_magnitudes_small_and_large_transform_agree(series):
    frames = FR.frames(series.filter("series_id = 1"), 32, 16)
    exact = frames.select("frame", SP.magnitudes("xs", 32).alias("m")).collect()
    fast = frames.select("frame", SP._fft_magnitude("xs").alias("m")).collect()
    a, b = ({r["frame"]: r["m"] for r in x} for x in (exact, fast))
    assert a.keys() == b.keys() and all(np.allclose(a[k], b[k]) for k in a)


def test_autocorrelation_across_blocks(series):
    kept = O.block_arrays.__defaults__
    O.block_arrays.__defaults__ = (16,)
    try:
        got = {}
        for r in SP.autocorrelation(series, 6).collect():
            got.setdefault(r["series_id"], {})[r["lag"]] = r["r"]
    finally:
        O.block_arrays.__defaults__ = kept
    for k, xs in SERIES.items():
        for lag in range(6):
            assert np.isclose(got[k][lag], np.dot(xs[: len(xs) - lag], xs[lag:]) if lag < len(xs) else 0)


def test_lagged_sums_against_loops():
    r = np.random.default_rng(5)
    whole = [r.normal(size=n) * 10.0 ** (n % 7 - 3) for n in (1, 2, 7, 64, 333, 5000)] + [np.zeros(9), np.array([1.0, np.nan, 2.0, np.inf])]
    own = [x[: max(1, len(x) * 2 // 3)] for x in whole]
    got = SP.lagged_sums(own, whole, 40)
    for row, (o, w) in enumerate(zip(own, whole)):
        for lag in range(40):
            want = sum(float(a) * float(b) for a, b in zip(o, w[lag:]))
            room = 1e-12 * (w @ w) if np.isfinite(w).all() else 0.0
            assert np.isclose(got[row, lag], want, rtol=0, atol=room, equal_nan=True)
    assert not SP.lagged_sums([np.array([1.0, 0, 0, 0])], [np.array([1.0, 0, 0, 0])], 3)[0, 1:].any()
    assert SP.lagged_sums([], [], 4).shape == (0, 4)


def test_differences_against_loops():
    r = np.random.default_rng(6)
    m = r.normal(size=(6, 150))
    m[1] = 3.0  # no lag differs
    m[2] = np.tile(m[2, :25], 6)
    m[3, 140] = np.nan
    got = SP.normalised_differences(m, 100)
    for row in range(6):
        d = [((m[row, :100] - m[row, k : k + 100]) ** 2).sum() for k in range(1, 51)]
        for k in range(1, 51):
            mean = sum(d[:k]) / k
            want = 1.0 if mean == 0 or np.isnan(mean) else d[k - 1] / mean
            assert np.isclose(got[row, k - 1], want, atol=1e-9)
    assert got[2, 24] == 0.0 and SP.normalised_differences(m[:0], 100).shape == (0, 50)


def test_pitch_both_ways(spark, monkeypatch):
    r = np.random.default_rng(7)
    df = spark.createDataFrame(
        [(k, t, float(x)) for k in (1, 2) for t, x in enumerate(r.normal(size=300))], "series_id long, t long, x double")
    rows = lambda: sorted((x.series_id, x.frame, x.f0) for x in SP.pitch(df, 1000.0, 20, 8).collect())
    small = rows()
    monkeypatch.setattr(SP, "SMALL_TRANSFORM", 0)
    assert small and small == rows()


def test_voiced_drops_nan_and_infinite(spark):
    xs = [1.0, float("nan"), 2.0, float("inf"), 0.0, -float("inf"), -1.0, 3.0]
    df = spark.createDataFrame([(1, t, x) for t, x in enumerate(xs)], "series_id long, t long, x double")
    assert [(r["t"], r["x"]) for r in SR.voiced(df).orderBy("t").collect()] == [(0, 1.0), (1, 2.0), (2, 3.0)]
    row = SR.contour_stats(df).first()
    assert (row["fo_mean"], row["fhi"], row["flo"]) == (2.0, 3.0, 1.0)


def test_peak_normalise_keeps_the_reference_vector(spark):
    xs = [0.1, -0.2, 0.5, -0.4, 0.3]
    df = spark.createDataFrame(
        [(1, t, x) for t, x in enumerate(xs)] + [(2, 0, 0.0)], "series_id long, t long, x double")
    got = arrays(FR.peak_normalise(df), "t", "x")
    assert np.isclose(got[1][2], 0.95) and np.isclose(got[1][1], -0.38)
    assert got[2] == [0.0]


def test_trim_and_longest_run(spark):
    rate = 800
    tone = np.sin(2 * np.pi * 44 * np.arange(rate) / rate)
    xs = np.concatenate([np.zeros(rate // 2), tone, np.zeros(rate // 2)])
    df = spark.createDataFrame([(1, t, float(x)) for t, x in enumerate(xs)], "series_id long, t long, x double")
    cut = FR.cut(df, FR.trim_bounds(df, 64, 16))
    assert rate <= cut.count() < 1.4 * rate
    flags = FR.frame_rms(df, 64, 16).withColumn("active", F.col("rms") > 0.3)
    row = FR.longest_active(df, flags, 64, 16).first()
    assert rate // 2 - 64 <= row["start"] <= rate // 2 and row["end"] <= 1.5 * rate + 64
    none = flags.withColumn("active", F.lit(False))
    assert FR.longest_active(df, none, 64, 16).first()["end"] == len(xs)


def test_longest_run_keeps_the_first_of_equals(spark):
    flags = [0, 1, 1, 0, 1, 1, 0]
    df = spark.createDataFrame([(1, t, bool(a)) for t, a in enumerate(flags)], "series_id long, frame long, active boolean")
    whole = spark.createDataFrame([(1, t, 0.0) for t in range(30)], "series_id long, t long, x double")
    row = FR.longest_active(whole, df, 4, 2).first()
    assert (row["start"], row["end"]) == (2, 8)


def test_pitch_of_a_tone(spark):
    rate, hz = 8000.0, 160.0
    xs = np.sin(2 * np.pi * hz * np.arange(1200) / rate)
    df = spark.createDataFrame([(1, t, float(x)) for t, x in enumerate(xs)], "series_id long, t long, x double")
    got = [r["f0"] for r in SP.pitch(df, rate, 200, 100).collect()]
    # the first lag under the limit comes just before the exact period of 50 samples
    assert got and all(150 <= f <= 185 for f in got)


def test_asof_clamps_to_first(spark):
    samples = spark.createDataFrame([(1, t) for t in (5, 10, 15, 40)], "k long, us long")
    marks = spark.createDataFrame([(1, 10, 1.0), (1, 30, 2.0)], "k long, us long, v double")
    got = SR.asof_lookup(samples, marks, ["k"], "us", ["v"], F.floor(F.col("us") / 8))
    assert sorted((r["us"], r["mark_us"], r["v"]) for r in got.collect()) == [
        (5, 10, 1.0), (10, 10, 1.0), (15, 10, 1.0), (40, 30, 2.0)]


def test_resample_keeps_linear_ramp(spark):
    df = spark.createDataFrame([(1, t, float(t)) for t in range(50)], "series_id long, t long, x double")
    got = SR.resample(df, 5, 3).orderBy("g").collect()
    assert [r["g"] for r in got] == list(range(30))
    assert np.allclose([r["x"] for r in got], [g * 5 / 3 for g in range(30)])


def test_chunks_become_one_series(spark):
    chunks = spark.createDataFrame([(1, 2, [5, 6]), (1, 1, [1, 2, 3]), (1, 9, [7])], "k long, s long, v array<long>")
    got = FR.assemble_chunks(chunks, ["k"], "s", "v").orderBy("t").collect()
    assert [(r["t"], r["x"]) for r in got] == [(0, 1), (1, 2), (2, 3), (3, 5), (4, 6), (5, 7)]


def test_windows_are_cut_into_blocks(series):
    plan = SR.jitter(series)._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "windowspecdefinition(" in line]
    assert windows
    for line in windows:
        for spec in line.split("windowspecdefinition(")[1:]:
            assert spec.split(", ")[1].startswith("_block"), spec[:80]


def test_drawn_pairs_are_read_from_arrays_and_never_broadcast(spark):
    """Short keys read their pairs from one array, longer ones join them; both give the same pairs."""
    rows = [(s, t, float((t * t * 7 + s * 3) % 101 + 1)) for s, n in ((1, 40), (2, 90), (3, 3), (4, 5000), (5, 2)) for t in range(n)]
    rows += [(None, t, float(t + 1)) for t in range(40)]
    vectors = SR.delay_vectors(spark.createDataFrame(rows, "series_id long, t long, x double"))
    near, far = SR.drawn_pairs(vectors)
    assert {r[0] for r in near.select("series_id").distinct().collect()} == {1, 2}
    assert {r[0] for r in far.select("series_id").distinct().collect()} == {4}
    got = sorted(map(tuple, SR.sampled_pairs(vectors).collect()))
    joined = [x for part in SR.drawn_pairs(vectors, reach=0) for x in part.collect()]
    assert got == sorted(map(tuple, joined)) and len(got) > 900
    x = {(s, t): v for s, t, v in rows}
    s, k, dist = got[0]
    u, w = (k + 1) * 48271 % SR._M, (k + 1) * 40692 % SR._M
    p, q = u * u % SR._M, (w * w + w) % SR._M
    i, j = ((v * 2147483648 + v * 69621 % SR._M) % 38 for v in (p, q))
    assert s == 1 and abs(dist - sum((x[s, i + d] - x[s, j + d]) ** 2 for d in range(3)) ** 0.5) < 1e-12
    plan = far._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("rightHint=(strategy=merge)") + plan.count("leftHint=(strategy=merge)") == 2
