"""Scans, sinks, token bucket and stream state on small inputs."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from timbrel.functions import fixed
from timbrel.sources import tables as TB
from timbrel.streaming import admission as AD
from timbrel.streaming import jobs as J


def test_feature_scan_needs_its_columns(spark, tmp_path):
    good = str(tmp_path / "good.csv")
    header = ["name", *fixed.VOICE_FEATURES, "status"]
    with open(good, "w") as f:
        f.write(",".join(header) + "\n" + ",".join(["r_1", *["0.5"] * 22, "1"]) + "\n")
    row = TB.read_features(spark, good).first()
    assert (row["name"], row["fo_mean"], row["jitter_pct"], row["status"]) == ("r_1", 0.5, 50.0, 1)
    bad = str(tmp_path / "bad.csv")
    with open(bad, "w") as f:
        f.write("name,status\nx,1\n")
    with pytest.raises(ValueError, match="PPE"):
        TB.read_features(spark, bad)


def test_labelled_folders(spark, tmp_path):
    for name in ("healthy/a.wav", "parkinsons/b.MP3", "parkinsons/c.txt", "other/d.wav"):
        os.makedirs(tmp_path / os.path.dirname(name), exist_ok=True)
        (tmp_path / name).write_bytes(b"x")
    got = {os.path.basename(r["path"]): r["label"] for r in TB.labelled_files(spark, str(tmp_path)).collect()}
    assert got == {"a.wav": 0, "b.MP3": 1}
    none = TB.labelled_files(spark, str(tmp_path / "absent"))
    assert none.count() == 0 and none.columns == ["path", "modificationTime", "length", "label"]


def test_cache_computes_once(spark, tmp_path):
    calls = []

    def compute():
        calls.append(1)
        return spark.range(3)

    path = str(tmp_path / "cache")
    for _ in range(2):
        assert TB.compute_or_reuse(spark, path, compute).count() == 3
    assert calls == [1]


def test_missing_points_are_empty(spark, tmp_path):
    assert TB.read_points(spark, str(tmp_path / "none.csv")).count() == 0


def test_retention(spark):
    df = spark.createDataFrame([("u/a.wav", 0), ("u/.keep", 0), ("u/b.wav", 3_000_000_000)], "path string, us long")
    got = TB.expired(df, 3_700_000_000, F.col("us")).collect()
    assert [(r["path"], r["age_seconds"]) for r in got] == [("u/a.wav", 3700.0)]


def by_loop(rows, rate, capacity):
    state, out = {}, {}
    for client, us, ident in sorted(rows):
        if client not in state:
            ok, tokens = True, capacity
        else:
            ok, tokens = AD.take(state[client][0], (us - state[client][1]) / 1e6, rate, capacity)
        state[client] = (tokens, us)
        out[ident] = ok
    return out


def bursts():
    """A burst, long pauses that refill the bucket, and a steady overload."""
    rows, ident = [], 0
    for client, times in {
        1: [i * 1000 for i in range(20)],
        2: [*range(0, 20_000_000, 1_000_000), *range(200_000_000, 230_000_000, 500_000)],
        3: [0, 61_000_000, 61_000_001, 500_000_000],
    }.items():
        for t in times:
            rows.append((client, t, ident))
            ident += 1
    return rows


def test_token_bucket_burst_admits_eleven(spark):
    df = spark.createDataFrame(bursts(), "client long, us long, event_id long")
    got = {r["event_id"]: r["admitted"] for r in AD.admit(df, 10 / 60, 10.0, F.floor(F.col("us") / 5_000_000)).collect()}
    assert got == by_loop(bursts(), 10 / 60, 10.0)
    assert sum(got[i] for i in range(20)) == 11


def stream_of(spark, path, batches, schema):
    """A stream whose micro-batches are the given row lists."""
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{path}/b{i}")
    return (
        spark.readStream.schema(schema).option("maxFilesPerTrigger", 1)
        .option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").parquet(path)
    )


def test_token_bucket_state_survives_batches(spark, tmp_path):
    rows = sorted(bursts(), key=lambda r: r[1])
    half = len(rows) // 2
    stream = stream_of(spark, str(tmp_path), [rows[:half], rows[half:]], "client long, us long, event_id long")
    got = J.run(AD.admit_stream(stream, 10 / 60, 10.0), "append", "bucket").collect()
    assert {r["event_id"]: r["admitted"] for r in got} == by_loop(bursts(), 10 / 60, 10.0)
    assert len({r["batch"] for r in got}) == 2


def test_baseline_state_survives_batches(spark, tmp_path):
    a, b = [1.0, 0.0], [0.0, 1.0]
    schema = "patient_id long, screening_id long, us long, embedding array<double>"
    stream = stream_of(spark, str(tmp_path), [[(1, 1, 5, a)], [(1, 2, 6, b), (2, 3, 6, b)]], schema)
    got = {r["screening_id"]: (round(r["drift"], 6), r["is_first"]) for r in J.run(J.drift_stream(stream), "append", "drift").collect()}
    assert got == {1: (0.0, True), 2: (1.0, False), 3: (0.0, True)}


def test_upsert_keeps_the_newest_of_all_batches(spark, tmp_path):
    schema = "id long, us long, v string"
    stream = stream_of(spark, str(tmp_path), [[(1, 5, "new"), (2, 1, "x")], [(1, 4, "old"), (2, 2, "y")]], schema)
    got = {r["id"]: r["v"] for r in J.upsert_stream(stream, "upsert", "id", ["us"]).collect()}
    assert got == {1: "new", 2: "y"}


def test_sticky_flag_and_windows(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    schema = "client long, ts timestamp, us long, x double"
    rows = [(1, t0 + dt.timedelta(seconds=s), s * 1_000_000, v) for s, v in ((0, 0.3), (1, 0.4), (7, 0.0), (20, 0.1))]
    stream = stream_of(spark, str(tmp_path), [rows[:2], rows[2:]], schema)
    flags = J.latest(J.run(J.sticky_flag(stream, F.col("x") >= 0.4), "update", "flags"), ["client"]).first()
    assert flags["seen"] and flags["n"] == 4
    levels = J.latest(J.run(J.window_levels(stream, F.col("x"), "2 seconds"), "update", "w"), ["client", "start_us"])
    batch = J.window_levels(spark.createDataFrame(rows, schema), F.col("x"), "2 seconds")
    key = ["client", "start_us", "n", "level", "warn"]
    assert sorted(levels.select(key).collect()) == sorted(batch.select(key).collect())


def test_sessions_split_at_the_cap(spark):
    rows = [(1, s * 1_000_000, s) for s in (*range(0, 75, 1), 200, 205, 212)]
    df = spark.createDataFrame(rows, "client long, us long, event_id long")
    got = J.split_sessions(J.sessions(df, 30, F.floor(F.col("us") / 10_000_000)), "client", 10, 30)
    assert sorted((r["start_us"] // 1_000_000, r["seconds"]) for r in got.collect()) == [
        (0, 30.0), (30, 30.0), (60, 14.0), (200, 12.0)]
