"""Null keys, times and values, NaN samples, table folders, late files, and counts beyond 64 bits."""

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from timbrel import session as S
from timbrel.operators import frames as FR
from timbrel.operators import metrics as ME
from timbrel.operators import ordered as O
from timbrel.operators import series as SR
from timbrel.streaming import jobs as J
from tools.check import TABLES, compare

NAN = float("nan")


def test_prefix_keeps_null_keys_and_times(spark):
    rows = [("a", 1, 5), ("a", None, 7), (None, 3, 2), (None, 200000, 4), (None, None, 1), ("b", 0, None)]
    df = spark.createDataFrame(rows, "k string, t long, x long")
    got = O.prefix(df, ["k"], O.position_block("t"), ["t"], sums={"s": F.col("x")}, maxima={"m": F.col("x")})
    want = duckdb.connect().execute("""
        select k, t, x, coalesce(sum(x) over w, 0)::bigint, max(x) over w
        from (values ('a', 1, 5), ('a', null, 7), (null, 3, 2), (null, 200000, 4), (null, null, 1), ('b', 0, null)) r(k, t, x)
        window w as (partition by k order by t nulls first rows unbounded preceding)""").fetchall()
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key)
    assert O.dense_index(df, ["k"], O.position_block("t"), ["t"]).count() == len(rows)


def test_statistics_keep_null_keys(spark):
    df = spark.createDataFrame([("a", 1.0), (None, 2.0), (None, 4.0)], "k string, x double")
    got = {(r.k, r.x): r.m for r in O.with_stats(df, ["k"], {"m": F.avg("x")}).collect()}
    assert got == {("a", 1.0): 1.0, (None, 2.0): 3.0, (None, 4.0): 3.0}
    silent = spark.createDataFrame([(1, 0, 0.5), (1, 1, -0.25), (None, 0, 0.1)], "series_id long, t long, x double")
    assert FR.peak_normalise(silent).count() == 3


def test_quantiles_do_not_count_nulls_and_nans(spark):
    rows = [(1, float(i)) for i in range(10)] + [(1, None)] * 10 + [(1, NAN)] * 3 + [(2, None), (None, 7.0)]
    df = spark.createDataFrame(rows, "k long, x double")
    got = {r.k: r.median for r in O.quantiles(df, ["k"], "x", {"median": 0.5}).collect()}
    assert got == {1: 4.5, 2: None, None: 7.0}


@pytest.mark.parametrize("measure", [SR.spread, SR.period_entropy, SR.correlation_dimension, SR.contour_stats])
def test_nan_and_infinity_are_unvoiced(spark, measure):
    xs = [100 + 7 * (i % 5) + i * 0.1 for i in range(80)]
    spoilt = [v for x in xs for v in (x, *([NAN, float("inf"), 0.0] if int(x) % 4 == 0 else []))]
    frame = lambda v: spark.createDataFrame([(1, t, x) for t, x in enumerate(v)], "series_id long, t long, x double")
    a, b = measure(frame(xs)).first(), measure(frame(spoilt)).first()
    assert a.asDict() == pytest.approx(b.asDict())


def test_areas_of_billions_of_rows(spark):
    scored = spark.createDataFrame([(0.25, 0, 4_000_000_000), (0.75, 4_000_000_000, 0)], "p double, pos long, neg long").withColumn("_range", F.lit(0))

    class Sums:
        by = staticmethod(lambda df, keys: df)

    kept, ME._by_score = ME._by_score, Sums.by
    try:
        assert ME.roc_auc(scored).first().roc_auc == 1.0
        assert ME.average_precision(scored).first().pr_auc == pytest.approx(1.0)
    finally:
        ME._by_score = kept


@pytest.mark.parametrize("values", ["id + 0.5", "id * 1e-11", "if(id = 0, 1e15, id)", "pow(10.0, id % 300)"])
def test_blocks_stay_even_whatever_the_values(spark, values):
    df = spark.range(200_000).selectExpr("1 as k", f"cast({values} as double) as x").union(
        spark.createDataFrame([(2, 1.0), (2, 2.0), (None, 5.0)], "k int, x double")).distinct()
    blocks = O.value_blocks(df, ["k"], "x", per_block=1000)
    sizes = blocks.groupBy("k", "_block").agg(F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"))
    rows = sorted((r for r in sizes.collect() if r.k == 1), key=lambda r: r._block)
    assert max(r.n for r in rows) <= 1000
    assert all(a.hi < b.lo for a, b in zip(rows, rows[1:]))
    assert blocks.count() == df.count()


def test_a_cluster_must_name_its_shared_folder(spark, monkeypatch):
    class Conf:
        get = staticmethod(lambda *a: None)

    class Context:
        master = "spark://host:7077"
        getCheckpointDir = staticmethod(lambda: None)
        getConf = staticmethod(lambda: Conf)

    class Cluster:
        sparkContext, conf = Context, Conf

    with pytest.raises(ValueError, match="checkpoint"):
        S.checkpoint_folder(Cluster)


@pytest.fixture(scope="module")
def parts(spark, folder, tmp_path_factory):
    """The tables with ``events`` as a folder of part files, the newest first."""
    out = tmp_path_factory.mktemp("tables")
    for t in TABLES:
        if t != "events":
            (out / f"{t}.parquet").symlink_to(f"{folder}/{t}.parquet")
    events = spark.read.parquet(f"{folder}/events.parquet")
    cuts = [r.ts for r in events.selectExpr("explode(array(percentile_approx(cast(ts as timestamp), 0.33), percentile_approx(cast(ts as timestamp), 0.66))) as ts").collect()]
    ts = F.col("ts").cast("timestamp")
    for part in (ts > cuts[1], (ts > cuts[0]) & (ts <= cuts[1]), ts <= cuts[0]):
        events.filter(part).coalesce(1).write.mode("append").parquet(str(out / "events.parquet"))
    return str(out)


@pytest.mark.parametrize("name", ["t1_token_bucket_stream", "t2_sliding_windows", "t3_tumbling_windows", "t4_activity_sessions_stream",
                                  "t6_upsert_stream", "t7_sticky_flag_stream", "t9_streaming_screening"])
def test_streams_read_folders_and_keep_late_files(spark, parts, folder, name, monkeypatch):
    if name != "t1_token_bucket_stream":  # admission is in order of arrival
        monkeypatch.setattr(J, "FILES_PER_TRIGGER", 1)
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    _, ok, note = compare(entry.queries()[name](spark, parts), con, entry.oracle_sql()[name])
    assert ok, note
