"""Queries that run streams to the end of their input, and their batch twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from timbrel.functions import rules as R
from timbrel.operators import patients as P
from timbrel.plans.patients import vector_screenings
from timbrel.plans.registry import SQL, query
from timbrel.plans.rules import FUSED, fuse_screenings, fused_columns
from timbrel.plans.series import rounded
from timbrel.plans.sqltext import even
from timbrel.sources import views as V
from timbrel.sources.views import with_views
from timbrel.streaming import admission as AD
from timbrel.streaming import jobs as J

c = F.col
# one request in 20 hours on average, ten at once
RATE, CAPACITY = 1 / 72000, 10.0

_ADMIT = with_views("requests", """
    select client, event_id, ok as admitted from fold""", f"""
    seq as (select client, event_id, us, row_number() over (partition by client order by us, event_id) - 1 as t from requests),
    fold as (select client, event_id, us, t, true as ok, {CAPACITY}::double as tokens from seq where t = 0
      union all
      select s.client, s.event_id, s.us, s.t, x.v >= 1.0, case when x.v >= 1.0 then x.v - 1.0 else x.v end
      from fold f join seq s on s.client = f.client and s.t = f.t + 1,
        lateral (select least({CAPACITY}::double, f.tokens + ((s.us - f.us) / 1e6) * {RATE!r}::double) as v) x)""").replace("with ", "with recursive ", 1)


def requests_stream(spark, folder):
    e = J.read_events(spark, folder)
    return e.select(
        "event_id", c("user_id").alias("client"), "ts", "us",
        F.when(c("event_type") == "error", 429).otherwise(200).alias("status"),
        (c("value") / 1000).alias("duration"),
    )


@query("t1_token_bucket", _ADMIT)
def t1(spark, folder):
    return AD.admit(V.requests(spark, folder), RATE, CAPACITY, V.minute_block())


@query("t1_token_bucket_stream", _ADMIT)
def t1s(spark, folder):
    r = requests_stream(spark, folder).select("client", "us", "event_id")
    return J.run(AD.admit_stream(r, RATE, CAPACITY), "append", "admitted").drop("batch")


_WIN = """select client, epoch_us(start) as start_us, count(*) as n, round(sqrt(avg(duration * duration)), 6) as level,
    sqrt(avg(duration * duration)) > 0.05 as warn from ({src}) group by client, start"""
_SLIDE = """select client, duration, start from requests, unnest([time_bucket(interval '20 minutes', ts, timestamp '1970-01-01') - interval '20 minutes' * i for i in range(3)]) u(start)
    where ts >= start and ts < start + interval '50 minutes'"""


def _windows(spark, folder, size, slide=None):
    rows = J.run(
        J.window_levels(requests_stream(spark, folder), c("duration"), size, slide),
        "update", "windows")
    return rounded(J.latest(rows, ["client", "start_us"]))


@query("t2_sliding_windows", with_views("requests", _WIN.format(src=_SLIDE)))
def t2(spark, folder):
    return _windows(spark, folder, "50 minutes", "20 minutes")


@query("t3_tumbling_windows", with_views("requests", _WIN.format(
    src="select client, duration, time_bucket(interval '2 hours', ts, timestamp '1970-01-01') as start from requests")))
def t3(spark, folder):
    return _windows(spark, folder, "2 hours")


# activity: pauses of 6 h close a session; pieces of 10 h to 30 h count
GAP, SHORT, CAP = 6 * 3600, 10 * 3600, 30 * 3600
_SESSIONS = with_views("requests", f"""
    select client, first_us + i * {CAP * 1000000} as start_us, least({CAP * 1000000}, last_us - (first_us + i * {CAP * 1000000})) / 1e6 as seconds
    from ses, unnest(range((last_us - first_us) // {CAP * 1000000} + 1)) u(i)
    where least({CAP * 1000000}, last_us - (first_us + i * {CAP * 1000000})) / 1e6 >= {SHORT}""", f"""
    op as (select client, us, coalesce(us - lag(us) over (partition by client order by us) >= {GAP * 1000000}, true)::int as o from requests),
    ses as (select client, min(us) as first_us, max(us) as last_us from (select *, sum(o) over (partition by client order by us) as s from op) group by client, s)""")


@query("t4_activity_sessions", _SESSIONS)
def t4(spark, folder):
    s = J.sessions(V.requests(spark, folder), GAP, V.minute_block())
    return J.split_sessions(s, "client", SHORT, CAP)


@query("t4_activity_sessions_stream", _SESSIONS)
def t4s(spark, folder):
    # complete mode also reports the sessions that are still open at the end of the input
    rows = J.run(
        J.session_stream(requests_stream(spark, folder), f"{GAP} seconds"), "complete", "sessions")
    newest = J.latest(rows, ["client", "first_us"])
    return J.split_sessions(newest, "client", SHORT, CAP)


def screening_stream(spark, folder):
    """Arriving screenings with their vector by a stream-static join."""
    vectors = V.table(spark, folder, "embeddings").select(
        "vec_id", c("embedding").cast("array<double>").alias("embedding"))
    n = vectors.count()
    return J.read_events(spark, folder).select(
        c("event_id").alias("screening_id"), c("user_id").alias("patient_id"), "us", "value",
        "props", (c("event_id") % n).alias("vec_id"),
    ).join(vectors, "vec_id")


@query("t5_first_value_drift_stream", with_views("drifted", f"""
    select patient_id, screening_id, {even('coalesce(drift, 0)', 4)} as drift, drift is null as is_first from drifted"""))
def t5(spark, folder):
    s = screening_stream(spark, folder).select("patient_id", "screening_id", "us", "embedding")
    out = J.run(J.drift_stream(s), "append", "drift")
    return out.select(
        "patient_id", "screening_id", R.drift_status(c("drift"))["drift"].alias("drift"),
        "is_first")


@query("t6_upsert_stream", SQL["s8_last_wins_upsert"])
def t6(spark, folder):
    e = J.read_events(spark, folder).select(
        F.floor(c("event_id") / 2).alias("screening_id"), "event_id", "us", "value")
    return J.upsert_stream(e, "upsert", "screening_id", ["us", "event_id"]).drop("us")


@query("t7_sticky_flag_stream", with_views("requests", """
    select client, max(duration) >= 0.3 as seen, count(*) as n from requests group by client"""))
def t7(spark, folder):
    flags = J.sticky_flag(requests_stream(spark, folder), c("duration") >= 0.3)
    return J.latest(J.run(flags, "update", "flags"), ["client"])


@query("t8_expiry_stream")
def t8(spark, folder):
    """Each id once; ids older than an hour are forgotten."""
    r = requests_stream(spark, folder).select("event_id", "client", "ts", "us")
    return J.run(J.unique_within(r, "event_id"), "append", "unique").select(
        "event_id", "client", "us")


@query("t9_streaming_screening", with_views("drifted trusted", f"""
    select patient_id, screening_id, baseline_drift, {fused_columns('coalesce(drift, 0)')}
    from (select t.*, d.drift, {even('coalesce(d.drift, 0)', 4)} as baseline_drift from ruled t join drifted d using (screening_id))""",
    "ruled as (select *, " + """case when auth < 65 then 'spoofed' when quality < 2.5 then 'poor_quality'
            when ood > 75 then 'atypical' when band = 2 and sim_pd between 40 and 60 then 'inconclusive'
            when band = 1 and trust_level = 'High' and sim_pd > 65 then 'agree_high'
            when band = 0 and trust_level = 'High' and 100 - sim_pd > 65 then 'agree_low'
            when band = 1 and sim_pd < 35 then 'diverge_down' when band = 0 and sim_pd > 65 then 'diverge_up' else 'standard' end as rule
      from (select *, case when risk_score >= 0.65 then 1 when risk_score <= 0.35 then 0 else 2 end as band from trusted))"""))
def t9(spark, folder):
    arriving = V.audits(screening_stream(spark, folder).withColumn(
        "risk_score", F.least("value", F.lit(100.0)) / 100.0).withColumn("k", V.json_k()))
    stored = P.baselines(vector_screenings(spark, folder))

    def decide(df):
        trusted = df.withColumn(
            "tr", R.trust(c("risk_score"), c("quality"), c("ood"), c("sim_pd"), c("auth")))
        return fuse_screenings(trusted, c("drift")).select(
            "patient_id", "screening_id", R.drift_status(c("drift"))["drift"]
            .alias("baseline_drift"), *FUSED)

    return J.run(J.screen_stream(arriving, stored, decide), "append", "screened").drop("batch")
