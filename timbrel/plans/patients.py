"""Queries over patients: history, baselines, drift, fused decisions."""

from __future__ import annotations

from pyspark.sql import functions as F

from timbrel.functions import fixed
from timbrel.functions import rules as R
from timbrel.operators import patients as P
from timbrel.operators.vectors import constant_vector
from timbrel.functions.scalars import dot
from timbrel.plans.registry import query
from timbrel.plans.rules import FUSED, flat, fuse_screenings, fused_columns, metrics, trusted
from timbrel.plans.series import rounded
from timbrel.plans.sqltext import even, q
from timbrel.sources import views as V
from timbrel.sources.views import with_views

c = F.col

_COS = "(list_dot_product({a}, {b}) / ((sqrt(list_dot_product({a}, {a})) + 1e-10) * (sqrt(list_dot_product({b}, {b})) + 1e-10)))"
V.CTE["drifted"] = (("screenings_emb",), f"""
    select *, case when screening_id <> base_id then 1.0 - {_COS.format(a='embedding', b='base')} end as drift
    from (select *, first_value(embedding) over w as base, first_value(screening_id) over w as base_id
          from screenings_emb window w as (partition by patient_id order by us, screening_id))""")


def vector_screenings(spark, folder):
    return V.screenings(spark, folder, embedding=True).withColumn(
        "embedding", c("embedding").cast("array<double>")
    )


def drifted(spark, folder, df=None):
    s = vector_screenings(spark, folder) if df is None else df
    return P.with_drift(s, P.baselines(s))


@query("patient_decisions", with_views("drifted trusted", f"""
    select patient_id, screening_id, position, baseline_drift, shifted, {fused_columns('coalesce(drift, 0)')}
    from (select *, case when auth < 65 then 'spoofed' when quality < 2.5 then 'poor_quality'
            when ood > 75 then 'atypical' when band = 2 and sim_pd between 40 and 60 then 'inconclusive'
            when band = 1 and trust_level = 'High' and sim_pd > 65 then 'agree_high'
            when band = 0 and trust_level = 'High' and 100 - sim_pd > 65 then 'agree_low'
            when band = 1 and sim_pd < 35 then 'diverge_down' when band = 0 and sim_pd > 65 then 'diverge_up' else 'standard' end as rule
          from (select t.*, d.drift, {even('coalesce(d.drift, 0)', 4)} as baseline_drift, coalesce(d.drift, 0) > 0.08 as shifted,
                  row_number() over (partition by t.patient_id order by t.us, t.screening_id) as position,
                  case when t.risk_score >= 0.65 then 1 when t.risk_score <= 0.35 then 0 else 2 end as band
                from trusted t join drifted d using (screening_id)))"""))
def patient_decisions(spark, folder):
    """History in time order with drift from the personal baseline and the fused decision."""
    s = trusted(spark, folder, embedding=True).withColumn(
        "embedding", c("embedding").cast("array<double>")
    )
    # positions first, on the bare scan; then the vectors
    placed = P.timeline(
        V.screenings(spark, folder).select("patient_id", "screening_id", "us"), V.minute_block()
    ).select("screening_id", "position")
    d = drifted(spark, folder, s).drop("embedding").join(placed, "screening_id")
    fused = fuse_screenings(d, c("drift"))
    return fused.withColumn("ds", R.drift_status(c("drift"))).select(
        "patient_id", "screening_id", "position", c("ds.drift").alias("baseline_drift"),
        c("ds.shifted").alias("shifted"), *FUSED,
    )


@query("w12_patient_timeline", with_views("screenings", """
    select patient_id, screening_id, row_number() over (partition by patient_id order by us, screening_id) as position from screenings"""))
def w12(spark, folder):
    s = V.screenings(spark, folder).select("patient_id", "screening_id", "us")
    return P.timeline(s, V.minute_block()).select("patient_id", "screening_id", "position")


@query("w13_baseline_drift", with_views("drifted", f"""
    select patient_id, screening_id, {even('coalesce(drift, 0)', 4)} as drift, coalesce(drift, 0) > 0.08 as shifted,
      case when coalesce(drift, 0) > 0.08 then {q(fixed.DRIFT_SHIFT)} else {q(fixed.DRIFT_STABLE)} end as status from drifted"""))
def w13(spark, folder):
    return drifted(spark, folder).withColumn("s", R.drift_status(c("drift"))).select(
        "patient_id", "screening_id", *flat("s", "drift", "shifted", "status")
    )


@query("w14_newest_ten", with_views("screenings", """
    select patient_id, screening_id, rank from (select *, row_number() over (partition by patient_id order by us desc, screening_id desc) as rank from screenings) where rank <= 10"""))
def w14(spark, folder):
    s = V.screenings(spark, folder).select("patient_id", "screening_id", "us")
    return P.newest(s, 10, "patient_id", ["us", "screening_id"]).drop("us")


D = 64
import math  # noqa: E402

LOADINGS = [[math.cos(i * 0.1) for i in range(D)], [math.sin(i * 0.1) for i in range(D)]]
_LOAD = ["[" + ", ".join(repr(v) + "::double" for v in row) + "]" for row in LOADINGS]


@query("w18_digital_twin_path", with_views("screenings_emb", f"""
    select patient_id, screening_id, row_number() over (partition by patient_id order by us, screening_id) as position,
      round(list_dot_product(embedding, {_LOAD[0]}), 6) as x, round(list_dot_product(embedding, {_LOAD[1]}), 6) as y from screenings_emb"""))
def w18(spark, folder):
    s = vector_screenings(spark, folder).select(
        "patient_id", "screening_id", "us",
        dot(c("embedding"), constant_vector(LOADINGS[0])).alias("x"),
        dot(c("embedding"), constant_vector(LOADINGS[1])).alias("y"),
    )
    return rounded(P.timeline(s, V.minute_block()).drop("us"))


@query("p1_baseline_lookup", with_views("screenings_emb", """
    select patient_id, screening_id as baseline_id, round(list_sum(embedding), 6) as checksum from screenings_emb
    where patient_id = 7 order by us, screening_id limit 1"""))
def p1(spark, folder):
    s = vector_screenings(spark, folder).filter(c("patient_id") == 7)
    return P.baselines(s).select(
        "patient_id", "baseline_id",
        F.round(F.aggregate("baseline", F.lit(0.0), lambda a, v: a + v), 6).alias("checksum"),
    )


@query("p2_history_projection", """
    select user_id as patient_id, event_id as screening_id, least(value, 100.0) / 100.0 as risk_score,
      json_extract_string(props, '$.k')::bigint as k from events""")
def p2(spark, folder):
    return V.table(spark, folder, "events").select(
        c("user_id").alias("patient_id"), c("event_id").alias("screening_id"),
        (F.least("value", F.lit(100.0)) / 100.0).alias("risk_score"),
        F.from_json("props", "k bigint")["k"].alias("k"),
    )


@query("p8_default_fill", with_views("screenings", """
    select s.screening_id, coalesce(t.score, 50.0) as trust_score, coalesce(t.level, 'Medium') as trust_level,
      coalesce(qa.quality, 4.0) as quality, coalesce(o.ood, 10.0) as ood, coalesce(m.sim_pd, 50.0) as sim_pd,
      coalesce(100 - m.sim_pd, 50.0) as sim_healthy, coalesce(a.auth, 100.0) as auth
    from screenings s
    left join (select screening_id, ood as score, 'Low' as level from screenings where k % 2 = 0) t using (screening_id)
    left join (select screening_id, quality from screenings where k % 3 = 0) qa using (screening_id)
    left join (select screening_id, ood from screenings where k % 5 = 0) o using (screening_id)
    left join (select screening_id, sim_pd from screenings where k % 7 = 0) m using (screening_id)
    left join (select screening_id, auth from screenings where k % 11 = 0) a using (screening_id)"""))
def p8(spark, folder):
    # fixed values: what stands in for a missing audit
    s = V.screenings(spark, folder)
    k = c("k")
    parts = [
        s.filter(k % 2 == 0).select("screening_id", F.struct(
            c("ood").alias("score"), F.lit("Low").alias("level")).alias("t")),
        s.filter(k % 3 == 0).select("screening_id", F.struct("quality").alias("qa")),
        s.filter(k % 5 == 0).select("screening_id", F.struct("ood").alias("o")),
        s.filter(k % 7 == 0).select("screening_id", F.struct("sim_pd").alias("m")),
        s.filter(k % 11 == 0).select("screening_id", F.struct("auth").alias("a")),
    ]
    out = s.select("screening_id")
    for part in parts:
        out = out.join(part, "screening_id", "left")
    return out.select(
        "screening_id",
        F.coalesce("t.score", F.lit(50.0)).alias("trust_score"),
        F.coalesce("t.level", F.lit("Medium")).alias("trust_level"),
        F.coalesce("qa.quality", F.lit(4.0)).alias("quality"),
        F.coalesce("o.ood", F.lit(10.0)).alias("ood"),
        F.coalesce("m.sim_pd", F.lit(50.0)).alias("sim_pd"),
        F.coalesce(100 - c("m.sim_pd"), F.lit(50.0)).alias("sim_healthy"),
        F.coalesce("a.auth", F.lit(100.0)).alias("auth"),
    )


@query("p9_clinical_projection", with_views("metrics", """
    select screening_id, fo_mean, fhi, flo, jitter_pct, jitter_abs, shimmer_local, shimmer_db, hnr, nhr, energy,
      fo_mean * 3 + fhi * 2 + flo as formant_check from metrics"""))
def p9(spark, folder):
    source = metrics(spark, folder).select(
        "screening_id",
        *[c(n).alias(raw) for n, raw in CLINICAL.items()],
        (c("fo_mean") * 3).alias("F1"), (c("fhi") * 2).alias("F2"), c("flo").alias("F3"),
    )
    out = source.select(
        "screening_id", *[c(f"`{raw}`").alias(n) for n, raw in CLINICAL.items()],
        F.array("F1", "F2", "F3").alias("formants"),
    )
    return out.select(
        "screening_id", *CLINICAL,
        F.aggregate("formants", F.lit(0.0), lambda a, v: a + v).alias("formant_check"),
    )


# fixed values: report name -> feature column
CLINICAL = {
    "fo_mean": "MDVP:Fo(Hz)", "fhi": "MDVP:Fhi(Hz)", "flo": "MDVP:Flo(Hz)",
    "jitter_pct": "MDVP:Jitter(%)", "jitter_abs": "MDVP:Jitter(Abs)",
    "shimmer_local": "MDVP:Shimmer", "shimmer_db": "MDVP:Shimmer(dB)", "hnr": "HNR",
    "nhr": "NHR", "energy": "Energy",
}


@query("j1_screening_baseline_join", with_views("screenings_emb", f"""
    select s.screening_id, b.base is not null as has_baseline, {even("coalesce(1.0 - " + _COS.format(a='s.embedding', b='b.base') + ", 0)", 4)} as drift
    from screenings_emb s left join (
      select patient_id, arg_min(embedding, (us, screening_id)) as base from screenings_emb where patient_id % 2 = 0 group by patient_id) b using (patient_id)"""))
def j1(spark, folder):
    s = vector_screenings(spark, folder)
    base = P.baselines(s.filter(c("patient_id") % 2 == 0)).select("patient_id", "baseline")
    marked = base.withColumn("has", F.lit(True))
    out = P.with_drift(s, marked.drop("has"))
    return out.select(
        "screening_id", c("drift").isNotNull().alias("has_baseline"),
        R.drift_status(c("drift"))["drift"].alias("drift"),
    )


@query("s8_last_wins_upsert", """
    select screening_id, event_id, value from (select event_id // 2 as screening_id, event_id, value,
      row_number() over (partition by event_id // 2 order by ts desc, event_id desc) as rn from events) where rn = 1""")
def s8(spark, folder):
    e = V.table(spark, folder, "events").select(
        F.floor(c("event_id") / 2).alias("screening_id"), "event_id", V.micros("ts").alias("us"),
        "value",
    )
    stored, arriving = e.filter("event_id % 3 <> 0"), e.filter("event_id % 3 = 0")
    return P.last_wins(stored.unionByName(arriving), order=["us", "event_id"]).drop("us")


@query("s9_first_wins_baseline", with_views("screenings_emb", """
    select patient_id, round(list_sum(b), 6) as checksum from (
      select patient_id, arg_max(embedding, (us, screening_id)) as b from screenings_emb where patient_id % 3 = 0 group by patient_id
      union all
      select patient_id, arg_min(embedding, (us, screening_id)) from screenings_emb where patient_id % 3 <> 0 group by patient_id)"""))
def s9(spark, folder):
    s = vector_screenings(spark, folder)
    stored = s.filter(c("patient_id") % 3 == 0).groupBy("patient_id").agg(
        F.max_by("embedding", F.struct("us", "screening_id")).alias("baseline")
    )
    return P.first_wins(stored, s).select(
        "patient_id",
        F.round(F.aggregate("baseline", F.lit(0.0), lambda a, v: a + v), 6).alias("checksum"),
    )


@query("a26_history_count", with_views("screenings", """
    select patient_id, count(*) as total_screenings from screenings group by patient_id"""))
def a26(spark, folder):
    return V.screenings(spark, folder).groupBy("patient_id").agg(
        F.count(F.lit(1)).alias("total_screenings")
    )


@query("j11_audit_fusion", with_views("trusted", """
    select screening_id, risk_score, quality, ood, sim_pd, auth, trust_score, trust_level from trusted"""))
def j11(spark, folder):
    """Audit tables keyed by screening, joined on that one key."""
    t = trusted(spark, folder)
    tables = [
        t.select("screening_id", "quality"), t.select("screening_id", "ood"),
        t.select("screening_id", "sim_pd"), t.select("screening_id", "auth"),
        t.select("screening_id", c("tr.score").alias("trust_score"),
                 c("tr.level").alias("trust_level")),
    ]
    out = t.select("screening_id", "risk_score")
    for audit in tables:
        out = out.join(audit, "screening_id")
    return out
