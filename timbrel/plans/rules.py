"""Queries of the rule cascades and scalar functions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timbrel.functions import fixed
from timbrel.functions import rules as R
from timbrel.functions import scalars as S
from timbrel.operators.vectors import constant_vector
from timbrel.plans.registry import query
from timbrel.plans.sqltext import case, even, join_reasons, q, rungs
from timbrel.sources import views as V
from timbrel.sources.views import with_views

c = F.col


def flat(struct: str, *names: str):
    return [c(f"{struct}.{n}").alias(n) for n in names]


def joined(name: str, sep: str = "|"):
    return F.array_join(c(name), sep).alias(name.split(".")[-1])


# --- view: clinical metrics per screening --------------------------------------------------
METRICS = {
    "fo_mean": "60 + k * 3.0", "fhi": "80 + k * 3.0", "flo": "50 + k * 2.0",
    "jitter_pct": "k * 0.03", "jitter_abs": "k * 0.00001", "shimmer_local": "k * 0.001",
    "shimmer_db": "k * 0.01", "hnr": "k * 0.4", "nhr": "k * 0.005", "energy": "k * 0.01",
}


def metrics(spark, folder) -> DataFrame:
    return V.screenings(spark, folder).select(
        "*", *[F.expr(f"cast({e}D as double)").alias(n) for n, e in METRICS.items()]
    )


V.CTE["metrics"] = (
    ("screenings",),
    "select *, " + ", ".join(f"({e.replace('k *', 'k::double *')})::double as {n}"
                             for n, e in METRICS.items()) + " from screenings",
)

# --- view: five strongest attributions per vector with labels and a risk --------------------
LABELS = list(fixed.FEATURE_LABELS.values())


def label_of(i):
    return F.element_at(F.array(*[F.lit(x) for x in LABELS]), (i % len(LABELS) + 1).cast("int"))


def top_attributions(spark, folder) -> DataFrame:
    """(vec_id, risk, top): strongest attributions by magnitude, sorted inside the row."""
    means = V.vec_long(spark, folder).groupBy("i").agg(F.avg("v").alias("m")).orderBy("i")
    # one number per dimension; everything else stays inside the row
    mean = constant_vector([r.m for r in means.collect()])

    def term(v, i):
        value = F.round(v.cast("double") - F.get(mean, i), 9)
        return F.struct((-F.abs(value)).alias("o"), i.cast("long").alias("i"), value.alias("value"))

    per_row = V.refs(spark, folder).select(
        "vec_id", F.array_sort(F.transform("embedding", term)).alias("all"))
    return per_row.select(
        "vec_id",
        ((c("vec_id") * 37 % 100) / 100.0).alias("risk"),
        F.transform(
            F.slice("all", 1, 5),
            lambda a: F.struct(label_of(a["i"]).alias("label"), a["value"].alias("value"),
                               a["i"].alias("i")),
        ).alias("top"),
    )


_LABEL_SQL = "([" + ", ".join(q(x) for x in LABELS) + f"])[i % {len(LABELS)} + 1]"
V.CTE["top_attr"] = (
    ("attributions",),
    f"""select vec_id, i, value, {_LABEL_SQL} as label,
               row_number() over (partition by vec_id order by abs(value) desc, i) as rk,
               (vec_id * 37 % 100) / 100.0::double as risk
        from attributions qualify rk <= 5""",
)


# --- rules ------------------------------------------------------------------------------------
_POINTS = (
    "(" + rungs("snr", [(25, 30), (15, 20), (8, 10)], 2)
    + " + " + rungs("coverage", [(60, 25), (40, 18), (20, 10)], 2)
    + " + " + rungs("duration", [(10, 20), (5, 12), (2, 6)], 1)
    + " + case when noise <= 10 then 15 when noise <= 25 then 10 when noise <= 50 then 5 else 1 end"
    + " + case when clipped then 0 else 10 end)"
)


@query("r1_recording_quality", with_views("screenings", f"""
    select screening_id, score::bigint as score, repeat('★', score) || repeat('☆', 5 - score) as stars,
           score >= 2 as suitable,
           case when score <= 2 then {q(fixed.QUALITY_WARNING)} end as warning
    from scored""", f"scored as (select *, {rungs('points', [(85, 5), (65, 4), (45, 3), (25, 2)], 1)} as score from (select *, {_POINTS} as points from screenings))"))
def r1(spark, folder):
    s = V.screenings(spark, folder)
    return s.select(
        "screening_id",
        R.recording_quality(c("snr"), c("coverage"), c("duration"), c("noise"), c("clipped"))
        .alias("r"),
    ).select("screening_id", *flat("r", "score", "stars", "suitable", "warning"))


@query("r2_microphone_status", with_views("screenings", """
    select screening_id,
           case when k / 30000.0 < 0.001 then 'No Signal' when clipped then 'Clipping Detected'
                when snr < 10 then 'Noisy' else 'Good' end as mic_status
    from screenings"""))
def r2(spark, folder):
    return V.screenings(spark, folder).select(
        "screening_id",
        R.microphone_status(c("k") / 30000.0, c("clipped"), c("snr")).alias("mic_status"),
    )


V.CTE["auth_inputs"] = (("screenings",), """
    select screening_id, k / 50000.0::double as clip_ratio, (k * 37 % 4000)::double as bandwidth,
           (k * 53 % 5000)::double as rolloff, k / 100000.0::double as flatness,
           (k * 3)::double as f0_std, k % 25 as n_voiced, k = 99 as silent
    from screenings""")


@query("r3_authenticity", with_views("auth_inputs", f"""
    select screening_id, {even('score', 1)} as score,
           case when score > 85 or score < 40 then 'High' else 'Moderate' end as confidence,
           score >= 65 as is_authentic,
           case when silent then {q(fixed.AUTH_SILENT)} else {join_reasons([
               ("clip_ratio > 0.001", "'Digital saturation clipping detected (' || printf('%.2f', clip_ratio * 100) || '% clipped).'"),
               ("bandwidth < 1500", q(fixed.AUTH_NARROW)),
               ("rolloff < 2500 and flatness < 0.0005", q(fixed.AUTH_REPLAY)),
               ("n_voiced > 10 and f0_std < 4", q(fixed.AUTH_MONOTONE)),
               ("n_voiced > 10 and f0_std > 120", q(fixed.AUTH_UNSTABLE))], '|')} end as warnings
    from (select *, case when silent then 0.0 else greatest(0.0, least(100.0, 100.0
            - case when clip_ratio > 0.001 then least(40.0, clip_ratio * 1000.0) else 0 end
            - case when bandwidth < 1500 then 25 else 0 end
            - case when rolloff < 2500 and flatness < 0.0005 then 30 else 0 end
            - case when n_voiced > 10 and f0_std < 4 then 45
                   when n_voiced > 10 and f0_std > 120 then 20 else 0 end)) end::double as score
          from auth_inputs)"""))
def r3(spark, folder):
    k = c("k")
    return V.screenings(spark, folder).select(
        "screening_id",
        R.authenticity(
            k / 50000.0, (k * 37 % 4000).cast("double"), (k * 53 % 5000).cast("double"),
            k / 100000.0, (k * 3).cast("double"), k % 25, k == 99,
        ).alias("a"),
    ).select("screening_id", *flat("a", "score", "confidence", "is_authentic"),
             joined("a.warnings"))


_NOISY = "(snr < 12 or noise > 35)"
_SHORT = "(coverage < 30 or duration < 5)"
_ODD = f"(sim < 0.78 and not ({_NOISY} or clipped or {_SHORT}))"
V.CTE["quality_audit"] = (("screenings",), f"""
    select *, {even('raw_score', 1)} as q_score, raw_score < 3.0 as re_record,
           {join_reasons([(_NOISY, q(fixed.QUALITY_REASONS[0])), ('clipped', q(fixed.QUALITY_REASONS[1])), (_SHORT, q(fixed.QUALITY_REASONS[2])), ('sim < 0.72', q(fixed.QUALITY_REASONS[3])), (_ODD, q(fixed.QUALITY_REASONS[4]))])} as reasons
    from (select *, greatest(1.0, least(5.0, 5.0
            - case when {_NOISY} then 1.5 else 0 end - case when clipped then 2.0 else 0 end
            - case when {_SHORT} then 1.5 else 0 end - case when sim < 0.72 then 1.5 else 0 end
            - case when {_ODD} then 1.0 else 0 end))::double as raw_score
          from (select *, 0.6 + (k % 40) * 0.01::double as sim from screenings))""")


def audited(spark, folder, embedding: bool = False):
    s = V.screenings(spark, folder, embedding).withColumn(
        "sim", 0.6 + (c("k") % 40) * F.lit(0.01)
    )
    return s.withColumn(
        "qa",
        R.quality_audit(c("snr"), c("noise"), c("clipped"), c("coverage"), c("duration"),
                        c("sim")),
    )


@query("r4_quality_audit", with_views("quality_audit", f"""
    select screening_id, q_score as score,
           repeat('★', round_even(raw_score, 0)::int) || repeat('☆', 5 - round_even(raw_score, 0)::int) as stars,
           case when raw_score >= 4 then 'High' when raw_score >= 2.5 then 'Moderate' else 'Low' end as reliability,
           re_record, reasons,
           case when re_record then {q(fixed.RE_RECORD)} || case when reasons <> ''
                  then ' Reasons identified: ' || reasons || '.' else '' end
                else {q(fixed.QUALITY_OK)} end as message
    from quality_audit"""))
def r4(spark, folder):
    return audited(spark, folder).select(
        "screening_id", *flat("qa", "score", "stars", "reliability", "re_record", "message"),
        joined("qa.reasons", ", "),
    )


@query("r5_out_of_distribution", with_views("screenings", f"""
    select screening_id, not inside as is_ood, {even('p', 1)} as probability, {even('raw', 4)} as raw,
           case when inside then {q(fixed.OOD_INSIDE)} when p > 85 then {q(fixed.OOD_CRITICAL)}
                else {q(fixed.OOD_MODERATE)} end as reason
    from (select *, raw >= 1.0 as inside,
                 case when raw >= 1.0 then greatest(0.0, least(50.0, 50.0 - greatest(1e-5, raw - 1.0) / 2.0 * 50.0))
                      else least(100.0, 50.0 + (1.0 - raw) / 0.5 * 50.0) end::double as p
          from (select screening_id, k / 33.0::double as raw from screenings))"""))
def r5(spark, folder):
    return V.screenings(spark, folder).select(
        "screening_id", R.out_of_distribution(c("k") / 33.0, F.lit(1.0)).alias("o")
    ).select("screening_id", *flat("o", "is_ood", "probability", "raw", "reason"))


_TRUST = """50.0 + 2.0 * abs(risk_score - 0.5) * 45.0
      - case when (risk_score >= 0.5) <> (sim_pd >= 50) then 15.0 else 0 end
      - case when quality < 4 then (4.0 - quality) * 12.0 else 0 end
      - case when auth < 85 then (85.0 - auth) * 0.6::double else 0 end
      - case when ood > 25 then (ood - 25.0) * 0.5 else 0 end"""
V.CTE["trusted"] = (("screenings",), f"""
    select *, {even('t', 1)} as trust_score,
           case when t >= 75 then 'High' when t >= 45 then 'Medium' else 'Low' end as trust_level
    from (select *, greatest(10.0, least(99.0, t0,
              case when quality < 2.5 then 30.0 else 99.0 end,
              case when auth < 65 then 25.0 else 99.0 end,
              case when ood > 75 then 35.0 else 99.0 end))::double as t
          from (select *, ({_TRUST})::double as t0 from screenings))""")


def trusted(spark, folder, embedding: bool = False):
    return V.screenings(spark, folder, embedding).withColumn(
        "tr", R.trust(c("risk_score"), c("quality"), c("ood"), c("sim_pd"), c("auth"))
    )


@query("r6_trust_score", with_views("trusted", f"""
    select screening_id, trust_score as score, trust_level as level,
           {join_reasons([
               ("(risk_score >= 0.5) <> (sim_pd >= 50)", q(fixed.TRUST_DIVERGENCE)),
               ("quality < 4", "'reduced recording quality (Audit Score: ' || printf('%.1f', quality) || ' Stars)'"),
               ("auth < 85", q(fixed.TRUST_AUTH)), ("ood > 25", q(fixed.TRUST_OOD)),
               ("quality < 2.5", q(fixed.TRUST_BAD_QUALITY)), ("auth < 65", q(fixed.TRUST_SPOOF)),
               ("ood > 75", q(fixed.TRUST_OUTSIDE))], '|')} as reasons
    from trusted"""))
def r6(spark, folder):
    return trusted(spark, folder).select(
        "screening_id", *flat("tr", "score", "level"), joined("tr.reasons")
    )


# fused decision without drift: SQL pieces shared by the decision queries
_RULE = """case when auth < 65 then 'spoofed' when quality < 2.5 then 'poor_quality'
    when ood > 75 then 'atypical'
    when band = 2 and sim_pd between 40 and 60 then 'inconclusive'
    when band = 1 and trust_level = 'High' and sim_pd > 65 then 'agree_high'
    when band = 0 and trust_level = 'High' and 100 - sim_pd > 65 then 'agree_low'
    when band = 1 and sim_pd < 35 then 'diverge_down'
    when band = 0 and sim_pd > 65 then 'diverge_up' else 'standard' end"""
_BAND = "case when risk_score >= 0.65 then 1 when risk_score <= 0.35 then 0 else 2 end"
_FINAL = """case rule when 'spoofed' then least(trust_score, 15.0)
    when 'poor_quality' then least(trust_score, 20.0) when 'atypical' then least(trust_score, 35.0)
    when 'inconclusive' then least(trust_score, 50.0)
    when 'diverge_down' then greatest(35.0, trust_score - 15.0)
    when 'diverge_up' then greatest(35.0, trust_score - 15.0) else trust_score end"""


def fused_columns(drift: str = "0.0") -> str:
    """Select list of the fused decision over columns of ``trusted`` plus band and rule."""
    text = case("rule", {k: v[2] for k, v in fixed.DECISIONS.items()})
    nearest = f"case when sim_pd > 50 then {q(fixed.CLUSTERS[1])} else {q(fixed.CLUSTERS[0])} end"
    for name, value in (("{reasons}", "''"), ("{pd}", "sim_pd::varchar"),
                        ("{healthy}", "(100 - sim_pd)::varchar"), ("{cluster}", nearest)):
        text = f"replace({text}, '{name}', {value})"
    return f"""rule,
      coalesce({case('rule', {k: v[0] if v[0] is not None else 'NULL' for k, v in fixed.DECISIONS.items()}).replace("'NULL'", 'null')}, band)::bigint as status,
      coalesce({case('rule', {k: v[1] for k, v in fixed.DECISIONS.items()})}, {case('band', fixed.STATUS_LABEL)}) as status_label,
      {even(_FINAL, 1)} as final_trust,
      case when rule in ('spoofed', 'poor_quality', 'atypical', 'inconclusive') then 'Low'
           when rule in ('diverge_down', 'diverge_up') then 'Medium' else trust_level end as final_level,
      {text} || case when rule in ('agree_high', 'agree_low', 'standard') and {drift} > 0.08
                     then {q(' Note: ' + fixed.DRIFT_SHIFT)} else '' end as reasoning,
      coalesce({case('rule', {k: v[3] for k, v in fixed.DECISIONS.items()})}, {case('band', fixed.STANDARD_ADVICE)}) as advice"""


V.CTE["ruled"] = (("trusted",), f"select *, {_RULE} as rule from (select *, {_BAND} as band from trusted)")


def fuse_screenings(df: DataFrame, drift=None) -> DataFrame:
    """Fuse the audits of the ``screenings`` view (needs column ``tr``)."""
    return R.fuse(
        df,
        risk=c("risk_score"), trust_score=c("tr.score"), trust_level=c("tr.level"),
        quality=c("quality"), re_record=F.lit(False),
        reasons=F.array().cast("array<string>"),
        ood=c("ood"), is_ood=F.lit(False), sim_pd=c("sim_pd"),
        sim_healthy=100 - c("sim_pd"),
        nearest=F.when(c("sim_pd") > 50, fixed.CLUSTERS[1]).otherwise(fixed.CLUSTERS[0]),
        auth=c("auth"), is_authentic=F.lit(True),
        drift=F.lit(0.0) if drift is None else drift,
    )


FUSED = ("rule", "status", "status_label", "final_trust", "final_level", "reasoning", "advice")


@query("r7_decision_fusion",
       with_views("ruled", f"select screening_id, {fused_columns()} from ruled"))
def r7(spark, folder):
    return fuse_screenings(trusted(spark, folder)).select("screening_id", *FUSED)


_ALT_RULE = """case when re_record or q_score <= 2 then 'poor_quality' when ood > 70 then 'atypical'
    when band = 2 and sim_pd between 45 and 55 then 'inconclusive'
    when band = 1 and conf >= 0.7 and q_score >= 4 and sim_pd > 65 then 'agree_high'
    when band = 0 and conf >= 0.7 and q_score >= 4 and sim_pd < 35 then 'agree_low'
    when band = 1 and sim_pd < 35 then 'diverge_down' when band = 0 and sim_pd > 65 then 'diverge_up'
    else 'standard' end"""
_ALT_TEXT = case("rule", {k: v[1] for k, v in fixed.ALT_DECISIONS.items()})


@query("r8_confidence_fusion", with_views("quality_audit", f"""
    select screening_id, rule, case when rule = 'inconclusive' then 3 else band end::bigint as status,
           {case('band', fixed.STATUS_LABEL)} as status_label, {even('''case
             when rule = 'poor_quality' then least(conf * 100, 30.0) when rule = 'atypical' then least(conf * 100, 40.0)
             when rule = 'inconclusive' then least(conf * 100, 50.0)
             when rule in ('agree_high', 'agree_low') then least(99.0, greatest(conf * 100, 95.0))
             when rule in ('diverge_down', 'diverge_up') then greatest(50.0, conf * 100 - 15.0)
             else conf * 100 end''', 1)} as score,
           coalesce({case('rule', {k: v[0] for k, v in fixed.ALT_DECISIONS.items()})},
             case when conf * 100 >= 70 then 'High' when conf * 100 >= 35 then 'Moderate' else 'Low' end) as label,
           replace(replace({_ALT_TEXT}, '{{reasons}}', reasons), '{{cluster}}',
             case when sim_pd > 50 then {q(fixed.CLUSTERS[1])} else {q(fixed.CLUSTERS[0])} end) as reasoning,
           coalesce({case('rule', {k: v[2] for k, v in fixed.ALT_DECISIONS.items()})}, {case('band', fixed.ADVICE)}) as advice
    from (select *, {_ALT_RULE} as rule from (select *, {_BAND} as band, 2.0 * abs(risk_score - 0.5) as conf from quality_audit))
"""))
def r8(spark, folder):
    return R.fuse_by_confidence(
        audited(spark, folder),
        risk=c("risk_score"), confidence=S.certainty(c("risk_score")), quality=c("qa.score"),
        re_record=c("qa.re_record"), reasons=c("qa.reasons"), ood=c("ood"),
        is_ood=F.lit(False), similarity=c("sim_pd"),
        nearest=F.when(c("sim_pd") > 50, fixed.CLUSTERS[1]).otherwise(fixed.CLUSTERS[0]),
    ).select("screening_id", "rule", "status", "status_label", "score", "label", "reasoning",
             "advice")


@query("r9_certainty_label", with_views("screenings", f"""
    select screening_id, {rungs('c', [r[:2] for r in fixed.CERTAINTY[:2]], fixed.CERTAINTY[2][1])} as label,
           {rungs('c', [(r[0], r[2]) for r in fixed.CERTAINTY[:2]], fixed.CERTAINTY[2][2])} as meaning
    from (select screening_id, 2.0 * abs(risk_score - 0.5) as c from screenings)"""))
def r9(spark, folder):
    return V.screenings(spark, folder).select(
        "screening_id", R.certainty_label(c("risk_score")).alias("l")
    ).select("screening_id", *flat("l", "label", "meaning"))


@query("r10_confidence_label", with_views("trusted", f"""
    select screening_id, score, coalesce(case when k % 3 = 0 then trust_level end,
             case when score >= 90 then 'Very High' when score >= 70 then 'High' when score >= 55 then 'Moderate' else 'Low' end) as label,
           case when score >= 75 then 'High' when score >= 55 then 'Moderate' else 'Low' end as reliability
    from (select *, coalesce(case when k % 3 = 0 then trust_score end,
            {even('greatest(50.0, least(99.0, 2.0 * abs(risk_score - 0.5) * 100.0))', 1)}) as score from trusted)"""))
def r10(spark, folder):
    fused = c("k") % 3 == 0
    return trusted(spark, folder).select(
        "screening_id",
        R.confidence(S.certainty(c("risk_score")), F.when(fused, c("tr.score")),
                     F.when(fused, c("tr.level"))).alias("x"),
    ).select("screening_id", *flat("x", "score", "label", "reliability"))


def _status_sql() -> str:
    parts = []
    for key, label, unit, shown, low, high, below, above, scale in fixed.BIOMARKERS:
        v = f"({key} * {scale})"
        status = "'Normal'"
        if high is not None:
            status = f"case when {v} <= {high} then {status} else {q(above)} end"
        if low is not None:
            status = f"case when {v} < {low} then {q(below)} else {status} end"
        parts.append(
            f"select screening_id, {q(key)} as key, {q(label)} as label, "
            f"cast({even(v, 3)} as varchar) as value, {q(unit)} as unit, "
            f"{q(shown)} as reference_range, {status} as status from metrics"
        )
    row = fixed.MFCC_ROW
    names = ("key", "label", "value", "unit", "reference_range", "status")
    parts.append("select screening_id, "
                 + ", ".join(f"{q(v)} as {n}" for n, v in zip(names, row)) + " from metrics")
    return "\nunion all ".join(parts)


@query("r11_biomarker_statuses", with_views("metrics", _status_sql()))
def r11(spark, folder):
    m = metrics(spark, folder)
    return m.select(
        "screening_id",
        F.inline(R.biomarker_statuses({n: c(n) for n in METRICS})),
    )


def _phrase_case(table, label: str, otherwise: str, slot: int) -> str:
    rows = " ".join(
        "when " + " or ".join(f"contains(lower({label}), {q(w)})" for w in row[0])
        + f" then {q(row[slot])}"
        for row in table
    )
    return f"case {rows} else {otherwise} end"


_DESCRIPTOR = (
    f"case when value > 0 then {_phrase_case(fixed.DESCRIPTORS, 'label', chr(39) + 'Elevated ' + chr(39) + ' || label', 1)}"
    f" else {_phrase_case(fixed.DESCRIPTORS, 'label', chr(39) + 'Reduced ' + chr(39) + ' || label', 2)} end"
)
_PHRASE = (
    f"case when value > 0 then {_phrase_case(fixed.RAISED_PHRASES, 'label', chr(39) + 'altered ' + chr(39) + ' || lower(label)', 1)}"
    f" else {_phrase_case(fixed.LOWERED_PHRASES, 'label', chr(39) + 'reduced ' + chr(39) + ' || lower(label)', 1)} end"
)


@query("r12_directional_biomarkers", with_views("top_attr", f"""
    select vec_id, rk as rank, label, case when value > 0 then '↑' else '↓' end as direction,
           {_DESCRIPTOR} as descriptor, {even('value', 4)} as value from top_attr"""))
def r12(spark, folder):
    top = top_attributions(spark, folder)
    return top.select(
        "vec_id", F.posexplode(R.directional_biomarkers(c("top"))).alias("p", "b")
    ).select("vec_id", (c("p") + 1).cast("long").alias("rank"),
             *flat("b", "label", "direction", "descriptor", "value"))


_CONTEXT = f"""case when risk >= 0.65 then {q(fixed.EXPLAIN_CONTEXT[1])}
    when risk >= 0.35 then {q(fixed.EXPLAIN_CONTEXT[2])} else {q(fixed.EXPLAIN_CONTEXT[0])} end"""


@query("r13_explanation", with_views("top_attr", f"""
    select vec_id, 'The screening result was primarily influenced by ' || d[1] || ', ' || d[2] || ', and ' || d[3]
             || ', ' || {_CONTEXT} || '.' as explanation
    from (select vec_id, any_value(risk) as risk, list({_PHRASE} order by rk) as d
          from top_attr where rk <= 3 group by vec_id)"""))
def r13(spark, folder):
    return top_attributions(spark, folder).select(
        "vec_id", R.explanation(c("top"), c("risk")).alias("explanation")
    )


@query("r14_recommendation", with_views("screenings", f"""
    select screening_id, case when risk_score < 0.35 then {q(fixed.ADVICE[0])}
      when risk_score < 0.65 then {q(fixed.ADVICE[2])} else {q(fixed.ADVICE[1])} end as advice
    from screenings"""))
def r14(spark, folder):
    return V.screenings(spark, folder).select(
        "screening_id", R.recommendation(c("risk_score")).alias("advice")
    )


AUDITED = 20  # percent of speech below which a recording is not audited, so that nothing was fused


@query("r13_fused_explanation", with_views("top_attr ruled", f"""
    select vec_id, coalesce(f.reasoning, 'The screening result was primarily influenced by ' || d[1] || ', ' || d[2] || ', and ' || d[3]
             || ', ' || {_CONTEXT} || '.') as explanation
    from (select vec_id, any_value(risk) as risk, list({_PHRASE} order by rk) as d
          from top_attr where rk <= 3 group by vec_id)
    left join (select screening_id, {fused_columns()} from ruled where coverage >= {AUDITED}) f on f.screening_id = vec_id"""))
def r13_fused(spark, folder):
    """The fused reasoning of an audited recording, else the text made from its strongest attributions."""
    fused = fuse_screenings(trusted(spark, folder)).where(c("coverage") >= AUDITED).select("screening_id", "reasoning")
    top = top_attributions(spark, folder)
    return top.join(fused, c("screening_id") == c("vec_id"), "left").select(
        "vec_id", R.explanation(c("top"), c("risk"), c("reasoning")).alias("explanation"))


@query("r14_fused_recommendation", with_views("ruled", f"""
    select screening_id, case when coverage >= {AUDITED} then advice
        when risk_score < 0.35 then {q(fixed.ADVICE[0])}
        when risk_score < 0.65 then {q(fixed.ADVICE[2])} else {q(fixed.ADVICE[1])} end as advice
    from (select screening_id, risk_score, coverage, {fused_columns()} from ruled)"""))
def r14_fused(spark, folder):
    """The fused advice of an audited recording, else the advice of its risk band."""
    fused = fuse_screenings(trusted(spark, folder))
    said = F.when(c("coverage") >= AUDITED, c("advice"))
    return fused.select("screening_id", R.recommendation(c("risk_score"), said).alias("advice"))


def _by_band(table: dict) -> str:
    t = {k: v if isinstance(v, str) else "|".join(v) for k, v in table.items()}
    return (f"case when risk < 0.35 then {q(t[0])} when risk < 0.65 then {q(t[2])} "
            f"else {q(t[1])} end")


@query("r15_report_rows", with_views("top_attr", f"""
    select vec_id, {_by_band(fixed.STATUS_LABEL)} as category,
           {_by_band(fixed.REPORT_SUMMARY)} || {q(fixed.REPORT_DRIVERS)} || drivers || '.' as summary,
           printf('%.2f Hz', f0) || '; ' || case when f0 > 0 and f0 < 80 then 'Low (Deep voice/dysphonia potential)'
             when f0 > 280 then 'High (Tension potential)' else 'Within range' end
           || '|' || printf('%.3f%%', jit) || '; ' || case when jit > 1.04 then 'Elevated' else 'Normal' end
           || '|' || printf('%.3f%%', shim * 100.0) || '; ' || case when shim * 100.0 > 3.80 then 'Elevated' else 'Normal' end
           || '|' || printf('%.2f dB', hnr) || '; ' || case when hnr < 20 then 'Low (Breathiness)' else 'Normal (Stable)' end as biomarkers,
           {_by_band(fixed.REPORT_ADVICE)} as advice
    from (select vec_id, any_value(risk) as risk, 50 + vec_id % 250 + 0.25::double as f0,
                 (vec_id % 200) / 64.0::double as jit, (vec_id % 80) / 1024.0::double as shim, (vec_id % 45)::double as hnr,
                 array_to_string(list(label || case when value > 0 then ' (increased risk)' else ' (decreased risk)' end order by rk), ', ') as drivers
          from top_attr where rk <= 3 group by vec_id)"""))
def r15(spark, folder):
    v = c("vec_id")
    return top_attributions(spark, folder).select(
        "vec_id",
        R.report(
            50 + v % 250 + 0.25, (v % 200) / 64.0, (v % 80) / 1024.0,
            (v % 45).cast("double"), c("risk"), c("top"),
        ).alias("r"),
    ).select(
        "vec_id", *flat("r", "category", "summary"),
        F.array_join(
            F.transform("r.biomarkers", lambda b: F.concat(b["value"], F.lit("; "), b["status"])),
            "|",
        ).alias("biomarkers"),
        joined("r.advice"),
    )


@query("r16_radar_scores", with_views("metrics", """
    select screening_id, u.axis as axis, u.voice::bigint as voice, u.cohort::bigint as cohort from (
      select screening_id, unnest([
        {'axis': 'Pitch Stability', 'voice': case when fo_mean between 85 and 255 then 92 else
            greatest(25, floor(90 - (case when fo_mean < 85 then 85 - fo_mean else fo_mean - 255 end) * 0.4::double + 0.5)) end, 'cohort': 85},
        {'axis': 'Jitter (Pitch)', 'voice': greatest(15, least(99, floor(100 - jitter_pct * 30 + 0.5))), 'cohort': 90},
        {'axis': 'Shimmer (Amp)', 'voice': greatest(15, least(99, floor(100 - (case when shimmer_local < 0.1 then shimmer_local * 100 else shimmer_local end) * 8 + 0.5))), 'cohort': 90},
        {'axis': 'Harmonic Ratio', 'voice': greatest(15, least(99, floor(hnr * 4 + 0.5))), 'cohort': 85},
        {'axis': 'Noise Ratio', 'voice': greatest(15, least(99, floor(100 - nhr * 200 + 0.5))), 'cohort': 90},
        {'axis': 'Spectral Energy', 'voice': 85.0::double, 'cohort': 85}]) as u
      from metrics)"""))
def r16(spark, folder):
    return metrics(spark, folder).select(
        "screening_id",
        F.inline(R.radar(c("fo_mean"), c("jitter_pct"), c("shimmer_local"), c("hnr"), c("nhr"),
                         c("energy"))),
    )


@query("r17_capture_quality", with_views("screenings", """
    select screening_id, floor(greatest(30.0, least(100.0, 100 - k / 1000.0::double * 800))
             - case when clipped then 20 else 0 end + 0.5)::bigint as score from screenings"""))
def r17(spark, folder):
    return V.screenings(spark, folder).select(
        "screening_id", R.capture_quality(c("k") / 1000.0, c("clipped")).alias("score")
    )


@query("r18_drawing_risk", with_views("drawings", """
    select drawing_id, case when p < 0.3 then 'Low risk' when p < 0.6 then 'Moderate risk' else 'High risk' end as label,
           p >= 0.5 as positive from drawings"""))
def r18(spark, folder):
    return V.drawings(spark, folder).select(
        "drawing_id", R.drawing_risk(c("p")).alias("r")
    ).select("drawing_id", *flat("r", "label", "positive"))


@query("r19_cohort_match", with_views("screenings", f"""
    select screening_id, case when sp > sh then {q(fixed.CLUSTERS[1])} else {q(fixed.CLUSTERS[0])} end as nearest,
           {rungs('abs(sp - sh)', [(0.04, 'High'), (0.015, 'Moderate')], 'Low')} as confidence
    from (select screening_id, k / 512.0::double as sp, (k * 7 % 50) / 512.0::double as sh from screenings)"""))
def r19(spark, folder):
    k = c("k")
    return V.screenings(spark, folder).select(
        "screening_id", R.cohort_match(k / 512.0, (k * 7 % 50) / 512.0).alias("m")
    ).select("screening_id", *flat("m", "nearest", "confidence"))


# --- scalar functions ---------------------------------------------------------------------------


@query("f1_subject_id", with_views("refs", r"""
    select vec_id, case when regexp_matches(name, '^(.+?)_\d+$') then regexp_extract(name, '^(.+?)_\d+$', 1) else name end as subject
    from (select vec_id, case when vec_id % 7 = 0 then 'plain' || vec_id else 'rec_S' || (vec_id % 32) || '_' || vec_id end as name from refs)"""))
def f1(spark, folder):
    name = F.when(c("vec_id") % 7 == 0, F.concat(F.lit("plain"), c("vec_id").cast("string")))
    return V.refs(spark, folder).select(
        "vec_id", S.subject_id(name.otherwise(V.vec_name())).alias("subject")
    )


_STEM = r"regexp_replace(file_name, '\.[^.]*$', '')"
V.CTE["drawn"] = (("drawings",), rf"""
    select *, case
        when collection = 'coded' and regexp_matches(upper(stem), '^V(\d+)([A-Z])([EO])')
          then case when regexp_extract(upper(stem), '^V(\d+)([A-Z])([EO])', 3) = 'E' then 'spiral' else 'wave' end
        when collection = 'coded' then 'unknown' when collection = 'numbered' then 'both'
        when regexp_matches(stem, '^sp\d+-[HP]\d+$') then 'spiral'
        when regexp_matches(stem, '^mea\d+-[HP]\d+$') then 'wave' else 'both' end as kind,
      case
        when collection = 'coded' then case when regexp_extract(upper(stem), '^V(\d+)([A-Z])([EO])', 2) = 'P' then 'PD_' else 'H_' end
          || lpad(regexp_extract(upper(stem), '^V(\d+)([A-Z])([EO])', 1), 3, '0')
        when collection = 'numbered' then 'HPD_' || regexp_extract(stem, '^(\d+)-\d+$', 1)
        else 'NHPD_' || regexp_extract(stem, '^(sp\d+|mea\d+)-[HP](\d+)$', 1) || '_' || regexp_extract(stem, '^(sp\d+|mea\d+)-[HP](\d+)$', 2) end as subject
    from (select *, {_STEM} as stem from drawings)""")


def drawn(spark, folder) -> DataFrame:
    return V.drawings(spark, folder).withColumn(
        "d", S.drawing(c("file_name"), c("collection"))
    ).select("drawing_id", "file_name", "collection", "label", "p",
             *flat("d", "kind", "subject"))


@query("f2_drawing_names",
       with_views("drawn", "select drawing_id, file_name, kind, subject from drawn"))
def f2(spark, folder):
    return drawn(spark, folder).select("drawing_id", "file_name", "kind", "subject")


@query("f3_report_codes", with_views("uploads", r"""
    select page_id, nullif(regexp_extract(u, 'report_([a-f0-9]+)\.pdf', 1), '') as report_id,
           'VV-' || coalesce(upper(nullif(split_part(split_part(u, '_', 2), '.', 1), '')), 'UNKNOWN') as code
    from (select page_id, case when page_id % 5 = 0 then 'http://host/none' else 'http://host/report_' || printf('%x', page_id * 7919 + 4096) || '.pdf' end as u from uploads)"""))
def f3(spark, folder):
    u = F.when(c("page_id") % 5 == 0, "http://host/none").otherwise(
        F.concat(F.lit("http://host/report_"), F.lower(F.hex(c("page_id") * 7919 + 4096)),
                 F.lit(".pdf"))
    )
    return V.uploads(spark, folder).select(
        "page_id", S.report_id(u).alias("report_id"), S.reference_code(u).alias("code")
    )


@query("f4_stars", with_views("screenings", """
    select screening_id, repeat('★', round_even(quality, 0)::int) || repeat('☆', 5 - round_even(quality, 0)::int) as stars from screenings"""))
def f4(spark, folder):
    return V.screenings(spark, folder).select("screening_id", S.stars(c("quality")).alias("stars"))


@query("f5_reason_text", with_views("screenings", """
    select screening_id, coalesce(array_to_string(r, ', '), '') as plain,
           case len(r) when 1 then r[1] when 2 then r[1] || ' and ' || r[2]
             when 3 then r[1] || ', ' || r[2] || ', and ' || r[3] end as english
    from (select screening_id, list_filter([case when snr < 12 then 'noise' end, case when clipped then 'clipping' end,
            case when duration < 5 then 'short' end], lambda v: v is not null) as r from screenings)"""))
def f5(spark, folder):
    r = S.present(F.when(c("snr") < 12, "noise"), F.when(c("clipped"), "clipping"),
                  F.when(c("duration") < 5, "short"))
    return V.screenings(spark, folder).select(
        "screening_id", F.array_join(r, ", ").alias("plain"), S.english_list(r).alias("english")
    )


@query("f7_two_way_share", with_views("screenings", """
    select screening_id, round(100.0 / (1.0 + exp(((100 - sim_pd) / 100.0 - sim_pd / 100.0) / 0.05::double)), 6) as share_pd from screenings"""))
def f7(spark, folder):
    s = c("sim_pd") / 100.0
    return V.screenings(spark, folder).select(
        "screening_id",
        F.round(S.two_way_share(s, (100 - c("sim_pd")) / 100.0), 6).alias("share_pd"),
    )


@query("f9_certainty", with_views("screenings", """
    select screening_id, round(2.0 * abs(risk_score - 0.5), 6) as certainty from screenings"""))
def f9(spark, folder):
    return V.screenings(spark, folder).select(
        "screening_id", F.round(S.certainty(c("risk_score")), 6).alias("certainty")
    )


@query("f10_clamp_round", with_views("screenings", f"""
    select screening_id, {even('greatest(20.0, least(80.0, us % 1000 / 8.0))', 1)} as bounded from screenings"""))
def f10(spark, folder):
    return V.screenings(spark, folder).select(
        "screening_id",
        S.half_even(S.clamp(c("us") % 1000 / 8.0, 20.0, 80.0), 1).alias("bounded"),
    )


@query("f11_decibel_meter", with_views("signal_ev", """
    select series_id, t, round(db, 6) as db, round(greatest(0.0, least(100.0, (db + 50.0) / 50.0 * 100.0)), 6) as meter
    from (select *, case when abs(x) > 0 then 20.0 * log10(abs(x)) else -100.0 end as db from signal_ev)"""))
def f11(spark, folder):
    return V.signal_ev(spark, folder).withColumn("db", S.decibel(F.abs("x"))).select(
        "series_id", "t", F.round("db", 6).alias("db"),
        F.round(S.meter(c("db")), 6).alias("meter"),
    )


@query("f12_range_percent", with_views("screenings", """
    select screening_id, round((risk_score - 0.1) / 0.8::double * 100.0, 6) as pct, round((risk_score - 0.1) * 100.0, 6) as pct_flat from screenings"""))
def f12(spark, folder):
    return V.screenings(spark, folder).select(
        "screening_id",
        F.round(S.range_percent(c("risk_score"), F.lit(0.1), F.lit(0.9)), 6).alias("pct"),
        F.round(S.range_percent(c("risk_score"), F.lit(0.1), F.lit(0.1)), 6).alias("pct_flat"),
    )


METRIC_JSON = "struct<hnr: double, jitter_pct: double, formants: array<double>>"


@query("f13_metrics_json", with_views("metrics", """
    select screening_id, hnr, jitter_pct, fo_mean as f1, k::varchar as k_text from metrics"""))
def f13(spark, folder):
    m = metrics(spark, folder).select(
        "screening_id",
        F.to_json(F.struct("hnr", "jitter_pct", F.array("fo_mean", "fhi").alias("formants")))
        .alias("doc"),
        F.get_json_object(F.to_json(F.struct("k")), "$.k").alias("k_text"),
    )
    return m.withColumn("d", F.from_json("doc", METRIC_JSON)).select(
        "screening_id", c("d.hnr").alias("hnr"), c("d.jitter_pct").alias("jitter_pct"),
        F.get("d.formants", F.lit(0)).alias("f1"), "k_text",
    )


@query("f14_value_text", with_views("screenings", """
    select screening_id, printf('%.2f Hz', 60 + k * 3.25) as pitch, printf('%.3f%%', k / 64.0) as jitter, printf('%.2f dB', k * 0.25) as hnr from screenings"""))
def f14(spark, folder):
    return V.screenings(spark, folder).select(
        "screening_id", S.fixed_text(60 + c("k") * 3.25, 2, " Hz").alias("pitch"),
        S.fixed_text(c("k") / 64.0, 3, "%").alias("jitter"),
        S.fixed_text(c("k") * 0.25, 2, " dB").alias("hnr"),
    )


AS_OF = "2024-02-01 00:00:00"
AS_OF_US = 1706745600000000


@query("f15_iso_time_age", with_views("screenings", f"""
    select screening_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') as iso, round(({AS_OF_US} - us) / 1e6, 6) as age_seconds from screenings"""))
def f15(spark, folder):
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    back = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', "
                  "to_timestamp_ntz(iso, \"yyyy-MM-dd'T'HH:mm:ss.SSSSSS\"))")
    return V.screenings(spark, folder).select("screening_id", iso.alias("iso")).select(
        "screening_id", "iso",
        F.round(S.age_seconds(F.lit(AS_OF_US), back), 6).alias("age_seconds"),
    )


@query("f16_array_prefix", with_views("refs", """
    select vec_id, len(embedding)::bigint as n, round(embedding[1], 6) as first, round(embedding[len(embedding)], 6) as last,
           round(list_sum(embedding[1:5]), 6) as head_sum from refs"""))
def f16(spark, folder):
    e = c("embedding")
    return V.refs(spark, folder).select(
        "vec_id", F.size(e).cast("long").alias("n"), F.round(F.element_at(e, 1), 6).alias("first"),
        F.round(F.element_at(e, -1), 6).alias("last"),
        F.round(F.aggregate(F.slice(e, 1, 5), F.lit(0.0), lambda s, v: s + v), 6)
        .alias("head_sum"),
    )


@query("f17_keyword_descriptor", with_views("attributions", f"""
    select vec_id, i, {_DESCRIPTOR} as descriptor from (select *, {_LABEL_SQL} as label from attributions)"""))
def f17(spark, folder):
    return V.attributions(spark, folder).select(
        "vec_id", "i", S.descriptor(label_of(c("i")), c("value")).alias("descriptor")
    )


@query("f18_shown_snr", with_views("screenings", """
    select screening_id, s::bigint as shown, round(least(100.0, s / 30.0 * 100.0), 6) as meter
    from (select screening_id, greatest(10, floor(32 - (case when noise is null or noise = 0 then 5 else noise end) * 0.6::double + 0.5)) as s from screenings)"""))
def f18(spark, folder):
    return V.screenings(spark, folder).select(
        "screening_id", S.shown_snr(c("noise")).alias("shown"),
        F.round(S.shown_snr_meter(c("noise")), 6).alias("meter"),
    )
