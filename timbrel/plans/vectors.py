"""Queries over vectors: centroids, neighbours, density, projections, attributions."""

from __future__ import annotations

from pyspark.sql import functions as F

from timbrel.functions import fixed
from timbrel.functions import rules as R
from timbrel.functions import scalars as S
from timbrel.operators import cells as CE
from timbrel.operators import vectors as VE
from timbrel.operators.ordered import quantiles
from timbrel.plans.registry import query
from timbrel.plans.rules import LABELS, flat, top_attributions
from timbrel.plans.series import rounded
from timbrel.plans.sqltext import even, q
from timbrel.sources import views as V
from timbrel.sources.views import with_views

c = F.col
_COS = "(list_dot_product({a}, {b}) / ((sqrt(list_dot_product({a}, {a})) + 1e-10) * (sqrt(list_dot_product({b}, {b})) + 1e-10)))"

V.CTE["centroids"] = (("vec_long",), """
    select cohort, list(m order by i) as v from (select cohort, i, avg(v) as m from vec_long group by cohort, i) group by cohort""")
V.CTE["neighbours"] = (("refs",), f"""
    select row_id, rank, ref_id, cohort, similarity from (
      select a.vec_id as row_id, b.vec_id as ref_id, b.cohort, {_COS.format(a='a.embedding', b='b.embedding')} as similarity,
        row_number() over (partition by a.vec_id order by {_COS.format(a='a.embedding', b='b.embedding')} desc, b.vec_id) as rank
      from refs a, refs b where a.vec_id <> b.vec_id) where rank <= 5""")


V.CTE["flatpoints"] = (("refs",), """
    select vec_id, cohort, list_sum(embedding[1:32]) / sqrt(list_dot_product(embedding, embedding)) * 10 as x,
      list_sum(embedding[33:64]) / sqrt(list_dot_product(embedding, embedding)) * 10 as y from refs""")


def neighbours(spark, folder, k=5):
    refs = V.refs(spark, folder)
    rows = refs.select(c("vec_id").alias("row_id"), "embedding")
    return VE.nearest_references(
        rows.withColumnRenamed("row_id", "vec_id"), refs, k, row_id="vec_id", skip_self=True
    )


@query("a3_cohort_centroids", with_views("vec_long", """
    select cohort, i, round(avg(v), 6) as mean from vec_long group by cohort, i"""))
def a3(spark, folder):
    return rounded(VE.mean_vector(V.refs(spark, folder), ["cohort"]).select(
        "cohort", F.posexplode("vector").alias("i", "mean")))


@query("a4_cohort_covariance", with_views("vec_long", """
    select cohort, a.i, b.i as j, round(sum((a.v - ma) * (b.v - mb)) / count(*), 9) as cov from
      (select *, avg(v) over (partition by cohort, i) as ma from vec_long) a join
      (select vec_id, i, v, avg(v) over (partition by cohort, i) as mb from vec_long) b using (vec_id) group by cohort, a.i, b.i"""))
def a4(spark, folder):
    return rounded(
        VE.covariances(V.refs(spark, folder), "cohort", "embedding").select(
            "cohort", "i", "j", "cov"), digits=9)


@query("a6_mean_pooling", with_views("vec_long", """
    select vec_id % 32 as subject, i, round(avg(v), 6) as mean from vec_long group by vec_id % 32, i"""))
def a6(spark, folder):
    s = V.refs(spark, folder).withColumn("subject", V.subject_of(c("vec_id")))
    return rounded(VE.mean_vector(s, ["subject"]).select(
        "subject", F.posexplode("vector").alias("i", "mean")))


_SIM = f"""select r.vec_id, {_COS.format(a='r.embedding', b='h.v')} as sim_h, {_COS.format(a='r.embedding', b='p.v')} as sim_p
    from refs r, (select v from centroids where cohort = 0) h, (select v from centroids where cohort = 1) p"""


@query("j2_cohort_similarity", with_views("centroids refs", f"""
    select vec_id, round(sim_h, 6) as sim_h, round(sim_p, 6) as sim_p, {even('share', 1)} as similarity_parkinsons, {even('100 - share', 1)} as similarity_healthy,
      case when sim_p > sim_h then {q(fixed.CLUSTERS[1])} else {q(fixed.CLUSTERS[0])} end as nearest,
      case when abs(sim_p - sim_h) >= 0.04 then 'High' when abs(sim_p - sim_h) >= 0.015 then 'Moderate' else 'Low' end as confidence
    from (select *, 100.0 / (1.0 + exp((sim_h - sim_p) / 0.05::double)) as share from ({_SIM}))"""))
def j2(spark, folder):
    refs = V.refs(spark, folder)
    healthy, pathology = VE.centroid_pair(refs)
    out = VE.cohort_similarity(refs, healthy, pathology)
    return rounded(out.select(
        "vec_id", "sim_h", "sim_p", "similarity_parkinsons", "similarity_healthy", "nearest",
        "confidence"))


@query("j3_nearest_references", with_views("neighbours", f"""
    select row_id, rank, ref_id, case when cohort = 1 then {q(fixed.COHORTS[1])} else {q(fixed.COHORTS[0])} end as cohort,
      cohort as label, {even('similarity', 4)} as similarity from neighbours"""))
def j3(spark, folder):
    return neighbours(spark, folder).select(
        "row_id", "rank", "ref_id", VE.cohort_name(c("cohort")).alias("cohort"),
        c("cohort").alias("label"), S.half_even(c("similarity"), 4).alias("similarity"),
    )


@query("j3_pruned_nearest", with_views("neighbours", """
    select row_id, rank, ref_id, cohort as label, round(similarity, 6) as similarity from neighbours"""))
def j3p(spark, folder):
    refs = V.refs(spark, folder)
    return rounded(CE.nearest_pruned(refs, refs, 5, row_id="vec_id", skip_self=True)
                   .withColumnRenamed("cohort", "label"))


@query("k2_mean_top_similarity", with_views("neighbours", """
    select row_id as vec_id, round(avg(similarity), 6) as similarity from neighbours group by row_id"""))
def k2(spark, folder):
    rows = V.refs(spark, folder).select("vec_id")
    return rounded(VE.mean_top_similarity(rows, neighbours(spark, folder), "vec_id"))


@query("k4_first_three_neighbours", with_views("neighbours", f"""
    select row_id, array_to_string(list('Case #' || ref_id || ' (' || case when cohort = 1 then {q(fixed.COHORTS[1])} else {q(fixed.COHORTS[0])} end
      || ' - ' || printf('%.1f', {even(even('similarity', 4) + ' * 100', 1)}) || '% Match)' order by rank), '|') as matches
    from neighbours where rank <= 3 group by row_id"""))
def k4(spark, folder):
    text = F.concat(
        F.lit("Case #"), c("ref_id").cast("string"), F.lit(" ("), VE.cohort_name(c("cohort")),
        F.lit(" - "), S.fixed_text(S.half_even(c("similarity"), 4) * 100, 1, "% Match)"),
    )
    best = neighbours(spark, folder).filter("rank <= 3").groupBy("row_id").agg(
        F.array_sort(F.collect_list(F.struct("rank", text.alias("t")))).alias("a")
    )
    return best.select(
        "row_id", F.array_join(F.transform("a", lambda s: s["t"]), "|").alias("matches")
    )


@query("k1_top_attributions", with_views("top_attr", """
    select vec_id, rk as rank, label, value, case when value > 0 then 'increase' else 'decrease' end as impact from top_attr"""))
def k1(spark, folder):
    return top_attributions(spark, folder).select(
        "vec_id", F.posexplode("top").alias("p", "a")
    ).select("vec_id", (c("p") + 1).cast("long").alias("rank"), *flat("a", "label", "value"),
             F.when(c("a.value") > 0, "increase").otherwise("decrease").alias("impact"))


@query("w10_attribution_waterfall", with_views("attributions", """
    select vec_id, rank, round(0.47::double + run - value, 6) as start, round(0.47::double + run, 6) as "end", value > 0 as positive from (
      select *, sum(value) over (partition by vec_id order by rank) as run from (
        select *, row_number() over (partition by vec_id order by abs(value) desc, i) as rank from attributions) where rank <= 6)"""))
def w10(spark, folder):
    long = V.attributions(spark, folder)
    per_row = long.groupBy("vec_id").agg(
        F.slice(
            F.array_sort(F.collect_list(F.struct((-F.abs("value")).alias("o"), "i", "value"))),
            1, 6,
        ).alias("top")
    )
    zero = F.expr("cast(array() as array<struct<start: double, end: double, positive: boolean>>)")
    steps = F.aggregate(
        "top",
        zero,
        lambda acc, a: F.concat(acc, F.array(F.struct(
            F.coalesce(F.try_element_at(acc, F.lit(-1))["end"], F.lit(0.47)).alias("start"),
            (F.coalesce(F.try_element_at(acc, F.lit(-1))["end"], F.lit(0.47)) + a["value"])
            .alias("end"),
            (a["value"] > 0).alias("positive"),
        ))),
    )
    return rounded(per_row.select("vec_id", F.posexplode(steps).alias("p", "s")).select(
        "vec_id", (c("p") + 1).cast("long").alias("rank"), *flat("s", "start", "end", "positive")))


COEFS = [round(((i * 37) % 64 - 31.5) / 50 * (1 if i % 3 else 0), 4) for i in range(64)]
_COEF_SQL = "coef(i, w) as (values " + ", ".join(
    f"({i}, {w}::double)" for i, w in enumerate(COEFS)) + ")"


@query("k3_top_coefficients", with_views("refs", """
    select i, round(coef, 6) as coef, row_number() over (order by abs(coef) desc, i) as rank from (
      select i, round((avg(v) filter (cohort = 1) - avg(v) filter (cohort = 0)) / stddev_pop(v), 9) as coef
      from (select cohort, unnest(embedding)::double as v, unnest(range(64)) as i from refs) group by i)
    where abs(coef) >= 1e-5 qualify rank <= 12"""))
def k3(spark, folder):
    """Per dimension, the gap of the cohort means in standard deviations as its coefficient."""
    from timbrel.operators.models import top_coefficients

    v = c("v").cast("double")
    mean = lambda k: F.avg(F.when(c("cohort") == k, v))
    long = V.refs(spark, folder).select("cohort", F.posexplode("embedding").alias("i", "v"))
    coef = long.groupBy(c("i").cast("long").alias("i")).agg(
        F.round((mean(1) - mean(0)) / F.stddev_pop(v), 9).alias("coef"))
    return rounded(top_coefficients(coef))


INVERSE = [[round((2.0 if i == j else 0.0) + 1.0 / (1 + abs(i - j)), 9) for j in range(64)]
           for i in range(64)]


@query("f8_mahalanobis", with_views("vec_long", """
    select vec_id, round(sqrt(sum(d * (case when i = j then 2.0 else 0.0 end + round(1.0::double / (1 + abs(i - j)), 9)) * e)), 6) as distance from
      (select vec_id, i, v - avg(v) over (partition by i) as d from vec_long) join
      (select vec_id, i as j, v - avg(v) over (partition by i) as e from vec_long) using (vec_id) group by vec_id"""))
def f8(spark, folder):
    refs = V.refs(spark, folder)
    mean = list(VE.mean_vector(refs, []).first()["vector"])
    diff = VE.minus(c("embedding"), VE.constant_vector(mean))
    return rounded(refs.select("vec_id", VE.mahalanobis(diff, INVERSE).alias("distance")))


@query("f6_cosine_similarity", with_views("refs", f"""
    select a.vec_id, round({_COS.format(a='a.embedding', b='b.embedding')}, 6) as similarity,
      round(1 - {_COS.format(a='a.embedding', b='b.embedding')}, 6) as distance from refs a join refs b on b.vec_id = a.vec_id + 1"""))
def f6(spark, folder):
    r = V.refs(spark, folder).select("vec_id", "embedding", S.norm(c("embedding")).alias("len"))
    nxt = r.select((c("vec_id") - 1).alias("vec_id"), c("embedding").alias("e2"),
                   c("len").alias("l2"))
    sim = S.cosine(c("embedding"), c("e2"), c("len"), c("l2"))
    return rounded(r.join(nxt, "vec_id").select(
        "vec_id", sim.alias("similarity"), (1 - sim).alias("distance")))


_WITHIN = with_views("flatpoints", """
    select row_id, ref_id, round(d, 6) as distance from (
      select a.vec_id as row_id, b.vec_id as ref_id, sqrt(pow(a.x + 0.3 - b.x, 2) + pow(a.y - 0.2 - b.y, 2)) as d,
        row_number() over (partition by a.vec_id order by sqrt(pow(a.x + 0.3 - b.x, 2) + pow(a.y - 0.2 - b.y, 2)), b.vec_id) as rn
      from flatpoints a, flatpoints b) where rn = 1 and d < 0.8""")


@query("j8_nearest_within_radius", _WITHIN)
def j8(spark, folder):
    p = points(spark, folder)
    rows = p.select(c("vec_id").alias("row_id"), F.array(c("x") + 0.3, c("y") - 0.2).alias("xy"))
    refs = p.select(c("vec_id").alias("point_id"), F.array("x", "y").alias("xy"))
    return rounded(VE.nearest_within(rows, refs, 0.8))


@query("j8_grid_nearest", _WITHIN)
def j8g(spark, folder):
    p = points(spark, folder)
    rows = p.select(c("vec_id").alias("row_id"), (c("x") + 0.3).alias("x"), (c("y") - 0.2).alias("y"))
    return rounded(CE.nearest_on_grid(rows, p.withColumnRenamed("vec_id", "point_id"), 0.8))


def points(spark, folder):
    return V.refs(spark, folder).select(
        "vec_id", "cohort", VE.half_sum_projection().alias("p")
    ).select("vec_id", "cohort", "p.x", "p.y")


@query("m2_half_sum_projection", with_views(
    "flatpoints", "select vec_id, round(x, 6) as x, round(y, 6) as y from flatpoints"))
def m2f(spark, folder):
    return rounded(points(spark, folder).drop("cohort"))


@query("m2_principal_components")
def m2(spark, folder):
    refs = V.refs(spark, folder)
    fit = VE.fit_projection(refs, 2)
    return rounded(refs.select("vec_id", fit.apply().alias("p")).select(
        "vec_id", F.get("p", F.lit(0)).alias("pca_x"), F.get("p", F.lit(1)).alias("pca_y")))


@query("p10_viewport_filter", with_views("flatpoints", """
    select vec_id, round(x, 6) as x, round(y, 6) as y from flatpoints where x between 0.25 - 1.2 and 0.25 + 1.2 and y between -0.1 - 0.8 and -0.1 + 0.8"""))
def p10(spark, folder):
    from timbrel.operators.points import in_view

    return rounded(in_view(points(spark, folder), 0.25, -0.1).drop("cohort"))


@query("p11_stratum_subset", with_views("refs", """
    select vec_id, round(list_sum(embedding), 6) as checksum from refs where cohort = 1"""))
def p11(spark, folder):
    return V.refs(spark, folder).filter("cohort = 1").select(
        "vec_id", F.round(F.aggregate("embedding", F.lit(0.0), lambda a, v: a + v), 6)
        .alias("checksum"))


@query("a23_bounds", with_views("flatpoints", """
    select round(min(x) - 0.8::double, 6) as min_x, round(max(x) + 0.8::double, 6) as max_x, round(min(y) - 0.8::double, 6) as min_y, round(max(y) + 0.8::double, 6) as max_y from flatpoints"""))
def a23(spark, folder):
    from timbrel.operators.points import bounds

    return rounded(bounds(points(spark, folder)))


@query("m3_density_outlier", with_views("refs vec_long", f"""
    select vec_id, round(raw, 6) as raw, raw < thr as is_ood, round(thr, 6) as threshold, {even('''case when raw >= thr then greatest(0, least(50, 50 - greatest(1e-5, raw - thr) / 2 * 50))
        else least(100, 50 + (thr - raw) / 0.5::double * 50) end''', 1)} as probability
    from (select *, quantile_cont(raw, 0.05) over () as thr from (
      select a.vec_id, sum(0.05::double * exp(-g * (list_dot_product(a.embedding, a.embedding) + list_dot_product(b.embedding, b.embedding) - 2 * list_dot_product(a.embedding, b.embedding)))) as raw
      from refs a, refs b, (select 1.0 / (64 * var_pop(v)) as g from vec_long) group by a.vec_id))"""))
def m3(spark, folder):
    refs = V.refs(spark, folder)
    scores = VE.density_score(refs, refs, VE.kernel_width(refs), row_id="vec_id")
    threshold = VE.density_threshold(scores)
    return rounded(
        scores.withColumn("o", R.out_of_distribution(c("raw"), F.lit(threshold))).select(
            c("row_id").alias("vec_id"), "raw", c("o.is_ood").alias("is_ood"),
            F.lit(threshold).alias("threshold"), c("o.probability").alias("probability")))


@query("m1_standardise", with_views("vec_long", """
    select vec_id, i, round((v - avg(v) over w) / stddev_pop(v) over w, 6) as z from vec_long window w as (partition by i)"""))
def m1(spark, folder):
    refs = V.refs(spark, folder)
    fit = VE.fit_scaler(refs, "embedding")
    return rounded(refs.select("vec_id", F.posexplode(fit.apply("embedding")).alias("i", "z")))


@query("j12_label_lookup", with_views("attributions", f"""
    select a.vec_id, a.i, coalesce(l.label, a.name) as label from (select vec_id, i, case when i % 40 < {len(LABELS)} then n.name else 'f' || i end as name
      from attributions a left join names n on n.j = a.i % 40) a left join names l on l.name = a.name""",
    "names(j, name, label) as (values " + ", ".join(
        f"({j}, {q(n)}, {q(lab)})" for j, (n, lab) in enumerate(fixed.FEATURE_LABELS.items())) + ")"))
def j12(spark, folder):
    from timbrel.operators.models import display_labels

    names = F.array(*[F.lit(n) for n in fixed.FEATURE_LABELS])
    a = V.attributions(spark, folder).select(
        "vec_id", "i",
        F.when(c("i") % 40 < len(LABELS), F.get(names, (c("i") % 40).cast("int")))
        .otherwise(F.concat(F.lit("f"), c("i").cast("string"))).alias("name"))
    return display_labels(a).select("vec_id", "i", "label")


@query("a12_score_percentile", with_views("scores", """
    select round(quantile_cont(p, 0.05), 6) as p05, round(quantile_cont(p, 0.5), 6) as p50, round(quantile_cont(p, 0.95), 6) as p95 from scores"""))
def a12s(spark, folder):
    return rounded(quantiles(V.scores(spark, folder), [], "p",
                             {"p05": 0.05, "p50": 0.5, "p95": 0.95}))


