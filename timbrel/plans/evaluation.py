"""Queries of metrics, splits, folds, sets and joins over drawings and scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from timbrel.functions import scalars as S
from timbrel.operators import metrics as ME
from timbrel.operators import models as MO
from timbrel.operators import splits as SP
from timbrel.plans.registry import query
from timbrel.plans.rules import drawn
from timbrel.plans.series import rounded
from timbrel.session import materialise
from timbrel.sources import views as V
from timbrel.sources.views import with_views

c = F.col

# --- metrics ------------------------------------------------------------------------------


@query("a1_class_balance", with_views("scores", """
    select sum(y)::bigint as n_pos, sum(1 - y)::bigint as n_neg, round(sum(y) / sum(1 - y), 6) as pos_ratio, round(sum(1 - y) / sum(y), 6) as pos_weight from scores"""))
def a1(spark, folder):
    return rounded(ME.class_balance(V.scores(spark, folder)))


# three score variants over five folds stand for the models of a benchmark
V.CTE["cv"] = (("scores",), """
    select s.doc_id, s.y, m.model, m.ord, s.doc_id % 5 as fold,
      case m.model when 'plain' then p when 'folded' then p * 7 % 1 else 1 - abs(0.5 - p) end as p
    from scores s, (values ('plain', 0), ('folded', 1), ('middle', 2)) m(model, ord)""")


def cv(spark, folder):
    p = c("p")
    variants = F.array(
        *[
            F.struct(F.lit(n).alias("model"), F.lit(i).alias("ord"), v.alias("p"))
            for i, (n, v) in enumerate(
                (("plain", p), ("folded", p * 7 % 1), ("middle", 1 - F.abs(0.5 - p)))
            )
        ]
    )
    return V.scores(spark, folder).select(
        "doc_id", "y", (c("doc_id") % 5).alias("fold"), F.explode(variants).alias("v")
    ).select("doc_id", "y", "fold", "v.*")


_CONF = """conf as (select model, fold, tp, fp, fn, tn, (tp + tn) / (tp + fp + fn + tn) as accuracy,
      case when tp + fp = 0 then 0 else tp / (tp + fp) end as precision, case when tp + fn = 0 then 0 else tp / (tp + fn) end as recall,
      case when 2 * tp + fp + fn = 0 then 0 else 2 * tp / (2 * tp + fp + fn) end as f1 from (
      select model, fold, count(*) filter (y = 1 and p >= 0.5) as tp, count(*) filter (y = 0 and p >= 0.5) as fp,
        count(*) filter (y = 1 and p < 0.5) as fn, count(*) filter (y = 0 and p < 0.5) as tn from cv group by model, fold))"""
_AUC = """auc as (select model, fold, coalesce(sum(case when y = 1 then r end) - sum(y) * (sum(y) + 1) / 2.0, 0) / (sum(y) * sum(1 - y)) as roc_auc from (
      select *, rank() over (partition by model, fold order by p) + (count(*) over (partition by model, fold, p) - 1) / 2.0 as r from cv) group by model, fold)"""
_AP = """ap as (select model, fold, sum(pos * tp / (tp + fp)) / sum(pos) as pr_auc from (
      select *, sum(pos) over w as tp, sum(neg) over w as fp from (select model, fold, p, sum(y) as pos, sum(1 - y) as neg from cv group by model, fold, p)
      window w as (partition by model, fold order by p desc)) group by model, fold)"""
_LOSS = """losses as (select model, fold, avg(-(y * case when p > 0 then greatest(ln(case when p > 0 then p end), -100) else -100 end
      + (1 - y) * case when p < 1 then greatest(ln(case when p < 1 then 1 - p end), -100) else -100 end)) as loss from cv group by model, fold)"""


@query("a8_confusion_metrics", with_views("cv", """
    select model, fold, round(accuracy, 6) as accuracy, round(precision, 6) as precision, round(recall, 6) as recall, round(f1, 6) as f1 from conf""", _CONF))
def a8(spark, folder):
    return rounded(ME.confusion_metrics(cv(spark, folder), ["model", "fold"]))


@query("a9_roc_auc", with_views("cv", "select model, fold, round(roc_auc, 6) as roc_auc from auc", _AUC))
def a9(spark, folder):
    return rounded(ME.roc_auc(cv(spark, folder), ["model", "fold"]))


@query("a10_average_precision", with_views(
    "cv", "select model, fold, round(pr_auc, 6) as pr_auc from ap", _AP))
def a10(spark, folder):
    return rounded(ME.average_precision(cv(spark, folder), ["model", "fold"]))


_AVG = """select model, round(avg(accuracy), 6) as accuracy, round(avg(precision), 6) as precision, round(avg(recall), 6) as recall,
    round(avg(f1), 6) as f1, round(avg(roc_auc), 6) as roc_auc, round(avg(pr_auc), 6) as pr_auc
    from conf join auc using (model, fold) join ap using (model, fold) group by model"""


@query("a7_fold_average", with_views("cv", _AVG, f"{_CONF}, {_AUC}, {_AP}"))
def a7(spark, folder):
    return rounded(ME.fold_average(ME.all_metrics(cv(spark, folder), ["model", "fold"])))


@query("a11_best_model", with_views("cv", """
    select model as best, round(a, 6) as roc_auc from (select model, avg(roc_auc) as a from auc group by model)
    join (select distinct model, ord from cv) using (model) order by a desc, ord limit 1""", _AUC))
def a11(spark, folder):
    rows = cv(spark, folder)
    averaged = ME.fold_average(ME.roc_auc(rows, ["model", "fold"]))
    return rounded(ME.best_model(averaged.join(rows.select("model", "ord").distinct(), "model")))


@query("a28_log_loss", with_views(
    "cv", "select model, fold, round(loss, 6) as loss from losses", _LOSS))
def a28(spark, folder):
    return rounded(ME.log_loss(cv(spark, folder), ["model", "fold"]))


@query("a29_best_fold", with_views("cv", """
    select model, fold as best_fold, round(loss, 6) as loss from losses qualify row_number() over (partition by model order by loss, fold) = 1""", _LOSS))
def a29(spark, folder):
    return rounded(ME.best_fold(ME.log_loss(cv(spark, folder), ["model", "fold"]), ["model"]))


@query("m13_soft_voting", with_views(
    "cv", "select doc_id, round(avg(p), 6) as p from cv group by doc_id"))
def m13(spark, folder):
    rows = cv(spark, folder)
    parts = [rows.filter(c("model") == m) for m in ("plain", "folded", "middle")]
    return rounded(MO.soft_vote(parts, "doc_id"))


@query("m4_class_weights", with_views("scores", """
    select doc_id, round(count(*) over () / (2.0 * count(*) over (partition by y)), 6) as weight from scores"""))
def m4(spark, folder):
    s = V.scores(spark, folder)
    return rounded(MO.prepared(s.withColumn("features", F.array("p")),
                               weights=ME.class_weights(s)).select("doc_id", "weight"))


# --- drawings: pools, subjects, joins, sets ----------------------------------------------------


def pools(spark, folder):
    return drawn(spark, folder).select(
        "drawing_id", "label", "p", "subject",
        F.explode_outer(S.drawing_pools(c("kind"))).alias("pool"),
    ).filter(c("pool").isNotNull())


V.CTE["pools"] = (("drawn",), """
    select drawing_id, label, p, subject, pool from (
      select *, unnest(case kind when 'both' then ['spiral', 'wave'] when 'unknown' then []::varchar[] else [kind] end) as pool from drawn)""")
V.CTE["subject_scores"] = (("pools",), """
    select pool, subject, avg(p) as score, arg_max(label, drawing_id) as label from pools group by pool, subject""")


def pool_scores(spark, folder, pool):
    return ME.subject_scores(pools(spark, folder).filter(c("pool") == pool), "drawing_id")


@query("p7_pool_fan_out",
       with_views("pools", "select drawing_id, subject, pool, label from pools"))
def p7(spark, folder):
    return pools(spark, folder).select("drawing_id", "subject", "pool", "label")


@query("a2_pool_summary", with_views("pools", """
    select pool, count(*) as n_total, sum(label)::bigint as n_pd, sum(1 - label)::bigint as n_healthy, count(distinct subject) as subjects,
      count(distinct subject) filter (label = 1) as pd_subjects, count(distinct subject) filter (label = 0) as healthy_subjects,
      round(sum(label) / sum(1 - label), 6) as ratio from pools group by pool"""))
def a2(spark, folder):
    return rounded(ME.pool_summary(pools(spark, folder)))


@query("a5_subject_scores", with_views("subject_scores", """
    select pool, subject, round(score, 6) as score, label from subject_scores"""))
def a5(spark, folder):
    return rounded(ME.subject_scores(pools(spark, folder), "drawing_id", keys=["pool"]))


@query("a24_distinct_subjects", with_views("refs", """
    select count(distinct vec_id % 32) as subjects, count(distinct vec_id % 32) >= 10 as by_subject from refs"""))
def a24(spark, folder):
    s = V.refs(spark, folder).select(V.subject_of(c("vec_id")).alias("subject"))
    return s.agg(F.countDistinct("subject").alias("subjects")).withColumn(
        "by_subject", c("subjects") >= SP.MIN_SUBJECTS
    )


@query("j4_inner_score_join", with_views("subject_scores", """
    select subject, round(s.score, 6) as spiral, round(w.score, 6) as wave, s.label from
      (select * from subject_scores where pool = 'spiral') s join (select * from subject_scores where pool = 'wave') w using (subject)"""))
def j4(spark, folder):
    return rounded(score_pairs(spark, folder, "inner"))


def score_pairs(spark, folder, how):
    """Subject scores of both pools side by side; a missing one counts 0.5."""
    left = pool_scores(spark, folder, "spiral").select(
        "subject", c("score").alias("spiral"), c("label").alias("l1"))
    right = pool_scores(spark, folder, "wave").select(
        "subject", c("score").alias("wave"), c("label").alias("l2"))
    return left.join(right, "subject", how).select(
        "subject", F.coalesce("spiral", F.lit(0.5)).alias("spiral"),
        F.coalesce("wave", F.lit(0.5)).alias("wave"), F.coalesce("l1", "l2").alias("label"))


@query("j5_full_score_join", with_views("subject_scores", """
    select subject, round(coalesce(s.score, 0.5), 6) as spiral, round(coalesce(w.score, 0.5), 6) as wave, coalesce(s.label, w.label) as label from
      (select * from subject_scores where pool = 'spiral') s full join (select * from subject_scores where pool = 'wave') w using (subject)"""))
def j5(spark, folder):
    return rounded(score_pairs(spark, folder, "full"))


_HELD = """held as (select distinct pool, subject from (
      select pool, subject, label, row_number() over (partition by pool, label order by md5(subject || ':42'), subject) - 1 as r, count(*) over (partition by pool, label) as n
      from (select distinct pool, subject, label from pools)) where r < greatest(1, floor(n * 0.2)))"""
POOLS = ("spiral", "wave")


def each_pool(spark, folder, fn):
    """``fn`` of the rows of each pool, together and with the pool's name."""
    rows = materialise(pools(spark, folder), "pools")
    parts = [fn(rows.filter(c("pool") == p)).withColumn("pool", F.lit(p)) for p in POOLS]
    return parts[0].unionByName(parts[1])


@query("j6_semi_anti_split", with_views("pools", """
    select pool, drawing_id, subject, (pool, subject) in (select (pool, subject) from held) as test from pools""", _HELD))
def j6(spark, folder):
    def split(rows):
        train, test = SP.subject_split(rows, SP.test_subjects(rows))
        return train.withColumn("test", F.lit(False)).unionByName(
            test.withColumn("test", F.lit(True))).select("drawing_id", "subject", "test")

    return each_pool(spark, folder, split)


@query("m7_subject_level_split", with_views("pools", """
    select pool, subject, label, (pool, subject) in (select (pool, subject) from held) as test, count(*) as n from pools group by pool, subject, label""", _HELD))
def m7(spark, folder):
    def split(rows):
        held = SP.test_subjects(rows).withColumn("test", F.lit(True))
        counts = rows.groupBy("subject", "label").agg(F.count(F.lit(1)).alias("n"))
        return counts.join(held, "subject", "left").withColumn(
            "test", F.coalesce("test", F.lit(False)))

    return each_pool(spark, folder, split)


@query("m6_stratified_split", with_views("scores", """
    select doc_id, y, r < floor(n * 0.2) as test from (select *, row_number() over (partition by y order by md5(doc_id || ':42'), doc_id) - 1 as r,
      count(*) over (partition by y) as n from scores)"""))
def m6(spark, folder):
    return SP.stratified_split(V.scores(spark, folder), "doc_id").select("doc_id", "y", "test")


V.CTE["folded"] = (("refs",), """
    select r.vec_id, r.vec_id % 32 as subject, r.cohort, case when k % 10 < 5 then k % 10 else 9 - k % 10 end as fold from refs r join (
      select subject, row_number() over (partition by class order by n desc, md5(subject || ':42'), subject) - 1 as k from (
        select vec_id % 32 as subject, (avg(cohort) >= 0.5)::bigint as class, count(*) as n from refs group by vec_id % 32)) s on r.vec_id % 32 = s.subject""")


def labelled(spark, folder):
    """(vec_id, subject, y, features)."""
    return V.refs(spark, folder).select(
        "vec_id", V.subject_of(c("vec_id")).alias("subject"), c("cohort").alias("y"),
        c("embedding").alias("features"))


@query("m8_group_folds", with_views(
    "folded", "select vec_id, subject, cohort as y, fold::bigint as fold from folded"))
def m8(spark, folder):
    folds = SP.group_folds(labelled(spark, folder), "vec_id", label="y")
    return folds.select("vec_id", "subject", "y", c("fold").cast("long").alias("fold"))


@query("m16_score_fusion", with_views("subject_scores", """
    select subject, round(1 / (1 + exp(-(-1.5 + 1.2::double * s.score + 1.8::double * w.score))), 6) as p from
      (select * from subject_scores where pool = 'spiral') s join (select * from subject_scores where pool = 'wave') w using (subject)"""))
def m16(spark, folder):
    pairs = score_pairs(spark, folder, "inner")
    return rounded(pairs.select(
        "subject", MO.logistic(-1.5, [1.2, 1.8], [c("spiral"), c("wave")]).alias("p")))


@query("m16_fitted_fusion")
def m16f(spark, folder):
    """The fusion fitted on the paired scores, then applied to them."""
    pairs = score_pairs(spark, folder, "full")
    intercept, coefs = MO.fit_fusion(pairs, ["spiral", "wave"])
    return rounded(pairs.select(
        "subject", "label", MO.logistic(intercept, coefs, [c("spiral"), c("wave")]).alias("p")))


# --- sets -----------------------------------------------------------------------------------


def subjects(spark, folder, pool):
    return pools(spark, folder).filter(c("pool") == pool).select("subject")


_SETS = """sp as (select subject from pools where pool = 'spiral'), wv as (select subject from pools where pool = 'wave')"""


@query("u1_shared_subjects", with_views(
    "pools", "select subject from sp intersect select subject from wv", _SETS))
def u1(spark, folder):
    return subjects(spark, folder, "spiral").intersect(subjects(spark, folder, "wave"))


@query("u2_union_subjects", with_views(
    "pools", "select subject from sp union select subject from wv", _SETS))
def u2(spark, folder):
    return subjects(spark, folder, "spiral").union(subjects(spark, folder, "wave")).distinct()


@query("u3_except_subjects", with_views(
    "pools", "select pool, subject from pools except select pool, subject from held", _HELD))
def u3(spark, folder):
    return each_pool(
        spark, folder, lambda rows: rows.select("subject").subtract(SP.test_subjects(rows)))


@query("u4_subjects_per_class", with_views("pools", """
    select pool, label, count(*) as n, min(subject) as first, max(subject) as last from (select distinct pool, label, subject from pools) group by pool, label"""))
def u4(spark, folder):
    rows = pools(spark, folder)
    return rows.select("pool", "label", "subject").distinct().groupBy("pool", "label").agg(
        F.count(F.lit(1)).alias("n"), F.min("subject").alias("first"),
        F.max("subject").alias("last"))


@query("u5_concatenated_pools", with_views("drawn", """
    select collection, kind, count(*) as n, sum(label)::bigint as n_pd from drawn group by collection, kind"""))
def u5(spark, folder):
    d = drawn(spark, folder)
    parts = [d.filter(c("collection") == x) for x in ("coded", "numbered", "tagged")]
    whole = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return whole.groupBy("collection", "kind").agg(
        F.count(F.lit(1)).alias("n"), F.sum("label").alias("n_pd"))
