"""Queries over scans and sinks. Files are written to and read from the shared folder."""

from __future__ import annotations

from pyspark.sql import functions as F

from timbrel.functions import fixed
from timbrel.functions import rules as R
from timbrel.operators import metrics as ME
from timbrel.operators import models as MO
from timbrel.plans.evaluation import _AP, _AUC, _CONF, cv
from timbrel.plans.registry import query
from timbrel.plans.series import rounded
from timbrel.plans.sqltext import even
from timbrel.plans.vectors import points
from timbrel.sources import tables as TB
from timbrel.sources import views as V
from timbrel.sources.views import with_views

c = F.col
NAMES = fixed.VOICE_FEATURES


def voice_table(spark, folder):
    """The first 22 vector elements under the names of the voice feature table."""
    return V.refs(spark, folder).select(
        V.vec_name().alias("name"),
        *[F.get("embedding", F.lit(i)).alias(n) for i, n in enumerate(NAMES)],
        c("cohort").cast("int").alias("status"),
    )


_VOICE = ", ".join(
    f"round(embedding[{i + 1}]{' * 100' if n == 'jitter_pct' else ''}, 6) as {n}"
    for i, n in enumerate(TB.FEATURE_COLUMNS)
)


@query("s1_feature_csv_scan", with_views("refs", f"""
    select 'rec_S' || (vec_id % 32) || '_' || vec_id as name, {_VOICE}, cohort::int as status from refs"""))
def s1(spark, folder):
    path = TB.scratch(spark, "features")
    voice_table(spark, folder).write.option("header", True).csv(path)
    out = TB.read_features(spark, path)
    return out.select(
        "name", *[F.round(n, 6).alias(n) for n in TB.FEATURE_COLUMNS], "status")


@query("s2_point_scan", with_views("flatpoints", """
    select round(x, 6) as x, round(y, 6) as y, cohort::int as status from flatpoints"""))
def s2(spark, folder):
    path = TB.scratch(spark, "points")
    _write_points(spark, folder, path)
    got = TB.read_points(spark, path)
    absent = TB.read_points(spark, path + "-absent")
    return got.unionByName(absent).select(
        F.round("x", 6).alias("x"), F.round("y", 6).alias("y"), "status")


def _write_points(spark, folder, path):
    TB.write_points(points(spark, folder).select(
        c("x").alias("pca_x"), c("y").alias("pca_y"), c("cohort").alias("status")), path)


@query("s3_labelled_paths", """
    select page_id, path, case when page_id % 3 = 0 then 0 else 1 end::int as label from (
      select page_id, 'data/' || case page_id % 3 when 0 then 'healthy' when 1 then 'parkinsons' else 'other' end || '/rec_' || page_id || '.' || (['wav','mp3','webm','WAV'])[page_id % 4 + 1] as path from pages)
    where page_id % 3 < 2 and page_id % 4 in (0, 1, 3)""")
def s3(spark, folder):
    p = c("page_id")
    ext = F.element_at(F.array(*[F.lit(e) for e in ("wav", "mp3", "webm", "WAV")]),
                       (p % 4 + 1).cast("int"))
    where = F.when(p % 3 == 0, "healthy").when(p % 3 == 1, "parkinsons").otherwise("other")
    paths = V.table(spark, folder, "pages").select(
        "page_id", F.concat(F.lit("data/"), where, F.lit("/rec_"), p.cast("string"), F.lit("."),
                            ext).alias("path"))
    return TB.labelled_paths(paths)


@query("s4_drawing_catalogue", with_views("pools drawn", """
    select p.drawing_id, d.file_name, p.pool, p.subject, p.label from pools p join drawn d using (drawing_id)"""))
def s4(spark, folder):
    return TB.drawing_catalogue(V.drawings(spark, folder)).select(
        "drawing_id", "file_name", "pool", "subject", "label")


@query("s5_admission_filter", with_views("uploads", f"""
    select page_id, case when size > {fixed.MAX_UPLOAD} then 'too_large' when name is null or name = '' then 'no_name'
      when lower(string_split(name, '.')[-1]) not in ('wav', 'mp3', 'webm', 'ogg') then 'unsupported_format' end as reason from uploads"""))
def s5(spark, folder):
    return V.uploads(spark, folder).select(
        "page_id", R.admission(c("name"), c("size")).alias("reason"))


@query("s6_points_sink", with_views("flatpoints", """
    select round(x, 6) as pca_x, round(y, 6) as pca_y, cohort::int as status from flatpoints"""))
def s6(spark, folder):
    path = TB.scratch(spark, "points")
    for _ in range(2):  # the second write replaces the first
        _write_points(spark, folder, path)
    return rounded_points(spark.read.schema(TB.POINT_SCHEMA).option("header", True).csv(path))


def rounded_points(df):
    return df.select(F.round("pca_x", 6).alias("pca_x"), F.round("pca_y", 6).alias("pca_y"),
                     "status")


@query("s7_compute_or_reuse", with_views("series_ev", """
    select series_id, count(*) as n, round(avg(x) + 3.3e-8, 6) as mean from series_ev group by series_id"""))
def s7(spark, folder):
    path = TB.scratch(spark, "cache")

    def compute():
        return V.series_ev(spark, folder).groupBy("series_id").agg(
            F.count(F.lit(1)).alias("n"), (F.avg("x") + 3.3e-8).alias("mean"))

    TB.compute_or_reuse(spark, path, compute)
    again = TB.compute_or_reuse(spark, path, lambda: spark.range(0).toDF("never"))
    return rounded(again)


@query("s10_metrics_sink", with_views("cv", """
    select model, round(avg(accuracy), 6) as accuracy, round(avg(roc_auc), 6) as roc_auc, round(avg(pr_auc), 6) as pr_auc
    from conf join auc using (model, fold) join ap using (model, fold) group by model""",
    f"{_CONF}, {_AUC}, {_AP}"))
def s10(spark, folder):
    path = TB.scratch(spark, "metrics")
    m = ME.fold_average(ME.all_metrics(cv(spark, folder), ["model", "fold"]))
    TB.write_metrics(m, path, "model", ["accuracy", "roc_auc", "pr_auc"])
    doc = spark.read.text(path).select(
        F.from_json("value", "map<string, struct<accuracy: double, roc_auc: double, pr_auc: double>>")
        .alias("d"))
    return rounded(doc.select(F.explode("d").alias("model", "m")).select("model", "m.*"))


AS_OF_US = 1704672000000000  # 2024-01-08


@query("s11_retention_sweep", with_views("screenings", f"""
    select path, round(({AS_OF_US} - us) / 1e6, 6) as age_seconds from (
      select us, 'uploads/' || case when screening_id % 10 = 0 then '.' else '' end || 'f' || screening_id || '.wav' as path, screening_id from screenings)
    where screening_id % 10 <> 0 and ({AS_OF_US} - us) / 1e6 > 3600"""))
def s11(spark, folder):
    i = c("screening_id")
    files = V.screenings(spark, folder).select(
        F.concat(F.lit("uploads/"), F.when(i % 10 == 0, ".").otherwise(""), F.lit("f"),
                 i.cast("string"), F.lit(".wav")).alias("path"), "us")
    return rounded(TB.expired(files, AS_OF_US, c("us")).select("path", "age_seconds"))


@query("s12_request_log", with_views("requests", f"""
    select strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') as timestamp, 'POST' as method, '/screen/' || event_type as path, status as status_code,
      client::varchar as client_ip, {even('duration', 4)} as duration_seconds from requests"""))
def s12(spark, folder):
    path = TB.scratch(spark, "log")
    r = V.requests(spark, folder).select(
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("timestamp"),
        F.lit("POST").alias("method"), F.concat(F.lit("/screen/"), "event_type").alias("path"),
        c("status").alias("status_code"), c("client").cast("string").alias("client_ip"),
        c("duration").alias("duration_seconds"))
    TB.write_log(r, path)
    return TB.read_log(spark, path)


ALIGNED = ("HNR", "MDVP:Fo(Hz)", "PPE", "MDVP:Shimmer", "NHR")
_POS = {n: NAMES.index(n) + 1 for n in ALIGNED}
_ALL = {n: i for i, n in enumerate(NAMES, 1)}


@query("p5_align_features", with_views("refs", "select 'rec_S' || (vec_id % 32) || '_' || vec_id as name, " + ", ".join(
    f"embedding[{i}] as \"{n}\"" for n, i in _POS.items()) + " from refs"))
def p5(spark, folder):
    return MO.align(voice_table(spark, folder), ALIGNED, keep=["name"])


@query("p6_skew_transform", with_views("refs", "select 'rec_S' || (vec_id % 32) || '_' || vec_id as name, " + ", ".join(
    (f"round(ln(1 + greatest(embedding[{i}], 0)), 6)" if n in fixed.SKEWED_FEATURES else f"round(embedding[{i}], 6)") + f" as \"{n}\""
    for n, i in _ALL.items()) + " from refs"))
def p6(spark, folder):
    t = MO.skew_transform(MO.align(voice_table(spark, folder), list(_ALL), keep=["name"]))
    return t.select("name", *[F.round(f"`{n}`", 6).alias(n) for n in _ALL])
