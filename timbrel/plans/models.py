"""Queries that fit or apply models on the vector features."""

from __future__ import annotations

from pyspark.sql import functions as F

from timbrel.functions import rules as R
from timbrel.functions.scalars import quadratic_form
from timbrel.operators import coalitions as CO
from timbrel.operators import kernels as KE
from timbrel.operators import metrics as ME
from timbrel.operators import models as MO
from timbrel.operators import splits as SP
from timbrel.operators import trees as TR
from timbrel.operators import vectors as VE
from timbrel.operators.spectral import constant_rows
from timbrel.plans.evaluation import labelled
from timbrel.plans.registry import query
from timbrel.plans.series import rounded
from timbrel.plans.vectors import _COEF_SQL, COEFS
from timbrel.session import materialise
from timbrel.sources import tables as TB
from timbrel.sources import views as V
from timbrel.sources.views import with_views

c = F.col
FOLDS = 3


def folded(spark, folder):
    return materialise(
        SP.group_folds(labelled(spark, folder), "vec_id", FOLDS, label="y")
    )


@query("m19_batch_scoring", with_views("vec_long", """
    select vec_id, round(1 / (1 + exp(-z)), 6) as p, (1 / (1 + exp(-z)) >= 0.5)::bigint as status from (
      select vec_id, sum(w * s) + 0.25 as z from (
        select vec_id, i, (l - avg(l) over (partition by i)) / stddev_pop(l) over (partition by i) as s from (
          select vec_id, i, case when i % 3 = 0 then ln(1 + greatest(v, 0)) else v end as l from vec_long)) join coef using (i) group by vec_id)""", _COEF_SQL))
def m19(spark, folder):
    """Skewed features through log1p, population scaling, fixed coefficients."""
    logged = labelled(spark, folder).withColumn(
        "features",
        F.transform("features", lambda v, i: F.when(
            i % 3 == 0, F.log1p(F.greatest(v, F.lit(0.0)))).otherwise(v)))
    scaler = VE.fit_scaler(logged)
    return rounded(MO.linear_score(logged, scaler, 0.25, COEFS).select("vec_id", "p", "status"))


@query("m18_linear_attributions", with_views("vec_long", """
    select vec_id, i, round(w * (v - avg(v) over (partition by i)), 6) as value from vec_long join coef using (i)""", _COEF_SQL))
def m18(spark, folder):
    rows = labelled(spark, folder)
    mean = list(VE.mean_vector(rows, [], "features").first()["vector"])
    return rounded(MO.linear_attributions(rows, "vec_id", COEFS, mean))


@query("m18_sampled_attributions")
def m18s(spark, folder):
    rows = labelled(spark, folder)
    scaler = VE.fit_scaler(rows)
    model = MO.estimators()["random_forest"].fit(MO.prepared(rows, scaler))
    base = MO.background(rows.withColumn("features", scaler.apply()))
    scaled = rows.select("vec_id", scaler.apply().alias("features"))
    return rounded(MO.sampled_attributions(scaled, "vec_id", MO.probability(model), base))


@query("m5_l1_selection")
def m5(spark, folder):
    return rounded(MO.top_coefficients(MO.l1_selection(labelled(spark, folder))))


def rounded_vector(vec: str):
    return F.transform(vec, lambda v: F.round(v, 6)).alias(vec)


@query("m9_minority_oversampling")
def m9(spark, folder):
    """The synthetic rows themselves."""
    made = SP.oversample(V.refs(spark, folder))
    return made.select("source", c("copy").cast("long").alias("copy"), "cohort", rounded_vector("embedding"))


@query("m10_random_search")
def m10(spark, folder):
    rows = folded(spark, folder)
    forest, grid = MO.forest_grid()
    ready = MO.prepared(rows, VE.fit_scaler(rows), ME.class_weights(rows))
    best, _ = MO.random_search(ready, forest, grid, 2)
    return rounded(MO.probability(best)(ready).select("vec_id", "y", "p"))


@query("m11_classifiers")
def m11(spark, folder):
    rows = labelled(spark, folder)
    split = SP.stratified_split(rows, "vec_id")
    train, test = split.filter(~c("test")), split.filter("test")
    scaler = VE.fit_scaler(train)
    weights = ME.class_weights(train)
    parts = []
    for name, est in MO.estimators().items():
        model = est.fit(MO.prepared(train, scaler, weights))
        parts.append(MO.probability(model)(MO.prepared(test, scaler)).select(
            F.lit(name).alias("model"), "vec_id", "y", "p"))
    even = MO.estimators()["random_forest"].fit(
        MO.prepared(MO.balanced_sample(train), scaler))
    parts.append(MO.probability(even)(MO.prepared(test, scaler)).select(
        F.lit("balanced_forest").alias("model"), "vec_id", "y", "p"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return rounded(out)


def split_and_scaled(spark, folder):
    """(train, test) with features scaled by the training rows."""
    rows = SP.stratified_split(labelled(spark, folder), "vec_id")
    scaler = VE.fit_scaler(rows.filter(~c("test")))
    rows = materialise(rows.select("vec_id", "subject", "y", "test", scaler.apply().alias("features")), "split")
    return rows.filter(~c("test")), rows.filter("test")


@query("m11_kernel_margin")
def m11_kernel(spark, folder):
    """Held-out margins of a Gaussian-kernel machine; 512 landmarks hold every training row at the small scales."""
    train, test = split_and_scaled(spark, folder)
    return rounded(KE.fit_margin(train).score(test).select("vec_id", "y", "margin"))


@query("m11_regularised_boosting")
def m11_boosting(spark, folder):
    """Held-out scores of second-order boosting, the larger class weighted down as the reference does."""
    train, test = split_and_scaled(spark, folder)
    sizes = {r["y"]: r["count"] for r in train.groupBy("y").count().collect()}
    spec = TR.Boosting(positive_weight=sizes.get(0, 1) / max(1, sizes.get(1, 1)))
    return rounded(TR.boosted_probability(test, TR.boost(train, spec)).select("vec_id", "y", "p"))


@query("m11_balanced_forest")
def m11_forest(spark, folder):
    """Held-out scores of 200 trees, each grown on its own class-balanced draw."""
    train, test = split_and_scaled(spark, folder)
    return rounded(TR.forest_probability(test, TR.balanced_forest(train)).select("vec_id", "y", "p"))


@query("m10_kernel_search")
def m10_kernel(spark, folder):
    """Mean area under the curve of all 70 cells of the kernel margin's grid over subject folds; the reference draws 30 of them."""
    rows = folded(spark, folder)
    scaler = VE.fit_scaler(rows)
    ready = materialise(rows.withColumn("features", scaler.apply()), "ready")
    return rounded(KE.search_margin(ready, KE.GRID))


@query("m18_coalition_attributions")
def m18_coalitions(spark, folder):
    """Attributions of the kernel machine's score over ten weighted centres, 2 d + 2048 shared coalitions."""
    rows = labelled(spark, folder)
    scaled = materialise(rows.select("vec_id", "y", VE.fit_scaler(rows).apply().alias("features")), "scaled")
    model = KE.fit_margin(scaled, landmarks=128)
    base = MO.background(scaled)
    d = len(base[0][0])
    return rounded(CO.kernel_attributions(scaled, "vec_id", KE.KernelProbability(model), base, most=2 * d + 2048))


@query("m3_fitted_density")
def m3_fitted(spark, folder):
    """Outlier scores under fitted one-class weights, with the 5th percentile as threshold."""
    refs = V.refs(spark, folder)
    scores = materialise(KE.one_class(refs).score(refs).select("vec_id", "raw"), "density")
    threshold = VE.density_threshold(scores)
    return rounded(scores.withColumn("o", R.out_of_distribution(c("raw"), F.lit(threshold))).select(
        "vec_id", "raw", c("o.is_ood").alias("is_ood"), F.lit(threshold).alias("threshold"), c("o.probability").alias("probability")))


@query("m12_calibration")
def m12(spark, folder):
    rows = labelled(spark, folder)
    return rounded(MO.calibrated_scores(rows, rows, "vec_id"))


@query("m14_stacking")
def m14(spark, folder):
    _, scores = MO.stacked(folded(spark, folder), FOLDS, "vec_id", ["margin", "random_forest"])
    return rounded(scores)


@query("m15_benchmark_table")
def m15(spark, folder):
    return rounded(MO.benchmark(folded(spark, folder), FOLDS, "vec_id"))


@query("m17_background_summary")
def m17(spark, folder):
    """The ten centres with their shares of the rows."""
    rows = labelled(spark, folder)
    base = MO.background(rows)
    parts = F.array(*[
        F.struct(F.lit(n).cast("long").alias("centre"), F.lit(float(share)).alias("share"), VE.constant_vector(vector).alias("vector"))
        for n, (vector, share) in enumerate(base)])
    out = rows.agg(F.count(F.lit(1)).alias("n")).select("n", F.inline(parts))
    return rounded(out.select("n", "centre", "share", rounded_vector("vector")))


REDUCED = 16


def reduced(spark, folder):
    refs = V.refs(spark, folder)
    fit = VE.fit_projection(refs, REDUCED)
    return refs.select("vec_id", "cohort", fit.apply().alias("reduced"))


@query("a4_shrunk_mahalanobis")
def a4s(spark, folder):
    """Distance to both cohorts under shrunk covariances in reduced space."""
    rows = reduced(spark, folder)
    models = VE.shrunk_inverses(rows, "cohort", "reduced")
    out = rows.select("vec_id", "reduced")
    for cohort, (mean, inverse) in sorted(models.items()):
        diff = VE.minus(c("reduced"), VE.constant_vector(mean))
        out = out.withColumn(
            f"distance_{cohort}", F.sqrt(quadratic_form(diff, constant_rows(inverse))))
    return rounded(out.drop("reduced"))


def build_references(spark, rows, path: str) -> dict[str, str]:
    """Write the reference assets of a cohort table (vec_id, cohort, embedding) as tables."""
    at = {n: f"{path}/{n}" for n in ("centroids", "covariances", "density")}
    VE.mean_vector(rows, ["cohort"]).write.parquet(at["centroids"])
    fit = VE.fit_projection(rows, REDUCED)
    low = rows.select("cohort", fit.apply().alias("reduced"))
    models = VE.shrunk_inverses(low, "cohort", "reduced")
    spark.createDataFrame(
        [(k, m.tolist(), [r.tolist() for r in inv]) for k, (m, inv) in models.items()],
        "cohort long, mean array<double>, inverse array<array<double>>",
    ).write.parquet(at["covariances"])
    gamma = VE.kernel_width(rows)
    scores = VE.density_score(rows, rows, gamma, row_id="vec_id")
    spark.createDataFrame(
        [(gamma, VE.density_threshold(scores))], "gamma double, threshold double"
    ).write.parquet(at["density"])
    return at


@query("m20_reference_assets")
def m20(spark, folder):
    """The written assets read back: centroid, reduced mean, inverse covariance, kernel width and threshold per cohort."""
    at = build_references(spark, V.refs(spark, folder), TB.scratch(spark, "references"))
    density = spark.read.parquet(at["density"])
    return rounded(
        spark.read.parquet(at["centroids"]).select("cohort", "n", c("vector").alias("centroid"))
        .join(spark.read.parquet(at["covariances"]), "cohort")
        .join(density.withColumn("cohort", F.explode(F.array(
            F.lit(0).cast("long"), F.lit(1).cast("long")))), "cohort"))
