"""Training, calibration, ensembles and attributions on ``pyspark.ml``.

Feature tables carry (ident, subject, y, features array<double>). Scaling, selection and
oversampling are fitted inside the training folds; ``global_fit`` reproduces the leaky variant
that fits the scaler on all rows first.
"""

from __future__ import annotations

import random
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.ml import Estimator
from pyspark.ml.classification import (
    GBTClassifier,
    LinearSVC,
    LogisticRegression,
    RandomForestClassifier,
)
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from timbrel.functions import fixed
from timbrel.functions.scalars import clamp, dot
from timbrel.operators.metrics import all_metrics, class_weights, fold_average
from timbrel.operators.splits import oversample, scatter
from timbrel.operators.vectors import Scaler, constant_vector, fit_scaler
from timbrel.session import materialise

SELECTED = 12
SELECTION_LIMIT = 1e-5


# --- preparation ------------------------------------------------------------------------------


def align(df: DataFrame, names: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """The trained features in trained order; a missing one is an error."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing features: {missing}")
    return df.select(*keep, *[F.col(f"`{n}`") for n in names])


def skew_transform(df: DataFrame, skewed: Sequence[str] = fixed.SKEWED_FEATURES) -> DataFrame:
    """log1p(max(x, 0)) on the skewed columns that are present."""
    chosen = set(skewed)
    return df.select(
        *[
            F.log1p(clamp(F.col(f"`{n}`"), 0.0, float("inf"))).alias(n)
            if n in chosen
            else F.col(f"`{n}`")
            for n in df.columns
        ]
    )


def prepared(df: DataFrame, scaler: Scaler | None = None, weights: dict | None = None):
    """Attach ``label``, ``vector`` (scaled) and ``weight`` for the estimators."""
    v = scaler.apply("features") if scaler else F.col("features")
    w = F.lit(1.0)
    for cls, value in (weights or {}).items():
        w = F.when(F.col("y") == cls, value).otherwise(w)
    return df.withColumns(
        {"label": F.col("y").cast("double"), "vector": array_to_vector(v), "weight": w}
    )


def probability(model) -> Callable[[DataFrame], DataFrame]:
    """Scorer attaching ``p``: class-1 probability, or a logistic of the margin."""

    def score(df: DataFrame) -> DataFrame:
        out = model.transform(df)
        if "probability" in out.columns:
            p = vector_to_array("probability")[1]
        else:
            p = 1.0 / (1.0 + F.exp(-vector_to_array("rawPrediction")[1]))
        return out.withColumn("p", p).drop("rawPrediction", "probability", "prediction")

    return score


# --- estimators -----------------------------------------------------------------------------


def estimators(seed: int = 42) -> dict[str, Estimator]:
    """Linear margin, random forest and gradient boosting."""
    cols = {"featuresCol": "vector", "labelCol": "label"}
    return {
        "margin": LinearSVC(**cols, weightCol="weight", maxIter=20, regParam=0.01),
        "random_forest": RandomForestClassifier(
            **cols, weightCol="weight", numTrees=20, maxDepth=5, seed=seed
        ),
        "gradient_boosting": GBTClassifier(
            **cols, weightCol="weight", maxIter=10, maxDepth=3, seed=seed
        ),
    }


def balanced_sample(df: DataFrame, seed: int = 42) -> DataFrame:
    """Rows sampled per class so that the expected class sizes are even."""
    sizes = {r["y"]: r["count"] for r in df.groupBy("y").count().collect()}
    low = min(sizes.values())
    return df.sampleBy("y", {k: low / n for k, n in sizes.items()}, seed)


def l1_selection(df: DataFrame, c: float = 0.8) -> DataFrame:
    """(i, coef) of an L1 logistic fit with balanced weights on standardised features."""
    scaler = fit_scaler(df)
    n = df.count()
    lr = LogisticRegression(
        featuresCol="vector", labelCol="label", weightCol="weight", elasticNetParam=1.0,
        regParam=1.0 / (c * n), standardization=False, maxIter=100,
    )
    model = lr.fit(prepared(df, scaler, class_weights(df)))
    coefs = model.coefficients.toArray().tolist()
    return df.sparkSession.range(1).select(
        F.posexplode(constant_vector(coefs)).alias("i", "coef")
    )


def top_coefficients(coefs: DataFrame, n: int = SELECTED) -> DataFrame:
    """The n strongest coefficients that reach the selection threshold, with their rank."""
    size = F.abs("coef")
    best = coefs.filter(size >= SELECTION_LIMIT).orderBy(size.desc(), "i").limit(n)
    return best.withColumn(
        "rank", F.row_number().over(Window.orderBy(size.desc(), "i")).cast("long")
    )


def random_search(
    df: DataFrame, estimator: Estimator, grid: list[dict], tries: int, fold: str = "fold",
    seed: int = 42, parallelism: int = 4,
):
    """Seeded draw of parameter maps, compared by ROC-AUC over the given folds.

    Returns (best model, [(params, mean auc)]).
    """
    maps = random.Random(seed).sample(grid, min(tries, len(grid)))
    folds = df.agg(F.max(fold)).first()[0] + 1
    search = CrossValidator(
        estimator=estimator, estimatorParamMaps=maps,
        evaluator=BinaryClassificationEvaluator(labelCol="label", weightCol="weight"),
        numFolds=int(folds), foldCol=fold, parallelism=parallelism, seed=seed,
    )
    fitted = search.fit(df.withColumn(fold, F.col(fold).cast("int")))
    named = [{p.name: v for p, v in m.items()} for m in maps]
    return fitted.bestModel, list(zip(named, fitted.avgMetrics))


def forest_grid(seed: int = 42) -> tuple[Estimator, list[dict]]:
    forest = estimators(seed)["random_forest"]
    grid = (
        ParamGridBuilder()
        .addGrid(forest.numTrees, [10, 20])
        .addGrid(forest.maxDepth, [3, 5])
        .build()
    )
    return forest, grid


# --- cross-validation, calibration, ensembles ---------------------------------------------------


def fold_scores(
    df: DataFrame, models: dict[str, Estimator], folds: int, ident: str, smote: bool = False,
    global_fit: bool = False,
) -> DataFrame:
    """Out-of-fold scores (model, ident, fold, y, p).

    Scaler, class weights and oversampling are fitted on the training side of each fold; its
    prepared rows are stored once and every model is fitted on them.
    """
    whole = fit_scaler(df) if global_fit else None
    parts = []
    for k in range(folds):
        train, held = df.filter(F.col("fold") != k), df.filter(F.col("fold") == k)
        scaler = whole or fit_scaler(train)
        rows = train.select("y", "features")
        if smote:
            made = oversample(train, ident, "y", "features").select("y", "features")
            rows = materialise(rows.unionByName(made), "train")
        ready = prepared(rows, scaler, None if smote else class_weights(rows))
        for name, estimator in models.items():
            model = estimator.copy().fit(ready)
            scored = probability(model)(prepared(held, scaler))
            parts.append(scored.select(F.lit(name).alias("model"), ident, "fold", "y", "p"))
    return reduce(DataFrame.unionByName, parts)


def benchmark(
    df: DataFrame, folds: int, ident: str, models: dict[str, Estimator] | None = None,
    smote: bool = True,
) -> DataFrame:
    """(model, ord, accuracy, precision, recall, f1, roc_auc, pr_auc) averaged over folds."""
    models = models or estimators()
    scores = materialise(fold_scores(df, models, folds, ident, smote), "scores")
    order = F.array_position(F.array(*[F.lit(n) for n in models]), F.col("model")) - 1
    averaged = fold_average(all_metrics(scores, ["model", "fold"]))
    return averaged.withColumn("ord", order)


def calibrated_scores(
    df: DataFrame, train: DataFrame, ident: str, folds: int = 3, seed: int = 42
) -> DataFrame:
    """(ident, p): sigmoid calibration, one margin model per fold, averaged."""
    dealt = train.withColumn(
        "_k", F.conv(F.substring(scatter(ident, seed), 1, 6), 16, 10).cast("long") % folds
    )
    parts = []
    for k in range(folds):
        rest, held = dealt.filter(F.col("_k") != k), dealt.filter(F.col("_k") == k)
        scaler = fit_scaler(rest)
        margin = estimators(seed)["margin"].fit(prepared(rest, scaler, class_weights(rest)))

        def with_margin(rows: DataFrame, scaler=scaler, margin=margin) -> DataFrame:
            out = margin.transform(prepared(rows, scaler))
            return out.select(
                ident, "label",
                array_to_vector(F.array(vector_to_array("rawPrediction")[1])).alias("vector"),
            )

        sigmoid = LogisticRegression(featuresCol="vector", labelCol="label").fit(with_margin(held))
        parts.append(probability(sigmoid)(with_margin(df)).select(ident, "p"))
    return soft_vote(parts, ident)


def soft_vote(parts: Sequence[DataFrame], ident: str) -> DataFrame:
    """Mean probability per id over the score tables."""
    return reduce(DataFrame.unionByName, [p.select(ident, "p") for p in parts]).groupBy(
        ident
    ).agg(F.avg("p").alias("p"))


def stacked(df: DataFrame, folds: int, ident: str, names: Sequence[str]) -> tuple:
    """(fitted balanced logistic model, out-of-fold score table with one column per model)."""
    base = estimators()
    scores = fold_scores(df, {n: base[n] for n in names}, folds, ident)
    table = materialise(
        scores.groupBy(ident, "y").pivot("model", list(names)).agg(F.first("p")), "stack"
    )
    rows = prepared(
        table.withColumn("features", F.array(*names)), weights=class_weights(table)
    )
    model = LogisticRegression(
        featuresCol="vector", labelCol="label", weightCol="weight"
    ).fit(rows)
    return model, probability(model)(rows).select(ident, "y", *names, "p")


def logistic(intercept: float, coefs: Sequence[float], values: Sequence[Column]) -> Column:
    """Probability from fixed coefficients."""
    z = reduce(lambda a, b: a + b, [v * w for v, w in zip(values, coefs)], F.lit(intercept))
    return 1.0 / (1.0 + F.exp(-z))


def fit_fusion(df: DataFrame, columns: Sequence[str], label: str = "label") -> tuple:
    """(intercept, coefficients) of a logistic fusion of scores."""
    rows = df.select(
        F.col(label).cast("double").alias("label"),
        array_to_vector(F.array(*[F.col(x).cast("double") for x in columns])).alias("vector"),
    )
    # inverse penalty strength 1 over n rows
    model = LogisticRegression(
        featuresCol="vector", labelCol="label", regParam=1.0 / max(1, rows.count()),
        standardization=False, maxIter=500,
    ).fit(rows)
    return float(model.intercept), model.coefficients.toArray().tolist()


def linear_score(
    df: DataFrame, scaler: Scaler, intercept: float, coefs: Sequence[float],
    vec: str = "features",
) -> DataFrame:
    """Attach ``p`` and ``status`` (1 from 0.5 on) for a linear model on scaled features."""
    z = dot(scaler.apply(vec), constant_vector(coefs)) + F.lit(float(intercept))
    scored = df.withColumn("p", 1.0 / (1.0 + F.exp(-z)))
    return scored.withColumn("status", (F.col("p") >= 0.5).cast("long"))


# --- attributions -----------------------------------------------------------------------------


def background(df: DataFrame, k: int = 10, seed: int = 42) -> list[tuple[list[float], float]]:
    """(centre, share of rows) of k clusters."""
    rows = df.select(array_to_vector("features").alias("features"))
    model = KMeans(k=k, seed=seed).fit(rows)
    sizes = model.summary.clusterSizes
    n = sum(sizes)
    return [(c.tolist(), s / n) for c, s in zip(model.clusterCenters(), sizes)]


def linear_attributions(
    df: DataFrame, ident: str, coefs: Sequence[float], mean: Sequence[float],
    vec: str = "features",
) -> DataFrame:
    """(ident, i, value) = coef * (x - mean), exact for a linear model."""
    parts = F.zip_with(
        F.zip_with(F.col(vec), constant_vector(mean), lambda x, m: x - m),
        constant_vector(coefs), lambda d, w: d * w,
    )
    return df.select(ident, F.posexplode(parts).alias("i", "value"))


def sampled_attributions(
    df: DataFrame,
    ident: str,
    score: Callable[[DataFrame], DataFrame],
    base: Sequence[tuple[Sequence[float], float]],
    permutations: int = 2,
    seed: int = 42,
) -> DataFrame:
    """(ident, i, value) for any scorer: mean gain of switching a feature from the background
    to the row's value along sampled feature orders."""
    d = len(base[0][0])
    rng = random.Random(seed)
    draws = []
    for _ in range(permutations):
        order = list(range(d))
        rng.shuffle(order)
        centre = rng.choices([b[0] for b in base], [b[1] for b in base])[0]
        place = [0] * d
        for at, i in enumerate(order):
            place[i] = at
        draws.append((place, order, centre))
    draw = F.explode(F.array(*[
        F.struct(
            F.lit(n).alias("n"),
            F.array(*[F.lit(x) for x in place]).alias("place"),
            F.array(*[F.lit(x) for x in order]).alias("order"),
            constant_vector(centre).alias("centre"),
        )
        for n, (place, order, centre) in enumerate(draws)
    ]))
    taken = F.col("taken")
    mixed = F.zip_with(
        "features", F.arrays_zip("draw.centre", "draw.place"),
        lambda x, b: F.when(b["place"] < taken, x).otherwise(b["centre"]),
    )
    probes = (
        df.select(ident, "features", draw.alias("draw"))
        .select("*", F.explode(F.sequence(F.lit(0), F.lit(d))).alias("taken"))
        .select(
            ident, F.col("draw.n").alias("n"), "taken",
            F.get("draw.order", taken - 1).alias("i"), array_to_vector(mixed).alias("vector"),
        )
    )
    scored = score(probes).select(ident, "n", "taken", "i", "p")
    # one (row, draw) holds d + 1 probes: a bounded window
    w = Window.partitionBy(ident, "n").orderBy("taken")
    gains = scored.withColumn("gain", F.col("p") - F.lag("p").over(w)).filter("taken > 0")
    return gains.groupBy(ident, "i").agg(F.avg("gain").alias("value"))


def display_labels(df: DataFrame, name: str = "name") -> DataFrame:
    """Attach ``label``: the display label of a feature, its own name when unknown."""
    table = F.create_map(*[F.lit(x) for kv in fixed.FEATURE_LABELS.items() for x in kv])
    return df.withColumn("label", F.coalesce(F.try_element_at(table, F.col(name)), F.col(name)))

