"""Classification metrics over (keys, y, p) tables, exact and without a global sort task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timbrel.operators.ordered import prefix, value_blocks
from timbrel.session import materialise


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b == 0, 0.0).otherwise(a / F.nullif(b, F.lit(0)))


def confusion_metrics(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """accuracy, precision, recall, f1 at p >= 0.5; undefined ratios are 0."""
    y, hit = F.col("y") == 1, F.col("p") >= 0.5

    def n(cond: Column) -> Column:
        return F.sum(cond.cast("long"))

    counts = df.groupBy(*keys).agg(
        n(y & hit).alias("tp"), n(~y & hit).alias("fp"), n(y & ~hit).alias("fn"),
        n(~y & ~hit).alias("tn"),
    )
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    return counts.select(
        *keys,
        _ratio(tp + tn, tp + fp + fn + tn).alias("accuracy"),
        _ratio(tp, tp + fp).alias("precision"),
        _ratio(tp, tp + fn).alias("recall"),
        _ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
    )


def _by_score(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows per distinct score, in blocks of equal numbers of scores (column ``_range``)."""
    counted = df.groupBy(*keys, "p").agg(
        F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg")
    )
    counted = materialise(counted, "by-score")
    return value_blocks(counted, keys, "p").withColumnRenamed("_block", "_range")


def roc_auc(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Rank-based area under the ROC curve, ties count half; 0 with a single class."""
    ranked = prefix(
        _by_score(df, keys), keys, F.col("_range"), ["p"],
        sums={"below": F.col("neg")}, before=True,
    )
    # in doubles: products of counts leave 64-bit integers from some billions of rows on
    pos = F.col("pos").cast("double")
    wins = F.sum(pos * (F.col("below") + F.col("neg") / 2.0))
    pairs = F.sum(pos) * F.sum("neg")
    return ranked.groupBy(*keys).agg(
        F.when(pairs == 0, 0.0).otherwise(wins / F.nullif(pairs, F.lit(0))).alias("roc_auc")
    )


def average_precision(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Sum of precision times recall step over the distinct scores, highest first."""
    ranked = prefix(
        _by_score(df, keys), keys, -F.col("_range"), [F.desc("p")],
        sums={"tp": F.col("pos"), "fp": F.col("neg")},
    )
    area = F.sum(F.col("pos").cast("double") * F.col("tp") / (F.col("tp") + F.col("fp")))
    return ranked.groupBy(*keys).agg(
        F.when(F.sum("pos") == 0, 0.0)
        .otherwise(area / F.nullif(F.sum("pos"), F.lit(0)))
        .alias("pr_auc")
    )


def log_loss(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Mean binary cross-entropy, logarithms floored at -100."""

    def log(p: Column) -> Column:
        return F.when(p > 0, F.greatest(F.ln(F.when(p > 0, p)), F.lit(-100.0))).otherwise(-100.0)

    y, p = F.col("y"), F.col("p")
    return df.groupBy(*keys).agg(
        F.avg(-(y * log(p) + (1 - y) * log(1 - p))).alias("loss")
    )


def all_metrics(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    by = list(keys)
    return (
        confusion_metrics(df, keys).join(roc_auc(df, keys), by).join(average_precision(df, keys), by)
    )


METRIC_NAMES = ("accuracy", "precision", "recall", "f1", "roc_auc", "pr_auc")


def fold_average(metrics: DataFrame, model: str = "model") -> DataFrame:
    present = [m for m in METRIC_NAMES if m in metrics.columns]
    return metrics.groupBy(model).agg(*[F.avg(m).alias(m) for m in present])


def best_model(metrics: DataFrame, model: str = "model", order: str = "ord") -> DataFrame:
    """Model of the highest ROC-AUC, the first one on ties."""
    return metrics.agg(
        F.max_by(model, F.struct("roc_auc", -F.col(order))).alias("best"),
        F.max("roc_auc").alias("roc_auc"),
    )


def best_fold(losses: DataFrame, keys: Sequence[str] = (), fold: str = "fold") -> DataFrame:
    return losses.groupBy(*keys).agg(
        F.min_by(fold, F.struct("loss", fold)).alias("best_fold"), F.min("loss").alias("loss")
    )


def class_balance(df: DataFrame, label: str = "y") -> DataFrame:
    """n_pos, n_neg, ratio and weight of the classes."""
    pos = F.sum((F.col(label) == 1).cast("long"))
    neg = F.sum((F.col(label) == 0).cast("long"))
    return df.agg(pos.alias("n_pos"), neg.alias("n_neg")).select(
        "n_pos", "n_neg",
        F.try_divide("n_pos", "n_neg").alias("pos_ratio"),
        F.try_divide("n_neg", "n_pos").alias("pos_weight"),
    )


def class_weights(df: DataFrame, label: str = "y") -> dict[int, float]:
    """Balanced weight n / (2 n_c) per class."""
    rows = df.groupBy(label).count().collect()
    n = sum(r["count"] for r in rows)
    return {int(r[label]): n / (len(rows) * r["count"]) for r in rows}


def pool_summary(df: DataFrame, pool: str = "pool") -> DataFrame:
    """Rows and distinct subjects per pool, in all and per class."""
    pd_, hy = F.col("label") == 1, F.col("label") == 0
    per_subject = df.groupBy(pool, "subject").agg(
        F.count(F.lit(1)).alias("n"), F.sum(pd_.cast("long")).alias("pd"),
        F.sum(hy.cast("long")).alias("hy"),
    )
    return per_subject.groupBy(pool).agg(
        F.sum("n").alias("n_total"), F.sum("pd").alias("n_pd"), F.sum("hy").alias("n_healthy"),
        F.count(F.lit(1)).alias("subjects"),
        F.sum((F.col("pd") > 0).cast("long")).alias("pd_subjects"),
        F.sum((F.col("hy") > 0).cast("long")).alias("healthy_subjects"),
    ).withColumn("ratio", F.try_divide("n_pd", "n_healthy"))


def subject_scores(
    df: DataFrame, seq: str, subject: str = "subject", keys: Sequence[str] = ()
) -> DataFrame:
    """(keys, subject, score, label): mean score, label as last seen."""
    return df.groupBy(*keys, subject).agg(
        F.avg("p").alias("score"), F.max_by("label", seq).alias("label")
    )
