"""Leakage-free splits, folds and oversampling, all by a stable hash order.

A rank "per class" would put half of all rows into one task; ranks here are running counts
over hash-prefix blocks instead (see ``ordered.prefix``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timbrel.operators.ordered import dense_index, with_stats
from timbrel.operators.vectors import nearest_references
from timbrel.session import materialise


def scatter(ident: str | Column, seed: int) -> Column:
    """A stable pseudo-random order: hex digest of id and seed."""
    col = F.col(ident) if isinstance(ident, str) else ident
    return F.md5(F.concat(col.cast("string"), F.lit(f":{seed}")))


def ranked(df: DataFrame, keys: Sequence[str], ident: str, seed: int) -> DataFrame:
    """Attach 0-based ``rank`` of the scattered ids within the keys."""
    hashed = df.withColumn("_h", scatter(ident, seed))
    return dense_index(
        hashed, keys, F.substring("_h", 1, 3), ["_h", ident], "rank"
    ).drop("_h")


def stratified_split(
    df: DataFrame, ident: str, label: str = "y", share: float = 0.2, seed: int = 42
) -> DataFrame:
    """Attach ``test``: a fifth of every class."""
    sized = with_stats(df, [label], {"_n": F.count(F.lit(1))})
    out = ranked(sized, [label], ident, seed)
    return out.withColumn("test", F.col("rank") < F.floor(F.col("_n") * share)).drop(
        "rank", "_n"
    )


def subject_table(df: DataFrame, subject: str = "subject", label: str = "label") -> DataFrame:
    """(subject, class, size): class by majority of the rows, ties positive."""
    return df.groupBy(subject).agg(
        (F.avg(label) >= 0.5).cast("long").alias("class"), F.count(F.lit(1)).alias("size")
    )


def test_subjects(
    df: DataFrame, subject: str = "subject", label: str = "label", share: float = 0.2,
    seed: int = 42,
) -> DataFrame:
    """Subjects held out: ``max(1, floor(share * n))`` of each class. A subject that occurs
    with both labels is drawn in each."""
    subjects = materialise(df.select(subject, label).distinct(), "subjects")
    sized = with_stats(subjects, [label], {"_n": F.count(F.lit(1))})
    out = ranked(sized, [label], subject, seed)
    held = F.greatest(F.lit(1), F.floor(F.col("_n") * share))
    return materialise(out.filter(F.col("rank") < held).select(subject).distinct(), "held")


def subject_split(df: DataFrame, held: DataFrame, subject: str = "subject"):
    """(train, test) rows by anti and semi join: no subject on both sides."""
    return df.join(held, subject, "left_anti"), df.join(held, subject, "left_semi")


MIN_SUBJECTS = 10


def group_folds(
    df: DataFrame, ident: str, folds: int = 5, subject: str = "subject", label: str = "label",
    seed: int = 42,
) -> DataFrame:
    """Attach ``fold``: subjects dealt per class, largest first, back and forth over the folds.

    Below ten subjects, rows are dealt per class instead.
    """
    subjects = materialise(subject_table(df, subject, label), "subjects")
    if len(subjects.limit(MIN_SUBJECTS).collect()) < MIN_SUBJECTS:
        return ranked(df, [label], ident, seed).withColumn(
            "fold", F.col("rank") % folds
        ).drop("rank")
    hashed = subjects.withColumn("_h", scatter(subject, seed))
    dealt = dense_index(
        hashed, ["class"], F.struct(-F.col("size"), F.substring("_h", 1, 3)),
        [F.desc("size"), "_h", subject], "rank",
    )
    turn = F.col("rank") % (2 * folds)
    fold = F.when(turn < folds, turn).otherwise(2 * folds - 1 - turn)
    return df.join(dealt.select(subject, fold.alias("fold")), subject)


def oversample(
    df: DataFrame, ident: str = "vec_id", label: str = "cohort", vec: str = "embedding",
    k: int = 5, seed: int = 42,
) -> DataFrame:
    """Synthetic rows of the smaller class: (source, copy, <label>, <vec>), to even the classes.

    Each lies between a row and one of its k nearest of the same class.
    """
    sizes = {r[label]: r["count"] for r in df.groupBy(label).count().collect()}
    small = min(sizes, key=lambda c: (sizes[c], c))
    n, missing = sizes[small], max(sizes.values()) - sizes[small]
    k = min(k, n - 1)
    minority = df.filter(F.col(label) == small).select(
        ident, F.col(label).cast("long").alias("cohort"), vec
    )
    index = ranked(minority, [], ident, seed)
    copies = F.lit(missing // n) + (F.col("rank") < missing % n).cast("int")
    seeds = index.filter(copies > 0).select(
        F.col(ident).alias("source"), F.col(vec).alias("_base"),
        F.explode(F.sequence(F.lit(1), copies)).alias("copy"),
    )
    drawn = seeds.withColumns(
        {
            "rank": F.pmod(F.xxhash64("source", "copy", F.lit(seed)), F.lit(k)) + 1,
            "_u": F.pmod(F.xxhash64("copy", "source", F.lit(seed + 1)), F.lit(1 << 20))
            / float(1 << 20),
        }
    )
    near = nearest_references(
        minority, minority, k, row_id=ident, ref_id=ident, vec=vec, skip_self=True
    ).select(F.col("row_id").alias("source"), "rank", F.col("ref_id").alias("_other"))
    other = minority.select(F.col(ident).alias("_other"), F.col(vec).alias("_far"))
    u = F.col("_u")
    return drawn.join(near, ["source", "rank"]).join(other, "_other").select(
        "source", "copy", F.lit(small).cast("long").alias(label),
        F.zip_with("_base", "_far", lambda a, b: a + u * (b - a)).alias(vec),
    )
