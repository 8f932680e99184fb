"""Longitudinal work: timelines, personal baselines, drift, upserts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from timbrel.functions.scalars import cosine, norm
from timbrel.operators.ordered import dense_index


def timeline(
    df: DataFrame, block: Column, patient: str = "patient_id",
    order: Sequence[str] = ("us", "screening_id"),
) -> DataFrame:
    """Attach the 1-based position of every screening in its patient's history."""
    out = dense_index(df, [patient], block, list(order), "position")
    return out.withColumn("position", F.col("position") + 1)


def baselines(
    df: DataFrame, patient: str = "patient_id", vec: str = "embedding",
    order: Sequence[str] = ("us", "screening_id"),
) -> DataFrame:
    """(patient, baseline, baseline_id): the first embedding of every patient.

    The first row is found on the order columns alone (combined map-side); vectors are
    fetched for those rows only.
    """
    ident = order[-1]
    first = df.groupBy(patient).agg(F.min(F.struct(*order)).alias("_f")).select(
        patient, F.col(f"_f.{ident}").alias(ident)
    )
    return df.select(patient, ident, vec).join(first, [patient, ident]).select(
        patient, F.col(vec).alias("baseline"), F.col(ident).alias("baseline_id")
    )


def with_drift(
    df: DataFrame, base: DataFrame, patient: str = "patient_id", vec: str = "embedding",
    ident: str = "screening_id",
) -> DataFrame:
    """Attach ``drift`` = 1 - cosine to the baseline; null without one.

    The screening that created the baseline has none yet. The baseline side holds one row per
    patient and its length is computed once; a hot patient is split by the adaptive planner.
    """
    prepared = base.withColumn("_len", norm(F.col("baseline")))
    d = 1.0 - cosine(F.col(vec), F.col("baseline"), norm_b=F.col("_len"))
    known = F.col("baseline").isNotNull()
    if "baseline_id" in base.columns:
        known = known & (F.col("baseline_id") != F.col(ident))
    return (
        df.join(prepared, patient, "left")
        .withColumn("drift", F.when(known, d))
        .drop("_len", "baseline", "baseline_id")
    )


def first_wins(
    existing: DataFrame, arriving: DataFrame, patient: str = "patient_id",
    vec: str = "embedding", order: Sequence[str] = ("us", "screening_id"),
) -> DataFrame:
    """Baselines after an insert that never overwrites: (patient, baseline)."""
    fresh = baselines(
        arriving.join(existing.select(patient), patient, "left_anti"), patient, vec, order
    ).select(patient, "baseline")
    return existing.select(patient, "baseline").unionByName(fresh)


def last_wins(
    df: DataFrame, ident: str = "screening_id", order: Sequence[str] = ("us",)
) -> DataFrame:
    """Newest row per id."""
    w = Window.partitionBy(ident).orderBy(*[F.desc(o) for o in order])
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def newest(df: DataFrame, n: int, key: str, order: Sequence[str]) -> DataFrame:
    """The n newest rows per key with their rank; limited per partition before the shuffle."""
    w = Window.partitionBy(key).orderBy(*[F.desc(o) for o in order])
    return df.withColumn("rank", F.row_number().over(w).cast("long")).filter(
        F.col("rank") <= n
    )
