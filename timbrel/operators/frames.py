"""Frames of sample tables: energy, noise floor, activity, trimming."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timbrel.functions.scalars import clamp
from timbrel.operators.ordered import position_block, prefix, ranked_values, with_stats
from timbrel.session import materialise

KEYS = ("series_id",)
FRAMES_PER_BLOCK = 64


def frames(
    df: DataFrame, length: int, hop: int, keys: Sequence[str] = KEYS, pos: str = "t",
    value: str = "x",
) -> DataFrame:
    """(keys, frame, xs): complete frames only.

    Samples are grouped by runs of 64 frames (64 * hop + length samples at most), so the
    shuffle carries each sample about once and no list grows with the series.
    """
    t = F.col(pos)
    final = F.floor(t / hop)
    # samples between frames (hop above length) stay, so that runs have no gaps
    first = F.least(final, F.greatest(F.lit(0), F.ceil((t - length + 1) / hop)))
    runs = F.sequence(
        position_block(first, FRAMES_PER_BLOCK), position_block(final, FRAMES_PER_BLOCK)
    )
    grouped = (
        df.select(*keys, t.alias("_t"), F.col(value).cast("double").alias("_x"),
                  F.explode(runs).alias("_run"))
        .groupBy(*keys, "_run")
        .agg(F.array_sort(F.collect_list(F.struct("_t", "_x"))).alias("_s"))
        .select(
            *keys, "_run", F.col("_s._x").alias("_xs"),
            F.get("_s", F.lit(0))["_t"].alias("_t0"), F.size("_s").alias("_n"),
        )
    )
    f0 = F.col("_run") * FRAMES_PER_BLOCK
    fmax = F.least(
        f0 + FRAMES_PER_BLOCK - 1, F.floor((F.col("_t0") + F.col("_n") - length) / hop)
    )
    cut = F.transform(
        F.sequence(f0, fmax),
        lambda f: F.struct(
            f.alias("frame"),
            F.slice("_xs", (f * hop - F.col("_t0") + 1).cast("int"), length).alias("xs"),
        ),
    )
    return grouped.filter(fmax >= f0).select(*keys, F.inline(cut))


def rms(xs: Column | str) -> Column:
    xs = F.col(xs) if isinstance(xs, str) else xs
    return F.sqrt(F.aggregate(xs, F.lit(0.0), lambda s, v: s + v * v) / F.size(xs))


def frame_rms(df: DataFrame, length: int, hop: int, keys: Sequence[str] = KEYS) -> DataFrame:
    """(keys, frame, rms)."""
    return frames(df, length, hop, keys).select(*keys, "frame", rms("xs").alias("rms"))


def noise_floor(energy: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """(keys, floor): mean of the lowest tenth (at least one) of the frame energies."""
    ranked = ranked_values(energy, keys, "rms")
    k = F.greatest(F.lit(1), F.floor(F.col("n") * 0.1))
    taken = F.greatest(F.lit(0), F.least(F.col("copies"), k - F.col("below")))
    return ranked.groupBy(*keys).agg(
        F.try_divide(F.sum(F.col("rms") * taken), F.sum(taken)).alias("floor")
    )


def speech_levels(energy: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """coverage, silence, noise_pct, snr, peak per key from frame energies."""
    energy = materialise(energy, "energy")
    floors = noise_floor(energy, keys)
    e, floor = F.col("rms"), F.col("floor")
    speech = e > F.greatest(floor * 3.0, F.lit(0.005))
    agg = energy.join(floors, list(keys)).groupBy(*keys, "floor").agg(
        F.avg(speech.cast("double")).alias("_share"),
        F.avg(F.when(speech, e)).alias("_speech"),
        F.max(e).alias("peak"),
    )
    peak = F.when(F.col("peak") > 0, F.col("peak")).otherwise(1e-10)
    level = F.coalesce("_speech", peak)
    return agg.select(
        *keys,
        floor,
        (F.col("_share") * 100).alias("coverage"),
        (100 - F.col("_share") * 100).alias("silence"),
        clamp(floor / peak * 100, 0.0, 100.0).alias("noise_pct"),
        F.when(
            floor > 0, clamp(20 * F.log10(level / F.when(floor > 0, floor)), 0.0, 60.0)
        )
        .otherwise(40.0)
        .alias("snr"),
        F.col("peak"),
    )


def clipping(df: DataFrame, keys: Sequence[str] = KEYS, value: str = "x", limit: float = 0.99):
    ratio = F.avg((F.abs(value) >= limit).cast("double"))
    return df.groupBy(*keys).agg(ratio.alias("clip_ratio")).withColumn(
        "clipped", F.col("clip_ratio") > 0.001
    )


def silent(df: DataFrame, keys: Sequence[str] = KEYS, value: str = "x") -> DataFrame:
    return df.groupBy(*keys).agg((F.max(F.abs(value)) < 1e-4).alias("silent"))


def ambient_noise(df: DataFrame, block: int, keys: Sequence[str] = KEYS) -> DataFrame:
    """Mean energy of whole blocks; warn above 0.05."""
    level = frame_rms(df, block, block, keys).groupBy(*keys).agg(F.avg("rms").alias("level"))
    return level.withColumn("warn", F.col("level") > 0.05)


def active_runs(
    flags: DataFrame, keys: Sequence[str] = KEYS, pos: str = "frame", active: str = "active"
) -> DataFrame:
    """Maximal runs of true flags: (keys, start, end, length).

    Inside a run, position minus the number of active rows so far stays constant.
    """
    flags = materialise(flags.select(*keys, pos, active), "flags")
    counted = prefix(
        flags, keys, position_block(pos), [pos], sums={"_seen": F.col(active).cast("long")}
    ).filter(active)
    return (
        counted.groupBy(*keys, (F.col(pos) - F.col("_seen")).alias("_island"))
        .agg(F.min(pos).alias("start"), F.max(pos).alias("end"),
             F.count(F.lit(1)).alias("length"))
        .drop("_island")
    )


def longest_active(
    df: DataFrame, flags: DataFrame, length: int, hop: int, keys: Sequence[str] = KEYS
) -> DataFrame:
    """(keys, start, end) in samples of the longest active run; the whole series if none."""
    best = active_runs(flags, keys).groupBy(*keys).agg(
        F.max_by(F.struct("start", "end"), F.struct("length", -F.col("start"))).alias("_b")
    )
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    return sizes.join(best, list(keys), "left").select(
        *keys,
        F.coalesce(F.col("_b.start") * hop, F.lit(0)).alias("start"),
        F.coalesce(F.col("_b.end") * hop + length, F.col("_n")).alias("end"),
    )


def trim_bounds(
    df: DataFrame, length: int, hop: int, top_db: float = 30.0, keys: Sequence[str] = KEYS
) -> DataFrame:
    """(keys, start, end) without leading and trailing frames far below the loudest."""
    energy = materialise(frame_rms(df, length, hop, keys), "energy")
    e = with_stats(energy, keys, {"_peak": F.max("rms")})
    loud = F.col("rms") > F.col("_peak") * 10 ** (-top_db / 20)
    return e.filter(loud).groupBy(*keys).agg(
        (F.min("frame") * hop).alias("start"), (F.max("frame") * hop + length).alias("end")
    )


def cut(df: DataFrame, bounds: DataFrame, keys: Sequence[str] = KEYS, pos: str = "t"):
    """Samples inside the bounds of their key; keys without bounds stay whole."""
    inside = F.col("start").isNull() | (
        (F.col(pos) >= F.col("start")) & (F.col(pos) < F.col("end"))
    )
    return df.join(bounds, list(keys), "left").filter(inside).select(*df.columns)


def peak_normalise(
    df: DataFrame, keys: Sequence[str] = KEYS, value: str = "x", target: float = 0.95
) -> DataFrame:
    x = F.col(value)
    peaked = with_stats(df, keys, {"_peak": F.max(F.abs(x))})
    return peaked.withColumn(
        value,
        F.when(F.col("_peak") > 0, x / F.nullif(F.col("_peak"), F.lit(0.0)) * target).otherwise(x),
    ).drop("_peak")


def duration(df: DataFrame, rate: float, keys: Sequence[str] = KEYS) -> DataFrame:
    seconds = F.count(F.lit(1)) / rate
    return df.groupBy(*keys).agg((F.rint(seconds * 10) / 10).alias("seconds"))


def assemble_chunks(
    chunks: DataFrame, keys: Sequence[str], seq: str, samples: str
) -> DataFrame:
    """Ordered chunks to one continuous index: (keys, t, x)."""
    placed = prefix(
        chunks.select(*keys, seq, samples), keys, position_block(seq), [seq],
        sums={"_offset": F.size(samples).cast("long")}, before=True,
    )
    return placed.select(*keys, "_offset", F.posexplode(samples).alias("_p", "x")).select(
        *keys, (F.col("_offset") + F.col("_p")).alias("t"), "x"
    )
