"""Spectral measures of frames. A frame's spectrum stays an array in its row, so every
measure after the framing shuffle is row-local."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from timbrel.functions.scalars import clamp, dot
from timbrel.operators.frames import frames, rms
from timbrel.operators.ordered import block_arrays

KEYS = ("series_id",)
# Above this transform size the array expressions give way to an Arrow batch FFT.
SMALL_TRANSFORM = 64


def constant_rows(matrix: Sequence[Sequence[float]]) -> Column:
    return F.array(*[F.array(*[F.lit(float(v)) for v in row]) for row in matrix])


def hann(n: int) -> list[float]:
    return [0.5 - 0.5 * math.cos(2 * math.pi * i / n) for i in range(n)]


def twiddle(n: int) -> tuple[list[list[float]], list[list[float]]]:
    """Windowed cosine and sine rows, one per bin 0..n/2."""
    w = hann(n)
    cos = [[w[i] * math.cos(2 * math.pi * b * i / n) for i in range(n)] for b in range(n // 2 + 1)]
    sin = [[w[i] * math.sin(2 * math.pi * b * i / n) for i in range(n)] for b in range(n // 2 + 1)]
    return cos, sin


@F.pandas_udf(ArrayType(DoubleType()))
def _fft_magnitude(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for xs in batches:
        if len(xs) == 0:
            yield pd.Series([], dtype=object)
            continue
        m = np.stack(xs.to_numpy())
        window = np.asarray(hann(m.shape[1]))
        yield pd.Series(list(np.abs(np.fft.rfft(m * window, axis=1))))


def magnitudes(xs: str, n_fft: int) -> Column:
    """Hann-windowed magnitude per bin of an array<double> of ``n_fft`` samples."""
    if n_fft > SMALL_TRANSFORM:
        return _fft_magnitude(F.col(xs))
    cos, sin = twiddle(n_fft)
    both = F.arrays_zip(constant_rows(cos).alias("c"), constant_rows(sin).alias("s"))
    return F.transform(
        both,
        lambda row: F.sqrt(
            F.pow(dot(F.col(xs), row["c"]), 2) + F.pow(dot(F.col(xs), row["s"]), 2)
        ),
    )


def spectrogram(
    df: DataFrame, n_fft: int, hop: int, keys: Sequence[str] = KEYS
) -> DataFrame:
    """(keys, frame, rms, mags)."""
    return frames(df, n_fft, hop, keys).select(
        *keys, "frame", rms("xs").alias("rms"), magnitudes("xs", n_fft).alias("mags")
    )


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, v: s + v)


def flatness(mags: str = "mags") -> Column:
    """Geometric over arithmetic mean of the power, floored at 1e-10."""
    power = F.transform(mags, lambda m: F.greatest(F.lit(1e-10), m * m))
    n = F.size(mags)
    return F.exp(total(F.transform(power, lambda p: F.ln(p))) / n) / (total(power) / n)


def bin_frequencies(n_fft: int, rate: float) -> Column:
    return F.array(*[F.lit(b * rate / n_fft) for b in range(n_fft // 2 + 1)])


def centroid_bandwidth(mags: str, n_fft: int, rate: float) -> Column:
    """struct(centroid, bandwidth); zeros for an empty spectrum."""
    f = bin_frequencies(n_fft, rate)
    m = F.col(mags)
    weight = total(m)
    safe = F.when(weight > 0, weight).otherwise(1.0)
    centre = dot(f, m) / safe
    var = total(F.zip_with(f, m, lambda a, b: b * F.pow(a - centre, 2))) / safe
    return F.struct(centre.alias("centroid"), F.sqrt(var).alias("bandwidth"))


def rolloff_bin(mags: str = "mags", share: float = 0.85) -> Column:
    """Lowest bin where the running magnitude reaches ``share`` of the total."""
    m = F.col(mags)
    limit = total(m) * share
    state = F.struct(F.lit(0.0).alias("sum"), F.lit(0).cast("long").alias("bin"))
    return F.aggregate(
        m, state,
        lambda s, v: F.struct(
            (s["sum"] + v).alias("sum"),
            F.when(s["sum"] + v >= limit, s["bin"]).otherwise(s["bin"] + 1).alias("bin"),
        ),
        lambda s: s["bin"],
    )


def noise_gate(
    spec: DataFrame, noise_frames: int, keep: float = 0.15, keys: Sequence[str] = KEYS
) -> DataFrame:
    """Attenuate bins not above mean + 2 deviations of the first frames.

    The threshold of a key comes from a fixed number of frames; it is one small array per
    key, joined to the frames.
    """
    head = spec.filter(F.col("frame") < max(2, noise_frames)).select(
        *keys, F.posexplode("mags").alias("bin", "mag")
    )
    per_bin = head.groupBy(*keys, "bin").agg(
        (F.avg("mag") + 2 * F.stddev_pop("mag")).alias("limit")
    )
    limits = per_bin.groupBy(*keys).agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("bin", "limit"))), lambda s: s["limit"]
        ).alias("limits")
    )
    gated = F.zip_with("mags", "limits", lambda m, lim: F.when(m > lim, m).otherwise(m * keep))
    return spec.join(limits, list(keys)).withColumn("mags", gated).drop("limits")


def activity(spec: DataFrame, energy: float = 0.015, flat: float = 0.15) -> DataFrame:
    """Flag frames with high energy and low flatness."""
    return spec.withColumn("active", (F.col("rms") > energy) & (flatness() < flat))


# --- filter banks ------------------------------------------------------------------------------


def mel_weights(n_mels: int, n_fft: int, rate: float) -> list[list[float]]:
    """Triangles evenly spaced in mel, area-normalised, one row per band."""

    def mel(f: float) -> float:
        return 2595.0 * math.log10(1.0 + f / 700.0)

    def hertz(m: float) -> float:
        return 700.0 * (10.0 ** (m / 2595.0) - 1.0)

    edges = [hertz(mel(rate / 2) * i / (n_mels + 1)) for i in range(n_mels + 2)]
    rows = []
    for lo, mid, hi in zip(edges, edges[1:], edges[2:]):
        up = [(b * rate / n_fft - lo) / (mid - lo) for b in range(n_fft // 2 + 1)]
        down = [(hi - b * rate / n_fft) / (hi - mid) for b in range(n_fft // 2 + 1)]
        rows.append([max(0.0, min(u, d)) * 2.0 / (hi - lo) for u, d in zip(up, down)])
    return rows


def cosine_basis(n_out: int, n_in: int) -> list[list[float]]:
    """Orthonormal DCT-II rows."""
    rows = []
    for k in range(n_out):
        s = math.sqrt((1.0 if k == 0 else 2.0) / n_in)
        rows.append([s * math.cos(math.pi * k * (i + 0.5) / n_in) for i in range(n_in)])
    return rows


def pitch_class_weights(n_fft: int, rate: float) -> list[list[float]]:
    """Each bin counted towards its nearest of 12 pitch classes (class 9 holds 440 Hz)."""
    rows = [[0.0] * (n_fft // 2 + 1) for _ in range(12)]
    for b in range(1, n_fft // 2 + 1):
        note = round(69 + 12 * math.log2(b * rate / n_fft / 440.0))
        rows[note % 12][b] = 1.0
    return rows


def project(values: Column, weights: Sequence[Sequence[float]]) -> Column:
    """Matrix-vector product with constant weights, inside the row."""
    if sum(len(r) for r in weights) <= 4096:
        return F.transform(constant_rows(weights), lambda row: dot(row, values))
    matrix = np.asarray(weights)

    @F.pandas_udf(ArrayType(DoubleType()))
    def product(vs: pd.Series) -> pd.Series:
        if len(vs) == 0:
            return pd.Series([], dtype=object)
        return pd.Series(list(np.stack(vs.to_numpy()) @ matrix.T))

    return product(values)


def power(mags: str = "mags") -> Column:
    return F.transform(mags, lambda m: m * m)


def cepstrum(mags: str, mel: Sequence[Sequence[float]], n_out: int) -> Column:
    logs = F.transform(
        project(power(mags), mel), lambda v: 10.0 * F.log10(F.greatest(F.lit(1e-10), v))
    )
    return project(logs, cosine_basis(n_out, len(mel)))


def pitch_classes(mags: str, weights: Sequence[Sequence[float]]) -> Column:
    """Energy per pitch class relative to the strongest one."""
    raw = project(power(mags), weights)
    top = F.array_max(raw)
    return F.transform(raw, lambda v: v / F.when(top > 0, top).otherwise(1.0))


def pool(df: DataFrame, column: str, names: str, keys: Sequence[str] = KEYS) -> DataFrame:
    """Element-wise mean of an array column per key, long form (keys, i, <names>)."""
    return (
        df.select(*keys, F.posexplode(column).alias("i", "_v"))
        .groupBy(*keys, "i")
        .agg(F.avg("_v").alias(names))
    )


# --- autocorrelation ----------------------------------------------------------------------------


# Numbers that one transform of many rows holds at a time.
TRANSFORM_NUMBERS = 1 << 20
# A transform errs by some 1e-15 of the energy; what is below this share of it is zero.
NOISE = 1e-13


def lagged_sums(own: list[np.ndarray], whole: list[np.ndarray], lags: int) -> np.ndarray:
    """Per row and lag the sum of own[j] * whole[j + lag], by transforms of the padded rows.

    Costs n log n a row whatever the number of lags. Rows with NaN or infinite samples are added up directly.
    """
    out = np.zeros((len(own), lags))
    need = max((max(len(w), len(o) + lags) for o, w in zip(own, whole)), default=1)
    n = 1 << (need - 1).bit_length()
    step = max(1, TRANSFORM_NUMBERS // n)
    for lo in range(0, len(own), step):
        a, b = (np.zeros((min(step, len(own) - lo), n)) for _ in range(2))
        for row, (o, w) in enumerate(zip(own[lo : lo + step], whole[lo : lo + step])):
            a[row, : len(o)], b[row, : len(w)] = o, w
        rough = ~(np.isfinite(a).all(axis=1) & np.isfinite(b).all(axis=1))
        energy = np.sqrt((a * a).sum(axis=1) * (b * b).sum(axis=1))[:, None]
        for row in np.flatnonzero(rough):
            o, w = own[lo + row], whole[lo + row]
            for lag in range(lags):
                rest = w[lag : lag + len(o)]
                out[lo + row, lag] = (o[: len(rest)] * rest).sum()
        a[rough], b[rough] = 0.0, 0.0
        spectrum = np.conj(np.fft.rfft(a, axis=1)) * np.fft.rfft(b, axis=1)
        sums = np.fft.irfft(spectrum, n, axis=1)[:, :lags]
        sums[np.abs(sums) <= NOISE * np.where(rough[:, None], 0.0, energy)] = 0.0
        out[lo : lo + step][~rough] = sums[~rough]
    return out


def autocorrelation(
    df: DataFrame, lags: int, keys: Sequence[str] = KEYS, pos: str = "t", value: str = "x"
) -> DataFrame:
    """(keys, lag, r) for lags 0..lags-1.

    Every block (with the following samples at hand) gives its sums for all lags by one
    transform. They add up to the sums of the series, so a long series spreads over many
    tasks and no pairs are emitted. A null sample adds nothing.
    """
    blocks = block_arrays(df, keys, pos, value, ahead=lags)

    @F.pandas_udf(ArrayType(DoubleType()))
    def sums(xs: pd.Series, own: pd.Series) -> pd.Series:
        whole = [np.asarray(x, float) for x in xs]
        return pd.Series(list(lagged_sums([x[:n] for x, n in zip(whole, own)], whole, lags)), dtype=object)

    present = F.transform("xs", lambda x: F.coalesce(x, F.lit(0.0)))
    return (
        blocks.select(*keys, sums(present, "own").alias("r"))
        .select(*keys, F.posexplode("r").alias("lag", "r"))
        .groupBy(*keys, F.col("lag").cast("long").alias("lag"))
        .agg(F.sum("r").alias("r"))
    )


def harmonicity(
    df: DataFrame, rate: int, keys: Sequence[str] = KEYS, pos: str = "t", value: str = "x"
) -> DataFrame:
    """hnr, nhr from the strongest lag of the pitch range; (15, 0.03) as fallback."""
    low, high, size = int(rate / 500), int(rate / 75), int(rate / 50)
    acf = autocorrelation(df, size, keys, pos, value)
    n = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    inside = (F.col("lag") >= low) & (F.col("lag") < high)
    peak = acf.groupBy(*keys).agg(
        F.max(F.when(F.col("lag") == 0, F.col("r"))).alias("r0"),
        F.max(F.when(inside, F.col("r"))).alias("r"),
    )
    r0, r = F.col("r0"), F.col("r")
    fallback = (F.least(F.col("_n"), F.lit(size)) <= high) | (r0 <= 0) | (r0 - r <= 0)
    ratio = F.when(r > 0, r / F.nullif(r0 - r, F.lit(0.0)))
    return peak.join(n, list(keys)).select(
        *keys,
        F.when(fallback, 15.0)
        .otherwise(F.coalesce(clamp(10 * F.log10(ratio), 0.0, 40.0), F.lit(0.0)))
        .alias("hnr"),
        F.when(fallback, 0.03)
        .when(r == 0, 10.0)
        .otherwise(clamp((r0 - r) / F.nullif(r, F.lit(0.0)), 0.001, 10.0))
        .alias("nhr"),
    )


def normalised_differences(m: np.ndarray, window: int) -> np.ndarray:
    """Per row and lag 1, 2, ...: the squared difference of the first ``window`` samples and those a lag later, over
    the mean of the differences up to that lag; 1 where that mean is zero or a sample is missing."""
    high = m.shape[1] - window
    lags = np.arange(1, high + 1)
    rough = ~np.isfinite(m).all(axis=1)
    safe = np.where(rough[:, None], 0.0, m)
    energy = np.cumsum(np.pad(safe * safe, ((0, 0), (1, 0))), axis=1)
    both = energy[:, window, None] + energy[:, window + lags] - energy[:, lags]
    d = both - 2 * lagged_sums(list(safe[:, :window]), list(safe), high + 1)[:, 1:]
    d[d <= NOISE * energy[:, -1:]] = 0.0
    for row in np.flatnonzero(rough):
        d[row] = [((m[row, :window] - m[row, lag : lag + window]) ** 2).sum() for lag in lags]
    with np.errstate(invalid="ignore", divide="ignore"):
        v = d * lags / np.cumsum(d, axis=1)
    return np.where(np.isnan(v), 1.0, v)


def pitch(
    df: DataFrame, rate: float, window: int, hop: int, fmin: float = 75.0, fmax: float = 500.0,
    limit: float = 0.1, keys: Sequence[str] = KEYS,
) -> DataFrame:
    """(keys, frame, f0) by the cumulative-mean-normalised difference function.

    Long frames get the differences of all lags from one transform, short ones from array
    expressions. A lag whose samples are not all known counts as 1.
    """
    low, high = max(1, int(rate / fmax)), int(rate / fmin)
    cut = frames(df, window + high, hop, keys)
    lags = F.sequence(F.lit(1), F.lit(high))

    @F.pandas_udf(ArrayType(DoubleType()))
    def normalised(xs: pd.Series) -> pd.Series:
        m = np.stack(xs.to_numpy()) if len(xs) else np.zeros((0, window + high))
        return pd.Series(list(normalised_differences(m, window)), dtype=object)

    def difference(lag: Column) -> Column:
        return F.aggregate(
            F.zip_with(
                F.slice("xs", 1, window), F.slice("xs", lag + 1, window),
                lambda a, b: (a - b) * (a - b),
            ),
            F.lit(0.0), lambda s, v: s + v,
        )

    if window + high > SMALL_TRANSFORM:
        running = cut.select(*keys, "frame", normalised("xs").alias("v")).select(
            *keys, "frame",
            F.transform("v", lambda v, i: F.struct((i + 1).alias("lag"), v.alias("v"))).alias("c"),
        )
    else:
        diffs = cut.select(*keys, "frame", F.transform(lags, difference).alias("d"))
        running = diffs.select(
            *keys, "frame",
            F.transform(
                lags,
                lambda lag: F.struct(
                    lag.alias("lag"),
                    F.coalesce(
                        F.get("d", lag - 1) * lag
                        / F.nullif(total(F.slice("d", F.lit(1), lag)), F.lit(0.0)),
                        F.lit(1.0),
                    ).alias("v"),
                ),
            ).alias("c"),
        )
    searched = F.filter("c", lambda s: s["lag"] >= low)
    under = F.filter(searched, lambda s: s["v"] < limit)
    least = F.array_min(F.transform(searched, lambda s: F.struct(s["v"], s["lag"])))
    best = F.when(F.size(under) > 0, F.get(under, F.lit(0))["lag"]).otherwise(least["lag"])
    return running.select(*keys, "frame", (rate / best).alias("f0"))
