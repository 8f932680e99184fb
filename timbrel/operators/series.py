"""Measures of ordered series: perturbation, contour statistics, complexity.

Input is a long table (keys, pos, value) with a dense position. All results are one row per
key. Nothing here sends a whole series to one task: see ``ordered``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timbrel.functions.scalars import clamp
from timbrel.operators.ordered import (
    block_arrays,
    dense_index,
    neighbourhood,
    position_block,
    prefix,
    quantiles,
    with_stats,
)
from timbrel.session import materialise

KEYS = ("series_id",)


def heard(x: Column) -> Column:
    """Positive and finite; NaN, which compares as the largest number, is not."""
    return ~F.isnan(x) & (F.abs(x) != float("inf")) & (x > 0)


def voiced(df: DataFrame, keys: Sequence[str] = KEYS, pos: str = "t", value: str = "x"):
    """Keep positive finite samples (NaN and infinities count as 0) and close the gaps."""
    x = F.col(value)
    kept = df.filter(heard(x))
    return dense_index(kept, keys, position_block(pos), [pos], "_i").withColumn(
        pos, F.col("_i")
    ).drop("_i")


# --- perturbation ------------------------------------------------------------------------


def _perturbation(df, keys, pos, value, spans: Sequence[int], ratio: bool = False) -> DataFrame:
    """n, mean, step, db, and per odd span the mean distance from the centred mean."""
    x = F.col(value)
    reach = max(1, *[s // 2 for s in spans])

    def build(w):
        made = {"_prev": F.lag(x).over(w)}
        for s in spans:
            frame = w.rowsBetween(-(s // 2), s // 2)
            made[f"_m{s}"] = F.avg(x).over(frame)
            made[f"_n{s}"] = F.count(x).over(frame)
        return made

    near = neighbourhood(df.select(*keys, pos, value), keys, pos, reach, reach, build)
    aggs = [
        F.count(x).alias("n"),
        F.avg(x).alias("mean"),
        F.avg(F.abs(x - F.col("_prev"))).alias("step"),
    ]
    if ratio:
        aggs.append(F.avg(F.abs(20.0 * F.log10(x / F.col("_prev")))).alias("db"))
    for s in spans:
        full = F.col(f"_n{s}") == s
        aggs.append(F.avg(F.when(full, F.abs(x - F.col(f"_m{s}")))).alias(f"dev{s}"))
    return near.groupBy(*keys).agg(*aggs)


def _guarded(cond: Column, value: Column) -> Column:
    return F.when(cond, F.coalesce(value, F.lit(0.0))).otherwise(0.0)


def jitter(df: DataFrame, keys: Sequence[str] = KEYS, pos: str = "t", value: str = "x"):
    """jitter_abs, jitter_pct, rap, ppq, ddp; all 0 below five periods or at zero mean."""
    m = _perturbation(df, keys, pos, value, (3, 5))
    ok = (F.col("n") >= 5) & (F.col("mean") != 0)
    mean = F.nullif(F.col("mean"), F.lit(0.0))
    return m.select(
        *keys,
        _guarded(ok, F.col("step")).alias("jitter_abs"),
        _guarded(ok, F.col("step") / mean * 100).alias("jitter_pct"),
        _guarded(ok, F.col("dev3") / mean).alias("rap"),
        _guarded(ok, F.col("dev5") / mean).alias("ppq"),
        _guarded(ok, 3 * F.col("dev3") / mean).alias("ddp"),
    )


def shimmer(df: DataFrame, keys: Sequence[str] = KEYS, pos: str = "t", value: str = "x"):
    """shimmer_local, shimmer_db, apq3, apq5, apq11, dda over the positive amplitudes."""
    m = _perturbation(voiced(df, keys, pos, value), keys, pos, value, (3, 5, 11), ratio=True)
    ok = (F.col("n") >= 5) & (F.col("mean") != 0)
    mean = F.nullif(F.col("mean"), F.lit(0.0))
    return m.select(
        *keys,
        _guarded(ok, F.col("step") / mean).alias("shimmer_local"),
        _guarded(ok, F.col("db")).alias("shimmer_db"),
        _guarded(ok, F.col("dev3") / mean).alias("apq3"),
        _guarded(ok, F.col("dev5") / mean).alias("apq5"),
        _guarded(ok, F.col("dev11") / mean).alias("apq11"),
        _guarded(ok, 3 * F.col("dev3") / mean).alias("dda"),
    )


# --- contour -------------------------------------------------------------------------------


def contour_stats(df: DataFrame, keys: Sequence[str] = KEYS, value: str = "x") -> DataFrame:
    """fo_mean, fhi, flo over voiced samples, 0 when there are none."""
    x = F.col(value)
    v = F.when(heard(x), x)
    return df.groupBy(*keys).agg(
        F.coalesce(F.avg(v), F.lit(0.0)).alias("fo_mean"),
        F.coalesce(F.max(v), F.lit(0.0)).alias("fhi"),
        F.coalesce(F.min(v), F.lit(0.0)).alias("flo"),
    )


def profile(df: DataFrame, keys: Sequence[str] = KEYS, pos: str = "t", value: str = "x"):
    """Running sum of the samples minus their mean (columns keys, pos, n, y)."""
    centred = with_stats(
        df.select(*keys, pos, value), keys, {"_mean": F.avg(value), "n": F.count(F.lit(1))}
    )
    return prefix(
        centred, keys, position_block(pos), [pos],
        sums={"y": F.col(value) - F.col("_mean")},
    ).select(*keys, pos, "n", "y")


def spread(df: DataFrame, keys: Sequence[str] = KEYS, value: str = "x") -> DataFrame:
    """spread1, spread2 of the voiced samples; (-5, 0.2) below ten of them."""
    x = F.when(heard(F.col(value)), F.col(value))
    logs = df.filter(heard(F.col(value))).select(*keys, F.ln(F.col(value) + 1e-8).alias("_ln"))
    p25 = quantiles(logs, keys, "_ln", {"_p25": 0.25})
    stats = df.groupBy(*keys).agg(
        F.count(x).alias("n"),
        F.avg(F.ln(x + 1e-8)).alias("_mln"),
        (F.stddev_pop(x) / (F.avg(x) + 1e-8)).alias("_cv"),
    )
    short = F.col("n") < 10
    return stats.join(p25, list(keys), "left").select(
        *keys,
        F.when(short, -5.0)
        .otherwise(clamp((F.col("_p25") - F.col("_mln")) * 3.0, -8.0, -2.0))
        .alias("spread1"),
        F.when(short, 0.2).otherwise(clamp(F.col("_cv"), 0.001, 0.5)).alias("spread2"),
    )


# --- entropies -----------------------------------------------------------------------------

EPS = 1e-10


def _histogram_entropy(binned: DataFrame, keys, top: Column) -> DataFrame:
    """Entropy in bits over ``top`` of a density histogram, each bin raised by 1e-10.

    ``binned`` holds one row per filled bin: keys, n, bins, width, count. Empty bins are
    added in closed form.
    """
    z = 1.0 / F.col("width") + F.col("bins") * EPS
    p = (F.col("count") / (F.col("n") * F.col("width")) + EPS) / z
    empty = EPS / z
    return binned.groupBy(*keys, "n", "bins", "width").agg(
        F.sum(-p * F.log2(p)).alias("_filled"), F.count(F.lit(1)).alias("_k")
    ).select(
        *keys,
        clamp(
            (F.col("_filled") + (F.col("bins") - F.col("_k")) * (-empty * F.log2(empty))) / top,
            0.0,
            1.0,
        ).alias("entropy"),
    )


def _binned(df: DataFrame, keys, value: Column, lo: Column, hi: Column, bins: Column):
    """Rows counted per equal-width bin of lo..hi (one unit around lo when they coincide)."""
    flat = lo == hi
    start = F.when(flat, lo - 0.5).otherwise(lo)
    width = F.when(flat, F.lit(1.0)).otherwise(hi - lo) / bins
    return (
        df.withColumn("bins", bins)
        .withColumn("width", width)
        .withColumn(
            "_bin", F.least(F.floor((value - start) / F.col("width")), F.col("bins") - 1)
        )
        .groupBy(*keys, "n", "bins", "width", "_bin")
        .agg(F.count(F.lit(1)).alias("count"))
    )


def period_entropy(df: DataFrame, keys: Sequence[str] = KEYS, value: str = "x") -> DataFrame:
    """ppe: entropy of log2(period / mean period) in 100 bins; 0 below ten voiced samples."""
    voice = heard(F.col(value))
    period = F.when(voice, F.try_divide(F.lit(1.0), F.col(value)))
    stats = df.groupBy(*keys).agg(
        F.count(period).alias("n"), F.avg(period).alias("_m"), F.min(period).alias("_lo"),
        F.max(period).alias("_hi"),
    )
    rows = df.filter(voice).select(*keys, period.alias("_p"))
    rows = rows.join(stats.filter("n >= 10"), list(keys))
    m = F.col("_m")
    binned = _binned(
        rows, keys, F.log2(F.col("_p") / m), F.log2(F.col("_lo") / m),
        F.log2(F.col("_hi") / m), F.lit(100),
    )
    found = _histogram_entropy(binned, keys, F.log2(F.lit(100.0)))
    return stats.select(*keys).join(found, list(keys), "left").select(
        *keys, F.coalesce("entropy", F.lit(0.0)).alias("ppe")
    )


def first_recurrence(
    df: DataFrame,
    keys: Sequence[str] = KEYS,
    pos: str = "t",
    value: str = "x",
    eps: float = 0.5,
    look: int = 24,
    reach: int = 4096,
) -> DataFrame:
    """Per sample the distance to the first later sample nearer than ``eps`` deviations.

    Most samples recur within ``look`` rows, seen through lead columns. Those left over search
    the array of their own and the next block of ``reach`` samples. What is still open then is
    a value that stays away for thousands of samples; ``_far_recurrence`` finds its match at any
    distance from block summaries.
    """
    scored = with_stats(
        df.select(*keys, pos, value), keys,
        {"_mu": F.avg(value), "_sd": F.stddev_pop(value), "n": F.count(F.lit(1))},
    ).select(
        *keys, pos, "n", ((F.col(value) - F.col("_mu")) / (F.col("_sd") + 1e-8)).alias("_z")
    )
    z = F.col("_z")

    def build(w):
        return {f"_z{i}": F.lead(z, i).over(w) for i in range(1, look + 1)}

    near = neighbourhood(scored, keys, pos, 0, look, build)
    step = F.coalesce(
        *[F.when(F.abs(F.col(f"_z{i}") - z) < eps, i) for i in range(1, look + 1)], F.lit(0)
    )
    stepped = materialise(
        near.select(*keys, pos, "n", "_z", step.cast("long").alias("_step")), "steps"
    )
    done = stepped.filter("_step > 0").select(*keys, pos, "n", F.col("_step").alias("length"))
    left = stepped.filter((F.col("_step") == 0) & (F.col(pos) + look < F.col("n") - 1))
    if not left.take(1):
        return done

    arrays = block_arrays(stepped.select(*keys, pos, "_z"), keys, pos, "_z", reach, reach)
    start = (F.col(pos) - F.col("first") + look + 2).cast("int")
    tail = F.slice("xs", start, F.greatest(F.size("xs") - start + 1, F.lit(0)))
    at = F.array_position(F.transform(tail, lambda v: F.abs(v - z) < eps), True)
    seen = materialise(
        left.withColumn("first", position_block(pos, reach) * reach)
        .join(arrays, [*keys, "first"])
        .select(
            *keys, pos, "n", "_z", (F.col("first") + F.size("xs") - 1).alias("_seen"),
            (F.nullif(at, F.lit(0).cast("long")) + look).alias("length"),
        ),
        "seen",
    )
    done = done.unionByName(
        seen.filter("length is not null").select(*keys, pos, "n", "length")
    )
    far = seen.filter((F.col("length").isNull()) & (F.col("_seen") < F.col("n") - 1))
    if not far.take(1):
        return done
    return done.unionByName(_far_recurrence(far.drop("length"), stepped, keys, pos, eps, reach))


def _far_recurrence(open_rows, points, keys, pos, eps: float, reach: int) -> DataFrame:
    """First match behind ``_seen``, the end of a block.

    Values fall into cells of a sixteenth of ``eps``. Cells up to 15 away match for sure, so
    the first position per cell and block is enough; only the two cells 16 away are compared
    value by value, and only before the sure match.
    """
    z = F.col("_z")
    cell = F.floor(z / (eps / 16))
    row = [*keys, pos]
    celled = points.select(*keys, F.col(pos).alias("_p"), z.alias("_zp"), cell.alias("_cell"))
    summary = celled.groupBy(*keys, "_cell", position_block("_p", reach).alias("_b")).agg(
        F.min("_p").alias("_p")
    )
    sure = (
        open_rows.select(*row, "_seen", F.explode(F.sequence(cell - 15, cell + 15)).alias("_cell"))
        .join(summary, [*keys, "_cell"])
        .filter(F.col("_p") > F.col("_seen"))
        .groupBy(*row)
        .agg(F.min("_p").alias("_sure"))
    )
    bounded = materialise(open_rows.join(sure, row, "left"), "bounded")
    edge = (
        bounded.select(
            *row, "_seen", "_z", F.coalesce("_sure", "n").alias("_limit"),
            F.explode(F.array(cell - 16, cell + 16)).alias("_cell"),
        )
        .join(celled, [*keys, "_cell"])
        .filter(
            (F.col("_p") > F.col("_seen")) & (F.col("_p") < F.col("_limit"))
            & (F.abs(F.col("_zp") - z) < eps)
        )
        .groupBy(*row)
        .agg(F.min("_p").alias("_edge"))
    )
    return (
        bounded.join(edge, row, "left")
        .withColumn("length", F.least("_sure", "_edge") - F.col(pos))
        .filter("length is not null")
        .select(*row, "n", "length")
    )


def recurrence_entropy(
    df: DataFrame, keys: Sequence[str] = KEYS, pos: str = "t", value: str = "x",
    clean: bool = False,
) -> DataFrame:
    """rpde: entropy of first-recurrence lengths; 0.5 below 20 samples or 5 recurrences.

    ``clean`` says that the contour has voiced samples only.
    """
    contour = df if clean else materialise(voiced(df, keys, pos, value), "contour")
    lengths = materialise(
        first_recurrence(contour, keys, pos, value)
        .filter("n >= 20")
        .groupBy(*keys, "length")
        .agg(F.count(F.lit(1)).alias("count")),
        "lengths",
    )
    sized = with_stats(
        lengths, keys,
        {"n": F.sum("count"), "_lo": F.min("length"), "_hi": F.max("length")},
    ).filter("n >= 5")
    bins = F.least(F.lit(30), F.floor(F.col("n") / 2) + 1)
    flat = F.col("_lo") == F.col("_hi")
    start = F.when(flat, F.col("_lo") - 0.5).otherwise(F.col("_lo"))
    width = F.when(flat, F.lit(1.0)).otherwise(F.col("_hi") - F.col("_lo")) / bins
    binned = (
        sized.withColumn("bins", bins)
        .withColumn("width", width)
        .withColumn(
            "_bin",
            F.least(F.floor((F.col("length") - start) / F.col("width")), F.col("bins") - 1),
        )
        .groupBy(*keys, "n", "bins", "width", "_bin")
        .agg(F.sum("count").alias("count"))
    )
    found = _histogram_entropy(binned, keys, F.log2(F.lit(30.0)))
    return df.select(*keys).distinct().join(found, list(keys), "left").select(
        *keys, F.coalesce("entropy", F.lit(0.5)).alias("rpde")
    )


# --- scaling -------------------------------------------------------------------------------


def box_sizes(top: Column) -> Column:
    """Up to 12 whole sizes from 4 to ``top``, evenly spaced on a log scale."""
    low = F.log10(F.lit(4.0))
    return F.array_distinct(
        F.transform(
            F.sequence(F.lit(0), F.lit(11)),
            lambda i: F.rint(
                F.pow(F.lit(10.0), low + i * (F.log10(top.cast("double")) - low) / 11.0)
            ).cast("long"),
        )
    )


def fluctuation(
    df: DataFrame, keys: Sequence[str] = KEYS, pos: str = "t", value: str = "x",
    clean: bool = False,
) -> DataFrame:
    """dfa: slope of ln F(box) over ln box for 12 box sizes from 4 to n/4; 0.7 as fallback.

    The detrended residual of a box comes from regression moments, which combine map-side.
    """
    contour = df if clean else materialise(voiced(df, keys, pos, value), "contour")
    y = profile(contour, keys, pos, value)
    sizes = contour.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter("_n >= 30").select(
        *keys, box_sizes(F.floor(F.col("_n") / 4)).alias("_sizes")
    )
    k = F.floor(F.col(pos) / F.col("box"))
    boxed = (
        y.join(sizes, list(keys))
        .select(*keys, pos, "n", "y", F.explode("_sizes").alias("box"))
        .filter((F.col("box") >= 2) & (F.floor(F.col("n") / F.col("box")) >= 2))
        .filter(k < F.floor(F.col("n") / F.col("box")))
    )
    # positions inside a box are 0..box-1, so their variance is (box^2 - 1) / 12
    t = (F.col(pos) % F.col("box")).cast("double")
    per_box = boxed.groupBy(*keys, "box", k.alias("_k")).agg(
        F.var_pop("y").alias("_vy"), F.covar_pop("y", t).alias("_cty")
    )
    vt = (F.col("box") * F.col("box") - 1) / 12.0
    resid = F.greatest(F.lit(0.0), F.col("_vy") - F.col("_cty") * F.col("_cty") / vt)
    per_size = per_box.groupBy(*keys, "box").agg(
        F.avg(F.sqrt(resid)).alias("_f")
    )
    slope = F.regr_slope(F.ln(F.col("_f") + 1e-10), F.ln(F.col("box").cast("double")))
    found = per_size.groupBy(*keys).agg(
        slope.alias("_a"), F.count(F.lit(1)).alias("_sizes")
    ).filter("_sizes >= 4")
    return df.select(*keys).distinct().join(found, list(keys), "left").select(
        *keys, F.coalesce(clamp(F.col("_a"), 0.1, 2.0), F.lit(0.7)).alias("dfa")
    )


def delay_vectors(df: DataFrame, keys: Sequence[str] = KEYS, pos: str = "t", value: str = "x"):
    """(keys, pos, a, b, c): three consecutive samples, complete ones only."""

    def build(w):
        return {
            "a": F.col(value), "b": F.lead(value, 1).over(w), "c": F.lead(value, 2).over(w)
        }

    return neighbourhood(df.select(*keys, pos, value), keys, pos, 0, 2, build).select(
        *keys, pos, "a", "b", "c"
    ).filter(F.col("c").isNotNull())


PAIRS = 500
_M = 2147483647


def _draw(k: Column, factor: int, shift: int, n: Column) -> Column:
    """A number below ``n`` scattered by ``k`` alone, the same in every run and engine."""
    u = (k + 1) * factor % _M
    v = (u * u + shift * u) % _M
    return (v * 2147483648 + v * 69621 % _M) % n


def drawn_pairs(
    vectors: DataFrame, keys: Sequence[str] = KEYS, pos: str = "t", most: int = PAIRS, reach: int = 4096
) -> tuple[DataFrame, DataFrame]:
    """``sampled_pairs`` of the keys with up to ``reach`` vectors, and those of the others.

    A short key's vectors are one array and its pairs are read from it, so the pairs, many times
    the rows, are neither joined nor shuffled. Longer keys have few pairs for their rows and join them.
    """
    n = F.col("_n")
    named = vectors
    for k in keys:
        named = named.filter(F.col(k).isNotNull())
    sizes = named.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"), F.min(pos).alias("_lo"), F.max(pos).alias("_hi")
    ).filter("_n >= 2")
    short = (n <= reach) & (F.col("_lo") == 0) & (F.col("_hi") == n - 1)
    vector = F.struct("a", "b", "c")
    whole = (
        named.join(sizes.filter(short).select(*keys, "_n"), list(keys))
        .groupBy(*keys, "_n")
        .agg(F.array_sort(F.collect_list(F.struct(F.col(pos).alias("_t"), "a", "b", "c"))).alias("_v"))
    )

    def drawn(sized: DataFrame, *columns: str) -> DataFrame:
        return (
            sized.withColumn("_pairs", F.least(F.lit(most), F.floor(n.cast("double") * (n - 1) / 2)))
            .select(*keys, *columns, "_n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_pairs") - 1)).alias("_k"))
            .select(*keys, *columns, "_k", _draw(F.col("_k"), 48271, 0, n).alias("_i"), _draw(F.col("_k"), 40692, 1, n).alias("_j"))
            .filter("_i != _j")
        )

    def apart(pairs: DataFrame, x: Column, y: Column) -> DataFrame:
        gaps = [F.pow(x[d] - y[d], 2) for d in "abc"]
        return pairs.select(*keys, "_k", F.sqrt(gaps[0] + gaps[1] + gaps[2]).alias("dist"))

    near = apart(drawn(whole, "_v"), F.get("_v", F.col("_i").cast("int")), F.get("_v", F.col("_j").cast("int")))
    # the planner takes exploded pairs for as small as the sizes they come from: it must not broadcast them
    pairs = drawn(sizes.filter(~short)).hint("merge")
    left = named.select(*keys, F.col(pos).alias("_i"), vector.alias("_x"))
    right = named.select(*keys, F.col(pos).alias("_j"), vector.alias("_y"))
    both = pairs.join(left, [*keys, "_i"]).hint("merge").join(right, [*keys, "_j"])
    return near, apart(both, F.col("_x"), F.col("_y"))


def sampled_pairs(
    vectors: DataFrame, keys: Sequence[str] = KEYS, pos: str = "t", most: int = PAIRS
) -> DataFrame:
    """Distances of up to ``most`` drawn pairs of delay vectors per key (columns keys, dist).

    The draw replaces all-pairs work: its size does not grow with the series.
    """
    near, far = drawn_pairs(vectors, keys, pos, most)
    return near.unionByName(far)


def correlation_dimension(
    df: DataFrame, keys: Sequence[str] = KEYS, pos: str = "t", value: str = "x",
    clean: bool = False,
) -> DataFrame:
    """d2: slope of ln C(r) over ln r at the 10..50 % distances, within 1..4; 2.3 fallback."""
    sizes = df.groupBy(*keys).agg(F.count(F.when(heard(F.col(value)), 1)).alias("n"))
    contour = df if clean else voiced(df, keys, pos, value)
    vectors = materialise(delay_vectors(contour, keys, pos, value), "vectors")
    # at most 500 distances per key, so the built-in percentile and a list are bounded; pairs read
    # from a key's array already lie together, so the two sorts of pairs are grouped apart
    near, far = (
        dist.groupBy(*keys).agg(
            F.percentile("dist", F.array(*[F.lit(p / 10) for p in range(1, 6)])).alias("r"),
            F.collect_list("dist").alias("_d"),
        )
        for dist in drawn_pairs(vectors, keys, pos)
    )
    at = near.unionByName(far)
    points = at.filter(F.size("_d") >= 20).filter(F.get("r", F.lit(0)) > 0).select(
        *keys, "_d", F.explode("r").alias("r")
    )
    r = F.col("r")
    c = F.size(F.filter("_d", lambda d: d < r)) / F.size("_d") + 1e-10
    slope = points.select(*keys, F.ln(r + 1e-10).alias("lr"), F.ln(c).alias("lc")).groupBy(
        *keys
    ).agg(F.regr_slope("lc", "lr").alias("_s"))
    return sizes.join(slope, list(keys), "left").select(
        *keys,
        F.when(F.col("n") >= 30, F.coalesce(clamp(F.col("_s"), 1.0, 4.0), F.lit(2.3)))
        .otherwise(2.3)
        .alias("d2"),
    )


# --- lookups, grids, peaks --------------------------------------------------------------------


def asof_lookup(
    samples: DataFrame,
    marks: DataFrame,
    keys: Sequence[str],
    time: str,
    payload: Sequence[str],
    block: Column,
) -> DataFrame:
    """Each sample takes the latest mark at or before it, else the first mark of its key."""
    mark = F.struct(time, *payload)
    both = samples.withColumn("_mark", F.lit(None).cast(marks.select(mark).schema[0].dataType))
    both = both.withColumn("_side", F.lit(1)).unionByName(
        marks.select(*keys, time, mark.alias("_mark"), F.lit(0).alias("_side")),
        allowMissingColumns=True,
    )
    filled = prefix(both, keys, block, [time, "_side"], maxima={"_last": F.col("_mark")})
    first = marks.groupBy(*keys).agg(F.min(mark).alias("_first"))
    found = filled.filter("_side = 1").join(first, list(keys), "left")
    got = F.coalesce("_last", "_first")
    return found.select(
        *samples.columns,
        got[time].alias(f"mark_{time}"),
        *[got[p].alias(p) for p in payload],
    )


def resample(
    df: DataFrame, rate_in: int, rate_out: int, keys: Sequence[str] = KEYS, pos: str = "t",
    value: str = "x",
) -> DataFrame:
    """Linear interpolation on a grid of ``rate_out`` from samples at ``rate_in``."""
    t = F.col(pos)

    def build(w):
        return {"_next": F.lead(value).over(w)}

    near = neighbourhood(df.select(*keys, pos, value), keys, pos, 0, 1, build)
    first = F.ceil(t * rate_out / rate_in)
    final = F.when(F.col("_next").isNull(), F.floor(t * rate_out / rate_in)).otherwise(
        F.ceil((t + 1) * rate_out / rate_in) - 1
    )
    grid = near.filter(final >= first).select(
        "*", F.explode(F.sequence(first, final)).alias("g")
    )
    share = F.col("g") * rate_in / rate_out - t
    step = F.coalesce(F.col("_next"), F.col(value)) - F.col(value)
    return grid.select(*keys, "g", (F.col(value) + step * share).alias("x"))


def peaks(
    df: DataFrame, spacing: int, rise: float = 0.01, keys: Sequence[str] = KEYS, pos: str = "t",
    value: str = "x",
) -> DataFrame:
    """Local maxima that lead their ``spacing`` neighbourhood: (keys, pos, i, amplitude, n)."""
    x = F.col(value)

    def build(w):
        around = w.rowsBetween(-spacing, spacing)
        return {
            "_prev": F.lag(x).over(w), "_next": F.lead(x).over(w),
            "_top": F.max(x).over(around), "_low": F.min(x).over(around),
        }

    reach = max(1, spacing)
    near = neighbourhood(df.select(*keys, pos, value), keys, pos, reach, reach, build)
    top = near.filter(
        (x > F.col("_prev")) & (x >= F.col("_next")) & (x == F.col("_top"))
        & (x - F.col("_low") >= rise)
    ).select(*keys, pos, x.alias("amplitude"))
    numbered = dense_index(top, keys, position_block(pos), [pos], "i")
    return with_stats(numbered, keys, {"n": F.count(F.lit(1))})


def cycles(
    df: DataFrame, rate: float, pitch: float, keys: Sequence[str] = KEYS, pos: str = "t",
    value: str = "x",
) -> DataFrame:
    """(keys, i, period, amplitude) from peaks at least 0.8 cycles apart; none below five."""
    found = peaks(df, int(0.8 * rate / pitch), keys=keys, pos=pos, value=value)

    def build(w):
        return {"period": (F.lead(pos).over(w) - F.col(pos)) / rate}

    return neighbourhood(found.filter("n >= 5"), keys, "i", 0, 1, build).select(
        *keys, "i", "period", "amplitude"
    )


def crossing_rate(df: DataFrame, keys: Sequence[str] = KEYS, pos: str = "t", value: str = "x"):
    """zcr: share of neighbouring samples whose sign differs."""

    def build(w):
        return {"_prev": F.lag(value).over(w)}

    near = neighbourhood(df.select(*keys, pos, value), keys, pos, 1, 0, build)
    crossed = (F.col(value) < 0) != (F.col("_prev") < 0)
    return near.groupBy(*keys).agg(F.avg(crossed.cast("double")).alias("zcr"))
