"""Ordered work on series that may be far larger than one task.

A plain ``Window.partitionBy(series)`` sends a whole series to one task. One series may
hold a third of all rows, so no operator here does that. Three building blocks replace it:

``prefix``         running sum / max along a key: local pass inside blocks, then the
                   block totals (few rows) give every block its carry-in.
``neighbourhood``  lag, lead and moving frames: rows near a block border are copied to
                   the next block, so that each block of bounded size is self-sufficient.
``quantiles``      exact order statistics from ranks over value blocks.

``prefix`` and ``with_stats`` read their input twice (the second time for a few columns and
combined map-side). Chains of them would double with every link, so the operators store a
step that is read again (``session.materialise``); callers pass stored tables.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from timbrel.session import materialise

# Positions per block. Bounds the rows of every window partition below.
BLOCK = 65536


def whole_div(a: Column, b: int | Column) -> Column:
    """Floor division for integer columns."""
    return F.floor(a / b).cast("long")


def position_block(pos: str | Column, size: int = BLOCK) -> Column:
    col = F.col(pos) if isinstance(pos, str) else pos
    return F.shiftright(col.cast("long"), size.bit_length() - 1)


def prefix(
    df: DataFrame,
    keys: Sequence[str],
    block: Column,
    order: Sequence[str | Column],
    *,
    sums: dict[str, Column] | None = None,
    maxima: dict[str, Column] | None = None,
    before: bool = False,
) -> DataFrame:
    """Running totals and running maxima per key, in ``order``.

    ``block`` must grow with ``order``: all rows of a lower block come first. ``before``
    leaves the row itself out of its totals. The rows are shuffled once, on (keys, block);
    the second pass sees one row per block only. Null keys form a group of their own and a null
    block comes first, as in a window: keys and block travel as one struct, whose fields compare
    as equal when both are null.
    """
    sums, maxima = sums or {}, maxima or {}
    names = [*sums, *maxima]
    raw = {n: f"_v_{n}" for n in names}
    keyed = df.select(
        "*",
        F.struct(*[F.col(k) for k in keys], block.alias("_block")).alias("_place"),
        *[c.alias(raw[n]) for n, c in {**sums, **maxima}.items()],
    )
    last = -1 if before else Window.currentRow
    local = (
        Window.partitionBy("_place").orderBy(*order).rowsBetween(Window.unboundedPreceding, last)
    )
    totals = keyed.groupBy("_place").agg(
        *[F.sum(raw[n]).alias(raw[n]) for n in sums],
        *[F.max(raw[n]).alias(raw[n]) for n in maxima],
    )
    earlier = (
        Window.partitionBy(*[F.col("_place").getField(k) for k in keys])
        .orderBy(F.col("_place").getField("_block"))
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    carry = totals.select(
        "_place",
        *[F.sum(raw[n]).over(earlier).alias(f"_c_{n}") for n in sums],
        *[F.max(raw[n]).over(earlier).alias(f"_c_{n}") for n in maxima],
    )
    inside = keyed.select(
        *df.columns,
        "_place",
        *[F.sum(raw[n]).over(local).alias(f"_l_{n}") for n in sums],
        *[F.max(raw[n]).over(local).alias(f"_l_{n}") for n in maxima],
    )

    def joined(n: str) -> Column:
        inner, carried = F.col(f"_l_{n}"), F.col(f"_c_{n}")
        if n in maxima:
            return F.greatest(inner, carried).alias(n)
        zero = F.lit(0)
        return (F.coalesce(inner, zero) + F.coalesce(carried, zero)).alias(n)

    kept = [c for c in df.columns if c not in names]
    return inside.join(carry, "_place").select(*kept, *[joined(n) for n in names])


def dense_index(
    df: DataFrame,
    keys: Sequence[str],
    block: Column,
    order: Sequence[str | Column],
    name: str = "t",
) -> DataFrame:
    """0-based position of every row within its key (``row_number() - 1``)."""
    out = prefix(df, keys, block, order, sums={name: F.lit(1).cast("long")})
    return out.withColumn(name, F.col(name) - 1)


def neighbourhood(
    df: DataFrame,
    keys: Sequence[str],
    pos: str,
    back: int,
    ahead: int,
    build: Callable[[Window], dict[str, Column]],
    size: int = BLOCK,
) -> DataFrame:
    """Window columns that reach ``back`` rows before and ``ahead`` rows after.

    ``pos`` must be dense (0, 1, 2, ... per key). ``build`` gets the window ordered by
    ``pos`` and returns the new columns.
    """
    own = position_block(pos, size)
    first = position_block(F.greatest(F.col(pos) - ahead, F.lit(0)), size)
    final = position_block(F.col(pos) + back, size)
    blocks = df.select(
        "*",
        F.explode(
            F.when(first == final, F.array(first)).otherwise(F.sequence(first, final))
        ).alias("_block"),
    )
    w = Window.partitionBy(*keys, "_block").orderBy(pos)
    made = build(w)
    kept = [c for c in df.columns if c not in made]
    return blocks.select(
        *kept,
        (F.col("_block") == own).alias("_own"),
        *[c.alias(n) for n, c in made.items()],
    ).filter("_own").drop("_own")


def block_arrays(
    df: DataFrame,
    keys: Sequence[str],
    pos: str,
    value: str,
    ahead: int,
    size: int = 4096,
) -> DataFrame:
    """One row per block of ``size`` positions: (keys, first, own, xs).

    ``xs`` holds the samples of the block in order plus up to ``ahead`` following ones, so
    it is bounded by ``size + ahead``; ``own`` counts the samples that belong to the block.
    """
    first = position_block(F.greatest(F.col(pos) - ahead, F.lit(0)), size)
    final = position_block(pos, size)
    return (
        df.select(
            *keys,
            F.col(pos).alias("_pos"),
            F.col(value).cast("double").alias("_x"),
            F.explode(
                F.when(first == final, F.array(first)).otherwise(F.sequence(first, final))
            ).alias("_block"),
        )
        .groupBy(*keys, "_block")
        .agg(
            F.array_sort(F.collect_list(F.struct("_pos", "_x"))).alias("_s"),
            F.sum((position_block("_pos", size) == F.col("_block")).cast("int")).alias("own"),
        )
        .filter("own > 0")
        .select(
            *keys,
            (F.col("_block") * size).alias("first"),
            "own",
            F.col("_s._x").alias("xs"),
        )
    )


def with_stats(df: DataFrame, keys: Sequence[str], stats: dict[str, Column]) -> DataFrame:
    """Attach per-key aggregates: map-side combined, then joined back.

    The stats side holds one row per key. Small sides are broadcast by Spark's own size
    check; beyond it the adaptive planner splits hot keys. Rows with null keys keep together.
    """
    aggs = [c.alias(n) for n, c in stats.items()]
    if not keys:  # one row of numbers: attach them as constants
        one = df.agg(*aggs)
        row = one.first()
        return df.withColumns(
            {f.name: F.lit(row[f.name]).cast(f.dataType) for f in one.schema.fields}
        )
    keyed = df.withColumn("_key", F.struct(*keys))
    return keyed.join(keyed.groupBy("_key").agg(*aggs), "_key").drop("_key")


STEPS = 10  # halvings of the search below, so 2 ** 10 ranges per key


def value_blocks(
    df: DataFrame, keys: Sequence[str], value: str, per_block: int = BLOCK
) -> DataFrame:
    """Attach ``_block``, which grows with ``value`` and splits a key into ranges of equal counts.

    Only keys with more than ``per_block`` rows get range ends, from an approximate quantile
    sketch; so outliers, narrow ranges and heavy tails leave blocks as even as uniform values do.
    """
    place = F.struct(*[F.col(k) for k in keys]) if keys else F.lit(0)
    keyed = df.withColumn("_key", place)
    big = keyed.groupBy("_key").agg(F.count(F.lit(1)).alias("_rows")).filter(F.col("_rows") > per_block)
    ends = F.percentile_approx(value, [i / 2**STEPS for i in range(1, 2**STEPS)], F.lit(10**5))
    split = materialise(
        keyed.join(big.select("_key"), "_key", "left_semi").groupBy("_key").agg(ends.alias("_ends")), "ranges"
    )
    halves = F.array(*[F.lit(2**i) for i in reversed(range(STEPS))])
    found = F.aggregate(
        halves, F.lit(0),
        lambda at, step: F.when(F.get("_ends", at + step - 1) < F.col(value), at + step).otherwise(at),
    )
    joined = keyed.join(split, "_key", "left")
    block = F.when(F.col("_ends").isNull(), 0).otherwise(found).cast("long")
    return joined.withColumn("_block", block).drop("_key", "_ends")


def ranked_values(
    df: DataFrame, keys: Sequence[str], value: str, per_block: int = BLOCK
) -> DataFrame:
    """Distinct values per key with their row counts and ranks.

    Returns (keys, value, copies, below, n): ``below`` rows of the key are smaller, ``n``
    rows in all. Copies of a value are merged before the shuffle; value blocks of equal
    counts keep every window partition small. Null and NaN values do
    not count: they make one row without copies, so that a key of nothing else stays.
    """
    if isinstance(df.schema[value].dataType, (T.DoubleType, T.FloatType)):
        df = df.withColumn(value, F.nanvl(value, F.lit(None)))
    counted = materialise(df.groupBy(*keys, value).agg(F.count(value).alias("copies")), "values")
    sized = with_stats(
        counted,
        keys,
        {"n": F.sum("copies")},
    )
    placed = value_blocks(sized, keys, value, per_block).withColumnRenamed("_block", "_range")
    out = prefix(placed, keys, F.col("_range"), [value], sums={"_upto": F.col("copies")})
    return out.select(
        *keys, value, "copies", (F.col("_upto") - F.col("copies")).alias("below"), "n"
    )


def quantiles(
    df: DataFrame, keys: Sequence[str], value: str, probs: dict[str, float]
) -> DataFrame:
    """Exact quantiles with linear interpolation, one column per entry of ``probs``."""
    ranked = ranked_values(df, keys, value)
    below, copies, x = F.col("below"), F.col("copies"), F.col(value)

    def at(rank: Column) -> Column:
        return F.max(F.when((below <= rank) & (rank < below + copies), x))

    aggs = []
    for name, p in probs.items():
        spot = (F.col("n") - 1) * F.lit(float(p))
        low = F.floor(spot)
        high = F.least(low + 1, F.col("n") - 1)
        a, b = at(low), at(high)
        share = F.max(spot - low)
        aggs.append((a + (b - a) * share).alias(name))
    return ranked.groupBy(*keys).agg(*aggs)
