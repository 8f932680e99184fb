"""Projected points: viewport and bounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# fixed values: half width and half height of a focused view, margin of the full view
HALF_X, HALF_Y, MARGIN = 1.2, 0.8, 0.8


def in_view(points: DataFrame, x: float, y: float) -> DataFrame:
    return points.filter(
        F.col("x").between(x - HALF_X, x + HALF_X) & F.col("y").between(y - HALF_Y, y + HALF_Y)
    )


def bounds(points: DataFrame) -> DataFrame:
    return points.agg(
        (F.min("x") - MARGIN).alias("min_x"), (F.max("x") + MARGIN).alias("max_x"),
        (F.min("y") - MARGIN).alias("min_y"), (F.max("y") + MARGIN).alias("max_y"),
    )
