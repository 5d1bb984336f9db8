"""Bilinear interpolation in tables of grid nodes: cells carry their four corners, points join once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CORNERS = ((0, 0), (0, 1), (1, 0), (1, 1))


def axes(grid: DataFrame, keys: list[str], y: str, x: str) -> DataFrame:
    """One row per grid: its node positions along both axes, ascending."""
    return grid.groupBy(*keys).agg(F.array_sort(F.collect_set(y)).alias("g_ys"), F.array_sort(F.collect_set(x)).alias("g_xs"))


def cells(grid: DataFrame, keys: list[str], y: str, x: str, values: list[str]) -> DataFrame:
    """Whole cells (keys, g_iy, g_ix) with ``values`` at the corners, e.g. u00, u01, u10, u11 (row, column).

    A node is a corner of four cells at most: one group-by brings them together.
    A cell that lacks a corner is left out.
    """
    at = grid.join(axes(grid, keys, y, x), keys).select(*keys, *values, (F.array_position("g_ys", F.col(y)) - 1).alias("j"), (F.array_position("g_xs", F.col(x)) - 1).alias("i"))
    corner = F.explode(F.array(*[F.struct(F.lit(f"{dy}{dx}").alias("k"), (F.col("j") - dy).alias("g_iy"), (F.col("i") - dx).alias("g_ix")) for dy, dx in CORNERS]))
    spread = at.withColumn("n", corner).select(*keys, *values, "n.*").where("g_iy >= 0 and g_ix >= 0")
    whole = spread.groupBy(*keys, "g_iy", "g_ix").agg(
        F.count_distinct("k").alias("g_n"), *[F.max(F.when(F.col("k") == f"{dy}{dx}", F.col(v))).alias(f"{v}{dy}{dx}") for v in values for dy, dx in CORNERS]
    )
    return whole.where("g_n = 4").drop("g_n")


def _below(axis: str, value: str) -> Column:
    """Number of the cell a value lies in; values beyond the ends belong to the last cells."""
    return F.greatest(F.lit(0), F.least(F.size(F.filter(axis, lambda a: a <= F.col(value))) - 1, F.size(axis) - 2)).cast("bigint")


def interpolate(points: DataFrame, grid: DataFrame, keys: list[str], y: str, x: str, values: list[str]) -> DataFrame:
    """``points`` (keys, y, x and others) with the ``values`` of ``grid`` between its nodes.

    Points outside are clamped to the edge. Axes may ascend or descend on input.
    """
    at = points.join(axes(grid, keys, y, x), keys)
    for i, t, axis, value in (("g_iy", "g_ty", "g_ys", y), ("g_ix", "g_tx", "g_xs", x)):
        at = at.withColumn(i, _below(axis, value))
        low, high = F.get(axis, F.col(i)), F.get(axis, F.col(i) + 1)
        at = at.withColumn(t, F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col(value) - low) / (high - low))))
    both = at.drop("g_ys", "g_xs").join(cells(grid, keys, y, x, values), [*keys, "g_iy", "g_ix"])
    tx, ty = F.col("g_tx"), F.col("g_ty")
    row = lambda v, dy: F.col(f"{v}{dy}0") * (1 - tx) + F.col(f"{v}{dy}1") * tx
    return both.select(*points.columns, *[(row(v, 0) * (1 - ty) + row(v, 1) * ty).alias(v) for v in values])
