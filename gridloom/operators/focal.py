"""Focal operators on long grids (r, c, value): each cell from its neighbourhood.

Neighbourhoods are array kernels over tiles with halos (tiles.py): one exchange of the grid, whatever the size of the
neighbourhood. Borders follow each operator's own rule.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalar as S
from .lineage import cut
from .ranking import quantiles
from .tiles import Box, beside, over_tiles


def neighbourhood(df: DataFrame, value: str = "z") -> DataFrame:
    """df with z1 ... z9, the 3 x 3 window row by row, for a full rectangular grid.

    Outside the border a value is what a straight line through the edge cell and the one inside it gives.
    """

    def kernel(box: Box, arrays: list[np.ndarray]) -> list[np.ndarray]:
        z = arrays[0]

        def side(a: np.ndarray, rows: int, cols: int) -> np.ndarray:
            near = beside(a, rows, cols)
            return np.where(np.isnan(near), 2 * a - beside(a, -rows, -cols), near)

        middle = [side(z, 0, -1), z, side(z, 0, 1)]
        return [*(side(a, -1, 0) for a in middle), *middle, *(side(a, 1, 0) for a in middle)]

    return over_tiles(df, [value], 1, kernel, ", ".join(f"z{k} double" for k in range(1, 10)))


def gradient(df: DataFrame, dx: Column | float, dy: Column | float, value: str = "z") -> DataFrame:
    """df with p (to the east) and q (to the north) by weighted central differences; one neighbourhood feeds all that follows."""
    z = [None, *[F.col(f"z{k}") for k in range(1, 10)]]
    p = (z[3] + z[6] * 2 + z[9] - z[1] - z[4] * 2 - z[7]) / (S.as_col(dx) * 8)
    q = (z[1] + z[2] * 2 + z[3] - z[7] - z[8] * 2 - z[9]) / (S.as_col(dy) * 8)
    return neighbourhood(df, value).withColumns({"p": p, "q": q})


def curvatures(df: DataFrame, dx: Column | float, dy: Column | float, value: str = "z") -> DataFrame:
    """df with general, plan and profile curvature."""
    n = neighbourhood(df, value)
    general, plan, profile = S.surface_curvatures({k: F.col(f"z{k}") for k in range(1, 10)}, S.as_col(dx), S.as_col(dy))
    return n.select(*df.columns, general.alias("general"), plan.alias("plan"), profile.alias("profile"))


def simple_gradient(df: DataFrame, dx: float, dy: float, value: str = "z") -> DataFrame:
    """df with gx and gy: central differences inside, one-sided ones at the border."""

    def kernel(box: Box, arrays: list[np.ndarray]) -> list[np.ndarray]:
        z = arrays[0]

        def slope(before: np.ndarray, after: np.ndarray, step: float) -> np.ndarray:
            inside = ~np.isnan(before) & ~np.isnan(after)
            return np.where(inside, (after - before) / (2 * step), (np.where(np.isnan(after), z, after) - np.where(np.isnan(before), z, before)) / step)

        return [slope(beside(z, 0, -1), beside(z, 0, 1), dx), slope(beside(z, -1, 0), beside(z, 1, 0), dy)]

    return over_tiles(df, [value], 1, kernel, "gx double, gy double")


def weighted(df: DataFrame, values: list[str], weights: list[float]) -> DataFrame:
    """df with each value replaced by the weighted sum over a square of cells, by the same weights along rows and columns.

    Beyond the border cells repeat in reverse, edge cell first.
    """
    k = len(weights) // 2

    def kernel(box: Box, arrays: list[np.ndarray]) -> list[np.ndarray]:
        out = []
        for a in map(box.mirrored, arrays):
            for rows, cols in ((0, 1), (1, 0)):
                a = sum(w * beside(a, rows * o, cols * o) for o, w in zip(range(-k, k + 1), weights))
            out.append(a)
        return out

    return over_tiles(df, values, k, kernel, ", ".join(f"`{v}` double" for v in values)).select(*df.columns)


def box_mean(df: DataFrame, values: list[str], k: int) -> DataFrame:
    """df with each value replaced by its mean over (2k + 1) squared cells."""
    return weighted(df, values, [1 / (2 * k + 1)] * (2 * k + 1))


def gaussian(df: DataFrame, values: list[str], sigma: float = 2.0, truncate: float = 4.0) -> DataFrame:
    k = int(truncate * sigma + 0.5)
    raw = [math.exp(-0.5 * (o / sigma) ** 2) for o in range(-k, k + 1)]
    return weighted(df, values, [x / sum(raw) for x in raw])


def lee_filter(df: DataFrame, value: str, k: int = 2) -> DataFrame:
    """df with the value smoothed where its local variance is near that of the noise (the mean of all local variances)."""
    local = box_mean(df.withColumns({"__m": F.col(value), "__s": F.col(value) * F.col(value)}), ["__m", "__s"], k)
    local = cut(local.withColumn("__v", F.greatest(F.col("__s") - F.col("__m") * F.col("__m"), F.lit(0.0))))  # read for the noise and for the result
    noise = local.agg(F.avg("__v").alias("n")).first()["n"] or 0.0
    weight = F.coalesce(F.try_divide(F.col("__v"), F.col("__v") + noise), F.lit(0.0))
    return local.withColumn(value, F.col("__m") + weight * (F.col(value) - F.col("__m"))).drop("__m", "__s", "__v")


def median3(df: DataFrame, value: str) -> DataFrame:
    """df with the value replaced by the median of its 3 x 3 window; border cells count again for what is missing."""

    def kernel(box: Box, arrays: list[np.ndarray]) -> list[np.ndarray]:
        a = box.mirrored(arrays[0])
        return [np.sort(np.stack([beside(a, i, j) for i in (-1, 0, 1) for j in (-1, 0, 1)]), 0)[4]]

    return over_tiles(df, [value], 1, kernel, f"`{value}` double").select(*df.columns)


def dilate(mask: DataFrame, n: int) -> DataFrame:
    """(r, c) of all cells within n rows and columns of a mask's cells: widened along rows, then along columns."""
    wide = mask.select("r", F.explode(F.sequence(F.col("c") - n, F.col("c") + n)).alias("c")).distinct()
    return wide.select(F.explode(F.sequence(F.col("r") - n, F.col("r") + n)).alias("r"), "c").distinct()


def near(df: DataFrame, mask: Column, n: int, name: str) -> DataFrame:
    """df with a boolean column: is a cell of the mask within n rows and columns? Separable maxima."""

    def kernel(box: Box, arrays: list[np.ndarray]) -> list[np.ndarray]:
        a = np.nan_to_num(arrays[0])
        for rows, cols in ((0, 1), (1, 0)):
            a = np.max([np.nan_to_num(beside(a, rows * o, cols * o)) for o in range(-n, n + 1)], axis=0)
        return [a]

    found = over_tiles(df.withColumn("__m", mask.cast("double")), ["__m"], n, kernel, "__m double")
    return found.withColumn(name, F.col("__m") == 1).drop("__m")


def _in_db(df: DataFrame, value: str) -> tuple[DataFrame, float | None, bool]:
    """df with the value in decibels, the median of what it was, and whether it was converted."""
    low, mid = quantiles(df, value, [0.0, 0.5])
    linear = low is not None and low >= 0 and mid < 1
    return df.withColumn(value, S.linear_to_db(F.col(value))) if linear else df, mid, linear


def ensure_db(df: DataFrame, value: str) -> DataFrame:
    """df with the value in decibels: converted if it looks linear (nothing negative, median below 1)."""
    return _in_db(df, value)[0]


def preprocess(df: DataFrame, value: str, k: int = 2) -> DataFrame:
    """Decibels, smoothed on the linear scale; invalid cells take the median for it and are null again after it."""
    db, mid, converted = _in_db(cut(df), value)  # read for the quantiles, the borders and the filter
    db = db.withColumn("__ok", F.col(value).isNotNull())
    if converted:
        mid = quantiles(db, value, [0.5])[0]
    linear = db.withColumn(value, S.db_to_linear(F.coalesce(value, F.lit(mid))))
    return lee_filter(linear, value, k).withColumn(value, F.when(F.col("__ok"), S.linear_to_db(F.col(value)))).drop("__ok")
