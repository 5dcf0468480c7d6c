"""Resampling between grids: exact area shares, blocks, nearest, bilinear, and filling of gaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .joins import nearest_points


def block_stats(df: DataFrame, k: int, **aggs: Column) -> DataFrame:
    """(r, c, ...) of blocks of k x k cells."""
    return df.groupBy(F.floor(F.col("r") / k).cast("int").alias("r"), F.floor(F.col("c") / k).cast("int").alias("c")).agg(*[a.alias(n) for n, a in aggs.items()])


def fraction_three_in_two(mask: DataFrame, share: Column) -> DataFrame:
    """(r, c, f): the exact share of each coarse cell that fine cells cover, where three fine cells are as wide as two coarse ones.

    A fine cell is 2 x 2 sub-cells, a coarse one 3 x 3, and the coarse grid starts one sub-cell before the fine one.
    Each fine cell so adds at most four parts; parts of a coarse cell are summed before they are exchanged.
    """
    parts = mask.where(share > 0).withColumn("__s", share)
    for axis in "rc":
        first = F.col(axis) * 2 + 1
        coarse = F.array(*[F.floor((first + o) / 3).cast("int") for o in (0, 1)])
        parts = parts.withColumn(axis, F.explode(coarse))
    return parts.groupBy("r", "c").agg((F.sum("__s") / 9.0).alias("f"))


def nearest_resample(source: DataFrame, target: DataFrame, ratio: float, values: list[str]) -> DataFrame:
    """target's cells with the values of the source cell that holds their centre; ratio: target cells a source cell."""
    at = lambda a: F.floor((F.col(a) + 0.5) / ratio).cast("int")
    keyed = target.withColumns({"__r": at("r"), "__c": at("c")})
    src = source.select(F.col("r").alias("__r"), F.col("c").alias("__c"), *values)
    return keyed.join(src, ["__r", "__c"], "left").drop("__r", "__c")


def mode_resample(df: DataFrame, k: int, value: str) -> DataFrame:
    """(r, c, value): the commonest value of each block, ties to the least."""
    counts = df.groupBy(F.floor(F.col("r") / k).cast("int").alias("r"), F.floor(F.col("c") / k).cast("int").alias("c"), value).agg(F.count("*").alias("n"))
    return counts.groupBy("r", "c").agg(F.max(F.struct("n", (-F.col(value)).alias("v"))).alias("m")).select("r", "c", (-F.col("m.v")).alias(value))


def bilinear(source: DataFrame, points: DataFrame, value: str, rows: int, cols: int) -> DataFrame:
    """points (y, x in source grid units, centres at .5) with the value between the four centres around, clipped to them."""
    fy = F.least(F.greatest(F.col("y") - 0.5, F.lit(0.0)), F.lit(rows - 1.0))
    fx = F.least(F.greatest(F.col("x") - 0.5, F.lit(0.0)), F.lit(cols - 1.0))
    r0, c0 = F.least(F.floor(fy), F.lit(max(rows - 2, 0))).cast("int"), F.least(F.floor(fx), F.lit(max(cols - 2, 0))).cast("int")
    base = points.withColumns({"__r0": r0, "__c0": c0}).withColumns({"__dy": fy - F.col("__r0"), "__dx": fx - F.col("__c0")})
    corner = [(i, j) for i in (0, 1) for j in (0, 1)]
    picks = F.array(*[F.struct((F.col("__r0") + i).alias("r"), (F.col("__c0") + j).alias("c"), ((F.col("__dy") if i else 1 - F.col("__dy")) * (F.col("__dx") if j else 1 - F.col("__dx"))).alias("w")) for i, j in corner])
    keys = points.columns
    wide = base.select(*keys, F.inline(picks)).where("w > 0")
    return wide.join(source.select("r", "c", value), ["r", "c"]).groupBy(*keys).agg(F.sum(F.col("w") * F.col(value)).alias(value))


def fill_nearest(df: DataFrame, value: str, valid: Column, ties: str = "id") -> DataFrame:
    """df (r, c) with invalid values replaced by that of the nearest valid cell, ties to the first by row and column."""
    width = 1 << 20
    cells = df.withColumns({ties: F.col("r").cast("long") * width + F.col("c"), "x": F.col("c").cast("double"), "y": F.col("r").cast("double")})
    good = cells.where(valid).select(F.col(ties).alias("__src"), F.col(value).alias("__v"), "x", "y")
    hit = nearest_points(cells.where(~F.coalesce(valid, F.lit(False))), good, ties, "__src").select(ties, "__src").join(good.select("__src", "__v").hint("merge"), "__src")
    return cells.join(hit.drop("__src").hint("merge"), ties, "left").withColumn(value, F.when(valid, F.col(value)).otherwise(F.col("__v"))).drop(ties, "x", "y", "__v")
