"""Line density: lengths per lattice cell summed over a disk, and its exact check."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def length_in_circle(cx: Column, cy: Column, radius: float) -> Column:
    """Length of the segment (x1, y1)-(x2, y2) inside a circle: the parameter range between the two crossings."""
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    fx, fy = F.col("x1") - cx, F.col("y1") - cy
    a, b, c = dx * dx + dy * dy, (fx * dx + fy * dy) * 2, fx * fx + fy * fy - radius * radius
    disc = b * b - a * c * 4
    root = F.sqrt(F.greatest(disc, F.lit(0.0)))
    low, high = F.try_divide(-b - root, a * 2), F.try_divide(root - b, a * 2)
    inside = F.greatest(F.least(high, F.lit(1.0)) - F.greatest(low, F.lit(0.0)), F.lit(0.0))
    return F.when((disc > 0) & (a > 0), inside * F.sqrt(a)).otherwise(0.0)


def lattice_lengths(segs: DataFrame, cell: float, step: float) -> DataFrame:
    """(r, c, len): segments cut into pieces of at most `step`, each counted where its middle lies."""
    length = F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))
    n = F.greatest(F.ceil(length / step), F.lit(1))
    pieces = segs.withColumns({"__n": n, "__len": length}).withColumn("__i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__n"))))
    f = (F.col("__i") - 0.5) / F.col("__n")
    x, y = F.col("x1") + (F.col("x2") - F.col("x1")) * f, F.col("y1") + (F.col("y2") - F.col("y1")) * f
    return pieces.groupBy(F.floor(y / cell).cast("int").alias("r"), F.floor(x / cell).cast("int").alias("c")).agg(F.sum(F.col("__len") / F.col("__n")).alias("len"))


def disk_density(lengths: DataFrame, radius: int, cell: float) -> DataFrame:
    """(r, c, density): length within `radius` cells over the disk's area; each length goes to the cells of its disk, pre-summed by row runs."""
    runs = F.array(*[F.struct(F.lit(dr).alias("dr"), F.lit(int(math.sqrt(radius * radius - dr * dr))).alias("w")) for dr in range(-radius, radius + 1)])
    rows = lengths.select("r", "c", "len", F.inline(runs))
    spread = rows.select((F.col("r") + F.col("dr")).alias("r"), F.explode(F.sequence(F.col("c") - F.col("w"), F.col("c") + F.col("w"))).alias("c"), "len")
    return spread.groupBy("r", "c").agg((F.sum("len") / (math.pi * (radius * cell) ** 2)).alias("density"))
