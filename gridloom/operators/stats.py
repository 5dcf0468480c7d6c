"""Histograms and thresholds, correlations, modes, ranks of sources, mosaics."""

from __future__ import annotations

import itertools

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BINS = 512


def histogram(df: DataFrame, value: str, low: float, high: float, bins: int) -> DataFrame:
    """(bin, n) of equal bins over [low, high]; the last one is closed, values outside are left out."""
    at = F.floor((F.col(value) - low) / ((high - low) / bins)).cast("int")
    return df.where(F.col(value).between(low, high)).groupBy(F.least(at, F.lit(bins - 1)).alias("bin")).agg(F.count("*").alias("n"))


def otsu(df: DataFrame, value: str, low: float | None = None, high: float | None = None, bins: int = BINS) -> DataFrame:
    """(threshold): the centre of the bin that best parts the values in two classes, by the variance between them.

    The values are counted into bins in one aggregation; what follows is on the table of at most `bins` rows.
    """
    v = F.col(value)
    kept = df.where(v.isNotNull() & (F.lit(True) if low is None else v >= low) & (F.lit(True) if high is None else v <= high))
    lim = kept.agg(F.min(v).alias("a"), F.max(v).alias("b")).first()
    a, b = lim["a"] or 0.0, lim["b"] or 0.0
    width = (b - a) / bins or 1.0
    counts = kept.groupBy(F.least(F.floor((v - a) / F.lit(b - a if b > a else 1.0) * bins), F.lit(bins - 1)).cast("int").alias("bin")).agg(F.count("*").alias("n"))
    mids = counts.withColumn("mid", F.lit(a) + (F.col("bin") + 0.5) * width)
    w = Window.partitionBy(F.lit(0)).orderBy("bin")  # at most `bins` rows
    every = Window.partitionBy(F.lit(0))
    sums = mids.select("mid", F.sum("n").over(w).alias("w1"), F.sum(F.col("n") * F.col("mid")).over(w).alias("s1"), F.sum("n").over(every).alias("w"), F.sum(F.col("n") * F.col("mid")).over(every).alias("s"))
    between = (F.col("w1") * (F.col("w") - F.col("w1"))).cast("double") * F.pow(F.col("s1") / F.col("w1") - (F.col("s") - F.col("s1")) / (F.col("w") - F.col("w1")), F.lit(2.0))
    return sums.where("w1 < w").agg(F.max_by("mid", F.struct(between, -F.col("mid"))).alias("threshold"))


def separability(df: DataFrame, value: str, threshold: float) -> DataFrame:
    """low_share, low_mean, high_mean and eta, the share of the variance that lies between the classes."""
    v = F.col(value)
    s = df.agg(F.avg((v < threshold).cast("int")).alias("low_share"), F.avg(F.when(v < threshold, v)).alias("low_mean"), F.avg(F.when(v >= threshold, v)).alias("high_mean"), F.var_pop(v).alias("__var"))
    eta = F.try_divide(F.col("low_share") * (F.lit(1.0) - F.col("low_share")) * F.pow(F.col("low_mean") - F.col("high_mean"), F.lit(2.0)), F.col("__var"))
    return s.withColumn("eta", eta).drop("__var")


def correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """(x, y, r) for each pair of columns, from one aggregation."""
    pairs = list(itertools.combinations(columns, 2))
    row = df.agg(*[F.corr(x, y).alias(f"__{i}") for i, (x, y) in enumerate(pairs)])
    return row.select(F.inline(F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"), F.col(f"__{i}").alias("r")) for i, (x, y) in enumerate(pairs)])))


def vif(df: DataFrame, columns: list[str]) -> DataFrame:
    """(name, vif): the diagonal of the inverse correlation matrix, which is as small as the list of columns."""
    k = len(columns)
    m = np.eye(k)
    for r in correlations(df, columns).collect():
        i, j = columns.index(r["x"]), columns.index(r["y"])
        m[i, j] = m[j, i] = r["r"] or 0.0
    return df.sparkSession.createDataFrame([(c, float(v)) for c, v in zip(columns, np.diag(np.linalg.pinv(m)))], "name string, vif double")


def mode(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """The commonest value of each group, ties to the least."""
    return df.groupBy(*by, value).agg(F.count("*").alias("n")).groupBy(*by).agg(F.max_by(value, F.struct("n", -F.col(value))).alias(value))


def mean_ranks(df: DataFrame, name: str, higher_is_better: dict[str, bool]) -> DataFrame:
    """(name, mean_rank from 0, chosen) of a short table of sources."""
    every = Window.partitionBy(F.lit(0))
    ranks = [F.rank().over(every.orderBy(F.desc(c) if high else F.asc(c), name)) - 1 for c, high in higher_is_better.items()]
    out = df.select(name, (sum(ranks[1:], ranks[0]) / float(len(ranks))).alias("mean_rank"))
    return out.withColumn("chosen", F.col("mean_rank") == F.min("mean_rank").over(every))


def mosaic(df: DataFrame, priority: str, value: str) -> DataFrame:
    """(r, c, value): of the images that have a cell, the valid value of the first by priority."""
    return df.where(F.col(value).isNotNull()).groupBy("r", "c").agg(F.min_by(value, priority).alias(value))
