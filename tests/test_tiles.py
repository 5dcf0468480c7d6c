"""Neighbourhood operators over tiles of any size against whole arrays; exact quantiles against numpy."""

import numpy as np
import pytest
from gridloom.operators import focal, ranking, tiles
from pyspark.sql import functions as F

SHAPE = (23, 17)


@pytest.fixture(scope="module")
def z():
    return np.random.default_rng(1).normal(size=SHAPE)


def grid(spark, z, top=0, left=0):
    return spark.createDataFrame([(top + i, left + j, float(z[i, j]), "kept") for i in range(z.shape[0]) for j in range(z.shape[1])], "r int, c int, z double, other string")


def array_of(df, col, top=0, left=0, shape=SHAPE):
    out = np.full(shape, np.nan)
    for r in df.select("r", "c", col).collect():
        out[r[0] - top, r[1] - left] = np.nan if r[2] is None else r[2]
    return out


def odd(z):
    """z with a border in which straight lines go on."""
    z = np.column_stack([2 * z[:, 0] - z[:, 1], z, 2 * z[:, -1] - z[:, -2]])
    return np.vstack([2 * z[0] - z[1], z, 2 * z[-1] - z[-2]])


@pytest.mark.parametrize(("size", "top", "left"), [(5, 0, 0), (4, -7, 3), (256, 0, 0)])
def test_tiles_do_not_change_neighbourhoods(spark, monkeypatch, z, size, top, left):
    monkeypatch.setattr(tiles, "TILE", size)
    df, (h, w) = grid(spark, z, top, left), SHAPE
    wide = odd(z)
    n = focal.neighbourhood(df).cache()
    assert n.columns == ["r", "c", "z", "other", *[f"z{k}" for k in range(1, 10)]] and n.where("other = 'kept'").count() == z.size
    for k in range(9):
        assert np.allclose(array_of(n, f"z{k + 1}", top, left), wide[k // 3 : k // 3 + h, k % 3 : k % 3 + w])
    mirrored = np.pad(z, 3, mode="symmetric")
    box = sum(mirrored[i : i + h, j : j + w] for i in range(7) for j in range(7)) / 49
    assert np.allclose(array_of(focal.box_mean(df, ["z"], 3), "z", top, left), box)
    edge = np.pad(z, 1, mode="edge")
    median = np.median([edge[i : i + h, j : j + w] for i in range(3) for j in range(3)], axis=0)
    assert np.allclose(array_of(focal.median3(df, "z"), "z", top, left), median)
    g = focal.simple_gradient(df, 2.0, 3.0)
    assert np.allclose(array_of(g, "gx", top, left), np.gradient(z, 2.0, axis=1)) and np.allclose(array_of(g, "gy", top, left), np.gradient(z, 3.0, axis=0))
    far = np.pad(z > 1.5, 2)
    near = np.max([far[i : i + h, j : j + w] for i in range(5) for j in range(5)], axis=0)
    assert (array_of(focal.near(df, F.col("z") > 1.5, 2, "m").withColumn("m", F.col("m").cast("double")), "m", top, left) == near).all()


def test_missing_values_stay_missing_and_empty_grids_empty(spark, z):
    holes = z.copy()
    holes[3, 4] = np.nan
    df = grid(spark, holes).withColumn("z", F.when(~F.isnan("z"), F.col("z")))
    got = array_of(focal.neighbourhood(df), "z5")
    assert np.isnan(got[3, 4]) and np.isnan(got).sum() == 1
    for f in (focal.neighbourhood, lambda d: focal.box_mean(d, ["z"], 2), lambda d: focal.median3(d, "z")):
        assert f(df.limit(0)).count() == 0
    one = grid(spark, z[:1, :1])
    assert focal.box_mean(one, ["z"], 2).first()["z"] == pytest.approx(z[0, 0]) and focal.neighbourhood(one).first()["z4"] is None


def test_tall_grids_have_a_task_a_tile(spark):
    df = spark.range(256 * 8).select(F.col("id").cast("int").alias("r"), F.lit(0).alias("c"), F.lit(1.0).alias("z"))
    sent = tiles.over_tiles(df, ["z"], 1, lambda box, a: [np.full_like(a[0], box.row)], "at double")
    assert sent.select("at").distinct().count() == 8


@pytest.mark.parametrize("shares", [[0.0, 0.5, 1.0], [0.2, 0.31, 0.8]])
def test_quantiles(spark, shares):
    values = np.random.default_rng(2).integers(0, 40, 501) / 8
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,)] * 5, "v double").repartition(4)
    assert np.allclose(ranking.quantiles(df, "v", shares), np.quantile(values, shares))
    assert ranking.quantiles(df.limit(0), "v", shares) == [None] * len(shares)
