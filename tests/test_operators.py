"""Operators against analytic surfaces and brute force."""

import itertools
import math
import random

import numpy as np
import pytest
from gridloom.functions import scalar as S
from gridloom.operators import components, focal, joins, metrics, ranking, resample, routing, sampling
from gridloom.operators import timeseries as T
from pyspark.sql import functions as F


def grid(spark, z):
    z = np.asarray(z, float)
    return spark.createDataFrame([(i, j, float(z[i, j])) for i in range(z.shape[0]) for j in range(z.shape[1])], "r int, c int, z double")


def array_of(df, value, shape):
    out = np.full(shape, np.nan)
    for x in df.select("r", "c", value).collect():
        out[x[0], x[1]] = x[2]
    return out


def test_plane_has_its_slope_everywhere(spark):
    y, x = np.mgrid[0:9, 0:9]
    g = focal.gradient(grid(spark, 0.1 * 30 * x), 30.0, 30.0)
    assert np.allclose(array_of(g, "p", (9, 9)), 0.1) and np.allclose(array_of(g, "q", (9, 9)), 0)
    aspect = g.select(S.aspect_deg(F.col("p"), F.col("q")).alias("a")).distinct().collect()
    assert [round(r.a, 6) for r in aspect] == [270.0]


def test_dome_is_convex(spark):
    y, x = np.mgrid[-5:6, -5:6] * 30.0
    k = focal.curvatures(grid(spark, -1e-3 * (x * x + y * y)), 30.0, 30.0)
    inner = array_of(k, "general", (11, 11))[1:-1, 1:-1]
    assert np.allclose(inner, 0.4)


@pytest.mark.parametrize("shape", [(7, 9), (3, 4), (1, 5)])
def test_box_mean_mirrors_at_borders(spark, shape):
    z = np.random.default_rng(1).random(shape)
    want = np.zeros(shape)
    wide = np.pad(z, 2, mode="symmetric") if min(shape) >= 2 else np.pad(np.pad(z, ((0, 0), (2, 2)), mode="symmetric"), ((2, 2), (0, 0)), mode="edge")
    for i in range(shape[0]):
        for j in range(shape[1]):
            want[i, j] = wide[i : i + 5, j : j + 5].mean()
    assert np.allclose(array_of(focal.box_mean(grid(spark, z), ["z"], 2), "z", shape), want)


def patches_of(mask):
    seen, out = {}, []
    for cell in sorted(mask):
        if cell in seen:
            continue
        todo, group = [cell], set()
        while todo:
            r, c = todo.pop()
            if (r, c) in group:
                continue
            group.add((r, c))
            todo += [(r + a, c + b) for a in (-1, 0, 1) for b in (-1, 0, 1) if (r + a, c + b) in mask]
        seen |= dict.fromkeys(group, len(out))
        out.append(frozenset(group))
    return set(out)


@pytest.mark.parametrize("tile", [3, 8, 100])
def test_patches_equal_brute_force(spark, tile):
    rng = random.Random(tile)
    mask = {(r, c) for r in range(20) for c in range(20) if rng.random() < 0.42}
    got = components.label_patches(spark.createDataFrame(sorted(mask), "r int, c int"), tile).collect()
    groups = {}
    for x in got:
        groups.setdefault(x.patch, set()).add((x.r, x.c))
    assert {frozenset(g) for g in groups.values()} == patches_of(mask)


def least_surface(z, step):
    """The least surface at or above z that goes down by the step to some neighbour from every cell inside."""
    wide = np.full((z.shape[0] + 2, z.shape[1] + 2), np.inf)
    out = wide[1:-1, 1:-1]
    out[...] = np.where(np.pad(np.ones((z.shape[0] - 2, z.shape[1] - 2), bool), 1), np.inf, z)
    inner = np.isinf(out)
    for _ in range(z.size):
        around = np.min([wide[1 + a : 1 + a + z.shape[0], 1 + b : 1 + b + z.shape[1]] for a, b in components.OFFSETS], axis=0)
        out[...] = np.where(inner, np.maximum(z, around + step), z)
    return out.copy()


@pytest.mark.parametrize("tile", [3, 256])
def test_fill_drains_and_accumulation_keeps_mass(spark, tile):
    rng = np.random.default_rng(42)
    z = rng.random((10, 12)) * 5 - 0.3 * np.arange(10)[:, None]
    z[4:7, 4:8] = -20  # a pit
    filled = least_surface(z, routing.EPSILON)
    for i, j in itertools.product(range(1, 9), range(1, 11)):
        assert min(filled[i + a, j + b] for a, b in components.OFFSETS) < filled[i, j]
    cells = grid(spark, filled).withColumnRenamed("z", "zf").withColumn("one", F.lit(1.0))
    edges = routing.flow_edges(cells, 30.0, 30.0)
    done = routing.accumulate(cells, edges, ["one"], tile)
    edge = F.col("r").isin(0, 9) | F.col("c").isin(0, 11)
    row = routing.ledger(done, edges, "one", edge).first()
    assert row.total == 120 and math.isclose(row.out, 120, abs_tol=1e-9) and row.lost == 0


def test_level_fill_equals_flooding(spark):
    z = np.random.default_rng(3).random((7, 8))
    exact = least_surface(z, 0.0)
    assert np.allclose(array_of(routing.level_fill(grid(spark, z), 7, 8), "zf", z.shape), exact)


def test_height_above_drainage_on_a_plane(spark):
    z = np.arange(5, dtype=float)[None, :].repeat(4, 0)
    cells = grid(spark, z).withColumnRenamed("z", "zf")
    recv = routing.receivers(routing.flow_edges(cells, 1.0, 1.0))
    hand = routing.height_above_drainage(cells, recv, F.col("c") == 0, "zf")
    assert np.allclose(array_of(hand, "hand", z.shape), z)


def test_exact_fraction_equals_sub_pixels(spark):
    mask = np.random.default_rng(5).random((6, 9)) < 0.5
    canvas = np.zeros((15, 21))
    canvas[1:13, 1:19] = np.kron(mask, np.ones((2, 2)))
    want = canvas.reshape(5, 3, 7, 3).mean(axis=(1, 3))
    df = resample.fraction_three_in_two(grid(spark, mask), F.col("z"))
    got = np.nan_to_num(array_of(df, "f", want.shape))
    assert np.allclose(got, want)


@pytest.mark.parametrize("k", [1, 2])
def test_nearest_points_equal_brute_force(spark, k):
    rng = random.Random(k)
    a = [(i, rng.random() * 30 - 5, rng.random() * 9) for i in range(60)]
    b = [(i, rng.random() ** 3 * 20, rng.random() * 5) for i in range(25)]
    q, s = spark.createDataFrame(a, "q int, x double, y double"), spark.createDataFrame(b, "s int, x double, y double")
    got = sorted((r.q, r.nth, round(r.dist, 9)) for r in joins.nearest_points(q, s, "q", "s", k).collect())
    want = []
    for i, x, y in a:
        d = sorted(math.hypot(x - u, y - v) for _, u, v in b)
        want += [(i, n + 1, round(d[n], 9)) for n in range(k)]
    assert got == sorted(want)


def test_gap_fills_differ_as_they_should(spark):
    df = spark.createDataFrame([([1.0, None, None, 4.0],), ([None, None, 2.0, None],), ([None, None],)], "v array<double>")
    out = df.select(T.fill_nearest_year("v").alias("a"), T.fill_cascading("v").alias("b")).collect()
    assert [r.a for r in out] == [[1.0, 1.0, 4.0, 4.0], [2.0, 2.0, 2.0, 2.0], [0.0, 0.0]]
    assert [r.b for r in out] == [[1.0, 1.0, 1.0, 4.0], [2.0, 2.0, 2.0, 2.0], [0.0, 0.0]]


def test_auc_counts_ties_as_half(spark):
    rng = random.Random(9)
    rows = [(rng.randrange(6) / 5, rng.random() < 0.4) for _ in range(80)]
    got = ranking.auc(spark.createDataFrame(rows, "s double, y boolean"), "s", F.col("y")).first()
    p, n = [s for s, y in rows if y], [s for s, y in rows if not y]
    assert math.isclose(got.auc, sum((a > b) + (a == b) / 2 for a in p for b in n) / len(p) / len(n), abs_tol=1e-12)


def test_ratios_without_denominator_are_null(spark):
    df = spark.createDataFrame([(False, False)], "a boolean, b boolean")
    r = metrics.ratios(metrics.contingency(df, F.col("a"), F.col("b"))).first()
    assert r.pod is None and r.csi is None and r.oa == 1.0


def test_folds_keep_groups_whole(spark):
    df = spark.createDataFrame([(f"{i % 13}_{i % 7}", i % 3 == 0) for i in range(400)], "block string, p boolean").withColumn("y", F.col("p").cast("int"))
    folds = sampling.group_folds(df, "block", "y", 4)
    assert folds.count() == folds.select("block").distinct().count() == df.select("block").distinct().count()
    assert set(r.fold for r in folds.collect()) == {0, 1, 2, 3}


def test_utm_against_known_point(spark):
    # a point on the central meridian, and the symmetry around it
    df = spark.createDataFrame([(75.0, 10.0), (76.0, 10.0), (74.0, 10.0)], "lon double, lat double")
    x, y = S.utm(F.col("lon"), F.col("lat"), 43)
    a, b, c = df.select(x.alias("x"), y.alias("y")).collect()
    assert math.isclose(a.x, 500000, abs_tol=1e-6) and math.isclose(a.y, 0.9996 * 1105854.833, abs_tol=0.5)
    assert math.isclose(b.x - 500000, 500000 - c.x, abs_tol=1e-6) and math.isclose(b.y, c.y, abs_tol=1e-6)


def test_f_quantile():
    assert math.isclose(S.f_quantile(0.95, 5, 10), 3.3258345, abs_tol=1e-6)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "r int, c int, z double")
    assert components.label_patches(none.select("r", "c")).count() == 0
    assert focal.neighbourhood(none).count() == 0
    assert ranking.auc(none.withColumn("y", F.lit(True)), "z", F.col("y")).first().auc is None
