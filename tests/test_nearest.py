"""Nearest points: many queries of one cell, queries far outside, targets that crowd a cell, ties."""

import math

import numpy as np
import pytest
from gridloom.operators import joins


@pytest.mark.parametrize("listed", [4096, 5])
def test_nearest_of_crowds(spark, listed, monkeypatch):
    monkeypatch.setattr(joins, "LISTED", listed)
    rng = np.random.default_rng(9)
    targets = [(k, float(x), float(y)) for k, (x, y) in enumerate(rng.integers(0, 9, (60, 2)))] + [(100 + k, 700.0 + k / 100, 1.0) for k in range(40)]
    queries = [(k, float(x), float(y)) for k, (x, y) in enumerate(rng.integers(-300, 900, (80, 2)) / 2)] + [(500 + k, 4.0, 4.5) for k in range(30)]
    got = joins.nearest_points(spark.createDataFrame(queries, "q long, x double, y double"), spark.createDataFrame(targets, "s long, x double, y double"), "q", "s").collect()
    want = {q: min((math.hypot(x - a, y - b), s) for s, a, b in targets) for q, x, y in queries}
    assert len(got) == len(want)
    assert {r.q: (round(r.dist, 9), r.s, r.nth) for r in got} == {q: (round(d, 9), s, 1) for q, (d, s) in want.items()}


def test_no_row_a_pair_is_sorted(spark, monkeypatch):
    """Pairs were sorted by query within each task, so that its memory grew with them."""
    plans, cut = [], joins.cut
    monkeypatch.setattr(joins, "cut", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or cut(df))
    points = [(k, float(k % 7), float(k % 5)) for k in range(30)]
    found = joins.nearest_points(spark.createDataFrame(points, "q long, x double, y double"), spark.createDataFrame(points, "s long, x double, y double"), "q", "s")
    assert found.count() == 30 and [p for p in plans if "min(struct(dist" in p] == []


def test_only_rivals_are_compared(spark):
    """Every query far outside compared itself with all targets."""
    rng = np.random.default_rng(2)
    box = (3.0, 4.0, 20.0, 900.0)  # x from, to, y from, to
    near = [(float(x), float(y), k) for k, (x, y) in enumerate(rng.random((300, 2)) * 9)]
    df = spark.createDataFrame([(*box, near)], "__ax double, __bx double, __ay double, __by double, __near array<struct<__tx: double, __ty: double, s: int>>")
    left = {t["s"] for t in joins._rivals(df).first()["__near"]}
    places = [(x, y) for x in np.linspace(3, 4, 21) for y in np.linspace(20, 900, 200)]
    assert {min((math.hypot(x - a, y - b), s) for a, b, s in near)[1] for x, y in places} <= left
    assert len(left) < 30
