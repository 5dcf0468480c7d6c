"""Queries cover the whole of their table."""

import math

import numpy as np
import pytest
from gridloom.operators import routing
from gridloom.plans import catalog
from gridloom.plans.registry import Tables
from pyspark.sql import functions as F
from test_operators import array_of, grid
from test_oracles import duck, rows  # noqa: F401

FOLDER = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", ["gr07_level_fill", "gr08_accumulation", "gr09_weighted_accumulation", "gr11_height_above_drainage", "gr14_route_flow", "cp06_route_flow"])
def test_every_cell_has_a_row(spark, name):
    cells = Tables(spark, FOLDER).part.count()
    assert catalog.QUERIES[name](spark, FOLDER).count() == cells


@pytest.mark.parametrize("name", ["cp02_flood_map", "ml15_change_test"])
def test_classes_count_every_cell(spark, name):
    cells = Tables(spark, FOLDER).img_pair.count()
    assert catalog.QUERIES[name](spark, FOLDER).agg(F.sum("n")).first()[0] == cells


def test_preprocess_covers_every_row(spark):
    seen = Tables(spark, FOLDER).img_pair.where("ref").count()
    assert catalog.QUERIES["cp05_preprocess"](spark, FOLDER).first()["valid"] >= seen


@pytest.mark.parametrize("name", ["gr07_level_fill", "gr10_receivers", "gr11_height_above_drainage", "gr12_share_to_receiver", "gr13_mass_balance", "gr15_edge_inflow", "rf12_nearest_resample"])
def test_whole_query_equals_sql(spark, duck, name):  # noqa: F811
    got = catalog.QUERIES[name](spark, "/root/testdata/sf0.001").toPandas()
    assert rows(got) == rows(duck.execute(catalog.ORACLES[name]).df())


@pytest.mark.parametrize("tile", [3, 256])
def test_accumulation_equals_brute_force(spark, tile):
    z = np.random.default_rng(8).random((9, 11)) * 9
    cells = grid(spark, z).withColumnRenamed("z", "zf").withColumn("one", F.lit(1.0))
    got = array_of(routing.accumulate(cells, routing.flow_edges(cells, 30.0, 30.0), ["one"], tile), "acc_one", z.shape)
    want = np.ones(z.shape)
    for i, j in sorted(np.ndindex(*z.shape), key=lambda x: -z[x]):
        down = {(r, c): (z[i, j] - z[r, c]) / math.hypot(r - i, c - j) / 30 * (0.354 if r != i and c != j else 0.5) for r in range(max(i - 1, 0), min(i + 2, 9)) for c in range(max(j - 1, 0), min(j + 2, 11)) if z[r, c] < z[i, j]}
        for x, w in down.items():
            want[x] += want[i, j] * w / sum(down.values())
    assert np.allclose(got, want)
