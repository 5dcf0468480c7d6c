"""Grids that grow: joins by cell never go by way of the driver, fills go tile by tile."""

import numpy as np
import pytest
from gridloom.operators import components, routing
from pyspark.sql import functions as F
from test_operators import array_of, grid


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_joins_by_cell_are_exchanged(spark):
    cells = grid(spark, np.random.default_rng(3).random((6, 7))).withColumnRenamed("z", "zf").withColumn("one", F.lit(1.0))
    edges = routing.flow_edges(cells, 30.0, 30.0)
    recv = routing.receivers(edges)
    made = [
        components.neighbours(cells, "zf"), edges, routing.share_to_receiver(edges, recv), routing.accumulate(cells, edges, ["one"]),
        routing.height_above_drainage(cells, recv, F.col("c") == 0, "zf"),
    ]
    assert [d for d in made if "BroadcastHashJoin" in plan_of(d)] == []


@pytest.mark.parametrize("size", [3, 256])
def test_level_fill_over_tiles(spark, size):
    z = np.random.default_rng(5).integers(1, 30, (11, 13)).astype(float)
    z[4, 5] = np.nan
    level = z.copy()
    level[1:-1, 1:-1] = np.inf
    while True:
        new = level.copy()
        for i, j in np.ndindex(9, 11):
            if not np.isnan(z[i + 1, j + 1]):
                new[i + 1, j + 1] = max(z[i + 1, j + 1], np.nanmin(level[i : i + 3, j : j + 3]))
        new[4, 5] = np.nan
        if np.array_equal(new, level, equal_nan=True):
            break
        level = new
    assert np.array_equal(array_of(routing.level_fill(grid(spark, z), 11, 13, size=size), "zf", z.shape), level, equal_nan=True)
