"""The block bootstrap against the same draws taken block by block, however blocks are dealt over tasks."""

import numpy as np
import pytest
from gridloom.operators import sampling
from pyspark.sql import functions as F


@pytest.mark.parametrize("part", [2, 1000])
def test_block_bootstrap_equals_its_draws(spark, part, monkeypatch):
    monkeypatch.setattr(sampling, "DRAWN", part)
    rng = np.random.default_rng(4)
    rows = [(f"{k % 9}_{k % 2}", float(rng.integers(20)) / 20, float(rng.random()), int(rng.integers(2))) for k in range(400)]
    df = spark.createDataFrame(rows, "block string, a double, b double, y int")
    got = {r.draw: (r.auc_a, r.auc_b) for r in sampling.block_bootstrap(df, "block", "a", "b", "y", draws=12).collect()}
    blocks = df.select("block").distinct().withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(11)))).withColumn("u", sampling.draw(["block", "draw"], 42)).collect()
    limits = np.cumsum([np.exp(-1) / np.prod(range(1, k + 1)) for k in range(6)])
    weight = {(r.block, r.draw): int((r.u >= limits).sum()) for r in blocks}
    for d in range(12):
        for m in (0, 1):
            w = np.array([weight[r[0], d] for r in rows])
            s, y = np.floor(np.array([r[1 + m] for r in rows]) * 200), np.array([r[3] for r in rows])
            pos, neg = y == 1, y == 0
            wins = ((s[pos][:, None] > s[neg]) + (s[pos][:, None] == s[neg]) / 2) * w[pos][:, None] * w[neg]
            assert abs(got[d][m] - wins.sum() / (w[pos].sum() * w[neg].sum())) < 1e-12


def test_draws_are_not_rows(spark):
    """A row a block, score and draw was made, hashed and exchanged."""
    df = spark.createDataFrame([("x", 0.1, 0.2, 1), ("z", 0.3, 0.1, 0)], "block string, a double, b double, y int")
    plan = sampling.block_bootstrap(df, "block", "a", "b", "y", draws=12)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan
