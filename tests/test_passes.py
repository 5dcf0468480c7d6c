"""What grows with the input goes by ranges and once: held-out blocks, groups of ranks."""

import math

from gridloom.operators import boosting, models, ranking, sampling
from gridloom.plans import model_queries
from gridloom.plans.registry import Tables
from pyspark.sql import functions as F
from test_large_grids import plan_of


def test_held_out_blocks_are_ranked_by_ranges(spark):
    """A limit sent a fifth of the blocks from every task to one."""
    df = spark.createDataFrame([(f"{k % 37}_{k % 2}", k % 3 % 2) for k in range(400)] + [(None, 1)], "block string, y int")
    held = sampling.held_out_blocks(df, "block", "y")
    blocks = df.where("y = 1").select("block").distinct().withColumn("u", sampling.draw(["block"], 42)).collect()
    assert {r.block for r in held.collect()} == {b.block for b in sorted(blocks, key=lambda b: (b.u, b.block or ""))[: round(len(blocks) * 0.2)]}
    assert "Limit" not in plan_of(held) and "TakeOrdered" not in plan_of(held)


def test_ranks_of_few_groups_are_not_exchanged_by_group(spark, monkeypatch):
    """Each group's rows met in one task to learn where the group begins, once there were too many for a guess at a broadcast."""
    monkeypatch.setattr(ranking, "cut", lambda df: (spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1"), df)[1])
    df = spark.range(100).selectExpr("id", "id % 2 AS bag")
    ranked = ranking.ordinal_ranks(df, "id", ["id"], ["bag"])
    plan = plan_of(ranked)
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" not in plan and {(r.bag, r.rank) for r in ranked.collect()} == {(b, k) for b in (0, 1) for k in range(1, 51)}


def test_rows_of_an_id_are_found_once(spark):
    """Every pass of every fit exchanged and sorted all rows again."""
    rows = model_queries._rows(Tables(spark, "/root/testdata/sf0.001"))
    assert "Aggregate" not in plan_of(rows) and "Exchange" not in plan_of(rows)
    assert rows.count() == rows.select("id").distinct().count()


def test_bins_are_searched(spark):
    """Each value was held against every edge in turn."""
    values = [None, float("nan"), float("-inf"), float("inf"), -0.0, 0.0, *[k / 8 for k in range(-30, 30)]]
    what = boosting.Boosting(("x", "k", "none"))
    q = boosting.Quantised([[-3.0, -0.5, -0.0, 0.125, 2.0], [2.0, 5.0], []], [None] * 3)
    df = spark.createDataFrame([(x, None if k == 0 else k % 9, 1.0) for k, x in enumerate(values)], "x double, k int, none double")
    got = boosting.binned(df, what, q)
    assert "filter(" not in plan_of(got) and got.columns == ["x", "k", "none", "__b0", "__b1", "__b2"]
    below = lambda x, edges: 0 if x is None or math.isnan(x) else 1 + sum(e < x for e in edges)
    assert [r for r in got.collect() if (r["__b0"], r["__b1"], r["__b2"]) != (below(r.x, q.edges[0]), below(r.k, q.edges[1]), 1)] == []


def test_passes_read_alike_rows_as_one(spark, monkeypatch):
    written, cut = [], boosting.cut
    monkeypatch.setattr(boosting, "cut", lambda df: written.append(cut(df)) or written[-1])
    df = spark.range(2000).selectExpr("id % 7 AS x", "int(id % 7 * 31 % 5 > id % 3) AS y")
    model = boosting.fit(df, boosting.Boosting(("x",), rounds=2, leaves=4))
    assert written[-1].count() <= 14 and written[-1].agg(F.sum("__n")).first()[0] == 2000 and len(model.trees) == 2


def test_features_are_permuted_by_two_sorts(spark, monkeypatch):
    """Each feature took two sorts of all rows and a join of its own."""
    df = spark.range(300).selectExpr("id", "double(id % 10) AS f1", "double(id % 4) AS f2", "int(id % 10 > 4) AS y")
    recipe = models.Recipe(("f1", "f2"), rounds=1, depth=2)
    model = models.fit(df, recipe)
    base = ranking.auc(models.scores(model, df), "score", F.col("y") == 1).first()["auc"]
    want = {f: base - ranking.auc(models.scores(model, sampling.permuted(df, f, ["id"])), "score", F.col("y") == 1).first()["auc"] for f in ("f1", "f2")}
    sorts, ranks = [], sampling.hash_ranks
    monkeypatch.setattr(sampling, "hash_ranks", lambda *a, **k: sorts.append(1) or ranks(*a, **k))
    got = {r.feature: r.drop for r in models.permutation_importance(model, df, recipe, ["id"]).collect()}
    assert got == want and len(sorts) == 2


def test_calibration_learns_from_counts(spark, monkeypatch):
    """Both curves were fitted on all training rows."""
    written, cut = [], models.cut
    monkeypatch.setattr(models, "cut", lambda df: written.append(cut(df)) or written[-1])
    df = spark.range(600).selectExpr("id", "(id % 6 + 1) / 8D AS score", "int(id * 7 % 13 < id % 6 * 2 + 1) AS y")
    got = {r.score: (r.platt, r.isotonic) for r in models.calibrated(df, df, "y").collect()}
    rate = {r.score: r.p for r in df.groupBy("score").agg(F.avg("y").alias("p")).collect()}
    assert written[0].count() <= 12 and sorted(rate.values()) == [rate[s] for s in sorted(rate)]
    assert all(abs(got[s][1] - rate[s]) < 1e-9 for s in rate)
    mean = sum(p for p, _ in got.values()) / 6
    assert abs(mean - df.agg(F.avg("y")).first()[0]) < 1e-4
