"""What costs much is worked out once and written, however many passes read it."""

import numpy as np
from gridloom.operators import boosting, metrics, ranking
from gridloom.plans import composites
from pyspark.sql import functions as F
from test_large_grids import plan_of
from test_operators import grid


def test_smoothed_images_of_a_flood_map_are_written(spark, monkeypatch):
    """Every quantile, border, noise and threshold filtered both images again."""
    rng = np.random.default_rng(7)
    pair = grid(spark, rng.random((20, 30)) * 10 - 15).withColumnRenamed("z", "wet").withColumn("dry", F.when(F.col("c") != 3, F.col("wet") + 2))
    masks, without_small = [], composites.components.without_small
    monkeypatch.setattr(composites.components, "without_small", lambda mask, least: masks.append(mask) or without_small(mask, least))
    got = composites.flood_map(pair, "wet", "dry")
    assert "InArrow" not in plan_of(masks[0])
    rows = {(x.r, x.c): x["class"] for x in got.collect()}
    assert len(rows) == 600 and all((v is None) == (c == 3) for (_, c), v in rows.items())


def test_models_of_one_table_share_its_bins(spark, monkeypatch):
    """A fit with constraints wrote and binned the same rows as the fit without."""
    df = spark.range(2000).selectExpr("id % 7 AS x", "int(id % 7 * 31 % 5 > id % 3) AS y")
    whats = [boosting.Boosting(("x",), rounds=2, leaves=4), boosting.Boosting(("x",), rounds=2, leaves=4, monotone={"x": 1})]
    alone = [boosting.fit(df, what) for what in whats]
    written, cut = [], boosting.cut
    monkeypatch.setattr(boosting, "cut", lambda df: written.append(1) or cut(df))
    both = boosting.fits(df, whats)
    assert len(written) == 2 and [m.trees for m in both] == [m.trees for m in alone] and both[0].trees != both[1].trees


def test_figures_of_a_classification_come_from_one_count(spark):
    """Scores were worked out for the contingency table and again for the areas."""
    df = spark.range(500).selectExpr("IF(id % 11 = 0, null, id % 8 / 8D) AS s", "id % 3 AS g", "IF(id % 13 = 0, null, id % 5 > 2) AS y")
    got = metrics.classification(df, "s", F.col("y"), by=["g"])
    assert "Range" not in plan_of(got)
    want = {r.g: r for r in metrics.contingency(df, F.col("s") >= 0.5, F.col("y"), ["g"]).collect()}
    areas = {r.g: r.auc for r in ranking.auc(df, "s", F.col("y"), ["g"]).collect()}
    for r in got.collect():
        w = want[r.g]
        assert r.auc == areas[r.g] and abs(r.accuracy - (w.tp + w.tn) / (w.tp + w.fp + w.fn + w.tn)) < 1e-12 and abs(r.specificity - w.tn / (w.tn + w.fp)) < 1e-12
