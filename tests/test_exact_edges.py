"""Bin edges of boosted trees come from one count of the values, whatever the partitions; written rows are not copied."""

import math

from gridloom.operators import boosting, ranking
from gridloom.plans import model_queries
from gridloom.plans.registry import Tables
from pyspark.sql import functions as F


def test_edges_do_not_depend_on_partitions(spark):
    """Those of many-valued features came from a sketch, which differed with how rows lay in partitions."""
    df = spark.range(60_000).selectExpr(
        "CASE WHEN id % 101 = 0 THEN null WHEN id % 103 = 0 THEN double('NaN') ELSE pow(id * 7919 % 60013, 2) - 1e8 END AS x",
        "IF(id % 5 < 2, -1D, double(id * 31 % 2003)) AS tied", "double(id % 9) AS few", "cast(null AS double) AS none",
    )
    what = boosting.Boosting(("x", "tied", "few", "none"), bins=40)
    want = []
    for f in what.features:
        v = sorted(r[0] for r in df.select(f).collect() if r[0] is not None and not math.isnan(r[0]))
        wanted = v if len(set(v)) <= what.bins else [v[-(-k * len(v) // what.bins) - 1] for k in range(1, what.bins + 1)]
        want.append(sorted(set(wanted))[:-1])
    for n in (1, 7):
        assert boosting.quantise(df.repartition(n), what).edges == want


def test_values_are_counted_in_one_pass(spark, monkeypatch):
    """Each feature of few values was read once more."""
    written, cut = [], ranking.cut
    monkeypatch.setattr(ranking, "cut", lambda df: written.append(cut(df)) or written[-1])
    df = spark.range(1000).select((F.col("id") % 7).cast("double").alias("a"), (F.col("id") % 3).cast("double").alias("b"))
    read = spark.sparkContext.accumulator(0)
    seen = F.udf(lambda v: read.add(1) or v, "double").asNondeterministic()
    found = ranking.cut_points(df.select(seen("a").alias("a"), "b"), {"a": F.col("a"), "b": F.col("b")}, 10)
    assert found == {"a": [float(k) for k in range(7)], "b": [0.0, 1.0, 2.0]} and read.value == 1000 and written[0].count() == 10


def test_written_rows_are_not_copied(spark, monkeypatch):
    """ml11_stress_test and others wrote all columns of all rows, and a fit wrote its rows once more."""
    rows = model_queries._rows(Tables(spark, "/root/testdata/sf0.001"), *model_queries.SEEN)
    assert rows.columns == ["y", "f1", "f2", "f3", "f4", "event"] and rows.count() == model_queries._rows(Tables(spark, "/root/testdata/sf0.001")).count()
    what = boosting.Boosting(model_queries.FEATURES, rounds=1, leaves=3)
    want = boosting.fit(rows, what)
    written, cut = [], boosting.cut
    monkeypatch.setattr(boosting, "cut", lambda df: written.append(cut(df)) or written[-1])
    got = boosting.fit(rows, what, written=True)
    assert len(written) == 1 and "__n" in written[0].columns and str(got.trees) == str(want.trees) and got.quantised == want.quantised
