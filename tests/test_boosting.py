"""Boosted trees against a plain grower, subsets by brute force, and what constraints promise."""

import itertools
import math
import random

import pytest
from gridloom.operators import boosting as B
from pyspark.sql import functions as F

SCHEMA = "id long, y int, a double, b double, k string"


def samples(n=1000, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        a, b, k = rng.randrange(12) / 2, rng.choice([None, *map(float, range(6))]), rng.choice("pqrstuvw")
        z = 0.5 * a - 0.3 * (b or 4) + {"p": 2, "s": -2, "v": 1.5}.get(k, 0) + rng.gauss(0, 1)
        rows.append((i, int(z > 0.5), a, b, k))
    return rows


def plain_trees(rows, what, subsets=False):
    """Trees as nested tuples, grown the plain way: every split of every leaf tried, the best leaf first, rows in lists."""
    names = ["id", "y", "a", "b", "k"]
    col = {f: [r[names.index(f)] for r in rows] for f in names}
    whole = lambda x: round(x * B.SCALE)
    p = sum(col["y"]) / len(rows)
    score = [math.log(p / (1 - p))] * len(rows)
    trees = []

    def value(idx, g, h, lo, hi):
        return min(max(-sum(g[i] for i in idx) / B.SCALE / (sum(h[i] for i in idx) / B.SCALE + what.l2), lo), hi)

    def worth(idx, g, h, v):
        return -(2 * sum(g[i] for i in idx) / B.SCALE * v + (sum(h[i] for i in idx) / B.SCALE + what.l2) * v * v)

    def best_split(idx, g, h, lo, hi):
        out = None
        base = worth(idx, g, h, value(idx, g, h, lo, hi))
        for f, name in enumerate(what.features):
            x = col[name]
            there = sorted({x[i] for i in idx if x[i] is not None})
            gone = any(x[i] is None for i in idx)
            if name in what.categorical:
                rate = {v: sum(g[i] for i in idx if x[i] == v) / sum(h[i] for i in idx if x[i] == v) for v in there}
                order = sorted(there, key=lambda v: (rate[v], v))
                sides = [set(order[:k]) for k in range(1, len(order))]
                if subsets:
                    sides = [set(c) for k in range(1, len(there)) for c in itertools.combinations(there, k)]
                tests = [(lambda v, s=s: v in s) for s in sides]
            else:
                tests = [(lambda v, t=t, m=m: m if v is None else v <= t) for t in ([-1e9] if gone else []) + there for m in ([True, False] if gone else [True])]
            for test in tests:
                left, right = [i for i in idx if test(x[i])], [i for i in idx if not test(x[i])]
                if min(len(left), len(right)) < max(1, what.least_rows) or min(sum(h[i] for i in s) for s in (left, right)) / B.SCALE < what.least_hessian:
                    continue
                a, b = value(left, g, h, lo, hi), value(right, g, h, lo, hi)
                sign = what.monotone.get(name, 0)
                if sign * (b - a) < 0:
                    continue
                gain = worth(left, g, h, a) + worth(right, g, h, b) - base
                if out is None or gain > out[0] + 1e-9:
                    out = (gain, f, left, right, a, b, sign)
        return out if out and out[0] > what.least_gain else None

    for _ in range(what.rounds):
        prob = [1 / (1 + math.exp(-s)) for s in score]
        g, h = [whole(q - y) for q, y in zip(prob, col["y"])], [whole(q * (1 - q)) for q in prob]
        idx = list(range(len(rows)))
        leaves = [(idx, -math.inf, math.inf, 0.0, best_split(idx, g, h, -math.inf, math.inf))]
        while len(leaves) < what.leaves and any(x[4] for x in leaves):
            at = max((k for k, x in enumerate(leaves) if x[4]), key=lambda k: leaves[k][4][0])
            _, lo, hi, _, (gain, f, left, right, a, b, sign) = leaves.pop(at)
            mid = (a + b) / 2
            ends = [(lo, hi)] * 2 if not sign else [(lo, mid), (mid, hi)] if sign > 0 else [(mid, hi), (lo, mid)]
            leaves += [(s, *e, v, best_split(s, g, h, *e)) for s, e, v in zip((left, right), ends, (a, b))]
        trees.append(sorted((sorted(x[0]), round(x[3], 9)) for x in leaves))
        for idx, _, _, v, _ in leaves:
            for i in idx:
                score[i] += what.rate * v
    return trees, score


@pytest.mark.parametrize("what", [
    B.Boosting(("a", "b"), rounds=2, leaves=6, l2=1.0),
    B.Boosting(("a", "b", "k"), rounds=1, leaves=7, l2=0.0, categorical=("k",), rate=0.3),
    B.Boosting(("a", "b"), rounds=1, leaves=6, l2=2.0, monotone={"a": 1, "b": -1}, least_rows=5),
], ids=["ridge", "categories", "constraints"])
def test_equals_a_plain_grower(spark, what):
    rows = samples()
    model = B.fit(spark.createDataFrame(rows, SCHEMA).repartition(5), what)
    got = {r["id"]: r["score"] for r in model.scores(spark.createDataFrame(rows, SCHEMA)).collect()}
    trees, margin = plain_trees(rows, what)
    assert [len(opened) + 1 for _, opened in model.trees] == [len(t) for t in trees]
    assert max(abs(got[i] - 1 / (1 + math.exp(-m))) for i, m in enumerate(margin)) < 1e-9


def test_ordered_categories_find_the_best_of_all_subsets(spark):
    rows = samples(600, 3)
    what = B.Boosting(("k",), rounds=1, leaves=2, l2=0.0, categorical=("k",), least_rows=1)
    model = B.fit(spark.createDataFrame(rows, SCHEMA), what)
    _, margin = plain_trees(rows, what, subsets=True)
    got = {r["id"]: r["score"] for r in model.scores(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert len({*map(str, margin)}) == 2 and max(abs(got[i] - 1 / (1 + math.exp(-m))) for i, m in enumerate(margin)) < 1e-9


def test_constrained_scores_never_turn(spark):
    df = spark.createDataFrame(samples(800, 5), SCHEMA)
    free = B.Boosting(("a", "b", "k"), rounds=1, leaves=9, categorical=("k",), least_rows=5)
    for what, bound in ((free, False), (B.Boosting(**{**free.__dict__, "monotone": {"a": 1}}), True)):
        model = B.fit(df, what)
        grid = df.select("b", "k").distinct().withColumn("a", F.explode(F.array(*[F.lit(float(v)) for v in range(8)])))
        curves = model.scores(grid).groupBy("b", "k").agg(F.sort_array(F.collect_list(F.struct("a", "score"))).alias("c")).collect()
        falls = sum(x["score"] > y["score"] + 1e-12 for r in curves for x, y in zip(r["c"], r["c"][1:]))
        assert (falls == 0) == bound


def test_missing_unseen_empty_and_one_class(spark):
    rows = samples(400, 7)
    df = spark.createDataFrame(rows, SCHEMA)
    what = B.Boosting(("a", "b", "k"), rounds=1, leaves=5, categorical=("k",))
    model = B.fit(df, what)
    odd = spark.createDataFrame([(1, None, None, float("nan"), "zz"), (2, None, float("nan"), None, None)], SCHEMA)
    assert all(0 < r.score < 1 for r in model.scores(odd).collect())
    assert not B.fit(df.limit(0), what).trees and not B.fit(df.where("y = 1"), what).trees
    assert B.fit(df.limit(0), what).scores(df).where("score = 0.5").count() == 400
    # rows' places in partitions and repeated fits change nothing
    again = B.fit(df.repartition(7), what)
    assert str(again.trees) == str(model.trees) and abs(sum(model.gain_importance().values()) - 1) < 1e-12


def test_bagging_draws_by_key(spark):
    df = spark.createDataFrame(samples(400, 9), SCHEMA)
    what = B.Boosting(("a", "b"), rounds=1, leaves=4, bagging=0.5, keys=("id",), least_rows=5)
    assert str(B.fit(df, what).trees) == str(B.fit(df.repartition(3), what).trees) != str(B.fit(df, B.Boosting(**{**what.__dict__, "seed": 1})).trees)
