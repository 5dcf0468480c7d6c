"""Sampling (SM) and models (ML); what depends on a random draw or a fitted tree has no SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import boosting as B
from ..operators import metrics, ranking
from ..operators import models as M
from ..operators import sampling as P
from ..operators.lineage import cut
from .registry import draw_sql, query, sql_with

R = lambda c, n=None, d=4: F.round(c, d).alias(n or c)
SAMPLES = sql_with("samples")
FEATURES = ("f1", "f2", "f3", "f4")
RECIPE = M.Recipe(FEATURES, rounds=4, depth=3)
LEAFWISE = B.Boosting(FEATURES, rounds=3, leaves=8, rate=0.3)
#: What the queries with trees grown leaf by leaf read of a sample.
SEEN = ("y", *FEATURES, "event")


def _rows(t, *columns):
    """One row an id: of those that share it the first by all columns, so that every run has the same rows.

    They are exchanged once and written, since every pass of a fit reads them again; columns: what is written, all by default.
    """
    rest = [c for c in t.samples.columns if c != "id"]
    first = t.samples.repartition("id").groupBy("id").agg(F.min(F.struct(*rest)).alias("__row")).select("id", "__row.*")
    return cut(first.select(*columns) if columns else first)


def _by_event(s):
    return s.where("event < 1999"), s.where("event >= 1999")


def _split(t):
    return _by_event(_rows(t).withColumn("fold", P.fold_of_unseen(F.col("block"), 3)))


def _model(t):
    train, test = _split(t)
    return M.fit(train, RECIPE), train, test


@query("sm01_balanced", SAMPLES + f", u AS (SELECT id, max(y) AS y FROM samples GROUP BY id), n AS (SELECT id, y, row_number() OVER (PARTITION BY y ORDER BY {draw_sql('id')}, id) AS nth FROM u) SELECT id, y FROM n WHERE y = 1 OR nth <= (SELECT count(*) FROM u WHERE y = 1)")
def sm01(t):
    u = t.samples.groupBy("id").agg(F.max("y").alias("y"))
    return P.balanced(u, "y", ["id"]).select("id", "y")


@query("sm02_fixed_n", sql_with("dem") + f" SELECT r, c, z FROM dem ORDER BY {draw_sql('r', 'c')}, r, c LIMIT 100")
def sm02(t):
    return P.first_by_hash(t.dem, ["r", "c"], 100)


_BY_NATION = f"WITH x AS (SELECT c_custkey, c_nationkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY {draw_sql('c_custkey')}, c_custkey) AS nth, count(*) OVER (PARTITION BY c_nationkey) AS n FROM customer) "


@query("sm03_stratified_split", _BY_NATION + "SELECT c_custkey, c_nationkey, nth <= floor(n * 0.7::DOUBLE) AS train FROM x")
def sm03(t):
    return P.stratified_split(t.customer.select("c_custkey", "c_nationkey"), "c_nationkey", ["c_custkey"])


@query("sm04_stratified_folds", _BY_NATION + "SELECT c_custkey, c_nationkey, ((nth - 1) % 5)::INT AS fold FROM x")
def sm04(t):
    return P.stratified_folds(t.customer.select("c_custkey", "c_nationkey"), "c_nationkey", ["c_custkey"])


@query("sm05_group_folds")
def sm05(t):
    folds = P.group_folds(t.samples, "block", "y", 5)
    return t.samples.join(folds, "block").groupBy("fold").agg(F.count("*").alias("n"), F.count_if(F.col("y") == 1).alias("pos"), F.count_distinct("block").alias("blocks"))


@query("sm05_unseen_block", SAMPLES + " SELECT DISTINCT block, ((split_part(block, '_', 1)::BIGINT + split_part(block, '_', 2)::BIGINT) % 5)::INT AS fold FROM samples")
def sm05u(t):
    return t.samples.select("block").distinct().withColumn("fold", P.fold_of_unseen(F.col("block")))


@query("sm06_bags", f"SELECT p_partkey, bag FROM (SELECT p_partkey, k::INT AS bag, row_number() OVER (PARTITION BY k ORDER BY {draw_sql('p_partkey', 'k')}, p_partkey) AS nth FROM part, range(4) x(k)) WHERE nth <= 50")
def sm06(t):
    return P.bags(t.part.select("p_partkey"), ["p_partkey"], 4, 50).select("p_partkey", "bag")


@query("sm07_block_hold_out", SAMPLES + f", b AS (SELECT block, row_number() OVER (ORDER BY {draw_sql('block')}, block) AS nth, count(*) OVER () AS n FROM (SELECT DISTINCT block FROM samples WHERE y = 1)) SELECT block FROM b WHERE nth <= greatest(1, round(n * 0.2))")
def sm07(t):
    return P.held_out_blocks(t.samples, "block", "y")


@query("sm08_block_bootstrap")
def sm08(t):
    s = t.samples.withColumns({"a": F.col("f1") / 51, "b": F.col("f3") * 9})
    d = P.block_bootstrap(s, "block", "a", "b", "y", draws=200)
    return d.agg(F.count("*").alias("draws"), R(F.percentile("auc_a", 0.025), "low"), R(F.percentile("auc_a", 0.975), "high"), R(F.avg((F.col("auc_b") > F.col("auc_a")).cast("int")), "b_wins"))


@query("sm09_permutation", f"WITH a AS (SELECT p_partkey, row_number() OVER (ORDER BY {draw_sql('p_partkey')}, p_partkey) AS nth FROM part), b AS (SELECT p_size, row_number() OVER (ORDER BY {draw_sql('p_partkey', seed=43)}, p_partkey) AS nth FROM part) SELECT p_partkey, p_size FROM a JOIN b USING (nth)")
def sm09(t):
    return P.permuted(t.part.select("p_partkey", "p_size"), "p_size", ["p_partkey"])


@query("sm10_temporal_split", SAMPLES + " SELECT CASE WHEN event IN (1995, 1996) THEN 'train' ELSE 'test' END AS part, count(*) AS n FROM samples WHERE event IN (1995, 1996, 1998, 2000) GROUP BY 1")
def sm10(t):
    part = F.when(F.col("event").isin(1995, 1996), "train").otherwise("test")
    return t.samples.where(F.col("event").isin(1995, 1996, 1998, 2000)).groupBy(part.alias("part")).agg(F.count("*").alias("n"))


@query("ml01_boosted_trees")
def ml01(t):
    train, test = _by_event(_rows(t, *SEEN))
    return ranking.auc(M.leafwise(LEAFWISE, written=True)(train, test), "score", F.col("y") == 1).select("n_pos", "n_neg", R("auc"))


#: Each split of the root of a first tree: sums up to a value, of gradients p - y and hessians p (1 - p) in whole steps, with ridge 1.
_GAINS_SQL = SAMPLES + """, p AS (SELECT avg(y)::DOUBLE AS p FROM samples),
  steps AS (SELECT unnest([0, 1, 2]) AS feature, unnest([f1, f3, f4]) AS x, round((p - y) * 16777216)::BIGINT AS g, round(p * (1 - p) * 16777216)::BIGINT AS h FROM samples, p),
  sums AS (SELECT feature, x, sum(g) AS g, sum(h) AS h, count(*) AS n FROM steps GROUP BY ALL),
  lefts AS (SELECT feature, dense_rank() OVER (PARTITION BY feature ORDER BY x) AS last, sum(g) OVER w / 16777216 AS lg, sum(h) OVER w / 16777216 AS lh, sum(n) OVER w AS n_left,
              sum(g) OVER a / 16777216 AS ag, sum(h) OVER a / 16777216 AS ah, sum(n) OVER a AS n FROM sums WINDOW w AS (PARTITION BY feature ORDER BY x), a AS (PARTITION BY feature))
  SELECT feature::INT AS feature, last::INT AS last, n_left::BIGINT AS n_left, round(lg * lg / (lh + 1) + (ag - lg) * (ag - lg) / (ah - lh + 1) - ag * ag / (ah + 1), 4) AS gain
  FROM lefts WHERE n_left >= 20 AND n - n_left >= 20"""


@query("ml01_split_gains", _GAINS_SQL)
def ml01_gains(t):
    what = B.Boosting(("f1", "f3", "f4"))
    rows = B.binned(t.samples, what, B.quantise(t.samples, what))
    p = F.lit(rows.agg(F.avg("y")).first()[0])
    hist = B.histograms(rows, F.lit(0), len(what.features), p - F.col("y"), p * (1 - p))
    return B.split_gains(hist, what).select("feature", "last", "n_left", R("gain"))


@query("ml02_early_stopping")
def ml02(t):
    train, _ = _split(t)
    n = M.best_rounds(train, RECIPE, F.col("fold") == 0, most=8)
    return t.spark.createDataFrame([(int(n),)], "rounds int")


@query("ml03_tuning")
def ml03(t):
    train, test = _split(t)
    return M.tuned(train, test, RECIPE, [{"depth": d, "rate": r, "rounds": 3} for d in (2, 3) for r in (0.1, 0.3)]).withColumn("auc", F.round("auc", 4))


@query("ml04_second_family")
def ml04(t):
    train, test = _split(t)
    return ranking.auc(M.plain(M.Recipe(FEATURES, rounds=8, depth=4, family="forest"))(train, test), "score", F.col("y") == 1).select(R("auc"))


@query("ml05_ablation")
def ml05(t):
    train, test = _split(t)
    return M.ablation(train, test, RECIPE, {"A": ("f1",), "B": ("f1", "f2"), "C": ("f1", "f2", "f3"), "D": FEATURES}).withColumn("auc", F.round("auc", 4))


@query("ml06_positive_unlabelled")
def ml06(t):
    train, test = _split(t)
    designs = {"standard": M.plain(RECIPE), "naive": M.weighted_unlabelled(RECIPE), "share": M.labelled_share(RECIPE, "block"), "bagging": M.bagged_unlabelled(RECIPE, ["id"], 2)}
    parts = [ranking.auc(d(train, test), "score", F.col("y") == 1).select(F.lit(n).alias("design"), R("auc")) for n, d in designs.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query("ml07_monotone")
def ml07(t):
    """Cells that get safer or riskier when two features grow, with trees left free and trees that may not fall in them."""
    train, test = _by_event(_rows(t, *SEEN))
    variants = {"free": LEAFWISE, "constrained": B.Boosting(FEATURES, rounds=3, leaves=8, rate=0.3, monotone={"f1": 1, "f3": 1})}
    grown = {"f1": F.col("f1") + 10, "f3": F.col("f3") + 0.02}
    parts = [M.develop_and_count(model, test, grown).select(F.lit(name).alias("variant"), "n", R("safer"), R("riskier")) for name, model in zip(variants, B.fits(train, list(variants.values()), written=True))]
    return parts[0].unionByName(parts[1])


@query("ml08_categorical")
def ml08(t):
    """Areas under the ROC curve with a category of eight kinds, as an unordered feature and as a number."""
    kinds = _rows(t).withColumn("kind", F.pmod(F.col("id") * 5 + F.col("y") * F.pmod(F.col("id"), F.lit(3)), F.lit(8)).cast("int"))
    train, test = kinds.where("event < 1999"), kinds.where("event >= 1999")
    parts = [
        ranking.auc(M.leafwise(B.Boosting(("f1", "kind"), rounds=2, leaves=4, rate=0.3, categorical=c))(train, test), "score", F.col("y") == 1).select(F.lit(name).alias("design"), "n_pos", R("auc"))
        for name, c in (("unordered", ("kind",)), ("number", ()))
    ]
    return parts[0].unionByName(parts[1])


@query("ml09_importance")
def ml09(t):
    model, _, test = _model(t)
    gain = M.gain_importance(model, FEATURES, t.spark)
    return gain.join(M.permutation_importance(model, test, RECIPE, ["id"]), "feature").select("feature", R("gain"), R("drop"))


@query("ml10_batch_scoring")
def ml10(t):
    model, _, test = _model(t)
    return M.scores(model, test).select("id", R("score", d=6))


@query("ml11_stress_test")
def ml11(t):
    train, test = _by_event(_rows(t, *SEEN))
    return M.develop_and_count(B.fit(train, LEAFWISE, written=True), test, {"f1": F.col("f1") + 10}).select("n", R("safer"), R("riskier"))


@query("ml12_response_curve")
def ml12(t):
    model, _, test = _model(t)
    return M.response_curve(model, test, "f1", [2.5 * k for k in range(21)]).select("value", R("mean_score", d=6))


@query("ml13_subset_diagnostics")
def ml13(t):
    model, _, test = _model(t)
    urban = F.when(F.col("f1") > 25, "urban").otherwise("rural")
    return ranking.auc(M.scores(model, test).withColumn("part", urban), "score", F.col("y") == 1, ["part"]).select("part", "n_pos", R("auc"))


@query("ml14_scenario_classes")
def ml14(t):
    model, _, test = _model(t)
    base = M.scores(model, test)
    breaks = ranking.quantiles(base, "score", [0.2, 0.4, 0.6, 0.8])
    return M.rescored_classes(model, test, {"f1": F.least(F.col("f1") * 1.2, F.lit(50.0))}, breaks).groupBy("class").agg(F.count("*").alias("n"))


@query("ml15_change_test")
def ml15(t):
    g = t.img_pair.select("r", "c", (F.col("a") + 1).alias("dry"), (F.col("b") + 1).alias("wet"), "ref")
    return M.change_test(g, "dry", "wet", "ref").groupBy("ref", "change").agg(F.count("*").alias("n"))


@query("mt10_protocols")
def mt10(t):
    s = _rows(t, *SEEN, P.fold_of_unseen(F.col("block"), 2).alias("fold"))
    out = M.run_protocols(s, M.leafwise(B.Boosting(FEATURES, rounds=1, leaves=4, rate=0.3), written=True), "y", "event", "fold", [1995, 1996, 1997], [1999, 2000], folds=2)
    return out.select("protocol", "part", *[R(c) for c in ("accuracy", "f1", "auc")])


@query("mt18_calibration")
def mt18(t):
    model, train, test = _model(t)
    c = M.calibrated(M.scores(model, train), M.scores(model, test), "y")
    c = c.withColumn("prior", S.prior_corrected(F.col("score"), 0.3))
    return metrics.briers(c, ["score", "prior", "platt", "isotonic"], F.col("y") == 1).select("method", R("brier", d=6))
