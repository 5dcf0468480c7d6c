"""Evaluation statistics (MT) and data checks (DQ)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import metrics as M
from ..operators import quality as Q
from ..operators import ranking
from ..operators.lineage import cut
from .join_queries import _DIST
from .registry import query, sql_with

R = lambda c, n=None, d=6: F.round(c, d).alias(n or c)
AGREE, SCORED, PAIR, SAMPLES, DEM = (sql_with(x) for x in ("agree", "scored", "img_pair", "samples", "dem"))
_CT = ", x AS (SELECT count(*) FILTER (WHERE a AND b)::DOUBLE AS tp, count(*) FILTER (WHERE a AND NOT b)::DOUBLE AS fp, count(*) FILTER (WHERE NOT a AND b)::DOUBLE AS fn, count(*) FILTER (WHERE NOT a AND NOT b)::DOUBLE AS tn FROM agree)"


def _auc_sql(source: str, score: str = "s", label: str = "y = 1") -> str:
    return f"(SELECT sum(p * (coalesce(b, 0) + n / 2.0)) / (sum(p) * sum(n)) FROM (SELECT p, n, sum(n) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM (SELECT {score} AS s, count(*) FILTER (WHERE {label})::DOUBLE AS p, count(*) FILTER (WHERE NOT ({label}))::DOUBLE AS n FROM {source} GROUP BY 1)))"


@query("mt01_classification", SCORED + ", x AS (SELECT count(*) FILTER (WHERE s >= 0.5 AND y = 1)::DOUBLE AS tp, count(*) FILTER (WHERE s >= 0.5 AND y = 0)::DOUBLE AS fp, count(*) FILTER (WHERE s < 0.5 AND y = 1)::DOUBLE AS fn, count(*) FILTER (WHERE s < 0.5 AND y = 0)::DOUBLE AS tn FROM scored) SELECT round((tp + tn) / (tp + tn + fp + fn), 6) AS accuracy, round(tp / (tp + fp), 6) AS \"precision\", round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1, round(tn / (tn + fp), 6) AS specificity, round(" + _auc_sql("scored") + ", 6) AS auc FROM x")
def mt01(t):
    return M.classification(t.scored, "s", F.col("y") == 1).select(*[R(c) for c in ("accuracy", "precision", "recall", "f1", "specificity", "auc")])


@query("mt02_auc", SCORED + " SELECT round(" + _auc_sql("scored") + ", 6) AS auc")
def mt02(t):
    return ranking.auc(t.scored, "s", F.col("y") == 1).select(R("auc"))


@query("mt03_agreement_ratios", AGREE + _CT + " SELECT round(tp/(tp+fn), 6) AS pod, round(1 - tp/(tp+fp), 6) AS far, round(tp/(tp+fp+fn), 6) AS csi, round(2*tp/(2*tp+fp+fn), 6) AS f1, round((tp+tn)/(tp+fp+fn+tn), 6) AS oa, round(((tp+tn)/(tp+fp+fn+tn) - ((tp+fp)*(tp+fn)+(fn+tn)*(fp+tn))/(tp+fp+fn+tn)**2) / (1 - ((tp+fp)*(tp+fn)+(fn+tn)*(fp+tn))/(tp+fp+fn+tn)**2), 6) AS kappa, round((tp+fp)/(tp+fn), 6) AS bias FROM x")
def mt03(t):
    return M.ratios(M.contingency(t.agree, F.col("a"), F.col("b"))).select(*[R(c) for c in ("pod", "far", "csi", "f1", "oa", "kappa", "bias")])


@query(
    "mt04_tolerant_agreement",
    DEM + ", o AS (SELECT r, c FROM dem WHERE z > 44), f AS (SELECT r, c FROM dem WHERE z < 3), tol AS (SELECT d.r, d.c FROM dem d WHERE EXISTS (SELECT 1 FROM f WHERE abs(f.r - d.r) <= 2 AND abs(f.c - d.c) <= 2)) SELECT (SELECT count(*) FROM o) AS found, (SELECT count(*) FROM o JOIN tol USING (r, c)) AS confirmed, round((SELECT count(*) FROM o JOIN tol USING (r, c)) / (SELECT count(*) FROM o)::DOUBLE / ((SELECT count(*) FROM tol) / (SELECT count(*) FROM dem)::DOUBLE), 6) AS lift",
)
def mt04(t):
    from ..operators.agreement import tolerant_agreement

    return tolerant_agreement(t.dem, F.col("z") > 44, F.col("z") < 3, 2).select("found", "confirmed", R("lift"))


@query(
    "mt05_event_evaluation",
    SCORED + """, k AS (SELECT s, y, CASE WHEN l_linenumber <= 2 AND y = 1 THEN 'pos' WHEN l_linenumber = 3 AND y = 0 THEN 'neg' ELSE 'rnd' END AS kind FROM scored), rf AS (SELECT s FROM k WHERE kind = 'rnd'),
pc AS (SELECT s, 100.0 * (SELECT count(*) FROM rf WHERE rf.s <= v.s) / (SELECT count(*) FROM rf) AS pct FROM (SELECT DISTINCT s FROM k) v), p AS (SELECT pct FROM k JOIN pc USING (s) WHERE kind = 'pos')
SELECT count(*) AS n_pos, round(avg((pct >= 60)::INT), 6) AS pos_in_upper_40, round(avg((pct >= 80)::INT), 6) AS pos_in_upper_20, """
    + ", ".join(f"round(avg((least(floor(pct / 20), 4) = {k})::INT) / 0.2, 6) AS fr_{k + 1}" for k in range(5))
    + ", round(" + _auc_sql("(SELECT * FROM k WHERE kind IN ('pos', 'neg'))", label="kind = 'pos'") + ", 6) AS auc_pos_vs_neg FROM p",
)
def mt05(t):
    k = F.when((F.col("l_linenumber") <= 2) & (F.col("y") == 1), "pos").when((F.col("l_linenumber") == 3) & (F.col("y") == 0), "neg").otherwise("rnd")
    out = M.event_evaluation(t.scored.withColumn("kind", k), "s", "kind", F.col("y") == 1)
    return out.select("n_pos", *[R(c) for c in ("pos_in_upper_40", "pos_in_upper_20", *[f"fr_{k}" for k in range(1, 6)], "auc_pos_vs_neg")])


@query("mt06_frequency_ratio", SAMPLES + ", g AS (SELECT l, sum(f1) AS a, sum(CASE WHEN y = 1 THEN f1 ELSE 0 END) AS f FROM (SELECT *, least(floor(f2 / 20000), 4)::INT AS l FROM samples) GROUP BY l) SELECT l AS class, round(a / (SELECT sum(a) FROM g), 6) AS area_share, round(f / (SELECT sum(f) FROM g), 6) AS flood_share, round(f / (SELECT sum(f) FROM g) / (a / (SELECT sum(a) FROM g)), 6) AS frequency_ratio FROM g")
def mt06(t):
    k = F.least(F.floor(F.col("f2") / 20000), F.lit(4)).cast("int")
    out = M.frequency_ratio(t.samples.withColumn("class", k), "class", F.col("y") == 1, F.col("f1"))
    return out.select("class", R("area_share"), R("flood_share"), R("frequency_ratio"))


@query("mt07_feature_auc", SAMPLES + " " + " UNION ALL ".join(f"SELECT 'f{i}' AS feature, round(" + _auc_sql("samples", f"f{i}") + f", 6) AS auc, round(greatest({_auc_sql('samples', f'f{i}')}, 1 - {_auc_sql('samples', f'f{i}')}), 6) AS sep" for i in (1, 3, 4)))
def mt07(t):
    long = t.samples.select("y", F.inline(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("x")) for f in ("f1", "f3", "f4")])))
    return ranking.auc(long, "x", F.col("y") == 1, ["feature"]).select("feature", R("auc"), R(F.greatest(F.col("auc"), 1 - F.col("auc")), "sep"))


@query("mt08_brier", SCORED + " SELECT round(avg((s - y) ** 2), 6) AS brier FROM scored")
def mt08(t):
    return M.brier(t.scored, "s", F.col("y") == 1).select(R("brier"))


_EDGES = ", ".join(f"quantile_cont(s, {k / 10}) AS q{k}" for k in range(11))


@query("mt09_calibration_error", SCORED + f", q AS (SELECT {_EDGES} FROM scored), b AS (SELECT s, y, least(greatest(" + " + ".join(f"(s >= q{k})::INT" for k in range(11)) + " - 1, 0), 9) AS bin FROM scored, q), g AS (SELECT bin, count(*) AS n, avg(s) AS ms, avg(y) AS my FROM b GROUP BY bin) SELECT round(sum(abs(ms - my) * n) / sum(n), 6) AS ece FROM g")
def mt09(t):
    return M.expected_calibration_error(t.scored, "s", F.col("y") == 1).select(R("ece"))


@query("mt11_reshape_by_event", SAMPLES + " SELECT " + ", ".join(f"round(avg(y) FILTER (WHERE event = {y}), 6) AS e{y}" for y in (1996, 1998, 2000)) + " FROM samples")
def mt11(t):
    return t.samples.groupBy().pivot("event", [1996, 1998, 2000]).agg(F.round(F.avg("y"), 6)).toDF("e1996", "e1998", "e2000")


@query("mt12_gated_subset_auc", SCORED + ", g AS (SELECT grp, count(*) FILTER (WHERE y = 1) AS n_pos FROM scored GROUP BY grp) SELECT grp, n_pos, CASE WHEN n_pos >= 30 THEN CASE grp " + " ".join(f"WHEN '{g}' THEN round(" + _auc_sql(f"(SELECT * FROM scored WHERE grp = '{g}')") + ", 6)" for g in "OF") + " END END AS auc FROM g")
def mt12(t):
    return ranking.auc(t.scored, "s", F.col("y") == 1, ["grp"]).select("grp", "n_pos", F.when(F.col("n_pos") >= 30, F.round("auc", 6)).alias("auc"))


@query("mt13_split_proximity")
def mt13(t):
    from ..operators.joins import nearest_points
    from ..operators.sampling import stratified_split

    s = t.customer.select("c_custkey", (F.col("c_nationkey") < 12).cast("int").alias("y"), F.pmod("c_custkey", F.lit(100)).cast("double").alias("x"), (F.col("c_acctbal") / 100).alias("yy"))
    split = stratified_split(s, "y", ["c_custkey"])
    at = lambda d, n: d.select(F.col("c_custkey").alias(n), "x", F.col("yy").alias("y"))
    near = nearest_points(at(split.where("NOT train"), "q"), at(split.where("train"), "s"), "q", "s")
    near = cut(near)
    return near.agg(R(F.avg((F.col("dist") <= 1).cast("int")), "within_1")).withColumn("median", R(F.lit(ranking.quantiles(near, "dist", [0.5])[0]), "median"))


@query("mt14_class_agreement", DEM + " SELECT round(avg((z // 10 = c // 10)::INT), 6) AS same, round(avg((abs(z // 10 - c // 10) <= 1)::INT), 6) AS within_1 FROM dem".replace("z // 10", "floor(z / 10)").replace("c // 10", "floor(c / 10)"))
def mt14(t):
    a, b = F.floor(F.col("z") / 10), F.floor(F.col("c") / 10)
    return t.dem.agg(R(F.avg((a == b).cast("int")), "same"), R(F.avg((F.abs(a - b) <= 1).cast("int")), "within_1"))


@query("mt15_source_agreement", PAIR + ", x AS (SELECT abs(a) * 2 AS p, abs(b) * 2 AS q FROM img_pair) SELECT round(corr(p, q), 6) AS r, round(2.0 * count(*) FILTER (WHERE p >= 0.5 AND q >= 0.5) / (count(*) FILTER (WHERE p >= 0.5) + count(*) FILTER (WHERE q >= 0.5)), 6) AS f1, round(avg(abs(p - q)), 6) AS mae FROM x")
def mt15(t):
    x = t.img_pair.select((F.abs("a") * 2).alias("p"), (F.abs("b") * 2).alias("q"))
    p, q = F.col("p") >= 0.5, F.col("q") >= 0.5
    return x.agg(R(F.corr("p", "q"), "r"), R(F.try_divide(F.count_if(p & q) * 2.0, F.count_if(p) + F.count_if(q)), "f1"), R(F.avg(F.abs(F.col("p") - F.col("q"))), "mae"))


@query("mt16_plausibility", DEM + " SELECT round(avg((z < 10)::INT) FILTER (WHERE c < 10), 6) AS low_near, round(avg((z < 10)::INT) FILTER (WHERE c >= 40), 6) AS low_far FROM dem")
def mt16(t):
    low = (F.col("z") < 10).cast("int")
    return t.dem.agg(R(F.avg(F.when(F.col("c") < 10, low)), "low_near"), R(F.avg(F.when(F.col("c") >= 40, low)), "low_far"))


@query("mt17_keep_rule", "SELECT s_suppkey, CASE WHEN s_acctbal >= 0 AND s_nationkey < 20 AND s_suppkey % 3 <> 0 THEN 'kept' ELSE 'rejected' END AS status, concat_ws('; ', CASE WHEN s_acctbal < 0 THEN 'debt' END, CASE WHEN s_nationkey >= 20 THEN 'nation' END, CASE WHEN s_suppkey % 3 = 0 THEN 'third' END) AS reason FROM supplier")
def mt17(t):
    return Q.keep_rule(t.supplier, {"debt": F.col("s_acctbal") < 0, "nation": F.col("s_nationkey") >= 20, "third": F.col("s_suppkey") % 3 == 0}).select("s_suppkey", "status", "reason")


# data checks ------------------------------------------------------------------------------------------------


@query("dq01_audit", "SELECT 'nation' AS name, count(*) AS n, round(avg((n_name IS NOT NULL)::INT), 6) AS valid FROM nation UNION ALL SELECT 'supplier', count(*), round(avg((s_acctbal IS NOT NULL)::INT), 6) FROM supplier")
def dq01(t):
    return Q.audit({"nation": (t.nation, "n_name"), "supplier": (t.supplier, "s_acctbal")}).withColumn("valid", F.round("valid", 6))


@query("dq02_sample_checks", SAMPLES + " SELECT count(*) FILTER (WHERE f1 IS NULL) = 0 AS no_nulls, bool_and(f1 >= 0) AS non_negative, bool_and(f3 BETWEEN 0 AND 0.11) AS in_range, count(*) FILTER (WHERE y = 1) = count(*) FILTER (WHERE y = 0) AS balanced, count(*) = count(DISTINCT id) AS is_unique FROM samples")
def dq02(t):
    return Q.sample_checks(t.samples, "y", ["id"], "f1", "f3", 0.0, 0.11)


@query("dq03_layer_checkpoint", PAIR + " SELECT 'a' AS layer, count(*) FILTER (WHERE a IS NULL) AS gaps, round(min(a), 6) AS lo, round(max(a), 6) AS hi FROM img_pair UNION ALL SELECT 'b', count(*) FILTER (WHERE b IS NULL), round(min(b), 6), round(max(b), 6) FROM img_pair")
def dq03(t):
    return Q.layer_report(t.img_pair, ["a", "b"]).select("layer", "gaps", R("lo"), R("hi"))


@query("dq04_gaps_by_event", SAMPLES + " SELECT event, count(*) FILTER (WHERE f2 IS NULL) AS gaps, round(min(f2), 2) AS lo, round(max(f2), 2) AS hi FROM samples GROUP BY 1")
def dq04(t):
    return t.samples.groupBy("event").agg(F.count_if(F.col("f2").isNull()).alias("gaps"), R(F.min("f2"), "lo", 2), R(F.max("f2"), "hi", 2))


@query("dq05_spot_check", _DIST)
def dq05(t):
    """Fast nearest distance against the exact one at sampled points."""
    from .join_queries import jn17

    return jn17(t)


@query("dq06_regression_equality", PAIR + " SELECT count(*) FILTER (WHERE abs(a - a) > 1e-6) AS differing, round(max(abs(a - a)), 6) AS most FROM img_pair")
def dq06(t):
    return Q.difference(t.img_pair.select("r", "c", "a"), t.img_pair.select("r", "c", F.col("a").alias("b")), ["r", "c"], "a", "b", 1e-6)


@query("dq07_provenance", "SELECT n_name, CASE WHEN n_nationkey % 3 = 0 THEN 'live' WHEN n_nationkey % 3 = 1 THEN 'synthetic' ELSE 'unknown' END AS provenance FROM nation")
def dq07(t):
    log = F.when(F.col("n_nationkey") % 3 == 0, "fetched from server").when(F.col("n_nationkey") % 3 == 1, "fallback: synthetic grid").otherwise("")
    return t.nation.select("n_name", Q.provenance(log).alias("provenance"))
