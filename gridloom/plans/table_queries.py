"""Aggregation (AG), sorting (SO) and set operations (ST)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import metrics, ranking, resample, stats
from .registry import draw_sql, query, sql_with

R = lambda c, n, d=6: F.round(c, d).alias(n)
IMG, DEM, PAIR, SAMPLES, AGREE, CUBE = (sql_with(x) for x in ("img", "dem", "img_pair", "samples", "agree", "cube"))


@query("ag01_masked_stats", PAIR + " SELECT count(*) FILTER (WHERE ref) AS n, round(sum(a) FILTER (WHERE ref), 4) AS total, round(avg(ref::INT), 6) AS share FROM img_pair")
def ag01(t):
    return t.img_pair.agg(F.count_if("ref").alias("n"), R(F.sum(F.when(F.col("ref"), F.col("a"))), "total", 4), R(F.avg(F.col("ref").cast("int")), "share"))


@query("ag02_area_sum", DEM + " SELECT round(sum(CASE WHEN z > 25 THEN 0.00027 * 111.320 * cos(radians(10.5 - (r + 0.5) * 0.00027)) * 0.00027 * 110.574 END), 6) AS km2 FROM dem")
def ag02(t):
    area = S.sphere_cell_km2(S.pixel_lat(F.col("r"), 10.5, -0.00027), 0.00027, 0.00027)
    return t.dem.agg(R(F.sum(F.when(F.col("z") > 25, area)), "km2"))


@query("ag03_contingency", AGREE + " SELECT count(*) FILTER (WHERE a AND b) AS tp, count(*) FILTER (WHERE a AND NOT b) AS fp, count(*) FILTER (WHERE NOT a AND b) AS fn, count(*) FILTER (WHERE NOT a AND NOT b) AS tn FROM agree")
def ag03(t):
    return metrics.contingency(t.agree, F.col("a"), F.col("b"))


@query("ag04_named_aggs", SAMPLES + " SELECT block, round(avg(f1), 6) AS mean_f1, round(sum(f2), 2) AS sum_f2, round(quantile_cont(f3, 0.5), 6) AS med_f3 FROM samples GROUP BY block")
def ag04(t):
    return t.samples.groupBy("block").agg(R(F.avg("f1"), "mean_f1"), R(F.sum("f2"), "sum_f2", 2), R(F.percentile("f3", 0.5), "med_f3"))


@query("ag05_group_size", SAMPLES + " SELECT block, event, count(*) AS n FROM samples GROUP BY ALL")
def ag05(t):
    return t.samples.groupBy("block", "event").agg(F.count("*").alias("n"))


@query("ag06_pivot_counts", SAMPLES + ", f AS (SELECT *, id % 5 AS fold FROM samples WHERE y = 1) SELECT fold, " + ", ".join(f"count(*) FILTER (WHERE event = {y}) AS e{y}" for y in range(1995, 2002)) + " FROM f GROUP BY fold")
def ag06(t):
    years = list(range(1995, 2002))
    p = t.samples.where("y = 1").groupBy(F.pmod("id", F.lit(5)).alias("fold")).pivot("event", years).count().fillna(0)
    return p.select("fold", *[F.col(f"`{y}`").alias(f"e{y}") for y in years])


@query("ag07_value_counts", "SELECT l_returnflag, count(*) AS n FROM lineitem GROUP BY 1")
def ag07(t):
    return t.lineitem.groupBy("l_returnflag").agg(F.count("*").alias("n"))


@query("ag08_distinct", "SELECT count(DISTINCT l_partkey) AS parts, count(DISTINCT l_suppkey) AS suppliers FROM lineitem")
def ag08(t):
    return t.lineitem.agg(F.count_distinct("l_partkey").alias("parts"), F.count_distinct("l_suppkey").alias("suppliers"))


@query("ag09_class_quantiles", SAMPLES + " SELECT y, round(quantile_cont(f2, 0.1), 4) AS p10, round(quantile_cont(f2, 0.5), 4) AS p50, round(quantile_cont(f2, 0.9), 4) AS p90 FROM samples GROUP BY y")
def ag09(t):
    q = t.samples.groupBy("y").agg(F.percentile("f2", [0.1, 0.5, 0.9]).alias("q"))
    return q.select("y", *[R(F.get("q", F.lit(i)), n, 4) for i, n in enumerate(("p10", "p50", "p90"))])


@query("ag10_exact_quantiles", "SELECT round(quantile_cont(value, 0.2), 6) AS q20, round(quantile_cont(value, 0.8), 6) AS q80 FROM events")
def ag10(t):
    low, high = ranking.quantiles(t.events, "value", [0.2, 0.8])
    return t.spark.range(1).select(R(F.lit(low), "q20"), R(F.lit(high), "q80"))


@query("ag11_histogram", IMG + " SELECT CASE WHEN v = 0.6 THEN 11 ELSE floor((v + 0.6) / 0.1)::INT END AS bin, count(*) AS n FROM img WHERE v BETWEEN -0.6 AND 0.6 GROUP BY 1")
def ag11(t):
    return stats.histogram(t.img, "v", -0.6, 0.6, 12)


_OTSU = """, lim AS (SELECT min(v) AS lo, max(v) AS hi FROM img), b AS (SELECT least(floor((v - lo) / (hi - lo) * 512), 511)::INT AS bin, count(*) AS n FROM img, lim GROUP BY 1),
c AS (SELECT bin, n, lo + (bin + 0.5) * (hi - lo) / 512 AS mid FROM b, lim),
w AS (SELECT bin, mid, sum(n) OVER (ORDER BY bin) AS w1, sum(n * mid) OVER (ORDER BY bin) AS s1, sum(n) OVER () AS w, sum(n * mid) OVER () AS s FROM c),
k AS (SELECT max_by(mid, (w1 * (w - w1))::DOUBLE * (s1 / w1 - (s - s1) / (w - w1)) ** 2) AS t FROM w WHERE w1 < w)"""


@query("ag12_otsu_threshold", IMG + _OTSU + " SELECT round(t, 6) AS threshold FROM k")
def ag12(t):
    return stats.otsu(t.img, "v").select(R(F.col("threshold"), "threshold"))


@query(
    "ag13_separability",
    IMG + _OTSU + " SELECT round(avg((v < t)::INT), 6) AS low_share, round(avg(v) FILTER (WHERE v < t), 6) AS low_mean, round(avg(v) FILTER (WHERE v >= t), 6) AS high_mean, round(avg((v < t)::INT) * (1 - avg((v < t)::INT)) * (avg(v) FILTER (WHERE v < t) - avg(v) FILTER (WHERE v >= t)) ** 2 / var_pop(v), 6) AS eta FROM img, k",
)
def ag13(t):
    threshold = stats.otsu(t.img, "v").first()["threshold"]
    return stats.separability(t.img, "v", threshold).select(*[R(F.col(c), c) for c in ("low_share", "low_mean", "high_mean", "eta")])


@query(
    "agg12_otsu_change",
    PAIR + ", " + ", ".join(
        f"""l{x} AS (SELECT min({x}) AS lo, max({x}) AS hi FROM img_pair), b{x} AS (SELECT least(floor(({x} - lo) / (hi - lo) * 512), 511)::INT AS bin, count(*) AS n FROM img_pair, l{x} GROUP BY 1),
c{x} AS (SELECT bin, n, lo + (bin + 0.5) * (hi - lo) / 512 AS mid FROM b{x}, l{x}), w{x} AS (SELECT mid, sum(n) OVER (ORDER BY bin) AS w1, sum(n * mid) OVER (ORDER BY bin) AS s1, sum(n) OVER () AS w, sum(n * mid) OVER () AS s FROM c{x}),
k{x} AS (SELECT max_by(mid, (w1 * (w - w1))::DOUBLE * (s1 / w1 - (s - s1) / (w - w1)) ** 2) AS t FROM w{x} WHERE w1 < w)""" for x in "ab"
    ) + """, m AS (SELECT (a < ka.t AND NOT b < kb.t) AS f, ref FROM img_pair, ka, kb),
x AS (SELECT count(*) FILTER (WHERE f AND ref) AS tp, count(*) FILTER (WHERE f AND NOT ref) AS fp, count(*) FILTER (WHERE NOT f AND ref) AS fn, count(*) FILTER (WHERE NOT f AND NOT ref) AS tn FROM m)
SELECT tp, fp, fn, tn, round(tp / (tp + fn), 6) AS pod, round(1 - tp / (tp + fp), 6) AS far, round(tp / (tp + fp + fn), 6) AS csi FROM x""",
)
def agg12(t):
    """Change between two observations by two thresholds, held against a reference."""
    pair = t.img_pair
    ta, tb = (stats.otsu(pair.select(F.col(x).alias("v")), "v").first()["threshold"] for x in "ab")
    table = metrics.contingency(pair, (F.col("a") < ta) & ~(F.col("b") < tb), F.col("ref"))
    return metrics.ratios(table).select("tp", "fp", "fn", "tn", *[R(F.col(c), c) for c in ("pod", "far", "csi")])


@query("ag14_layer_stats", IMG + " SELECT round(min(v), 6) AS lo, round(max(v), 6) AS hi, round(avg(v), 6) AS mean, round(quantile_cont(v, 0.5), 6) AS med FROM img")
def ag14(t):
    med = ranking.quantiles(t.img, "v", [0.5])[0]
    return t.img.agg(R(F.min("v"), "lo"), R(F.max("v"), "hi"), R(F.avg("v"), "mean")).withColumn("med", R(F.lit(med), "med"))


@query("ag15_bincount", "SELECT p_size, count(*) AS n FROM part GROUP BY 1")
def ag15(t):
    return t.part.groupBy("p_size").agg(F.count("*").alias("n"))


@query("ag16_weighted_bincount", "SELECT l_linenumber AS cell, round(sum(l_quantity), 2) AS len FROM lineitem GROUP BY 1")
def ag16(t):
    return t.lineitem.groupBy(F.col("l_linenumber").alias("cell")).agg(R(F.sum("l_quantity"), "len", 2))


@query("ag17_pearson", PAIR + " SELECT round(corr(a, b), 6) AS r FROM img_pair")
def ag17(t):
    return t.img_pair.agg(R(F.corr("a", "b"), "r"))


@query("ag17_pearson_matrix", SAMPLES + " " + " UNION ALL ".join(f"SELECT 'f{i}' AS x, 'f{j}' AS y, round(corr(f{i}, f{j}), 6) AS r FROM samples" for i in range(1, 5) for j in range(i + 1, 5)))
def ag17m(t):
    return stats.correlations(t.samples, ["f1", "f2", "f3", "f4"]).withColumn("r", F.round("r", 6))


@query("ag18_spearman_ordinal", SAMPLES + ", k AS (SELECT row_number() OVER (ORDER BY f1, id, y, f2) AS a, row_number() OVER (ORDER BY f2, id, y, f1) AS b FROM (SELECT id, y, f1, f2, f3, f4 FROM samples GROUP BY ALL)) SELECT round(corr(a, b), 6) AS rho FROM k")
def ag18a(t):
    s = t.samples.select("id", "y", "f1", "f2", "f3", "f4").distinct()
    one = ranking.ordinal_ranks(s, "f1", ["id", "y", "f2"]).withColumnRenamed("rank", "a")
    return ranking.ordinal_ranks(one, "f2", ["id", "y", "f1"]).agg(R(F.corr("a", "rank"), "rho"))


@query("ag18_spearman_average", SAMPLES + ", k AS (SELECT rank() OVER (ORDER BY f1) + (count(*) OVER (PARTITION BY f1) - 1) / 2.0 AS a, rank() OVER (ORDER BY f2) + (count(*) OVER (PARTITION BY f2) - 1) / 2.0 AS b FROM samples) SELECT round(corr(a, b), 6) AS rho FROM k")
def ag18b(t):
    ra = ranking.average_ranks(t.samples, "f1").select("f1", F.col("rank").alias("a"))
    rb = ranking.average_ranks(t.samples, "f2").select("f2", F.col("rank").alias("b"))
    return t.samples.join(ra, "f1").join(rb, "f2").agg(R(F.corr("a", "b"), "rho"))


def _det3(i: tuple[int, ...]) -> str:
    """The determinant of the correlations of three columns."""
    a, b, c = (f"r{i[x]}{i[y]}" for x, y in ((0, 1), (0, 2), (1, 2)))
    return f"(1 + 2 * {a} * {b} * {c} - {a} * {a} - {b} * {b} - {c} * {c})"


_R = {(i, j): f"corr(f{i}, f{j}) AS r{i}{j}" for i in range(1, 5) for j in range(i + 1, 5)}
#: The determinant of all four, by its first row.
_DET4 = (
    f"({_det3((2, 3, 4))} - r12 * (r12 * (1 - r34 * r34) - r23 * (r13 - r34 * r14) + r24 * (r13 * r34 - r14))"
    " + r13 * (r12 * (r23 - r34 * r24) - (r13 - r34 * r14) + r24 * (r13 * r24 - r23 * r14)) - r14 * (r12 * (r23 * r34 - r24) - (r13 * r34 - r14) + r23 * (r13 * r24 - r23 * r14)))"
)


@query(
    "ag19_vif",
    SAMPLES + f", m AS (SELECT {', '.join(_R.values())} FROM samples) " + " UNION ALL ".join(f"SELECT 'f{k}' AS name, round({_det3(tuple(x for x in range(1, 5) if x != k))} / {_DET4}, 6) AS vif FROM m" for k in range(1, 5)),
)
def ag19(t):
    return stats.vif(t.samples, ["f1", "f2", "f3", "f4"]).withColumn("vif", F.round("vif", 6))


@query("ag20_high_correlations", SAMPLES + " SELECT * FROM (" + " UNION ALL ".join(f"SELECT 'f{i}' AS x, 'f{j}' AS y, round(corr(f{i}, f{j}), 6) AS r FROM samples" for i in range(1, 5) for j in range(i + 1, 5)) + ") WHERE abs(r) >= 0.7")
def ag20(t):
    return stats.correlations(t.samples, ["f1", "f2", "f3", "f4"]).where(F.abs("r") >= 0.7).withColumn("r", F.round("r", 6))


@query("ag21_looks", PAIR + " SELECT ref, round(avg(a + 1) ** 2 / var_pop(a + 1), 6) AS looks FROM img_pair GROUP BY ref")
def ag21(t):
    v = F.col("a") + 1
    return t.img_pair.groupBy("ref").agg(R(F.pow(F.avg(v), F.lit(2.0)) / F.var_pop(v), "looks"))


@query("ag22_mode", "SELECT l_suppkey, -max(k)['v'] AS part_mode FROM (SELECT l_suppkey, {'n': count(*), 'v': -l_partkey % 1000} AS k FROM lineitem GROUP BY l_suppkey, l_partkey % 1000, -l_partkey % 1000) GROUP BY 1")
def ag22(t):
    return stats.mode(t.lineitem.select("l_suppkey", (F.col("l_partkey") % 1000).alias("part_mode")), ["l_suppkey"], "part_mode")


@query("ag23_composite", CUBE + " SELECT r, round(sum(v), 4) AS total, round(avg(v), 6) AS mean, round(quantile_cont(v, 0.5), 4) AS med FROM cube GROUP BY r")
def ag23(t):
    return t.cube.groupBy("r").agg(R(F.sum("v"), "total", 4), R(F.avg("v"), "mean"), R(F.percentile("v", 0.5), "med", 4))


@query("ag24_region_mean", CUBE + " SELECT year, round(avg(v), 6) AS mean FROM cube GROUP BY year")
def ag24(t):
    return t.cube.groupBy("year").agg(R(F.avg("v"), "mean"))


@query("ag25_block_mean", DEM + " SELECT floor(r / 3)::INT AS r, floor(c / 3)::INT AS c, round(avg(z), 6) AS mean, round(sum(z), 6) AS total FROM dem GROUP BY 1, 2")
def ag25(t):
    return resample.block_stats(t.dem, 3, mean=F.round(F.avg("z"), 6), total=F.round(F.sum("z"), 6))


@query("ag26_arg_max", "SELECT o_custkey, min(o_orderkey) AS o_orderkey FROM orders o WHERE o_totalprice = (SELECT max(o_totalprice) FROM orders x WHERE x.o_custkey = o.o_custkey) GROUP BY 1")
def ag26(t):
    return t.orders.groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_totalprice", -F.col("o_orderkey"))).alias("o_orderkey"))


@query("ag27_fold_mean_sd", SAMPLES + ", f AS (SELECT id % 5 AS fold, avg(f1) AS m FROM samples GROUP BY 1) SELECT round(avg(m), 6) AS mean, round(stddev_pop(m), 6) AS sd FROM f")
def ag27(t):
    folds = t.samples.groupBy(F.pmod("id", F.lit(5)).alias("fold")).agg(F.avg("f1").alias("m"))
    return folds.agg(R(F.avg("m"), "mean"), R(F.stddev_pop("m"), "sd"))


@query("ag28_mean_rank", "WITH s AS (SELECT l_returnflag AS src, avg(l_quantity) AS a, avg(l_discount) AS b, avg(l_tax) AS c FROM lineitem GROUP BY 1), k AS (SELECT src, (rank() OVER (ORDER BY a DESC, src) + rank() OVER (ORDER BY b DESC, src) + rank() OVER (ORDER BY c, src) - 3) / 3.0 AS mean_rank FROM s) SELECT src, round(mean_rank, 6) AS mean_rank, mean_rank = min(mean_rank) OVER () AS chosen FROM k")
def ag28(t):
    s = t.lineitem.groupBy(F.col("l_returnflag").alias("src")).agg(F.avg("l_quantity").alias("a"), F.avg("l_discount").alias("b"), F.avg("l_tax").alias("c"))
    return stats.mean_ranks(s, "src", {"a": True, "b": True, "c": False}).withColumn("mean_rank", F.round("mean_rank", 6))


@query("ag29_class_shares", "SELECT p_brand, " + ", ".join(f"round(avg((p_size % 3 = {k})::INT), 6) AS s{k}" for k in range(3)) + " FROM part GROUP BY 1")
def ag29(t):
    return t.part.groupBy("p_brand").agg(*[R(F.avg((F.col("p_size") % 3 == k).cast("int")), f"s{k}") for k in range(3)])


@query("ag30_growth", CUBE + ", e AS (SELECT r, max(v) FILTER (WHERE year = 1996) AS a, max(v) FILTER (WHERE year = 2000) AS b FROM cube GROUP BY r) SELECT r, round((b / a) ** 0.25 - 1, 6) AS cagr FROM e WHERE a > 0 AND b IS NOT NULL")
def ag30(t):
    e = t.cube.groupBy("r").agg(F.max(F.when(F.col("year") == 1996, F.col("v"))).alias("a"), F.max(F.when(F.col("year") == 2000, F.col("v"))).alias("b"))
    return e.where("a > 0 AND b IS NOT NULL").select("r", R(S.cagr(F.col("a"), F.col("b"), 4.0), "cagr"))


@query("ag31_checks", "SELECT bool_and(l_quantity > 0) AS all_positive, bool_or(l_discount > 0.05) AS any_large, max(l_quantity) AS most FROM lineitem")
def ag31(t):
    return t.lineitem.agg(F.bool_and(F.col("l_quantity") > 0).alias("all_positive"), F.bool_or(F.col("l_discount") > 0.05).alias("any_large"), F.max("l_quantity").alias("most"))


@query("ag32_points_per_cell", "SELECT floor(c_custkey / 100)::INT AS gc, floor(c_acctbal / 1000)::INT AS gr, count(*) AS n FROM customer GROUP BY 1, 2")
def ag32(t):
    return t.customer.groupBy(F.floor(F.col("c_custkey") / 100).cast("int").alias("gc"), F.floor(F.col("c_acctbal") / 1000).cast("int").alias("gr")).agg(F.count("*").alias("n"))


@query("ag33_normalise_by_max", "SELECT p_partkey, round(p_retailprice / (SELECT max(p_retailprice) FROM part), 6) AS share FROM part")
def ag33(t):
    top = t.part.agg(F.max("p_retailprice").alias("m")).first()["m"]
    return t.part.select("p_partkey", R(F.col("p_retailprice") / F.lit(top), "share"))


# sorting, limits --------------------------------------------------------------------------------------------


@query("so01_elevation_order", DEM + " SELECT r, c, row_number() OVER (ORDER BY z DESC, r, c) AS nth FROM dem")
def so01(t):
    return ranking.ordinal_ranks(t.dem.withColumn("z", -F.col("z")), "z", ["r", "c"]).select("r", "c", F.col("rank").alias("nth"))


@query("so02_sort", "SELECT s_suppkey, s_acctbal FROM supplier ORDER BY s_acctbal DESC, s_suppkey")
def so02(t):
    return t.supplier.select("s_suppkey", "s_acctbal").orderBy(F.desc("s_acctbal"), "s_suppkey")


@query("so03_best_of_group", "SELECT l_suppkey, max(l_extendedprice) AS best FROM lineitem GROUP BY 1")
def so03(t):
    return t.lineitem.groupBy("l_suppkey").agg(F.max(F.struct("l_extendedprice", "l_orderkey")).alias("b")).select("l_suppkey", F.col("b.l_extendedprice").alias("best"))


@query("so04_head", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 12")
def so04(t):
    return t.orders.select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(12)


@query("so05_best_by_tuple", "SELECT p_brand, p_partkey FROM part ORDER BY p_size DESC, p_retailprice, p_partkey LIMIT 1")
def so05(t):
    best = t.part.agg(F.max_by(F.struct("p_brand", "p_partkey"), F.struct("p_size", -F.col("p_retailprice"), -F.col("p_partkey"))).alias("b"))
    return best.select("b.*")


@query("so06_having", "SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) >= 600")
def so06(t):
    return t.lineitem.groupBy("l_suppkey").agg(F.count("*").alias("n")).where("n >= 600")


@query("so07_random_subset", sql_with("dem") + f" SELECT r, c, z FROM dem WHERE z > 25 ORDER BY {draw_sql('r', 'c')}, r, c LIMIT 35")
def so07(t):
    from ..operators.sampling import first_by_hash

    return first_by_hash(t.dem.where("z > 25"), ["r", "c"], 35)


# sets -------------------------------------------------------------------------------------------------------


@query("st01_concat", "SELECT s_name AS name, s_acctbal AS bal, 's' AS kind, NULL::VARCHAR AS seg FROM supplier UNION ALL SELECT c_name, c_acctbal, 'c', c_mktsegment FROM customer")
def st01(t):
    s = t.supplier.select(F.col("s_name").alias("name"), F.col("s_acctbal").alias("bal"), F.lit("s").alias("kind"))
    c = t.customer.select(F.col("c_name").alias("name"), F.col("c_acctbal").alias("bal"), F.lit("c").alias("kind"), F.col("c_mktsegment").alias("seg"))
    return s.unionByName(c, allowMissingColumns=True)


_KEYS = "WITH a AS (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_quantity > 45), b AS (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_discount > 0.08) "


def _keys(t):
    return t.lineitem.where("l_quantity > 45").select(F.col("l_partkey").alias("k")), t.lineitem.where("l_discount > 0.08").select(F.col("l_partkey").alias("k"))


@query("st02_union", _KEYS + "SELECT k FROM a UNION SELECT k FROM b")
def st02u(t):
    a, b = _keys(t)
    return a.union(b).distinct()


@query("st02_intersect", _KEYS + "SELECT k FROM a INTERSECT SELECT k FROM b")
def st02i(t):
    a, b = _keys(t)
    return a.intersect(b)


@query("st02_difference", _KEYS + "SELECT k FROM a EXCEPT SELECT k FROM b")
def st02d(t):
    a, b = _keys(t)
    return a.subtract(b)


@query("st03_union_fixed_point", sql_with("topo", recursive=True) + ", up AS (SELECT id FROM topo WHERE id IN (7, 11) UNION SELECT t.id FROM topo t JOIN up ON t.next_down = up.id WHERE t.id <> t.next_down) SELECT id FROM up")
def st03(t):
    from ..operators.joins import upstream

    return upstream(t.topo, t.topo.where("id IN (7, 11)"))


@query("st04_distinct", SAMPLES + " SELECT DISTINCT block FROM samples")
def st04(t):
    return t.samples.select("block").distinct()


@query("st05_duplicates", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def st05(t):
    return t.lineitem.groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n")).where("n > 1")


@query("st06_disjoint", "SELECT count(*) = 0 AS disjoint FROM (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' INTERSECT SELECT p_partkey + 1000000000 FROM part)")
def st06(t):
    both = t.lineitem.where("l_returnflag = 'R'").select(F.col("l_partkey").alias("k")).intersect(t.part.select((F.col("p_partkey") + 1000000000).alias("k")))
    return both.agg((F.count("*") == 0).alias("disjoint"))


@query("st07_name_leakage", "SELECT 'l_tax' AS name")
def st07(t):
    names = sorted({"l_tax", "lon", "lat", "block_id"} & set(t.lineitem.columns))
    return t.spark.createDataFrame([(n,) for n in names], "name string")


@query("st08_mosaic", "SELECT r, c, round(coalesce(CASE WHEN ref THEN a END, b), 6) AS v FROM (" + PAIR + " SELECT * FROM img_pair)")
def st08(t):
    first = t.img_pair.where("ref").select("r", "c", F.lit(1).alias("priority"), F.col("a").alias("v"))
    second = t.img_pair.select("r", "c", F.lit(2).alias("priority"), F.col("b").alias("v"))
    return stats.mosaic(first.unionByName(second), "priority", "v").withColumn("v", F.round("v", 6))
