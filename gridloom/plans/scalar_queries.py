"""Scalar functions (SC), projections and predicates (PF)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import ranking
from .registry import query, sql_with

R = lambda c, n, d=6: F.round(c, d).alias(n)
IMG, DEM, PAIR = sql_with("img"), sql_with("dem"), sql_with("img_pair")


@query("sc01_db_linear", IMG + " SELECT r, c, round(pow(10, v / 10), 6) AS linear, round(10 * log10(greatest(v, 1e-10)), 6) AS db FROM img")
def sc01(t):
    return t.img.select("r", "c", R(S.db_to_linear(F.col("v")), "linear"), R(S.linear_to_db(F.col("v")), "db"))


@query("sc02_dn_db", "SELECT l_orderkey, l_linenumber, l_quantity > 10 AS valid, round(20 * log10(greatest(l_quantity, 1)) - 55, 6) AS db FROM lineitem")
def sc02(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", (F.col("l_quantity") > 10).alias("valid"), R(S.dn_to_db(F.col("l_quantity")), "db"))


@query("sc03_slope", PAIR + " SELECT r, c, round(degrees(atan(sqrt(a * a + b * b))), 6) AS slope FROM img_pair")
def sc03(t):
    return t.img_pair.select("r", "c", R(S.slope_deg(F.col("a"), F.col("b")), "slope"))


@query("sc04_aspect", PAIR + " SELECT r, c, round(CASE WHEN a = 0 AND b = 0 THEN -1 ELSE ((degrees(atan2(-a, -b)) % 360) + 360) % 360 END, 5) AS aspect FROM img_pair")
def sc04(t):
    return t.img_pair.select("r", "c", R(S.aspect_deg(F.col("a"), F.col("b")), "aspect", 5))


_LAT = "(10.5 - (r + 0.5) * 0.00027)"
_W = f"(1 - 6.69437999014e-3 * sin(radians{_LAT}) ** 2)"


@query(
    "sc05_ellipsoid_cell",
    DEM + f" SELECT DISTINCT r, round(6378137.0 / sqrt{_W} * cos(radians{_LAT}) * radians(0.00027), 6) AS dx, round(6378137.0 * (1 - 6.69437999014e-3) / {_W} ** 1.5 * radians(0.00027), 6) AS dy FROM dem",
)
def sc05(t):
    dx, dy, _ = S.ellipsoid_cell(S.pixel_lat(F.col("r"), 10.5, -0.00027), 0.00027, 0.00027)
    return t.dem.select("r").distinct().select("r", R(dx, "dx"), R(dy, "dy"))


@query("sc06_sphere_cell", DEM + f" SELECT r, c, round(0.00027 * 111.320 * cos(radians{_LAT}) * (0.00027 * 110.574) * 1e6, 6) AS m2 FROM dem")
def sc06(t):
    return t.dem.select("r", "c", R(S.sphere_cell_km2(S.pixel_lat(F.col("r"), 10.5, -0.00027), 0.00027, 0.00027) * 1e6, "m2"))


@query("sc07_wetness", PAIR + " SELECT r, c, round(ln(((r + 1) * 900.0) / 30.0 / greatest(sqrt(a * a + b * b), 0.001)), 6) AS twi FROM img_pair")
def sc07(t):
    return t.img_pair.select("r", "c", R(S.wetness((F.col("r") + 1) * 900.0, F.lit(30.0), F.col("a"), F.col("b")), "twi"))


@query(
    "sc09_hillshade",
    PAIR + " SELECT r, c, round(least(greatest(cos(radians(45)) * cos(atan(sqrt(a*a+b*b))) + sin(radians(45)) * sin(atan(sqrt(a*a+b*b))) * cos(radians(315) - atan2(-a, -b)), 0), 1), 6) AS shade FROM img_pair",
)
def sc09(t):
    return t.img_pair.select("r", "c", R(S.hillshade(F.col("a"), F.col("b")), "shade"))


@query(
    "sc10_curve_number_runoff",
    """WITH x AS (SELECT p_partkey, p_size * 4.0 AS rain, (p_partkey % 101) / 100.0 * 98.0 + (1 - (p_partkey % 101) / 100.0) * 74.0 AS cn FROM part),
    y AS (SELECT *, 25400.0 / cn - 254.0 AS s, 25400.0 / (23.0 * cn / (10.0 + 0.13 * cn)) - 254.0 AS s3 FROM x)
    SELECT p_partkey, round(CASE WHEN rain > 0.2 * s THEN (rain - 0.2 * s) ** 2 / (rain + 0.8 * s) ELSE 0 END, 6) AS q,
      round(CASE WHEN rain > 0.2 * s3 THEN (rain - 0.2 * s3) ** 2 / (rain + 0.8 * s3) ELSE 0 END, 6) AS q_wet FROM y""",
)
def sc10(t):
    cn = S.mixed_curve_number(F.pmod("p_partkey", F.lit(101)) / 100.0, 74.0)
    rain = F.col("p_size") * 4.0
    return t.part.select("p_partkey", R(S.runoff(rain, cn), "q"), R(S.runoff(rain, S.wet_curve_number(cn)), "q_wet"))


@query(
    "sc11_hybrid_fraction",
    PAIR + ", k AS (SELECT sum(abs(a)) / sum(abs(b)) AS k FROM img_pair) SELECT r, c, round(least(greatest(abs(a) + k * (abs(b) - abs(a)), 0), 1), 6) AS h FROM img_pair, k",
)
def sc11(t):
    k = t.img_pair.agg((F.sum(F.abs("a")) / F.sum(F.abs("b"))).alias("k")).first()["k"]
    return t.img_pair.select("r", "c", R(S.hybrid_fraction(F.abs("a"), F.abs("b"), F.abs("a"), F.lit(k)), "h"))


@query("sc12_growth_scenario", PAIR + " SELECT r, c, round(least(greatest(abs(a) + (abs(a) - abs(b)) * 0.625, 0), 1), 6) AS g FROM img_pair")
def sc12(t):
    return t.img_pair.select("r", "c", R(S.trend(F.abs("a"), F.abs("b"), 5 / 8), "g"))


@query("sc13_normalized_difference", "SELECT l_orderkey, l_linenumber, round((l_quantity - l_tax) / nullif(l_quantity + l_tax, 0), 6) AS nd FROM lineitem")
def sc13(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", R(S.normalized_difference(F.col("l_quantity"), F.col("l_tax")), "nd"))


_HAZ = "(0.45 * (1 - least(greatest((z - 1) / 18, 0), 1)) + 0.35 * (1 - least(c * 12.0 / 600, 1)) + 0.2 * ((r * 7 + c) % 10) / 10.0)"


@query("sc14_hazard_index", DEM + f" SELECT r, c, round({_HAZ}, 6) AS hazard, CASE WHEN {_HAZ} >= 0.55 THEN 3 WHEN {_HAZ} >= 0.35 THEN 2 ELSE 1 END AS tier FROM dem")
def sc14(t):
    h = S.hazard_index(F.col("z"), F.lit(1.0), F.col("c") * 12.0, F.pmod(F.col("r") * 7 + F.col("c"), F.lit(10)) / 10.0)
    return t.dem.select("r", "c", R(h, "hazard"), S.hazard_tier(h).alias("tier"))


@query("sc15_growth_risk", DEM + " SELECT r, c, CASE WHEN NOT z > 20 THEN 0 WHEN z <= 30 AND c < 15 THEN 3 WHEN (z <= 30) <> (c < 15) THEN 2 ELSE 1 END AS risk FROM dem")
def sc15(t):
    return t.dem.select("r", "c", S.growth_risk(F.col("z") > 20, F.col("z") <= 30, F.col("c") < 15).alias("risk"))


@query("sc16_impact_class", DEM + " SELECT r, c, CASE WHEN z >= 30 AND c >= 25 THEN 3 WHEN c >= 25 THEN 2 WHEN z >= 30 THEN 1 ELSE 0 END AS impact FROM dem")
def sc16(t):
    return t.dem.select("r", "c", S.impact_class(F.col("z") >= 30, F.col("c") >= 25).alias("impact"))


_P = "least(greatest(s, 1e-6), 1 - 1e-6)"


@query("sc17_logit_prior", sql_with("scored") + f" SELECT l_orderkey, l_linenumber, round(ln({_P} / (1 - {_P})), 6) AS logit, round({_P} * 0.05 / ({_P} * 0.05 + (1 - {_P}) * 0.95), 6) AS corrected FROM scored")
def sc17(t):
    return t.scored.select("l_orderkey", "l_linenumber", R(S.logit(F.col("s")), "logit"), R(S.prior_corrected(F.col("s"), 0.05), "corrected"))


@query("sc18_digitise", DEM + " SELECT r, c, 1 + (z >= 10)::INT + (z >= 20)::INT + (z >= 30)::INT + (z >= 40)::INT AS class FROM dem")
def sc18(t):
    return t.dem.select("r", "c", S.digitise(F.col("z"), [10, 20, 30, 40]).alias("class"))


@query("sc19_quintile", sql_with("scored") + " SELECT l_orderkey, l_linenumber, least(floor(s * 100 / 20), 4)::INT AS q FROM scored")
def sc19(t):
    return t.scored.select("l_orderkey", "l_linenumber", S.quintile(F.col("s") * 100).alias("q"))


@query("sc20_pixel_centre", DEM + " SELECT r, c, round(76.1 + (c + 0.5) * 0.00027, 8) AS lon, round(10.5 - (r + 0.5) * 0.00027, 8) AS lat, r::BIGINT * 50 + c AS idx FROM dem")
def sc20(t):
    return t.dem.select("r", "c", R(S.pixel_lon(F.col("c"), 76.1, 0.00027), "lon", 8), R(S.pixel_lat(F.col("r"), 10.5, -0.00027), "lat", 8), S.flat_index(F.col("r"), F.col("c"), 50).alias("idx"))


@query("sc21_utm")
def sc21(t):
    x, y = S.utm(S.pixel_lon(F.col("c"), 76.1, 0.01), S.pixel_lat(F.col("r"), 10.5, -0.01), 43)
    return t.dem.select("r", "c", R(x, "x", 3), R(y, "y", 3))


@query(
    "sc22_tile_index",
    DEM + " SELECT r, c, floor((76.1 + c * 0.01 + 180) / 360 * 16384)::INT AS tx, floor((1 - asinh(tan(radians(10.5 - r * 0.01))) / pi()) / 2 * 16384)::INT AS ty FROM dem",
)
def sc22(t):
    x, y = S.web_mercator_tile(F.col("c") * 0.01 + 76.1, F.lit(10.5) - F.col("r") * 0.01, 14)
    return t.dem.select("r", "c", x.alias("tx"), y.alias("ty"))


@query("sc23_block_id", "SELECT c_custkey, floor(c_custkey / 500.0)::BIGINT || '_' || floor(c_acctbal / 1000)::BIGINT AS block FROM customer")
def sc23(t):
    return t.customer.select("c_custkey", S.block_id(F.col("c_custkey"), F.col("c_acctbal"), 1).alias("_"), F.concat_ws("_", F.floor(F.col("c_custkey") / 500).cast("string"), F.floor(F.col("c_acctbal") / 1000).cast("string")).alias("block")).drop("_")


@query("sc24_f_quantile")
def sc24(t):
    """Limits of the change test for each class of the image: degrees of freedom from the class's looks in 5 x 5 cells."""
    looks = t.img_pair.groupBy("ref").agg((F.pow(F.avg(F.col("a") + 1), F.lit(2.0)) / F.var_pop(F.col("a") + 1)).alias("looks"))
    limits = F.udf(lambda d: (S.f_quantile(1 - 1e-3, d, d), S.f_quantile(1e-3, d, d)), "upper double, lower double")  # a row a class
    return looks.select("ref", (F.col("looks") * 50.0).alias("dof")).withColumn("q", limits("dof")).select("ref", R("dof", "dof"), R("q.upper", "upper"), R("q.lower", "lower"))


@query("sc25_ratio", PAIR + " SELECT r, c, round(abs(a) / greatest(abs(b), 1e-6), 4) AS ratio FROM img_pair")
def sc25(t):
    return t.img_pair.select("r", "c", R(F.try_divide(F.abs("a"), F.greatest(F.abs("b"), F.lit(1e-6))), "ratio", 4))


@query(
    "sc26_strings",
    "SELECT p_partkey, substr(p_name, 1, 4) AS head, split_part(p_type, ' ', 1) AS first_word, replace(p_brand, '#', '-') AS brand, p_brand || '/' || p_type AS joined FROM part",
)
def sc26(t):
    return t.part.select("p_partkey", F.substring("p_name", 1, 4).alias("head"), F.split_part("p_type", F.lit(" "), F.lit(1)).alias("first_word"), F.replace("p_brand", F.lit("#"), F.lit("-")).alias("brand"), F.concat_ws("/", "p_brand", "p_type").alias("joined"))


@query(
    "sc27_dates",
    "SELECT o_orderkey, strftime(o_orderdate, '%d-%m-%Y') AS text, strptime(strftime(o_orderdate, '%d-%m-%Y'), '%d-%m-%Y')::DATE AS back, date_diff('day', DATE '1995-01-01', o_orderdate::DATE) AS days, (o_orderdate::DATE + 5)::DATE AS plus5, year(o_orderdate)::INT AS y, month(o_orderdate)::INT AS m, strftime(o_orderdate, '%Y-%m') AS ym FROM orders",
)
def sc27(t):
    d = F.to_date("o_orderdate")
    text = F.date_format("o_orderdate", "dd-MM-yyyy")
    return t.orders.select("o_orderkey", text.alias("text"), F.to_date(text, "dd-MM-yyyy").alias("back"), F.datediff(d, F.lit("1995-01-01").cast("date")).cast("long").alias("days"), F.date_add(d, 5).alias("plus5"), F.year(d).alias("y"), F.month(d).alias("m"), F.date_format(d, "yyyy-MM").alias("ym"))


@query(
    "sc28_math",
    PAIR + " SELECT r, c, round(abs(a), 6) AS ab, round(sqrt(abs(a)), 6) AS sq, round(sqrt(a*a+b*b), 6) AS hy, round(ln(1+abs(a)), 6) AS lg, round(exp(b), 6) AS ex, floor(a * 10)::BIGINT AS fl, ceil(b * 10)::BIGINT AS ce, round(greatest(a, b), 6) AS mx, round(least(a, b), 6) AS mn FROM img_pair",
)
def sc28(t):
    a, b = F.col("a"), F.col("b")
    return t.img_pair.select("r", "c", R(F.abs(a), "ab"), R(F.sqrt(F.abs(a)), "sq"), R(F.hypot(a, b), "hy"), R(F.log1p(F.abs(a)), "lg"), R(F.exp(b), "ex"), F.floor(a * 10).alias("fl"), F.ceil(b * 10).alias("ce"), R(F.greatest(a, b), "mx"), R(F.least(a, b), "mn"))


@query("sc29_arrays", "SELECT vec_id, len(embedding)::INT AS n, round(list_sum(embedding[1:8]::DOUBLE[]), 5) AS head_sum, round(list_min(embedding)::DOUBLE, 6) AS mn, round(list_max(list_transform(embedding, lambda x: x::DOUBLE * 2)), 5) AS mx2 FROM embeddings")
def sc29(t):
    e = F.col("embedding")
    total = F.aggregate(F.slice(e, 1, 8), F.lit(0.0), lambda s, x: s + x.cast("double"))
    return t.embeddings.select("vec_id", F.size(e).alias("n"), R(total, "head_sum", 5), R(F.array_min(e).cast("double"), "mn"), R(F.array_max(F.transform(e, lambda x: x.cast("double") * 2)), "mx2", 5))


@query("sc30_maps", "SELECT n_regionkey, (array_agg(n_name ORDER BY n_nationkey))[1] AS first_nation, count(*)::INT AS n FROM nation GROUP BY 1")
def sc30(t):
    pairs = F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name")))
    m = t.nation.groupBy("n_regionkey").agg(F.map_from_entries(pairs).alias("m"), F.min("n_nationkey").alias("k"))
    return m.select("n_regionkey", F.element_at("m", F.col("k")).alias("first_nation"), F.size("m").alias("n"))


@query("sc31_json", "SELECT event_id, (json_extract(props, '$.k'))::INT AS k, '{\"id\":' || event_id || '}' AS dumped FROM events")
def sc31(t):
    parsed = F.from_json("props", "k int")
    return t.events.select("event_id", parsed["k"].alias("k"), F.to_json(F.struct(F.col("event_id").alias("id"))).alias("dumped"))


@query("sc32_quantise", DEM + " SELECT r, c, round_even(z / 51.0 * 200, 0)::INT AS q, round(round_even(z / 51.0 * 200, 0) / 200.0, 6) AS back FROM dem")
def sc32(t):
    q = S.quantise(F.col("z") / 51.0)
    return t.dem.select("r", "c", q.alias("q"), R(S.dequantise(q), "back"))


@query("sc33_log_heavy_tail", "SELECT o_orderkey, round(log10(greatest(o_totalprice, 1)), 6) AS lg FROM orders")
def sc33(t):
    return t.orders.select("o_orderkey", R(F.log10(F.greatest("o_totalprice", F.lit(1.0))), "lg"))


@query(
    "sc34_unit_detection",
    "WITH s AS (SELECT min(l_tax) >= 0 AND quantile_cont(l_tax, 0.5) < 1 AS linear FROM lineitem) SELECT l_orderkey, l_linenumber, round(CASE WHEN linear THEN 10 * log10(greatest(l_tax, 1e-10)) ELSE l_tax END, 6) AS db FROM lineitem, s",
)
def sc34(t):
    from ..operators.focal import ensure_db

    return ensure_db(t.lineitem.select("l_orderkey", "l_linenumber", F.col("l_tax").alias("db")), "db").withColumn("db", F.round("db", 6))


# projections and predicates ---------------------------------------------------------------------------------


@query("pf01_mask_algebra", PAIR + " SELECT r, c, a < 0 AND ref AS both_, a < 0 OR ref AS any_, NOT ref AS no_, (a < 0) <> ref AS one_ FROM img_pair")
def pf01(t):
    m, ref = F.col("a") < 0, F.col("ref")
    return t.img_pair.select("r", "c", (m & ref).alias("both_"), (m | ref).alias("any_"), (~ref).alias("no_"), (m != ref).alias("one_"))


@query("pf02_conditional_map", PAIR + " SELECT r, c, CASE WHEN a < -0.1 THEN 2 WHEN a < 0 THEN 1 ELSE 0 END AS class FROM img_pair")
def pf02(t):
    return t.img_pair.select("r", "c", F.when(F.col("a") < -0.1, 2).when(F.col("a") < 0, 1).otherwise(0).alias("class"))


@query("pf03_masked_assignment", PAIR + " SELECT r, c, round(CASE WHEN ref THEN -1 ELSE a END, 6) AS a FROM img_pair")
def pf03(t):
    return t.img_pair.select("r", "c", R(F.when(F.col("ref"), F.lit(-1.0)).otherwise(F.col("a")), "a"))


@query("pf04_isin", "SELECT event_id, event_type FROM events WHERE event_type IN ('view', 'purchase')")
def pf04(t):
    return t.events.where(F.col("event_type").isin("view", "purchase")).select("event_id", "event_type")


@query("pf05_between", "SELECT p_partkey, p_size FROM part WHERE p_size BETWEEN 10 AND 20")
def pf05(t):
    return t.part.where(F.col("p_size").between(10, 20)).select("p_partkey", "p_size")


@query("pf06_prefix", "SELECT p_partkey, p_brand FROM part WHERE starts_with(p_brand, 'Brand#1')")
def pf06(t):
    return t.part.where(F.col("p_brand").startswith("Brand#1")).select("p_partkey", "p_brand")


@query("pf07_attribute_threshold", "SELECT p_partkey FROM part WHERE p_size >= 40")
def pf07(t):
    return t.part.where("p_size >= 40").select("p_partkey")


@query("pf08_box", DEM + " SELECT r, c, z FROM dem WHERE c BETWEEN 10 AND 20 AND r BETWEEN 1 AND 30")
def pf08(t):
    return t.dem.where(F.col("c").between(10, 20) & F.col("r").between(1, 30))


@query("pf09_box_window", DEM + " SELECT r, c, z FROM dem WHERE r >= floor((10.5 - 10.498) / 0.00027) AND r < ceil((10.5 - 10.496) / 0.00027) AND c >= floor((76.103 - 76.1) / 0.00027) AND c < ceil((76.106 - 76.1) / 0.00027)")
def pf09(t):
    from ..operators.grid import GridSpec

    return GridSpec(76.1, 10.5, 0.00027, -0.00027).window(t.dem, 76.103, 10.496, 76.106, 10.498)


@query("pf10_ring", DEM + " SELECT r, c, CASE WHEN (r - 10) ** 2 + (c - 25) ** 2 <= 9 THEN 'near' ELSE 'far' END AS ring FROM dem WHERE (r - 10) ** 2 + (c - 25) ** 2 <= 64")
def pf10(t):
    d = F.hypot(F.col("r") - 10, F.col("c") - 25)
    return t.dem.where(d <= 8).select("r", "c", F.when(d <= 3, "near").otherwise("far").alias("ring"))


@query("pf11_columns", "SELECT s_suppkey AS id, s_name AS name, 1 AS kind FROM supplier")
def pf11(t):
    return t.supplier.drop("s_nationkey", "s_acctbal").withColumnsRenamed({"s_suppkey": "id", "s_name": "name"}).withColumn("kind", F.lit(1))


@query("pf12_columns_by_prefix", "SELECT l_linenumber, l_linestatus FROM lineitem")
def pf12(t):
    return t.lineitem.select([c for c in t.lineitem.columns if c.startswith("l_line")])


@query("pf13_clip", PAIR + " SELECT r, c, round(least(greatest(a, -0.1), 0.1), 6) AS a FROM img_pair")
def pf13(t):
    return t.img_pair.select("r", "c", R(S.clip(F.col("a"), -0.1, 0.1), "a"))


@query("pf14_finite", "SELECT p_partkey, CASE WHEN p_size % 5 <> 0 THEN p_size::DOUBLE END AS v FROM part WHERE p_size % 7 <> 0")
def pf14(t):
    raw = F.when(F.col("p_size") % 7 == 0, F.lit(float("nan"))).otherwise(F.col("p_size").cast("double"))
    return t.part.select("p_partkey", raw.alias("v")).where(S.finite(F.col("v"))).withColumn("v", F.when(F.pmod("v", F.lit(5.0)) != 0, F.col("v")))


@query("pf15_first_match", """WITH ev AS (SELECT event_id, ts::DATE - 3 AS s, ts::DATE + 3 AS e FROM events WHERE event_type = 'purchase'), q AS (SELECT DISTINCT ts::DATE AS d FROM events WHERE event_type = 'error')
SELECT d, min(event_id) AS first_event FROM q JOIN ev ON d BETWEEN s AND e GROUP BY d""")
def pf15(t):
    from ..operators.joins import interval_join

    day = F.to_date("ts")
    ev = t.events.where("event_type = 'purchase'").select("event_id", F.date_sub(day, 3).alias("s"), F.date_add(day, 3).alias("e"))
    q = t.events.where("event_type = 'error'").select(day.alias("d")).distinct()
    return interval_join(q, ev, "d", "s", "e", days=8).groupBy("d").agg(F.min("event_id").alias("first_event"))


@query("pf16_percentile_threshold", "SELECT p_partkey, p_size FROM part WHERE p_size <= (SELECT quantile_cont(p_size, 0.3) FROM part)")
def pf16(t):
    cut = ranking.quantiles(t.part, "p_size", [0.3])[0]
    return t.part.where(F.col("p_size") <= cut).select("p_partkey", "p_size")
