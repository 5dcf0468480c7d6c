"""Joins (JN): by position, key, time, interval and distance."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import joins, ranking
from ..operators.lineage import cut
from .registry import query, sql_with

R = lambda c, n, d=6: F.round(c, d).alias(n)
DEM, PAIR = sql_with("dem"), sql_with("img_pair")

# supplier and customer as points; a town list of the nations
_PTS = "WITH s AS (SELECT s_suppkey AS sid, s_suppkey * 7 % 101 * 1.0 AS x, s_acctbal / 100 AS y FROM supplier), q AS (SELECT c_custkey AS qid, c_custkey * 3 % 101 * 1.0 AS x, c_acctbal / 100 AS y FROM customer)"


def _pts(t):
    s = t.supplier.select(F.col("s_suppkey").alias("sid"), (F.pmod(F.col("s_suppkey") * 7, F.lit(101)) * 1.0).alias("x"), (F.col("s_acctbal") / 100).alias("y"))
    q = t.customer.select(F.col("c_custkey").alias("qid"), (F.pmod(F.col("c_custkey") * 3, F.lit(101)) * 1.0).alias("x"), (F.col("c_acctbal") / 100).alias("y"))
    return s, q


@query("jn01_raster_overlay", PAIR + ", img AS (SELECT vec_id::INT AS r, unnest(range(len(embedding)))::INT AS c, unnest(embedding)::DOUBLE AS v FROM embeddings) SELECT p.r, p.c, round(p.b - i.v, 6) AS d FROM img_pair p JOIN img i ON p.r = i.r AND p.c = i.c")
def jn01(t):
    return t.img_pair.join(t.img, ["r", "c"]).select("r", "c", R(F.col("b") - F.col("v"), "d"))


@query("jn02_gather", DEM + " SELECT l_orderkey, l_linenumber, l_quantity, z FROM lineitem JOIN dem ON r = floor((l_partkey % 2000) / 50) AND c = (l_partkey % 2000) % 50")
def jn02(t):
    k = F.pmod("l_partkey", F.lit(2000))
    at = t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity", F.floor(k / 50).cast("int").alias("r"), F.pmod(k, F.lit(50)).cast("int").alias("c"))
    return at.join(t.dem, ["r", "c"]).drop("r", "c")


@query("jn03_lookup", "SELECT c_custkey, n_name FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey AND n_nationkey < 20")
def jn03(t):
    dim = t.nation.where("n_nationkey < 20").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return t.customer.join(dim, "c_nationkey", "left").select("c_custkey", "n_name")


@query("jn04_row_geometry", DEM + " SELECT r, c, round(z * cos(radians(10.5 - (r + 0.5) * 0.00027)), 6) AS zc FROM dem")
def jn04(t):
    return t.dem.select("r", "c", R(F.col("z") * F.cos(F.radians(S.pixel_lat(F.col("r"), 10.5, -0.00027))), "zc"))


@query("jn05_save_first", "SELECT c_custkey, (SELECT min(s_suppkey) FROM supplier WHERE s_nationkey = c_nationkey) AS first_supplier FROM customer WHERE c_nationkey IN (SELECT s_nationkey FROM supplier)")
def jn05(t):
    first = t.supplier.groupBy(F.col("s_nationkey").alias("c_nationkey")).agg(F.min("s_suppkey").alias("first_supplier"))
    return t.customer.join(first, "c_nationkey").select("c_custkey", "first_supplier")


_ASOF = "WITH f AS (SELECT event_id, user_id, ts::DATE AS d FROM events WHERE event_type = 'purchase'), y AS (SELECT event_id AS dry_id, user_id, ts::DATE AS dd FROM events WHERE event_type = 'view'), k AS (SELECT f.event_id, y.dry_id, row_number() OVER (PARTITION BY f.event_id ORDER BY abs(date_diff('day', dd, d)), dry_id) AS nth FROM f JOIN y USING (user_id)) "


def _acquisitions(t):
    flood = t.events.where("event_type = 'purchase'").select("event_id", "user_id", F.to_date("ts").alias("d"))
    dry = t.events.where("event_type = 'view'").select(F.col("event_id").alias("dry_id"), "user_id", F.to_date("ts").alias("dd"))
    return flood, dry


@query("jn06_nearest_in_time", _ASOF + "SELECT f.event_id, k.dry_id FROM f LEFT JOIN k ON k.event_id = f.event_id AND nth = 1")
def jn06(t):
    flood, dry = _acquisitions(t)
    return joins.asof_nearest(flood, dry, ["user_id"], "d", "dd", ["dry_id"], ["dry_id"]).select("event_id", "dry_id")


@query(
    "jn07_cascaded_match",
    "WITH f AS (SELECT event_id, user_id, user_id % 7 AS grp, ts::DATE AS d FROM events WHERE event_type = 'signup'), y AS (SELECT event_id AS dry_id, user_id, user_id % 7 AS grp, ts::DATE AS dd FROM events WHERE event_type = 'purchase'), "
    "k AS (SELECT f.event_id, dry_id, CASE WHEN f.user_id = y.user_id THEN 1 WHEN f.grp = y.grp THEN 2 ELSE 3 END AS level, row_number() OVER (PARTITION BY f.event_id ORDER BY CASE WHEN f.user_id = y.user_id THEN 1 WHEN f.grp = y.grp THEN 2 ELSE 3 END, abs(date_diff('day', dd, d)), dry_id) AS nth FROM f, y) SELECT event_id, dry_id, level FROM k WHERE nth = 1",
)
def jn07(t):
    base = t.events.select("event_id", "user_id", F.pmod("user_id", F.lit(7)).alias("grp"), F.to_date("ts").alias("d"), "event_type")
    flood = base.where("event_type = 'signup'").drop("event_type")
    dry = base.where("event_type = 'purchase'").select(F.col("event_id").alias("dry_id"), "user_id", "grp", F.col("d").alias("dd"))
    return joins.cascaded_match(flood, dry, [["user_id"], ["grp"], []], "d", "dd", ["dry_id"], ["dry_id"]).select("event_id", "dry_id", "level")


@query("jn08_interval_join", "WITH w AS (SELECT event_id, ts::DATE - 2 AS s, ts::DATE + 5 AS e FROM events WHERE event_type = 'signup'), p AS (SELECT o_orderdate::DATE AS d, count(*) AS n FROM orders GROUP BY 1) SELECT event_id, sum(n)::BIGINT AS peaks FROM w JOIN p ON d BETWEEN s AND e GROUP BY 1")
def jn08(t):
    day = F.to_date("ts")
    w = t.events.where("event_type = 'signup'").select("event_id", F.date_sub(day, 2).alias("s"), F.date_add(day, 5).alias("e"))
    p = t.orders.groupBy(F.to_date("o_orderdate").alias("d")).agg(F.count("*").alias("n"))
    return joins.interval_join(p, w, "d", "s", "e", days=8).groupBy("event_id").agg(F.sum("n").alias("peaks"))


@query("jn09_date_membership", "WITH e AS (SELECT user_id, list_distinct(list(ts::DATE)) AS days FROM events WHERE event_type = 'error' GROUP BY 1), x AS (SELECT user_id, unnest(days) AS d FROM e) SELECT user_id, count(*) AS orders FROM x JOIN orders ON o_orderdate::DATE = d GROUP BY 1")
def jn09(t):
    e = t.events.where("event_type = 'error'").groupBy("user_id").agg(F.collect_set(F.to_date("ts")).alias("days"))
    days = e.select("user_id", F.explode("days").alias("d"))
    per_day = t.orders.groupBy(F.to_date("o_orderdate").alias("d")).agg(F.count("*").alias("n"))
    return days.join(per_day, "d").groupBy("user_id").agg(F.sum("n").alias("orders"))


_NEAR = _PTS + ", k AS (SELECT qid, sid, sqrt((q.x - s.x) ** 2 + (q.y - s.y) ** 2) AS d, row_number() OVER (PARTITION BY qid ORDER BY sqrt((q.x - s.x) ** 2 + (q.y - s.y) ** 2), sid) AS nth FROM q, s) "


@query("jn10_nearest_point", _NEAR + "SELECT qid, round(d, 6) AS dist FROM k WHERE nth = 1")
def jn10(t):
    s, q = _pts(t)
    return joins.nearest_points(q, s, "qid", "sid").select("qid", R(F.col("dist"), "dist"))


@query("jn11_second_neighbour", _PTS + ", k AS (SELECT a.sid, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) AS d, row_number() OVER (PARTITION BY a.sid ORDER BY sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2), b.sid) AS nth FROM s a JOIN s b ON a.sid <> b.sid) SELECT sid, nth::INT AS nth, round(d, 6) AS dist FROM k WHERE nth <= 2")
def jn11(t):
    s, _ = _pts(t)
    others = s.withColumnRenamed("sid", "other")
    return joins.nearest_points(s, others, "sid", "other", k=2, exclude=F.col("sid") == F.col("other")).select("sid", "nth", R(F.col("dist"), "dist"))


@query("jn12_min_distance", _NEAR + "SELECT round(min(d), 6) AS least, round(max(d), 6) AS most FROM k WHERE nth = 1")
def jn12(t):
    s, q = _pts(t)
    return joins.nearest_points(q, s, "qid", "sid").agg(R(F.min("dist"), "least"), R(F.max("dist"), "most"))


@query("jn13_nearest_town", _PTS + ", towns AS (SELECT n_nationkey AS tid, n_name, n_nationkey * 4.0 AS x, n_nationkey * 3.0 AS y FROM nation), k AS (SELECT qid, n_name, sqrt((q.x - t.x) ** 2 + (q.y - t.y) ** 2) AS d, row_number() OVER (PARTITION BY qid ORDER BY sqrt((q.x - t.x) ** 2 + (q.y - t.y) ** 2), tid) AS nth FROM q, towns t) SELECT qid, CASE WHEN d <= 5 THEN n_name ELSE 'none' END AS place FROM k WHERE nth = 1")
def jn13(t):
    _, q = _pts(t)
    towns = t.nation.select(F.col("n_nationkey").alias("tid"), "n_name", (F.col("n_nationkey") * 4.0).alias("x"), (F.col("n_nationkey") * 3.0).alias("y"))
    hit = joins.nearest_points(q, towns, "qid", "tid").join(towns.select("tid", "n_name"), "tid")
    return hit.select("qid", F.when(F.col("dist") <= 5, F.col("n_name")).otherwise("none").alias("place"))


@query("jn14_box_semi_join", _PTS + " SELECT qid FROM q WHERE x BETWEEN 20 AND 40 AND y BETWEEN 10 AND 60")
def jn14(t):
    _, q = _pts(t)
    return q.where(F.col("x").between(20, 40) & F.col("y").between(10, 60)).select("qid")


# polygons: a triangle a nation
_TRI = "WITH p AS (SELECT n_nationkey AS id, n_nationkey * 2 + 0.3 AS x1, n_nationkey + 0.2 AS y1, n_nationkey * 2 + 9.4 AS x2, n_nationkey + 2.7 AS y2, n_nationkey * 2 + 4.1 AS x3, n_nationkey + 8.8 AS y3 FROM nation), cells AS (SELECT r, c, r + 0.5 AS y, c + 0.5 AS x FROM range(40) a(r), range(70) b(c))"


def _triangles(t):
    k = F.col("n_nationkey")
    point = lambda dx, dy: F.struct((k * 2 + dx).cast("double").alias("x"), (k + dy).cast("double").alias("y"))
    return t.nation.select(k.alias("id"), F.array(point(0.3, 0.2), point(9.4, 2.7), point(4.1, 8.8)).alias("ring"))


@query(
    "jn15_rasterize",
    _TRI + """, s AS (SELECT id, r, c, (x2 - x1) * (y - y1) - (y2 - y1) * (x - x1) AS a, (x3 - x2) * (y - y2) - (y3 - y2) * (x - x2) AS b, (x1 - x3) * (y - y3) - (y1 - y3) * (x - x3) AS d FROM p, cells)
    SELECT id, r::INT AS r, c::INT AS c FROM s WHERE (a > 0 AND b > 0 AND d > 0) OR (a < 0 AND b < 0 AND d < 0)""",
)
def jn15(t):
    return joins.rasterize(_triangles(t), "id")


_PARTS = _TRI + ", g AS (SELECT id, 0 AS part, x1 AS a, y1 AS b, x2 AS c, y2 AS d FROM p UNION ALL SELECT id, 1, x2, y2, x3, y3 FROM p UNION ALL SELECT id, 2, x3, y3, x1, y1 FROM p), l AS (SELECT *, c - a AS dx, d - b AS dy FROM g)"


@query(
    "jn16_clip_segments",
    _PARTS + """, t AS (SELECT *, greatest(0, CASE WHEN dx > 0 THEN (10 - a) / dx ELSE 0 END, CASE WHEN dx < 0 THEN (30 - a) / dx ELSE 0 END, CASE WHEN dy > 0 THEN (5 - b) / dy ELSE 0 END, CASE WHEN dy < 0 THEN (15 - b) / dy ELSE 0 END) AS s,
    least(1, CASE WHEN dx < 0 THEN (10 - a) / dx ELSE 1 END, CASE WHEN dx > 0 THEN (30 - a) / dx ELSE 1 END, CASE WHEN dy < 0 THEN (5 - b) / dy ELSE 1 END, CASE WHEN dy > 0 THEN (15 - b) / dy ELSE 1 END) AS e FROM l WHERE NOT (dx = 0 AND a NOT BETWEEN 10 AND 30) AND NOT (dy = 0 AND b NOT BETWEEN 5 AND 15))
    SELECT id, part, round(a + s * dx, 6) AS x1, round(b + s * dy, 6) AS y1, round(a + e * dx, 6) AS x2, round(b + e * dy, 6) AS y2 FROM t WHERE s < e""",
)
def jn16(t):
    rings = _triangles(t).withColumn("pts", F.concat("ring", F.slice("ring", 1, 1)))
    cut = joins.clip_segments(joins.segments(rings, "id"), 10, 5, 30, 15)
    return cut.select("id", "part", *[R(F.col(c), c) for c in ("x1", "y1", "x2", "y2")])


_SEG = _TRI + ", g AS (SELECT id, x1 AS a, y1 AS b, x2 AS c, y2 AS d FROM p UNION ALL SELECT id, x2, y2, x3, y3 FROM p UNION ALL SELECT id, x3, y3, x1, y1 FROM p)"
_DIST = _SEG + ", q AS (SELECT c_custkey AS qid, c_custkey * 3 % 101 * 1.0 AS x, c_acctbal / 100 AS y FROM customer), k AS (SELECT qid, x, y, a, b, c, d, least(greatest(((x - a) * (c - a) + (y - b) * (d - b)) / ((c - a) ** 2 + (d - b) ** 2), 0), 1) AS t FROM q, g) SELECT qid, round(min(sqrt((x - a - t * (c - a)) ** 2 + (y - b - t * (d - b)) ** 2)), 6) AS dist FROM k GROUP BY 1"


@query("jn17_exact_line_distance", _DIST)
def jn17(t):
    rings = _triangles(t).withColumn("pts", F.concat("ring", F.slice("ring", 1, 1)))
    segs = joins.segments(rings, "id")
    _, q = _pts(t)
    return joins.line_distance(q, segs, "qid").select("qid", R(F.col("dist"), "dist"))


@query("jn18_neighbour_sums", DEM + " SELECT a.r, a.c, count(*) AS n, sum(b.z) AS total FROM dem a JOIN dem b ON abs(a.r - b.r) <= 1 AND abs(a.c - b.c) <= 1 AND NOT (a.r = b.r AND a.c = b.c) GROUP BY 1, 2")
def jn18(t):
    from ..operators.components import neighbours

    return neighbours(t.dem).groupBy("r", "c").agg(F.count("*").alias("n"), F.sum("z2").alias("total"))


@query("jn19_anti_join", "SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 48)")
def jn19(t):
    hit = t.lineitem.where("l_quantity > 48").select(F.col("l_partkey").alias("p_partkey"))
    return t.part.join(hit, "p_partkey", "left_anti").select("p_partkey")


@query("jn20_tree_closure", sql_with("topo", recursive=True) + ", up AS (SELECT id FROM topo WHERE id = 5 UNION ALL SELECT t.id FROM topo t JOIN up ON t.next_down = up.id WHERE t.id <> t.next_down) SELECT id FROM up")
def jn20(t):
    return joins.upstream(t.topo, t.topo.where("id = 5"))


@query("jn21_scenario_product", "SELECT r_name, k::INT AS pct, round(r_regionkey * k / 100.0, 6) AS v FROM region, (VALUES (2), (5), (10)) AS x(k)")
def jn21(t):
    return t.region.withColumn("pct", F.explode(F.array(F.lit(2), F.lit(5), F.lit(10)))).select("r_name", "pct", R(F.col("r_regionkey") * F.col("pct") / 100.0, "v"))


@query("jn22_paired_scores", "SELECT l_suppkey, round(avg(l_quantity / 50 - l_discount * 10), 6) AS gap FROM lineitem GROUP BY 1")
def jn22(t):
    return t.lineitem.groupBy("l_suppkey").agg(R(F.avg(F.col("l_quantity") / 50 - F.col("l_discount") * 10), "gap"))


@query("jn23_distance_distribution", _NEAR + "SELECT round(quantile_cont(d, 0.5), 6) AS median, round(quantile_cont(d, 0.75), 6) AS p75, round(quantile_cont(d, 0.9), 6) AS p90, round(avg((d <= 2)::INT), 6) AS within_2 FROM k WHERE nth = 1")
def jn23(t):
    s, q = _pts(t)
    near = cut(joins.nearest_points(q, s, "qid", "sid"))
    found = zip(("median", "p75", "p90"), ranking.quantiles(near, "dist", [0.5, 0.75, 0.9]))
    return near.agg(R(F.avg((F.col("dist") <= 2).cast("int")), "within_2")).select(*[R(F.lit(x), n) for n, x in found], "within_2")


@query("jn24_segments", _TRI + " SELECT id, 0 AS part, x1, y1, x2, y2 FROM p UNION ALL SELECT id, 1, x2, y2, x3, y3 FROM p UNION ALL SELECT id, 2, x3, y3, x1, y1 FROM p")
def jn24(t):
    return joins.segments(_triangles(t).withColumn("pts", F.concat("ring", F.slice("ring", 1, 1))), "id").select("id", "part", *[F.round(c, 6).alias(c) for c in ("x1", "y1", "x2", "y2")])


_LEN = "sqrt((x2-x1)**2 + (y2-y1)**2) + sqrt((x3-x2)**2 + (y3-y2)**2) + sqrt((x1-x3)**2 + (y1-y3)**2)"


@query("jn25_detail_filter", _TRI + f" SELECT id, round(3 / ({_LEN}), 6) AS vertices_per_unit FROM p WHERE 3 / ({_LEN}) >= 0.1")
def jn25(t):
    tri = _triangles(t)
    outline = joins.segments(tri.withColumn("pts", F.concat("ring", F.slice("ring", 1, 1))), "id").groupBy("id").agg(F.sum(F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))).alias("len"))
    detail = tri.select("id", F.size("ring").alias("n")).join(outline, "id").select("id", (F.col("n") / F.col("len")).alias("d"))
    return detail.where("d >= 0.1").select("id", R(F.col("d"), "vertices_per_unit"))


@query("jn26_total_length", _TRI + f" SELECT round(sum({_LEN}), 6) AS total FROM p")
def jn26(t):
    segs = joins.segments(_triangles(t).withColumn("pts", F.concat("ring", F.slice("ring", 1, 1))), "id")
    return segs.agg(R(F.sum(F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))), "total"))


@query(
    "jn27_length_in_buffer",
    _SEG + ", k AS (SELECT id, (c - a) ** 2 + (d - b) ** 2 AS q2, 2 * ((a - 25) * (c - a) + (b - 12) * (d - b)) AS q1, (a - 25) ** 2 + (b - 12) ** 2 - 64 AS q0 FROM g), s AS (SELECT *, q1 * q1 - 4 * q2 * q0 AS disc FROM k) SELECT id, round(sum(CASE WHEN disc > 0 THEN greatest(least((-q1 + sqrt(greatest(disc, 0))) / (2 * q2), 1) - greatest((-q1 - sqrt(greatest(disc, 0))) / (2 * q2), 0), 0) * sqrt(q2) ELSE 0 END), 6) AS len FROM s GROUP BY 1",
)
def jn27(t):
    """Length of lines within a circle, by the closed form for a segment and a circle."""
    from ..operators.density import length_in_circle

    segs = joins.segments(_triangles(t).withColumn("pts", F.concat("ring", F.slice("ring", 1, 1))), "id")
    return segs.groupBy("id").agg(R(F.sum(length_in_circle(F.lit(25.0), F.lit(12.0), 8.0)), "len"))
