"""Focal, zonal and resampling operators (RF) and curvature (SC08)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import density, focal, grid, joins, ranking, resample
from .registry import query, sql_with

R = lambda c, n=None, d=6: F.round(c, d).alias(n or c)
DEM, IMG, PAIR = (sql_with(x) for x in ("dem", "img", "img_pair"))
# z1 ... z9 with odd reflection, columns first, then rows
_NB = """, w AS (SELECT r, c, z, coalesce(lag(z) OVER x, 2 * z - lead(z) OVER x) AS w_, coalesce(lead(z) OVER x, 2 * z - lag(z) OVER x) AS e_ FROM dem WINDOW x AS (PARTITION BY r ORDER BY c)),
nb AS (SELECT r, c, """ + ", ".join(
    f"coalesce({f}({v}) OVER y, 2 * {v} - {g}({v}) OVER y) AS z{k}" for k, v, f, g in ((1, "w_", "lag", "lead"), (2, "z", "lag", "lead"), (3, "e_", "lag", "lead"), (7, "w_", "lead", "lag"), (8, "z", "lead", "lag"), (9, "e_", "lead", "lag"))
) + ", w_ AS z4, z AS z5, e_ AS z6 FROM w WINDOW y AS (PARTITION BY c ORDER BY r)), pq AS (SELECT r, c, z5 AS z, (z3 + 2*z6 + z9 - z1 - 2*z4 - z7) / 240.0 AS p, (z1 + 2*z2 + z3 - z7 - 2*z8 - z9) / 240.0 AS q FROM nb)"


@query("rf01_neighbourhood", DEM + _NB + " SELECT r, c, " + ", ".join(f"round(z{k}, 6) AS z{k}" for k in range(1, 10)) + " FROM nb")
def rf01(t):
    return focal.neighbourhood(t.dem).select("r", "c", *[R(f"z{k}") for k in range(1, 10)])


@query("rf02_gradient", DEM + _NB + " SELECT r, c, round(p, 6) AS p, round(q, 6) AS q FROM pq")
def rf02(t):
    return focal.gradient(t.dem, 30.0, 30.0).select("r", "c", R("p"), R("q"))


@query("rf03_slope_aspect", DEM + _NB + " SELECT r, c, round(degrees(atan(sqrt(p*p + q*q))), 5) AS slope, round(CASE WHEN p = 0 AND q = 0 THEN -1 ELSE ((degrees(atan2(-p, -q)) % 360) + 360) % 360 END, 4) AS aspect FROM pq")
def rf03(t):
    g = focal.gradient(t.dem, 30.0, 30.0)
    return g.select("r", "c", R(S.slope_deg(F.col("p"), F.col("q")), "slope", 5), R(S.aspect_deg(F.col("p"), F.col("q")), "aspect", 4))


_DEF = "((z4 + z6) / 2 - z5) / 900.0 AS d, ((z2 + z8) / 2 - z5) / 900.0 AS e, (-z1 + z3 + z7 - z9) / 3600.0 AS f, (z6 - z4) / 60.0 AS g, (z2 - z8) / 60.0 AS h"


@query(
    "rf04_curvatures",
    DEM + _NB + f", k AS (SELECT r, c, {_DEF} FROM nb) SELECT r, c, round(-200 * (d + e), 5) AS general, round(CASE WHEN g*g + h*h > 0 THEN -200 * (d*h*h + e*g*g - f*g*h) / (g*g + h*h) ELSE 0 END, 5) AS plan, round(CASE WHEN g*g + h*h > 0 THEN -200 * (d*g*g + e*h*h + f*g*h) / (g*g + h*h) ELSE 0 END, 5) AS profile FROM k",
)
def rf04(t):
    return focal.curvatures(t.dem, 30.0, 30.0).select("r", "c", R("general", d=5), R("plan", d=5), R("profile", d=5))


@query("sc08_curvature_share", DEM + _NB + f", k AS (SELECT {_DEF} FROM nb) SELECT count(*) FILTER (WHERE -200 * (d + e) > 1e-9) AS convex, count(*) FILTER (WHERE -200 * (d + e) < -1e-9) AS concave FROM k")
def sc08(t):
    c = focal.curvatures(t.dem, 30.0, 30.0)
    return c.agg(F.count_if(F.col("general") > 1e-9).alias("convex"), F.count_if(F.col("general") < -1e-9).alias("concave"))


@query(
    "rf05_simple_gradient",
    DEM + """ SELECT r, c, round(CASE WHEN lag(z) OVER x IS NOT NULL AND lead(z) OVER x IS NOT NULL THEN (lead(z) OVER x - lag(z) OVER x) / 40.0 ELSE (coalesce(lead(z) OVER x, z) - coalesce(lag(z) OVER x, z)) / 20.0 END, 6) AS gx,
    round(CASE WHEN lag(z) OVER y IS NOT NULL AND lead(z) OVER y IS NOT NULL THEN (lead(z) OVER y - lag(z) OVER y) / 40.0 ELSE (coalesce(lead(z) OVER y, z) - coalesce(lag(z) OVER y, z)) / 20.0 END, 6) AS gy FROM dem WINDOW x AS (PARTITION BY r ORDER BY c), y AS (PARTITION BY c ORDER BY r)""",
)
def rf05(t):
    return focal.simple_gradient(t.dem, 20.0, 20.0).select("r", "c", R("gx"), R("gy"))


def _mirror_sql(source: str, value: str, k: int) -> str:
    """Box mean by mirrored indices: the edge cell repeats first."""
    def one(src: str, v: str, axis: str, other: str, out: str) -> str:
        m = f"(((a.{axis} + o.k) % (2 * n.n)) + 2 * n.n) % (2 * n.n)"
        return f"{out} AS (SELECT a.r, a.c, sum(b.{v}) / {2 * k + 1}.0 AS {v} FROM {src} a, range(-{k}, {k + 1}) o(k), (SELECT max({axis}) + 1 AS n FROM {src}) n, {src} b WHERE b.{other} = a.{other} AND b.{axis} = least({m}, 2 * n.n - 1 - {m}) GROUP BY 1, 2)"
    return one(source, value, "c", "r", f"{source}_{value}_x") + ", " + one(f"{source}_{value}_x", value, "r", "c", f"{source}_{value}_box")


@query("rf06_box_mean", DEM + ", " + _mirror_sql("dem", "z", 2) + " SELECT r, c, round(z, 6) AS z FROM dem_z_box")
def rf06(t):
    return focal.box_mean(t.dem, ["z"], 2).select("r", "c", R("z"))


@query(
    "rf07_lee_filter",
    DEM + ", sq AS (SELECT r, c, z * z AS z FROM dem), " + _mirror_sql("dem", "z", 2) + ", " + _mirror_sql("sq", "z", 2)
    + ", v AS (SELECT d.r, d.c, d.z, m.z AS m, greatest(s.z - m.z * m.z, 0) AS v FROM dem d JOIN dem_z_box m USING (r, c) JOIN sq_z_box s USING (r, c)) SELECT r, c, round(m + v / (v + (SELECT avg(v) FROM v)) * (z - m), 5) AS z FROM v",
)
def rf07(t):
    return focal.lee_filter(t.dem, "z", 2).select("r", "c", R("z", d=5))


@query(
    "rf08_median3",
    DEM + ", o AS (SELECT a.r, a.c, i.k AS i, j.k AS j, least(greatest(a.r + i.k, 0), m.r) AS rr, least(greatest(a.c + j.k, 0), m.c) AS cc FROM dem a, range(-1, 2) i(k), range(-1, 2) j(k), (SELECT max(r) AS r, max(c) AS c FROM dem) m) SELECT o.r, o.c, quantile_cont(b.z, 0.5) AS z FROM o JOIN dem b ON b.r = o.rr AND b.c = o.cc GROUP BY 1, 2",
)
def rf08(t):
    return focal.median3(t.dem, "z").select("r", "c", "z")


@query(
    "rf09_gaussian",
    DEM + """, w0 AS (SELECT i - 8 AS o, exp(-0.5 * ((i - 8) / 2.0) ** 2) AS w FROM range(17) x(i)), w AS (SELECT o, w / (SELECT sum(w) FROM w0) AS w FROM w0), m AS (SELECT max(r) + 1 AS n FROM dem),
    a0 AS (SELECT r, c, w, ((c + o) % 100 + 100) % 100 AS j FROM dem, w), a AS (SELECT a0.r, a0.c, sum(a0.w * dem.z) AS z FROM a0 JOIN dem ON dem.r = a0.r AND dem.c = least(j, 99 - j) GROUP BY 1, 2),
    b0 AS (SELECT r, c, w, n, ((r + o) % (2 * n) + 2 * n) % (2 * n) AS j FROM a, w, m) SELECT b0.r, b0.c, round(sum(b0.w * a.z), 6) AS z FROM b0 JOIN a ON a.c = b0.c AND a.r = least(j, 2 * n - 1 - j) GROUP BY 1, 2""",
)
def rf09(t):
    return focal.gaussian(t.dem, ["z"], 2.0).select("r", "c", R("z"))


@query("rf10_dilation", DEM + ", m AS (SELECT r, c FROM dem WHERE z > 48) SELECT d.r, d.c FROM dem d WHERE EXISTS (SELECT 1 FROM m WHERE abs(m.r - d.r) <= 2 AND abs(m.c - d.c) <= 2)")
def rf10(t):
    wide = focal.dilate(t.dem.where("z > 48").select("r", "c"), 2)
    return t.dem.select("r", "c").join(wide, ["r", "c"], "left_semi")


@query("rf11_closing", DEM + ", h AS (SELECT r, c, lead(c) OVER (PARTITION BY r ORDER BY c) AS nxt FROM dem WHERE z > 35) SELECT r, c::INT AS c FROM (SELECT r, unnest(range(c, CASE WHEN nxt - c <= 4 THEN nxt ELSE c + 1 END)) AS c FROM h)")
def rf11(t):
    from ..operators.timeseries import true_runs

    runs = true_runs(t.dem, ["r"], "c", F.col("z") > 35)
    return runs.select("r", F.explode(F.sequence("first", "last")).alias("c"))


@query("rf12_nearest_resample", DEM + " SELECT t.r, t.c, dem.z FROM dem t LEFT JOIN dem ON dem.r = floor((t.r + 0.5) / 1.5) AND dem.c = floor((t.c + 0.5) / 1.5)")
def rf12(t):
    return resample.nearest_resample(t.dem, t.dem.select("r", "c"), 1.5, ["z"])


@query("rf12_mode_resample", DEM + ", k AS (SELECT floor(r / 4)::INT AS r, floor(c / 4)::INT AS c, (z % 5)::INT AS v, count(*) AS n FROM dem GROUP BY 1, 2, 3), o AS (SELECT *, row_number() OVER (PARTITION BY r, c ORDER BY n DESC, v) AS nth FROM k) SELECT r, c, v FROM o WHERE nth = 1")
def rf12m(t):
    return resample.mode_resample(t.dem.select("r", "c", F.pmod("z", F.lit(5.0)).cast("int").alias("v")), 4, "v")


@query(
    "rf13_exact_fraction",
    DEM + ", s AS (SELECT 2 * r + i + 1 AS sr, 2 * c + j + 1 AS sc FROM dem, range(2) a(i), range(2) b(j) WHERE z > 25) SELECT floor(sr / 3)::INT AS r, floor(sc / 3)::INT AS c, round(count(*) / 9.0, 6) AS f FROM s GROUP BY 1, 2",
)
def rf13(t):
    return resample.fraction_three_in_two(t.dem, (F.col("z") > 25).cast("int")).select("r", "c", R("f"))


@query("rf14_valid_fraction", DEM + " SELECT floor(r / 3)::INT AS r, floor(c / 3)::INT AS c, round(sum((z > 25)::INT) FILTER (WHERE z % 7 <> 0) / count(*) FILTER (WHERE z % 7 <> 0), 6) AS f FROM dem GROUP BY 1, 2")
def rf14(t):
    ok = F.pmod("z", F.lit(7.0)) != 0
    return resample.block_stats(t.dem, 3, f=F.round(F.try_divide(F.sum(F.when(ok, (F.col("z") > 25).cast("int"))), F.count_if(ok)), 6))


@query(
    "rf15_bilinear",
    DEM + ", m AS (SELECT max(r) AS mr, max(c) AS mc FROM dem), p AS (SELECT s_suppkey, least(greatest(s_suppkey % 37 * 1.07 - 0.5, 0), mr) AS y, least(greatest(s_suppkey % 53 * 0.93 - 0.5, 0), mc) AS x, mr, mc FROM supplier, m), k AS (SELECT *, least(floor(y), mr - 1) AS r0, least(floor(x), mc - 1) AS c0 FROM p) "
    "SELECT s_suppkey, round(sum(dem.z * CASE WHEN dem.r = r0 THEN 1 - (y - r0) ELSE y - r0 END * CASE WHEN dem.c = c0 THEN 1 - (x - c0) ELSE x - c0 END), 5) AS z FROM k JOIN dem ON dem.r IN (r0, r0 + 1) AND dem.c IN (c0, c0 + 1) GROUP BY 1",
)
def rf15(t):
    size = t.dem.agg(F.max("r").alias("r"), F.max("c").alias("c")).first()
    pts = t.supplier.select("s_suppkey", (F.pmod("s_suppkey", F.lit(37)) * 1.07).alias("y"), (F.pmod("s_suppkey", F.lit(53)) * 0.93).alias("x"))
    return resample.bilinear(t.dem, pts, "z", size["r"] + 1, size["c"] + 1).select("s_suppkey", R("z", d=5))


@query(
    "rf16_nearest_fill",
    DEM + ", g AS (SELECT * FROM dem WHERE z % 3 <> 0), k AS (SELECT d.r, d.c, g.z, row_number() OVER (PARTITION BY d.r, d.c ORDER BY sqrt((d.r - g.r) ** 2 + (d.c - g.c) ** 2), g.r, g.c) AS nth FROM dem d JOIN g ON abs(d.r - g.r) <= 12 AND abs(d.c - g.c) <= 12) SELECT r, c, z FROM k WHERE nth = 1",
)
def rf16(t):
    return resample.fill_nearest(t.dem, "z", F.pmod("z", F.lit(3.0)) != 0).select("r", "c", "z")


#: The sides of the triangles of nations, and their lengths.
_SIDES = "WITH p AS (SELECT n_nationkey AS id, n_nationkey * 2 + 0.3 AS x1, n_nationkey + 0.2 AS y1, n_nationkey * 2 + 9.4 AS x2, n_nationkey + 2.7 AS y2, n_nationkey * 2 + 4.1 AS x3, n_nationkey + 8.8 AS y3 FROM nation), g AS (SELECT id, x1::DOUBLE AS a, y1::DOUBLE AS b, x2::DOUBLE AS c, y2::DOUBLE AS d FROM p UNION ALL SELECT id, x2, y2, x3, y3 FROM p UNION ALL SELECT id, x3, y3, x1, y1 FROM p), l AS (SELECT *, sqrt((c - a) ** 2 + (d - b) ** 2) AS len FROM g)"


@query(
    "rf17_line_density",
    _SIDES + """, q AS (SELECT *, greatest(ceil(len / 0.1), 1) AS n FROM l), s AS (SELECT floor(b + (d - b) * ((i + 0.5) / n))::INT AS r, floor(a + (c - a) * ((i + 0.5) / n))::INT AS c, sum(len / n) AS len FROM q, range(200) x(i) WHERE i < n GROUP BY 1, 2),
    o AS (SELECT i - 4 AS dr, j - 4 AS dc FROM range(9) a(i), range(9) b(j) WHERE (i - 4) ** 2 + (j - 4) ** 2 <= 16) SELECT (r + dr)::INT AS r, (c + dc)::INT AS c, round(sum(len) / (pi() * 16), 6) AS density FROM s, o GROUP BY 1, 2""",
)
def rf17(t):
    from .join_queries import _triangles

    segs = joins.segments(_triangles(t).withColumn("pts", F.concat("ring", F.slice("ring", 1, 1))), "id")
    return density.disk_density(density.lattice_lengths(segs, 1.0, 0.1), 4, 1.0).select("r", "c", R("density"))


@query(
    "rf18_distance_raster",
    _SIDES + ", dem AS (SELECT p_partkey AS cell, p_partkey % 50 + 0.5 AS x, floor(p_partkey / 50) + 0.5 AS y FROM part), q AS (SELECT *, greatest(ceil(len / 0.5), 1) AS n FROM l), t AS (SELECT DISTINCT a + (c - a) * i / n AS x, b + (d - b) * i / n AS y FROM q, range(60) z(i) WHERE i <= n) SELECT cell, round(min(sqrt((dem.x - t.x) ** 2 + (dem.y - t.y) ** 2)), 6) AS dist FROM dem, t GROUP BY 1",
)
def rf18(t):
    from .join_queries import _triangles

    segs = joins.segments(_triangles(t).withColumn("pts", F.concat("ring", F.slice("ring", 1, 1))), "id")
    pts = joins.densify(segs, "id", 0.5).select(F.concat_ws(",", F.col("x").cast("string"), F.col("y").cast("string")).alias("pid"), "x", "y").distinct()
    cells = t.dem.select((F.col("r") * 50 + F.col("c")).alias("cell"), (F.col("c") + 0.5).alias("x"), (F.col("r") + 0.5).alias("y"))
    return joins.nearest_points(cells, pts, "cell", "pid").select("cell", R("dist"))


@query("rf19_registration")
def rf19(t):
    from ..operators.registration import shift_between

    moved = t.dem.select((F.col("r") + 1).alias("r"), (F.col("c") + 2).alias("c"), "z")
    return shift_between(t.dem, moved, 64)


@query("rf20_invariant_bias", PAIR + " SELECT r, c, round(b - (SELECT quantile_cont(b - a, 0.5) FROM img_pair WHERE ref), 6) AS b FROM img_pair")
def rf20(t):
    bias = ranking.quantiles(t.img_pair.where("ref").select((F.col("b") - F.col("a")).alias("d")), "d", [0.5])[0]
    return t.img_pair.select("r", "c", R(F.col("b") - F.lit(bias), "b"))


@query("rf21_zonal_stats", DEM + " SELECT floor(c / 10)::INT AS zone, count(*) AS n, round(avg(z), 6) AS mean, min(z) AS lo, max(z) AS hi, round(quantile_cont(z, 0.9), 6) AS p90 FROM dem GROUP BY 1")
def rf21(t):
    return t.dem.groupBy(F.floor(F.col("c") / 10).cast("int").alias("zone")).agg(F.count("*").alias("n"), R(F.avg("z"), "mean"), F.min("z").alias("lo"), F.max("z").alias("hi"), R(F.percentile("z", 0.9), "p90"))


@query("rf22_edge_distance", DEM + ", m AS (SELECT max(r) + 1 AS h, max(c) + 1 AS w FROM dem) SELECT r, c, round(least(c + 0.5, w - c - 0.5, r + 0.5, h - r - 0.5), 6) AS d FROM dem, m")
def rf22(t):
    s = t.dem.agg((F.max("r") + 1).alias("h"), (F.max("c") + 1).alias("w")).first()
    y, x = F.col("r") + 0.5, F.col("c") + 0.5
    return t.dem.select("r", "c", R(F.least(x, F.lit(s["w"]) - x, y, F.lit(s["h"]) - y), "d"))


@query("rf23_extended_window", DEM + " SELECT r + 4 AS r, c + 7 AS c, z FROM dem WHERE r BETWEEN 2 AND 9")
def rf23(t):
    small, big = grid.GridSpec(76.1, 10.5, 0.01, -0.01), grid.GridSpec(76.03, 10.54, 0.01, -0.01)
    return grid.shift(t.dem.where(F.col("r").between(2, 9)), *big.offset_of(small))


@query("rf24_shadow_mask", DEM + ", m AS (SELECT r, c FROM dem WHERE z > 48) SELECT d.r, d.c FROM dem d WHERE EXISTS (SELECT 1 FROM m WHERE abs(m.r + 1 - d.r) <= 1 AND abs(m.c + 3 - d.c) <= 1)")
def rf24(t):
    shadow = focal.dilate(grid.shift(t.dem.where("z > 48"), 1, 3).select("r", "c"), 1)
    return t.dem.select("r", "c").join(shadow, ["r", "c"], "left_semi")
