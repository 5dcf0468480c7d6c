"""Patches, trees and flow on grids (GR)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import components as K
from ..operators import joins
from ..operators import routing as W
from .registry import WIDTH, query, sql_with

R = lambda c, n=None, d=6: F.round(c, d).alias(n or c)
DEM, TOPO = sql_with("dem", recursive=True), sql_with("topo", recursive=True)
#: Patches by walking from every cell; the patch is named by its least cell.
_PATCH = DEM + """, m AS MATERIALIZED (SELECT r, c, r * 50 + c AS i FROM dem WHERE z > 32), e AS MATERIALIZED (SELECT a.i AS a, b.i AS b FROM m a JOIN m b ON b.r BETWEEN a.r - 1 AND a.r + 1 AND b.c BETWEEN a.c - 1 AND a.c + 1 AND a.i <> b.i),
walk AS (SELECT i, i AS root FROM m UNION SELECT e.b, w.root FROM walk w JOIN e ON e.a = w.i WHERE w.root < e.b),
patch AS MATERIALIZED (SELECT m.r, m.c, (SELECT min(root) FROM walk WHERE walk.i = m.i) AS patch FROM m)"""


def _mask(t):
    return t.dem.where("z > 32").select("r", "c")


def _named(df):
    least = df.groupBy("patch").agg(F.min(F.col("r") * 50 + F.col("c")).alias("name"))
    return df.join(least, "patch").select("r", "c", F.col("name").alias("patch"))


@query("gr01_patches", _PATCH + " SELECT r, c, patch FROM patch")
def gr01(t):
    return _named(K.label_patches(_mask(t), 16))


@query("gr02_remove_small", _PATCH + ", n AS (SELECT patch, count(*) AS n FROM patch GROUP BY 1) SELECT r, c FROM patch JOIN n USING (patch) WHERE n >= 5")
def gr02(t):
    return K.without_small(_mask(t), 5).select("r", "c")


@query("gr03_border_connected", _PATCH + ", s AS (SELECT max(r) AS mr FROM dem) SELECT r, c FROM patch WHERE patch IN (SELECT patch FROM patch, s WHERE r IN (0, mr) OR c IN (0, 49))")
def gr03(t):
    return K.touching_border(_mask(t), t.dem.agg(F.max("r") + 1).first()[0], 50)


@query("gr04_confirmed_patches", _PATCH + ", f AS (SELECT r, c FROM dem WHERE z < 3), k AS (SELECT patch, count(*) AS n, bool_or(EXISTS (SELECT 1 FROM f WHERE abs(f.r - p.r) <= 1 AND abs(f.c - p.c) <= 1)) AS hit FROM patch p GROUP BY 1) SELECT count(*) AS n_patches, count(*) FILTER (WHERE hit) AS n_confirmed FROM k WHERE n >= 4")
def gr04(t):
    return K.confirmed_patches(_mask(t), t.dem.where("z < 3"), 4, 1)


@query("gr05_basins_touching", "SELECT DISTINCT floor(p_partkey / 100)::BIGINT AS basin FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 49)")
def gr05(t):
    hit = t.lineitem.where("l_quantity > 49").select(F.col("l_partkey").alias("p_partkey"))
    return t.part.join(hit, "p_partkey", "left_semi").select(F.floor(F.col("p_partkey") / 100).alias("basin")).distinct()


@query("gr06_upstream", TOPO + ", up AS (SELECT id FROM topo WHERE id IN (2, 9) UNION SELECT t.id FROM topo t JOIN up ON t.next_down = up.id WHERE t.id <> t.next_down) SELECT id FROM up")
def gr06(t):
    return joins.upstream(t.topo, t.topo.where("id IN (2, 9)"))


@query("gr07_priority_fill")
def gr07(t):
    return W.priority_fill(t.dem).select("r", "c", R("zf"))


@query(
    "gr07_level_fill",
    DEM + """, m AS (SELECT max(r) AS mr FROM dem), f AS MATERIALIZED (SELECT r, c, z, (r IN (0, mr) OR c IN (0, 49)) AS edge FROM dem, m), o AS (SELECT i - 1 AS dr, j - 1 AS dc FROM range(3) a(i), range(3) b(j) WHERE i <> 1 OR j <> 1),
    up(r, c, level) AS (SELECT r, c, z FROM f WHERE edge UNION SELECT x.r, x.c, greatest(x.z, up.level) FROM up, o JOIN f x ON x.r = up.r + dr AND x.c = up.c + dc AND NOT x.edge) SELECT r, c, min(level) AS zf FROM up GROUP BY 1, 2""",
)
def gr07b(t):
    return W.level_fill(t.dem, _last_row(t.dem) + 1, WIDTH).select("r", "c", "zf")


def _last_row(df):
    return df.agg(F.max("r").alias("r")).first()["r"] or 0


def _slope(ramp):
    """A slope with bumps: the ramp and a little of the column. Pits keep what flows into them."""
    cells = ramp.select("r", "c", (F.col("z") * 10 + F.pmod(F.col("r") * 7 + F.col("c") * 3, F.lit(5)) * 0.3).alias("zf"))
    return cells, W.flow_edges(cells, 30.0, 30.0)


#: Cells of the slope and edges downhill, the steepest first. Accumulation has no SQL: enumerating every path would not end.
_FLOW = sql_with("ramp", recursive=True) + """, f AS MATERIALIZED (SELECT r, c, z * 10 + ((r * 7 + c * 3) % 5) * 0.3 AS z FROM ramp), o AS (SELECT i - 1 AS dr, j - 1 AS dc FROM range(3) a(i), range(3) b(j) WHERE i <> 1 OR j <> 1),
n AS (SELECT r, c, z, r + dr AS r2, c + dc AS c2, dr, dc FROM f, o),
e0 AS (SELECT n.r, n.c, n.r2, n.c2, (n.z - b.z) / CASE WHEN dr <> 0 AND dc <> 0 THEN sqrt(1800.0) ELSE 30.0 END AS s, CASE WHEN dr <> 0 AND dc <> 0 THEN 0.354 ELSE 0.5 END AS w, CASE dr WHEN -1 THEN dc + 1 WHEN 0 THEN CASE WHEN dc < 0 THEN 3 ELSE 4 END ELSE dc + 6 END AS k FROM n JOIN f b ON b.r = n.r2 AND b.c = n.c2 WHERE n.z > b.z),
e AS MATERIALIZED (SELECT *, s * w / sum(s * w) OVER (PARTITION BY r, c) AS weight, row_number() OVER (PARTITION BY r, c ORDER BY s DESC, k) AS nth FROM e0)"""


@query("gr08_accumulation")
def gr08(t):
    cells, edges = _slope(t.ramp)
    return W.accumulate(cells.withColumn("one", F.lit(1.0)), edges, ["one"]).select("r", "c", R("acc_one"))


@query("gr09_weighted_accumulation")
def gr09(t):
    cells, edges = _slope(t.ramp)
    both = cells.withColumns({"one": F.lit(1.0), "paved": (F.col("c") > 2).cast("double")})
    return W.accumulate(both, edges, ["one", "paved"]).select("r", "c", R("acc_one"), R("acc_paved"))


@query("gr10_receivers", _FLOW + " SELECT r, c, r2, c2 FROM e WHERE nth = 1")
def gr10(t):
    return W.receivers(_slope(t.ramp)[1])


@query(
    "gr11_height_above_drainage",
    _FLOW + ", walk(r, c, tr, tc) AS (SELECT r, c, r, c FROM f UNION ALL SELECT walk.r, walk.c, e.r2, e.c2 FROM walk JOIN e ON e.r = tr AND e.c = tc AND nth = 1 WHERE tc <> 0), d AS (SELECT walk.r, walk.c, min(f.z) AS zd FROM walk JOIN f ON f.r = tr AND f.c = tc WHERE tc = 0 GROUP BY 1, 2) SELECT f.r, f.c, round(CASE WHEN zd IS NULL THEN 0 ELSE greatest(z - zd, 0) END, 6) AS hand FROM f LEFT JOIN d ON d.r = f.r AND d.c = f.c",
)
def gr11(t):
    cells, edges = _slope(t.ramp)
    return W.height_above_drainage(cells, W.receivers(edges), F.col("c") == 0, "zf").select("r", "c", R("hand"))


@query("gr12_share_to_receiver", _FLOW + " SELECT r, c, round(weight, 6) AS share FROM e WHERE nth = 1")
def gr12(t):
    edges = _slope(t.ramp)[1]
    return W.share_to_receiver(edges, W.receivers(edges)).select("r", "c", R("share"))


@query("gr13_mass_balance", sql_with("ramp") + " SELECT count(*)::DOUBLE AS total, 0.0::DOUBLE AS missing FROM ramp")
def gr13(t):
    cells, edges = _slope(t.ramp)
    done = W.accumulate(cells.withColumn("one", F.lit(1.0)), edges, ["one"])
    edge = F.col("r").isin(0, _last_row(t.ramp)) | F.col("c").isin(0, WIDTH - 1)
    return W.ledger(done, edges, "one", edge).select(R("total"), F.abs(F.round(F.col("total") - F.col("out") - F.col("lost"), 6)).alias("missing"))


@query("gr14_route_flow")
def gr14(t):
    from .composites import route_flow

    return route_flow(t.ramp, 30.0, 30.0).select("r", "c", R("zf"), R("acc_area"))


@query("gr15_edge_inflow", sql_with("dem") + ", h AS (SELECT r, c, z, CASE WHEN c - lag(c) OVER w <= 4 THEN 0 ELSE 1 END AS new FROM dem WHERE z > 35 WINDOW w AS (PARTITION BY r ORDER BY c)), g AS (SELECT *, sum(new) OVER (PARTITION BY r ORDER BY c) AS run FROM h) SELECT r, run::BIGINT AS run, min(c) AS first, max(c) AS last, sum(z) AS inflow FROM g GROUP BY 1, 2")
def gr15(t):
    return W.crossing_inflow(t.dem, ["r"], "c", F.col("z") > 35, "z").withColumn("run", F.col("run").cast("long"))
