"""Sources and sinks (SRC, SNK): each writes to the shared folder and reads back what it wrote."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import models as M
from ..operators.lineage import shared_dir
from ..sources import readers as I
from ..sources import writers as O
from .registry import query, sql_with

R = lambda c, n=None, d=6: F.round(c, d).alias(n or c)
DEM, IMG, PAIR = (sql_with(x) for x in ("dem", "img", "img_pair"))


def _path(t) -> str:
    return f"{shared_dir(t.spark)}/{uuid.uuid4()}"


@query("src01_band", DEM + " SELECT r, c, CASE WHEN z <> 13 THEN z END AS v FROM dem")
def src01(t):
    path = _path(t)
    t.dem.withColumnRenamed("z", "v").write.parquet(path)
    return I.band(t.spark, path, nodata=13)


@query("src02_stack", PAIR + " SELECT r, c, round(b, 6) AS b FROM img_pair")
def src02(t):
    path = _path(t)
    t.img_pair.write.parquet(path)
    return I.stack(t.spark, path, ["b"]).withColumn("b", F.round("b", 6))


@query("src03_window", DEM + " SELECT r, c, z FROM dem WHERE r BETWEEN 3 AND 9 AND c BETWEEN 10 AND 30")
def src03(t):
    return I.window(t.dem, (3, 9), (10, 30))


@query("src04_vectors_in_box", "WITH p AS (SELECT n_nationkey AS id, n_nationkey * 2 + 0.3 AS xmin, n_nationkey * 2 + 9.4 AS xmax, n_nationkey + 0.2 AS ymin, n_nationkey + 8.8 AS ymax FROM nation) SELECT id FROM p WHERE xmax >= 10 AND xmin <= 20 AND ymax >= 5 AND ymin <= 12")
def src04(t):
    from .join_queries import _triangles

    return I.vectors(I.bounds(_triangles(t), "ring"), 10, 5, 20, 12).select("id")


@query("src05_layer", "SELECT r_regionkey, r_name FROM region")
def src05(t):
    return t.region


@query("src06_dated_polygons", "SELECT o_orderkey, o_orderdate::DATE AS date FROM orders")
def src06(t):
    text = t.orders.select("o_orderkey", F.date_format("o_orderdate", "dd-MM-yyyy HH:mm").alias("from_time"))
    return I.dated(text, "from_time").select("o_orderkey", "date")


@query("src07_csv", "SELECT s_suppkey, s_name, round(s_acctbal, 2) AS s_acctbal FROM supplier")
def src07(t):
    path = _path(t)
    t.supplier.select("s_suppkey", "s_name", F.round("s_acctbal", 2).alias("s_acctbal")).write.csv(path, header=True)
    return I.csv(t.spark, path, "s_suppkey long, s_name string, s_acctbal double")


@query("src08_parquet", "SELECT c_custkey, c_mktsegment FROM customer")
def src08(t):
    return t.customer.select("c_custkey", "c_mktsegment")


@query("src09_json_document", "SELECT n_nationkey, n_name FROM nation")
def src09(t):
    path = _path(t)
    t.nation.select("n_nationkey", "n_name").write.json(path)
    return t.spark.read.json(path, schema="n_nationkey int, n_name string")


@query("src10_array_file", IMG + " SELECT r, count(*) AS n, round(sum(v), 4) AS total FROM img GROUP BY r")
def src10(t):
    path = _path(t)
    t.embeddings.select("vec_id", "embedding").write.parquet(path)
    v = t.spark.read.parquet(path).select(F.col("vec_id").cast("int").alias("r"), F.explode("embedding").alias("v"))
    return v.groupBy("r").agg(F.count("*").alias("n"), R(F.sum(F.col("v").cast("double")), "total", 4))


def _catalog(t):
    k = F.col("event_id")
    return t.events.select(
        F.concat(F.lit("s"), k.cast("string")).alias("id"), F.to_date("ts").alias("date"), F.when(k % 2 == 0, "ASC").otherwise("DESC").alias("pass"), F.pmod("user_id", F.lit(5)).cast("int").alias("orbit"),
        (k % 10 * 1.0).alias("west"), (k % 7 * 1.0).alias("south"), (k % 10 + 2.0).alias("east"), (k % 7 + 2.0).alias("north"), F.col("value").alias("cloud"), F.col("event_type").alias("mode"),
    )


_SCENES = "WITH k AS (SELECT 's' || event_id AS id, ts::DATE AS date, CASE WHEN event_id % 2 = 0 THEN 'ASC' ELSE 'DESC' END AS pass, (user_id % 5)::INT AS orbit, event_id % 10 AS west, event_id % 7 AS south, value AS cloud, event_type AS mode FROM events), mid AS (SELECT (min(date) + 5)::DATE AS a FROM k) "


@query("src11_scene_query", _SCENES + "SELECT date, orbit, pass, array_to_string(list_sort(list(id)), ',') AS ids FROM k WHERE west + 2 >= 3 AND west <= 5 AND south + 2 >= 2 AND south <= 4 AND date >= (SELECT a FROM mid) AND mode = 'view' GROUP BY 1, 2, 3")
def src11(t):
    c = _catalog(t)
    a = c.agg((F.date_add(F.min("date"), 5)).cast("string").alias("a")).first()["a"]
    found = I.acquisitions(I.scenes(c, (3, 2, 5, 4), a, "9999-12-31", F.col("mode") == "view"))
    return found.withColumn("ids", F.array_join("ids", ","))


@query("src12_tiles", DEM + " SELECT r, c, z FROM dem")
def src12(t):
    n = t.dem.count()
    return I.mosaic_tiles([t.dem.where(F.col("c") < 20), t.dem.where(F.col("c") >= 20)], n // 50, 50)


@query("src13_clearest", _SCENES + "SELECT id, round(cloud, 6) AS cloud FROM k ORDER BY cloud, date, id LIMIT 1")
def src13(t):
    return I.clearest(_catalog(t), "1900-01-01", "1900-01-02", ("1900-01-01", "9999-12-31")).select("id", R("cloud"))


def _elements(t):
    point = lambda k: F.struct((F.col("n_nationkey") + k * 0.5).alias("lon"), (F.col("n_regionkey") + k * 1.0).alias("lat"))
    e = F.struct(F.lit("way").alias("type"), F.col("n_nationkey").cast("long").alias("id"), F.create_map(F.lit("name"), F.col("n_name")).alias("tags"), F.array(point(0), point(1), point(2)).alias("geometry"))
    return t.nation.select(F.to_json(F.struct(F.array(e).alias("elements"))).alias("text"))


@query("src15_road_graph", "SELECT n_nationkey::BIGINT AS id, k::INT AS seq FROM nation, range(2) x(k)")
def src15(t):
    _, edges = I.road_graph(I.map_elements(_elements(t), "text"))
    return edges.select("id", "seq")


@query("src16_map_elements", "SELECT n_nationkey::BIGINT AS id, k::INT AS seq, n_nationkey + k * 0.5 AS lon, n_regionkey + k * 1.0 AS lat FROM nation, range(3) x(k)")
def src16(t):
    return I.map_elements(_elements(t), "text").select("id", "seq", "lon", "lat")


@query("snk01_tiled_grid", DEM + " SELECT r, c, z FROM dem")
def snk01(t):
    path = _path(t)
    O.grid(t.dem, path, 16)
    return t.spark.read.parquet(path).select("r", "c", "z")


@query("snk02_band_stack", PAIR + " SELECT r, c, round(a, 6) AS a, round(b, 6) AS b FROM img_pair")
def snk02(t):
    path = _path(t)
    O.grid(t.img_pair.drop("ref"), path, 64, {"a": "dB", "b": "dB"})
    return t.spark.read.parquet(path).select("r", "c", R("a"), R("b"))


@query("snk03_csv", "SELECT s_suppkey, round(s_acctbal, 1) AS s_acctbal FROM supplier WHERE abs(s_acctbal) >= 1000")
def snk03(t):
    path = _path(t)
    O.csv(t.supplier.select("s_suppkey", "s_acctbal"), path)
    return t.spark.read.csv(path, schema="s_suppkey long, s_acctbal double", header=True).where("abs(s_acctbal) >= 1000").withColumn("s_acctbal", F.round("s_acctbal", 1))


@query("snk04_parquet", "SELECT p_partkey, p_name FROM part")
def snk04(t):
    path = _path(t)
    t.part.select("p_partkey", "p_name").write.parquet(path)
    return t.spark.read.parquet(path)


@query("snk05_metrics_document", "SELECT l_returnflag AS flag, count(*) AS n FROM lineitem GROUP BY 1")
def snk05(t):
    path = _path(t)
    O.documents(t.lineitem.groupBy(F.col("l_returnflag").alias("flag")).agg(F.count("*").alias("n")), path)
    return t.spark.read.json(path, schema="flag string, n long")


@query("snk06_array_file", "SELECT vec_id, len(embedding)::INT AS n FROM embeddings")
def snk06(t):
    path = _path(t)
    t.embeddings.select("vec_id", "embedding").write.parquet(path)
    return t.spark.read.parquet(path).select("vec_id", F.size("embedding").alias("n"))


@query("snk07_map_features", "SELECT n_nationkey AS id, 4::INT AS points, n_nationkey AS kept FROM nation")
def snk07(t):
    from .join_queries import _triangles

    rings = _triangles(t).withColumn("pts", F.concat("ring", F.slice("ring", 1, 1)))
    back = O.features(rings, "id", "pts", ["id"]).withColumn("f", F.from_json("feature", "geometry struct<coordinates: array<array<double>>>, properties struct<id: int>"))
    return back.select("id", F.size("f.geometry.coordinates").alias("points"), F.col("f.properties.id").alias("kept"))


@query("snk08_model_round_trip")
def snk08(t):
    from pyspark.ml import PipelineModel

    from .model_queries import _model

    model, _, test = _model(t)
    path = _path(t)
    model.write().save(path)
    return M.scores(PipelineModel.load(path), test).agg(F.count("*").alias("n"), R(F.avg("score"), "mean"))


@query("snk10_cached", "SELECT r_regionkey, r_name FROM region")
def snk10(t):
    path = _path(t)
    O.cached(t.spark, path, lambda: t.region)
    return O.cached(t.spark, path, lambda: t.region.limit(0))
