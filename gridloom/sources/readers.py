"""Scans: grids, vectors, tables, documents and scene catalogues, with explicit schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar as S

SCENE = "id string, date date, pass string, orbit int, mode string, bands array<string>, west double, south double, east double, north double"
ELEMENTS = "elements array<struct<type: string, id: long, tags: map<string, string>, geometry: array<struct<lon: double, lat: double>>>>"


def band(spark: SparkSession, path: str, value: str = "v", nodata: float | None = None) -> DataFrame:
    """A grid (r, c, value) with nodata, NaN and infinities as null."""
    df = spark.read.parquet(path)
    return df.withColumn(value, S.masked(F.col(value), nodata))


def stack(spark: SparkSession, path: str, bands: list[str]) -> DataFrame:
    """Named bands of a wide grid; an unknown name is an error. Only their columns are read."""
    df = spark.read.parquet(path)
    missing = set(bands) - set(df.columns)
    if missing:
        raise KeyError(f"no such bands: {sorted(missing)}")
    return df.select("r", "c", *bands)


def window(df: DataFrame, rows: tuple[int, int], cols: tuple[int, int]) -> DataFrame:
    """The cells of a range of rows and columns; the filter reaches the scan."""
    return df.where(F.col("r").between(*rows) & F.col("c").between(*cols))


def vectors(df: DataFrame, west: float, south: float, east: float, north: float) -> DataFrame:
    """Features (xmin, ymin, xmax, ymax, ...) that a box meets."""
    return df.where((F.col("xmax") >= west) & (F.col("xmin") <= east) & (F.col("ymax") >= south) & (F.col("ymin") <= north))


def bounds(df: DataFrame, points: str) -> DataFrame:
    """df with the box of an array of points (x, y), to filter and prune by."""
    x, y = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    return df.withColumns({"xmin": F.array_min(x), "ymin": F.array_min(y), "xmax": F.array_max(x), "ymax": F.array_max(y)})


def dated(df: DataFrame, text: str, name: str = "date") -> DataFrame:
    """df with the date of the first ten characters of a text, day first."""
    return df.withColumn(name, F.to_date(F.substring(text, 1, 10), "dd-MM-yyyy"))


def csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.csv(path, schema=schema, header=True)


def document(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON document as one nested row."""
    return spark.read.json(path, schema=schema, multiLine=True)


def scenes(catalog: DataFrame, box: tuple[float, float, float, float], start: str, end: str, conditions: Column | None = None) -> DataFrame:
    """Scenes of a catalogue that a box meets, from start to before end, under further conditions."""
    w, s, e, n = box
    out = catalog.where((F.col("east") >= w) & (F.col("west") <= e) & (F.col("north") >= s) & (F.col("south") <= n) & (F.col("date") >= start) & (F.col("date") < end))
    return out if conditions is None else out.where(conditions)


def acquisitions(found: DataFrame) -> DataFrame:
    """(date, orbit, pass, ids): the frames of one pass over the box."""
    return found.groupBy("date", "orbit", "pass").agg(F.array_sort(F.collect_set("id")).alias("ids"))


def clearest(catalog: DataFrame, start: str, end: str, wider: tuple[str, str], cloud: str = "cloud") -> DataFrame:
    """The least cloudy scene of a window; of a wider one only if there is none."""
    pick = lambda a, b: catalog.where((F.col("date") >= a) & (F.col("date") < b)).orderBy(cloud, "date", "id").limit(1)
    best = pick(start, end)
    return best if not best.isEmpty() else pick(*wider)


def mosaic_tiles(tiles: list[DataFrame], rows: int, cols: int) -> DataFrame:
    """Tiles of a grid together; an error unless every cell of the grid is there once."""
    from functools import reduce

    out = reduce(DataFrame.unionByName, tiles)
    n = out.agg(F.count("*").alias("n"), F.count_distinct("r", "c").alias("d")).first()
    if n["n"] != rows * cols or n["d"] != rows * cols:
        raise ValueError(f"{n['n']} cells, {n['d']} distinct ones; the grid has {rows * cols}")
    return out


def map_elements(df: DataFrame, text: str) -> DataFrame:
    """(type, id, tags, seq, lon, lat): the vertices of map elements in JSON texts."""
    parsed = df.select(F.explode(F.from_json(text, ELEMENTS)["elements"]).alias("e"))
    return parsed.select("e.type", "e.id", "e.tags", F.posexplode("e.geometry").alias("seq", "p")).select("type", "id", "tags", "seq", "p.lon", "p.lat")


def road_graph(vertices: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of ways given by their vertices (id, seq, lon, lat)."""
    from pyspark.sql import Window

    point = F.concat_ws(",", F.round("lon", 7).cast("string"), F.round("lat", 7).cast("string"))
    v = vertices.select("id", "seq", point.alias("node"), "lon", "lat")
    nodes = v.groupBy("node").agg(F.first("lon").alias("lon"), F.first("lat").alias("lat"), F.count_distinct("id").alias("ways"))
    nxt = F.lead("node").over(Window.partitionBy("id").orderBy("seq"))
    return nodes, v.withColumn("to", nxt).where("to is not null").select("id", "seq", F.col("node").alias("from"), "to")
