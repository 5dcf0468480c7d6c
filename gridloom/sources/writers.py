"""Sinks: tiled grids, tables, texts and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.grid import tiled


def grid(df: DataFrame, path: str, tile: int = 256, comments: dict[str, str] | None = None, mode: str = "error") -> None:
    """A grid by tiles, cells in order within each, so that windows prune files and row groups. comments: units by band."""
    out = tiled(df, tile)
    for name, text in (comments or {}).items():
        out = out.withMetadata(name, {"comment": text})
    out.repartition("tr", "tc").sortWithinPartitions("tr", "tc", "r", "c").write.mode(mode).partitionBy("tr", "tc").parquet(path)


def csv(df: DataFrame, path: str, digits: int = 6, mode: str = "error") -> None:
    """A table as CSV with a header; doubles to so many significant digits."""
    cols = [F.format_string(f"%.{digits}g", F.col(c)).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes]
    df.select(*cols).write.mode(mode).csv(path, header=True)


def documents(df: DataFrame, path: str, mode: str = "error") -> None:
    """Each row as a JSON document, a line each; dates and times as text."""
    df.select(F.to_json(F.struct("*")).alias("value")).write.mode(mode).text(path)


def features(df: DataFrame, id_col: str, points: str, properties: list[str]) -> DataFrame:
    """(id, feature): each row as a map feature in JSON, a line of (x, y) points with properties."""
    coordinates = F.transform(points, lambda p: F.array(p["x"], p["y"]))
    geometry = F.struct(F.lit("LineString").alias("type"), coordinates.alias("coordinates"))
    return df.select(id_col, F.to_json(F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), F.struct(*properties).alias("properties"))).alias("feature"))


def cached(spark: SparkSession, path: str, make) -> DataFrame:
    """The table at path; made and written first if it is not there."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.parquet(path)
    except AnalysisException:
        make().write.parquet(path)
        return spark.read.parquet(path)
