"""Sessions with the settings that the library's jobs expect."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def session(name: str = "gridloom", **more: str) -> SparkSession:
    """A session of SETTINGS and the given ones, on whatever master the environment names (local[*] if none)."""
    builder = SparkSession.builder.appName(name).config(map=SETTINGS | more)
    if not more.get("spark.master"):
        builder = builder.master("local[*]")
    return builder.getOrCreate()
