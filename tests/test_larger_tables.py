"""What larger tables brought to light: latitudes far south, ties at a tier's limit, and a query that named another's table."""

import math

import pytest
from gridloom.functions import scalar as S
from gridloom.plans import catalog
from pyspark.sql import functions as F
from test_oracles import duck, rows  # noqa: F401


@pytest.mark.parametrize("name", ["mt14_class_agreement", "sc14_hazard_index", "sc22_tile_index", "cp16_hazard_validation"])
def test_equals_sql(spark, duck, name):  # noqa: F811
    got = catalog.QUERIES[name](spark, "/root/testdata/sf0.001").toPandas()
    assert rows(got) == rows(duck.execute(catalog.ORACLES[name]).df())


def test_tiles_far_south_and_beyond(spark):
    lats = [85.05, 10.5, 0.0, -10.5, -85.05, -89.99, -90.0, -100.0, -180.0, -229.5]
    df = spark.createDataFrame([(x,) for x in lats], "lat double")
    got = [r.y for r in df.select("lat", S.web_mercator_tile(F.lit(76.1), F.col("lat"), 14)[1].alias("y")).collect()]
    assert got == [math.floor((1 - math.asinh(math.tan(math.radians(x))) / math.pi) / 2 * 2**14) for x in lats]


def test_hazard_is_the_tiers_limit_itself(spark):
    df = spark.range(10).select((F.col("id") / 10.0).alias("built"))
    got = [r.h for r in df.orderBy("built").select(S.hazard_index(F.lit(19.0), F.lit(1.0), F.lit(600.0), F.col("built")).alias("h")).collect()]
    assert got == [k * 2 / 100 if k != 7 else 0.13999999999999999 for k in range(10)]
