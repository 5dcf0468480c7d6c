"""Queries by name, with SQL for the same rows, and the derived inputs that both sides share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Grid width of the elevation raster made of `part`.
WIDTH = 50


class Tables:
    """The driver's tables, and rasters, series and samples derived from them."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @property
    def img(self) -> DataFrame:
        """A band raster (r, c, v): a row a vector, a column a position."""
        return self.embeddings.select(F.col("vec_id").cast("int").alias("r"), F.posexplode("embedding").alias("c", "v")).withColumn("v", F.col("v").cast("double"))

    @property
    def img_pair(self) -> DataFrame:
        """Two observations (r, c, a, b, ref): of a row and of the next; ref: the row's label is below 5."""
        one = self.embeddings.select(F.col("vec_id").cast("int").alias("r"), F.col("embedding").alias("x"), F.col("label"))
        two = self.embeddings.select((F.col("vec_id") - 1).cast("int").alias("r"), F.col("embedding").alias("y"))
        zipped = one.join(two, "r").select("r", (F.col("label") < 5).alias("ref"), F.posexplode(F.arrays_zip("x", "y")).alias("c", "z"))
        return zipped.select("r", "c", F.col("z.x").cast("double").alias("a"), F.col("z.y").cast("double").alias("b"), "ref")

    @property
    def dem(self) -> DataFrame:
        """An elevation raster (r, c, z), WIDTH columns."""
        k = F.col("p_partkey")
        return self.part.select(F.floor(k / WIDTH).cast("int").alias("r"), F.pmod(k, F.lit(WIDTH)).cast("int").alias("c"), F.col("p_size").cast("double").alias("z"))

    @property
    def ramp(self) -> DataFrame:
        k = F.col("p_partkey")
        return self.part.select(F.floor(k / WIDTH).cast("int").alias("r"), F.pmod(k, F.lit(WIDTH)).cast("int").alias("c"), F.col("p_retailprice").alias("z"))

    @property
    def daily(self) -> DataFrame:
        """A daily series (d, mm) with gaps."""
        return self.orders.groupBy(F.to_date("o_orderdate").alias("d")).agg((F.round(F.sum("o_totalprice")) / 1000).alias("mm"))

    @property
    def samples(self) -> DataFrame:
        """A labelled sample table: y, features, block and event."""
        return self.lineitem.select(
            (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("id"), (F.col("l_returnflag") == "R").cast("int").alias("y"),
            F.col("l_quantity").alias("f1"), F.round(F.col("l_extendedprice"), 2).alias("f2"), F.col("l_discount").alias("f3"), F.col("l_tax").alias("f4"),
            F.concat_ws("_", F.floor(F.col("l_partkey") / 500).cast("string"), F.floor(F.col("l_suppkey") / 25).cast("string")).alias("block"), F.year("l_shipdate").alias("event"),
        )

    @property
    def scored(self) -> DataFrame:
        """Scores in [0, 1] with labels (id, y, s, grp): tied scores, as a tree model gives."""
        return self.lineitem.select(
            "l_orderkey", "l_linenumber", (F.col("l_returnflag") == "R").cast("int").alias("y"), (F.col("l_quantity") / 50).alias("s"), F.col("l_linestatus").alias("grp"), F.col("l_suppkey").alias("k"),
        )

    @property
    def cube(self) -> DataFrame:
        """A yearly cube (r, year, v) with gaps as null, all years of 1995 to 2001 present."""
        got = self.orders.join(self.customer.select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey").groupBy(F.col("c_nationkey").alias("r"), F.year("o_orderdate").alias("year")).agg(F.round(F.sum("o_totalprice") / 1e6, 4).alias("v"))
        return got.withColumn("v", F.when(F.pmod(F.col("r") * 7 + F.col("year"), F.lit(5)) != 0, F.col("v")))

    @property
    def agree(self) -> DataFrame:
        """Two binary maps (id, a, b)."""
        return self.labels.select(F.col("doc_id").alias("id"), (F.col("quality") == 1).alias("a"), (F.col("toxic") == 1).alias("b"))

    @property
    def topo(self) -> DataFrame:
        """A basin tree (id, next_down); the root's is itself."""
        return self.part.select(F.col("p_partkey").alias("id"), F.floor(F.col("p_partkey") / 3).cast("long").alias("next_down"))


# The same inputs in DuckDB SQL.
_SQL = {
    "img": "SELECT vec_id::INT AS r, unnest(range(len(embedding)))::INT AS c, unnest(embedding)::DOUBLE AS v FROM embeddings",
    "img_pair": "SELECT x.vec_id::INT AS r, unnest(range(len(x.embedding)))::INT AS c, unnest(x.embedding)::DOUBLE AS a, unnest(y.embedding)::DOUBLE AS b, x.label < 5 AS ref FROM embeddings x JOIN embeddings y ON y.vec_id = x.vec_id + 1",
    "dem": f"SELECT floor(p_partkey / {WIDTH})::INT AS r, (p_partkey % {WIDTH})::INT AS c, p_size::DOUBLE AS z FROM part",
    "ramp": f"SELECT floor(p_partkey / {WIDTH})::INT AS r, (p_partkey % {WIDTH})::INT AS c, p_retailprice AS z FROM part",
    "daily": "SELECT o_orderdate::DATE AS d, round(sum(o_totalprice)) / 1000 AS mm FROM orders GROUP BY 1",
    "samples": "SELECT l_orderkey * 100 + l_linenumber AS id, (l_returnflag = 'R')::INT AS y, l_quantity AS f1, round(l_extendedprice, 2) AS f2, l_discount AS f3, l_tax AS f4, floor(l_partkey / 500)::BIGINT || '_' || floor(l_suppkey / 25)::BIGINT AS block, year(l_shipdate)::INT AS event FROM lineitem",
    "scored": "SELECT l_orderkey, l_linenumber, (l_returnflag = 'R')::INT AS y, l_quantity / 50 AS s, l_linestatus AS grp, l_suppkey AS k FROM lineitem",
    "cube": "SELECT r, year, CASE WHEN (r * 7 + year) % 5 <> 0 THEN v END AS v FROM (SELECT c_nationkey AS r, year(o_orderdate)::INT AS year, round(sum(o_totalprice) / 1e6, 4) AS v FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY ALL)",
    "agree": "SELECT doc_id AS id, quality = 1 AS a, toxic = 1 AS b FROM labels",
    "topo": "SELECT p_partkey AS id, floor(p_partkey / 3)::BIGINT AS next_down FROM part",
}


def sql_with(*names: str, recursive: bool = False) -> str:
    """'WITH ...' for derived inputs; more tables and the SELECT may follow."""
    return f"WITH {'RECURSIVE ' * recursive}" + ", ".join(f"{n} AS ({_SQL[n]})" for n in names)


def draw_sql(*keys: str, seed: int = 42) -> str:
    """SQL for the whole number that sampling.draw makes of the keys and a seed."""
    return f"('0x' || substr(md5('{seed}:' || " + " || ':' || ".join(keys) + "), 1, 13))::BIGINT"


def query(name: str, sql: str | None = None) -> Callable:
    """Registers a function of Tables as a query, with SQL for the same rows where SQL can express it."""

    def register(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        assert name not in QUERIES, name
        QUERIES[name] = lambda spark, folder: f(Tables(spark, folder))
        if sql:
            ORACLES[name] = sql
        return f

    return register
