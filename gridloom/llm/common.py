"""Shared helpers: reading, repeatable draws and Arrow row mapping; lineage cuts and skew-safe joins of the library."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.lineage import cut, shared_dir
from ..operators.skew import hot_keys, salted_join

__all__ = ["WORD", "cut", "hot_keys", "map_rows", "n_blocks", "pinned_splits", "salted_join", "shared_dir", "table", "uniform"]

#: A word of the contracts: a run of characters that are not ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def uniform(*parts: Column | int | str) -> Column:
    """A number in (0, 1) that depends on the parts alone, so that a task run again draws the same."""
    h = F.xxhash64(*[p if isinstance(p, Column) else F.lit(p) for p in parts])
    return (F.shiftrightunsigned(h, 11).cast("double") + 0.5) * F.lit(2.0**-53)


def map_rows(df: DataFrame, f: Callable[[dict[str, list]], dict[str, list]], schema: str, rows: int = 512) -> DataFrame:
    """f over slices of at most `rows` rows, as columns of Python values; one Python pass, in Arrow batches."""
    spark = df.sparkSession
    fields = spark.createDataFrame([], schema).schema
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                out = f({k: part.column(i).to_pylist() for i, k in enumerate(part.schema.names)})
                yield pa.RecordBatch.from_arrays([pa.array(out[x.name], x.type) for x in arrow], schema=arrow)

    return df.mapInArrow(run, fields)


def n_blocks(rows: int, each: int) -> int:
    return max(1, math.ceil(rows / each))


@contextmanager
def pinned_splits(spark: SparkSession) -> Iterator[None]:
    """Within it, scans split files alike however many executors are alive; the session's own setting goes first and comes back."""
    key = "spark.sql.files.minPartitionNum"
    if spark.conf.get(key, None) is not None:
        yield
        return
    spark.conf.set(key, spark.sparkContext.defaultParallelism)
    try:
        yield
    finally:
        spark.conf.unset(key)
