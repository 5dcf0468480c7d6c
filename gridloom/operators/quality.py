"""Checks of tables and layers, each one aggregation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def audit(tables: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """(name, n, valid): rows, and the share of rows with a value in the given column."""
    parts = [df.agg(F.lit(name).alias("name"), F.count("*").alias("n"), F.avg(F.col(c).isNotNull().cast("int")).alias("valid")) for name, (df, c) in tables.items()]
    return reduce(DataFrame.unionByName, parts)


def sample_checks(df: DataFrame, label: str, key: list[str], non_negative: str, ranged: str, low: float, high: float) -> DataFrame:
    n = F.count("*")
    return df.agg(
        (F.count_if(F.col(non_negative).isNull()) == 0).alias("no_nulls"), F.bool_and(F.col(non_negative) >= 0).alias("non_negative"), F.bool_and(F.col(ranged).between(low, high)).alias("in_range"),
        (F.count_if(F.col(label) == 1) == F.count_if(F.col(label) == 0)).alias("balanced"), (n == F.count_distinct(*key)).alias("is_unique"),
    )


def layer_report(df: DataFrame, layers: list[str], domain: Column | None = None) -> DataFrame:
    """(layer, gaps, lo, hi) within the domain: one pass over all layers."""
    inside = F.lit(True) if domain is None else domain
    row = df.where(inside).agg(*[x for c in layers for x in (F.count_if(F.col(c).isNull() | F.isnan(F.col(c).cast("double"))).alias(f"{c}_g"), F.min(c).alias(f"{c}_l"), F.max(c).alias(f"{c}_h"))])
    return row.select(F.inline(F.array(*[F.struct(F.lit(c).alias("layer"), F.col(f"{c}_g").alias("gaps"), F.col(f"{c}_l").alias("lo"), F.col(f"{c}_h").alias("hi")) for c in layers])))


def difference(a: DataFrame, b: DataFrame, on: list[str], x: str, y: str, tolerance: float) -> DataFrame:
    """(differing, most): cells that differ by more than the tolerance or that only one side has, and the largest difference."""
    gap = F.abs(F.col(x) - F.col(y))
    both = a.join(b, on, "full")
    return both.agg(F.count_if(~F.coalesce(gap <= tolerance, F.col(x).isNull() & F.col(y).isNull())).alias("differing"), F.round(F.max(gap), 6).alias("most"))


def keep_rule(df: DataFrame, failures: dict[str, Column], unverified: Column | None = None) -> DataFrame:
    """df with status and reason: kept without failures, rejected with any, unverified if only the reference is missing."""
    reasons = F.array_compact(F.array(*[F.when(c, F.lit(name)) for name, c in failures.items()]))
    failed = F.size(reasons) > 0
    status = F.when(failed, "rejected").when(F.coalesce(unverified, F.lit(False)) if unverified is not None else F.lit(False), "unverified").otherwise("kept")
    return df.withColumns({"status": status, "reason": F.array_join(reasons, "; ")})


def provenance(log: Column) -> Column:
    """Where a dataset came from, by what its reader said: live, synthetic or unknown."""
    said = F.lower(log)
    return F.when(said.contains("synthetic") | said.contains("fallback"), "synthetic").when(said.contains("fetched") | said.contains("live"), "live").otherwise("unknown")
