"""Joins that stay even when a few keys hold much of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Keys with more than this share of the rows are hot; by counting there are at most 1 / HOT_SHARE.
HOT_SHARE = 1 / 1000


def hot_keys(counts: DataFrame, keys: list[str], n: str, share: float = HOT_SHARE) -> DataFrame:
    """Keys that hold more than `share` of the rows, with `__salts`: over how many salts to spread each.

    counts: one row a key, with its number of rows in column n. At most 1 / share keys come back, whatever
    the size of counts, so the result may be broadcast.
    """
    total = counts.agg(F.sum(n).alias("t")).first()["t"] or 0
    step = max(1.0, total * share)
    return counts.where(F.col(n) > step).select(*keys, F.ceil(F.col(n) / F.lit(step)).cast("int").alias("__salts"))


def salted_join(big: DataFrame, small: DataFrame, keys: list[str], hot: DataFrame, spread: Column, how: str = "inner") -> DataFrame:
    """Equi-join of big with small (one row a key), hot keys of big being spread over salts.

    hot comes from hot_keys(); spread: an expression over big that differs from row to row. Keys are not null.
    """
    hot = hot.select(*[F.col(k).alias(f"__hot_{i}") for i, k in enumerate(keys)], "__salts")

    def salts(df: DataFrame) -> DataFrame:
        on = [F.col(k) == F.col(f"__hot_{i}") for i, k in enumerate(keys)]
        return df.join(F.broadcast(hot), on, "left").drop(*[f"__hot_{i}" for i in range(len(keys))])

    left = salts(big).withColumn("__salt", F.coalesce(F.pmod(F.xxhash64(spread), F.col("__salts")).cast("int"), F.lit(0))).drop("__salts")
    right = salts(small).withColumn("__salt", F.explode(F.sequence(F.lit(0), F.coalesce("__salts", F.lit(1)) - 1))).drop("__salts")
    return left.join(right, [*keys, "__salt"], how).drop("__salt")
