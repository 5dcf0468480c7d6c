"""Ranks and cumulative sums over all rows, without sending all rows to one task.

Values are first counted, then dealt over ranges; each range is ordered by a task of its own and knows what lies
before it from the ranges' totals, a table of a few hundred rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lineage import cut

#: Ranges that values are dealt over.
RANGES = 128


def ranged(df: DataFrame, value: str, by: list[str], ranges: int = RANGES) -> DataFrame:
    """df with `__range`, which grows with the value; ranges hold about equally many rows, equal values share one."""
    edges = df.groupBy(*by).agg(F.array_distinct(F.percentile_approx(value, [k / ranges for k in range(1, ranges)], 10_000)).alias("__edges"))
    joined = df.join(edges, by, "left") if by else df.withColumn("__edges", F.lit(edges.first()["__edges"]).cast(f"array<{dict(df.dtypes)[value]}>"))
    return joined.withColumn("__range", F.coalesce(F.size(F.filter("__edges", lambda e: e < F.col(value))), F.lit(0))).drop("__edges")


def running_sums(df: DataFrame, value: str, sums: list[str], by: list[str] | None = None) -> DataFrame:
    """df with before_<s> for each of the sums: the total over rows of smaller values (of the same group).

    df: one row a value and group. by: columns of few distinct tuples.
    """
    by = by or []
    df = ranged(df, value, by)
    totals = df.groupBy(*by, "__range").agg(*[F.sum(s).alias(f"__{s}") for s in sums])
    over = Window.partitionBy(*by).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    offsets = totals.select(*by, "__range", *[F.coalesce(F.sum(f"__{s}").over(over), F.lit(0)).alias(f"__off_{s}") for s in sums])
    within = Window.partitionBy(*by, "__range").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    out = df.join(offsets, [*by, "__range"])
    out = out.withColumns({f"before_{s}": F.col(f"__off_{s}") + F.coalesce(F.sum(s).over(within), F.lit(0)) for s in sums})
    return out.drop("__range", *[f"__off_{s}" for s in sums])


def quantiles(df: DataFrame, value: str, shares: list[float]) -> list[float | None]:
    """Exact quantiles of the values that are not null, between neighbours by a straight line; None if there is none.

    Values are counted and dealt over ranges; only those at the wanted ranks leave the tasks, two a share at most.
    """
    values = cut(value_counts(df.where(F.col(value).isNotNull()).select(F.col(value).cast("double").alias("v")), "v"))  # read for the ranges and for the sums
    counts = cut(running_sums(values, "v", ["n"]))
    total = counts.agg(F.sum("n").alias("n")).first()["n"]
    if not total:
        return [None] * len(shares)
    wanted = sorted({k for q in shares for at in [q * (total - 1)] for k in (math.floor(at), math.ceil(at))})
    ranks = counts.withColumn("k", F.explode(F.filter(F.array(*[F.lit(k) for k in wanted]), lambda k: (k >= F.col("before_n")) & (k < F.col("before_n") + F.col("n")))))
    at = {r["k"]: r["v"] for r in ranks.select("k", "v").collect()}
    return [at[math.floor(x)] + (at[math.ceil(x)] - at[math.floor(x)]) * (x - math.floor(x)) for x in (q * (total - 1) for q in shares)]


def cut_points(df: DataFrame, columns: dict[str, Column], parts: int) -> dict[str, list[float]]:
    """By name, in order, the values of each column of doubles that are not null if there are at most `parts`, else those at ranks ceil(k / parts * rows).

    All columns are counted in one pass over df; the counts are written, and all else reads them. Two jobs follow that
    gather a row a column and at most `parts` values each.
    """
    if not columns:
        return {}
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("which"), c.alias("v")) for k, c in enumerate(columns.values())]))
    counts = cut(value_counts(df.select(each.alias("x")).select("x.*").where("v is not null"), "v", ["which"]))
    sizes = {r["which"]: r for r in counts.groupBy("which").agg(F.count("*").alias("values"), F.sum("n").alias("rows")).collect()}
    many = [k for k, r in sizes.items() if r["values"] > parts]
    found = counts.where(~F.col("which").isin(many)).select("which", "v")
    if many:  # a value holds a wanted rank where parts * (rows so far) / rows passes a whole number
        rows = F.create_map(*[F.lit(x) for k in many for x in (k, sizes[k]["rows"])])[F.col("which")]
        ranks = running_sums(counts.where(F.col("which").isin(many)), "v", ["n"], ["which"]).withColumn("rows", rows)
        found = found.unionByName(ranks.where(f"(before_n + n) * {parts}L div rows > before_n * {parts}L div rows").select("which", "v"))
    at: dict[int, list[float]] = {}
    for r in found.collect():
        at.setdefault(r["which"], []).append(r["v"])
    return {name: sorted(at.get(k, [])) for k, name in enumerate(columns)}


def value_counts(df: DataFrame, value: str, by: list[str] | None = None, **conditions: Column) -> DataFrame:
    """One row a value (and group) with n and a count for each condition."""
    return df.groupBy(*(by or []), value).agg(F.count("*").alias("n"), *[F.count_if(c).alias(k) for k, c in conditions.items()])


def average_ranks(df: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """One row a value (and group): n and rank, ties sharing the mean of their ranks."""
    counts = running_sums(value_counts(df, value, by), value, ["n"], by)
    return counts.withColumn("rank", F.col("before_n") + (F.col("n") + 1) / 2.0).drop("before_n")


def ordinal_ranks(df: DataFrame, value: str, tie: list[str], by: list[str] | None = None) -> DataFrame:
    """df with `rank` 1, 2, ... (in each group): by value, ties by the tie columns, nulls first.

    One sort by ranges of all those columns, so not even equal values have to share a task. Rows are numbered within
    their task; the tasks' row counts, a short table, give what lies before each. by: columns of few distinct tuples,
    since where each begins is broadcast.
    """
    by = by or []
    keys = [*by, value, *tie]
    placed = cut(df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("__at", F.monotonically_increasing_id()))
    task, within = F.shiftright("__at", 33), F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    counts = placed.groupBy(task.alias("__task")).agg(F.count("*").alias("__n"))
    before = counts.select("__task", F.coalesce(F.sum("__n").over(Window.partitionBy(F.lit(0)).orderBy("__task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    ranked = placed.withColumn("__task", task).join(F.broadcast(before), "__task").withColumn("rank", F.col("__before") + within + 1)
    if by:
        first = ranked.groupBy(*[F.col(b).alias(f"__by{i}") for i, b in enumerate(by)]).agg(F.min("rank").alias("__first"))
        on = [F.col(b).eqNullSafe(F.col(f"__by{i}")) for i, b in enumerate(by)]
        ranked = ranked.join(F.broadcast(first), on).withColumn("rank", F.col("rank") - F.col("__first") + 1)
    return ranked.select(*df.columns, "rank")


def percentile_ranks(df: DataFrame, value: str, tie: list[str]) -> DataFrame:
    """df with `pct`: 100 * ordinal rank / rows."""
    n = df.count()
    return ordinal_ranks(df, value, tie).withColumn("pct", F.col("rank") * 100.0 / n).drop("rank")


def percentile_against(df: DataFrame, value: str, reference: DataFrame, ref_value: str) -> DataFrame:
    """df with `pct`: the share (0 to 100) of reference values that are at or below the value."""
    total = reference.count()
    both = value_counts(df, value).select(F.col(value).alias("__v"), F.lit(0).cast("long").alias("n")).unionByName(value_counts(reference, ref_value).select(F.col(ref_value).alias("__v"), "n"))
    both = both.groupBy("__v").agg(F.sum("n").alias("n"))
    ranks = running_sums(both, "__v", ["n"]).select("__v", (F.col("before_n") + F.col("n")).alias("__at"))
    return df.join(ranks, df[value] == F.col("__v"), "left").withColumn("pct", F.col("__at") * 100.0 / total).drop("__v", "__at")


def auc(df: DataFrame, score: str, label: Column, by: list[str] | None = None) -> DataFrame:
    """(groups, n_pos, n_neg, auc): area under the ROC curve with ties at one half, from counts by score."""
    return auc_of_counts(cut(value_counts(df, score, by, pos=label, neg=~label)), score, by)


def auc_of_counts(counted: DataFrame, score: str, by: list[str] | None = None) -> DataFrame:
    """The same of a table with pos and neg by score and group, which is read some times."""
    by = by or []
    counts = running_sums(counted, score, ["neg"], by)
    wins = F.sum(F.col("pos").cast("double") * (F.col("before_neg") + F.col("neg") / 2.0))
    out = counts.groupBy(*by).agg(F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"), wins.alias("__wins"))
    return out.select(*by, "n_pos", "n_neg", F.try_divide(F.col("__wins"), F.col("n_pos").cast("double") * F.col("n_neg")).alias("auc"))
