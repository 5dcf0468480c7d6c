"""Samples, splits, folds and resamples that depend on keys and a seed alone, so any task can draw them again."""

from __future__ import annotations

from hashlib import md5

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lineage import cut
from .ranking import ordinal_ranks

#: Groups that are dealt into folds together, on average.
DEALT = 10_000
#: Blocks that are weighed in one product, on average.
DRAWN = 1000


def draw(keys: list[str], seed: int) -> Column:
    """A number in [0, 1): the first 13 hexadecimal digits of the md5 of '<seed>:<key>:<key>...', over 16 to the 13th.

    Any engine can draw it again, so SQL repeats a sample row for row.
    """
    text = F.concat_ws(":", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") * F.lit(2.0**-52)


def first_by_hash(df: DataFrame, keys: list[str], n: int, seed: int = 42) -> DataFrame:
    """n rows without replacement, every n of them as likely as any other."""
    return df.orderBy(draw(keys, seed), *keys).limit(n)


def hash_ranks(df: DataFrame, keys: list[str], by: list[str] | None = None, seed: int = 42) -> DataFrame:
    """df with `rank`, a random order from 1 (in each group)."""
    return ordinal_ranks(df.withColumn("__u", draw(keys, seed)), "__u", keys, by).drop("__u")


def balanced(df: DataFrame, label: str, keys: list[str], seed: int = 42) -> DataFrame:
    """All positives and as many negatives drawn without replacement."""
    n = df.agg(F.count_if(F.col(label) == 1).alias("n")).first()["n"]
    ranked = hash_ranks(df.where(F.col(label) == 0), keys, seed=seed)
    return df.where(F.col(label) == 1).unionByName(ranked.where(F.col("rank") <= n).drop("rank"))


def stratified_split(df: DataFrame, label: str, keys: list[str], share: float = 0.7, seed: int = 42) -> DataFrame:
    """df with `train`: exactly that share of each class, rounded down."""
    n = df.groupBy(label).agg(F.floor(F.count("*") * share).alias("__cut"))
    return hash_ranks(df, keys, [label], seed).join(n, label).withColumn("train", F.col("rank") <= F.col("__cut")).drop("rank", "__cut")


def stratified_folds(df: DataFrame, label: str, keys: list[str], k: int = 5, seed: int = 42) -> DataFrame:
    """df with `fold` 0 to k - 1, each class dealt evenly."""
    return hash_ranks(df, keys, [label], seed).withColumn("fold", F.pmod(F.col("rank") - 1, F.lit(k)).cast("int")).drop("rank")


def group_folds(df: DataFrame, group: str, label: str, k: int = 5, seed: int = 42) -> DataFrame:
    """(group, fold): whole groups to folds, so that the classes are spread as evenly as greedy dealing can.

    Groups go in order of the spread of their class counts, ties at random; each to the fold where the spread of the
    folds' class shares comes out least. Groups are dealt by hash over parts of about DEALT, each part by itself in one task.
    """
    counts = df.groupBy(group).agg(F.count_if(F.col(label) == 1).alias("__p"), F.count_if(F.col(label) == 0).alias("__n"))
    counts = cut(counts.withColumn("__u", draw([group], seed)))
    parts = max(1, -(-counts.count() // DEALT))

    def deal(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.assign(gap=-(rows["__p"] - rows["__n"]).abs()).sort_values(["gap", "__u", group])
        add = rows[["__p", "__n"]].to_numpy(float) / np.maximum(1, rows[["__p", "__n"]].sum().to_numpy(float))
        sizes, share, folds = np.zeros(k), np.zeros((k, 2)), []
        for x, n in zip(add, (rows["__p"] + rows["__n"]).tolist()):
            after = share[None] + np.eye(k)[:, :, None] * x  # [fold, folds then, class]
            spread = np.round(after.std(1).sum(1), 12)
            best = min(range(k), key=lambda f: (spread[f], sizes[f]))
            share[best] += x
            sizes[best] += n
            folds.append(best)
        return pd.DataFrame({group: rows[group], "fold": np.array(folds, np.int32)})

    return counts.groupBy(F.pmod(F.xxhash64(F.lit(seed + 1), group), F.lit(parts))).applyInPandas(deal, f"`{group}` {dict(df.dtypes)[group]}, fold int")


def fold_of_unseen(block: Column, k: int = 5) -> Column:
    """A fold for a block 'i_j' that the fold table doesn't have: (i + j) modulo k."""
    part = lambda i: F.get(F.split(block, "_"), F.lit(i)).cast("long")
    return F.pmod(part(0) + part(1), F.lit(k)).cast("int")


def bags(df: DataFrame, keys: list[str], n: int, size: int, seed: int = 42) -> DataFrame:
    """df's rows in n independent draws of `size` rows each, with `bag`."""
    every = df.withColumn("bag", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return hash_ranks(every, [*keys, "bag"], ["bag"], seed).where(F.col("rank") <= size).drop("rank")


def held_out_blocks(df: DataFrame, block: str, label: str, share: float = 0.2, seed: int = 42) -> DataFrame:
    """(block): a share of the blocks with positives, at least one. They are ranked by ranges: a limit would send as many to one task."""
    blocks = cut(df.where(F.col(label) == 1).select(block).distinct())
    n = max(1, int(round(blocks.count() * share)))
    return hash_ranks(blocks, [block], seed=seed).where(F.col("rank") <= n).select(block)


def block_bootstrap(df: DataFrame, block: str, score_a: str, score_b: str, label: str, draws: int = 1000, seed: int = 42, bins: int = 200) -> DataFrame:
    """(draw, auc_a, auc_b): paired areas under the ROC curve over blocks drawn with replacement.

    A draw weighs each block by how often it is drawn (Poisson with mean 1). Scores are counted by block and score
    once; blocks are dealt over parts of about DRAWN, and a part's counts come to all its draws in one product of
    matrices, of which only sums by draw and score are exchanged.
    """
    both = df.select(block, label, F.explode(F.array(F.struct(F.lit("a").alias("m"), F.col(score_a).alias("s")), F.struct(F.lit("b").alias("m"), F.col(score_b).alias("s")))).alias("x"))
    edge = F.coalesce(F.floor(F.col("x.s") * bins).cast("int"), F.lit(-(2**31)))  # nulls before all scores
    counts = cut(both.groupBy(block, F.col("x.m").alias("m"), edge.alias("bin")).agg(F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) == 0).alias("n")))
    parts = max(1, -(-counts.select(block).distinct().count() // DRAWN))
    # the inverse of the Poisson(1) distribution, cut at 6: what lies beyond has a share below 1e-4 and counts as 6
    limits, share, total = [], 0.36787944117144233, 0.0
    for k in range(6):
        total += share
        limits.append(total)
        share /= k + 1

    def drawn(rows: pa.Table) -> pa.Table:
        names: dict[str | None, int] = {}
        which = [names.setdefault(b, len(names)) for b in rows.column("__block").to_pylist()]
        texts = (f"{seed}:" if b is None else f"{seed}:{b}:" for b in names)  # as draw() joins them
        u = [[int(md5(f"{text}{d}".encode()).hexdigest()[:13], 16) * 2.0**-52 for d in range(draws)] for text in texts]
        weights = np.searchsorted(limits, np.array(u), "right").astype(float)  # [block, draw]
        keys, at = np.unique(np.stack([rows.column("m").to_numpy(zero_copy_only=False) == "b", rows.column("bin").to_numpy()]).astype(np.int64), axis=1, return_inverse=True)
        made = []
        for c in "pn":
            table = np.zeros((len(names), keys.shape[1]))
            np.add.at(table, (which, at.reshape(-1)), rows.column(c).to_numpy())
            made.append(np.rint(weights.T @ table).astype(np.int64).reshape(-1))
        m, at_bin = (np.tile(k, draws) for k in keys)
        return pa.table({"draw": pa.array(np.repeat(np.arange(draws), keys.shape[1]), pa.int32()), "m": pa.array(np.where(m == 1, "b", "a"), pa.string()), "bin": pa.array(at_bin, pa.int32()), "p": made[0], "n": made[1]})

    dealt = counts.select(F.col(block).cast("string").alias("__block"), "m", "bin", "p", "n", F.pmod(F.xxhash64(F.lit(seed + 1), block), F.lit(parts)).alias("__part"))
    by_bin = dealt.groupBy("__part").applyInArrow(lambda rows: drawn(rows.drop_columns("__part")), "draw int, m string, bin int, p long, n long").where("p + n > 0").groupBy("draw", "m", "bin").agg(F.sum("p").alias("p"), F.sum("n").alias("n"))
    below = Window.partitionBy("draw", "m").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)  # at most `bins` rows
    wins = by_bin.withColumn("__b", F.coalesce(F.sum("n").over(below), F.lit(0))).groupBy("draw", "m").agg(F.sum(F.col("p") * (F.col("__b") + F.col("n") / 2.0)).alias("w"), F.sum("p").alias("p"), F.sum("n").alias("n"))
    area = F.try_divide(F.col("w"), (F.col("p") * F.col("n")).cast("double"))
    return wins.groupBy("draw").agg(F.max(F.when(F.col("m") == "a", area)).alias("auc_a"), F.max(F.when(F.col("m") == "b", area)).alias("auc_b"))


def permuted(df: DataFrame, column: str, keys: list[str], seed: int = 42) -> DataFrame:
    """df with one column's values dealt out anew among the rows."""
    return dealt_anew(df, [column], keys, seed).withColumn(column, F.col(f"__new_{column}")).drop(f"__new_{column}")


def dealt_anew(df: DataFrame, columns: list[str], keys: list[str], seed: int = 42) -> DataFrame:
    """df with __new_<c> for each of the columns, their values dealt out anew: each row has those of one other, from two sorts in all."""
    new = [f"__new_{c}" for c in columns]
    values = hash_ranks(df.select(*keys, *[F.col(c).alias(n) for c, n in zip(columns, new)]), keys, seed=seed + 1).select("rank", *new)
    return hash_ranks(df, keys, seed=seed).join(values, "rank").drop("rank")
