"""Uniform shuffle into shards of exact size, by a hypergeometric communication matrix.

A uniformly random permutation of all rows sends a random number of rows from each input partition to each
shard. Those numbers follow a multivariate hypergeometric law with both margins fixed. We draw them first
(recursive halving over the partitions), permute each partition locally, send its rows to shards by those
counts, and permute each shard again. One exchange of the rows; shard sizes differ by at most one row.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table, uniform

LAW = "rows"
N_SHARDS = 24
#: A shard of more rows than this is permuted by several tasks.
ROWS_PER_TASK = 250_000
#: A table of more bytes than this is joined by an exchange, not broadcast.
MAX_BROADCAST_BYTES = 64 << 20
CHANGED = "input partitions changed between the two readings; checkpoint the input"


def log_factorial(x: Column) -> Column:
    """ln x! by Stirling's series at x + 9, brought back by the recurrence; error below 1e-12."""
    z = x.cast("double") + 9.0
    series = (z - 0.5) * F.log(z) - z + 0.5 * math.log(2 * math.pi) + 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5)
    shift = F.lit(0.0)
    for k in range(1, 9):
        shift = shift + F.log(x.cast("double") + float(k))
    return series - shift


def let(value: Column, f) -> Column:
    """f(value), with the value made once: a one-element array as its binding."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def hypergeometric(u: Column, population: Column, good: Column, draws: Column) -> Column:
    """The number of good ones in `draws` draws without replacement: the inverse of the distribution at u.

    The walk covers nine standard deviations and twelve more on each side; beyond lies less than 1e-18.
    """
    def bounds(i: Column) -> Column:
        pop, k, n = i["pop"], i["k"], i["n"]
        share = k / F.greatest(pop, F.lit(1.0))
        sd = F.sqrt(F.greatest(F.lit(0.0), n * share * (1 - share) * (pop - n) / F.greatest(pop - 1, F.lit(1.0))))
        mode = F.floor((n + 1) * (k + 1) / (pop + 2)).cast("double")
        low, high = F.greatest(F.lit(0.0), n - (pop - k)), F.least(n, k)
        return F.struct(
            i["u"].alias("u"), pop.alias("pop"), k.alias("k"), n.alias("n"), low.alias("low"), high.alias("high"),
            F.greatest(low, F.floor(mode - 9 * sd - 12)).alias("first"), F.least(high, F.ceil(mode + 9 * sd + 12)).alias("last"),
        )

    def choose(a: Column, b: Column) -> Column:
        return log_factorial(a) - log_factorial(b) - log_factorial(a - b)

    def walk(i: Column) -> Column:
        pop, k, n, first, last = (i[c] for c in ("pop", "k", "n", "first", "last"))
        start = F.struct(F.exp(choose(k, first) + choose(pop - k, n - first) - choose(pop, n)).alias("p"), F.lit(0.0).alias("below"), first.alias("x"))

        def step(s: Column, x: Column) -> Column:
            p = s["p"] * (k - x) * (n - x) / ((x + 1) * (pop - k - n + x + 1))
            below = s["below"] + s["p"]
            return F.when(below >= i["u"], s).otherwise(F.struct(p.alias("p"), below.alias("below"), F.least(x + 1.0, last).alias("x")))

        found = F.aggregate(F.sequence(first.cast("long"), last.cast("long")), start, step, lambda s: s["x"].cast("long"))
        return F.when(i["low"] >= i["high"], i["low"].cast("long")).otherwise(found)

    given = F.struct(u.alias("u"), *[c.cast("double").alias(name) for name, c in (("pop", population), ("k", good), ("n", draws))])
    return let(let(given, bounds), walk)


def _draw(node: Column, rows: Column, capacity: Column, seed: int) -> Column:
    """How many of `rows` rows go to each shard of the given capacities: multivariate, shard by shard."""
    total = F.aggregate(capacity, F.lit(0).cast("long"), lambda a, x: a + x)
    start = F.struct(rows.cast("long").alias("rows"), total.alias("room"), F.array().cast("array<bigint>").alias("out"))

    def step(s: Column, i: Column) -> Column:
        room = F.get(capacity, i)
        x = hypergeometric(uniform(seed, node, i), s["room"], room, s["rows"])
        return let(x, lambda v: F.struct((s["rows"] - v).alias("rows"), (s["room"] - room).alias("room"), F.concat(s["out"], F.array(v)).alias("out")))

    return F.aggregate(F.sequence(F.lit(0), F.size(capacity) - 1), start, step, lambda s: s["out"])


def communication_matrix(margins: DataFrame, most: int, seed: int) -> DataFrame:
    """(block, counts): how many rows of each partition go to each shard.

    margins: one row, rows: array of (block, n), the rows of each partition, at most `most` of them; room: array of the
    rows of each shard; the sums are equal. The partitions are halved again and again; each half's share of every shard
    is drawn, so the draws of a level are independent and run in parallel.
    """
    df = margins.select(F.lit(1).cast("long").alias("node"), "rows", "room")
    for level in range(math.ceil(math.log2(max(2, most)))):
        if level in (3, 9):  # eight nodes, and again five hundred
            df = df.repartition(2 ** level, "node")
        half = F.floor(F.size("rows") / 2).cast("int")
        left = F.slice("rows", F.lit(1), half)
        n = F.aggregate(left, F.lit(0).cast("long"), lambda a, x: a + x["n"])
        df = df.withColumn("__take", F.when(F.size("rows") > 1, _draw(F.col("node"), n, F.col("room"), seed)))
        kids = F.array(
            F.struct((F.col("node") * 2).alias("node"), left.alias("rows"), F.col("__take").alias("room")),
            F.struct((F.col("node") * 2 + 1).alias("node"), F.slice("rows", half + 1, F.size("rows") - half).alias("rows"), F.zip_with("room", "__take", lambda a, b: a - b).alias("room")),
        )
        df = df.select(F.inline(F.when(F.size("rows") > 1, kids).otherwise(F.array(F.struct("node", "rows", "room")))))
    whole = F.when(F.size("rows") > 1, F.raise_error(F.lit(CHANGED)).cast("int")).otherwise(F.get("rows", F.lit(0))["block"])
    return df.where(F.size("rows") > 0).select(whole.alias("block"), F.col("room").alias("counts"))


def place_in(ends: Column, at: Column, most: int) -> Column:
    """How many of the ascending ends are at most `at`, by binary search."""

    def step(s: Column, _: Column) -> Column:
        mid = F.floor((s["lo"] + s["hi"]) / 2).cast("int")
        open_, right = s["lo"] < s["hi"], F.get(ends, mid) <= at
        return F.struct(F.when(open_ & right, mid + 1).otherwise(s["lo"]).alias("lo"), F.when(open_ & ~right, mid).otherwise(s["hi"]).alias("hi"))

    start = F.struct(F.lit(0).alias("lo"), F.size(ends).alias("hi"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(most.bit_length())), start, step, lambda s: s["lo"])


def shuffle_into_shards(df: DataFrame, key: Column, n_shards: int = N_SHARDS, rows_per_task: int = ROWS_PER_TASK, seed: int = 7) -> DataFrame:
    """df with `shard` (0 to n_shards - 1) and `slot` (gapless from 0 in each shard): a uniform shuffle.

    key: an expression over df that tells rows apart (rows with equal keys may swap places, so it should cover
    what differs). Nulls in any column are kept; very long texts travel once; repeated rows each get a slot of their own;
    an empty df gives an empty result. Input columns named shard or slot are replaced.

    One plan reads df twice (a scan, or a checkpoint): to count the rows of each partition, and to send them; a shard
    of more than rows_per_task rows is counted once more, so that several tasks can number it. Partitions that gain or
    lose rows between the readings end the job with an error.
    """
    keep = [F.col(f"`{c}`") for c in df.columns if c not in ("shard", "slot")]
    total, partitions = df.count(), max(1, df.rdd.getNumPartitions())
    tasks = max(1, math.ceil(total / n_shards / rows_per_task))
    capacity = F.array(*[F.lit(total * (j + 1) // n_shards - total * j // n_shards).cast("long") for j in range(n_shards)])
    counted = df.groupBy(F.spark_partition_id().alias("block")).agg(F.count("*").alias("n"))
    margins = counted.agg(F.sort_array(F.collect_list(F.struct("block", "n"))).alias("rows")).select("rows", capacity.alias("room"))  # a number a partition
    matrix = communication_matrix(margins, 2 * partitions, seed)
    matrix = matrix.select(
        F.col("block").alias("__block"),
        F.slice(F.aggregate("counts", F.array(F.lit(0).cast("long")), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x))), 2, n_shards).alias("__ends"),
    )
    small = lambda t, size: F.broadcast(t) if size <= MAX_BROADCAST_BYTES else t
    matrix = small(matrix, partitions * (n_shards + 4) * 8)

    def sent(row: Column) -> DataFrame:
        local = (
            df.select(row.alias("__row"), key.alias("__key"))
            .sortWithinPartitions(F.xxhash64(F.lit(seed), "__key"), "__key")
            .withColumn("__at", F.monotonically_increasing_id())
            .withColumn("__block", F.shiftright("__at", 33).cast("int"))
            .withColumn("__at", F.col("__at").bitwiseAND(F.lit((1 << 33) - 1)))
        )
        shard = F.when(F.col("__at") < F.element_at("__ends", -1), place_in(F.col("__ends"), F.col("__at"), n_shards)).otherwise(F.raise_error(F.lit(CHANGED)).cast("int"))
        draw = F.xxhash64(F.lit(seed + 1), "__key", "__block", "__at")
        return local.join(matrix, "__block", "left").select("__row", "__key", "__block", "__at", shard.alias("shard"), F.pmod(draw, F.lit(tasks)).cast("int").alias("__task"))

    w = "(partition by shard, __task order by xxhash64(%d, __key, __block, __at), __key, __block, __at)" % (seed + 2)
    placed = sent(F.struct(*keep)).select("__row", "shard", "__task", F.expr(f"row_number() over {w} - 1").cast("long").alias("slot"), F.expr(f"lead(1) over {w} is null").alias("__last"))
    full = F.get(capacity, F.col("shard"))
    if tasks > 1:  # tasks draw their rows, so where each begins in its shard has to be counted
        sizes = sent(F.lit(0)).groupBy("shard", "__task").agg(F.count("*").alias("n"))
        begins = sizes.groupBy("shard").agg(F.sort_array(F.collect_list(F.struct("__task", "n"))).alias("of"), F.sum("n").alias("n"))
        begin = F.aggregate(F.filter("of", lambda x: x["__task"] < F.col("t.__task")), F.lit(0).cast("long"), lambda a, x: a + x["n"])
        begins = begins.select("shard", "n", "of", F.explode("of").alias("t")).select("shard", F.col("t.__task").alias("__task"), begin.alias("__begin"), F.col("n").alias("__n"))
        placed = placed.join(small(begins, n_shards * tasks * 32), ["shard", "__task"])
        slot = F.when(F.col("__n") == full, F.col("slot") + F.col("__begin")).otherwise(F.raise_error(F.lit(CHANGED)).cast("long"))
    else:
        slot = F.when(~F.col("__last") | (F.col("slot") + 1 == full), F.col("slot")).otherwise(F.raise_error(F.lit(CHANGED)).cast("long"))
    return placed.select("__row.*", "shard", slot.alias("slot"))


def op2_sharding(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    shards = shuffle_into_shards(docs, F.struct(F.col("doc_id"), F.xxhash64("text")))
    return shards.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).cast("long").alias("text_crc32"),
        F.lit(LAW).alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
    )


QUERIES = {"op2_sharding": op2_sharding}
ORACLES: dict[str, str] = {}
