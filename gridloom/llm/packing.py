"""Variable-capacity best-fit packing of documents into training sequences of several permitted lengths."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, n_blocks, table

#: Permitted sequence lengths, in words with one end mark a document.
LENGTHS = (512, 1024, 2048, 4096)
#: A sequence costs its length, a fixed part, and a part for attention that is as large as the length at this length.
OVERHEAD, ATTENTION = 16, 16_384
#: How many of the emptiest bins are packed again together, in turn, and how often.
TAILS, AGAIN = (64, 24, 8, 4, 2), 4
#: Documents that are packed together, on average; each block is packed by itself.
BLOCK_ROWS = 20_000


def open_cost(length: int, load: int) -> float:
    """The cost of a bin of this length for each word of a load that it may come to hold."""
    return (length + length * length / ATTENTION + OVERHEAD) / load


def best_fit(sizes: list[int], lengths: tuple[int, ...] = LENGTHS) -> tuple[list[int], list[int], list[int]]:
    """(bin of each item, load of each bin, length of each bin) for sizes of 1 to max(lengths), the bins of opened_fit
    downsized to the smallest length that holds their contents."""
    where, load, _ = opened_fit(sizes, lengths)
    return where, load, downsized(load, lengths)


def opened_fit(sizes: list[int], lengths: tuple[int, ...] = LENGTHS) -> tuple[list[int], list[int], list[int]]:
    """(bin of each item, load of each bin, length that each bin was opened with).

    Items go from large to small (ties in their order) to the open bin with the least room that takes them,
    ties to the oldest bin. Where none does, a new bin opens: of the lengths that hold the item, the one that
    costs least for each word it could be filled with from the items still to come.
    """
    lengths = tuple(sorted(lengths))
    order = sorted(range(len(sizes)), key=lambda i: -sizes[i])
    left = sum(sizes)
    where, load, length, room = [0] * len(sizes), [], [], []  # room: (space, bin), sorted
    for i in order:
        size = sizes[i]
        at = bisect_left(room, (size, -1))
        if at < len(room):
            _, b = room.pop(at)
        else:
            b = len(load)
            load.append(0)
            length.append(min((x for x in lengths if x >= size), key=lambda x: (open_cost(x, min(x, left)), -x)))
        where[i] = b
        load[b] += size
        left -= size
        if load[b] < length[b]:
            insort(room, (length[b] - load[b], b))
    return where, load, length


class Remaining:
    """Counts of the items that no bin holds or has planned for yet, by size."""

    def __init__(self, sizes: list[int], longest: int):
        self.free, self.planned = [0] * (longest + 1), [0] * (longest + 1)
        for x in sizes:
            self.free[x] += 1
        self.below = [x if n else x - 1 for x, n in enumerate(self.free)]  # towards the next size with free items
        self.below[0] = 0

    def largest(self, size: int) -> int:
        """The largest size up to this one that has free items, 0 without one."""
        end = size
        while end and not self.free[end]:
            end = self.below[end] if self.below[end] < end else end - 1
        while size > end:
            size, self.below[size] = (self.below[size] if self.below[size] < size else size - 1), end
        return end

    def plan(self, room: int) -> list[tuple[int, int]]:
        """(size, how many) that would fill a room, from large to small."""
        out, size = [], self.largest(room)
        while size:
            n = min(self.free[size], room // size)
            out.append((size, n))
            room -= n * size
            size = self.largest(min(room, size - 1))
        return out

    def take(self, size: int) -> None:
        """An item goes to a bin that is open: one that was planned for, if there is one."""
        of = self.planned if self.planned[size] else self.free
        of[size] -= 1

    def reserve(self, plan: list[tuple[int, int]]) -> None:
        for size, n in plan:
            self.free[size] -= n
            self.planned[size] += n


def planned_fit(sizes: list[int], lengths: tuple[int, ...] = LENGTHS) -> tuple[list[int], list[int], list[int]]:
    """As best_fit, but a new bin takes the length that costs least for each word of the load that it would reach: its
    item and the best fill by items still to come that no open bin has planned for. Items go to the fullest bin whatever
    was planned, so a bin may stay emptier than its plan; lengths are those that bins were opened with."""
    lengths = tuple(sorted(lengths))
    remaining = Remaining(sizes, max(lengths))
    where, load, length, room = [0] * len(sizes), [], [], []
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        size = sizes[i]
        at = bisect_left(room, (size, -1))
        remaining.take(size)
        if at < len(room):
            _, b = room.pop(at)
        else:
            b = len(load)
            plans = {x: remaining.plan(x - size) for x in lengths if x >= size}
            best = min(plans, key=lambda x: (open_cost(x, size + sum(a * n for a, n in plans[x])), -x))
            remaining.reserve(plans[best])
            load.append(0)
            length.append(best)
        where[i] = b
        load[b] += size
        if load[b] < length[b]:
            insort(room, (length[b] - load[b], b))
    return where, load, length


def downsized(load: list[int], lengths: tuple[int, ...] = LENGTHS) -> list[int]:
    """The smallest length that holds each load."""
    return [next(x for x in sorted(lengths) if x >= n) for n in load]


def total_cost(lengths: list[int]) -> float:
    return sum(open_cost(n, 1) for n in lengths)


def tries(sizes: list[int], lengths: tuple[int, ...]) -> list[tuple[list[int], list[int], list[int]]]:
    """Packings with the lengths that bins were opened with: planned_fit, and opened_fit with all lengths, with all but the
    smallest, and so on to the largest alone."""
    return [planned_fit(sizes, lengths), *(opened_fit(sizes, lengths[k:]) for k in range(len(lengths)))]


def joint_fit(sizes: list[int], lengths: tuple[int, ...] = LENGTHS) -> tuple[list[int], list[int], list[int]]:
    """The cheapest of several packings, every bin downsized to its contents, and its emptiest bins packed again.

    Of the bins with room left the emptiest are taken out, TAILS of them in turn, and their items are packed in every way
    of tries(): bins open large, fill, shrink to what they hold, and the cheapest way stays, if it is cheaper than what
    was there. That is done AGAIN times.
    """
    return opened_and_final(sizes, lengths)[:3]


def opened_and_final(sizes: list[int], lengths: tuple[int, ...] = LENGTHS) -> tuple[list[int], list[int], list[int], list[int]]:
    """joint_fit's bins, loads and lengths, and the lengths that the bins were opened with."""
    lengths = tuple(sorted(lengths))
    price = lambda t: total_cost(downsized(t[1], lengths))
    where, load, opened = min(tries(sizes, lengths), key=price)
    for tail in TAILS * AGAIN:
        final = downsized(load, lengths)
        loose = sorted((b for b in range(len(load)) if load[b] < final[b]), key=lambda b: (load[b] / final[b], b))[:tail]
        place = {b: k for k, b in enumerate(loose)}
        items = [i for i, b in enumerate(where) if b in place]
        new = min(tries([sizes[i] for i in items], lengths), key=price, default=None) if items else None
        if new is None or price(new) >= total_cost([final[b] for b in loose]) - 1e-9:
            continue
        number = {b: k for k, b in enumerate(b for b in range(len(load)) if b not in place)}
        where = [number.get(b, -1) for b in where]
        for i, b in zip(items, new[0]):
            where[i] = len(number) + b
        load, opened = [load[b] for b in number] + new[1], [opened[b] for b in number] + new[2]
    return where, load, downsized(load, lengths), opened


def pack(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lengths: tuple[int, ...] = LENGTHS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(doc_id, piece, first_word, n_words, bin_block, bin, bin_length, bin_load, offset): one row a piece.

    A document takes its words and one end mark. One longer than the largest length is cut into full pieces and
    a rest; every piece is packed. Rows are dealt by hash over blocks of about block_rows, equal rows by their number too;
    each block is packed by joint_fit in one task, from the sizes alone, so the result is the same however df is split.
    Null and empty texts are a piece of the end mark alone; very long ones are counted whole; repeated rows are packed
    each; null ids are kept; other columns of df are not read. An empty df gives no rows.
    """
    kind, longest = dict(df.dtypes)[id_col], max(lengths)
    rows = df.select(
        F.col(f"`{id_col}`").alias("doc_id"), (F.coalesce(F.regexp_count(F.col(f"`{text_col}`"), F.lit(WORD)), F.lit(0)) + 1).cast("long").alias("size"),
        F.xxhash64(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")).alias("h"),
    )
    blocks = n_blocks(df.count(), block_rows)
    # equal rows are counted and numbered, so that many of them spread over blocks
    rows = rows.groupBy("doc_id", "size", "h").agg(F.count("*").alias("n")).withColumn("k", F.explode(F.sequence(F.lit(1).cast("long"), "n")))
    rows = rows.select("doc_id", "size", "h", F.pmod(F.xxhash64("h", "k"), F.lit(blocks)).cast("int").alias("block"))
    schema = f"doc_id {kind}, piece int, first_word long, n_words long, bin_block int, bin long, bin_length int, bin_load long, offset long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches]
        cols = {n: [x for b in got for x in b.column(n).to_pylist()] for n in ("doc_id", "size", "h", "block")}
        order = sorted(range(len(cols["h"])), key=lambda i: (cols["h"][i], cols["size"][i], cols["doc_id"][i] is None, cols["doc_id"][i] or 0))
        out: list[tuple] = []
        for i in order:
            for k in range(-(-cols["size"][i] // longest)):
                out.append((cols["doc_id"][i], k, k * longest, min(longest, cols["size"][i] - k * longest)))
        where, load, length = joint_fit([x[3] for x in out], lengths)
        filled, offsets = [0] * len(load), []
        for x, b in zip(out, where):
            offsets.append(filled[b])
            filled[b] += x[3]
        names = [f.name for f in arrow]
        block = cols["block"][0] if out else 0
        columns = [*(list(c) for c in zip(*out)), [block] * len(out), where, [length[b] for b in where], [load[b] for b in where], offsets] if out else [[] for _ in names]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow)

    from pyspark.sql.pandas.types import to_arrow_schema

    fields = df.sparkSession.createDataFrame([], schema).schema
    arrow = to_arrow_schema(fields)
    return rows.groupBy("block").applyInArrow(lambda t: pa.Table.from_batches(run(iter(t.to_batches()))), fields)


def op9_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {"op9_best_fit_packing": op9_best_fit_packing}
ORACLES: dict[str, str] = {}
