"""Benchmark decontamination by q-gram lemma filtering and banded alignment.

Benchmark items are cut into overlapping segments. Where a text holds a segment of m characters with at most e
edits, it shares with it at least r - q * e of any r of the segment's q-grams, all on diagonals (position in the
text minus position in the item) that differ by at most 2e. So shared q-grams are counted in overlapping
bands of diagonals; a band that meets the bound is verified by an alignment within the band. q is chosen by the
length of the segment so that the bound is 1 at least: no match within the budget is lost at any length.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, map_rows, n_blocks, table

#: The longest q-grams; segments whose bound would not be positive take shorter ones.
Q = 10
#: Edits allowed, as a share of a segment's characters.
EDIT_RATE = 0.07
#: Items longer than a segment are cut into segments of so many characters, STRIDE apart: a run of SEGMENT + STRIDE - 1
#: characters of an item always holds a whole segment.
SEGMENT, STRIDE = 80, 16
#: Items of fewer characters are no evidence.
MIN_CHARS = 20
#: q-grams found in more places of the index are left out where the bound stays positive without them.
COMMON = 8
#: Characters of benchmark text that are indexed and broadcast at a time; a larger benchmark takes more passes.
MAX_PART_CHARS = 4_000_000
#: Code points that are hashed at a time, and of documents that are searched together.
SLICE, TOGETHER = 1 << 15, 1 << 16

_MULT = np.uint64(0x9E3779B97F4A7C15)
#: Stands between documents that are searched together, more often than any budget; texts have a space in its place.
_GAP = "￿" * (int(SEGMENT * EDIT_RATE) + 2)


def budget_of(length: int) -> int:
    return int(length * EDIT_RATE)


def q_of(length: int) -> int:
    """The longest q up to Q for which length - q + 1 q-grams are more than q times the budget."""
    return min(Q, length // (budget_of(length) + 1))


@cache
def folding() -> np.ndarray:
    """By code point its lower case, whatever stands beside it, and a space for every white-space character.

    A code point whose lower case is longer stays; the final sigma is a sigma, so that it does not matter where a word ends.
    """
    table = np.arange(0x110000, dtype=np.uint32)
    for point in range(0x110000):
        c = chr(point)
        low = c.lower()
        if c.isspace():
            table[point] = 32
        elif low != c and len(low) == 1:
            table[point] = ord(low)
    table[0x3C2] = 0x3C3
    return table


def codes(text: str) -> np.ndarray:
    """Code points of the text, folded one by one."""
    return folding()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]


def normal(text: str) -> np.ndarray:
    return codes(text.replace("￿", " "))


def gram_hashes(points: np.ndarray, q: int) -> np.ndarray:
    """A 64-bit hash of the q code points from each position, by doubling."""
    n = len(points) - q + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    by_width, width, h = {1: points.astype(np.uint64)}, 1, None
    power = {1: _MULT}
    while width * 2 <= q:
        a = by_width[width]
        by_width[width * 2] = a[:-width] * power[width] + a[width:]
        power[width * 2] = np.uint64(int(power[width]) ** 2 % 2**64)
        width *= 2
    done = 0
    for w in sorted(by_width, reverse=True):
        if q - done >= w:
            part = by_width[w][done : done + n]
            h = part.copy() if h is None else h * power[w] + part
            done += w
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def starts_of(length: int) -> list[int]:
    """Where an item's segments start; one no longer than a segment is a segment itself."""
    return [0] if length <= SEGMENT else [*range(0, length - SEGMENT, STRIDE), length - SEGMENT]


class Grams:
    """The q-grams, of one q, of distinct items: hashes in order, with their places in the items' joined text."""

    def __init__(self, q: int, items: list[tuple[np.ndarray, list[int]]]):
        """items: (code points, item numbers with this text)."""
        self.q, self.owners = q, [o for _, o in items]
        self.points = np.concatenate([p for p, _ in items])
        at = np.cumsum([0] + [len(p) for p, _ in items])
        seg = [(a + s, i, s, min(SEGMENT, len(p))) for i, ((p, _), a) in enumerate(zip(items, at.tolist())) for s in starts_of(len(p))]
        #: Of each segment its place in the joined text, its item, its place in the item, its length and budget.
        self.start, self.item, self.offset, self.length = (np.array(x, np.int64) for x in zip(*seg))
        self.budget = np.array([budget_of(m) for m in self.length.tolist()], np.int64)
        place = np.concatenate([np.arange(a, a + len(p) - q + 1) for (p, _), a in zip(items, at.tolist())])
        grams = np.concatenate([gram_hashes(p, q) for p, _ in items])
        _, inverse, count = np.unique(grams, return_inverse=True, return_counts=True)
        often = np.zeros(len(self.points) + 1, np.int64)
        often[place] = count[inverse]
        last = self.start + self.length - q  # of a segment's last gram
        keep = self.rarer(often, last)
        kept = np.r_[0, np.cumsum(keep & (often[:-1] > 0))]
        self.bound = kept[last + 1] - kept[self.start] - q * self.budget
        use = keep[place]
        order = np.argsort(grams[use], kind="stable")
        self.grams, self.place = grams[use][order], place[use][order]
        # segments that hold a gram: starts ascend, and so do ends
        self.first_seg = np.searchsorted(last, self.place, "left")
        self.segs = np.searchsorted(self.start, self.place, "right") - self.first_seg
        self.shift = np.uint64(64 - min(24, max(12, len(grams).bit_length() + 5)))
        self.sieve = np.zeros(1 << (64 - int(self.shift)), bool)
        self.sieve[self.grams >> self.shift] = True

    def rarer(self, often: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Which places of the joined text to keep: without the commonest grams that every segment around can spare."""
        votes, around = np.zeros(len(self.points), np.int64), np.zeros(len(self.points), np.int64)
        common = np.r_[0, np.cumsum(often[:-1] > COMMON)]
        for a, b, e, m in zip(self.start.tolist(), (last + 1).tolist(), self.budget.tolist(), self.length.tolist()):
            around[a:b] += 1
            spare = b - a - self.q * e - 1 - max(2, m // 16)
            if spare > 0 and common[b] > common[a]:
                top = np.argsort(-often[a:b], kind="stable")[:spare] + a
                votes[top[often[top] > COMMON]] += 1
        return (votes == 0) | (votes < around)

    def candidates(self, points: np.ndarray) -> list[tuple[int, int, int]]:
        """(segment, lowest diagonal, highest diagonal) of the bands that meet the bound, overlapping ones merged."""
        at_, entry_ = [], []
        for start in range(0, len(points), SLICE):
            h = gram_hashes(points[start : start + SLICE + self.q - 1], self.q)
            hit = np.flatnonzero(self.sieve[h >> self.shift])
            low = np.searchsorted(self.grams, h[hit], "left")
            real = self.grams[np.minimum(low, len(self.grams) - 1)] == h[hit]
            hit, low = hit[real], low[real]
            if len(hit):
                n = np.searchsorted(self.grams, h[hit], "right") - low
                entry_.append(np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum()))
                at_.append(np.repeat(hit + start, n))
        if not at_:
            return []
        entry = np.concatenate(entry_)
        n = self.segs[entry]
        diagonal = np.repeat(np.concatenate(at_) - self.place[entry], n)
        seg = np.repeat(self.first_seg[entry] - np.cumsum(n) + n, n) + np.arange(n.sum())
        cell = diagonal // (2 * self.budget[seg] + 1)
        order = np.lexsort((cell, seg))
        seg, cell = seg[order], cell[order]
        edge = np.flatnonzero(np.r_[True, (seg[1:] != seg[:-1]) | (cell[1:] != cell[:-1])])
        count = np.diff(np.r_[edge, len(seg)])
        seg, cell = seg[edge], cell[edge]
        neighbour = np.r_[(seg[1:] == seg[:-1]) & (cell[1:] == cell[:-1] + 1), False]
        both = count + np.where(neighbour, np.r_[count[1:], 0], 0)  # a band is a cell and the next
        before = np.r_[False, neighbour[:-1]]
        ok = (both >= self.bound[seg]) | ~before & (count >= self.bound[seg])
        found: list[tuple[int, int, int]] = []
        for s, c, two in zip(seg[ok].tolist(), cell[ok].tolist(), neighbour[ok].tolist()):
            w = 2 * int(self.budget[s]) + 1
            low, high = c * w, (c + 1 + two) * w - 1
            if found and found[-1][0] == s and low <= found[-1][2] + 1:
                found[-1] = s, found[-1][1], high
            else:
                found.append((s, low, high))
        return found

    def matches(self, points: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """(item, start in the item, edits, start, end) of the segments found, code points."""
        out = []
        for s, low, high in self.candidates(points):
            g, m, e = int(self.start[s]), int(self.length[s]), int(self.budget[s])
            segment = self.points[g : g + m]
            low, high = low + g, high + g  # where the segment would start
            exact = next((t for t in range(max(0, low), min(high, len(points) - m) + 1) if np.array_equal(points[t : t + m], segment)), None)
            a, b = max(0, low - e), min(len(points), high + m + e + 1)
            found = (0, exact - a, exact - a + m) if exact is not None else banded(segment, points[a:b], low - a, high - a, e)
            if found:
                out += [(item, int(self.offset[s]), found[0], found[1] + a, found[2] + a) for item in self.owners[self.item[s]]]
        return out


class Index:
    """Grams of all items, by q."""

    def __init__(self, items: list[tuple[int | None, str]], min_chars: int = MIN_CHARS):
        self.ids, by_text = [i for i, _ in items], {}
        for n, (_, text) in enumerate(items):
            if len(text) >= max(1, min_chars):
                by_text.setdefault(normal(text).tobytes(), []).append(n)
        by_q: dict[int, list] = {}
        for raw, owners in sorted(by_text.items()):
            points = np.frombuffer(raw, np.uint32)
            by_q.setdefault(q_of(min(SEGMENT, len(points))), []).append((points, owners))
        self.grams = [Grams(q, group) for q, group in sorted(by_q.items())]

    def search(self, texts: list[str | None]) -> list[tuple[int, int | None, int, int, int, int]]:
        """(place of the text, item id, start in the item, edits, start, end) of every segment found, texts searched together."""
        out, held, size = [], [], 0

        def done() -> None:
            joined = _GAP.join(t for _, t in held)
            starts = np.cumsum([0] + [len(t) + len(_GAP) for _, t in held])
            points = codes(joined)
            for grams in self.grams:
                for item, start, edits, a, b in grams.matches(points):
                    k = int(np.searchsorted(starts, a, "right")) - 1
                    out.append((held[k][0], self.ids[item], start, edits, a - int(starts[k]), b - int(starts[k])))
            held.clear()

        for i, text in enumerate(texts):
            if text and self.grams:
                held.append((i, text.replace("￿", " ")))
                size += len(text)
                if size >= TOGETHER:
                    done()
                    size = 0
        if held:
            done()
        return out


def banded(segment: np.ndarray, window: np.ndarray, low: int, high: int, budget: int) -> tuple[int, int, int] | None:
    """(edits, start, end) of the best occurrence of the segment in the window, or None if beyond the budget.

    Edit distance with free ends in the window, over the diagonals low - budget to high + budget only; of equal
    ones the first to end, then the longest.
    """
    m, n = len(segment), len(window)
    first, last = low - budget, high + budget
    span, far = last - first + 1, m + n + 1
    shift = np.arange(span)
    col = first + shift  # window characters used, at row 0
    cost = np.where((col >= 0) & (col <= n), 0, far)
    start = col.copy()
    for i in range(1, m + 1):
        col = first + shift + i
        inside = (col >= 0) & (col <= n)
        ch = window[np.clip(col - 1, 0, max(0, n - 1))] if n else np.zeros(span, np.uint32)
        along = cost + np.where((col >= 1) & (ch == segment[i - 1]), 0, 1)
        along[col < 1] = far
        up = np.r_[cost[1:], far] + 1
        best = np.minimum(along, up)
        origin = np.where(along <= up, start, np.r_[start[1:], 0])
        best[~inside] = far
        flat = best - shift  # a window character more: from the left, one edit each
        low_flat = np.minimum.accumulate(flat)
        source = np.maximum.accumulate(np.where(flat == low_flat, shift, 0))
        cost, start = low_flat + shift, origin[source]
        cost[~inside] = far
        if cost.min() > budget:
            return None
    j = int(cost.argmin())
    return int(cost[j]), int(start[j]), int(first + j + m)


def find_benchmark(
    df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", min_chars: int = MIN_CHARS, part_chars: int = MAX_PART_CHARS
) -> DataFrame:
    """(doc_id, text_hash, item_id, item_start, edits, start, end): one row for each segment found in each row of df.

    Positions are code points. Null and empty texts hold nothing; very long texts are searched whole, slice by slice;
    items that are null or shorter than min_chars are no evidence and never found; equal items are each reported;
    repeated rows of df are each searched; null ids are kept; other columns of either table are not read. Empty
    tables give no rows. A benchmark of more than part_chars characters is searched part by part, one index in memory
    at a time.
    """
    kind, item_kind = dict(df.dtypes)[id_col], dict(benchmark.dtypes)[item_col]
    items = benchmark.select(F.col(f"`{item_col}`").alias("item"), F.col(f"`{item_text_col}`").alias("text")).where("text is not null")
    parts = n_blocks(int(items.agg(F.sum(F.length("text"))).first()[0] or 0), part_chars)
    docs = df.select(F.col(f"`{id_col}`").alias("doc_id"), F.xxhash64(F.col(f"`{text_col}`")).alias("text_hash"), F.col(f"`{text_col}`").alias("text"))
    schema = f"doc_id {kind}, text_hash long, item_id {item_kind}, item_start int, edits int, start int, end int"
    names = [x.split()[0] for x in schema.split(", ")]

    def searched(part: int) -> tuple[DataFrame, Callable[[], None]]:
        own = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(parts)) == part)
        index = df.sparkSession.sparkContext.broadcast(Index([(r["item"], r["text"]) for r in own.collect()], min_chars))  # bounded: one part

        def search(cols: dict[str, list]) -> dict[str, list]:
            rows = [(cols["doc_id"][i], cols["text_hash"][i], *m) for i, *m in index.value.search(cols["text"])]
            return dict(zip(names, zip(*rows))) if rows else {n: [] for n in names}

        return map_rows(docs, search, schema), index.destroy

    if parts == 1:
        return searched(0)[0]
    found = None
    for part in range(parts):
        rows, release = searched(part)
        rows = cut(rows)
        release()
        found = rows if found is None else found.unionByName(rows)
    return found


def op4_decontaminate(spark, sf_dir: str) -> DataFrame:
    found = find_benchmark(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.groupBy("doc_id", "item_id").agg(
        F.count("*").cast("long").alias("n_segments"), F.min("edits").alias("least_edits"), F.min("start").alias("first_start"), F.max("end").alias("last_end")
    )


QUERIES = {"op4_decontaminate": op4_decontaminate}
ORACLES: dict[str, str] = {}
