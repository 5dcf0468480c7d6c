"""N-gram Jaccard join: MinHash banding for candidates, verification on full n-gram sets, classes of linked texts.

1. Each document becomes the set of its word n-grams; equal sets are one set from here on, so copies cost
   nothing more. 2. Bands of MinHash rows; sets that meet in a band bucket are candidates. Buckets are kept as
   stars, never as pairs, and joined into candidate groups. 3. The texts of candidate groups alone are read
   again and verified group by group, each pair of sets once; a large group is cut into blocks, and each pair of
   blocks is a task. Tasks give counts of links and a spanning forest, never a row a pair. 4. The forests give
   the classes.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.graph import connected_components
from .common import WORD, cut, hot_keys, map_rows, salted_join, table

N, THRESHOLD = 5, 0.8
#: Pairs at the threshold are found with this probability at least; more hashes than MAX_HASHES are not used.
RECALL, MAX_HASHES = 0.9999, 128
#: Sets, and n-grams of all sets, in one block of a candidate group or bucket.
BLOCK_SETS, BLOCK_GRAMS = 1024, 2_000_000
#: Pairs that are counted at a time.
PAIRS = 2_000_000

_word = re.compile(WORD)
_C = np.uint64(0x9E3779B97F4A7C15)


def bands_and_rows(threshold: float = THRESHOLD, recall: float = RECALL, most: int = MAX_HASHES) -> tuple[int, int]:
    """(bands, rows): of the layouts that reach the recall within `most` hashes the one with most rows, so fewest false candidates."""
    best = most, 1
    for rows in range(1, most + 1):
        bands = next((b for b in range(1, most // rows + 1) if 1 - (1 - threshold**rows) ** b >= recall), None)
        if bands:
            best = bands, rows
    return best


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Grams:
    """Hashes of the distinct word n-grams of a text; keeps the hashes of a bounded number of words."""

    MAX_KNOWN = 300_000

    def __init__(self) -> None:
        self.known: dict[str, int] = {}

    def of(self, text: str | None) -> np.ndarray:
        """Sorted 64-bit hashes; a text of fewer words than N is one n-gram of them all, one without words none."""
        words = _word.findall((text or "").lower())
        if not words:
            return np.zeros(0, np.uint64)
        known = self.known
        if len(known) > self.MAX_KNOWN:
            known.clear()
        for w in set(words).difference(known):
            known[w] = xxhash.xxh3_64_intdigest(w)
        h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        n = min(N, len(h))
        out = np.zeros(len(h) - n + 1, np.uint64)
        for k in range(n):
            out = out * _C + h[k : len(h) - n + 1 + k]
        return np.unique(mix(out + np.uint64(n)))


def minhash_bands(grams: np.ndarray, bands: int, rows: int, seeds: np.ndarray) -> np.ndarray:
    """One 64-bit hash a band: of its rows' least hashes under as many hash functions."""
    least = np.full(bands * rows, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(grams), 512):
        part = grams[at : at + 512]
        with np.errstate(over="ignore"):
            h = part[None, :] * seeds[:, :1] + seeds[:, 1:]
            h ^= h >> np.uint64(32)
        np.minimum(least, h.min(1), out=least)
    out = np.zeros(bands, np.uint64)
    table_ = least.reshape(bands, rows)
    for k in range(rows):
        out = mix(out * _C + table_[:, k])
    return out


def hash_seeds(n: int) -> np.ndarray:
    rng = np.random.default_rng(20)
    seeds = rng.integers(0, 2**63, (n, 2), dtype=np.int64).astype(np.uint64)
    seeds[:, 0] |= np.uint64(1)
    return seeds


def links_of(sets: list[np.ndarray], cross: int, threshold: float = THRESHOLD) -> np.ndarray:
    """Boolean matrix of the pairs with a Jaccard similarity of the threshold or more.

    cross: 0 for all pairs of the sets, else only those of one of the first `cross` sets with one of the rest.
    Common n-grams are counted by matrix products, n-grams of few sets pair by pair.
    """
    n, size = len(sets), np.array([len(s) for s in sets], np.float64)
    grams, owner = np.concatenate(sets), np.repeat(np.arange(n), size.astype(np.int64))
    order = np.argsort(grams, kind="stable")
    grams, owner = grams[order], owner[order]
    edge = np.flatnonzero(np.r_[True, grams[1:] != grams[:-1]])
    count = np.diff(np.r_[edge, len(grams)])
    both = np.zeros((n, n), np.float32)
    few = max(2, min(48, n // 16))
    for c in range(2, few + 1):  # n-grams of exactly c sets
        all_first = edge[count == c]
        step = max(1, PAIRS // (c * (c - 1) // 2))
        for at in range(0, len(all_first), step):
            first = all_first[at : at + step]
            own = np.stack([owner[first + k] for k in range(c)])
            flat = np.concatenate([own[i] * n + own[j] for i in range(c) for j in range(i + 1, c)])  # owners ascend
            both += np.bincount(flat, minlength=n * n).reshape(n, n)
    common = np.flatnonzero(count > few)
    for at in range(0, len(common), 2048):
        part = common[at : at + 2048]
        col = np.repeat(np.arange(len(part)), count[part])
        row = owner[np.repeat(edge[part] - np.cumsum(count[part]) + count[part], count[part]) + np.arange(count[part].sum())]
        x = np.zeros((n, len(part)), np.float32)
        x[row, col] = 1
        both += np.triu(x @ x.T, 1)
    union = size[:, None] + size[None, :] - both
    # 5 * shared >= 4 * union, without dividing
    close = (both >= threshold * union - 1e-9) & (union > 0)
    close = np.triu(close, 1)
    if cross:
        close[:cross, :cross] = False
        close[cross:, cross:] = False
    return close


def forest(close: np.ndarray) -> list[tuple[int, int]]:
    """(node, root) of the components of an upper triangular link matrix, by breadth-first search."""
    close = close | close.T
    seen, out = np.zeros(len(close), bool), []
    for root in range(len(close)):
        if seen[root]:
            continue
        seen[root] = True
        front = close[root] & ~seen
        while front.any():
            seen |= front
            out += [(int(i), root) for i in np.flatnonzero(front)]
            front = close[front].any(0) & ~seen
    return out


def blocks_of() -> list[Column]:
    """Aggregates over sets: into how many blocks they go, and how many they are."""
    return [F.ceil(F.greatest(F.count("*") / BLOCK_SETS, F.sum("grams") / BLOCK_GRAMS)).cast("int").alias("blocks"), F.count("*").alias("n")]


def bucket_units(stars: DataFrame, sets: DataFrame, placed: DataFrame, sizes: DataFrame) -> DataFrame:
    """(set, units, bands) for the sets of those groups that send fewer texts if each bucket is verified by itself."""
    inside = cut(stars.select("set", "band", "bucket").join(placed.where("blocks > 1").select("set", "label", "grams"), "set"))
    buckets = cut(inside.groupBy("band", "bucket").agg(*blocks_of(), F.any_value("label").alias("label")))  # one label a bucket
    sends = cut(buckets.groupBy("label").agg(F.sum(F.col("n") * F.col("blocks")).alias("sends")))
    cheaper = sizes.join(sends, "label").where("sends < n * blocks").select("label")
    rows = salted_join(inside, cheaper, ["label"], hot_keys(sends, ["label"], "sends"), F.struct("set", "band"))
    rows = salted_join(rows, buckets.select("band", "bucket", "blocks"), ["band", "bucket"], hot_keys(buckets, ["band", "bucket"], "n"), F.col("set"))
    units = rows.groupBy("set").agg(F.collect_list(F.struct(F.concat_ws(":", "band", "bucket").alias("unit"), "blocks", "band")).alias("units"))  # at most one a band
    return units.join(sets.select("set", "bands"), "set")


def classes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_hash, class_id, n_links, class_docs, keep): one row a row of df.

    Two rows are linked if the Jaccard similarity of their sets of N-word n-grams (lower case, words are what
    ASCII white space separates) is THRESHOLD or more; a class is what links connect. class_id: the least id of
    the class; n_links: how many other rows the row is linked with, copies included; keep: true for the rows
    whose id and text are those of the class's first row by id, then text hash. A text of fewer than N words is
    one n-gram, a very long one is taken whole; null texts and texts without words are linked with nothing and kept;
    repeated rows are copies; a null id sorts last. Other columns of df are not read. An empty df gives no rows.
    """
    kind = dict(df.dtypes)[id_col]
    bands, rows = bands_and_rows()
    seeds, grams_of = hash_seeds(bands * rows), Grams()
    docs = df.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))

    def sign(cols: dict[str, list]) -> dict[str, list]:
        sets = [grams_of.of(t) for t in cols["text"]]
        return {
            "doc_id": cols["doc_id"],
            "set": [xxhash.xxh3_128_hexdigest(s.tobytes()) if len(s) else None for s in sets],
            "grams": [len(s) for s in sets],
            "bands": [minhash_bands(s, bands, rows, seeds).view(np.int64) if len(s) else None for s in sets],
        }

    hashed = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    signed = cut(map_rows(hashed, lambda c: sign(c) | {"text_hash": c["text_hash"]}, f"doc_id {kind}, text_hash long, set string, grams int, bands array<long>"))
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash")).alias("first")
    sets = cut(signed.where("set is not null").groupBy("set").agg(F.count("*").alias("copies"), first, F.any_value("grams").alias("grams"), F.any_value("bands").alias("bands")))

    members = sets.select("set", F.posexplode("bands").alias("band", "bucket"))
    buckets = cut(members.groupBy("band", "bucket").agg(F.count("*").alias("n"), F.min("set").alias("hub")).where("n > 1"))
    stars = salted_join(members, buckets.drop("n"), ["band", "bucket"], hot_keys(buckets, ["band", "bucket"], "n"), F.col("set"))
    groups = connected_components(stars.where("set != hub").select(F.col("set").alias("a"), F.col("hub").alias("b")).distinct())

    candidates = groups.withColumnRenamed("node", "set").join(sets.select("set", "copies", "first", "grams"), "set")
    candidates = cut(candidates.select("set", "label", "copies", "grams", F.col("first.doc_id").alias("__id"), F.col("first.text_hash").alias("__th")))
    sizes = cut(candidates.groupBy("label").agg(*blocks_of()))
    placed = salted_join(candidates, sizes.select("label", "blocks"), ["label"], hot_keys(sizes, ["label"], "n"), F.col("set"))
    units = F.array(F.struct(F.col("label").alias("unit"), F.col("blocks"), F.lit(-1).alias("band")))
    if sizes.where("blocks > 1").isEmpty():  # then every group is one task as it is
        placed = placed.select("set", "copies", "__id", "__th", units.alias("units"), F.lit(None).cast("array<long>").alias("bands"))
    else:
        placed = cut(placed)
        own_units = bucket_units(stars, sets, placed, sizes).withColumnRenamed("units", "__units")
        placed = placed.join(own_units, "set", "left").select("set", "copies", "__id", "__th", F.coalesce("__units", units).alias("units"), "bands")
    texts = hashed.join(placed, F.col("doc_id").eqNullSafe(F.col("__id")) & F.col("text_hash").eqNullSafe(F.col("__th")))
    texts = texts.select("set", "copies", "text", "bands", F.inline("units"))
    block = F.pmod(F.xxhash64("set"), F.col("blocks")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(F.least(k, block).alias("i"), F.greatest(k, block).alias("j")))
    sent = texts.select("set", "unit", "band", "bands", "copies", "text", block.alias("block"), F.inline(pairs))

    def verify(t: pa.Table) -> pa.Table:
        seen: dict[str, tuple] = {}
        for s, c, b, text, own_bands in zip(*(t.column(n).to_pylist() for n in ("set", "copies", "block", "text", "bands"))):
            seen.setdefault(s, (b, s, c, text, own_bands))  # repeated rows of a representative
        own = sorted(seen.values(), key=lambda x: x[:2])
        i, j, band = (t.column(n)[0].as_py() for n in ("i", "j", "band"))
        close = links_of([grams_of.of(x[3]) for x in own], sum(x[0] == i for x in own) if i != j else 0)
        for k in range(band):  # a pair that shares an earlier band is verified there
            at = np.array([x[4][k] for x in own], np.int64)
            close &= at[:, None] != at[None, :]
        copies = np.array([x[2] for x in own], np.int64)
        linked = (close | close.T) @ copies
        rows_ = [(own[k][1], None, int(linked[k])) for k in np.flatnonzero(linked)] + [(own[a][1], own[b][1], 0) for a, b in forest(close)]
        return pa.table([pa.array(c, f.type) for c, f in zip(zip(*rows_) if rows_ else ([], [], []), arrow)], schema=arrow)

    arrow = pa.schema([("a", pa.string()), ("b", pa.string()), ("links", pa.int64())])
    verified = cut(sent.groupBy("unit", "i", "j").applyInArrow(verify, "a string, b string, links long"))
    linked = verified.where("b is null").groupBy(F.col("a").alias("set")).agg(F.sum("links").alias("links"))
    labels = connected_components(verified.where("b is not null").select("a", "b")).withColumnRenamed("node", "set")

    of_set = sets.select("set", "copies", "first").join(labels, "set", "left").withColumn("label", F.coalesce("label", "set")).join(linked, "set", "left")
    heads = of_set.groupBy("label").agg(F.min("first").alias("head"), F.sum("copies").alias("class_docs"), F.count("*").alias("n"))
    heads = cut(heads)
    of_set = cut(salted_join(of_set, heads.drop("n"), ["label"], hot_keys(heads, ["label"], "n"), F.col("set")))
    result = of_set.select("set", "head", "class_docs", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    rows_of = signed.withColumn("set", F.coalesce("set", F.lit(""))).drop("bands", "grams")
    out = salted_join(rows_of, result, ["set"], hot_keys(sets.select("set", F.col("copies").alias("n")), ["set"], "n"), F.struct("doc_id", "text_hash", F.monotonically_increasing_id()), "left")
    is_head = F.col("doc_id").eqNullSafe(F.col("head.doc_id")) & F.col("text_hash").eqNullSafe(F.col("head.text_hash"))
    return out.select(
        "doc_id", "text_hash", F.when(F.col("head").isNull(), F.col("doc_id")).otherwise(F.col("head.doc_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("class_docs", F.lit(1)).cast("long").alias("class_docs"),
        (F.col("head").isNull() | is_head).alias("keep"),
    )


def op3_ngram_jaccard(spark, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links", "class_docs")


QUERIES = {"op3_ngram_jaccard": op3_ngram_jaccard}
#: Five-word shingles of the documents, and pairs of them that are linked, over a relation `{docs}` of distinct doc_id.
LINKS_SQL = r"""
  nw AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[^\x20\x09-\x0D]+') AS w FROM {docs}),
  sh AS (SELECT DISTINCT doc_id, array_to_string(w[p + 1 : p + 5], ' ') AS g FROM (SELECT doc_id, w, unnest(range(greatest(len(w) - 4, 1))) AS p FROM nw WHERE len(w) > 0)),
  sz AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
  pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM sh a JOIN sh b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
  links AS (SELECT a, b FROM pairs JOIN sz x ON x.doc_id = a JOIN sz y ON y.doc_id = b WHERE 5 * k >= 4 * (x.n + y.n - k)),
  reach AS (SELECT DISTINCT a AS node, a AS root FROM links UNION SELECT l.b, r.root FROM reach r JOIN links l ON l.a = r.node WHERE r.root < l.b),
  cls AS (SELECT d.doc_id, least(d.doc_id, coalesce(min(r.root), d.doc_id)) AS class_id FROM {docs} d LEFT JOIN reach r ON r.node = d.doc_id GROUP BY d.doc_id)
"""
ORACLES = {
    "op3_ngram_jaccard": "WITH RECURSIVE" + LINKS_SQL.format(docs="documents") + """
SELECT c.doc_id, c.class_id, coalesce(n.n, 0)::BIGINT AS n_links, (count(*) OVER (PARTITION BY c.class_id))::BIGINT AS class_docs
FROM cls c LEFT JOIN (SELECT a, count(*) AS n FROM links GROUP BY a) n ON n.a = c.doc_id"""
}
