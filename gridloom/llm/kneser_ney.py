"""Quality classifier: an interpolated modified Kneser-Ney n-gram model of trusted text.

The model is over characters. Counts of n-grams are tables, sharded by n-gram; probabilities come from joins of
those tables, order by order. Runs of input rows form chunks. One pass over the texts writes each chunk's distinct
n-grams with their counts, packed by shard. The shards' counts make the model; a chunk's n-grams are then looked up
shard by shard, and what they come to goes to the chunk's documents, which a second pass sends there compressed. Texts fall into two halves by their hash; each half's trusted texts train a model, and every text is
scored by the model of the other half, so none is scored by a model that has seen it or a copy of it.
A document is kept if its perplexity is at most a quantile of the trusted documents' in its language.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, hot_keys, pinned_splits, salted_join, table

ORDER = 5
#: The quantile of the trusted documents' perplexities, and by what factor a document may be above it.
QUANTILE, SLACK = 0.99, 1.1
#: Width of the grid, in the logarithm of the perplexity, that quantiles are taken on.
STEP = 1e-4
#: How many standard errors of its mean log-probability a document has to be above, so that short ones aren't rejected by chance.
ERRORS = 2.0
#: Languages with fewer trusted documents than this go by the quantile of all languages.
MIN_TRUSTED = 30
#: Consecutive rows of an input partition whose n-grams are looked up together: a chunk ends once it has so many bytes or rows.
CHUNK_BYTES, CHUNK_ROWS = 32_000_000, 65_536
#: n-grams fall into so many shards for each shuffle partition of the session.
SHARDS = 2
#: Log-probabilities go to the chunks in steps of one by this, down to LEAST_LOG.
LOG_STEPS, LEAST_LOG = 1024, -31.9
#: Bins of the grid that are summed up to find where a quantile lies.
COARSE = 1000
#: More trusted ids than this are joined by an exchange, not broadcast.
MAX_BROADCAST_IDS = 4_000_000
#: Characters that are hashed at a time.
SLICE = 1 << 19
START, END = "\x02", "\x03"
CHANGED = "input partitions changed between the two passes; checkpoint the input"

_B = np.uint64(0x9E3779B97F4A7C15)
_BITS = 21


def gram_hashes(text: str) -> np.ndarray:
    """A 64-bit hash of the ORDER characters from each position."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    n = max(0, len(points) - ORDER + 1)
    h = points[:n].copy()
    for k in range(1, ORDER):
        h *= _B
        h += points[k : k + n]
    h ^= h >> np.uint64(32)
    h *= _B
    return h


class GramTable:
    """n-grams by their hashes, with their places in the order they were added."""

    def __init__(self) -> None:
        self.hashes = np.zeros(0, np.uint64)
        self.slots = np.full(1 << _BITS, -1, np.int32)
        self.rest, self.rest_at = np.zeros(0, np.uint64), np.zeros(0, np.int64)  # those whose slot is taken, sorted

    def find(self, h: np.ndarray) -> np.ndarray:
        """The place of each, -1 if it was not added."""
        if not len(self.hashes):
            return np.full(len(h), -1, np.int64)
        at = self.slots[h >> np.uint64(64 - _BITS)].astype(np.int64)
        wrong = np.flatnonzero((at < 0) | (self.hashes[at] != h))
        if len(wrong):
            at[wrong] = -1
            if len(self.rest):
                i = np.minimum(np.searchsorted(self.rest, h[wrong]), len(self.rest) - 1)
                at[wrong] = np.where(self.rest[i] == h[wrong], self.rest_at[i], -1)
        return at

    def add(self, h: np.ndarray) -> None:
        """Adds distinct hashes that are not there."""
        places = np.arange(len(self.hashes), len(self.hashes) + len(h))
        self.hashes = np.r_[self.hashes, h]
        slot = h >> np.uint64(64 - _BITS)
        free = self.slots[slot] < 0
        self.slots[slot[free]] = places[free]  # of several for one slot the last stays
        lost = self.slots[slot] != places
        rest, at = np.r_[self.rest, h[lost]], np.r_[self.rest_at, places[lost]]
        order = np.argsort(rest)
        self.rest, self.rest_at = rest[order], at[order]


def parts(texts: list[str | None]):
    """(joined text, owner of each piece, start of each piece) for pieces of the framed texts, about SLICE characters at a time."""
    pieces, owners, held = [], [], 0
    for i, text in enumerate(texts):
        framed = START * (ORDER - 1) + (text or "") + END
        for at in range(0, len(framed) - ORDER + 1, SLICE):
            piece = framed[at : at + SLICE + ORDER - 1]
            pieces.append(piece)
            owners.append(i)
            held += len(piece)
            if held >= SLICE:
                yield pieces, owners
                pieces, owners, held = [], [], 0
    if pieces:
        yield pieces, owners


def grams_in(pieces: list[str]) -> tuple[str, np.ndarray, np.ndarray, np.ndarray]:
    """(joined text, positions, hashes, piece) of the n-grams that lie within one piece."""
    text = "".join(pieces)
    h = gram_hashes(text)
    length = np.array([len(p) for p in pieces])
    piece = np.repeat(np.arange(len(pieces)), length)[: len(h)]
    ends = np.cumsum(length)
    inside = np.arange(len(h)) <= ends[piece] - ORDER
    at = np.flatnonzero(inside)
    return text, at, h[at], piece[at]


def count_grams(texts: list[str | None], halves: list[int | None]) -> tuple[list[str], np.ndarray]:
    """The distinct n-grams of texts, and how often each is in the trusted ones of either half; halves: None if not trusted."""
    known, grams, counts = GramTable(), [], np.zeros((2, 0), np.int64)
    for pieces, owners in parts(texts):
        text, at, h, piece = grams_in(pieces)
        place = known.find(h)
        new = np.flatnonzero(place < 0)
        if len(new):
            fresh, first = np.unique(h[new], return_index=True)
            known.add(fresh)
            grams += [text[i : i + ORDER] for i in at[new[first]].tolist()]
            place[new] = known.find(h[new])
            counts = np.c_[counts, np.zeros((2, len(grams) - counts.shape[1]), np.int64)]
        for half in (0, 1):
            weight = np.array([halves[o] == half for o in owners], float)[piece]
            counts[half] += np.bincount(place, weights=weight, minlength=len(grams)).astype(np.int64)
    return grams, counts


def squeeze(data: bytes, level: int = 3) -> bytes:
    return zstandard.ZstdCompressor(level=level).compress(data)


def unsqueeze(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def packed(grams: list[str], counts: np.ndarray, shards: int) -> list[tuple[int, bytes, bytes]]:
    """(shard, n-grams one after the other in order, their counts in either half), compressed, for each shard that has any."""
    order = np.array(sorted(range(len(grams)), key=grams.__getitem__), np.int64)
    hashes = gram_hashes("".join(grams))[::ORDER]
    shard = ((hashes >> np.uint64(20)) % np.uint64(shards)).astype(np.int64)[order]
    order = order[np.argsort(shard, kind="stable")]
    edge = np.r_[0, np.cumsum(np.bincount(shard, minlength=shards))]
    return [
        (k, squeeze("".join([grams[i] for i in order[a:b].tolist()]).encode()), squeeze(counts[:, order[a:b]].astype(np.int32).tobytes()))
        for k, (a, b) in enumerate(zip(edge, edge[1:])) if b > a
    ]


def score_texts(texts: list[str | None], halves: np.ndarray, grams: str, logs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sum of the n-grams' log-probabilities, sum of their squares, number of n-grams) of each text.

    grams: one after the other; logs: [half, n-gram], by the model of either half; halves: of each text, which is
    scored by the other's.
    """
    known = GramTable()
    known.add(gram_hashes(grams)[::ORDER])
    total, squares, n = np.zeros(len(texts)), np.zeros(len(texts)), np.zeros(len(texts))
    for pieces, owners in parts(texts):
        _, _, h, piece = grams_in(pieces)
        owner, place = np.asarray(owners)[piece], known.find(h)
        if len(place) and place.min() < 0:
            raise ValueError(CHANGED)
        log = logs[1 - halves[owner], place]
        total += np.bincount(owner, weights=log, minlength=len(texts))
        squares += np.bincount(owner, weights=log * log, minlength=len(texts))
        n += np.bincount(owner, minlength=len(texts))
    return total, squares, n


def discounts(counts: DataFrame) -> dict[str, float]:
    """The discounts d1, d2, d3 of counts 1, 2 and 3 or more in either half, from the numbers of n-grams seen 1 to 4 times."""
    row = counts.agg(*[F.count_if(F.col(f"c{h}") == n).alias(f"n{n}_{h}") for h in (0, 1) for n in (1, 2, 3, 4)]).first()
    out = {}
    for h in (0, 1):
        n = [row[f"n{k}_{h}"] for k in (1, 2, 3, 4)]
        y = n[0] / max(1, n[0] + 2 * n[1])
        for k in (1, 2, 3):
            d = k - (k + 1) * y * n[k] / n[k - 1] if n[k - 1] else 0.5 * k
            out[f"d{k}_{h}"] = min(max(d, 0.1), k - 0.05)
    return out


def log_probabilities(counts: DataFrame) -> DataFrame:
    """(shard, gram, p0, p1): the probability of each n-gram's last character given those before it, by either half's model.

    counts: (shard, gram, c0, c1), all n-grams that are looked up, with their counts in the halves' trusted documents.
    Lower orders count distinct continuations. Level by level, a probability is the discounted share of its count
    plus the context's left-over mass times the probability of one order less; a context that the half has not
    seen hands on the lower order whole. Order 0 is uniform over the characters and an unknown one.
    """
    levels = {ORDER: counts}
    for k in range(ORDER - 1, 0, -1):
        seen = [F.count_if(F.col(f"c{h}") > 0).alias(f"c{h}") for h in (0, 1)]
        levels[k] = cut(levels[k + 1].groupBy(F.substring("gram", 2, k).alias("gram")).agg(*seen))
    uniform = F.lit(1 / (levels[1].count() + 1))
    p = None
    for k in range(1, ORDER + 1):
        d = discounts(levels[k])
        shard, around = ["shard"] if k == ORDER else [], Window.partitionBy(F.substring("gram", 1, k - 1))  # no more rows than characters

        def parts_of(h: int) -> list[Column]:
            """own and rest: a probability is its n-gram's own part and that of one order less, times the rest."""
            c = F.col(f"c{h}")
            gone = F.when(c >= 3, d[f"d3_{h}"]).when(c == 2, d[f"d2_{h}"]).when(c == 1, d[f"d1_{h}"]).otherwise(0.0)
            total = F.sum(c).over(around)
            return [F.when(total > 0, (c - gone) / total).otherwise(0.0).alias(f"own{h}"), F.when(total > 0, F.sum(gone).over(around) / total).otherwise(1.0).alias(f"rest{h}")]

        grams = levels[k].select(*shard, "gram", *parts_of(0), *parts_of(1))
        lower = [uniform, uniform]
        if k > 1:
            grams = grams.withColumn("suffix", F.substring("gram", 2, k - 1)).join(p.withColumnRenamed("gram", "suffix"), "suffix")
            lower = [F.col("p0"), F.col("p1")]
        p = grams.select(*shard, "gram", *[(F.col(f"own{h}") + F.col(f"rest{h}") * lower[h]).alias(f"p{h}") for h in (0, 1)])
        if k < ORDER:
            p = cut(p)
    return p


def perplexities(df: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(doc_id, text_hash, lang, trusted, perplexity, error of its logarithm): one row a row of df. trusted: a table of doc_id.

    df must be read twice alike (a scan within pinned_splits, or a checkpoint): chunks are runs of rows of its
    partitions. Should they differ in the second pass, the job ends with an error. Texts longer than a chunk are a
    chunk of their own, read piece by piece.
    """
    spark, kind = df.sparkSession, dict(df.dtypes)[id_col]
    rows = df.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("")).alias("lang"), F.col(f"`{text_col}`").alias("text"))
    good = cut(trusted.select(F.col("doc_id").cast(kind).alias("__id")).where("__id is not null").distinct())
    few = good.count() <= MAX_BROADCAST_IDS
    docs = rows.join(F.broadcast(good) if few else good, F.col("doc_id") == F.col("__id"), "left").select("doc_id", "lang", F.col("__id").isNotNull().alias("trusted"), "text")
    if not few:
        docs = cut(docs)
    th = F.xxhash64("text")
    docs = docs.select("doc_id", th.alias("text_hash"), "lang", "trusted", F.pmod(th, F.lit(2)).cast("int").alias("half"), "text")
    shards = SHARDS * int(spark.conf.get("spark.sql.shuffle.partitions"))

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Table]]:
        chunk, held, size, n = TaskContext.get().partitionId() << 33, [], 0, 0
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                held.append(part)
                size, n = size + part.column("text").nbytes, n + part.num_rows
                if size >= CHUNK_BYTES or n >= CHUNK_ROWS:
                    yield chunk, pa.Table.from_batches(held)
                    chunk, held, size, n = chunk + 1, [], 0, 0
        if held:
            yield chunk, pa.Table.from_batches(held)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, own in chunks(batches):
            half = [h if good else None for h, good in zip(own.column("half").to_pylist(), own.column("trusted").to_pylist())]
            found = packed(*count_grams(own.column("text").to_pylist(), half), shards)
            yield pa.RecordBatch.from_arrays(
                [pa.array([chunk] * len(found), pa.int64()), pa.array([x[0] for x in found], pa.int32()), pa.array([x[1] for x in found], pa.binary()), pa.array([x[2] for x in found], pa.binary())],
                names=["chunk", "shard", "grams", "counts"],
            )

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, own in chunks(batches):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, own.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=6))) as out:
                out.write_table(own.combine_chunks())
            yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["chunk", "docs"])

    wanted = cut(docs.mapInArrow(count, "chunk long, shard int, grams binary, counts binary"))

    def total(key: tuple, t: pa.Table) -> pa.Table:
        grams = "".join(unsqueeze(g).decode() for g in t.column("grams").to_pylist())
        counts = np.concatenate([np.frombuffer(unsqueeze(c), np.int32).reshape(2, -1) for c in t.column("counts").to_pylist()], axis=1)
        _, first, inverse = np.unique(gram_hashes(grams)[::ORDER], return_index=True, return_inverse=True)
        sums = [np.bincount(inverse, weights=c, minlength=len(first)).astype(np.int64) for c in counts]
        return pa.table({"shard": pa.array([key[0].as_py()] * len(first), pa.int32()), "gram": [grams[ORDER * i : ORDER * (i + 1)] for i in first.tolist()], "c0": sums[0], "c1": sums[1]})

    counts = cut(wanted.select("shard", "grams", "counts").groupBy("shard").applyInArrow(total, "shard int, gram string, c0 long, c1 long"))
    steps = [F.round(F.greatest(F.log(f"p{h}"), F.lit(LEAST_LOG)) * LOG_STEPS).cast("short").alias(f"l{h}") for h in (0, 1)]
    p = log_probabilities(counts).select("shard", "gram", *steps)

    def look_up(left: pa.Table, right: pa.Table) -> pa.Table:
        hashes = gram_hashes("".join(right.column("gram").to_pylist()))[::ORDER]
        order = np.argsort(hashes)
        hashes, logs = hashes[order], np.stack([right.column(f"l{h}").to_numpy()[order] for h in (0, 1)])
        found = [squeeze(logs[:, np.searchsorted(hashes, gram_hashes(unsqueeze(g).decode())[::ORDER])].tobytes()) for g in left.column("grams").to_pylist()]
        return pa.table({"chunk": left.column("chunk"), "grams": left.column("grams"), "logs": pa.array(found, pa.binary())})

    looked = wanted.select("chunk", "shard", "grams").groupBy("shard").cogroup(p.groupBy("shard")).applyInArrow(look_up, "chunk long, grams binary, logs binary")

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        if left.num_rows != 1:
            raise ValueError(CHANGED)
        own = pa.ipc.open_stream(left.column("docs")[0].as_py()).read_all()
        grams = "".join(unsqueeze(g).decode() for g in right.column("grams").to_pylist())
        logs = [np.frombuffer(unsqueeze(x), np.int16).reshape(2, -1) for x in right.column("logs").to_pylist()]
        logs = np.concatenate(logs, axis=1).astype(np.float64) / LOG_STEPS if logs else np.zeros((2, 0))
        sums, squares, n = score_texts(own.column("text").to_pylist(), own.column("half").to_numpy(), grams, logs)
        mean = sums / np.maximum(n, 1)
        error = np.sqrt(np.maximum(squares / np.maximum(n, 1) - mean * mean, 0) / np.maximum(n, 1))
        return own.select(["doc_id", "text_hash", "lang", "trusted"]).append_column("perplexity", pa.array(np.exp(-mean))).append_column("error", pa.array(error))

    schema = f"doc_id {kind}, text_hash long, lang string, trusted boolean, perplexity double, error double"
    return docs.mapInArrow(send, "chunk long, docs binary").groupBy("chunk").cogroup(looked.groupBy("chunk")).applyInArrow(score, schema)


def quantiles(scored: DataFrame, share: float) -> DataFrame:
    """(lang, n, q): a quantile of each language's perplexities, from counts on a grid of STEP in their logarithm.

    Counts don't depend on the order in which they are merged, so neither does the quantile; the grid bounds them. Sums
    over COARSE bins tell where the quantile lies; only bins there are gone through.
    """
    bins = scored.groupBy("lang", F.floor(F.log("perplexity") / STEP).alias("bin")).agg(F.count("*").alias("c")).withColumn("coarse", F.floor(F.col("bin") / COARSE))
    w = Window.partitionBy("lang")
    wide = bins.groupBy("lang", "coarse").agg(F.sum("c").alias("c"))
    wide = wide.select("lang", "coarse", F.sum("c").over(w.orderBy("coarse")).alias("up_to"), (F.sum("c").over(w.orderBy("coarse")) - F.col("c")).alias("before"), F.sum("c").over(w).alias("n"))
    wide = wide.withColumn("need", F.ceil(F.col("n") * share)).where("before < need AND need <= up_to").drop("up_to")
    near = bins.join(wide, ["lang", "coarse"]).select("lang", "bin", "n", "need", (F.sum("c").over(w.orderBy("bin")) + F.col("before")).alias("up_to"))
    at = near.where("up_to >= need").groupBy("lang").agg(F.min("bin").alias("bin"), F.first("n").alias("n"))
    return at.select("lang", "n", F.exp((F.col("bin") + 1) * STEP).alias("q"))


def classify(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(doc_id, text_hash, lang, perplexity, threshold, kept): one row a row of df.

    labels: doc_id and quality; rows of quality 1 name the trusted documents, of which all are used. The
    threshold is the QUANTILE of the perplexities of its language's trusted documents (of all trusted ones if the
    language has fewer than MIN_TRUSTED) times SLACK, and as much more as ERRORS standard errors of the
    document's own mean log-probability. Without trusted documents nothing is rejected. A null or empty text
    is its end mark alone; a very long one is read whole; a null language is the language ''; repeated rows are scored alike; a null id is never
    trusted; other columns of df are not read. An empty df gives no rows.
    """
    with pinned_splits(df.sparkSession):
        scored = cut(perplexities(df, labels.where("quality = 1"), id_col, text_col, lang_col))  # figures only, no texts
    good = scored.where("trusted")
    every = quantiles(good.withColumn("lang", F.lit("")), QUANTILE).first()
    of_lang = quantiles(good, QUANTILE).where(F.col("n") >= MIN_TRUSTED)
    hot = hot_keys(scored.groupBy("lang").agg(F.count("*").alias("n")), ["lang"], "n")
    scored = salted_join(scored, of_lang.select("lang", "q"), ["lang"], hot, F.col("text_hash"), "left")
    limit = F.coalesce("q", F.lit(every["q"] if every else float("inf")))
    threshold = limit * SLACK * F.exp(ERRORS * F.col("error"))
    return scored.select("doc_id", "text_hash", "lang", "perplexity", threshold.alias("threshold"), (F.col("perplexity") <= threshold).alias("kept"))


def op8_quality_classifier(spark, sf_dir: str) -> DataFrame:
    found = classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", "lang", F.round("perplexity", 6).alias("perplexity"), F.round("threshold", 6).alias("threshold"), "kept")


QUERIES = {"op8_quality_classifier": op8_quality_classifier}
ORACLES: dict[str, str] = {}
