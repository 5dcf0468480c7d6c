"""Importance resampling towards a target distribution: hashed n-gram features, log ratios, one Gumbel draw a document.

Texts are split at word boundaries into chunks. A chunk owns the word positions it holds and carries the n-1 words that
follow, so that every n-gram belongs to the one chunk in which it begins, however long the text is. Chunks are hashed
once, into lists of buckets, and written as a table: its rows are small and even, so neither counting nor weighing
meets a long text again. Chunk counts give the two distributions; chunk weights are summed by document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ranking import ordinal_ranks
from .common import cut, table
from .spelling import CRC_SQL, LOWER, UPPER, lower_ascii

#: Words are runs of ASCII digits and letters and of everything beyond ASCII.
LETTER = r"0-9A-Za-z\x{80}-\x{10FFFF}"
#: Features are runs of 1 to N words, in so many buckets.
N, BUCKETS = 1, 10_000
#: Of the documents with MIN_WORDS words or more PERCENT in a hundred are drawn, by hashes that begin with SEED.
MIN_WORDS, PERCENT, SEED = 20, 10, "2024"
#: Characters of a chunk, which ends with a whole word.
CHUNK = 20_000


def chunks(docs: DataFrame, text_col: str, keep: list[Column], n: int = N, size: int = CHUNK) -> DataFrame:
    """keep, chunk (from 0), n_words (words the chunk owns) and words (its own, then up to n-1 that it carries).

    A text that is null or has no word has one chunk without words. A chunk has `size` characters, and the rest of its
    last word. A to Z are lower-cased.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    # what is owned, with the rest of a word that the size cuts; then, looking ahead, the words carried
    pattern = F.lit(rf"(?s)(.{{1,{size}}}[{LETTER}]*)(?=((?:[^{LETTER}]*[{LETTER}]+){{0,{n - 1}}}))")
    parts = [F.when(F.length(text) > size, F.regexp_extract_all(text, pattern, F.lit(k))).otherwise(F.array(whole)) for k, whole in ((1, text), (2, F.lit("")))]
    rows = docs.select(*keep, F.posexplode(F.arrays_zip(parts[0].alias("own"), parts[1].alias("carry"))).alias("chunk", "part"))
    own, carry = (F.transform(F.regexp_extract_all(f"part.{p}", F.lit(f"[{LETTER}]+"), F.lit(0)), lower_ascii) for p in ("own", "carry"))
    named = [c for c in rows.columns if c != "part"]
    if n == 1:
        return rows.select(*named, own.alias("words")).withColumn("n_words", F.size("words"))
    both = rows.select(*named, own.alias("own"), carry.alias("carry"))
    return both.select(*named, F.concat("own", "carry").alias("words"), F.size("own").alias("n_words"))


def bucketed(docs: DataFrame, text_col: str, keep: list[Column], n: int = N, buckets: int = BUCKETS, size: int = CHUNK) -> DataFrame:
    """keep, chunk, n_words and buckets: the bucket of each n-gram of 1 to n words that begins in the chunk."""
    rows = chunks(docs, text_col, keep, n, size)

    def grams(j: int) -> Column:
        if j == 1:
            return F.slice("words", 1, F.col("n_words"))
        last = F.least(F.col("n_words"), F.size("words") - (j - 1))
        return F.when(last > 0, F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.concat_ws(" ", F.slice("words", i, j)))).otherwise(F.array().cast("array<string>"))

    features = grams(1) if n == 1 else F.concat(*[grams(j) for j in range(1, n + 1)])
    named = [c for c in rows.columns if c != "words"]
    return rows.select(*named, F.transform(features, lambda f: (F.crc32(f) % buckets).cast("int")).alias("buckets"))


def counted(rows: DataFrame) -> DataFrame:
    """(bucket, n) over all chunks."""
    return rows.select(F.explode("buckets").alias("bucket")).groupBy("bucket").agg(F.count("*").alias("n"))


def gains(source: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> list[int]:
    """By bucket the floored 1000 ln of its smoothed share of the target over that of the source; as many numbers as buckets."""
    both = source.select("bucket", F.col("n").alias("s"), F.lit(0).alias("t")).unionByName(target.select("bucket", F.lit(0).alias("s"), F.col("n").alias("t")))
    found = both.groupBy("bucket").agg(F.sum("s").cast("double").alias("s"), F.sum("t").cast("double").alias("t"))
    totals = found.agg(F.sum("s").alias("s"), F.sum("t").alias("t")).first()
    all_s, all_t = (F.lit((x or 0.0) + buckets) for x in totals)
    each = found.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket")).join(found, "bucket", "left").na.fill(0.0)
    ratio = (F.col("t") + 1) * all_s / ((F.col("s") + 1) * all_t)
    return [r["gain"] for r in each.select("bucket", F.floor(1000 * F.log(ratio)).alias("gain")).orderBy("bucket").collect()]


def resample(
    docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", n: int = N, buckets: int = BUCKETS,
    min_words: int = MIN_WORDS, percent: int = PERCENT, seed: str = SEED, size: int = CHUNK,
) -> DataFrame:
    """(id, n_features, weight, score, rank), all long but the id: a row for each row of docs.

    weight: the floored mean of the gains of the text's features, 0 without any; score: weight and a Gumbel draw by the
    id's hash, in thousandths; rank: 1, 2, ... down from the highest score (ties: smaller id, then text hash) for the
    percent in a hundred that are drawn of the documents with min_words words or more, null for the others. Null texts
    have no words; a null id is hashed as nothing and sorts first; rows that repeat id and text have the same score and
    ranks one after another; other columns, whatever their names, are not read. With an empty target the gains come from
    smoothing alone; an empty table gives no rows.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    keep = [F.col(f"`{id_col}`").alias("id"), F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(1), text).alias("h2")]
    hashed = cut(bucketed(docs, text_col, keep, n, buckets, size))
    gain = gains(counted(hashed), counted(bucketed(target, target_col, [], n, buckets, size)), buckets)
    by_bucket = F.split(F.lit(",".join(map(str, gain))), ",").cast("array<bigint>")  # as many as there are buckets
    weighed = hashed.select("id", "h1", "h2", "chunk", "n_words", F.size("buckets").alias("k"), F.aggregate("buckets", F.lit(0).cast("long"), lambda a, b: a + F.get(by_bucket, b)).alias("w"))
    # rows that repeat an id and text come together here: as many as there are first chunks
    sums = weighed.groupBy("id", "h1", "h2").agg(*[F.sum(c).alias(c) for c in ("n_words", "k", "w")], F.count_if(F.col("chunk") == 0).alias("copies"))
    each = sums.select("id", "h1", "h2", *[F.expr(f"{c} div copies").alias(c) for c in ("n_words", "k", "w")], F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("copy"))
    weight = F.when(F.col("k") > 0, F.expr("(w - pmod(w, k)) div k")).otherwise(0)
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    draw = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    scored = cut(each.select("id", "h1", "h2", "copy", "n_words", F.col("k").alias("n_features"), weight.alias("weight"), (weight + draw).alias("score")))
    enough = F.col("n_words") >= min_words
    # scores are thousandths of logarithms: some 100 000 different ones at most, whatever the documents
    by_score = scored.where(enough).groupBy("score").agg(F.count("*").alias("n"))
    drawn = (by_score.agg(F.sum("n")).first()[0] or 0) * percent // 100
    higher = F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1))
    least = by_score.select("score", F.coalesce(higher, F.lit(0)).alias("before")).where(F.col("before") < drawn).agg(F.min("score")).first()[0]
    among = enough & (F.col("score") >= F.lit(least).cast("long")) if drawn else F.lit(False)
    ranked = ordinal_ranks(scored.where(among).withColumn("down", -F.col("score")), "down", ["id", "h1", "h2", "copy"])
    out = [F.col("id").alias(id_col), *[F.col(c).cast("long") for c in ("n_features", "weight", "score")]]
    drawn_rows = ranked.select(*out, F.when(F.col("rank") <= drawn, F.col("rank")).cast("long").alias("rank"))
    return drawn_rows.unionByName(scored.where(~among).select(*out, F.lit(None).cast("long").alias("rank")))


def op12_importance(spark, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_LOWERED = f"translate(text, '{UPPER}', '{LOWER}')"
_WORDS = r"regexp_extract_all(" + _LOWERED + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

QUERIES = {"op12_importance": op12_importance}
ORACLES = {
    "op12_importance": f"""WITH doc_words AS (SELECT doc_id, word, count(*) AS n FROM (SELECT doc_id, unnest({_WORDS}) AS word FROM documents) GROUP BY ALL),
  aim_words AS (SELECT word, count(*) AS n FROM (SELECT unnest({_WORDS}) AS word FROM benchmark) GROUP BY ALL),
  hashing AS (SELECT word AS key FROM doc_words UNION SELECT word FROM aim_words),""" + CRC_SQL + """,
  bucket_of AS (SELECT key AS word, h % 10000 AS bucket FROM hashed),
  s AS (SELECT bucket, sum(n) AS n FROM doc_words JOIN bucket_of USING (word) GROUP BY bucket),
  t AS (SELECT bucket, sum(n) AS n FROM aim_words JOIN bucket_of USING (word) GROUP BY bucket),
  gain AS (SELECT b AS bucket, floor(1000 * ln(((coalesce(t.n, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(n), 0) FROM s) + 10000)::DOUBLE)
             / ((coalesce(s.n, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(n), 0) FROM t) + 10000)::DOUBLE)))::BIGINT AS gain
           FROM range(10000) AS r(b) LEFT JOIN s ON s.bucket = b LEFT JOIN t ON t.bucket = b),
  sums AS (SELECT doc_id, sum(n)::BIGINT AS k, sum(n * gain)::BIGINT AS w FROM doc_words JOIN bucket_of USING (word) JOIN gain USING (bucket) GROUP BY doc_id),
  scored AS (SELECT doc_id, coalesce(k, 0)::BIGINT AS n_features, coalesce(floor(w / k), 0)::BIGINT AS weight,
             coalesce(floor(w / k), 0)::BIGINT + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT + 0.5) / 4294967296)))::BIGINT AS score
             FROM documents LEFT JOIN sums USING (doc_id)),
  ranked AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, floor(10 * count(*) OVER () / 100) AS drawn FROM scored WHERE n_features >= 20)
  SELECT doc_id, n_features, weight, score, CASE WHEN rank <= drawn THEN rank END AS rank FROM scored LEFT JOIN ranked USING (doc_id)"""
}
