"""Resampling against brute force: chunks of any size and n, weights, draws and ranks."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest
from gridloom.llm import importance
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, id string, h1 int, chunk int, words string, rank int"


def words(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def features(text, n):
    w = words(text)
    return [" ".join(w[i : i + j]) for j in range(1, n + 1) for i in range(len(w) - j + 1)]


def brute(docs, target, n, percent=10, buckets=10_000):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = (Counter(bucket(f) for _, text in rows for f in features(text, n)) for rows in (docs, target))
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets))))
    rows = []
    for doc_id, text in docs:
        g = [gain(bucket(f)) for f in features(text, n)]
        weight = sum(g) // len(g) if g else 0
        h = int(hashlib.sha256(f"2024:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        rows.append((doc_id, len(g), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words(text))))
    enough = sorted((r for r in rows if r[4] >= 20), key=lambda r: (-r[3], -1 if r[0] is None else r[0]))
    drawn = [r[:4] for r in enough[: percent * len(enough) // 100]]
    ranked = Counter(drawn)
    return sorted([(*r, k + 1) for k, r in enumerate(drawn)] + [(*r, None) for r in (Counter(x[:4] for x in rows) - ranked).elements()], key=str)


def documents():
    rng = random.Random(5)
    pool = ["Stone", "river", "été", "中文", "a1", "x", "The", "İ", "😀b", "word", "Ω"]
    text = lambda k: "".join(rng.choice(pool) + rng.choice([" ", "-", "\n", ", ", "  "]) for _ in range(k))
    docs = [(i, text(rng.choice([0, 5, 19, 20, 21, 60, 200]))) for i in range(60)]
    docs += [(100, None), (101, ""), (102, "!!! ###"), (103, "z" * 5000), (104, "word " * 3000), (None, text(40)), (7, docs[7][1]), (7, docs[7][1]), (None, None), (200, docs[3][1])]
    return docs, [(i, text(50).replace("Stone", "river")) for i in range(9)] + [(50, None)]


@pytest.mark.parametrize(("n", "size", "percent"), [(1, 20_000, 10), (1, 37, 50), (2, 23, 100), (3, 64, 30)])
def test_equals_brute_force(spark, n, size, percent):
    docs, target = documents()
    frame = spark.createDataFrame([(*d, "x", 1, 2, "y", 3) for d in docs], SCHEMA)
    got = importance.resample(frame, spark.createDataFrame(target, "item_id long, text string"), n=n, size=size, percent=percent)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"] and {k for _, k in got.dtypes} == {"bigint"}
    assert sorted(map(tuple, got.collect()), key=str) == brute(docs, target, n, percent)


@pytest.mark.parametrize(("n", "size"), [(1, 10), (3, 10), (4, 1)])
def test_chunks_own_every_word_once_and_carry_the_next(spark, n, size):
    docs, _ = documents()
    frame = spark.createDataFrame([(k, t) for k, (_, t) in enumerate(docs)], "k long, text string")
    for k, rows in ((k, sorted(rows)) for k, rows in importance.chunks(frame, "text", [F.col("k")], n, size).groupBy("k").agg(F.collect_list(F.struct("chunk", "n_words", "words"))).collect()):
        whole, at = words(docs[k][1]), 0
        for i, (chunk, own, held) in enumerate(rows):
            assert chunk == i and list(held) == whole[at : at + own + n - 1]
            at += own
        assert at == len(whole)


def test_empty_tables(spark):
    docs, target = documents()
    none, aims = spark.createDataFrame([], SCHEMA), spark.createDataFrame(target, "item_id long, text string")
    assert importance.resample(none, aims).count() == 0
    frame = spark.createDataFrame([(*d, "x", 1, 2, "y", 3) for d in docs], SCHEMA)
    assert sorted(map(tuple, importance.resample(frame, aims.limit(0)).collect()), key=str) == brute(docs, [], 1)
