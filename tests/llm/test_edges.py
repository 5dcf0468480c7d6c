"""Every operator on nulls, empties, long texts, repeated rows, clashing names and empty tables."""

import sys
from pathlib import Path

import public_tokenizers
import pytest

sys.path.insert(0, str(Path(__file__).parent))
from fixtures import documents, frame  # noqa: E402
from gridloom.llm import decontaminate, html_extract, importance, kneser_ney, line_dedup, ngram_jaccard, packing, pieces, quality_rules, secrets, sharding, spelling, toxicity  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

LABELS = "doc_id long, quality int, toxic int, text string"
LABEL_ROWS = [(i, int(i % 3 > 0), int(i % 7 == 0), "x") for i in range(0, 40)] + [(None, 1, 1, None), (3, None, None, None), (5, 1, 0, "y")]


def labels(spark, rows=LABEL_ROWS):
    return spark.createDataFrame(rows, LABELS)


def bench(spark):
    return spark.createDataFrame([(1, documents()[5][1]), (2, None), (3, ""), (None, "short"), (4, documents()[5][1])], "item_id long, text string")


OPERATORS = {
    "rules": lambda s, d: quality_rules.host_rules(d),
    "shards": lambda s, d: sharding.shuffle_into_shards(d, F.struct("doc_id", F.xxhash64("text"))),
    "jaccard": lambda s, d: ngram_jaccard.classes(d),
    "secrets": lambda s, d: secrets.find_secrets(d),
    "toxicity": lambda s, d: toxicity.score_toxicity(d, labels(s)),
    "quality": lambda s, d: kneser_ney.classify(d, labels(s)),
    "packing": lambda s, d: packing.pack(d),
    "lines": lambda s, d: line_dedup.dedup_line_windows(d),
    "importance": lambda s, d: importance.resample(d, bench(s)),
    "pieces": lambda s, d: pieces.decode(pieces.encode(d, public_tokenizers.path("piece_bpe_32k.model")), public_tokenizers.path("piece_bpe_32k.model")),
    "pages": lambda s, d: html_extract.extract_main_text(d.withColumn("url", F.col("source")), "doc_id", "url", "text"),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_a_row_for_each_row(spark, name):
    df = frame(spark)
    got = OPERATORS[name](spark, df)
    n = got.where("piece = 0").count() if name == "packing" else got.count()
    assert n == df.count()


@pytest.mark.parametrize("name", [*OPERATORS, "benchmark"])
def test_empty_table(spark, name):
    none = frame(spark, [])
    got = decontaminate.find_benchmark(none, bench(spark)) if name == "benchmark" else OPERATORS[name](spark, none)
    assert got.count() == 0


def test_without_labels_or_items(spark):
    df = frame(spark)
    assert kneser_ney.classify(df, labels(spark, [])).where("not kept").count() == 0
    assert toxicity.score_toxicity(df, labels(spark, [])).where("predicted = 1").count() == 0
    assert decontaminate.find_benchmark(df, bench(spark).limit(0)).count() == 0
    found = decontaminate.find_benchmark(df, bench(spark)).select("doc_id", "item_id").distinct().collect()
    assert {(5, 1), (5, 4)} <= {tuple(r) for r in found} and all(r.item_id in (1, 4) for r in found)


def by_key(df, *cols):
    return sorted(((r.doc_id, *(r[c] for c in cols)) for r in df.collect()), key=str)


def test_values_on_nulls_empties_repeats_and_clashing_names(spark):
    """What nulls, empties and repeats give, value by value; columns of clashing names change nothing."""
    rows = documents()
    df = frame(spark, rows)
    bare = df.select("doc_id", "text")
    empty = [(r[0], r[1]) for r in rows if not r[1]]
    for operate, cols, want in (
        (lambda d: secrets.find_secrets(d), ["spans"], ([],)),
        (lambda d: importance.resample(d, bench(spark)), ["n_features", "weight"], (0, 0)),
        (lambda d: pieces.encode(d, public_tokenizers.path("piece_bpe_32k.model")), ["ids", "starts", "ends"], ([2], [0], [0])),
    ):
        got = by_key(operate(df), *cols)
        assert got == by_key(operate(bare), *cols)
        for i in {i for i, _ in empty} - {i for i, t in ((r[0], r[1]) for r in rows) if t}:
            assert {str(g[1:]) for g in got if g[0] == i} == {str(want)}
    twice = [i for i, *_ in by_key(line_dedup.dedup_line_windows(df), "n_removed") if i == rows[3][0]]
    assert len(twice) == 3  # each repeated row has its row
    # spelling reads the same words whatever else there is
    assert sorted(map(tuple, spelling.spelling_variants(df).collect()), key=str) == sorted(map(tuple, spelling.spelling_variants(bare).collect()), key=str)
