"""The pipeline against its stages done by brute force."""

import random
import sys
from collections import Counter
from pathlib import Path

import numpy as np

sys.path.insert(0, str(Path(__file__).parent))
import corpus_pipeline  # noqa: E402
from fixtures import sentence  # noqa: E402
from gridloom.llm import kneser_ney as K  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402
from test_brute_force import contaminated, dedup, kn_model, links  # noqa: E402
from test_brute_force import kn_probability as probability  # noqa: E402


def test_run_equals_brute_force(spark, tmp_path):
    rng = random.Random(11)
    items = [(k, sentence(rng, 25)) for k in range(3)]
    shared = "\n".join(sentence(rng, 7) for _ in range(4))
    texts = ["\n".join(sentence(rng, rng.randrange(6, 14)) for _ in range(4)) for _ in range(40)]
    texts += [texts[2], texts[3] + " end", items[1][1] + " " + sentence(rng, 8), "%%% ### ||| &&& %%% ### @@@ 12345 67890 %%%% ####" * 3, sentence(rng, 9) + "\n" + shared, sentence(rng, 9) + "\n" + shared, "", None]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    rows.append(rows[5])
    cols = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, cols).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(40)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    half = {r.doc_id: r.h for r in spark.createDataFrame(rows, cols).select("doc_id", F.pmod(F.xxhash64("text"), F.lit(2)).alias("h")).collect()}
    models = {h: kn_model([t for i, t, *_ in rows if i < 40 and half[i] == h]) for h in (0, 1)}
    chars = len({c for _, t, *_ in rows for c in (t or "") + K.END})
    memo, ppl, err = {0: {}, 1: {}}, {}, {}
    for i, t, *_ in rows:
        m, g = 1 - half[i], K.START * (K.ORDER - 1) + (t or "") + K.END
        logs = []
        for k in range(len(g) - K.ORDER + 1):
            x = g[k : k + K.ORDER]
            if x not in memo[m]:
                memo[m][x] = np.log(probability(models[m], x, chars))
            logs.append(memo[m][x])
        ppl[i], err[i] = float(np.exp(-np.mean(logs))), float(np.std(logs) / np.sqrt(len(logs)))
    trusted = sorted(ppl[i] for i, *_ in rows if i < 40)
    limit = trusted[int(np.ceil(K.QUANTILE * len(trusted))) - 1] * K.SLACK
    docs = [r for r in rows if ppl[r[0]] <= limit * np.exp(K.ERRORS * err[r[0]])]
    cleaned = dedup(sorted({(r[0], r[1]) for r in docs if r[1] is not None}))
    docs = [(r[0], cleaned.get(r[0]), *r[2:]) for r in docs]
    changed = {r[0] for r in rows if r[1] is not None and cleaned.get(r[0], r[1]) != r[1]}
    docs = [r for r in docs if r[0] not in changed or r[1].strip()]
    link = links(docs)
    comp = list(range(len(docs)))
    for _ in docs:
        comp = [min([comp[i], *(comp[j] for j in link[i])], key=lambda k: docs[k][0]) for i in range(len(docs))]
    docs = [docs[i] for i in sorted(set(comp))]
    docs = [r for r in docs if not contaminated(r[1], items)]
    want = Counter({r[0]: len((r[1] or "").split()) + 1 for r in docs})

    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter({i: sum(r.n_words for r in got if r.doc_id == i) for i in {r.doc_id for r in got}}) == want
    assert 42 not in want and 43 not in want and 40 not in want and len(want) > 35


def test_stages_keep_columns_of_any_name_and_stand_empty_tables(spark, tmp_path):
    rng = random.Random(4)
    texts = ["\n".join(sentence(rng, 9) for _ in range(5)) for _ in range(12)]
    texts += [texts[0], None, "", texts[1] + "\nend"]
    cols = "doc_id long, text string, lang string, n_lines int, n_removed int, text_hash string, keep boolean, `a.b` int, __row int"
    rows = [(i, t, "en", 1, 2, "h", True, 3, 4) for i, t in enumerate(texts)] + [(3, texts[3], "en", 9, 2, "h", True, 3, 4)]
    spark.createDataFrame([(i, 1) for i in range(12)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, sentence(rng, 30)), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, some in (("full", rows), ("empty", [])):
        spark.createDataFrame(some, cols).coalesce(1).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        for stage, f in corpus_pipeline.STAGES[:-1]:
            out = f(spark, docs, str(tmp_path))
            assert out.columns == docs.columns, stage
            got = {r.doc_id: r for r in out.collect()}
            assert all((r.n_removed, r.text_hash, r.keep, r["a.b"], r["__row"]) == (2, "h", True, 3, 4) for r in got.values()), stage
            if name == "full":
                if stage == "quality classifier":
                    assert set(range(13)) | {15} <= got.keys() and (13 in got) == (14 in got)
                    continue
                assert got[13].text is None and got[14].text == "" and got[3].n_lines == (1 if stage == "n-gram Jaccard join" else got[3].n_lines), stage
                assert (12 in got, 15 in got) == ((False, False) if stage == "n-gram Jaccard join" else (stage != "line dedup", True)), stage
            else:
                assert not got
