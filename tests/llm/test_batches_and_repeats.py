"""What a text gives does not depend on the texts beside it; repeated rows are later occurrences."""

import random

from gridloom.llm import decontaminate
from gridloom.llm.line_dedup import dedup_line_windows


def test_any_grouping_of_texts_finds_the_same(spark, monkeypatch):
    items = [(1, "ab cd ef gh ij kl mnoΣ pq rs"), (2, "Straße nach İstanbul und zurück, ein langer Weg"), (3, "ΟΔΟΣ ΠΡΟΣ ΤΗΝ ΑΘΗΝΑ ΚΑΙ ΠΙΣΩ ΣΤΟΝ ΠΕΙΡΑΙΑ")]
    index = decontaminate.Index(items)
    texts = ["ab cd ef gh ij kx mnoΣ pq rs", "İ", "x ab cd ef gh ij kl mnoς pq rs y", "STRASSE Straße nach İstanbul und zurück, ein langer Weg", "οδος προς την αθηνα και πισω στον πειραια", None, "", "ß" * 50, "ab cd ef　gh ij kl mnoσ pq rs"]
    alone = {i: sorted(m[1:] for m in index.search([t])) for i, t in enumerate(texts)}
    assert alone[0] and alone[2] and alone[3] and alone[4] and alone[8] and not alone[1]
    rng = random.Random(1)
    for size in (1, 10, 10_000):
        monkeypatch.setattr(decontaminate, "TOGETHER", size)
        for _ in range(5):
            order = rng.sample(range(len(texts)), len(texts))
            found = index.search([texts[i] for i in order])
            assert {i: sorted(m[1:] for m in found if m[0] == k) for k, i in enumerate(order)} == {i: alone[i] for i in order}


def test_of_equal_rows_one_stays(spark):
    t, other = "a b\nc d\ne f\ng h", "x\ny\nz\nnew line"
    rows = [(1, t, 5), (1, t, 5), (1, t, 9), (2, t, 0), (None, other, 1), (None, other, 1), (3, "short\ntext", 0), (3, "short\ntext", 0), (4, None, 0), (4, None, 0), (5, "\n\n\n", 1), (5, "\n\n\n", 1)]
    got = dedup_line_windows(spark.createDataFrame(rows, "doc_id long, text string, n_removed int")).collect()
    want = [(1, t, 0), (1, "", 4), (1, "", 4), (2, "", 4), (None, other, 0), (None, "", 4), (3, "short\ntext", 0), (3, "short\ntext", 0), (4, None, 0), (4, None, 0), (5, "\n\n\n", 0), (5, "\n\n\n", 0)]
    assert sorted(((r.doc_id, r.text, r.n_removed) for r in got), key=str) == sorted(want, key=str)


def test_many_equal_rows_among_others(spark):
    rows = [(7, "l1\nl2\nl3\nl4")] * 500 + [(k, f"a{k}\nb{k}\nc{k}") for k in range(300)]
    got = dedup_line_windows(spark.createDataFrame(rows, "doc_id long, text string").repartition(6)).collect()
    assert len(got) == 800 and sum(r.n_removed == 0 for r in got) == 301 and sum(r.text == "" for r in got) == 499
