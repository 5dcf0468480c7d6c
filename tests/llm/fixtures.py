"""Small documents with what every operator has to stand: nulls, empty and long texts, ties, repeated rows, clashing names."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard int, slot int, __row string, text_hash string, host string, spans int, kept boolean"


def sentence(rng, n):
    return " ".join(rng.choice("the of and stone river tree walk light house small green quiet morning story paper letter".split()) + rng.choice(["", "", "s", "ly"]) for _ in range(n))


def documents(seed=1, n=60):
    rng = random.Random(seed)
    texts = ["\n".join(sentence(rng, rng.randrange(3, 14)) + "." for _ in range(rng.randrange(1, 9))) for _ in range(n)]
    texts += [texts[0], texts[0], texts[1] + " more", texts[2].replace("the", "a", 1), "", None, " \n\t \n ", "one", "x " * 30000, "a b c d e f g h " * 9, "!!! ### %%%", "same\nsame\nsame\nsame\nsame"]
    texts += ["\n".join(["shared line one here", "shared line two here", "shared line three here", sentence(rng, 8)]) for _ in range(4)]
    rows = [(i, t, rng.choice(["en", "de", None]), rng.choice(["a", "b", None]), len(t or "")) for i, t in enumerate(texts)]
    rows += [rows[3], rows[3], (None, "no id here at all", "en", "a", 5), (None, None, None, None, None)]
    return [(*r, 7, 7, "x", "y", "z", 1, True) for r in rows]


def frame(spark, rows=None):
    return spark.createDataFrame(documents() if rows is None else rows, SCHEMA)
