"""Spelling variants against brute force: automata, near words over blocks of any size, forms and roots."""

import random
import zlib
from collections import Counter

import pytest
from gridloom.llm import spelling

SCHEMA = "doc_id long, text string, word string, n long"


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    k = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[k + 1 :] == b[k + 1 :] if len(a) == len(b) else a[k:] == b[k + 1 :]


def words_of(rng, n, alphabet="abé", lengths=(5, 8)):
    return {"".join(rng.choice(alphabet) for _ in range(rng.randint(*lengths))) for _ in range(n)}


def test_automaton_numbers_words_and_is_minimal():
    words = sorted(words_of(random.Random(1), 300))
    machine = spelling.Automaton(words)
    assert [machine.number(w) for w in words] == list(range(len(words)))
    assert machine.number("zzzzz") is None and machine.number(words[0][:-1]) in (None, *range(len(words)))
    tails = {w[k:]: None for w in words for k in range(len(w) + 1)}  # a state is a set of tails
    states = {frozenset(w[len(p) :] for w in words if w.startswith(p)) for p in {w[:k] for w in words for k in range(len(w) + 1)}}
    assert tails and len(machine.final) == len(states)


@pytest.mark.parametrize("exact", [0, 2, 4])
def test_completion_with_one_error(exact):
    rng = random.Random(2)
    words = sorted(words_of(rng, 400))
    machine = spelling.Automaton(words)
    for q in [*words[:60], *words_of(rng, 40)]:
        got = {words[k] for k in machine.near(q, exact)}
        assert got == {w for w in words if w.startswith(q[:exact]) and one_edit(w[exact:], q[exact:])}


@pytest.mark.parametrize("block", [50_000, 7])
def test_near_words_equal_brute_force(spark, block):
    rng = random.Random(3)
    n = {w: rng.randrange(1, 9) for w in words_of(rng, 500, "abcé", (5, 9)) | {"aaaaa", "aaaaaa", "aaaaaaa"}}
    got = {r.word: (r.n_near, r.best_n, r.best) for r in spelling.near_words(spark.createDataFrame(list(n.items()), "word string, n long"), block).collect()}
    want = {}
    for w in n:
        near = [v for v in n if one_edit(w, v)]
        if near:
            best = min(near, key=lambda v: (-n[v], v))
            want[w] = (len(near), n[best], best)
    assert got == want


def brute(docs):
    counts = Counter()
    for doc_id, text in docs:
        for run in spelling_runs(text or ""):
            low = "".join(c.lower() if c in spelling.UPPER else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{low}".encode())
            if h % 97 == 0:
                low = low[: h % len(low)] + low[h % len(low) + 1 :]
            counts[low] += 1
    n = {w: k for w, k in counts.items() if len(w) >= 5 and k >= 3}
    out = {}
    for w in n:
        near = [v for v in n if one_edit(w, v)]
        best = min(near, key=lambda v: (-n[v], v), default=None)
        out[w] = (best if best and n[best] >= 2 * n[w] else None, len(near))
    rows = []
    for w, (form, near) in out.items():
        root = w
        while out[root][0]:
            root = out[root][0]
        rows.append((w, form, root, n[w], near, n[form] if form else None))
    return sorted(rows, key=str)


def spelling_runs(text):
    run = ""
    for c in text + " ":
        if "A" <= c <= "Z" or "a" <= c <= "z" or "À" <= c <= "ÿ":
            run += c
        elif run:
            yield run
            run = ""


def test_variants_equal_brute_force_on_nulls_repeats_and_other_alphabets(spark):
    rng = random.Random(4)
    words = sorted(words_of(rng, 60, "abÉé×K", (4, 7)))
    texts = [" ".join(rng.choices(words, k=120)) for _ in range(8)] + [None, "", "İstanbul KELVİN ΣΑΣ абвгд abcde" * 4, "x" * 40_000, "houses HOUSES Houses house " * 5]
    docs = [(i, t) for i, t in enumerate(texts)] + [(None, texts[0]), (3, texts[3]), (None, None), (None, "abcde abcde")]
    got = spelling.spelling_variants(spark.createDataFrame([(*d, "clash", 1) for d in docs], SCHEMA)).collect()
    assert sorted(map(tuple, got), key=str) == brute(docs)


def test_long_chains_of_forms_reach_their_root(spark):
    chain = ["aaaaa", "aaaab", "aaabb", "aabbb", "abbbb", "bbbbb", "bbbbc", "bbbcc"]
    docs = [(i, " ".join([w] * (3 * 2**i))) for i, w in enumerate(chain)]
    got = {r.word: r for r in spelling.spelling_variants(spark.createDataFrame([(*d, "", 1) for d in docs], SCHEMA)).collect()}
    assert {r.root for r in got.values()} == {"bbbcc"} and got["aaaaa"].form == "aaaab" and got["bbbcc"].form is None


def test_empty_table(spark):
    assert spelling.spelling_variants(spark.createDataFrame([], SCHEMA)).count() == 0
