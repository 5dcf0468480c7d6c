"""Toxicity by a weighted finite-state pattern grammar over clauses.

Words are read as symbols (insult of a level, threat, target, negation, reported speech, other). Five small weighted
transducers rewrite the symbols of a clause one after the other: what is reported weighs less, what is negated weighs
less, what follows a target is aimed; threats match if aimed, and insults match, aimed ones with more weight. Weights
stand on the transitions and multiply when the five are composed into one machine; a clause's weight is the sum over its
matches. Targets that follow are marked before, by a transducer that reads the clause from its end. A document's score is
a logistic function of the weights of its matched clauses.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from itertools import product

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, map_rows, table

#: Labelled rows of each class that the lexicon and the scale are fitted on, at most (first by a hash of the id).
FIT_ROWS = 6000
#: A word or a beginning of words is an insult if it stands in so many toxic rows, and so much more often than in others.
MIN_ROWS, MIN_LIFT = 3, 15.0
#: Lexicon entries that are learned, at most: those with the highest odds.
MAX_LEXICON = 20_000
STEMS = range(3, 9)
HOLD_OUT = 1
THRESHOLD = 0.7

# Closed word classes of the grammar, in English, German, French and Spanish.
TARGET = frozenset("you your yours yourself u du dich dir dein deine euch tu toi ton ta vous votre usted ustedes tú ti te vosotros he she they him her them".split())
NEGATION = frozenset("not no never isn aren wasn weren don doesn didn nicht kein keine nie niemals pas jamais aucun nunca jamás tampoco".split())
REPORT = frozenset("said says say wrote writes called quoted quote claimed reported sagte schrieb behauptete écrit déclaré affirmé dijo escribió afirmó according".split())
THREAT = frozenset("kill murder hurt destroy stab strangle shoot töten umbringen verprügeln tuer frapper étrangler matar golpear apuñalar".split())

_WORD = re.compile(r"[^\W\d_]+")
_CLAUSE = re.compile(r"[.!?;:\n,]+")
#: What marks do to a weight; how far a negation and a target reach, in words.
NEGATED, REPORTED, TARGETED, THREAT_WEIGHT = 0.25, 0.4, 1.25, 6.0
NEGATION_REACH, TARGET_REACH = 3, 4
#: Insults have levels: their log-odds in steps of so much, up to so many.
LEVEL, LEVELS = 0.25, 60


class Transducer:
    """A weighted sequential transducer: (state, symbol) -> (state, symbol, weight); state 0 starts."""

    def __init__(self, moves: dict[tuple[int, str], tuple[int, str, float]]):
        self.moves = moves

    def symbols(self) -> set[str]:
        return {s for _, s in self.moves}

    def outputs(self) -> set[str]:
        return {o for _, o, _ in self.moves.values()}

    def compose(self, then: Transducer) -> Transducer:
        """The transducer that applies self, then `then`, in one pass: the reachable part of the product, weights multiplied."""
        number, todo, moves = {(0, 0): 0}, [(0, 0)], {}
        while todo:
            a, b = pair = todo.pop()
            for s in self.symbols():
                if (a, s) not in self.moves:
                    continue
                a2, mid, w = self.moves[a, s]
                b2, out, v = then.moves[b, mid]
                if (a2, b2) not in number:
                    number[a2, b2] = len(number)
                    todo.append((a2, b2))
                moves[number[pair], s] = number[a2, b2], out, w * v
        return Transducer(moves)


#: The symbols that words are read as: other, target, negation, report, threat, and insult by level. An aimed one ends in '!'.
WORDS = ["o", "t", "n", "r", "h", *(f"i{k}" for k in range(1, LEVELS + 1))]


def after(alphabet: set[str], trigger: str, reach: int | None, weight: float = 1.0, mark: str = "") -> Transducer:
    """Weighs, and marks, insults and threats that follow the trigger within `reach` words (None: to the clause's end)."""
    last = 1 if reach is None else reach
    moves = {}
    for state, s in product(range(last + 1), alphabet):
        to = last if s == trigger else state if reach is None else max(0, state - 1)
        hit = state and s[0] in "ih"
        moves[state, s] = to, s + mark if hit and not s.endswith("!") else s, weight if hit else 1.0
    return Transducer(moves)


def threats(alphabet: set[str]) -> Transducer:
    """An aimed threat is a match; one that isn't is nothing."""
    return Transducer({(0, s): (0, *{"h!": ("T", THREAT_WEIGHT), "h": ("o", 1.0)}.get(s, (s, 1.0))) for s in alphabet})


def insults(alphabet: set[str]) -> Transducer:
    """An insult is a match with its level's weight, aimed ones with more; what isn't a match is nothing."""
    moves = {(0, s): (0, s if s == "T" else "o", 1.0) for s in alphabet}
    for s in alphabet:
        if s[0] == "i":
            moves[0, s] = 0, "I", int(s[1:].rstrip("!")) * LEVEL * (TARGETED if s.endswith("!") else 1.0)
    return Transducer(moves)


def grammar() -> tuple[Transducer, Transducer]:
    """(targets that follow, read from the clause's end; reported speech, negation, targets, threats and insults in one)."""
    following = after(set(WORDS), "t", TARGET_REACH, mark="!")
    machine = after(following.outputs(), "r", None, REPORTED)
    machine = machine.compose(after(machine.outputs(), "n", NEGATION_REACH, NEGATED))
    machine = machine.compose(after(machine.outputs(), "t", TARGET_REACH, mark="!"))
    machine = machine.compose(threats(machine.outputs()))
    return following, machine.compose(insults(machine.outputs()))


class Grammar:
    """The composed machine with a lexicon of insults: what a text's clauses weigh."""

    MAX_KNOWN = 300_000

    def __init__(self, insults: dict[str, float]):
        following, machine = grammar()
        self.insults, self.following, self.machine, self.known = insults, following.moves, machine.moves, {}

    def read(self, word: str) -> str:
        """The word's symbol; of an insult with the level of the word or of its weightiest listed beginning."""
        if len(self.known) >= self.MAX_KNOWN:
            self.known.clear()
        weight = self.insults.get(word, 0.0)
        for k in STEMS:
            if len(word) > k:
                weight = max(weight, self.insults.get(word[:k] + "*", 0.0))
        level = min(LEVELS, max(1, round(weight / LEVEL)))
        symbol = f"i{level}" if weight else "h" if word in THREAT else "n" if word in NEGATION else "r" if word in REPORT else "t" if word in TARGET else "o"
        self.known[word] = symbol
        return symbol

    def clause(self, symbols: list[str]) -> float:
        """The sum of the weights of the matches."""
        state, marked = 0, []
        for s in reversed(symbols):
            state, out, _ = self.following[state, s]
            marked.append(out)
        state, total = 0, 0.0
        for s in reversed(marked):
            state, out, weight = self.machine[state, s]
            if out != "o":
                total += weight
        return total

    def features(self, text: str | None) -> tuple[float, float]:
        """ln(1 + weight of all matched clauses), and that weight by the number of words."""
        text = (text or "").lower()
        known, read = self.known, self.read
        words = _WORD.findall(text)
        if not any((known.get(w) or read(w))[0] in "ih" for w in words):  # no clause can match
            return 0.0, 0.0
        total = sum(self.clause([known.get(w) or read(w) for w in _WORD.findall(part)]) for part in _CLAUSE.split(text))
        return math.log1p(total), total / (len(words) + 30)


def lexemes(text: str | None) -> set[str]:
    """Distinct words of a text and their beginnings, marked by '*'."""
    words = set(_WORD.findall((text or "").lower()))
    return words | {w[:k] + "*" for w in words for k in STEMS if len(w) > k}


def held_out(id_: Column) -> Column:
    return F.coalesce(F.crc32(id_.cast("string").cast("binary")) % 3 == HOLD_OUT, F.lit(False))


def fitting_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(text, toxic) of at most FIT_ROWS labelled rows of each class, none of them held out."""
    seen = labels.select(F.col("doc_id").alias("__id"), F.col("toxic").alias("__toxic")).where("__id is not null and __toxic is not null")
    seen = seen.where(~held_out(F.col("__id"))).groupBy("__id").agg(F.max("__toxic").alias("__toxic"))
    picked = [seen.where(F.col("__toxic") == c).orderBy(F.xxhash64("__id"), "__id").limit(FIT_ROWS) for c in (0, 1)]
    chosen = picked[0].unionByName(picked[1])  # bounded: 2 * FIT_ROWS ids
    joined = docs.join(F.broadcast(chosen), F.col("doc_id") == F.col("__id"))
    # rows that share an id teach once, so that the bound holds whatever repeats
    return joined.groupBy("__id").agg(F.min("text").alias("text"), F.max("__toxic").cast("int").alias("toxic")).drop("__id")


def learn_insults(rows: DataFrame) -> dict[str, float]:
    """Words and beginnings with their log-odds to stand in a toxic row."""

    def count(cols: dict[str, list]) -> dict[str, list]:
        found: tuple[Counter, Counter] = Counter(), Counter()
        for text, toxic in zip(cols["text"], cols["toxic"]):
            found[toxic].update(lexemes(text))
        keys = list(found[0].keys() | found[1].keys())
        return {"lexeme": keys, "clean": [found[0][k] for k in keys], "toxic": [found[1][k] for k in keys]}

    sizes = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    clean, toxic = sizes.get(0, 0), sizes.get(1, 0)
    odds = F.log((F.col("toxic") + 0.5) / (toxic + 1)) - F.log((F.col("clean") + 0.5) / (clean + 1))
    counts = map_rows(rows, count, "lexeme string, clean long, toxic long").groupBy("lexeme").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    best = counts.where(F.col("toxic") >= MIN_ROWS).withColumn("odds", odds).where(F.col("odds") > math.log(MIN_LIFT)).orderBy(F.desc("odds"), "lexeme").limit(MAX_LEXICON)
    return {r["lexeme"]: r["odds"] for r in best.select("lexeme", "odds").collect()}


def fit_scale(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic regression of y on the columns of x and a constant, by Newton's method with a small ridge."""
    x = np.column_stack([np.ones(len(x)), x])
    w, ridge = np.zeros(x.shape[1]), np.diag([1e-3, 0.05, 0.05])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x.T * (p * (1 - p))) @ x + ridge, x.T @ (y - p) - ridge @ w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return w


def score_toxicity(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score (0 to 1) and predicted (1 if the score is THRESHOLD or more), one row a row of df.

    labels: doc_id and toxic; rows that are held out (crc32 of the id mod 3 is 1) or null teach nothing. Without
    any labelled row every score is the same low one. A null or empty text has no clause; a very long one is read whole;
    repeated rows score alike; a null id isn't held out; other columns of df are not read. An empty df gives no rows.
    """
    kind = dict(df.dtypes)[id_col]
    docs = df.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    rows = cut(fitting_rows(docs, labels))  # bounded; read three times
    insults = learn_insults(rows)

    def measure(cols: dict[str, list]) -> dict[str, list]:
        g = Grammar(insults)
        found = [g.features(t) for t in cols["text"]]
        return {"a": [f[0] for f in found], "b": [f[1] for f in found], "toxic": cols["toxic"]}

    fitted = map_rows(rows, measure, "a double, b double, toxic int", rows=4096).collect()  # bounded: 2 * FIT_ROWS pairs of numbers
    y = np.array([r["toxic"] for r in fitted], float)
    weights = fit_scale(np.array([[r["a"], r["b"]] for r in fitted], float).reshape(-1, 2), y) if y.any() else np.array([-6.0, 0.0, 0.0])
    model = df.sparkSession.sparkContext.broadcast((insults, weights))  # bounded: MAX_LEXICON words
    held: list[Grammar] = []

    def score(cols: dict[str, list]) -> dict[str, list]:
        g = held[0] if held else held.append(Grammar(model.value[0])) or held[0]
        w = model.value[1]
        z = [w[0] + w[1] * a + w[2] * b for a, b in map(g.features, cols["text"])]
        return {"doc_id": cols["doc_id"], "score": [1 / (1 + math.exp(-max(-30.0, min(30.0, x)))) for x in z]}

    scored = map_rows(docs, score, f"doc_id {kind}, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def op7_toxicity(spark, sf_dir: str) -> DataFrame:
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {"op7_toxicity": op7_toxicity}
ORACLES: dict[str, str] = {}
