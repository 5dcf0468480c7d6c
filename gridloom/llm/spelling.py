"""Spelling variants: words that differ by one code point, found through forward and backward minimal automata.

One edit lies in the first half of a word or in the second, so the other half is matched exactly: the first half by an
automaton over the dictionary's words, the second by one over the words read backwards. From the state reached, the rest
is completed with one error. States count the words beneath them, so that each way through an automaton ends at the
word's number (a perfect hash), which finds the word's count without a table of strings.

The dictionary is dealt by (direction, length of the query, exact half), so that a query meets all words that share its
exact half in one place; places that hold much are cut into blocks of words, and a query visits each block. Tasks send
one row a query, never a row a pair.
"""

from __future__ import annotations

from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, n_blocks, table

RUN = "[A-Za-zÀ-ÿ]+"
MIN_LENGTH, MIN_COUNT = 5, 3
#: A run whose hash it divides loses a code point.
SLIPS = 97
#: A form is so many times as frequent as its variant.
RATIO = 2
#: Dictionary words of one automaton and queries of one block, about.
BLOCK = 50_000

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower_ascii(s: Column) -> Column:
    """s with A to Z in lower case and everything else as it is."""
    return F.when(s.rlike("[^\\x00-\\x7F]"), F.translate(s, UPPER, LOWER)).otherwise(F.lower(s))


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """(word, n): distinct words of at least min_length code points that occur min_count times or more.

    A word is a maximal run of RUN with A to Z lower-cased, of every occurrence in every text. Where SLIPS divides the
    crc32 h of `<id>:<run>`, the run's code point h % length is left out. A null text has no words; a null id is written
    as nothing; repeated rows count each.
    """
    runs = docs.select(F.col(f"`{id_col}`").alias("id"), F.explode(F.regexp_extract_all(F.col(f"`{text_col}`"), F.lit(RUN), F.lit(0))).alias("run"))
    runs = runs.where(F.length("run") >= min_length).select("id", lower_ascii(F.col("run")).alias("run"))
    hashed = runs.withColumn("h", F.crc32(F.concat(F.coalesce(F.col("id").cast("string"), F.lit("")), F.lit(":"), F.col("run"))))
    at = (F.col("h") % F.length("run")).cast("int")
    slipped = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    words = hashed.select(F.when(F.col("h") % SLIPS == 0, slipped).otherwise(F.col("run")).alias("word"))
    return words.where(F.length("word") >= min_length).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= min_count)


class Automaton:
    """The minimal acyclic automaton of sorted distinct words; a word's number is its place among them."""

    def __init__(self, words: Iterable[str]) -> None:
        self.final: list[bool] = []
        self.moves: list[dict[str, tuple[int, int]]] = []  # letter -> (state, words before those beyond it)
        self._count: list[int] = []
        known: dict[tuple, int] = {}
        path: list[list] = [[False, {}]]  # states of the last word's letters that may still grow
        last = ""

        def settle(depth: int) -> None:
            while len(path) > depth + 1:
                final, moves = path.pop()
                sign = (final, *moves.items())
                state = known.get(sign)
                if state is None:
                    state = known[sign] = self._add(final, moves)
                path[-1][1][last[len(path) - 1]] = state

        for word in words:
            same = 0
            for a, b in zip(last, word):
                if a != b:
                    break
                same += 1
            settle(same)
            path.extend([False, {}] for _ in range(len(word) - same))
            path[-1][0] = True
            last = word
        settle(0)
        self.root = self._add(*path[0])

    def _add(self, final: bool, moves: dict[str, int]) -> int:
        before, out = int(final), {}
        for letter, state in moves.items():  # letters come in order, as the words do
            out[letter] = (state, before)
            before += self._count[state]
        self.final.append(final)
        self.moves.append(out)
        self._count.append(before)
        return len(self.final) - 1

    def walk(self, state: int, number: int, letters: str) -> tuple[int, int] | None:
        moves = self.moves
        for letter in letters:
            step = moves[state].get(letter)
            if step is None:
                return None
            state, number = step[0], number + step[1]
        return state, number

    def number(self, word: str) -> int | None:
        end = self.walk(self.root, 0, word)
        return end[1] if end and self.final[end[0]] else None

    def near(self, word: str, exact: int) -> set[int]:
        """Numbers of the words that begin with word[:exact] and continue as word[exact:] with exactly one edit."""
        found: set[int] = set()
        here = self.walk(self.root, 0, word[:exact])
        at = exact

        def complete(state: int, number: int, rest: str) -> None:
            end = self.walk(state, number, rest)
            if end and self.final[end[0]]:
                found.add(end[1])

        while here:
            state, number = here
            rest = word[at:]
            mine = rest[:1]
            for letter, (to, before) in self.moves[state].items():
                if self.moves[to] or len(rest) < 2:
                    complete(to, number + before, rest)  # a letter more
                    if rest and letter != mine:
                        complete(to, number + before, rest[1:])  # another letter
            if not rest:
                break
            complete(state, number, rest[1:])  # a letter less
            here, at = self.walk(state, number, mine), at + 1
        return found


def _search(forward: bool, words: dict[str, int], queries: list[tuple[str, int]]) -> list[tuple[str, int, int, str]]:
    """(query, near words, largest count, its word) of the queries that have any, among the words."""
    turn = (lambda w: w) if forward else (lambda w: w[::-1])
    ordered = sorted(words, key=turn)
    automaton = Automaton(map(turn, ordered))
    out = []
    for query, _ in queries:
        half = len(query) // 2
        numbers = automaton.near(turn(query), half if forward else len(query) - half)
        near = [ordered[k] for k in numbers]
        if not forward:  # the forward search finds those that share the first half too
            near = [w for w in near if not w.startswith(query[:half])]
        if near:
            n, best = max(words[w] for w in near), None
            best = min(w for w in near if words[w] == n)
            out.append((query, len(near), n, best))
    return out


def near_words(words: DataFrame, block: int = BLOCK) -> DataFrame:
    """(word, n_near, best_n, best): for each word that has near words their number, and the one of largest n.

    words: (word, n), distinct, of MIN_LENGTH code points or more. Two words are near if one inserted, deleted or
    replaced code point makes one the other. Ties of best: the smallest in code-point order.
    """
    half = lambda length: F.floor(length / 2).cast("int")

    def keyed(kind: int, lengths: Column) -> DataFrame:
        each = words.withColumn("length", F.explode(lengths)).withColumn("forward", F.explode(F.array(F.lit(True), F.lit(False))))
        tail = F.col("length") - half(F.col("length"))
        exact = F.when(F.col("forward"), F.substring("word", F.lit(1), half(F.col("length")))).otherwise(F.substring("word", F.length("word") - tail + 1, tail))
        return each.select("word", "n", "length", "forward", exact.alias("exact"), F.lit(kind).alias("kind"))

    own = F.length("word")
    both = keyed(0, F.array(own - 1, own, own + 1)).unionByName(keyed(1, F.array(own)))
    keys = ["forward", "length", "exact"]
    # keys of more than a block: at most 8 rows a word / block of them
    counts = both.groupBy(*keys).agg(F.count_if(F.col("kind") == 0).alias("n0"), F.count_if(F.col("kind") == 1).alias("n1")).where((F.col("n0") > block) | (F.col("n1") > block))
    large = counts.select(*[F.col(k).alias(f"__{k}") for k in keys], F.ceil(F.col("n0") / block).cast("int").alias("word_blocks"), F.ceil(F.col("n1") / block).cast("int").alias("query_blocks"))
    on = [F.col(k) == F.col(f"__{k}") for k in keys]
    dealt = both.join(large, on, "left").drop(*[f"__{k}" for k in keys])
    w, q = (F.greatest(F.coalesce(F.col(c), F.lit(1)), F.lit(1)) for c in ("word_blocks", "query_blocks"))
    mine = F.pmod(F.xxhash64("word"), F.when(F.col("kind") == 0, w).otherwise(q)).cast("int")
    others = F.explode(F.sequence(F.lit(0), F.when(F.col("kind") == 0, q).otherwise(w) - 1))
    dealt = dealt.withColumn("mine", mine).withColumn("other", others)
    cell = [F.when(F.col("kind") == 0, F.col(a)).otherwise(F.col(b)) for a, b in (("mine", "other"), ("other", "mine"))]
    shards = n_blocks(8 * words.count(), block)
    shard = F.pmod(F.xxhash64(*keys, *cell), F.lit(max(shards, int(words.sparkSession.conf.get("spark.sql.shuffle.partitions")))))
    # each cell of blocks is a unit of its own: only what belongs to one key of several blocks must not mix
    unit = F.when(F.greatest(w, q) > 1, F.xxhash64(*keys, *cell)).otherwise(shard)
    dealt = dealt.select("word", "n", "kind", "forward", unit.alias("unit"))
    schema = pa.schema([("word", pa.string()), ("n_near", pa.int64()), ("best_n", pa.int64()), ("best", pa.string())])

    def search(part: pa.Table) -> pa.Table:
        found: list[tuple] = []
        rows = list(zip(*(part.column(c).to_pylist() for c in ("word", "n", "kind", "forward"))))
        for forward in (True, False):
            dictionary = {word: n for word, n, kind, way in rows if kind == 0 and way == forward}
            queries = [(word, n) for word, n, kind, way in rows if kind == 1 and way == forward]
            if dictionary and queries:
                found += _search(forward, dictionary, queries)
        return pa.table([pa.array(c, f.type) for c, f in zip(zip(*found) if found else [[]] * 4, schema)], schema=schema)

    parts = dealt.groupBy("unit").applyInArrow(search, "word string, n_near long, best_n long, best string")
    # largest n, then smallest word
    first = F.min(F.struct((-F.col("best_n")).alias("neg"), F.col("best")))
    return parts.groupBy("word").agg(F.sum("n_near").alias("n_near"), first.alias("first")).select("word", "n_near", (-F.col("first.neg")).alias("best_n"), F.col("first.best").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for (word, form): the last word that following forms leads to.

    Forms grow RATIO times in count each step, so there are no rings and at most log2 of the largest count steps;
    each round doubles the steps taken.
    """
    now = cut(forms.select("word", F.col("form").alias("root")))
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        joined = cut(now.join(ahead, "root", "left").select("word", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("moved")))
        now = joined.drop("moved")
        if joined.where("moved").isEmpty():
            return now


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ratio: int = RATIO) -> DataFrame:
    """Each word of docs (word_counts) with its form and root.

    form: the near word of largest n (ties: smallest in code-point order), if that n is at least ratio times the
    word's own, else null; form_n its n; root: where following forms ends, the word itself if it has no form; n_near:
    near words, 0 if none. Nulls, repeated rows and ids as in word_counts; only id and text are read, so other columns
    may have any name; an empty table gives no rows. ratio is above 1.
    """
    words = cut(word_counts(docs, id_col, text_col))
    near = words.join(near_words(words), "word", "left")
    takes = F.col("best_n") >= ratio * F.col("n")
    found = cut(near.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(takes, F.col("best")).alias("form"), F.when(takes, F.col("best_n")).alias("form_n")))
    ends = roots(found.where("form is not null"))
    return found.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11_spelling(spark, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents"))


#: crc32 of the UTF-8 of relation `hashing` (key), as `hashed` (key, h): the table of bytes, then a step a byte.
CRC_SQL = """
  crc_table AS (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i::BIGINT, range(8)), lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS v FROM range(256) AS r(i))),
  spelled AS (SELECT key, hex(encode(key)) AS x FROM hashing),
  hashed AS (SELECT key, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, len(x), 2), lambda i: ('0x' || substr(x, i, 2))::BIGINT)), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) AS h
             FROM spelled, crc_table)
"""

QUERIES = {"op11_spelling": op11_spelling}
ORACLES = {
    "op11_spelling": "WITH RECURSIVE runs AS (SELECT doc_id, translate(run, '" + UPPER + "', '" + LOWER + """') AS run, count(*) AS n
    FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS run FROM documents) WHERE length(run) >= 5 GROUP BY ALL),
  hashing AS (SELECT DISTINCT coalesce(doc_id::VARCHAR, '') || ':' || run AS key FROM runs),""" + CRC_SQL + """,
  slipped AS (SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, (h % length(run))::BIGINT) || substr(run, (h % length(run))::BIGINT + 2) ELSE run END AS word, n
              FROM runs JOIN hashed ON key = coalesce(doc_id::VARCHAR, '') || ':' || run),
  words AS (SELECT word, sum(n)::BIGINT AS n FROM slipped WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
  less AS (SELECT word, length(word) AS l, i, substr(word, 1, i) || substr(word, i + 2) AS rest FROM (SELECT word, unnest(range(length(word))) AS i FROM words)),
  near AS (SELECT a.word, b.word AS other FROM less a JOIN less b ON a.i = b.i AND a.rest = b.rest AND a.l = b.l AND a.word <> b.word
           UNION SELECT a.word, b.word FROM less a JOIN words b ON a.rest = b.word UNION SELECT b.word, a.word FROM less a JOIN words b ON a.rest = b.word),
  best AS (SELECT w.word, w.n, count(o.word) AS n_near, arg_min(o.word, (-o.n, o.word)) AS best, max(o.n) AS best_n
           FROM words w LEFT JOIN near p ON p.word = w.word LEFT JOIN words o ON o.word = p.other GROUP BY w.word, w.n),
  found AS (SELECT word, n, n_near, CASE WHEN best_n >= 2 * n THEN best END AS form, CASE WHEN best_n >= 2 * n THEN best_n END AS form_n FROM best),
  ways AS (SELECT word, word AS reached, 0 AS steps FROM found UNION ALL SELECT w.word, f.form, steps + 1 FROM ways w JOIN found f ON f.word = w.reached WHERE f.form IS NOT NULL),
  ends AS (SELECT word, arg_max(reached, steps) AS root FROM ways GROUP BY word)
  SELECT word, form, root, n, n_near, form_n FROM found JOIN ends USING (word)"""
}
