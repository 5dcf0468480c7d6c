"""Host-level quality rules: failures by host, shrunk by an empirical beta prior, joined back to documents."""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, cut, hot_keys, map_rows, salted_join, table

SYMBOLS = "#*$%&|<>"
MIN_WORDS, MAX_REPEAT_PERCENT, REPEAT_WINDOW = 20, 30, 8
RULES = ("short", "repeated", "symbols", "dup_lines")
#: A host's limit for a rule has LIFT times the odds of the rate of all documents, and is MIN_LIMIT at least. A host is rejected
#: if its shrunk rate is above the limit by more than ERRORS standard deviations of its posterior.
LIFT, MIN_LIMIT, ERRORS = 4.0, 0.2, 1.645
#: A document fails the symbol rule above this many symbols a 100 word characters, the line rule above this percentage of repeated lines.
MAX_SYMBOL_PERCENT, MAX_DUP_LINE_PERCENT = 10, 30
#: Hosts' pseudo-documents are at most this many, however alike the hosts are.
MAX_PRIOR_STRENGTH = 1000.0

_word = re.compile(WORD)
_not_symbol = str.maketrans("", "", SYMBOLS)


def repeated_words(codes: np.ndarray, window: int = REPEAT_WINDOW) -> int:
    """Words in windows of so many words that are found twice or more, the first included. codes: one a word."""
    n = len(codes) - window + 1
    if n < 2:
        return 0
    _, codes = np.unique(codes, return_inverse=True)
    key, top = codes.astype(np.int64), int(codes.max()) + 1
    width = 1
    while width < window:  # ranks of runs of 1, 2, 4 and 8 words: exact, no hashing
        step = min(width, window - width)
        pair = key[: len(key) - step] * top + key[step:]
        _, key = np.unique(pair, return_inverse=True)
        top, width = int(key.max()) + 1, width + step
    twice = np.bincount(key)[key] > 1
    edge = np.zeros(len(codes) + 1, np.int64)
    np.add.at(edge, np.flatnonzero(twice), 1)
    np.add.at(edge, np.flatnonzero(twice) + window, -1)
    return int((np.cumsum(edge) > 0).sum())


def text_stats(text: str | None) -> tuple[int, int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines (lines with a word)."""
    words = _word.findall(text or "")
    if not words:
        return 0, 0, 0, 0, 0, 0
    ids: dict[str, int] = {}
    codes = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words))
    lines = [x for x in text.split("\n") if _word.search(x)]
    repeat = 0 if len(ids) > len(words) - REPEAT_WINDOW else repeated_words(codes)
    return len(words), sum(map(len, words)), len(text) - len(text.translate(_not_symbol)), len(lines) - len(set(lines)), repeat, len(lines)


def document_stats(df: DataFrame, id_col: str, text_col: str, host_col: str) -> DataFrame:
    """doc_id, host and the figures of text_stats, with one boolean a rule."""
    kind = dict(df.dtypes)[id_col]

    def stats(cols: dict[str, list]) -> dict[str, list]:
        found = list(zip(*map(text_stats, cols["text"]))) or [[]] * 6
        names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")
        return {"doc_id": cols["doc_id"], "host": cols["host"]} | dict(zip(names, found))

    rows = df.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"), F.coalesce(F.col(f"`{host_col}`").cast("string"), F.lit("")).alias("host"))
    out = map_rows(rows, stats, f"doc_id {kind}, host string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long")
    return out.select(
        "*",
        (F.col("n_words") < MIN_WORDS).alias("short"),
        (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")).alias("repeated"),
        (100 * F.col("n_symbols") > MAX_SYMBOL_PERCENT * F.col("word_chars")).alias("symbols"),
        (100 * F.col("n_dup_lines") > MAX_DUP_LINE_PERCENT * F.col("n_lines")).alias("dup_lines"),
    )


def host_verdicts(stats: DataFrame) -> DataFrame:
    """host, host_docs, host_rate_<rule> and host_ok: each rule's failure rate shrunk towards the mean of all hosts.

    The beta prior of a rule has the pooled rate as its mean; its strength comes from the variance of the
    hosts' rates beyond that of sampling (method of moments, hosts weighted by their documents), between 1 and
    MAX_PRIOR_STRENGTH documents. A host is rejected if, for one of the rules, hardly any of its posterior is below the limit
    that the pooled rate sets: a rate with LIFT times its odds, MIN_LIMIT at least.
    """
    rules = list(RULES)
    hosts = stats.groupBy("host").agg(F.count("*").alias("host_docs"), *[F.count_if(r).alias(r) for r in rules])
    pooled = hosts.agg(F.sum("host_docs").alias("n"), F.count("*").alias("h"), F.sum(F.col("host_docs").cast("double") ** 2).alias("n2"), *[F.sum(r).alias(r) for r in rules]).first()
    n = float(pooled["n"] or 1)
    mean = {r: (pooled[r] or 0) / n for r in rules}
    squares = hosts.agg(*[F.sum(F.col("host_docs") * (F.col(r) / F.col("host_docs") - mean[r]) ** 2).alias(r) for r in rules]).first()
    out, ok = hosts, F.lit(True)
    for r in rules:
        within = mean[r] * (1 - mean[r])
        between = ((squares[r] or 0.0) - (pooled["h"] - 1) * within) / max(n - (pooled["n2"] or 0.0) / n, 1.0)
        strength = min(max(within / between - 1, 1.0), MAX_PRIOR_STRENGTH) if between > 0 else MAX_PRIOR_STRENGTH
        rate = (F.col(r) + strength * mean[r]) / (F.col("host_docs") + strength)
        out = out.withColumn(f"host_rate_{r}", rate)
        limit = max(MIN_LIMIT, LIFT * mean[r] / (1 + (LIFT - 1) * mean[r]))
        ok = ok & (rate - ERRORS * F.sqrt(rate * (1 - rate) / (F.col("host_docs") + strength + 1)) <= limit)
    return out.select("host", "host_docs", *[f"host_rate_{r}" for r in rules], ok.alias("host_ok"))


def host_rules(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """One row a row of df: doc_id, host, the document's figures, its host's shrunk rates, base_failed and kept.

    A null text has no words and fails as short; a very long one is read whole; a null host is the host ''. Repeated rows count as often as
    they stand. Other columns of df are not read, whatever their names. An empty df gives no rows.
    """
    stats = cut(document_stats(df, id_col, text_col, host_col))  # figures only, no texts
    verdicts = cut(host_verdicts(stats))
    joined = salted_join(stats, verdicts, ["host"], hot_keys(verdicts, ["host"], "host_docs"), F.col("doc_id"), "left")
    failed = F.col("short") | F.col("repeated")
    return joined.select("*", failed.alias("base_failed"), (~failed & F.col("host_ok")).alias("kept"))


def op1_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    rates = [F.round(f"host_rate_{r}", 6).alias(f"host_rate_{r}") for r in RULES]
    return host_rules(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "host_docs", *rates, "host_ok")


_WORDS_SQL = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_RULES = {
    "short": f"n_words < {MIN_WORDS}", "repeated": f"100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words",
    "symbols": f"100 * n_symbols > {MAX_SYMBOL_PERCENT} * word_chars", "dup_lines": f"100 * n_dup_lines > {MAX_DUP_LINE_PERCENT} * n_lines",
}
QUERIES = {"op1_quality_rules": op1_quality_rules}
ORACLES = {
    "op1_quality_rules": rf"""
WITH w AS (SELECT doc_id, source, coalesce(text, '') AS text, {_WORDS_SQL} AS words FROM documents),
starts AS (SELECT doc_id, unnest(range(len(words) - {REPEAT_WINDOW - 1})) AS pos, words FROM w WHERE len(words) >= {REPEAT_WINDOW}),
win AS (SELECT doc_id, pos, array_to_string(words[pos + 1 : pos + {REPEAT_WINDOW}], ' ') AS win FROM starts),
twice AS (SELECT doc_id, pos FROM (SELECT doc_id, pos, count(*) OVER (PARTITION BY doc_id, win) AS n FROM win) WHERE n > 1),
rep AS (SELECT doc_id, count(DISTINCT pos + k) AS n FROM twice, range({REPEAT_WINDOW}) AS o(k) GROUP BY doc_id),
dup AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM w)
        WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
s AS (SELECT w.doc_id, coalesce(source, '') AS host, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
        (length(text) - length(translate(text, '{SYMBOLS}', '')))::BIGINT AS n_symbols, coalesce(dup.n, 0)::BIGINT AS n_dup_lines,
        coalesce(rep.n, 0)::BIGINT AS n_repeat_words, coalesce(dup.n_lines, 0) AS n_lines
      FROM w LEFT JOIN rep USING (doc_id) LEFT JOIN dup USING (doc_id)),
h AS (SELECT host, count(*) AS host_docs, {", ".join(f"count(*) FILTER (WHERE {c})::DOUBLE AS f_{r}" for r, c in _RULES.items())} FROM s GROUP BY host),
p AS (SELECT sum(host_docs)::DOUBLE AS n, count(*) AS hosts, sum(host_docs::DOUBLE ** 2) AS n2, {", ".join(f"sum(f_{r}) / sum(host_docs) AS m_{r}" for r in _RULES)} FROM h),
v AS (SELECT {", ".join(f"(sum(host_docs * (f_{r} / host_docs - m_{r}) ** 2) - (any_value(hosts) - 1) * any_value(m_{r} * (1 - m_{r}))) / greatest(any_value(n - n2 / n), 1.0) AS v_{r}" for r in _RULES)} FROM h, p),
k AS (SELECT {", ".join(f"CASE WHEN v_{r} > 0 THEN least(greatest(m_{r} * (1 - m_{r}) / v_{r} - 1, 1.0), {MAX_PRIOR_STRENGTH}) ELSE {MAX_PRIOR_STRENGTH} END AS k_{r}" for r in _RULES)} FROM p, v),
r AS (SELECT host, host_docs::BIGINT AS host_docs, {", ".join(f"(f_{r} + k_{r} * m_{r}) / (host_docs + k_{r}) AS host_rate_{r}, k_{r}, greatest({MIN_LIMIT}, {LIFT} * m_{r} / (1 + {LIFT - 1} * m_{r})) AS limit_{r}" for r in _RULES)} FROM h, p, k)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND host_ok AS kept, host_docs,
  {", ".join(f"round(host_rate_{r}, 6) AS host_rate_{r}" for r in _RULES)}, host_ok
FROM (SELECT s.*, r.*, {_RULES["short"]} OR {_RULES["repeated"]} AS base_failed, {" AND ".join(f"host_rate_{r} - {ERRORS} * sqrt(host_rate_{r} * (1 - host_rate_{r}) / (host_docs + k_{r} + 1)) <= limit_{r}" for r in _RULES)} AS host_ok FROM s JOIN r USING (host))
"""
}
