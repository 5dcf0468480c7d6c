"""Queries and SQL of this subpackage, by name."""

from __future__ import annotations

from . import decontaminate, html_extract, importance, kneser_ney, line_dedup, ngram_jaccard, packing, pieces, quality_rules, secrets, sharding, spelling, toxicity

_MODULES = [quality_rules, sharding, ngram_jaccard, decontaminate, html_extract, secrets, toxicity, kneser_ney, packing, line_dedup, spelling, importance, pieces]
QUERIES = {k: f for m in _MODULES for k, f in m.QUERIES.items()}
ORACLES = {k: sql for m in _MODULES for k, sql in m.ORACLES.items()}
