"""The registered queries on the smallest tables: against their SQL, or against what their columns are said to hold."""

import glob
import hashlib
import os
import re
import zlib

import duckdb
import pytest
from gridloom.llm import queries, secrets

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{FOLDER}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def rows(df):
    cell = lambda v: "" if v is None or v != v else f"{v:.5f}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    return sorted(tuple(cell(r[c]) for c in sorted(df.columns)) for r in df.astype(object).to_dict("records"))


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, duck, name):
    got, want = queries.QUERIES[name](spark, FOLDER).toPandas(), duck.execute(queries.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)


def documents(duck):
    return dict(duck.execute("SELECT doc_id, text FROM documents").fetchall())


def test_sharding_holds_its_law(spark, duck):
    texts = documents(duck)
    got = queries.QUERIES["op2_sharding"](spark, FOLDER).collect()
    assert {r.doc_id for r in got} == set(texts) and len(got) == len(texts)
    shards = {k: sorted(r.slot for r in got if r.shard == k) for k in range(24)}
    assert all(v == list(range(len(v))) for v in shards.values()) and max(map(len, shards.values())) - min(map(len, shards.values())) <= 1
    for r in got:
        raw = (texts[r.doc_id] or "").encode()
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(raw) + 8, zlib.crc32(raw), "rows", None)


def test_secrets_hold_every_base_span(spark, duck):
    base = {
        "assign": (re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), lambda m: len(m[1]) >= 6),
        "access": (re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20), "hex": (re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 24),
    }
    for r in queries.QUERIES["op6_secret_crf"](spark, FOLDER).collect():
        text = documents(duck)[r.doc_id] or ""
        found = {k: [m.span() for m in rx.finditer(text) if ok(m)] for k, (rx, ok) in base.items()}
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(map(len, found.values()))
        spans = sorted((a, list(base).index(k), f"{k}:{a}:{b}") for k, v in found.items() for a, b in v)
        joined = ",".join(s for *_, s in spans)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert [s for s in r.spans.split(",") if s and not s.startswith(secrets.CRF)] == [s for *_, s in spans]


def test_scores_and_texts_have_a_row_each(spark, duck):
    got = queries.QUERIES["op7_toxicity"](spark, FOLDER).collect()
    assert len(got) == len(documents(duck)) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    pages = {r.page_id: r for r in queries.QUERIES["op5_html_extract"](spark, FOLDER).collect()}
    urls = dict(duck.execute("SELECT page_id, url FROM pages").fetchall())
    assert pages.keys() == urls.keys() and all(r.url == urls[k] and r.n_chars == len(r.text) and "<" not in r.text for k, r in pages.items())
