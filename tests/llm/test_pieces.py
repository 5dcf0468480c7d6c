"""Encoding and decoding against the sentencepiece library: ids, spans, texts, and normalisation by compiled maps."""

import hashlib
import random

import duckdb
import public_tokenizers
import pytest
import sentencepiece
from gridloom.llm import pieces, queries

PATH = public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, ids string, starts int, decoded string, __0 string, __1 int"


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def model():
    with open(PATH, "rb") as f:
        return pieces._registered(f.read())


def texts():
    rng = random.Random(1)
    parts = ["▁", "\n", "\t", "a", " the", "ing", "été", "中文", "😀", "\0", "<s>", "</s>", "'", " ", "  ", "​", "\U0010ffff", "ﷺ", "x-", "1"]
    made = ["".join(rng.choice(parts) for _ in range(rng.randrange(0, 30))) for _ in range(1500)]
    return [*made, "", " ", "x" * 3000, " " * 3000, "▁" * 50, "ab" * 20000, "a b " * 300_000]


def test_ids_spans_and_texts_are_the_library_s(library, model):
    for text in texts():
        ids, starts, ends = (x.tolist() for x in model.encode(text))
        assert ids == library.encode(text, add_eos=True)
        assert model.decode(ids) == library.decode(ids)
        if len(text) < 5000:
            assert list(zip(starts, ends))[:-1] == [(p.begin, p.end) for p in library.encode(text, return_type="proto").pieces]
        covered = [0, *ends]
        assert all(a == b or a == c for a, b, c in zip(starts, covered, starts)) and starts[-1] == ends[-1] == len(text.encode())


def test_decoding_any_ids(library, model):
    rng = random.Random(2)
    for _ in range(2000):
        ids = [rng.choice([0, 1, 2, 3 + rng.randrange(256), 259, rng.randrange(32000), 28705]) for _ in range(rng.randrange(0, 12))]
        assert model.decode(ids) == library.decode(ids)


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc_cf"])
@pytest.mark.parametrize("dummy", [False, True])
@pytest.mark.parametrize("squeeze", [False, True])
def test_compiled_maps_are_read_and_aligned(rule, dummy, squeeze):
    theirs = sentencepiece.SentencePieceNormalizer(rule_name=rule, add_dummy_prefix=dummy, remove_extra_whitespaces=squeeze, escape_whitespaces=True)
    spec = next(dict(pieces._fields(v)) for k, v in pieces._fields(theirs.serialized_model_proto()) if k == 3)
    ours = pieces.Normalizer(spec[2], dummy, squeeze)
    rng = random.Random(3)
    letters = "aé ①ﷺＡｶﾞ́e가  İß​\t\n▁ﬁ😀क़  "
    for _ in range(600):
        text = "".join(rng.choice(letters) if rng.random() < 0.9 else chr(rng.choice([rng.randrange(32, 0xD7FF), rng.randrange(0x10000, 0x1FFFF)])) for _ in range(rng.randrange(0, 12)))
        want, offsets = theirs.normalize(text, with_offsets=True)
        got, where = ours.normalize(text)
        assert got == want and (not got or [len(text.encode()[:k].decode()) for k in where.tolist()] == offsets)


def test_portions_do_not_change_pieces(model, monkeypatch):
    text = "ab  cd▁ e\nfg " * 300 + " " * 40 + "é" * 90
    whole = [x.tolist() for x in model.encode(text)]
    for size in (1, 7, 64):
        monkeypatch.setattr(pieces, "PORTION", size)
        monkeypatch.setattr(pieces, "REMEMBERED", size)
        assert [x.tolist() for x in model.encode(text)] == whole


def test_query_digests_are_the_library_s(spark, library):
    want = {}
    for doc_id, text in duckdb.connect().execute("SELECT doc_id, text FROM '/root/testdata/sf0.001/documents.parquet'").fetchall():
        ids = library.encode(text or "", add_eos=True)
        digests = (hashlib.sha256(x.encode()).hexdigest() for x in (" ".join(map(str, ids)), library.decode(ids)))
        want[doc_id] = (len(ids), *digests, len((text or "").encode()))
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256, r.n_source_bytes) for r in queries.QUERIES["op13_sentencepiece"](spark, "/root/testdata/sf0.001").collect()}
    assert got == want


def test_nulls_repeats_clashing_names_and_empty_tables(spark, library):
    rows = [(1, "a b", "x", 1, "y", "z", 2), (1, "a b", "x", 1, "y", "z", 2), (None, None, None, None, None, None, None), (2, "", "", 0, "", "", 0)]
    out = pieces.decode(pieces.encode(spark.createDataFrame(rows, SCHEMA), PATH), PATH)
    assert sorted(out.columns) == sorted(["doc_id", "text", "__0", "__1", "ids", "starts", "ends", "decoded"])
    got = sorted(((r.doc_id, r.text, r["__0"], r["__1"], r.ids, r.starts, r.ends, r.decoded) for r in out.collect()), key=str)
    ab = (1, "a b", "z", 2, [*library.encode("a b"), 2], [0, 1, 3], [1, 3, 3], "a b")
    assert got == sorted([ab, ab, (None, None, None, None, [2], [0], [0], ""), (2, "", "", 0, [2], [0], [0], "")], key=str)
    assert pieces.decode(pieces.encode(spark.createDataFrame([], SCHEMA), PATH), PATH).count() == 0
    assert pieces.decode(spark.createDataFrame([(None,), ([],)], "ids array<int>"), PATH).collect() == [(None, ""), ([], "")]
