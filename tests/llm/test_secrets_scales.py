"""What the field adds to the base patterns, on tables of two sizes: planted forms are found, the tables' own texts left alone."""

import pytest
from gridloom.llm import queries, secrets

#: Secrets of forms that the base patterns do not know, and harmless lines.
SECRETS = """pwd: hunter2secret99
passcode = 8361940275
signing_key=9F86D081884C7D659A2FEAA0C55AD015A3BF4F1B2B0B822C
bearer: aB3dE5gH7jK9mN1pQ3sT5vX7zB9dF1hJ
private_key => "q8Zt7LmX2vBn4KjH6gFd9sPa1oIuYeWr"
credential = "Xk29fLq8Zr"
auth_token -> 7f3a9c2e5b8d1f4a6c9e
client-key: Zm9vYmFyYmF6cXV4MTIzNDU2Nzg5MA==
passphrase: "Tr7xQm2Lp9"
license_key=A1B2C3D4E5F6G7H8J9K0L1M2N3
encryption-key: 0x9fA3kLmP2qRsT4uVwX6yZ8bC
token eyJhbGciOiJIUzI1NiIsInR5cCI6IkpXVCJ9.eyJzdWIiOiIxMjM0NTY3ODkwIn0.dozjgNryP4J3jVmNHl0w5N""".split("\n")
HARMLESS = """user: johnsmith
version = 4.2.11
date: 2024-03-05
see https://www.example.com/path/to/page-2024
count=123456
the token of respect
ID 20240305
file: report_final_v2.txt
GREAT DEALS!! BUY NOW!!
name: Mary Jones
size=1024
login: guest""".split("\n")


@pytest.mark.parametrize("scale", ["sf0.001", "sf0.01"])
def test_planted_forms_are_found_and_nothing_else(spark, scale):
    docs = spark.read.parquet(f"/root/testdata/{scale}/documents.parquet")
    tagger = secrets.Tagger(secrets.learned(secrets.fitting_sample(docs, "doc_id", "text")))
    around = [r.text for r in docs.where("length(text) > 300").orderBy("doc_id").limit(len(SECRETS + HARMLESS)).collect()]
    texts = [f"{a[:150]}\n{line}\n{a[150:300]}" for a, line in zip(around, SECRETS + HARMLESS)]
    inside = []
    for text, line, spans in zip(texts, SECRETS + HARMLESS, tagger.tag(texts)):
        spans += [(a, b) for a, b, _ in secrets.base_spans(text)]
        at = text.index(line)
        assert all(at <= a and b <= at + len(line) and " " not in text[a:b] for a, b in spans), (line, spans)
        inside.append(bool(spans))
    assert sum(inside[: len(SECRETS)]) >= len(SECRETS) - 2 and not any(inside[len(SECRETS) :])


def test_query_adds_no_span_where_there_is_no_secret(spark):
    """All secrets of the table are of the base's own forms."""
    got = queries.QUERIES["op6_secret_crf"](spark, "/root/testdata/sf0.01").collect()
    assert len(got) == 1000 and not any(f"{secrets.CRF}:" in r.spans for r in got)
