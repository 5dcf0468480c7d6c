"""Every query with SQL against DuckDB, on the smallest tables."""

import glob
import os

import duckdb
import pytest
from gridloom.plans import catalog

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{FOLDER}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def rows(df):
    def cell(v):
        if v is None or v != v:
            return ""
        if isinstance(v, bool):
            return str(v)
        if isinstance(v, (int, float)):
            return f"{float(v) + 0.0:.5f}"
        return str(v)[:10] if hasattr(v, "year") else str(v)

    return sorted(tuple(cell(r[c]) for c in sorted(df.columns)) for r in df.astype(object).to_dict("records"))


# every fifth query here, to keep the suite short; all of them at sf0.01 is a job of its own
@pytest.mark.parametrize("name", sorted(catalog.ORACLES)[::5])
def test_query_equals_sql(spark, duck, name):
    got = catalog.QUERIES[name](spark, FOLDER).toPandas()
    want = duck.execute(catalog.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
