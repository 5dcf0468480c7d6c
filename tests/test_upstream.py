"""Upstream closure without a limit on depth."""

import pytest
from gridloom.operators import joins
from gridloom.plans import catalog
from test_oracles import FOLDER, duck, rows  # noqa: F401


def test_chain_is_followed_to_its_end(spark):
    deep = 70
    chain = [(0, 0), *[(i, i - 1) for i in range(1, deep)], (1000, 999)]
    got = joins.upstream(spark.createDataFrame(chain, "id long, next_down long"), spark.createDataFrame([(3,)], "id long"))
    assert sorted(x.id for x in got.collect()) == list(range(3, deep))


def test_cycle_and_two_ways_down_end(spark):
    edges = [(1, 2), (2, 3), (3, 1), (4, 2), (5, 4), (5, 3), (6, 7)]
    got = joins.upstream(spark.createDataFrame(edges, "id long, next_down long"), spark.createDataFrame([(1,), (1,)], "id long"))
    assert sorted(x.id for x in got.collect()) == [1, 2, 3, 4, 5]


@pytest.mark.parametrize("name", ["jn20_tree_closure", "gr06_upstream", "st03_union_fixed_point"])
def test_queries_equal_sql(spark, duck, name):  # noqa: F811
    assert rows(catalog.QUERIES[name](spark, FOLDER).toPandas()) == rows(duck.execute(catalog.ORACLES[name]).df())
