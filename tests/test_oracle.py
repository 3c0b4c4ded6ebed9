"""Every query with SQL against its SQL, on the smallest tables."""

import pytest

from lexigrid.plans import catalogue
from tests.oracle import compare, connect

SQL = catalogue.oracle_sql()


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, sf, con, name):
    compare(spark, con, sf, catalogue.queries()[name], SQL[name])


def test_every_sql_has_a_query():
    assert set(SQL) <= set(catalogue.queries())


@pytest.mark.parametrize("name", ["html_leaf_blocks", "lm_generate", "topic_words", "topic_forest", "topic_nmf"])
def test_query_without_sql_has_rows(spark, sf, name):
    assert catalogue.queries()[name](spark, sf).count() > 0
