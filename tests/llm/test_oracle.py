import pytest

from lexigrid.llm import queries as Q
from tests.oracle import compare, connect

SQL = Q.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, sf, name):
    compare(spark, connect(sf), sf, Q.queries()[name], SQL[name])
