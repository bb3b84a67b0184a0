import pytest

from tests.oracle import compare
from tracemill.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_same_as_sql(spark, sf, name):
    assert compare(queries.QUERIES[name](spark, sf), queries.ORACLE_SQL[name], sf) == ""
