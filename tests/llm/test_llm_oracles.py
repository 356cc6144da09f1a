import pytest

from oracles import same
from tagloom.llm.queries import oracle_sql, queries


@pytest.mark.parametrize("name", oracle_sql())
def test_query_equals_its_sql(spark, name):
    assert same(spark, queries()[name], oracle_sql()[name])
