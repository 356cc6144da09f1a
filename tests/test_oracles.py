import pytest

from oracles import SF, same
from tagloom.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", ORACLES)
def test_query_equals_its_sql(spark, name):
    assert same(spark, QUERIES[name], ORACLES[name])


def test_every_query_has_its_sql():
    assert set(QUERIES) == set(ORACLES)


def test_selection_lexes_once_and_does_not_shuffle(spark):
    for name in ("select_many", "select_child_path", "select_multi"):
        plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Generate") == 1 and "Exchange" not in plan


def test_entry_file_works_without_the_training_data_part():
    import __spark_entry__

    assert set(QUERIES) <= set(__spark_entry__.queries()) and set(ORACLES) <= set(__spark_entry__.oracle_sql())
