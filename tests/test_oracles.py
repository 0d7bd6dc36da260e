import pytest

import __spark_entry__ as entry_points
from compare import difference

from callsieve.plans.oracles import ORACLES
from callsieve.plans.registry import QUERIES


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(entry_points.queries()) and set(ORACLES) <= set(entry_points.oracle_sql())


@pytest.mark.parametrize("name", QUERIES)
def test_query_equals_sql(spark, sf_dir, name):
    assert difference(QUERIES[name](spark, sf_dir), sf_dir, ORACLES[name]) == ""


def test_entry(spark):
    assert entry_points.entry(spark).count() == 12
