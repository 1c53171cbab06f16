"""Every registered query against its SQL at the smallest size."""

import pytest
from conftest import SF, rows_of

from gridfolk.plans.catalogue import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_gives_the_rows_of_its_sql(spark, duck, name):
    assert rows_of(QUERIES[name](spark, SF).toPandas()) == rows_of(duck.execute(ORACLES[name]).df())


def test_every_query_has_sql():
    assert set(ORACLES) == set(QUERIES)
