import pytest
from compare import duck_rows, spark_rows

from corpuscle.plans.catalogue import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, sf, name):
    got = spark_rows(QUERIES[name](spark, sf))
    assert got == duck_rows(sf, ORACLES[name])
