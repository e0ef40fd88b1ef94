import pytest

from workload.check import compare, connect
from workload.queries import QUERIES


@pytest.fixture(scope="module")
def duck(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_agrees_with_its_sql(spark, duck, sf_dir, name):
    good, note = compare(spark, duck, sf_dir, name)
    assert good, note
