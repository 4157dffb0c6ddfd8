import pytest

from pagewright.llm import catalog

from ..harness import differences

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_equals_sql(spark, name):
    assert not differences(spark, catalog.queries(), catalog.oracle_sql(), name, SF)


def test_a_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in catalog.queries()) == list(range(1, 11))
