import pytest

from pagewright.plans import catalog

from .harness import differences, duck

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_equals_sql(spark, con, name):
    assert not differences(spark, catalog.QUERIES, catalog.SQL, name, SF, con)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_runs(spark, name):
    out = catalog.QUERIES[name](spark, SF)
    assert len(set(out.columns)) == len(out.columns) and out.count() > 0
