import pytest

from loopweave.plans import catalog

from .compare import SF, agree, connection


@pytest.fixture(scope="module")
def con():
    return connection()


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_against_sql(spark, con, name):
    agree(catalog.QUERIES[name](spark, SF), con, catalog.SQL[name])


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_without_sql(spark, name):
    """Their rows are tested on planted inputs (test_patching, test_modes, test_operators, test_pipeline); here, that none comes twice."""
    df = catalog.QUERIES[name](spark, SF)
    assert df.count() == df.distinct().count()


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
