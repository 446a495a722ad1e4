"""Every named query against its SQL, and the driver's entry points."""

import pytest

import __spark_entry__ as driver
from oracle import DATA, compare, connect
from paneloom.catalog import CATALOG

SF = f"{DATA}/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", list(CATALOG))
def test_query(spark, con, name):
    query = CATALOG[name]
    df = query.run(spark, SF)
    if query.sql is None:
        assert df.count() > 0
    else:
        assert compare(df, con, query.sql) is None


def test_entry(spark):
    df = driver.entry(spark)
    assert df.count() == 150 and len(df.columns) == 106
    assert driver.queries().keys() >= driver.oracle_sql().keys()
