"""Every query over the reference's operators against its SQL."""

import pytest
from conftest import DATA
from oracle import connect, rows_of, rows_of_sql

from strandlake.plans import catalog

FOLDER = f"{DATA}/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_against_sql(spark, con, name):
    got = catalog.QUERIES[name](spark, FOLDER)
    want, columns = rows_of_sql(con, catalog.ORACLE_SQL[name])
    assert sorted(got.columns) == columns
    assert rows_of(got) == want


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_without_sql(spark, name):
    assert catalog.QUERIES[name](spark, FOLDER).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
