"""Every registered query of the sound and study operators runs; those with SQL return what the SQL returns."""

import pytest
from sqlcheck import connection, same

from sonora import plans

ORACLES = plans.all_oracles()


@pytest.fixture(scope="module")
def db(sf_dir):
    return connection(sf_dir)


@pytest.mark.parametrize("name", sorted(plans.all_queries()))
def test_query(spark, sf_dir, db, name):
    df = plans.all_queries()[name](spark, sf_dir)
    if name in ORACLES:
        same(df, db, ORACLES[name])
    else:
        assert df.count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
