"""Every registered query against its SQL oracle on small tables."""

import os

import pytest

import oracle
from argusline.plans import catalog

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, con, name):
    df = catalog.QUERIES[name](spark, SF_DIR)
    if name in catalog.ORACLE_SQL:
        assert oracle.differences(df, con, catalog.ORACLE_SQL[name]) is None
    else:
        # Checked against plain computations in test_inspection and test_units.
        assert df.count() > 0 and len(set(df.columns)) == len(df.columns)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(catalog.ORACLE_SQL) <= set(__spark_entry__.queries())
