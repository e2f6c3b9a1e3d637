"""Every registered trajectory query against its SQL."""

import pytest

from kinetrail.plans.catalog import ORACLE_SQL, QUERIES
from tests.oracle import differences


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_rows_as_sql(spark, name):
    assert differences(spark, "/root/testdata/sf0.001", QUERIES[name], ORACLE_SQL[name]) == []


def test_entry_and_registry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
