"""Every registered query against its SQL on the smallest tables."""

import pytest
from compare import compare, connect

from quantspark.plans import REGISTRY

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def oracle():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(REGISTRY))
def test_query(spark, oracle, name):
    ok, _, message, _ = compare(spark, oracle, name, FOLDER)
    assert ok, message


def test_columns_match_the_declared_ones(spark):
    import __spark_entry__ as entry

    df = entry.entry(spark)
    assert df.columns == [n for n, _ in REGISTRY["dip_trades"].spec()]
    assert set(entry.oracle_sql()) <= set(entry.queries())
