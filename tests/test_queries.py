"""Every registered query runs, and agrees with its SQL."""

import pytest

from papyra.plans.catalogue import ORACLE, QUERIES

from .conftest import SF
from .oracle import assert_same


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    df = QUERIES[name](spark, SF)
    if name in ORACLE:
        assert_same(df, ORACLE[name], SF)
    else:
        assert df.count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
