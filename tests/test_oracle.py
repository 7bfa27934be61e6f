"""Every registered query against its SQL on the smallest tables."""

import oracle
import pytest
from conftest import SF

from gridlake.queries import ORACLE, QUERIES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    assert name in ORACLE, f"{name} has no SQL: test it by brute force"
    assert oracle.compare(df, duck, ORACLE[name]) is None


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert set(entry.queries()) >= set(QUERIES) and set(entry.oracle_sql()) >= set(ORACLE)
    assert entry.entry(spark).count() > 0
