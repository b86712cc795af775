"""Every registered query that has SQL gives its rows; the rest run."""

from __future__ import annotations

import pytest

from framewright.plans.queries import ORACLES, QUERIES
from tests.compare import same_rows


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, data, name):
    df = QUERIES[name](spark, data)
    if name in ORACLES:
        same_rows(df, ORACLES[name], data)
    else:
        assert df.count() > 0


def test_entry(spark, data):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
