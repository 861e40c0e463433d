from __future__ import annotations

import pytest

from corpusgraph import catalog
from tests.conftest import DATA


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_matches_sql(name, same):
    same(catalog.queries()[name], catalog.oracle_sql()[name])


def test_entry_runs(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns
    assert set(catalog.queries()) <= set(__spark_entry__.queries())
    assert DATA
