"""Every clustering query with SQL gives what the SQL gives."""

import pytest

from basinflow.plans import oracles
from basinflow.queries import QUERIES


@pytest.mark.parametrize("name", sorted(oracles.SQL))
def test_query_equals_sql(compare, name):
    compare(name)


def test_sql_has_a_query_each():
    assert set(oracles.SQL) <= set(QUERIES)


def test_entry_runs(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["root", "size"]
    assert set(QUERIES) <= set(__spark_entry__.queries())
