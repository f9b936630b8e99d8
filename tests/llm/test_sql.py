"""The queries that SQL can express, against it."""

import oracle
import pytest

from cadenza.llm import queries


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_matches_sql(spark, sf, name):
    assert oracle.differences(spark, oracle.connect(sf), sf, queries.QUERIES[name], queries.SQL[name]) is None


def test_all_eleven_are_registered():
    import __spark_entry__ as entry

    assert [n.split("_")[0] for n in queries.QUERIES] == [f"op{i}" for i in range(1, 11)] + ["pipeline"]
    assert set(queries.QUERIES) <= set(entry.queries()) and set(queries.SQL) <= set(entry.oracle_sql())
