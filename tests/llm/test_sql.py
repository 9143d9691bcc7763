"""Corpus queries against their SQL."""

import pytest

from sluice.llm import queries
from tests import oracle


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_agrees_with_sql(spark, name):
    oracle.assert_same(spark, oracle.database(), queries.QUERIES[name], queries.SQL[name])
