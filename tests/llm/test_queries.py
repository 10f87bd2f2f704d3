"""Every training-data query with SQL agrees with DuckDB on the small tables."""

import pytest

from statloom.llm.queries import ORACLE, QUERIES
from tests.conftest import SMALL
from tests.oracle import compare, connect


def test_one_query_per_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_sql(spark, name):
    assert compare(QUERIES[name](spark, SMALL), connect(SMALL), ORACLE[name]) == []
