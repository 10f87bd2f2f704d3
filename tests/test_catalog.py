"""Every registered query with SQL agrees with DuckDB on the small tables."""

import pytest

from __spark_entry__ import oracle_sql, queries
from tests.conftest import SMALL
from tests.oracle import compare, connect

QUERIES, ORACLE = queries(), oracle_sql()
# too slow for a unit test; run by hand and by the correctness gate
SLOW = {"grid_search_scores", "softmax_boosted_scores", "boosted_tree_full_scores"}


@pytest.fixture(scope="module")
def con():
    return connect(SMALL)


def test_every_sql_has_a_query():
    assert set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize("name", [n for n in QUERIES if n in ORACLE])
def test_matches_sql(spark, con, name):
    assert compare(QUERIES[name](spark, SMALL), con, ORACLE[name]) == []


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in ORACLE and n not in SLOW])
def test_runs(spark, name):
    assert QUERIES[name](spark, SMALL).count() > 0


def test_losses_have_the_trials_of_the_reference(spark):
    trials = QUERIES["loss_by_trial"](spark, SMALL).agg({"trial": "max", "*": "count"}).first()
    assert sorted(trials) == [10_000, 10_000]


def test_projection_has_the_seasons_of_the_reference():
    assert "h3" in ORACLE["projected_seasons"]
