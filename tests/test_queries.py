"""Every query of the reference's operators against its SQL, on the smallest tables."""

import pytest
from oracle import compare, duck

from lodestone import plans

QUERIES, ORACLES = plans.queries(), plans.oracles()


@pytest.fixture(scope="module")
def con(sf_dir):
    return duck(sf_dir)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, sf_dir, con, name):
    assert compare(QUERIES[name](spark, sf_dir), con, ORACLES[name]) == ""


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs_and_agrees_with_itself(spark, sf_dir, name):
    first = sorted(map(str, QUERIES[name](spark, sf_dir).collect()))
    assert first == sorted(map(str, QUERIES[name](spark, sf_dir).collect()))


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
