"""Every registered query that has SQL gives the rows of that SQL."""

import pytest

from creditlens.catalog import ORACLES, QUERIES
from tests.compare import compare, duck

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SMALL)


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_names():
    assert not any("pipeline" in n or n.startswith("op") for n in QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, con, name):
    problems, rows = compare(spark, con, QUERIES[name], ORACLES[name], SMALL)
    assert not problems
    assert rows > 0
