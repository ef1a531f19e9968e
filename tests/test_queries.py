"""Every registered query against its SQL on the smallest tables."""

from pathlib import Path

import oracle
import pytest

from zygospark.plans.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF)


@pytest.mark.skipif(not Path(SF).exists(), reason="test tables not present")
@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    problem, rows, _ = oracle.check(spark, con, name, QUERIES[name], ORACLES.get(name), SF)
    assert problem is None
    assert rows > 0
