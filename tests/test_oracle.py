"""Every registered query against its check SQL on the small tables."""

import os

import pytest

import harness
from voxtrail.plans import CHECKS, QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return harness.connection(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan
    got = df.toPandas()
    assert len(set(got.columns)) == len(got.columns)
    if name in CHECKS:
        assert harness.compare(got, con.execute(CHECKS[name]).fetchdf()) is None
    else:
        assert len(got)
