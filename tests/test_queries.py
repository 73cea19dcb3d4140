"""Every registered query against its SQL, and what its plan must not contain."""

import re

import pytest

import __spark_entry__ as entry
from tests.compare import difference, duck

FOLDER = "/root/testdata/sf0.001"
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


def check_plan(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan
    for line in plan.splitlines():
        # A window names its partition columns in brackets before those of the order.
        if re.match(r"^[\s:+*()\d-]*Window \[", line):
            assert re.search(r"\], \[[^\]]+\], \[[^\]]*\]$", line), line


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, FOLDER)
    check_plan(df)
    if name in ORACLES:
        problem = difference(df, con, ORACLES[name])
        # A derived fault need not occur in the smallest tables.
        assert problem in (None, "both empty"), problem
    else:
        assert len(df.collect()) > 0
