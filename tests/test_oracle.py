"""Every registered query against its SQL, on the smallest tables.

QUERIES=a,v13 limits the run to names with these prefixes; SF picks the table size.
"""

import os

import pytest
from harness import DATA, compare, duck, plan_problem

import quillcheck.plans.all  # noqa: F401
from quillcheck.plans.registry import PLANS

SF_DIR = f"{DATA}/sf{os.environ.get('SF', '0.001')}"
WANTED = [p for p in os.environ.get("QUERIES", "").split(",") if p]


@pytest.fixture(scope="module")
def con():
    return duck(SF_DIR)


@pytest.mark.parametrize("name", [n for n in sorted(PLANS) if not WANTED or any(n.startswith(w) for w in WANTED)])
def test_matches_sql(spark, con, name):
    p = PLANS[name]
    if p.oracle is None:
        df = p(spark, SF_DIR)
        assert df.count() > 0 and plan_problem(df, name) is None
    else:
        assert compare(spark, con, p, SF_DIR) is None
