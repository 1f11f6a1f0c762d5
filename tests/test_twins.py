"""Every registered query against its SQL twin on the smallest tables."""

import pytest
from twin import compare, connect

from floeframe.plans.catalogue import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_twin(spark, con, name):
    problem = compare(QUERIES[name](spark, SF), con, ORACLES[name])
    assert problem is None, problem


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", ["gbt_skill", "hindcast"])
def test_model_jobs_give_rows(spark, name):
    rows = QUERIES[name](spark, SF).collect()
    assert {r["predictor"] for r in rows} == {"model", "persistence"}
