"""Every registered query against its SQL twin, and plan checks on all of them."""

import pytest
from compare import connect, duck_rows, spark_rows

import __spark_entry__ as entry
from staywide.checks.oracles import oracle_sql
from staywide.checks.queries import REGISTRY

SF_DIR = "/root/testdata/sf0.001"
QUERIES = REGISTRY
SQL = oracle_sql()

# Queries that call a model; all others must stay out of Python.
MODEL_QUERIES = {
    "apply_model_stub",
    "apply_model_null",
    "apply_model_waves",
    "two_step_chain",
    "voting_run",
    "one_step_run",
    "checkpoint_resume",
}


@pytest.fixture(scope="module")
def duck():
    return connect(SF_DIR)


def test_every_query_has_a_twin():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF_DIR)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan
    assert "NestedLoopJoin" not in plan
    if name not in MODEL_QUERIES:
        assert "InPandas" not in plan and "Python" not in plan
    assert spark_rows(df) == duck_rows(duck, SQL[name])


def test_entry(spark):
    df = entry.entry(spark)
    assert len(df.columns) == 49
    assert df.count() == df.select("stay_id").distinct().count() == 199
