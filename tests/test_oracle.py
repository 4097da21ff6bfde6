"""Every core query against its SQL."""

import os

import pytest

import oracle
from earshot.plans import registry

QUERIES, SQL = registry.gather()
SLOW = {"direction_models", "return_models", "walk_forward", "role_classifier", "role_predictions", "finance_run_all"}


@pytest.fixture(scope="session")
def con():
    return oracle.connection()


@pytest.mark.skipif(not os.path.isdir(oracle.DATA), reason="no test data")
@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, con, name):
    columns, rows = oracle.spark_rows(QUERIES[name](spark, oracle.DATA))
    want_columns, want = oracle.sql_rows(con, SQL[name])
    assert columns == want_columns
    assert rows == want


@pytest.mark.skipif(not os.path.isdir(oracle.DATA), reason="no test data")
@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL) - SLOW))
def test_runs(spark, name):
    assert QUERIES[name](spark, oracle.DATA).count() > 0


@pytest.mark.skipif(not os.path.isdir(oracle.DATA), reason="no test data")
def test_text_queries_are_not_vacuous(spark):
    q = QUERIES["lexicon_sentiment_chunks"](spark, oracle.DATA)
    assert q.filter("pos > 0").count() > 0 and q.filter("neg > 0").count() > 0 and q.filter("unc > 0").count() > 0
    assert QUERIES["keyword_negation_severity"](spark, oracle.DATA).filter("severity <> 'medium'").count() > 0
