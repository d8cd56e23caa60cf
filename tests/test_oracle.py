"""Every registered query against its oracle SQL on the smallest tables."""

from __future__ import annotations

import pytest

import __spark_entry__ as contract
from tests.oracle_check import difference, duck

FOLDER = "/root/testdata/sf0.001"
ORACLES = contract.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(contract.queries())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_oracle(spark, con, name):
    actual = contract.queries()[name](spark, FOLDER).toPandas()
    assert difference(actual, con.execute(ORACLES[name]).df()) is None


# they fit 300 trees each; model_checks and train_report run the same steps
SAME_STEPS = {"model_predictions", "explanations"}


@pytest.mark.parametrize("name", sorted(set(contract.queries()) - set(ORACLES) - SAME_STEPS))
def test_runs_without_oracle(spark, name):
    assert contract.queries()[name](spark, FOLDER).count() > 0


def test_entry(spark):
    assert contract.entry(spark).count() == 10277
