"""A sample of registered queries against their SQL; ``tests/compare.py`` runs them all."""

import pytest

import __spark_entry__ as contract
from tests.compare import compare, connect

FOLDER = "/root/testdata/sf0.001"
SAMPLE = [
    "profile_columns", "conform", "orphan_keys", "numeric_overview", "missing_per_row",
    "association_matrix", "classification_metrics", "threshold_table", "psi_numeric",
    "validate_rows", "top_contributions", "error_rate_stream",
]


@pytest.mark.parametrize("name", SAMPLE)
def test_query(spark, name):
    problem = compare(
        spark, connect(FOLDER), name, contract.queries()[name], contract.oracle_sql()[name], FOLDER
    )
    assert not problem, problem


def test_every_oracle_has_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())


def test_flagship(spark):
    assert {r["colonne"] for r in contract.entry(spark).collect()} == {"lang", "source", "n_chars"}
