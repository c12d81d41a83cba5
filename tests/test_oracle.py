"""Every registered query against its DuckDB statement, on the smallest tables."""

import oracle
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
PLAIN = {name: f for module in entry._PLANS for name, f in module.Q.items()}
STATEMENTS = {name: s for module in entry._PLANS for name, s in module.SQL.items()}


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF)


@pytest.mark.parametrize("name", sorted(STATEMENTS))
def test_matches_duckdb(spark, con, name):
    assert oracle.differences(PLAIN[name](spark, SF), STATEMENTS[name], con) == ""


@pytest.mark.parametrize("name", sorted(set(PLAIN) - set(STATEMENTS)))
def test_runs(spark, name):
    assert PLAIN[name](spark, SF).count() >= 0


def test_entry(spark):
    assert entry.entry(spark).columns
