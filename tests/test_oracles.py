"""Every query with SQL gives DuckDB's rows; the others run."""

from __future__ import annotations

import pytest
from oracle import connect, differences

from __spark_entry__ import entry, oracle_sql, queries

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_matches_sql(spark, con, name):
    assert differences(spark, con, FOLDER, queries()[name], oracle_sql()[name]) is None


@pytest.mark.parametrize("name", sorted(set(queries()) - set(oracle_sql())))
def test_runs(spark, name):
    assert queries()[name](spark, FOLDER).collect()


def test_entry(spark):
    assert entry(spark).columns[0] == "cve_id"
