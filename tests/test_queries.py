"""Every registered query against its DuckDB SQL on the smallest tables."""

from pathlib import Path

import pytest
from compare import compare, connect

from __spark_entry__ import entry, oracle_sql, queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="test tables are not here")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_matches_sql(spark, con, name):
    ok, note = compare(queries()[name](spark, SF), con, oracle_sql()[name])
    assert ok, note


def test_rational_fit_covers_all_parts(spark):
    rows = queries()["fit_rational"](spark, SF)
    assert rows.count() == spark.read.parquet(f"{SF}/part.parquet").count()


def test_entry(spark):
    assert entry(spark).limit(1).count() == 1
