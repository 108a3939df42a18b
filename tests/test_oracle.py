"""Every query with check SQL gives the same rows on DuckDB; the others run."""

import os

import pytest

import __spark_entry__ as entry
from checks.compare import compare, connect

QUERIES = entry.queries()
ORACLE = entry.oracle_sql()
SF_DIR = os.environ.get("CHECK_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


def test_every_check_has_a_query():
    assert set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF_DIR)
    if name in ORACLE:
        assert compare(df, ORACLE[name], con) == ""
    else:
        assert df.count() > 0
