"""Every llm query with check SQL gives the same rows on DuckDB."""

import os

import pytest

from checks.compare import compare, connect
from mailsieve.llm.queries import ORACLE, QUERIES

SF_DIR = os.environ.get("CHECK_SF_DIR", "/root/testdata/sf0.001")


def test_one_query_per_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    assert set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query(spark, name):
    assert compare(QUERIES[name](spark, SF_DIR), ORACLE[name], connect(SF_DIR)) == ""
