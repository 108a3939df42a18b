"""The operators marked native run no Python on the executors and shuffle no texts twice."""

import re

import pytest

from mailsieve.llm.queries import QUERIES


@pytest.mark.parametrize("name", ["op6_fingerprints", "op7_quality_rules", "op8_secret_scan"])
def test_no_python(spark, small, name):
    plan = QUERIES[name](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_rules_do_not_shuffle(spark, small):
    plan = QUERIES["op7_quality_rules"](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
