"""Native operators stay in the JVM; one pass of Python where one is enough."""

import pytest

from parallax.llm.queries import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["op5_licenses", "op6_urls", "op8_pii"])
def test_native(spark, name):
    text = plan(QUERIES[name](spark, FOLDER))
    assert not any(word in text for word in ("Python", "Pandas", "Arrow", "Cartesian", "NestedLoop"))


@pytest.mark.parametrize("name", ["op3_language", "op9_quality", "op10_packing"])
def test_no_shuffle_and_one_python_node(spark, name):
    text = plan(QUERIES[name](spark, FOLDER))
    assert "Exchange" not in text and sum(text.count(node) for node in ("ArrowEvalPython", "MapInPandas", "MapInArrow")) == 1
