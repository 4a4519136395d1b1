"""Queries of the subpackage against their SQL over the whole small tables; those without SQL run."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
from oracle import canonical, connect

from pagequarry.llm import plans

D = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_query_equals_sql(spark, name):
    got = plans.QUERIES[name](spark, D).toPandas()
    expected = connect(D).execute(plans.SQL[name]).df()
    assert sorted(got.columns) == sorted(expected.columns) and canonical(got) == canonical(expected)


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.SQL)))
def test_query_without_sql_runs(spark, name):
    assert plans.QUERIES[name](spark, D).toPandas() is not None
