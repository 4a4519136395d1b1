"""Every query that has SQL gives the rows of its SQL, over the whole small tables."""

import pytest
from oracle import canonical, connect

import __spark_entry__ as entry
from pagequarry.plans import audit, content, network, reports, structure

D = "/root/testdata/sf0.001"
CORE = [m for m in (audit, reports, network, content, structure)]
NAMES = sorted(n for m in CORE for n in m.SQL)


@pytest.fixture(scope="module")
def con():
    return connect(D)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, con, name):
    got = entry.queries()[name](spark, D).toPandas()
    expected = con.execute(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(expected.columns)
    assert canonical(got) == canonical(expected)


@pytest.mark.parametrize("name", sorted(n for m in CORE for n in m.QUERIES if n not in m.SQL))
def test_query_without_sql_runs(spark, name):
    assert entry.queries()[name](spark, D).toPandas() is not None


def test_entry(spark):
    assert entry.entry(spark).columns == ["crawl_id", "url", "change_type"]


def test_names_are_unique():
    names = [n for m in CORE for n in m.QUERIES]
    assert len(names) == len(set(names))


def test_filters_reach_the_scan(spark):
    from pagequarry.operators.filters import list_pages
    from pagequarry.session import table

    df = list_pages(table(spark, D, "crawled_urls"), status_code=404).select("id")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(status_code,404)" in plan and "ReadSchema: struct<id:string,status_code:int>" in plan
