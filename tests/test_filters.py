from pyspark.sql import functions as F

from pagequarry.operators import filters, reports, rules
from pagequarry.session import table

D = "/root/testdata/sf0.001"


def test_pages_do_not_overlap_and_miss_nothing(spark):
    pages = table(spark, D, "crawled_urls").select("id", "url").distinct()
    every, cursor = [], None
    while True:
        rows = [r.id for r in filters.keyset_page(pages, "id", cursor, 100).collect()]
        every += rows[:100]
        if len(rows) <= 100:
            break
        cursor = rows[99]
    assert every == sorted(r.id for r in pages.collect())


def test_newest_first_with_ties(spark):
    rows = spark.createDataFrame([("a", 1), ("b", 2), ("c", 2), ("d", 2), ("e", None)], "id string, created_at int")
    first = [r.id for r in filters.newest_first(rows, limit=2).collect()]
    assert first == ["b", "c", "d"] and [r.id for r in filters.newest_first(rows, cursor=(2, "c"), limit=2).collect()] == ["d", "a"]


def test_alerts_read_and_unread(spark):
    alerts = spark.createDataFrame([("1", "p", False), ("2", "p", True), ("3", "q", False)], "id string, project_id string, is_read boolean")
    assert [r.id for r in filters.list_alerts(alerts, "p", unread_only=True).collect()] == ["1"]
    read = filters.mark_read(alerts, F.col("project_id") == "q")
    assert {r.project_id: r.unread for r in filters.unread_counts(read).collect()} == {"p": 1, "q": 0}


def test_rule_results(spark):
    results = spark.createDataFrame([("u", "r", "v"), ("x", "r", "w")], "url_id string, extractor_id string, value string")
    named = filters.rule_results(results, spark.createDataFrame([("r", "Heading")], "id string, name string"), spark.createDataFrame([("u", "/a"), ("u", "/a")], "id string, url string"), "extractor_id")
    assert [(r.name, r.url, r.value) for r in named.collect()] == [("Heading", "/a", "v")]


def test_presets_and_summary(spark):
    pages = table(spark, D, "crawled_urls")
    assert filters.preset(pages, "client_errors").where("status_code < 400 or status_code > 499").count() == 0
    parts = [filters.preset(pages, n).count() for n in ("indexable", "non_indexable")]
    assert sum(parts) == filters.preset(pages, "all").count()
    assert set(reports.summary(pages, rules.page_issues(pages).selectExpr("*", "'info' as severity"))) == {"health", "overview", "quick wins", "performance"}
