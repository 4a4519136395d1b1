import os
import tempfile

import pytest

from pagequarry.functions import urls
from pagequarry.sources import html, readers, sinks


@pytest.mark.parametrize(
    ("url", "base", "expected"),
    [("HTTP://A.Example:80/x#f", None, "http://a.example:80/x"), ("../y?q=%20", "https://a.example/b/c", "https://a.example/y?q=%20"), ("javascript:x", None, None), ("", None, None), ("//h.example", "https://a.example", "https://h.example/"), ("https://a.example/%e9%7e(x)", None, "https://a.example/%EF%BF%BD~(x)"), ("https://[bad", None, None)],
)
def test_normalise(url, base, expected):
    assert urls.normalise(url, base) == expected


def test_scope_and_rewrite(spark):
    df = spark.createDataFrame([("https://a.example/x?b=1&a=2&c=3#f",), ("https://a.example/?a=1",), ("https://sub.a.example/y.pdf",), ("https://b.example/",), (None,)], "u string")
    got = [r[0] for r in df.select(urls.rewrite(df.u, [("#f$", "")], ["a", "c"])).collect()]
    assert got == ["https://a.example/x?b=1", "https://a.example/", "https://sub.a.example/y.pdf", "https://b.example/", None]
    assert [r[0] for r in df.where(urls.in_scope(df.u, "A.example", cdn_hosts=["b.example"], exclude=["*.pdf"])).collect()] == ["https://a.example/x?b=1&a=2&c=3#f", "https://a.example/?a=1", "https://b.example/"]


def test_page_row_metrics():
    text = "The cat sat here. " * 20
    row = html.page_row(f"<html><body><p>{text}<style>p{{}}</style></body></html>", "https://a.example/")
    assert row["word_count"] == 80 and row["avg_words_per_sentence"] == 4.0 and row["readability_score"] == 97.0 and row["simhash"] is not None
    assert html.page_row("<p>no body", "https://a.example/")["word_count"] == 0
    assert html.page_row("x", "https://a.example/", "application/pdf")["indexability_reason"] == "non_html"
    assert html.page_row("<body>x", "https://a.example/", status=404)["indexability_reason"] == "client_error"
    huge = html.page_row("<body>" + "<div>" * 5000 + "word " * 100000, "https://a.example/")
    assert huge["word_count"] == 100000


def test_selectors():
    root = html.parse("<div id=m class='a b'><p>1<p>2<ul><li class=x>3<li>4</ul></div><p data-k='v-1'>5")
    of = lambda s: [html.text_of(n) for n in html.css(root, s)]
    assert of("div#m.a > p") == ["1", "2" + "34"] or of("div#m.a > p")[0] == "1"
    assert of("li.x, [data-k|=v]") == ["3", "5"] and of("p[data-k^='v']") == ["5"] and of("li[class]") == ["3"]
    assert html.xpath(root, "//p[@data-k='v-1']/text()") == ["5"] and html.xpath(root, "//div/@id") == ["m"]
    assert html.pick(root, "", "css", "::bad") is None and html.pick(root, "ab12", "regex", r"[a-z]+(\d+)") == "12" and html.pick(root, "", "css", "li", "count") == "2"


def test_sinks_round_trip(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/crawled_urls.parquet")
    with tempfile.TemporaryDirectory() as d:
        sinks.write_csv(pages, f"{d}/csv")
        assert spark.read.option("header", True).csv(f"{d}/csv").columns == sinks.EXPORT_COLUMNS
        sinks.write_sitemap(pages, f"{d}/map")
        back = readers.sitemap_urls(spark, f"{d}/map")
        assert back.count() == sinks.sitemap_rows(pages).count()
        assert readers.sitemap_coverage(back, pages).where("place = 'sitemap'").count() == 0
        sinks.write_table(pages, f"{d}/table")
        crawl = pages.first().crawl_id
        assert spark.read.parquet(f"{d}/table").where(f"crawl_id = '{crawl}'").count() == pages.where(f"crawl_id = '{crawl}'").count()
        assert any(x.startswith("crawl_id=") for x in os.listdir(f"{d}/table"))
        sinks.drop_crawls(spark, f"{d}/table", [crawl, "unknown"])
        assert spark.read.parquet(f"{d}/table").where(f"crawl_id = '{crawl}'").count() == 0
    page = sinks.html_report("<A>", {"counts": pages.groupBy("status_code").count()})
    assert "&lt;A&gt;" in page and "<table>" in page
    good, bad = sinks.split_valid(pages, pages.status_code.isNotNull())
    assert good.count() + bad.count() == pages.count()


def test_cookies():
    assert readers.parse_cookies(None, "a.example") == [] and readers.same_site(".example", "a.example") and not readers.same_site("ample", "a.example")
    assert readers.parse_cookies("k=v; SameSite=None; Secure; HttpOnly", "a.example")[0]["issues"] == ["samesite_none_or_missing"]


def test_robots_of_hot_and_missing_hosts(spark):
    files = spark.createDataFrame([("a", "User-agent: *\nDisallow: /p/\nCrawl-delay: 2"), ("b", "x" * 600_000), ("c", None), ("a", "User-agent: *\nDisallow: /p/\nCrawl-delay: 2")], "host string, text string")
    asked = [(f"https://a/{'p' if i % 3 else 'q'}/{i}", "a", i) for i in range(300)] + [("https://b/p/1", "b", 1), ("https://c/p/1", "c", 2), ("https://d/p/1", "d", 3), (None, "a", 4), ("https://e", None, 5)]
    got = readers.robots_allowed(spark.createDataFrame(asked, "u string, h string, _x int"), files, "u", "h").collect()
    assert len(got) == len(asked)
    for r in got:
        assert r.allowed == (r.h != "a" or r.u is None or "/p/" not in r.u) and r.crawl_delay == (2.0 if r.h == "a" and r.u else None), r


def test_sitemap_index(spark, tmp_path):
    def save(name, body):
        (tmp_path / name).write_text(body)
        return str(tmp_path / name)

    for i in range(12):
        save(f"{i:02}.xml", f"<urlset><url><loc>https://a/{i}</loc></url></urlset>")
    inner = "".join(f"<sitemap><loc>{i:02}.xml</loc></sitemap>" for i in range(12))
    index = save("index.xml", f"<sitemapindex>{inner}<sitemap><loc>nowhere.xml</loc></sitemap></sitemapindex>")
    stored = lambda loc: str(tmp_path / loc) if (tmp_path / loc).exists() else None
    assert readers.sitemap_tree(spark, index, stored).count() == 10 and readers.sitemap_tree(spark, index, stored, children=None).count() == 12
    outer = save("outer.xml", "<sitemapindex><sitemap><loc>index.xml</loc></sitemap></sitemapindex>")
    assert readers.sitemap_tree(spark, outer, stored, depth=1).count() == 0 and readers.sitemap_tree(spark, outer, stored).count() == 10


def test_search_without_pattern(spark):
    with pytest.raises(ValueError, match="pattern"):
        html.custom_searches(spark.createDataFrame([("x",)], "t string"), "t", [{"id": 1, "pattern": ""}], [])
