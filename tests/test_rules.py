import json

from pagequarry.operators import reports, rules
from pagequarry.operators.registry import ISSUES

SCHEMA = (
    "id string, crawl_id string, url string, url_hash binary, status_code int, content_type string, title string, meta_description string, h1 array<string>, canonical_url string, robots_meta array<string>, "
    "is_indexable boolean, indexability_reason string, word_count int, crawl_depth int, seo_data string"
)
BASE = {"id": "1", "crawl_id": "c", "url": "https://a.example/x", "url_hash": b"1", "status_code": 200, "content_type": "text/html", "title": "t" * 40, "meta_description": "d" * 100, "h1": ["h"], "canonical_url": "https://a.example/y", "robots_meta": None, "is_indexable": True, "indexability_reason": None, "word_count": 10, "crawl_depth": 0}
HEADERS = {"security_headers": {"strict_transport_security": "x", "content_security_policy": "x", "x_content_type_options": "x", "x_frame_options": "x"}}


def issues(spark, seo=None, **changed):
    row = BASE | {"seo_data": json.dumps(HEADERS | (seo or {}))} | changed
    return sorted(r.issue_type for r in rules.page_issues(spark.createDataFrame([row], SCHEMA)).collect())


def test_clean_page_and_boundaries(spark):
    assert issues(spark) == []
    assert issues(spark, title="t" * 60) == [] and issues(spark, title="t" * 61) == ["title_too_long"]
    assert issues(spark, title="t" * 30) == [] and issues(spark, title="t" * 29) == ["title_too_short"]
    assert issues(spark, title="W" * 47) == [] and issues(spark, title="W" * 48) == ["title_pixel_too_wide"]
    assert issues(spark, meta_description="d" * 155) == [] and issues(spark, meta_description="d" * 156) == ["meta_description_too_long"]
    assert issues(spark, meta_description="d" * 70) == [] and issues(spark, meta_description="d" * 69) == ["meta_description_too_short"]
    assert issues(spark, h1=["h" * 70]) == [] and issues(spark, h1=["h" * 71]) == ["h1_too_long"]
    assert issues(spark, url="https://a.example/" + "x" * 97) == [] and issues(spark, url="https://a.example/" + "x" * 98) == ["url_too_long"]


def test_missing_values_and_gate(spark):
    assert issues(spark, title=None, meta_description="", h1=None, canonical_url=None) == ["missing_canonical", "missing_h1", "missing_meta_description", "missing_title"]
    assert issues(spark, title=None, word_count=0, meta_description=None, h1=None) == []
    assert issues(spark, canonical_url=None, is_indexable=False, indexability_reason="redirect") == []
    assert issues(spark, seo_data="{broken") == ["missing_csp", "missing_hsts", "missing_x_content_type_options", "missing_x_frame_options"]
    assert issues(spark, seo_data=json.dumps(json.dumps(HEADERS))) == []


def test_directives_urls_images_headings_pagination(spark):
    assert issues(spark, robots_meta=["none"]) == ["has_noindex_nofollow"] and issues(spark, robots_meta=["nofollow"]) == ["has_nofollow"]
    assert issues(spark, url="http://a.example/A_b//é?x=1") == ["http_url", "url_has_multiple_slashes", "url_has_parameters", "url_has_underscores", "url_has_uppercase", "url_non_ascii"]
    assert issues(spark, seo={"images": [{"alt": " ", "width": 1, "height": 1}, {"alt": "a" * 125, "width": 1, "height": None}, {"alt": "a" * 126, "width": 1, "height": 2}]}) == ["alt_text_too_long", "missing_alt_text", "missing_image_dimensions"]
    assert issues(spark, seo={"heading_sequence": ["h1", "h3", "h2", "h6"]}) == ["non_sequential_headings"] and issues(spark, seo={"heading_sequence": ["h3"]}) == []
    assert issues(spark, seo={"pagination": {"rel_next": "u", "next_count": 2}}, is_indexable=False) == ["multiple_pagination_urls", "non_indexable_paginated"]
    assert issues(spark, title="Same thing, thirty chars long!!", h1=[" same thing, thirty chars long!! "]) == ["title_same_as_h1"]
    assert issues(spark, seo={"mixed_content_urls": ["http://x"], "title_count": 2}) == ["mixed_content", "multiple_titles"]


def test_registry_and_found_types(spark):
    known = {k for some in ISSUES.values() for k, _, _ in some}
    assert len(known) == 56
    p = spark.read.parquet("/root/testdata/sf0.001/crawled_urls.parquet")
    links = spark.read.parquet("/root/testdata/sf0.001/page_links.parquet")
    found = rules.all_issues(p, links, extended=True)
    assert {r.issue_type for r in found.select("issue_type").distinct().collect()} <= known
    rows = rules.issue_summary(found).collect()
    for crawl in {r.crawl_id for r in rows}:
        n = {k: sum(r.n for r in rows if r.crawl_id == crawl and r.kind == k) for k in ("total", "severity", "category")}
        assert n["total"] == n["severity"] == n["category"]


def pages(spark, rows):
    return spark.createDataFrame([BASE | {"seo_data": "{}"} | r for r in rows], SCHEMA)


def test_cross_page_rules(spark):
    page = lambda i, nxt=None, prev=None, **kw: {"id": i, "url": i, "url_hash": i.encode(), "seo_data": json.dumps({"pagination": {"rel_next": nxt, "rel_prev": prev}})} | kw
    p = pages(spark, [page("a", "b", title="same"), page("b", "c", "x", title="same", status_code=404), page("c", None, "b", is_indexable=False, canonical_url="a"), page("d", canonical_url="c", title=None)])
    links = spark.createDataFrame([("c", "a", "b", b"b", "internal", "t"), ("c", "a", "c", b"c", "internal", None), ("c", "a", "b", b"b", "external", "")], "crawl_id string, source_url_id string, target_url string, target_url_hash binary, link_type string, anchor_text string")
    types = lambda df: sorted((r.url_id, r.issue_type) for r in df.collect())
    assert [(r.url_id, r.copies) for r in rules.duplicate_values(p).where("issue_type = 'duplicate_title'").orderBy("url_id").collect()] == [("a", 2), ("b", 2)]
    assert types(rules.broken_links(p, links)) == [("a", "broken_link_4xx")]
    assert types(rules.canonical_targets(p)) == [("d", "non_indexable_canonical")]
    assert sorted((r.url_id, r.rel, r.target) for r in rules.pagination_not_200(p).collect()) == [("a", "next", "b"), ("c", "prev", "b")]
    assert sorted((r.url_id, r.target) for r in rules.pagination_unlinked(p, links).collect()) == [("b", "x")]
    assert sorted((r.url_id, r.target) for r in rules.pagination_not_in_anchor(p, links).collect()) == [("b", "c"), ("b", "x"), ("c", "b")]
    assert sorted((r.url_id, r.target, r.back) for r in rules.pagination_sequence(p).collect()) == [("a", "b", "x")]


def test_odd_heading_levels(spark):
    assert issues(spark, seo={"heading_sequence": ["h1", "hx", "h3", None, "h6", 4]}) == []
    assert issues(spark, seo={"heading_sequence": ["hx", "h1", "H3"]}) == ["non_sequential_headings"] and issues(spark, seo={"heading_sequence": "h1"}) == []
    p = pages(spark, [{"id": "1", "seo_data": json.dumps({"heading_sequence": ["h2", "hx", "h5", "h0", "h9"]})}, {"id": "2", "status_code": 404, "seo_data": json.dumps({"heading_sequence": ["h2", "h5"]})}, {"id": "3"}])
    assert [(r.id, r.skips) for r in rules.heading_skips(p).collect()] == [("1", ["h2 -> h5", "h5 -> h9"])]
    assert reports.accessibility(p).first().skipped == 1


def test_details(spark):
    row = BASE | {"title": "T" * 70, "h1": ["a", "b"], "seo_data": json.dumps(HEADERS | {"images": [{"alt": ""}], "heading_sequence": ["h1", "h4"]})}
    got = {r.issue_type: r.details for r in rules.page_issues(spark.createDataFrame([row], SCHEMA)).collect()}
    assert got["title_too_long"] == {"length": "70", "title": "T" * 70} and got["multiple_h1"] == {"count": "2", "h1s": "a | b"}
    assert got["missing_alt_text"] == {"src": ""} and got["non_sequential_headings"] == {"sequence": "h1, h4", "skip_at": "h1 -> h4"}


def test_all_images_without_alt(spark):
    p = pages(spark, [{"id": i, "seo_data": json.dumps({"images": [{"src": f"{i}{n}"} for n in range(70)] + [{"src": "x", "alt": "a"}]})} for i in "ab"])
    got = sorted((r.id, r.place, r.src) for r in reports.images_without_alt(p, None).collect())
    assert got == [(i, n, f"{i}{n}") for i in "ab" for n in range(70)]
    assert reports.images_without_alt(p).count() == 100
