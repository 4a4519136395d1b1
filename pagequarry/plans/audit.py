"""Queries on issues: page rules, cross-page rules, their summary; each beside its SQL."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagequarry.functions.text import OTHER_PIXELS, PIXELS
from pagequarry.operators import rules
from pagequarry.operators.registry import registry_sql
from pagequarry.plans.cases import with_cases, with_pages
from pagequarry.session import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def once(sql: str) -> str:
    """The statement over pages and links that were delivered several times but count once."""
    if "pages_once" in sql:
        return sql
    head = "pages_once AS (SELECT DISTINCT ON (id) * FROM crawled_urls), links_once AS (SELECT DISTINCT ON (id) * FROM page_links)"
    sql = re.sub(r"\bpage_links\b", "links_once", re.sub(r"\bcrawled_urls\b", "pages_once", sql)).strip()
    for start in ("WITH RECURSIVE ", "WITH "):
        if sql.startswith(start):
            return f"{start}{head}, {sql[len(start):]}"
    return f"WITH {head} {sql}"


def query(sql: str | None = None, cases: bool = False):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = with_cases(once(sql)) if cases else once(sql)
        return f

    return add


def pages(spark: SparkSession, d: str) -> DataFrame:
    """The stored pages; rows that were delivered again count once."""
    return table(spark, d, "crawled_urls").dropDuplicates(["id"])


def links(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "page_links").dropDuplicates(["id"])


#: crawled_urls with seo_data parsed as doc.
DOC = """doc0 AS (SELECT *, CASE WHEN json_valid(seo_data) THEN CAST(seo_data AS JSON) END AS j FROM crawled_urls),
s AS (SELECT *, CASE WHEN json_type(j) = 'VARCHAR' THEN CASE WHEN json_valid(j->>'$') THEN CAST(j->>'$' AS JSON) END ELSE j END AS doc,
  lower(content_type) LIKE 'text/html%' AS html FROM doc0)"""

_PATH = "regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1)"
_QUERY = r"regexp_extract(url, '^[^?#]*\?([^#]*)', 1)"
_PIXELS = f"round_even(round(list_sum(list_transform(string_split(title, ''), lambda c: CASE WHEN unicode(c) BETWEEN 32 AND 126 THEN {PIXELS}[unicode(c) - 31] ELSE {OTHER_PIXELS} END)), 6), 0)"
_PAGED = "html AND (coalesce(doc->>'$.pagination.rel_next', '') <> '' OR coalesce(doc->>'$.pagination.rel_prev', '') <> '')"
_HEAD = "coalesce(doc->>'$.security_headers.{}', '') = ''"
_NOINDEX = "(list_contains(coalesce(robots_meta, []), 'noindex') OR list_contains(coalesce(robots_meta, []), 'none'))"
_NOFOLLOW = "(list_contains(coalesce(robots_meta, []), 'nofollow') OR list_contains(coalesce(robots_meta, []), 'none'))"
_CHECKED = "NOT (NOT is_indexable AND coalesce(indexability_reason IN ('redirect', 'client_error', 'server_error', 'non_html'), false))"
_LEVELS = "json_extract_string(doc, '$.heading_sequence[*]')"
_LEVEL = "TRY_CAST(regexp_replace(({l})[{i}], '^[hH]+', '') AS INTEGER)"
_JUMPS = f"list_filter(range(2, len({_LEVELS}) + 1), lambda i: {_LEVEL.format(l=_LEVELS, i='i')} - {_LEVEL.format(l=_LEVELS, i='i - 1')} > 1)"
_LONG_H1 = "list_filter(h1, lambda x: length(x) > 70)[1]"
_DIRECTIVES = "'directives=' || array_to_string(robots_meta, ', ')"
#: Test and details by type.
_CONTENT = {
    "missing_title": ("coalesce(title, '') = ''", "''"),
    "multiple_titles": ("title <> '' AND TRY_CAST(doc->>'$.title_count' AS INTEGER) > 1", "'count=' || (doc->>'$.title_count')"),
    "title_too_long": ("length(title) > 60", "'length=' || length(title) || '; title=' || title[:100]"),
    "title_too_short": ("title <> '' AND length(title) < 30", "'length=' || length(title) || '; title=' || title"),
    "title_pixel_too_wide": (f"title <> '' AND {_PIXELS} > 580", f"'limit=580; pixel_width=' || CAST({_PIXELS} AS INTEGER)"),
    "title_same_as_h1": ("title <> '' AND lower(trim(title, ' ')) = lower(trim(h1[1], ' '))", "''"),
    "missing_meta_description": ("coalesce(meta_description, '') = ''", "''"),
    "multiple_meta_descriptions": ("meta_description <> '' AND TRY_CAST(doc->>'$.meta_desc_count' AS INTEGER) > 1", "'count=' || (doc->>'$.meta_desc_count')"),
    "meta_description_too_long": ("length(meta_description) > 155", "'length=' || length(meta_description)"),
    "meta_description_too_short": ("meta_description <> '' AND length(meta_description) < 70", "'length=' || length(meta_description)"),
    "missing_h1": ("len(coalesce(h1, [])) = 0", "''"),
    "multiple_h1": ("len(h1) > 1", "'count=' || len(h1) || '; h1s=' || array_to_string(list_transform(h1, lambda x: x[:100]), ' | ')"),
    "h1_too_long": (f"{_LONG_H1} IS NOT NULL", f"'h1=' || ({_LONG_H1})[:100] || '; length=' || length({_LONG_H1})"),
    "non_sequential_headings": (f"len({_JUMPS}) > 0", f"'sequence=' || array_to_string(({_LEVELS})[:20], ', ') || '; skip_at=' || ({_LEVELS})[({_JUMPS})[1] - 1] || ' -> ' || ({_LEVELS})[({_JUMPS})[1]]"),
    "missing_canonical": (f"{_CHECKED} AND coalesce(canonical_url, '') = ''", "''"),
    "multiple_canonicals": (f"{_CHECKED} AND canonical_url <> '' AND TRY_CAST(doc->>'$.canonical_count' AS INTEGER) > 1", "'count=' || (doc->>'$.canonical_count')"),
    "self_referencing_canonical": (f"{_CHECKED} AND canonical_url <> '' AND lower(rtrim(canonical_url, '/')) = lower(rtrim(url, '/'))", "''"),
    "has_noindex_nofollow": (f"{_NOINDEX} AND {_NOFOLLOW}", _DIRECTIVES),
    "has_noindex": (f"{_NOINDEX} AND NOT {_NOFOLLOW}", _DIRECTIVES),
    "has_nofollow": (f"{_NOFOLLOW} AND NOT {_NOINDEX}", _DIRECTIVES),
    "multiple_robots_meta": ("TRY_CAST(doc->>'$.robots_meta_tag_count' AS INTEGER) > 1", "'count=' || (doc->>'$.robots_meta_tag_count')"),
    "has_x_robots_tag": ("coalesce(doc->>'$.x_robots_tag', '') <> ''", "'value=' || (doc->>'$.x_robots_tag')"),
}
_COUNT = "coalesce(TRY_CAST(doc->>'$.pagination.{}_count' AS INTEGER), 0)"
_MIXED = "json_extract_string(doc, '$.mixed_content_urls[*]')"
_ALWAYS = {
    "url_too_long": ("length(url) > 115", "'length=' || length(url)"),
    "url_non_ascii": (r"regexp_matches(url, '[^\x00-\x7F]')", "''"),
    "url_has_underscores": (f"contains({_PATH}, '_')", "''"),
    "url_has_uppercase": (f"{_PATH} <> lower({_PATH})", "''"),
    "url_has_parameters": (f"{_QUERY} <> ''", f"'query=' || ({_QUERY})[:100]"),
    "url_has_multiple_slashes": (f"contains({_PATH}, '//')", "''"),
    "http_url": ("url LIKE 'http://%'", "''"),
    "mixed_content": (f"len({_MIXED}) > 0", f"'count=' || len({_MIXED}) || '; urls=' || array_to_string(({_MIXED})[:5], ', ')"),
    **{kind: (_HEAD.format(name), "''") for kind, name in rules.HEADERS.items()},
    "multiple_pagination_urls": (f"{_PAGED} AND ({_COUNT.format('next')} > 1 OR {_COUNT.format('prev')} > 1)", f"'next_count=' || {_COUNT.format('next')} || '; prev_count=' || {_COUNT.format('prev')}"),
    "non_indexable_paginated": (f"{_PAGED} AND NOT is_indexable", "'reason=' || coalesce(indexability_reason, '')"),
}
_SRC = "'src=' || coalesce(i->>'$.src', '')[:200]"
_IMAGE = {
    "missing_alt_text": ("coalesce(trim(i->>'$.alt', ' '), '') = ''", _SRC),
    "alt_text_too_long": ("length(i->>'$.alt') > 125", f"'alt_length=' || length(i->>'$.alt') || '; ' || {_SRC}"),
    "missing_image_dimensions": ("coalesce(i->>'$.width', '') = '' OR coalesce(i->>'$.height', '') = ''", _SRC),
}
_GATE = "(title <> '' OR word_count > 0)"
PAGE_ISSUES = " UNION ALL ".join(
    [f"SELECT crawl_id, id AS url_id, '{k}' AS issue_type, {x} AS details FROM s WHERE {_GATE} AND ({t})" for k, (t, x) in _CONTENT.items()]
    + [f"SELECT crawl_id, id AS url_id, '{k}' AS issue_type, {x} AS details FROM s WHERE {t}" for k, (t, x) in _ALWAYS.items()]
    + [f"SELECT crawl_id, url_id, '{k}' AS issue_type, {x} AS details FROM (SELECT crawl_id, id AS url_id, unnest(json_extract(doc, '$.images[*]')) AS i FROM s WHERE {_GATE}) WHERE {t}" for k, (t, x) in _IMAGE.items()]
)
_DUPLICATES = " UNION ALL ".join(
    f"SELECT crawl_id, id AS url_id, '{kind}' AS issue_type, count(*) OVER (PARTITION BY crawl_id, {value}) AS copies FROM s WHERE html AND {value} <> '' QUALIFY copies > 1"
    for kind, value in (("duplicate_title", "title"), ("duplicate_meta_description", "meta_description"), ("duplicate_h1", "h1[1]"))
)
_BROKEN = """SELECT l.crawl_id, l.source_url_id AS url_id, l.target_url, u.status_code, l.anchor_text, CASE WHEN u.status_code >= 500 THEN 'broken_link_5xx' ELSE 'broken_link_4xx' END AS issue_type
FROM page_links l JOIN crawled_urls u ON u.crawl_id = l.crawl_id AND u.url_hash = l.target_url_hash WHERE l.link_type = 'internal' AND u.status_code >= 400"""
_CANONICAL = """SELECT a.crawl_id, a.id AS url_id, a.canonical_url, b.indexability_reason AS reason, 'non_indexable_canonical' AS issue_type
FROM crawled_urls a JOIN crawled_urls b ON b.crawl_id = a.crawl_id AND b.url = a.canonical_url
WHERE lower(a.content_type) LIKE 'text/html%' AND a.canonical_url <> a.url AND NOT b.is_indexable"""
REFS = """refs AS (SELECT * FROM (
  SELECT crawl_id, id AS url_id, url, 'next' AS rel, doc->>'$.pagination.rel_next' AS target FROM s WHERE html UNION ALL
  SELECT crawl_id, id, url, 'prev', doc->>'$.pagination.rel_prev' FROM s WHERE html) WHERE target <> '')"""
_NOT_200 = "SELECT r.crawl_id, r.url_id, rel, target, u.status_code, 'non_200_pagination_url' AS issue_type FROM refs r JOIN crawled_urls u ON u.crawl_id = r.crawl_id AND u.url = r.target WHERE u.status_code <> 200"
_UNLINKED = "SELECT crawl_id, url_id, rel, target, 'unlinked_pagination_url' AS issue_type FROM refs r WHERE NOT EXISTS (SELECT 1 FROM page_links l WHERE l.crawl_id = r.crawl_id AND l.target_url = r.target)"
_NO_ANCHOR = "SELECT crawl_id, url_id, rel, target, 'pagination_url_not_in_anchor' AS issue_type FROM refs r WHERE NOT EXISTS (SELECT 1 FROM page_links l WHERE l.source_url_id = r.url_id AND l.target_url = r.target)"
_SEQUENCE = """SELECT r.crawl_id, r.url_id, r.rel, r.target, coalesce(b.back, '(none)') AS back, 'pagination_sequence_error' AS issue_type
FROM (SELECT crawl_id, url, 'next' AS rel, doc->>'$.pagination.rel_prev' AS back FROM s WHERE html UNION ALL SELECT crawl_id, url, 'prev', doc->>'$.pagination.rel_next' FROM s WHERE html) b
JOIN refs r ON b.crawl_id = r.crawl_id AND b.url = r.target AND b.rel = r.rel WHERE b.back IS DISTINCT FROM r.url"""
_REST = [
    (_DUPLICATES, "'duplicate_count=' || copies"),
    (_BROKEN, "'anchor_text=' || coalesce(anchor_text, '')[:100] || '; status_code=' || status_code || '; target_url=' || target_url[:200]"),
    (_CANONICAL, "'canonical_url=' || canonical_url[:200] || '; reason=target_non_indexable'"),
    (_NOT_200, "'attribute=rel_' || rel || '; pagination_url=' || target[:200] || '; status_code=' || status_code"),
    (_UNLINKED, "'attribute=rel_' || rel || '; pagination_url=' || target[:200]"),
    (_NO_ANCHOR, "'attribute=rel_' || rel || '; pagination_url=' || target[:200]"),
    (_SEQUENCE, "'actual_back_ref=' || back[:200] || '; direction=' || rel || '; expected_target=' || target[:200]"),
]
ISSUES = f"""WITH {DOC}, {REFS}, found AS ({PAGE_ISSUES} {" ".join(f"UNION ALL SELECT crawl_id, url_id, issue_type, {x} FROM ({q})" for q, x in _REST)}),
issues AS (SELECT crawl_id, url_id, issue_type, severity, category, description, details FROM found JOIN {registry_sql()} USING (issue_type))"""


@query(f"WITH {DOC} {PAGE_ISSUES}")
def page_issues(spark, d):
    return rules.page_issues(pages(spark, d)).withColumn("details", rules.details_text())


@query(f"WITH {DOC} {_DUPLICATES}")
def duplicate_values(spark, d):
    return rules.duplicate_values(pages(spark, d))


@query(_BROKEN)
def broken_links(spark, d):
    return rules.broken_links(pages(spark, d), links(spark, d))


@query(_CANONICAL, cases=True)
def canonical_targets(spark, d):
    return rules.canonical_targets(with_pages(pages(spark, d))).select("crawl_id", "url_id", "canonical_url", "reason", "issue_type")


@query(f"WITH {DOC}, {REFS} {_NOT_200}", cases=True)
def pagination_not_200(spark, d):
    return rules.pagination_not_200(with_pages(pages(spark, d)))


@query(f"WITH {DOC}, {REFS} {_UNLINKED}")
def pagination_unlinked(spark, d):
    return rules.pagination_unlinked(pages(spark, d), links(spark, d))


@query(f"WITH {DOC}, {REFS} {_NO_ANCHOR}")
def pagination_not_in_anchor(spark, d):
    return rules.pagination_not_in_anchor(pages(spark, d), links(spark, d))


@query(f"WITH {DOC}, {REFS} {_SEQUENCE}", cases=True)
def pagination_sequence(spark, d):
    return rules.pagination_sequence(with_pages(pages(spark, d)))


@query("SELECT crawl_id, id AS url_id, 'non_indexable_' || indexability_reason AS issue_type FROM crawled_urls WHERE NOT is_indexable AND indexability_reason IN ('noindex', 'canonicalized', 'redirect', 'client_error', 'server_error')")
def indexability_issues(spark, d):
    return rules.indexability_issues(pages(spark, d))


@query(ISSUES + """ SELECT crawl_id, CASE WHEN severity IS NOT NULL THEN 'severity' WHEN category IS NOT NULL THEN 'category' ELSE 'total' END AS kind,
  coalesce(severity, category, 'all') AS name, count(*) AS n FROM issues GROUP BY GROUPING SETS ((crawl_id), (crawl_id, severity), (crawl_id, category))""")
def issue_summary(spark, d):
    return rules.issue_summary(rules.all_issues(pages(spark, d), links(spark, d)))


@query(ISSUES + " SELECT i.crawl_id, i.url_id, u.url, issue_type, severity, category, description, details FROM issues i JOIN crawled_urls u ON u.id = i.url_id")
def issue_list(spark, d):
    found = rules.issue_list(rules.all_issues(pages(spark, d), links(spark, d)), pages(spark, d))
    return found.select("crawl_id", "url_id", "url", "issue_type", "severity", "category", "description", rules.details_text().alias("details"))


@query(ISSUES + " SELECT i.crawl_id, i.url_id, u.url, issue_type FROM issues i JOIN crawled_urls u ON u.id = i.url_id WHERE severity = 'critical' AND category = 'titles'")
def issue_list_filtered(spark, d):
    found = rules.issue_list(rules.all_issues(pages(spark, d), links(spark, d)), pages(spark, d), severity="critical", category="titles")
    return found.select("crawl_id", "url_id", "url", "issue_type")


@query(f"""WITH {DOC}, h AS (SELECT crawl_id, id, list_filter({_LEVELS}, lambda x: regexp_matches(x, '^h[1-9]$')) AS l FROM s WHERE html AND status_code BETWEEN 200 AND 299),
k AS (SELECT crawl_id, id, list_transform(list_filter(range(2, len(l) + 1), lambda i: CAST(l[i][2] AS INTEGER) - CAST(l[i - 1][2] AS INTEGER) > 1), lambda i: l[i - 1] || ' -> ' || l[i]) AS skips FROM h)
SELECT crawl_id, id, array_to_string(skips, ', ') AS skips FROM k WHERE len(skips) > 0""")
def heading_hierarchy(spark, d):
    return rules.heading_skips(pages(spark, d)).withColumn("skips", F.array_join("skips", ", "))
