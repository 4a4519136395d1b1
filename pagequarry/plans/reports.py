"""Report queries, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagequarry.functions.text import STOP_WORDS
from pagequarry.operators import reports, rules
from pagequarry.plans.audit import DOC, ISSUES, links, once, pages
from pagequarry.session import table

QUERIES: dict = {}
SQL: dict[str, str] = {}
_OK = "status_code BETWEEN 200 AND 299"
_HTML = "lower(content_type) LIKE 'text/html%'"


def report(name: str, f, sql: str | None = None) -> None:
    QUERIES[name] = f
    if sql:
        SQL[name] = once(sql)


def micros(df, *names: str):
    """Times as microseconds since 1970, which every engine compares alike."""
    return df.withColumns({n: F.unix_micros(n) for n in names})


def on_pages(name: str, f, sql: str | None = None, *args) -> None:
    report(name, lambda spark, d: f(pages(spark, d), *args), sql)


def issues(spark, d):
    return rules.all_issues(pages(spark, d), links(spark, d))


def buckets(value: str, labels: tuple) -> str:
    bounds, last = labels
    return "CASE " + " ".join(f"WHEN {value} < {b} THEN '{label}'" for b, label in bounds) + f" WHEN {value} IS NOT NULL THEN '{last}' END"


def top(columns: str, source: str, order: str, k: int, by: str = "crawl_id") -> str:
    return f"SELECT {columns} FROM {source} QUALIFY row_number() OVER (PARTITION BY {by} ORDER BY {order}) <= {k}"


on_pages("counts", reports.counts, "SELECT crawl_id, count(*) AS pages, count(*) FILTER (status_code >= 400) AS errors FROM crawled_urls GROUP BY crawl_id")
on_pages("depth_distribution", reports.depth_distribution, "SELECT crawl_id, crawl_depth, count(*) AS n FROM crawled_urls GROUP BY ALL")
report(
    "exact_duplicates",
    lambda spark, d: reports.exact_duplicates(pages(spark, d), F.md5(F.lower("meta_description"))),
    "WITH g AS (SELECT crawl_id, md5(lower(meta_description)) AS content, count(*) AS n, min(id) AS first_id FROM crawled_urls WHERE status_code = 200 AND meta_description IS NOT NULL GROUP BY ALL HAVING count(*) > 1) "
    + top("*", "g", "n DESC, content", 50),
)
_HEALTH = f"""{ISSUES}, p AS (SELECT crawl_id, count(*) AS total, count(*) FILTER ({_OK}) AS ok, count(*) FILTER (status_code >= 400) AS errors, count(*) FILTER (is_indexable) AS indexable, avg(response_time_ms) AS ms FROM crawled_urls GROUP BY 1),
i AS (SELECT crawl_id, count(*) FILTER (severity = 'critical') AS critical, count(*) FILTER (severity = 'warning') AS warnings FROM issues GROUP BY 1),
q AS (SELECT p.*, coalesce(critical, 0) AS critical, coalesce(warnings, 0) AS warnings, coalesce(nullif(ms, 0), 500) AS m FROM p LEFT JOIN i USING (crawl_id)),
r AS (SELECT *, ok / greatest(total, 1) * 100 AS status_part, indexable / greatest(ok, 1) * 100 AS index_part, greatest(100 - least(critical * 5.0, 50) - least(warnings * 1.0, 30), 0) AS issue_part,
  CASE WHEN m < 300 THEN 100.0 WHEN m < 1000 THEN 100 - (m - 300) / 700 * 50 WHEN m < 3000 THEN 50 - (m - 1000) / 2000 * 40 ELSE 10 END AS speed_part FROM q),
t AS (SELECT *, round(least(status_part * 0.3 + index_part * 0.2 + issue_part * 0.3 + speed_part * 0.2, 100), 1) AS score FROM r)
SELECT crawl_id, score, CASE WHEN score >= 90 THEN 'A' WHEN score >= 75 THEN 'B' WHEN score >= 60 THEN 'C' WHEN score >= 40 THEN 'D' ELSE 'F' END AS grade, total, errors, critical, warnings,
  round(status_part, 3) AS status_part, round(index_part, 3) AS index_part, CAST(round(issue_part, 3) AS DOUBLE) AS issue_part, round(speed_part, 3) AS speed_part FROM t"""
report("health", lambda spark, d: reports.health(pages(spark, d), issues(spark, d)), _HEALTH)
on_pages(
    "performance",
    reports.performance,
    f"""SELECT crawl_id, count(*) AS n, round(avg(response_time_ms), 3) AS mean, round(quantile_cont(response_time_ms, 0.5), 3) AS p50, round(quantile_cont(response_time_ms, 0.95), 3) AS p95, min(response_time_ms) AS least,
  max(response_time_ms) AS most, count(*) FILTER (response_time_ms > 1000) AS slow, count(*) FILTER (response_time_ms > 3000) AS very_slow FROM crawled_urls WHERE {_OK} AND response_time_ms IS NOT NULL GROUP BY 1""",
)
on_pages("response_buckets", reports.response_buckets, f"SELECT crawl_id, {buckets('response_time_ms', reports.RESPONSE_BUCKETS)} AS bucket, count(*) AS n, min(response_time_ms) AS least FROM crawled_urls WHERE {_OK} AND response_time_ms IS NOT NULL GROUP BY 1, 2")
on_pages("slowest_pages", reports.slowest, top("crawl_id, id, url, response_time_ms, status_code", "crawled_urls WHERE response_time_ms IS NOT NULL", "response_time_ms DESC, id", 20))
on_pages("response_classes", reports.response_classes, f"SELECT crawl_id, coalesce({buckets('response_time_ms', reports.RESPONSE_CLASSES)}, 'unknown') AS bucket, count(*) AS n, CAST(round(avg(response_time_ms), 0) AS INTEGER) AS mean, min(response_time_ms) AS least, max(response_time_ms) AS most FROM crawled_urls WHERE {_HTML} GROUP BY 1, 2")
on_pages("slowest_html", reports.slowest_html, top("crawl_id, id, url, response_time_ms, status_code", f"crawled_urls WHERE {_HTML} AND response_time_ms IS NOT NULL", "response_time_ms DESC, id", 20))
_CLASS = "CASE " + " ".join(f"WHEN lower(content_type) LIKE '{p}' THEN '{n}'" for p, n in [("text/html%", "HTML"), ("%javascript%", "JavaScript"), ("text/css%", "CSS"), ("image/%", "Images"), ("%json%", "JSON"), ("%xml%", "XML"), ("%pdf%", "PDF"), ("%font%", "Fonts")]) + " WHEN content_type IS NOT NULL THEN 'Other' END"
on_pages(
    "overview",
    reports.overview,
    f"""SELECT crawl_id, 'status' AS kind, CASE WHEN status_code BETWEEN 200 AND 299 THEN '2xx' WHEN status_code BETWEEN 300 AND 399 THEN '3xx' WHEN status_code BETWEEN 400 AND 499 THEN '4xx' WHEN status_code BETWEEN 500 AND 599 THEN '5xx' ELSE 'other' END AS name, count(*) AS n
  FROM crawled_urls WHERE status_code IS NOT NULL GROUP BY ALL UNION ALL SELECT crawl_id, 'content', {_CLASS}, count(*) FROM crawled_urls WHERE content_type IS NOT NULL GROUP BY ALL
  UNION ALL SELECT crawl_id, 'indexable', CAST(is_indexable AS VARCHAR), count(*) FROM crawled_urls GROUP BY ALL""",
)
on_pages(
    "timeline_summary",
    lambda p: micros(reports.timeline_summary(p), "first", "last"),
    f"""SELECT crawl_id, count(*) AS total, epoch_us(min(crawled_at)) AS first, epoch_us(max(crawled_at)) AS last, count(*) FILTER ({_OK}) AS ok, count(*) FILTER (status_code BETWEEN 300 AND 399) AS redirects, count(*) FILTER (status_code >= 400 OR status_code = 0) AS errors,
  round(avg(response_time_ms), 3) AS mean FROM crawled_urls GROUP BY 1""",
)
on_pages("timeline_errors", lambda p: micros(reports.timeline(p, "errors"), "crawled_at"), top("crawl_id, id, url, status_code, epoch_us(crawled_at) AS crawled_at", "crawled_urls WHERE status_code >= 400 OR status_code = 0", "crawled_urls.crawled_at DESC, id", 50))
on_pages("crawl_speed", lambda p: micros(reports.crawl_speed(p), "second"), "SELECT crawl_id, epoch_us(date_trunc('second', crawled_at)) AS second, count(*) AS n, round(avg(response_time_ms), 3) AS mean FROM crawled_urls GROUP BY 1, 2")
_WINS = " UNION ALL ".join(f"SELECT crawl_id, '{w}' AS win, {w} AS n, '{p}' AS priority, '{c}' AS category, '{i}' AS impact, '{e}' AS effort FROM q WHERE {w} > 0" for w, p, c, i, e in reports.WINS)
_TYPES = [w[0] for w in reports.WINS if w[0] not in ("slow_pages", "long_redirects", "not_indexable", "thin_pages")]
report(
    "quick_wins",
    lambda spark, d: reports.quick_wins(pages(spark, d), issues(spark, d)),
    f"""{ISSUES}, p AS (SELECT crawl_id, count(*) FILTER ({_OK} AND response_time_ms > 1000) AS slow_pages, count(*) FILTER (len(redirect_chain) > 2) AS long_redirects, count(*) FILTER (NOT is_indexable AND {_OK} AND {_HTML}) AS not_indexable,
  count(*) FILTER (word_count < 100 AND {_OK} AND {_HTML}) AS thin_pages FROM crawled_urls GROUP BY 1), i AS (SELECT crawl_id, {", ".join(f"count(*) FILTER (issue_type = '{t}') AS {t}" for t in _TYPES)} FROM issues GROUP BY 1),
q AS (SELECT p.*, i.* EXCLUDE (crawl_id) FROM p LEFT JOIN i USING (crawl_id)) {_WINS}""",
)
_STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)
on_pages(
    "keywords",
    reports.keywords,
    f"""WITH t AS (SELECT crawl_id, unnest(list_concat([coalesce(title, '')], coalesce(h1, []))) AS t FROM crawled_urls WHERE {_OK} AND {_HTML}),
w AS (SELECT crawl_id, unnest(regexp_extract_all(lower(t), '[a-z0-9฀-๿]+')) AS word FROM t), f AS (SELECT crawl_id, word, count(*) AS n FROM w WHERE length(word) > 1 AND word NOT IN ({_STOP}) GROUP BY 1, 2),
m AS (SELECT *, round(n / max(n) OVER (PARTITION BY crawl_id), 3) AS weight, count(*) OVER (PARTITION BY crawl_id) AS unique_words FROM f),
o AS (SELECT crawl_id, count(*) AS total_pages FROM crawled_urls WHERE {_OK} AND {_HTML} GROUP BY 1) """
    + top("crawl_id, word, n, weight, unique_words, total_pages", "m JOIN o USING (crawl_id)", "n DESC, word", 50),
)
_SEGMENT = "regexp_extract(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '^/([^/]+)/', 1)"
on_pages(
    "segments",
    reports.segments,
    f"""WITH g AS (SELECT crawl_id, CASE WHEN {_SEGMENT} <> '' THEN '/' || {_SEGMENT} || '/' ELSE '/' END AS segment, * EXCLUDE (crawl_id) FROM crawled_urls),
a AS (SELECT crawl_id, segment, count(*) AS total, count(*) FILTER ({_OK}) AS ok, count(*) FILTER (status_code >= 400 OR status_code = 0) AS errors, count(*) FILTER (status_code BETWEEN 300 AND 399) AS redirects, count(*) FILTER (is_indexable) AS indexable,
  round(avg(response_time_ms), 1) AS mean_ms, round(avg(word_count), 0) AS mean_words FROM g GROUP BY 1, 2) SELECT *, round(ok * 100.0 / total, 1) AS health, round(indexable * 100.0 / total, 1) AS index_share FROM a""",
)
on_pages("content_quality", reports.content_quality, f"SELECT crawl_id, {buckets('coalesce(word_count, 0)', reports.WORD_BUCKETS)} AS bucket, count(*) AS n, min(coalesce(word_count, 0)) AS least, CAST(round(avg(word_count), 0) AS INTEGER) AS mean_words FROM crawled_urls WHERE {_HTML} GROUP BY 1, 2")
on_pages("content_stats", reports.content_stats, f"SELECT crawl_id, CAST(round(avg(word_count), 0) AS INTEGER) AS mean, CAST(round_even(quantile_cont(word_count, 0.5), 0) AS INTEGER) AS median, max(word_count) AS most, count(*) FILTER (coalesce(word_count, 0) < 100) AS thin FROM crawled_urls WHERE {_HTML} AND {_OK} GROUP BY 1")
on_pages("thin_pages", reports.thin_pages, top("crawl_id, id, url, coalesce(word_count, 0) AS words", f"crawled_urls WHERE {_HTML} AND {_OK} AND coalesce(word_count, 0) < 100", "coalesce(word_count, 0), id", 200))
on_pages("content_list", reports.content_list, top("crawl_id, id, word_count, text_ratio, readability_score", f"crawled_urls WHERE {_HTML}", "word_count DESC NULLS FIRST, id", 100))
on_pages(
    "depth_analysis",
    reports.depth_analysis,
    f"""SELECT crawl_id, crawl_depth, count(*) AS n, count(*) FILTER ({_OK}) AS ok, count(*) FILTER (status_code >= 400) AS errors, count(*) FILTER (is_indexable) AS indexable, CAST(round(avg(response_time_ms), 0) AS INTEGER) AS mean_ms,
  CAST(round(avg(word_count), 0) AS INTEGER) AS mean_words FROM crawled_urls WHERE {_HTML} GROUP BY 1, 2""",
)
on_pages("readability", reports.readability, f"SELECT crawl_id, count(*) AS total, count(readability_score) AS scored, round(avg(CAST(readability_score AS DECIMAL(12, 4))), 1) AS score, round(avg(CAST(text_ratio AS DECIMAL(12, 4))), 2) AS ratio, round(avg(CAST(avg_words_per_sentence AS DECIMAL(12, 4))), 1) AS sentence FROM crawled_urls WHERE {_HTML} AND {_OK} AND text_ratio IS NOT NULL GROUP BY 1")
on_pages("ratio_buckets", reports.ratio_buckets, f"SELECT crawl_id, {buckets('text_ratio', reports.RATIO_BUCKETS)} AS bucket, count(*) AS n FROM crawled_urls WHERE {_HTML} AND {_OK} AND text_ratio IS NOT NULL GROUP BY 1, 2")
on_pages("hardest_pages", reports.hardest_pages, top("crawl_id, id, readability_score", f"crawled_urls WHERE {_HTML} AND {_OK} AND readability_score IS NOT NULL", "readability_score, id", 50))
_OGF = "count(*) FILTER (coalesce(doc->>'$.og.{0}', '') = '') AS no_{0}"
on_pages("open_graph", reports.open_graph, f"WITH {DOC} SELECT crawl_id, count(*) AS pages, count(*) FILTER (doc->>'$.og' IS NOT NULL) AS with_og, {_OGF.format('title')}, {_OGF.format('description')}, {_OGF.format('image')} FROM s WHERE html AND {_OK} GROUP BY 1")
on_pages("mobile", reports.mobile, f"WITH {DOC} SELECT crawl_id, count(*) AS pages, count(*) FILTER (coalesce(doc->>'$.viewport', '') <> '') AS with_viewport, count(*) FILTER (contains(coalesce(doc->>'$.viewport', ''), 'width=device-width')) AS responsive FROM s WHERE html AND {_OK} GROUP BY 1")
_KIND = "CASE " + " ".join(f"WHEN lower(content_type) LIKE '{p}' THEN '{n}'" for p, n in [("%javascript%", "JavaScript"), ("%css%", "CSS"), ("%image/%", "Image"), ("%font%", "Font"), ("%woff%", "Font"), ("%pdf%", "PDF"), ("%json%", "JSON"), ("%xml%", "XML"), ("%text/html%", "HTML")]) + " ELSE 'Other' END"
on_pages("resources", reports.resources, f"SELECT crawl_id, {_KIND} AS kind, count(*) AS n, count(*) FILTER ({_OK}) AS ok, count(*) FILTER (status_code >= 400) AS errors, CAST(round(avg(response_time_ms), 0) AS INTEGER) AS mean_ms FROM crawled_urls GROUP BY 1, 2")
on_pages("resource_list", reports.resource_list, top(f"crawl_id, id, {_KIND} AS kind, status_code, response_time_ms", f"crawled_urls WHERE NOT {_HTML}", "CASE WHEN status_code >= 400 THEN 0 ELSE 1 END, response_time_ms DESC NULLS LAST, id", 300))
_NOALT = "len(list_filter(im, lambda i: coalesce(i->>'$.alt', '') = ''))"
_NOSIZE = "len(list_filter(im, lambda i: coalesce(i->>'$.width', '') = '' OR coalesce(i->>'$.height', '') = ''))"
on_pages(
    "images_audit",
    reports.images,
    f"""WITH {DOC}, p AS (SELECT crawl_id, json_extract(doc, '$.images[*]') AS im FROM s), g AS (SELECT crawl_id, count(*) AS pages, CAST(sum(len(im)) AS BIGINT) AS images, CAST(sum({_NOALT}) AS BIGINT) AS no_alt, CAST(sum({_NOSIZE}) AS BIGINT) AS no_size
  FROM p WHERE len(im) > 0 GROUP BY 1) SELECT *, round((images - no_alt) * 100.0 / images, 1) AS alt_share, round(images / pages, 1) AS per_page FROM g""",
)
on_pages(
    "images_without_alt",
    reports.images_without_alt,
    f"WITH {DOC}, p AS (SELECT crawl_id, id, json_extract(doc, '$.images[*]') AS im FROM s), e AS (SELECT crawl_id, id, unnest(im) AS i, CAST(generate_subscripts(im, 1) - 1 AS INTEGER) AS place FROM p), "
    + "n AS (SELECT crawl_id, id, place, i->>'$.src' AS src FROM e WHERE coalesce(i->>'$.alt', '') = '') "
    + top("*", "n", "id, place", 100),
)
on_pages("images_without_alt_all", reports.images_without_alt, SQL["images_without_alt"].split(" QUALIFY ")[0], None)
on_pages(
    "accessibility",
    reports.accessibility,
    f"""WITH {DOC}, p AS (SELECT crawl_id, coalesce(len(h1), 0) AS h, coalesce(json_extract(doc, '$.images[*]'), []) AS im, list_filter(coalesce(json_extract_string(doc, '$.heading_sequence[*]'), []), lambda x: regexp_matches(x, '^h[0-9]$')) AS l FROM s WHERE html AND {_OK}),
k AS (SELECT *, len(list_filter(range(2, len(l) + 1), lambda i: CAST(l[i][2] AS INTEGER) - CAST(l[i - 1][2] AS INTEGER) > 1)) > 0 AS skip FROM p),
g AS (SELECT crawl_id, count(*) AS pages, CAST(sum(len(im)) AS BIGINT) AS images, CAST(sum({_NOALT}) AS BIGINT) AS no_alt, count(*) FILTER (h = 0) AS no_h1, count(*) FILTER (h > 1) AS several_h1, count(*) FILTER (skip) AS skipped, count(*) FILTER (h <> 1 OR skip) AS with_issues FROM k GROUP BY 1)
SELECT *, round((1 - no_alt / greatest(images, 1)) * 100, 1) AS alt_share FROM g""",
)
_BLOCKS = "CASE WHEN json_type(doc->'$.json_ld') = 'ARRAY' THEN json_extract(doc, '$.json_ld[*]') WHEN doc->>'$.json_ld' IS NOT NULL THEN [doc->'$.json_ld'] ELSE [] END"
_LD = f"""WITH {DOC}, p AS (SELECT crawl_id, id, json_extract(doc, '$.json_ld[*]') AS bs FROM s WHERE html AND {_OK} AND json_type(doc->'$.json_ld') = 'ARRAY'),
o AS (SELECT crawl_id, id, b, CASE WHEN json_type(b->'$."@type"') = 'ARRAY' THEN array_to_string(json_extract_string(b, '$."@type"[*]'), ', ') ELSE coalesce(b->>'$."@type"', 'Unknown') END AS type
  FROM (SELECT crawl_id, id, unnest(bs) AS b FROM p) WHERE json_type(b) = 'OBJECT')"""
on_pages("structured_types", reports.structured_types, f"{_LD} SELECT crawl_id, type, count(*) AS blocks FROM o GROUP BY 1, 2")
_LACKS = """coalesce(b->>'$."{}"', '') IN ('', '[]', '{{}}', 'false', '0')"""
_WARNED = " OR ".join([_LACKS.format("@context")] + [f"type IN ({', '.join(repr(t) for t, some in reports.REQUIRED.items() if f in some)}) AND {_LACKS.format(f)}" for f in sorted({f for some in reports.REQUIRED.values() for f in some})])
_WARNINGS = " + ".join([f"count(*) FILTER ({_LACKS.format('@context')})"] + [f"count(*) FILTER (type IN ({', '.join(repr(t) for t, some in reports.REQUIRED.items() if f in some)}) AND {_LACKS.format(f)})" for f in sorted({f for some in reports.REQUIRED.values() for f in some})])
on_pages(
    "structured_pages",
    lambda p: reports.structured_pages(p).select("crawl_id", "id", F.array_join("types", " | ").alias("types"), "blocks", F.size("warnings").alias("warnings")),
    f"""{_LD}, w AS (SELECT crawl_id, id, string_agg(type, ' | ') AS types, {_WARNINGS} AS warnings FROM o GROUP BY 1, 2)
SELECT p.crawl_id, p.id, coalesce(types, '') AS types, CAST(len(bs) AS INTEGER) AS blocks, CAST(coalesce(warnings, 0) AS INTEGER) AS warnings FROM p LEFT JOIN w USING (crawl_id, id) WHERE len(bs) > 0""",
)
on_pages(
    "structured_coverage",
    reports.structured_coverage,
    f"""{_LD}, t AS (SELECT crawl_id, count(*) AS html_pages FROM s WHERE html AND {_OK} GROUP BY 1), d AS (SELECT crawl_id, count(*) AS with_data FROM p WHERE len(bs) > 0 GROUP BY 1),
w AS (SELECT crawl_id, count(DISTINCT id) AS with_warnings FROM o WHERE {_WARNED} GROUP BY 1)
SELECT crawl_id, html_pages, coalesce(with_data, 0) AS with_data, round(coalesce(with_data, 0) * 100.0 / html_pages, 1) AS coverage, coalesce(with_warnings, 0) AS with_warnings FROM t LEFT JOIN d USING (crawl_id) LEFT JOIN w USING (crawl_id)""",
)


def _validation(fields: dict[str, list[str]]) -> str:
    has = """coalesce(b->>'$."{}"', '') <> ''"""
    parts = [f"SELECT crawl_id, id, place, 'no {f}' AS message FROM o WHERE NOT ({has.format(f)})" for f in ("@type", "@context")]
    for name in sorted({f for some in fields.values() for f in some}):
        of = ", ".join(f"'{t}'" for t, some in fields.items() if name in some)
        parts.append(f"""SELECT crawl_id, id, place, 'no {name}' FROM o WHERE b->>'$."@type"' IN ({of}) AND NOT ({has.format(name)})""")
    return f"WITH {DOC}, e AS (SELECT crawl_id, id, unnest({_BLOCKS}) AS b, CAST(generate_subscripts({_BLOCKS}, 1) - 1 AS INTEGER) AS place FROM s), o AS (SELECT * FROM e WHERE json_type(b) = 'OBJECT') " + " UNION ALL ".join(parts)


on_pages("structured_recommended", reports.structured_validation, _validation(reports.RECOMMENDED))
on_pages("structured_required", reports.structured_validation, _validation(reports.REQUIRED), reports.REQUIRED)
_HEADERS = ["http_url", "mixed_content", "missing_hsts", "missing_csp", "missing_x_content_type_options", "missing_x_frame_options"]
report(
    "security_overview",
    lambda spark, d: reports.security(pages(spark, d), rules.page_issues(pages(spark, d))),
    f"""{ISSUES}, p AS (SELECT crawl_id, count(*) FILTER ({_OK} AND url LIKE 'https://%') AS https, count(*) FILTER ({_OK} AND url LIKE 'http://%') AS http FROM crawled_urls GROUP BY 1),
i AS (SELECT crawl_id, {", ".join(f"count(*) FILTER (issue_type = '{t}') AS {t}" for t in _HEADERS)} FROM issues GROUP BY 1) SELECT p.*, {", ".join(f"coalesce({t}, 0) AS {t}" for t in _HEADERS)} FROM p LEFT JOIN i USING (crawl_id)""",
)
_FLAG = "len(list_filter(c, lambda x: NOT coalesce(TRY_CAST(x->>'$.{}' AS BOOLEAN), false)))"
on_pages(
    "cookies_audit",
    reports.cookies,
    f"""WITH {DOC}, c AS (SELECT crawl_id, id, json_extract(doc, '$.cookies[*]') AS c FROM s), n AS (SELECT crawl_id, id, CAST(len(c) AS INTEGER) AS n, CAST({_FLAG.format("secure")} AS INTEGER) AS not_secure, CAST({_FLAG.format("http_only")} AS INTEGER) AS not_http_only,
  CAST(len(list_filter(c, lambda x: lower(coalesce(x->>'$.same_site', 'none')) IN ('none', ''))) AS INTEGER) AS no_same_site FROM c WHERE len(c) > 0) """
    + top("*", "n", "n DESC, id", 200),
)
on_pages(
    "redirect_chains",
    reports.redirect_chains,
    top("crawl_id, id, url, status_code, redirect_url, CAST(greatest(len(coalesce(redirect_chain, [])), 1) AS INTEGER) AS hops", "crawled_urls WHERE redirect_url IS NOT NULL", "hops DESC, url, id", 200),
)
on_pages("hreflang", reports.hreflang, f"WITH {DOC}, h AS (SELECT crawl_id, id, unnest(json_extract(doc, '$.hreflang[*]')) AS h FROM s) SELECT crawl_id, id, h->>'$.lang' AS lang, h->>'$.href' AS href FROM h")
on_pages("link_score_ranking", reports.link_scores, top("crawl_id, id, url, link_score", "crawled_urls WHERE link_score IS NOT NULL", "link_score DESC, id", 100))
_PDF = "(lower(content_type) LIKE '%pdf%' OR url LIKE '%.pdf%')"
report(
    "pdf_audit",
    lambda spark, d: reports.pdf_audit(pages(spark, d), links(spark, d)),
    f"""WITH {DOC}, l AS (SELECT crawl_id, target_url AS url, count(*) AS inlinks FROM page_links GROUP BY 1, 2),
p AS (SELECT crawl_id, id, url, status_code, response_time_ms, coalesce(TRY_CAST(doc->>'$.content_length' AS BIGINT), 0) AS size_bytes, coalesce(nullif(doc->>'$.pdf_title', ''), nullif(title, '')) AS pdf_title FROM s WHERE {_PDF})
SELECT p.crawl_id, id, p.url, status_code, size_bytes, round(size_bytes / 1024, 1) AS size_kb, pdf_title, coalesce(inlinks, 0) AS inlinks,
  array_to_string(list_filter([CASE WHEN pdf_title IS NULL THEN 'missing_title' END, CASE WHEN size_bytes > 5242880 THEN 'large_file' END, CASE WHEN status_code >= 400 THEN 'broken' END, CASE WHEN response_time_ms > 5000 THEN 'slow' END], lambda x: x IS NOT NULL), ', ') AS issues
FROM p LEFT JOIN l ON l.crawl_id = p.crawl_id AND l.url = p.url""",
)
report(
    "pdf_inlinks",
    lambda spark, d: reports.pdf_inlinks(pages(spark, d), links(spark, d)),
    f"""SELECT l.crawl_id, target_url, u.url AS source_url, anchor_text FROM page_links l JOIN crawled_urls u ON u.crawl_id = l.crawl_id AND u.id = l.source_url_id
WHERE (l.crawl_id, target_url) IN (SELECT (crawl_id, url) FROM crawled_urls WHERE {_PDF})""",
)
on_pages(
    "site_structure",
    reports.site_structure,
    f"""WITH p AS (SELECT crawl_id, status_code, list_filter(string_split(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/'), lambda x: x <> '') AS parts FROM crawled_urls),
e AS (SELECT crawl_id, status_code, parts, unnest(range(0, len(parts) + 1)) AS depth FROM p)
SELECT crawl_id, '/' || array_to_string(parts[1:depth], '/') AS prefix, CAST(depth AS INTEGER) AS depth, count(*) AS pages, count(*) FILTER ({_OK}) AS ok, count(*) FILTER (status_code >= 400) AS errors FROM e GROUP BY ALL""",
)
report(
    "project_stats",
    lambda spark, d: micros(reports.project_stats(table(spark, d, "crawls")), "created_at"),
    "WITH c AS (SELECT DISTINCT project_id, id, status, total_urls, error_count, epoch_us(created_at) AS created_at, (epoch_us(completed_at) - epoch_us(started_at)) / 1e6 AS seconds FROM crawls) " + top("*", "c", "created_at DESC, id", 20, "project_id"),
)
report(
    "project_trends",
    lambda spark, d: micros(reports.project_trends(table(spark, d, "crawls"), pages(spark, d), issues(spark, d)), "completed_at"),
    f"""{ISSUES}, c0 AS (SELECT DISTINCT project_id, id AS crawl_id, epoch_us(completed_at) AS completed_at FROM crawls WHERE status = 'completed'), c AS ({top("*", "c0", "completed_at DESC NULLS LAST, crawl_id", 50, "project_id")}),
p AS (SELECT crawl_id, round(avg(response_time_ms), 3) AS mean, round(quantile_cont(response_time_ms, 0.5), 3) AS median FROM crawled_urls WHERE status_code < 400 GROUP BY 1),
i AS (SELECT crawl_id, count(*) AS issues, count(*) FILTER (severity = 'critical') AS critical, count(*) FILTER (severity = 'warning') AS warnings, count(*) FILTER (severity = 'info') AS infos FROM issues GROUP BY 1)
SELECT c.*, mean, median, coalesce(i.issues, 0) AS issues, coalesce(critical, 0) AS critical, coalesce(warnings, 0) AS warnings, coalesce(infos, 0) AS infos FROM c LEFT JOIN p USING (crawl_id) LEFT JOIN i USING (crawl_id)""",
)
report(
    "dashboard",
    lambda spark, d: micros(reports.dashboard(table(spark, d, "projects"), table(spark, d, "crawls")), "last"),
    """WITH c AS (SELECT project_id, count(*) AS crawls, CAST(sum(crawled_urls_count) AS BIGINT) AS urls, CAST(sum(error_count) AS BIGINT) AS errors, count(*) FILTER (status = 'crawling') AS active, epoch_us(max(created_at)) AS last
  FROM (SELECT DISTINCT id, project_id, crawled_urls_count, error_count, status, created_at FROM crawls) GROUP BY 1)
SELECT p.id AS project_id, name, coalesce(crawls, 0) AS crawls, coalesce(urls, 0) AS urls, coalesce(errors, 0) AS errors, coalesce(active, 0) AS active, last FROM projects p LEFT JOIN c ON c.project_id = p.id""",
)
on_pages(
    "redirect_counts",
    reports.redirect_counts,
    "SELECT crawl_id, count(*) FILTER (len(redirect_chain) > 0) AS redirected, count(*) FILTER (len(redirect_chain) > 2) AS long, count(*) FILTER (status_code = 301) AS moved, count(*) FILTER (status_code = 302) AS found FROM crawled_urls GROUP BY 1",
)
on_pages(
    "cookie_totals",
    reports.cookie_totals,
    f"WITH {DOC}, c AS (SELECT crawl_id, json_extract(doc, '$.cookies[*]') AS c FROM s) SELECT crawl_id, count(*) AS pages, CAST(sum(len(c)) AS BIGINT) AS cookies, CAST(sum({_FLAG.format('secure')}) AS BIGINT) AS not_secure FROM c WHERE len(c) > 0 GROUP BY 1",
)
report(
    "project_crawls",
    lambda spark, d: micros(reports.project_crawls(table(spark, d, "crawls")), "created_at"),
    "WITH c AS (SELECT DISTINCT project_id, id, status, epoch_us(created_at) AS created_at FROM crawls) " + top("*", "c", "created_at DESC, id", 50, "project_id"),
)
