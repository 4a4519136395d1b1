"""Queries on links, graphs, comparisons and filtered lists, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagequarry.operators import compare, duplicates, filters, hierarchy, links, reports, rules
from pagequarry.plans.audit import DOC, ISSUES, once, pages
from pagequarry.plans.audit import links as link_table
from pagequarry.plans.cases import with_cases, with_links, with_pages
from pagequarry.plans.reports import _HEALTH, issues, top
from pagequarry.session import staged, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def add(name: str, f, sql: str | None = None, cases: bool = False) -> None:
    QUERIES[name] = f
    if sql:
        SQL[name] = with_cases(once(sql)) if cases else once(sql)


def on_links(name: str, f, sql: str | None = None, *args, **kwargs) -> None:
    add(name, lambda spark, d: f(pages(spark, d), link_table(spark, d), *args, **kwargs), sql)


_SOURCE = "JOIN crawled_urls u ON u.crawl_id = l.crawl_id AND u.id = l.source_url_id"
on_links("inlinks", links.inlinks, f"SELECT l.crawl_id, target_url, u.url AS source_url, anchor_text, link_type FROM page_links l {_SOURCE}")
on_links("inlink_counts", links.inlink_counts, "WITH n AS (SELECT crawl_id, target_url_hash AS url_hash, count(*) AS inlinks FROM page_links WHERE link_type = 'internal' GROUP BY 1, 2) SELECT crawl_id, id, coalesce(inlinks, 0) AS inlinks FROM crawled_urls LEFT JOIN n USING (crawl_id, url_hash)")
_ORPHAN = "SELECT crawl_id, id, url FROM crawled_urls u WHERE lower(content_type) LIKE 'text/html%' AND NOT EXISTS (SELECT 1 FROM page_links l WHERE l.crawl_id = u.crawl_id AND l.target_url_hash = u.url_hash AND link_type = 'internal'"
on_links("orphans", links.orphans, _ORPHAN + " AND l.source_url_id <> u.id)")
on_links("orphans_below_start", links.orphans, _ORPHAN + ") AND crawl_depth > 0", exclude_start=True)
add("anchor_texts", lambda spark, d: links.anchor_texts(link_table(spark, d)), "WITH n AS (SELECT crawl_id, anchor_text, count(*) AS n FROM page_links WHERE link_type = 'internal' AND anchor_text <> '' GROUP BY 1, 2) " + top("*", "n", "n DESC, anchor_text", 50))
_NOFOLLOW = "coalesce(list_contains(rel_attrs, 'nofollow'), false)"
on_links("external_links", links.external_links, f"SELECT l.crawl_id, l.id, target_url, u.url AS source_url, anchor_text, {_NOFOLLOW} AS nofollow FROM page_links l {_SOURCE} WHERE link_type = 'external'")
on_links("external_followed", links.external_links, f"SELECT l.crawl_id, l.id, target_url, u.url AS source_url, anchor_text, false AS nofollow FROM page_links l {_SOURCE} WHERE link_type = 'external' AND NOT {_NOFOLLOW}", nofollow=False)
add(
    "outlinks",
    lambda spark, d: links.outlinks(link_table(spark, d)).withColumn("rel_attrs", F.array_join("rel_attrs", " ")),
    top("crawl_id, source_url_id, id, target_url, anchor_text, link_type, array_to_string(coalesce(rel_attrs, []), ' ') AS rel_attrs, link_position, is_javascript", "page_links", "id", 100, "crawl_id, source_url_id"),
)
on_links(
    "links_analysis",
    links.links_analysis,
    f"""WITH n AS (SELECT crawl_id, target_url_hash AS url_hash, count(*) AS n FROM page_links WHERE link_type = 'internal' GROUP BY 1, 2), i AS (SELECT u.crawl_id, id, n FROM crawled_urls u JOIN n USING (crawl_id, url_hash)), o AS ({_ORPHAN} AND l.source_url_id <> u.id)),
a AS (SELECT crawl_id, anchor_text, count(*) AS n FROM page_links WHERE link_type = 'internal' AND anchor_text <> '' GROUP BY 1, 2)
SELECT crawl_id, 'inlinks' AS part, id AS name, n FROM ({top("*", "i", "n DESC, id", 50)}) UNION ALL SELECT crawl_id, 'orphans', id, 0 FROM ({top("*", "o", "url, id", 50)})
UNION ALL SELECT crawl_id, 'depth', CAST(crawl_depth AS VARCHAR), count(*) FROM crawled_urls GROUP BY ALL UNION ALL SELECT crawl_id, 'anchors', anchor_text, n FROM ({top("*", "a", "n DESC, anchor_text", 50)})""",
)
add("outlink_counts", lambda spark, d: links.outlink_counts(link_table(spark, d)), "SELECT crawl_id, source_url_id, count(*) FILTER (link_type = 'internal') AS internal, count(*) FILTER (link_type <> 'internal') AS other FROM page_links GROUP BY 1, 2")
add("uncrawled", lambda spark, d: links.uncrawled(with_pages(pages(spark, d)), with_links(link_table(spark, d))), "SELECT DISTINCT crawl_id, target_url FROM page_links l WHERE link_type = 'internal' AND NOT EXISTS (SELECT 1 FROM crawled_urls u WHERE u.crawl_id = l.crawl_id AND u.url_hash = l.target_url_hash)", cases=True)
_EDGES = f"edges AS (SELECT l.crawl_id, l.source_url_id AS source, t.id AS target, {_NOFOLLOW} AS nofollow FROM page_links l JOIN crawled_urls t ON t.crawl_id = l.crawl_id AND t.url_hash = l.target_url_hash WHERE link_type = 'internal')"
_NODES = f"""{_EDGES}, n AS (SELECT crawl_id, target AS id, count(DISTINCT source) AS sources FROM edges GROUP BY 1, 2), p AS (SELECT DISTINCT crawl_id, id, url FROM crawled_urls),
q AS (SELECT crawl_id, id, url, coalesce(sources, 0) AS sources FROM p LEFT JOIN n USING (crawl_id, id)), nodes AS ({top("*", "q", "sources DESC, id", 200)})"""
on_links("graph_nodes", links.graph_nodes, f"WITH {_NODES} SELECT * FROM nodes")
on_links("graph_edges", links.graph_edges, f"WITH {_NODES} SELECT DISTINCT e.crawl_id, source, target FROM edges e JOIN nodes a ON a.crawl_id = e.crawl_id AND a.id = source JOIN nodes b ON b.crawl_id = e.crawl_id AND b.id = target WHERE source <> target")


def _scores(rounds: int) -> str:
    steps = "".join(
        f""", r{i} AS MATERIALIZED (SELECT nodes.crawl_id, nodes.id, n, 0.15 / n + 0.85 * coalesce(got, 0) AS rank FROM nodes LEFT JOIN
  (SELECT w.crawl_id, w.target AS id, sum(w.w * r.rank) AS got FROM w JOIN r{i - 1} r ON r.crawl_id = w.crawl_id AND r.id = w.source GROUP BY 1, 2) g ON g.crawl_id = nodes.crawl_id AND g.id = nodes.id)"""
        for i in range(1, rounds + 1)
    )
    return f"""WITH {_EDGES}, nodes0 AS (SELECT DISTINCT crawl_id, id FROM crawled_urls WHERE lower(content_type) LIKE 'text/html%' AND status_code = 200),
nodes AS MATERIALIZED (SELECT crawl_id, id, count(*) OVER (PARTITION BY crawl_id) AS n FROM nodes0 QUALIFY n > 1),
e AS (SELECT edges.* FROM edges JOIN nodes a ON a.crawl_id = edges.crawl_id AND a.id = source JOIN nodes b ON b.crawl_id = edges.crawl_id AND b.id = target),
pairs AS (SELECT crawl_id, source, target, count(*) AS every, count(*) FILTER (NOT nofollow) AS passing FROM e GROUP BY 1, 2, 3),
w AS MATERIALIZED (SELECT crawl_id, source, target, passing / sum(every) OVER (PARTITION BY crawl_id, source) AS w FROM pairs), r0 AS (SELECT crawl_id, id, n, 1.0::DOUBLE / n AS rank FROM nodes){steps},
f AS (SELECT crawl_id, id, rank, min(rank) OVER (PARTITION BY crawl_id) AS low, max(rank) OVER (PARTITION BY crawl_id) AS high FROM r{rounds})
SELECT crawl_id, id, CAST(CASE WHEN high > low THEN greatest(1, round_even(round(log10((rank - low) / (high - low) * 99 + 1) / 2 * 99 + 1, 9), 0)) ELSE 50 END AS INTEGER) AS link_score FROM f"""


on_links("link_score", links.link_score, _scores(links.ITERATIONS))
on_links(
    "crawl_order",
    links.crawl_order,
    f"""WITH RECURSIVE {_EDGES}, d AS (SELECT DISTINCT crawl_id, source, target FROM edges), b(crawl_id, id, depth) AS (SELECT crawl_id, id, 0 FROM crawled_urls WHERE crawl_depth = 0 UNION
  SELECT d.crawl_id, d.target, b.depth + 1 FROM b JOIN d ON d.crawl_id = b.crawl_id AND d.source = b.id WHERE b.depth < 10) SELECT crawl_id, id, CAST(min(depth) AS INTEGER) AS depth FROM b GROUP BY 1, 2""",
)
on_links(
    "crawl_order_all",
    links.crawl_order,
    f"""WITH RECURSIVE {_EDGES}, d AS (SELECT DISTINCT crawl_id, source, target FROM edges), b(crawl_id, id, depth) USING KEY (crawl_id, id) AS (SELECT DISTINCT crawl_id, id, 0 FROM crawled_urls WHERE crawl_depth = 0 UNION
  SELECT d.crawl_id, d.target, min(b.depth) + 1 FROM b JOIN d ON d.crawl_id = b.crawl_id AND d.source = b.id LEFT JOIN recurring.b r ON r.crawl_id = d.crawl_id AND r.id = d.target WHERE r.id IS NULL GROUP BY 1, 2)
SELECT crawl_id, id, CAST(depth AS INTEGER) AS depth FROM b""",
    max_depth=None,
)


def pagination_loops(spark, d):
    """First pages whose next pages lead into a loop."""
    refs = staged(rules.pagination_refs(with_pages(pages(spark, d))), "pagination")
    first = refs.where("rel = 'next'").join(refs.where("rel = 'prev'").select("url_id"), "url_id", "left_anti")
    walks = hierarchy.resolve(refs.where("rel = 'next'"), "crawl_id", "url", "target").nodes
    looped = walks.where(F.col("depth") < 0).select(F.col("scope").alias("crawl_id"), F.col("node").alias("url"))
    return first.join(looped, ["crawl_id", "url"]).select("crawl_id", "url_id", "url", F.lit("pagination_loop").alias("issue_type"))


add(
    "pagination_loops",
    pagination_loops,
    f"""WITH RECURSIVE {DOC}, f AS MATERIALIZED (SELECT crawl_id, id AS url_id, url, doc->>'$.pagination.rel_next' AS n, doc->>'$.pagination.rel_prev' AS p FROM s WHERE html),
e AS MATERIALIZED (SELECT crawl_id, url, min(n) AS n FROM f WHERE coalesce(n, '') <> '' GROUP BY 1, 2), st AS (SELECT * FROM f WHERE coalesce(n, '') <> '' AND coalesce(p, '') = ''),
walk(crawl_id, url, here, hops) AS (SELECT crawl_id, url, url, 0 FROM st UNION SELECT w.crawl_id, w.url, e.n, w.hops + 1 FROM walk w JOIN e ON e.crawl_id = w.crawl_id AND e.url = w.here WHERE w.hops < 500)
SELECT st.crawl_id, st.url_id, st.url, 'pagination_loop' AS issue_type FROM st WHERE EXISTS (SELECT 1 FROM walk w WHERE w.crawl_id = st.crawl_id AND w.url = st.url AND w.hops = 500)""",
    cases=True,
)
_PAIRS = """done AS (SELECT project_id, id, row_number() OVER (PARTITION BY project_id ORDER BY completed_at DESC NULLS LAST, id DESC) AS r FROM (SELECT DISTINCT project_id, id, completed_at FROM crawls WHERE status = 'completed')),
pairs AS (SELECT project_id, max(id) FILTER (r = 2) AS a, max(id) FILTER (r = 1) AS b FROM done WHERE r <= 2 GROUP BY 1)"""
_VALUES = ", ".join(f"x.{c} AS a_{c}, y.{c} AS b_{c}" for c in ["status_code", "title", "word_count", "is_indexable", "response_time_ms"])
_DIFFER = " OR ".join(f"x.{c} IS DISTINCT FROM y.{c}" for c in ["status_code", "title", "word_count", "is_indexable"])
_COMPARE = f"""WITH {_PAIRS}, x AS (SELECT p.b, u.* FROM pairs p JOIN crawled_urls u ON u.crawl_id = p.a), y AS (SELECT p.b, u.* FROM pairs p JOIN crawled_urls u ON u.crawl_id = p.b WHERE p.a IS NOT NULL),
c AS (SELECT coalesce(x.b, y.b) AS b, coalesce(x.url, y.url) AS url, CASE WHEN x.url IS NULL THEN 'added' WHEN y.url IS NULL THEN 'removed' WHEN {_DIFFER} THEN 'changed' ELSE 'unchanged' END AS change_type, {_VALUES}
FROM x FULL JOIN y ON x.b = y.b AND x.url = y.url)"""
add("crawl_compare", lambda spark, d: compare.compare(pages(spark, d), compare.newest_pairs(table(spark, d, "crawls"))), _COMPARE + " SELECT * FROM c")
add("crawl_compare_counts", lambda spark, d: compare.compare(pages(spark, d), compare.newest_pairs(table(spark, d, "crawls"))).groupBy("b", "change_type").agg(F.count("*").alias("n")), _COMPARE + " SELECT b, change_type, count(*) AS n FROM c GROUP BY 1, 2")
_FACTS = ", ".join(f"x.{c} AS b_{c}, y.{c} AS a_{c}" for c in ("pages", "errors", "ms", "issues", "critical", "score"))
_RULES = " UNION ALL ".join(
    f"SELECT project_id, crawl_id, '{kind}' AS alert_type, {severity} AS severity, round(CAST({before} AS DOUBLE), 4) AS before, round(CAST({after} AS DOUBLE), 4) AS after FROM k WHERE {test}"
    for kind, test, severity, before, after in [
        ("health_regression", "b_score - a_score <= -10", "CASE WHEN b_score - a_score <= -20 THEN 'critical' ELSE 'warning' END", "a_score", "b_score"),
        ("health_improvement", "b_score - a_score >= 10", "'info'", "a_score", "b_score"),
        ("low_health", "b_score < 50", "'critical'", "NULL", "b_score"),
        ("error_spike", "b_errors / b_pages > a_errors / a_pages + 0.05", "'warning'", "a_errors / a_pages", "b_errors / b_pages"),
        ("high_errors", "b_errors > 10", "CASE WHEN b_errors >= 50 THEN 'critical' ELSE 'warning' END", "NULL", "b_errors"),
        ("critical_issues", "b_critical > 0", "'critical'", "NULL", "b_critical"),
        ("issues_increased", "b_issues - a_issues > 10", "'warning'", "a_issues", "b_issues"),
        ("slow_site", "b_ms > 3000", "'warning'", "NULL", "b_ms"),
    ]
)
add(
    "alerts",
    lambda spark, d: (lambda i: compare.alerts(table(spark, d, "crawls"), pages(spark, d), i, reports.health(pages(spark, d), i)))(staged(issues(spark, d), "issues")),
    _HEALTH.replace("WITH doc0", f"WITH {_PAIRS}, doc0", 1).replace("SELECT crawl_id, score, CASE", "h AS (SELECT crawl_id, score, CASE", 1).replace("round(speed_part, 3) AS speed_part FROM t", "round(speed_part, 3) AS speed_part FROM t)", 1).replace(
        "AS score FROM r)\n", "AS score FROM r),\n", 1
    )
    + f""", ip AS (SELECT crawl_id, count(*) AS issues, count(*) FILTER (severity = 'critical') AS critical FROM issues GROUP BY 1), up AS (SELECT crawl_id, count(*) AS pages, count(*) FILTER (status_code >= 400) AS errors, avg(response_time_ms) FILTER (status_code BETWEEN 200 AND 299) AS ms FROM crawled_urls GROUP BY 1),
facts AS (SELECT up.*, coalesce(ip.issues, 0) AS issues, coalesce(ip.critical, 0) AS critical, score FROM up LEFT JOIN ip USING (crawl_id) LEFT JOIN h USING (crawl_id)),
k AS (SELECT project_id, pairs.b AS crawl_id, {_FACTS} FROM pairs JOIN facts x ON x.crawl_id = pairs.b LEFT JOIN facts y ON y.crawl_id = pairs.a) {_RULES}""",
)
_BYTES = "list_transform(range(1, length(hex(encode(g))), 2), lambda i: CAST(16 * (instr('0123456789ABCDEF', substr(hex(encode(g)), i, 1)) - 1) + instr('0123456789ABCDEF', substr(hex(encode(g)), i + 1, 1)) - 1 AS UHUGEINT))"
add(
    "near_duplicates",
    lambda spark, d: duplicates.near_duplicates(table(spark, d, "documents"), "doc_id", "text"),
    f"""WITH RECURSIVE t AS (SELECT doc_id, trim(regexp_replace(lower(text), '[\\s\\x1C-\\x1F\\x{{85}}\\p{{Z}}]+', ' ', 'g'), ' ') AS s FROM documents WHERE text IS NOT NULL), w AS (SELECT * FROM t WHERE len(list_filter(string_split(s, ' '), lambda x: x <> '')) >= 50),
c AS (SELECT doc_id, g, count(*) AS n FROM (SELECT doc_id, substr(s, k, 3) AS g FROM (SELECT doc_id, s, unnest(range(1, length(s) - 1)) AS k FROM w)) GROUP BY 1, 2),
h AS (SELECT g, list_reduce(list_prepend(CAST(14695981039346656037 AS UHUGEINT), {_BYTES}), lambda a, b: (xor(a, b) * 1099511628211) % 18446744073709551616) AS h FROM (SELECT DISTINCT g FROM c)),
v AS (SELECT doc_id, b, sum(CASE WHEN CAST(h // (CAST(2 AS UHUGEINT) ** b)::UHUGEINT % 2 AS INTEGER) = 1 THEN n ELSE -n END) AS v FROM c JOIN h USING (g), (SELECT unnest(range(64)) AS b) GROUP BY 1, 2),
f AS MATERIALIZED (SELECT doc_id, CAST(CAST(sum(CASE WHEN v > 0 THEN (CAST(1 AS HUGEINT) << CAST(b AS INTEGER)) ELSE 0 END) AS UBIGINT) AS HUGEINT) AS f FROM v GROUP BY 1 HAVING f <> 0), d AS MATERIALIZED (SELECT DISTINCT f FROM f),
p AS MATERIALIZED (SELECT x.f AS a, y.f AS b FROM d x, d y WHERE x.f <> y.f AND bit_count(xor(x.f, y.f)) <= 3),
l(f, root) USING KEY (f) AS (SELECT f, f FROM d UNION SELECT p.b, min(l.root) FROM l JOIN p ON p.a = l.f JOIN recurring.l r ON r.f = p.b WHERE l.root < r.root GROUP BY p.b),
k AS (SELECT f.doc_id, l.root FROM f JOIN l USING (f))
SELECT doc_id AS id, min(doc_id) OVER (PARTITION BY root) AS class_id, count(*) OVER (PARTITION BY root) AS class_size FROM k QUALIFY class_size > 1""",
)
add("list_html_errors", lambda spark, d: filters.list_pages(pages(spark, d), status_min=400, status_max=499, content_type="HTML").select("id", "url", "status_code"), "SELECT id, url, status_code FROM crawled_urls WHERE status_code BETWEEN 400 AND 499 AND contains(lower(content_type), 'html')")
add(
    "list_other_types",
    lambda spark, d: filters.preset(pages(spark, d), "other").select("id", "content_type"),
    "SELECT id, content_type FROM crawled_urls WHERE content_type IS NOT NULL AND NOT (contains(lower(content_type), 'html') OR contains(lower(content_type), 'javascript') OR contains(lower(content_type), 'css') OR contains(lower(content_type), 'image'))",
)
add("list_search", lambda spark, d: filters.list_pages(pages(spark, d), search=" Guides/ ", is_indexable=True).select("id", "url"), "SELECT id, url FROM crawled_urls WHERE is_indexable AND contains(lower(url), 'guides/')")
add("list_keyset", lambda spark, d: filters.keyset_page(pages(spark, d).select("id", "url").distinct(), "id", "80000000-0000-0000-0000-000000000000", 50), "SELECT DISTINCT id, url FROM crawled_urls WHERE id > '80000000-0000-0000-0000-000000000000' ORDER BY id LIMIT 51")
add("list_by_issue", lambda spark, d: filters.preset(pages(spark, d), "duplicate_title", issues(spark, d)).select("id", "url"), ISSUES + " SELECT id, url FROM crawled_urls WHERE id IN (SELECT url_id FROM issues WHERE issue_type = 'duplicate_title')")
add(
    "list_newest",
    lambda spark, d: filters.newest_first(table(spark, d, "crawls").dropDuplicates(["id"]).select("id", "status", "created_at")).select("id", "status"),
    "SELECT id, status FROM (SELECT DISTINCT id, status, created_at FROM crawls) ORDER BY created_at DESC, id LIMIT 51",
)
add("list_structured_data", lambda spark, d: filters.with_structured_data(pages(spark, d)).select("id"), f"WITH {DOC} SELECT id FROM s WHERE len(json_extract(doc, '$.json_ld[*]')) > 0")
add("list_custom_extractions", lambda spark, d: filters.with_custom_extractions(pages(spark, d)).select("id"), f"WITH {DOC} SELECT id FROM s WHERE len(json_keys(doc, '$.custom_extractions')) > 0")
for _kind, _test in (("contains", "n <> '' OR p <> ''"), ("first_page", "n <> '' AND p = ''"), ("paginated_2_plus", "p <> ''")):
    add(
        f"pagination_{_kind}",
        lambda spark, d, kind=_kind: filters.pagination_pages(with_pages(pages(spark, d)), kind).select("id"),
        f"WITH {DOC}, f AS (SELECT id, coalesce(doc->>'$.pagination.rel_next', '') AS n, coalesce(doc->>'$.pagination.rel_prev', '') AS p FROM s) SELECT id FROM f WHERE {_test}",
        cases=True,
    )
