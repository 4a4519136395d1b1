"""A small crawl with the cases that stored crawls seldom hold; some queries read it beside the tables."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_AT = "https://cases.example"


def _page(name: str, status: int = 200, canonical: str | None = None, reason: str | None = None, depth: int = 1, **pagination) -> tuple:
    seo = json.dumps({"pagination": {k: f"{_AT}/{v}" for k, v in pagination.items()}} if pagination else {})
    return ("cases", f"case-{name}", f"{_AT}/{name}", status, "text/html", canonical and f"{_AT}/{canonical}", reason is None, reason, depth, seo)


#: A canonical address that can't be indexed, next pages that run in a circle, point back wrongly or don't answer.
PAGES = [
    _page("start", depth=0),
    _page("copy", canonical="hidden"),
    _page("hidden", reason="noindex"),
    _page("p1", rel_next="p2"),
    _page("p2", rel_next="p3", rel_prev="p1"),
    _page("p3", rel_next="p2", rel_prev="p1"),
    _page("q1", rel_next="gone"),
    _page("q2", rel_prev="q1"),
    _page("gone", status=404, reason="client_error"),
]
LINKS = [(-1, "cases", "case-start", f"{_AT}/p1", "one", "internal"), (-2, "cases", "case-start", f"{_AT}/never", None, "internal"), (-3, "cases", "case-q1", f"{_AT}/gone", "", "internal")]
_PAGE = "crawl_id string, id string, url string, status_code int, content_type string, canonical_url string, is_indexable boolean, indexability_reason string, crawl_depth int, seo_data string"
_LINK = "id long, crawl_id string, source_url_id string, target_url string, anchor_text string, link_type string"


def with_pages(pages: DataFrame) -> DataFrame:
    cases = pages.sparkSession.createDataFrame(PAGES, _PAGE).withColumn("url_hash", F.unhex(F.md5("url")))
    return pages.unionByName(cases, allowMissingColumns=True)


def with_links(links: DataFrame) -> DataFrame:
    cases = links.sparkSession.createDataFrame(LINKS, _LINK).withColumn("target_url_hash", F.unhex(F.md5("target_url")))
    return links.unionByName(cases, allowMissingColumns=True)


def _values(rows: list[tuple], schema: str) -> str:
    shown = lambda v: "NULL" if v is None else str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"
    names = ", ".join(c.split()[0] for c in schema.split(", "))
    return f"(VALUES {', '.join('(' + ', '.join(map(shown, r)) + ')' for r in rows)}) AS t({names})"


def with_cases(sql: str) -> str:
    """A statement of ``audit.once`` over the tables and the cases."""
    for table, key, rows, schema in (("pages_once", "url", PAGES, _PAGE), ("links_once", "target_url", LINKS, _LINK)):
        source = {"pages_once": "crawled_urls", "links_once": "page_links"}[table]
        plain = f"{table} AS (SELECT DISTINCT ON (id) * FROM {source})"
        assert plain in sql
        sql = sql.replace(plain, f"{table} AS (SELECT * FROM (SELECT DISTINCT ON (id) * FROM {source}) UNION ALL BY NAME SELECT *, unhex(md5({key})) AS {key}_hash FROM {_values(rows, schema)})")
    return sql
