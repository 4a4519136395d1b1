"""Filtered lists with keyset pages, the named filters of the page views, schedules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagequarry.functions.common import field, seo_document

C = F.col


def content_type_is(kind: str) -> Column:
    """Contains, without regard to case; 'other' is what is known but neither HTML, JavaScript, CSS nor an image."""
    low = F.lower("content_type")
    if kind == "other":
        return C("content_type").isNotNull() & ~(F.contains(low, F.lit("html")) | F.contains(low, F.lit("javascript")) | F.contains(low, F.lit("css")) | F.contains(low, F.lit("image")))
    return F.contains(low, F.lit(kind.lower()))


def list_pages(
    pages: DataFrame,
    status_code: int | None = None,
    status_min: int | None = None,
    status_max: int | None = None,
    content_type: str | None = None,
    is_indexable: bool | None = None,
    search: str | None = None,
    has_issue: str | None = None,
    issues: DataFrame | None = None,
) -> DataFrame:
    """Pages that meet every given condition; each reaches the scan as far as Parquet can use it."""
    p = pages
    if status_code is not None:
        p = p.where(C("status_code") == status_code)
    if status_min is not None:
        p = p.where(C("status_code") >= status_min)
    if status_max is not None:
        p = p.where(C("status_code") <= status_max)
    if is_indexable is not None:
        p = p.where(C("is_indexable") == is_indexable)
    if content_type:
        p = p.where(content_type_is(content_type))
    if search and search.strip():
        p = p.where(F.contains(F.lower("url"), F.lit(search.strip().lower())))
    if has_issue is not None:
        p = p.join(issues.where(C("issue_type") == has_issue).select(C("url_id").alias("id")).distinct(), "id", "left_semi")
    return p


def keyset_page(rows: DataFrame, key: str, cursor=None, limit: int = 50) -> DataFrame:
    """The next ``limit`` rows by key after ``cursor``; with one more row than that there is a further page."""
    kept = rows if cursor is None else rows.where(C(key) > F.lit(cursor))
    return kept.orderBy(key).limit(limit + 1)


def by_key(rows: DataFrame, key: str, value) -> DataFrame:
    return rows.where(C(key) == F.lit(value))


def with_structured_data(pages: DataFrame) -> DataFrame:
    p = pages.withColumn("doc", seo_document())
    return p.where(F.size(field("$.json_ld", "array<variant>")) > 0).drop("doc")


def with_custom_extractions(pages: DataFrame) -> DataFrame:
    p = pages.withColumn("doc", seo_document())
    return p.where(F.cardinality(field("$.custom_extractions", "map<string,string>")) > 0).drop("doc")


def pagination_pages(pages: DataFrame, kind: str = "contains", issues: DataFrame | None = None) -> DataFrame:
    """Pages with a next or previous page; 'first_page', 'paginated_2_plus', or the name of a pagination issue they have."""
    p = pages.withColumn("doc", seo_document())
    nxt, prev = F.coalesce(field("$.pagination.rel_next", "string"), F.lit("")) != "", F.coalesce(field("$.pagination.rel_prev", "string"), F.lit("")) != ""
    if kind == "contains":
        return p.where(nxt | prev).drop("doc")
    if kind == "first_page":
        return p.where(nxt & ~prev).drop("doc")
    if kind == "paginated_2_plus":
        return p.where(prev).drop("doc")
    return list_pages(p.where(nxt | prev).drop("doc"), has_issue=kind, issues=issues)


def due_schedules(schedules: DataFrame, now) -> DataFrame:
    """Active schedules whose next run has come, the longest due first."""
    return schedules.where(C("is_active") & C("next_run_at").isNotNull() & (C("next_run_at") <= F.lit(now))).orderBy("next_run_at", "id")


def newest_first(rows: DataFrame, at: str = "created_at", key: str = "id", cursor: tuple | None = None, limit: int = 50) -> DataFrame:
    """A page of rows by time, newest first, then by key; the cursor is the last row's pair, so pages neither skip nor repeat."""
    kept = rows if cursor is None else rows.where((C(at) < F.lit(cursor[0])) | ((C(at) == F.lit(cursor[0])) & (C(key) > F.lit(cursor[1]))))
    return kept.orderBy(C(at).desc_nulls_last(), key).limit(limit + 1)


def list_alerts(alerts: DataFrame, project_id: str | None = None, unread_only: bool = False) -> DataFrame:
    a = alerts if project_id is None else alerts.where(C("project_id") == project_id)
    return a.where(~C("is_read")) if unread_only else a


def unread_counts(alerts: DataFrame) -> DataFrame:
    return alerts.groupBy("project_id").agg(F.count_if(~C("is_read")).alias("unread"))


def mark_read(alerts: DataFrame, which: Column) -> DataFrame:
    """The alerts with those that meet ``which`` read; a null test leaves one as it is."""
    return alerts.withColumn("is_read", C("is_read") | F.coalesce(which, F.lit(False)))


def rule_results(results: DataFrame, rules: DataFrame, pages: DataFrame, rule_key: str) -> DataFrame:
    """Results of custom extractors or searches with their rule's name and their page's address."""
    named = results.join(rules.select(C("id").alias(rule_key), "name"), rule_key)
    return named.join(pages.select(C("id").alias("url_id"), "url").dropDuplicates(["url_id"]), "url_id")


#: Named conditions of the page views.
PRESETS: dict[str, dict] = {
    "all": {}, "html": {"content_type": "html"}, "javascript": {"content_type": "javascript"}, "css": {"content_type": "css"}, "images": {"content_type": "image"}, "pdf": {"content_type": "pdf"}, "other": {"content_type": "other"},
    "success": {"status_min": 200, "status_max": 299}, "redirects": {"status_min": 300, "status_max": 399}, "client_errors": {"status_min": 400, "status_max": 499}, "server_errors": {"status_min": 500, "status_max": 599},
    "indexable": {"is_indexable": True}, "non_indexable": {"is_indexable": False},
    **{t: {"has_issue": t} for t in (
        "missing_title", "duplicate_title", "title_too_long", "title_too_short", "title_same_as_h1", "missing_meta_description", "duplicate_meta_description", "meta_description_too_long", "meta_description_too_short",
        "missing_h1", "duplicate_h1", "multiple_h1", "missing_alt_text", "alt_text_too_long", "missing_canonical", "self_referencing_canonical", "has_noindex", "has_nofollow", "url_non_ascii", "url_has_underscores",
        "url_has_uppercase", "url_too_long", "url_has_parameters", "http_url", "mixed_content", "missing_hsts", "broken_link_4xx", "broken_link_5xx",
    )},
}


def preset(pages: DataFrame, name: str, issues: DataFrame | None = None) -> DataFrame:
    return list_pages(pages, **PRESETS[name], issues=issues)
