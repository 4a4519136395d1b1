"""The issue types with severity, category and description."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Issue types by category as (type, severity, description).
ISSUES = {
    "titles": [
        ("missing_title", "critical", "The page has no title"),
        ("duplicate_title", "warning", "Another page has the same title"),
        ("title_too_long", "warning", "The title is longer than 60 characters"),
        ("title_too_short", "warning", "The title is shorter than 30 characters"),
        ("title_pixel_too_wide", "warning", "The title is wider than 580 pixels"),
        ("title_same_as_h1", "info", "Title and first heading are the same"),
        ("multiple_titles", "warning", "The page has several titles"),
    ],
    "meta_descriptions": [
        ("missing_meta_description", "warning", "The page has no description"),
        ("duplicate_meta_description", "warning", "Another page has the same description"),
        ("meta_description_too_long", "info", "The description is longer than 155 characters"),
        ("meta_description_too_short", "info", "The description is shorter than 70 characters"),
        ("multiple_meta_descriptions", "warning", "The page has several descriptions"),
    ],
    "headings": [
        ("missing_h1", "warning", "The page has no main heading"),
        ("duplicate_h1", "warning", "Another page has the same main heading"),
        ("multiple_h1", "warning", "The page has several main headings"),
        ("h1_too_long", "info", "A main heading is longer than 70 characters"),
        ("non_sequential_headings", "info", "A heading level is left out"),
    ],
    "images": [
        ("missing_alt_text", "warning", "An image has no alternative text"),
        ("alt_text_too_long", "info", "An alternative text is longer than 125 characters"),
        ("missing_image_dimensions", "info", "An image has no width or height"),
    ],
    "canonicals": [
        ("missing_canonical", "warning", "The page names no canonical address"),
        ("self_referencing_canonical", "info", "The canonical address is the page's own"),
        ("multiple_canonicals", "critical", "The page names several canonical addresses"),
        ("canonical_mismatch", "warning", "Canonical addresses disagree"),
        ("non_indexable_canonical", "warning", "The canonical address can't be indexed"),
    ],
    "directives": [
        ("has_noindex", "info", "The page asks not to be indexed"),
        ("has_nofollow", "info", "The page asks not to follow its links"),
        ("has_noindex_nofollow", "info", "The page asks not to be indexed nor followed"),
        ("multiple_robots_meta", "warning", "The page has several robots tags"),
        ("has_x_robots_tag", "info", "A robots header is sent"),
    ],
    "url_quality": [
        ("url_non_ascii", "warning", "The address has characters beyond ASCII"),
        ("url_has_underscores", "info", "The path has underscores"),
        ("url_has_uppercase", "info", "The path has capitals"),
        ("url_too_long", "warning", "The address is longer than 115 characters"),
        ("url_has_parameters", "info", "The address has parameters"),
        ("url_has_multiple_slashes", "info", "The path has doubled slashes"),
    ],
    "security": [
        ("http_url", "warning", "The page is served without encryption"),
        ("mixed_content", "warning", "An encrypted page loads plain resources"),
        ("missing_hsts", "info", "No Strict-Transport-Security header"),
        ("missing_csp", "info", "No Content-Security-Policy header"),
        ("missing_x_content_type_options", "info", "No X-Content-Type-Options header"),
        ("missing_x_frame_options", "info", "No X-Frame-Options header"),
    ],
    "links": [
        ("broken_link_4xx", "critical", "A link leads to a client error"),
        ("broken_link_5xx", "warning", "A link leads to a server error"),
    ],
    "indexability": [
        ("non_indexable_noindex", "info", "Not indexable for its directive"),
        ("non_indexable_canonicalized", "info", "Not indexable for its canonical address"),
        ("non_indexable_redirect", "info", "Not indexable for its redirect"),
        ("non_indexable_client_error", "warning", "Not indexable for a client error"),
        ("non_indexable_server_error", "critical", "Not indexable for a server error"),
    ],
    "pagination": [
        ("pagination_url_not_in_anchor", "warning", "A next or previous page is not linked on the page"),
        ("multiple_pagination_urls", "warning", "The page names several next or previous pages"),
        ("non_indexable_paginated", "warning", "A paginated page can't be indexed"),
        ("non_200_pagination_url", "critical", "A next or previous page doesn't answer with 200"),
        ("unlinked_pagination_url", "warning", "A next or previous page is linked nowhere"),
        ("pagination_loop", "warning", "Next pages lead back to themselves"),
        ("pagination_sequence_error", "warning", "Next and previous pages don't point at each other"),
    ],
}


def registry(spark: SparkSession) -> DataFrame:
    """issue_type, severity, category, description: 56 rows."""
    rows = [(kind, severity, category, text) for category, some in ISSUES.items() for kind, severity, text in some]
    return spark.createDataFrame(rows, "issue_type string, severity string, category string, description string")


def registry_sql() -> str:
    quoted = lambda text: "'" + text.replace("'", "''") + "'"
    rows = ", ".join(f"('{kind}', '{severity}', '{category}', {quoted(text)})" for category, some in ISSUES.items() for kind, severity, text in some)
    return f"(VALUES {rows}) AS registry(issue_type, severity, category, description)"
