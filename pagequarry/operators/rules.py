"""Rules on single pages and across pages: one row per issue found."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagequarry.functions import urls
from pagequarry.functions.common import field, is_html, ok, seo_document
from pagequarry.functions.text import pixel_width
from pagequarry.operators.registry import registry
from pagequarry.session import staged


def with_document(pages: DataFrame) -> DataFrame:
    """Adds the parsed seo_data as ``doc``; the parsed fields the rules read come with it."""
    d = pages.withColumn("doc", seo_document())
    return (
        d.withColumn("title_count", field("$.title_count", "int"))
        .withColumn("meta_desc_count", field("$.meta_desc_count", "int"))
        .withColumn("canonical_count", field("$.canonical_count", "int"))
        .withColumn("robots_meta_tag_count", field("$.robots_meta_tag_count", "int"))
        .withColumn("x_robots_tag", field("$.x_robots_tag", "string"))
        .withColumn("levels", F.transform(field("$.heading_sequence", "array<variant>"), lambda x: F.try_variant_get(x, "$", "string")))
        .withColumn("images", field("$.images", "array<variant>"))
        .withColumn("mixed", field("$.mixed_content_urls", "array<variant>"))
        .withColumn("rel_next", field("$.pagination.rel_next", "string"))
        .withColumn("rel_prev", field("$.pagination.rel_prev", "string"))
        .withColumn("next_count", field("$.pagination.next_count", "int"))
        .withColumn("prev_count", field("$.pagination.prev_count", "int"))
    )


def image_field(image: Column, name: str) -> Column:
    return F.try_variant_get(image, f"$.{name}", "string")


def _filled(c: Column) -> Column:
    return c.isNotNull() & (c != "")


#: The security headers that pages are checked for, as seo_data names them.
HEADERS = {"missing_hsts": "strict_transport_security", "missing_csp": "content_security_policy", "missing_x_content_type_options": "x_content_type_options", "missing_x_frame_options": "x_frame_options"}
#: Fixed value: widest title in pixels.
TITLE_PIXELS = 580


def page_facts(pages: DataFrame) -> DataFrame:
    """What the rules read of each page, its JSON parsed once; small enough to be stored."""
    p = with_document(pages)
    images = F.transform("images", lambda i: F.struct(*[image_field(i, n).alias(n) for n in ("src", "alt", "width", "height")]))
    return p.select(
        "crawl_id", "id", "url", "url_hash", "status_code", "content_type", "title", "meta_description", "h1", "canonical_url", "robots_meta", "is_indexable", "indexability_reason", "word_count",
        "title_count", "meta_desc_count", "canonical_count", "robots_meta_tag_count", "x_robots_tag", "levels", "rel_next", "rel_prev", "next_count", "prev_count",
        images.alias("images"), F.transform("mixed", lambda x: F.try_variant_get(x, "$", "string")).alias("mixed"),
        *[field(f"$.security_headers.{name}", "string").alias(name) for name in HEADERS.values()],
    )


def _facts(pages: DataFrame) -> DataFrame:
    return pages if "levels" in pages.columns else page_facts(pages)


def details(**values) -> Column:
    """A map of texts; what is null becomes ''."""
    return F.create_map(*[x for k, v in values.items() for x in (F.lit(k), F.coalesce(v.cast("string"), F.lit("")))])


def details_text(c: Column | str = "details") -> Column:
    """The entries of a map by key, as 'key=value; key=value'; '' for none."""
    entries = F.transform(F.array_sort(F.map_entries(c)), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return F.coalesce(F.array_join(entries, "; "), F.lit(""))


def _no_details() -> Column:
    return F.lit(None).cast("map<string,string>")


def _level(tag: Column) -> Column:
    """The number of a heading tag, null for anything else."""
    return F.regexp_replace(tag, "^[hH]+", "").try_cast("int")


def heading_jumps(levels: Column) -> Column:
    """Pairs of neighbours of which the second is more than one level below the first; what is no heading tag makes no pair."""
    pairs = F.arrays_zip(F.slice(levels, 1, F.greatest(F.size(levels) - 1, F.lit(0))).alias("a"), F.slice(levels, 2, F.greatest(F.size(levels) - 1, F.lit(0))).alias("b"))
    return F.filter(pairs, lambda x: F.coalesce(_level(x["b"]) - _level(x["a"]) > 1, F.lit(False)))


def jump_text(pair: Column) -> Column:
    return F.concat(pair["a"], F.lit(" -> "), pair["b"])


def page_issues(pages: DataFrame) -> DataFrame:
    """crawl_id, url_id, issue_type, details: issues of each page by itself; an image rule gives a row for each image.

    Content rules need a title or words; URL and security rules look at every
    row; pagination rules need an HTML page with a next or previous page.
    details is a map that says what was found, null where the type says it all.
    """
    p = _facts(pages)
    c = F.col
    title, description, canonical, url = c("title"), c("meta_description"), c("canonical_url"), c("url")
    no_title, no_description = ~_filled(F.coalesce(title, F.lit(""))), ~_filled(F.coalesce(description, F.lit("")))
    h1 = F.coalesce(c("h1"), F.array().cast("array<string>"))
    robots = F.coalesce(c("robots_meta"), F.array().cast("array<string>"))
    noindex = F.array_contains(robots, "noindex") | F.array_contains(robots, "none")
    nofollow = F.array_contains(robots, "nofollow") | F.array_contains(robots, "none")
    checked = ~(~c("is_indexable") & F.coalesce(c("indexability_reason").isin("redirect", "client_error", "server_error", "non_html"), F.lit(False)))
    path, paged = urls.path(url), is_html() & (_filled(c("rel_next")) | _filled(c("rel_prev")))
    slash = lambda x: F.lower(F.regexp_replace(x, "/+$", ""))
    long_h1 = F.get(F.filter(h1, lambda x: F.length(x) > 70), F.lit(0))
    jumps, query, pixels = heading_jumps(c("levels")), urls.query(url), pixel_width(title)
    directives = details(directives=F.array_join(robots, ", "))

    content = [
        ("missing_title", no_title, None),
        ("multiple_titles", ~no_title & (c("title_count") > 1), details(count=c("title_count"))),
        ("title_too_long", ~no_title & (F.length(title) > 60), details(length=F.length(title), title=F.substring(title, 1, 100))),
        ("title_too_short", ~no_title & (F.length(title) < 30), details(length=F.length(title), title=title)),
        ("title_pixel_too_wide", ~no_title & (pixels > TITLE_PIXELS), details(limit=F.lit(TITLE_PIXELS), pixel_width=pixels.cast("int"))),
        ("title_same_as_h1", ~no_title & (F.size(h1) > 0) & (F.lower(F.trim(title)) == F.lower(F.trim(F.get(h1, F.lit(0))))), None),
        ("missing_meta_description", no_description, None),
        ("multiple_meta_descriptions", ~no_description & (c("meta_desc_count") > 1), details(count=c("meta_desc_count"))),
        ("meta_description_too_long", ~no_description & (F.length(description) > 155), details(length=F.length(description))),
        ("meta_description_too_short", ~no_description & (F.length(description) < 70), details(length=F.length(description))),
        ("missing_h1", F.size(h1) == 0, None),
        ("multiple_h1", F.size(h1) > 1, details(count=F.size(h1), h1s=F.array_join(F.transform(h1, lambda x: F.substring(x, 1, 100)), " | "))),
        ("h1_too_long", long_h1.isNotNull(), details(h1=F.substring(long_h1, 1, 100), length=F.length(long_h1))),
        ("non_sequential_headings", F.size(jumps) > 0, details(sequence=F.array_join(F.slice("levels", 1, 20), ", "), skip_at=jump_text(F.get(jumps, F.lit(0))))),
        ("missing_canonical", checked & ~_filled(F.coalesce(canonical, F.lit(""))), None),
        ("multiple_canonicals", checked & _filled(canonical) & (c("canonical_count") > 1), details(count=c("canonical_count"))),
        ("self_referencing_canonical", checked & _filled(canonical) & (slash(canonical) == slash(url)), None),
        ("has_noindex_nofollow", noindex & nofollow, directives),
        ("has_noindex", noindex & ~nofollow, directives),
        ("has_nofollow", nofollow & ~noindex, directives),
        ("multiple_robots_meta", c("robots_meta_tag_count") > 1, details(count=c("robots_meta_tag_count"))),
        ("has_x_robots_tag", _filled(c("x_robots_tag")), details(value=c("x_robots_tag"))),
    ]
    mixed = F.coalesce(c("mixed"), F.array().cast("array<string>"))
    pagination = details(next_count=F.coalesce("next_count", F.lit(0)), prev_count=F.coalesce("prev_count", F.lit(0)))
    always = [
        ("url_too_long", F.length(url) > 115, details(length=F.length(url))),
        ("url_non_ascii", url.rlike("[^\\x00-\\x7F]"), None),
        ("url_has_underscores", F.contains(path, F.lit("_")), None),
        ("url_has_uppercase", path != F.lower(path), None),
        ("url_has_parameters", query != "", details(query=F.substring(query, 1, 100))),
        ("url_has_multiple_slashes", F.contains(path, F.lit("//")), None),
        ("http_url", url.startswith("http://"), None),
        ("mixed_content", F.size(mixed) > 0, details(count=F.size(mixed), urls=F.array_join(F.slice(mixed, 1, 5), ", "))),
        *[(kind, F.coalesce(c(name), F.lit("")) == "", None) for kind, name in HEADERS.items()],
        ("multiple_pagination_urls", paged & ((c("next_count") > 1) | (c("prev_count") > 1)), pagination),
        ("non_indexable_paginated", paged & ~c("is_indexable"), details(reason=c("indexability_reason"))),
    ]
    unset = lambda x: F.coalesce(x, F.lit("")) == ""
    src = lambda x: F.substring(F.coalesce(x["src"], F.lit("")), 1, 200)
    per_image = [
        ("missing_alt_text", lambda x: unset(F.trim(x["alt"])), lambda x: details(src=src(x))),
        ("alt_text_too_long", lambda x: F.length(x["alt"]) > 125, lambda x: details(alt_length=F.length(x["alt"]), src=src(x))),
        ("missing_image_dimensions", lambda x: unset(x["width"]) | unset(x["height"]), lambda x: details(src=src(x))),
    ]
    gate = _filled(title) | (c("word_count") > 0)
    images = F.coalesce(F.when(gate, c("images")), F.array().cast("array<struct<src:string,alt:string,width:string,height:string>>"))
    issue = lambda kind, more: F.struct(F.lit(kind).alias("issue_type"), (_no_details() if more is None else more).alias("details"))
    once = F.array_compact(F.array(*[F.when(gate & test, issue(kind, more)) for kind, test, more in content], *[F.when(test, issue(kind, more)) for kind, test, more in always]))
    each = lambda kind, more: lambda x: issue(kind, more(x))
    many = [F.transform(F.filter(images, test), each(kind, more)) for kind, test, more in per_image]
    return p.select("crawl_id", c("id").alias("url_id"), F.explode(F.concat(once, *many)).alias("i")).select("crawl_id", "url_id", "i.issue_type", "i.details")


def indexability_issues(pages: DataFrame) -> DataFrame:
    """The five types a page's own reason gives: non_indexable_noindex, _canonicalized, _redirect, _client_error, _server_error."""
    reasons = ["noindex", "canonicalized", "redirect", "client_error", "server_error"]
    return pages.where(~F.col("is_indexable") & F.col("indexability_reason").isin(reasons)).select("crawl_id", F.col("id").alias("url_id"), F.concat(F.lit("non_indexable_"), "indexability_reason").alias("issue_type"))


def duplicate_values(pages: DataFrame) -> DataFrame:
    """crawl_id, url_id, issue_type, copies: HTML pages of one crawl with equal title, description or first heading.

    Values that occur once are dropped after a partial count; what is left is
    joined back, so that no window has to hold a value many pages share.
    """
    values = pages.where(is_html()).select(
        "crawl_id",
        F.col("id").alias("url_id"),
        F.explode(
            F.array(
                F.struct(F.lit("duplicate_title").alias("issue_type"), F.col("title").alias("value")),
                F.struct(F.lit("duplicate_meta_description").alias("issue_type"), F.col("meta_description").alias("value")),
                F.struct(F.lit("duplicate_h1").alias("issue_type"), F.get("h1", F.lit(0)).alias("value")),
            )
        ).alias("x"),
    ).select("crawl_id", "url_id", "x.issue_type", "x.value").where(_filled(F.col("value")))
    repeated = values.groupBy("crawl_id", "issue_type", "value").agg(F.count("*").alias("copies")).where("copies > 1")
    return values.join(repeated, ["crawl_id", "issue_type", "value"]).select("crawl_id", "url_id", "issue_type", "copies")


def broken_links(pages: DataFrame, links: DataFrame) -> DataFrame:
    """crawl_id, url_id (of the linking page), target_url, status_code, anchor_text, issue_type: one row per internal link to a page that answered 400 or more."""
    bad = pages.where(F.col("status_code") >= 400).select("crawl_id", F.col("url_hash").alias("target_url_hash"), "status_code")
    return (
        links.where(F.col("link_type") == "internal").join(bad, ["crawl_id", "target_url_hash"])
        .select("crawl_id", F.col("source_url_id").alias("url_id"), "target_url", "status_code", "anchor_text", F.when(F.col("status_code") >= 500, "broken_link_5xx").otherwise("broken_link_4xx").alias("issue_type"))
    )


def canonical_targets(pages: DataFrame) -> DataFrame:
    """crawl_id, url_id, canonical_url, reason, issue_type: HTML pages whose canonical page, another one, can't be indexed."""
    target = pages.where(~F.col("is_indexable")).select("crawl_id", F.col("url").alias("canonical_url"), F.col("indexability_reason").alias("reason"))
    own = pages.where(is_html() & F.col("canonical_url").isNotNull() & (F.col("canonical_url") != F.col("url"))).select("crawl_id", F.col("id").alias("url_id"), "canonical_url")
    return own.join(target, ["crawl_id", "canonical_url"]).withColumn("issue_type", F.lit("non_indexable_canonical"))


def pagination_refs(pages: DataFrame) -> DataFrame:
    """crawl_id, url_id, url, rel ('next' or 'prev'), target: both references in one pass, so that each check is one join."""
    p = _facts(pages).where(is_html())
    refs = F.array(F.struct(F.lit("next").alias("rel"), F.col("rel_next").alias("target")), F.struct(F.lit("prev").alias("rel"), F.col("rel_prev").alias("target")))
    return p.select("crawl_id", F.col("id").alias("url_id"), "url", F.explode(refs).alias("r")).select("crawl_id", "url_id", "url", "r.rel", "r.target").where(_filled(F.col("target")))


def pagination_not_200(pages: DataFrame, refs: DataFrame | None = None) -> DataFrame:
    answered = pages.where(F.col("status_code") != 200).select("crawl_id", F.col("url").alias("target"), "status_code")
    return _refs(pages, refs).join(answered, ["crawl_id", "target"]).select("crawl_id", "url_id", "rel", "target", "status_code", F.lit("non_200_pagination_url").alias("issue_type"))


def pagination_unlinked(pages: DataFrame, links: DataFrame, refs: DataFrame | None = None) -> DataFrame:
    linked = links.select("crawl_id", F.col("target_url").alias("target")).distinct()
    return _refs(pages, refs).join(linked, ["crawl_id", "target"], "left_anti").select("crawl_id", "url_id", "rel", "target", F.lit("unlinked_pagination_url").alias("issue_type"))


def pagination_not_in_anchor(pages: DataFrame, links: DataFrame, refs: DataFrame | None = None) -> DataFrame:
    """References that the page itself doesn't link."""
    own = links.select(F.col("source_url_id").alias("url_id"), F.col("target_url").alias("target")).distinct()
    return _refs(pages, refs).join(own, ["url_id", "target"], "left_anti").select("crawl_id", "url_id", "rel", "target", F.lit("pagination_url_not_in_anchor").alias("issue_type"))


def pagination_sequence(pages: DataFrame, refs: DataFrame | None = None) -> DataFrame:
    """References whose page has no reference back, or one to another page; back is '(none)' where there is none."""
    refs = _refs(pages, refs)
    page = pages.where(is_html()).select("crawl_id", F.col("url").alias("target"), F.col("id").alias("back_id"))
    opposite = F.when(F.col("rel") == "next", "prev").otherwise("next")
    back = refs.select(F.col("url_id").alias("back_id"), opposite.alias("rel"), F.col("target").alias("back")).distinct()
    found = refs.join(page, ["crawl_id", "target"]).join(back, ["back_id", "rel"], "left")
    return found.where(~F.col("back").eqNullSafe(F.col("url"))).select("crawl_id", "url_id", "rel", "target", F.coalesce("back", F.lit("(none)")).alias("back"), F.lit("pagination_sequence_error").alias("issue_type"))


def _refs(pages: DataFrame, refs: DataFrame | None) -> DataFrame:
    return pagination_refs(pages) if refs is None else refs


def all_issues(pages: DataFrame, links: DataFrame, extended: bool = False) -> DataFrame:
    """Every issue with its severity, category and details: crawl_id, url_id, issue_type, severity, category, details.

    The pages' JSON is parsed once, into a stored table that all rules read.
    """
    facts = staged(page_facts(pages), "page-facts")
    refs = pagination_refs(facts)
    cut_to = lambda name: F.substring(name, 1, 200)
    attribute = F.concat(F.lit("rel_"), "rel")
    parts = [
        (duplicate_values(facts), details(duplicate_count=F.col("copies"))),
        (broken_links(facts, links), details(anchor_text=F.substring("anchor_text", 1, 100), status_code=F.col("status_code"), target_url=cut_to("target_url"))),
        (canonical_targets(facts), details(canonical_url=cut_to("canonical_url"), reason=F.lit("target_non_indexable"))),
        (pagination_not_200(facts, refs), details(attribute=attribute, pagination_url=cut_to("target"), status_code=F.col("status_code"))),
        (pagination_unlinked(facts, links, refs), details(attribute=attribute, pagination_url=cut_to("target"))),
        (pagination_not_in_anchor(facts, links, refs), details(attribute=attribute, pagination_url=cut_to("target"))),
        (pagination_sequence(facts, refs), details(actual_back_ref=cut_to("back"), direction=F.col("rel"), expected_target=cut_to("target"))),
    ]
    if extended:
        parts.append((indexability_issues(facts), _no_details()))
    issues = page_issues(facts)
    for one, more in parts:
        issues = issues.unionByName(one.select("crawl_id", "url_id", "issue_type", more.alias("details")))
    known = registry(pages.sparkSession).drop("description")
    return issues.join(F.broadcast(known), "issue_type").select("crawl_id", "url_id", "issue_type", "severity", "category", "details")


def issue_summary(issues: DataFrame) -> DataFrame:
    """crawl_id, kind ('total', 'severity', 'category'), name, n: one pass with grouping sets."""
    g = issues.groupingSets([["crawl_id"], ["crawl_id", "severity"], ["crawl_id", "category"]], "crawl_id", "severity", "category").agg(F.count("*").alias("n"))
    kind = F.when(F.col("severity").isNotNull(), "severity").when(F.col("category").isNotNull(), "category").otherwise("total")
    return g.select("crawl_id", kind.alias("kind"), F.coalesce("severity", "category", F.lit("all")).alias("name"), "n")


def issue_list(issues: DataFrame, pages: DataFrame, severity: str | None = None, category: str | None = None, issue_type: str | None = None) -> DataFrame:
    """Issues with their page's address and their type's description, filtered."""
    for name, value in (("severity", severity), ("category", category), ("issue_type", issue_type)):
        if value is not None:
            issues = issues.where(F.col(name) == value)
    described = issues.join(F.broadcast(registry(pages.sparkSession).select("issue_type", "description")), "issue_type")
    return described.join(pages.select(F.col("id").alias("url_id"), "url").dropDuplicates(["url_id"]), "url_id")


def heading_skips(pages: DataFrame) -> DataFrame:
    """Per HTML page that answered 2xx and skips a level: crawl_id, id, skips as texts like 'h2 -> h4', each against the last heading that is one of h1 to h9."""
    p = with_document(pages.where(is_html() & ok()))
    jumps = heading_jumps(F.filter("levels", lambda x: x.rlike("^h[1-9]$")))
    return p.select("crawl_id", "id", F.transform(jumps, jump_text).alias("skips")).where(F.size("skips") > 0)
