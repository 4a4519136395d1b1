"""Reports on the pages of crawls: each takes pages of any number of crawls and groups by crawl_id."""

from __future__ import annotations



from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagequarry.functions import urls
from pagequarry.functions.common import buckets, content_class, is_html, ok, resource_class, seo_document, status_class, top_per, whole
from pagequarry.functions.text import STOP_WORDS
from pagequarry.operators.rules import heading_jumps, image_field, with_document

C = F.col
#: Upper bounds, not included, and labels.
RESPONSE_BUCKETS = ([(200, "<200ms"), (500, "200-500ms"), (1000, "500ms-1s"), (3000, "1-3s")], ">3s")
RESPONSE_CLASSES = ([(100, "<100ms"), (200, "100-200ms"), (500, "200-500ms"), (1000, "500ms-1s"), (2000, "1-2s"), (5000, "2-5s")], "5s+")
WORD_BUCKETS = ([(1, "empty"), (100, "thin (<100)"), (300, "short (100-300)"), (1000, "medium (300-1000)"), (3000, "long (1000-3000)")], "very_long (3000+)")
RATIO_BUCKETS = ([(0.1, "<10%"), (0.2, "10-20%"), (0.3, "20-30%"), (0.5, "30-50%")], "50%+")
#: The quick wins in order: what is counted, priority, category, impact, effort.
WINS = [
    ("missing_title", "critical", "titles", "high", "low"),
    ("missing_meta_description", "critical", "meta", "high", "medium"),
    ("missing_h1", "critical", "headings", "high", "low"),
    ("missing_alt_text", "warning", "images", "medium", "low"),
    ("slow_pages", "warning", "performance", "medium", "high"),
    ("long_redirects", "warning", "redirects", "medium", "medium"),
    ("duplicate_title", "warning", "titles", "medium", "medium"),
    ("not_indexable", "info", "indexability", "medium", "low"),
    ("missing_canonical", "info", "canonicals", "medium", "low"),
    ("thin_pages", "info", "content", "medium", "high"),
]


def _share(part: Column, total: Column, digits: int = 1) -> Column:
    return F.round(F.when(total > 0, part * 100.0 / total).otherwise(0.0), digits)


def counts(pages: DataFrame) -> DataFrame:
    return pages.groupBy("crawl_id").agg(F.count("*").alias("pages"), F.count_if(C("status_code") >= 400).alias("errors"))


def depth_distribution(pages: DataFrame) -> DataFrame:
    return pages.groupBy("crawl_id", "crawl_depth").agg(F.count("*").alias("n"))


def exact_duplicates(pages: DataFrame, content: Column, k: int = 50) -> DataFrame:
    """crawl_id, content, n, first_id: contents of several pages that answered 200, the most frequent first."""
    groups = pages.where(C("status_code") == 200).select("crawl_id", "id", content.alias("content")).where(C("content").isNotNull())
    found = groups.groupBy("crawl_id", "content").agg(F.count("*").alias("n"), F.min("id").alias("first_id")).where("n > 1")
    return top_per(found, ["crawl_id"], [C("n").desc(), C("content")], k)


def health(pages: DataFrame, issues: DataFrame) -> DataFrame:
    """crawl_id, score, grade and the four parts: status (.3), indexability against pages that answered 2xx (.2), issues (.3), mean time of all timed pages (.2)."""
    p = pages.groupBy("crawl_id").agg(
        F.count("*").alias("total"), F.count_if(ok()).alias("ok"), F.count_if(C("status_code") >= 400).alias("errors"), F.count_if("is_indexable").alias("indexable"), F.avg("response_time_ms").alias("ms")
    )
    i = issues.groupBy("crawl_id").agg(F.count_if(C("severity") == "critical").alias("critical"), F.count_if(C("severity") == "warning").alias("warnings"))
    both = p.join(i, "crawl_id", "left").na.fill(0, ["critical", "warnings"])
    ms = F.coalesce(F.nullif("ms", F.lit(0.0)), F.lit(500.0))
    speed = F.when(ms < 300, 100.0).when(ms < 1000, 100 - (ms - 300) / 700 * 50).when(ms < 3000, 50 - (ms - 1000) / 2000 * 40).otherwise(10.0)
    total, good = F.greatest(C("total"), F.lit(1)), F.greatest(C("ok"), F.lit(1))
    both = both.select(
        "crawl_id", "total", "errors", "critical", "warnings",
        (C("ok") / total * 100).alias("status_part"),
        (C("indexable") / good * 100).alias("index_part"),
        F.greatest(100 - F.least(C("critical") * 5.0, F.lit(50.0)) - F.least(C("warnings") * 1.0, F.lit(30.0)), F.lit(0.0)).alias("issue_part"),
        speed.alias("speed_part"),
    )
    score = F.round(F.greatest(F.lit(0.0), F.least(F.lit(100.0), C("status_part") * 0.3 + C("index_part") * 0.2 + C("issue_part") * 0.3 + C("speed_part") * 0.2)), 1)
    grade = F.when(C("score") >= 90, "A").when(C("score") >= 75, "B").when(C("score") >= 60, "C").when(C("score") >= 40, "D").otherwise("F")
    parts = ["status_part", "index_part", "issue_part", "speed_part"]
    return both.withColumn("score", score).select("crawl_id", "score", grade.alias("grade"), "total", "errors", "critical", "warnings", *[F.round(x, 3).alias(x) for x in parts])


def performance(pages: DataFrame) -> DataFrame:
    p = pages.where(ok() & C("response_time_ms").isNotNull())
    ms = C("response_time_ms")
    return p.groupBy("crawl_id").agg(
        F.count("*").alias("n"), F.round(F.avg(ms), 3).alias("mean"), F.round(F.percentile(ms, 0.5), 3).alias("p50"), F.round(F.percentile(ms, 0.95), 3).alias("p95"), F.min(ms).alias("least"), F.max(ms).alias("most"),
        F.count_if(ms > 1000).alias("slow"), F.count_if(ms > 3000).alias("very_slow"),
    )


def response_buckets(pages: DataFrame) -> DataFrame:
    p = pages.where(ok() & C("response_time_ms").isNotNull())
    return p.groupBy("crawl_id", buckets(C("response_time_ms"), *RESPONSE_BUCKETS).alias("bucket")).agg(F.count("*").alias("n"), F.min("response_time_ms").alias("least"))


def slowest(pages: DataFrame, k: int = 20) -> DataFrame:
    timed = pages.where(C("response_time_ms").isNotNull()).select("crawl_id", "id", "url", "response_time_ms", "status_code")
    return top_per(timed, ["crawl_id"], [C("response_time_ms").desc(), C("id")], k)


def response_classes(pages: DataFrame) -> DataFrame:
    label = F.coalesce(buckets(C("response_time_ms"), *RESPONSE_CLASSES), F.lit("unknown"))
    ms = C("response_time_ms")
    return pages.where(is_html()).groupBy("crawl_id", label.alias("bucket")).agg(F.count("*").alias("n"), whole(F.avg(ms)).alias("mean"), F.min(ms).alias("least"), F.max(ms).alias("most"))


def slowest_html(pages: DataFrame, k: int = 20) -> DataFrame:
    return slowest(pages.where(is_html()), k)


def overview(pages: DataFrame) -> DataFrame:
    """crawl_id, kind ('status', 'content', 'indexable'), name, n: three counts in one pass."""
    kinds = F.array(
        F.struct(F.lit("status").alias("kind"), status_class().alias("name")),
        F.struct(F.lit("content").alias("kind"), content_class().alias("name")),
        F.struct(F.lit("indexable").alias("kind"), C("is_indexable").cast("string").alias("name")),
    )
    return pages.select("crawl_id", F.explode(kinds).alias("x")).where("x.name is not null").groupBy("crawl_id", "x.kind", "x.name").agg(F.count("*").alias("n"))


def timeline_summary(pages: DataFrame) -> DataFrame:
    s = C("status_code")
    return pages.groupBy("crawl_id").agg(
        F.count("*").alias("total"), F.min("crawled_at").alias("first"), F.max("crawled_at").alias("last"), F.count_if(ok()).alias("ok"), F.count_if(s.between(300, 399)).alias("redirects"),
        F.count_if((s >= 400) | (s == 0)).alias("errors"), F.round(F.avg("response_time_ms"), 3).alias("mean"),
    )


def timeline(pages: DataFrame, status: str | None = None, before=None, k: int = 50) -> DataFrame:
    s = C("status_code")
    kept = {None: F.lit(True), "ok": ok(), "redirects": s.between(300, 399), "errors": (s >= 400) | (s == 0)}[status]
    p = pages.where(kept) if before is None else pages.where(kept & (C("crawled_at") < F.lit(before)))
    return top_per(p.select("crawl_id", "id", "url", "status_code", "crawled_at"), ["crawl_id"], [C("crawled_at").desc(), C("id")], k)


def crawl_speed(pages: DataFrame) -> DataFrame:
    return pages.groupBy("crawl_id", F.date_trunc("second", "crawled_at").alias("second")).agg(F.count("*").alias("n"), F.round(F.avg("response_time_ms"), 3).alias("mean"))


def quick_wins(pages: DataFrame, issues: DataFrame) -> DataFrame:
    """crawl_id, win, n, priority, category, impact, effort, place: what to mend first; what doesn't occur is left out."""
    p = pages.groupBy("crawl_id").agg(
        F.count_if(ok() & (C("response_time_ms") > 1000)).alias("slow_pages"),
        F.count_if(F.size("redirect_chain") > 2).alias("long_redirects"),
        F.count_if(~C("is_indexable") & ok() & is_html()).alias("not_indexable"),
        F.count_if((C("word_count") < 100) & ok() & is_html()).alias("thin_pages"),
    )
    types = [w[0] for w in WINS if w[0] not in p.columns]
    i = issues.where(C("issue_type").isin(types)).groupBy("crawl_id").agg(*[F.count_if(C("issue_type") == t).alias(t) for t in types])
    both = p.join(i, "crawl_id", "left").na.fill(0, types)
    rows = F.array(*[F.struct(F.lit(w).alias("win"), C(w).alias("n"), F.lit(a).alias("priority"), F.lit(b).alias("category"), F.lit(c).alias("impact"), F.lit(e).alias("effort"), F.lit(j).alias("_j")) for j, (w, a, b, c, e) in enumerate(WINS)])
    wins = both.select("crawl_id", F.explode(rows).alias("x")).select("crawl_id", "x.*").where("n > 0")
    rank = F.when(C("priority") == "critical", 0).when(C("priority") == "warning", 1).otherwise(2)
    return top_per(wins.withColumn("_p", rank), ["crawl_id"], [C("_p"), C("n").desc(), C("_j")], 10).drop("_p", "_j")


def keywords(pages: DataFrame, k: int = 50) -> DataFrame:
    """crawl_id, word, n, weight, unique_words, total_pages: words of titles and main headings of HTML pages that answered 2xx."""
    texts = F.concat(F.array(F.coalesce("title", F.lit(""))), F.coalesce("h1", F.array().cast("array<string>")))
    read = pages.where(ok() & is_html())
    found = read.select("crawl_id", F.explode(texts).alias("t")).select("crawl_id", F.explode(F.regexp_extract_all(F.lower("t"), F.lit("([a-z0-9฀-๿]+)"), F.lit(1))).alias("word"))
    freq = found.where((F.length("word") > 1) & ~C("word").isin(STOP_WORDS)).groupBy("crawl_id", "word").agg(F.count("*").alias("n"))
    most = freq.groupBy("crawl_id").agg(F.max("n").alias("most"), F.count("*").alias("unique_words"))
    of = most.join(read.groupBy("crawl_id").agg(F.count("*").alias("total_pages")), "crawl_id")
    return top_per(freq, ["crawl_id"], [C("n").desc(), C("word")], k).join(of, "crawl_id").select("crawl_id", "word", "n", F.round(C("n") / C("most"), 3).alias("weight"), "unique_words", "total_pages")


def segments(pages: DataFrame) -> DataFrame:
    s = C("status_code")
    return pages.groupBy("crawl_id", urls.segment(C("url")).alias("segment")).agg(
        F.count("*").alias("total"), F.count_if(ok()).alias("ok"), F.count_if((s >= 400) | (s == 0)).alias("errors"), F.count_if(s.between(300, 399)).alias("redirects"), F.count_if("is_indexable").alias("indexable"),
        F.round(F.avg("response_time_ms"), 1).alias("mean_ms"), F.round(F.avg("word_count"), 0).alias("mean_words"),
    ).withColumn("health", _share(C("ok"), C("total"))).withColumn("index_share", _share(C("indexable"), C("total")))


def content_quality(pages: DataFrame) -> DataFrame:
    words = F.coalesce("word_count", F.lit(0))
    return pages.where(is_html()).groupBy("crawl_id", buckets(words, *WORD_BUCKETS).alias("bucket")).agg(F.count("*").alias("n"), F.min(words).alias("least"), whole(F.avg("word_count")).alias("mean_words"))


def content_stats(pages: DataFrame) -> DataFrame:
    p = pages.where(is_html() & ok())
    return p.groupBy("crawl_id").agg(whole(F.avg("word_count")).alias("mean"), F.rint(F.percentile("word_count", 0.5)).cast("int").alias("median"), F.max("word_count").alias("most"), F.count_if(F.coalesce("word_count", F.lit(0)) < 100).alias("thin"))


def thin_pages(pages: DataFrame, k: int = 200) -> DataFrame:
    words = F.coalesce("word_count", F.lit(0))
    p = pages.where(is_html() & ok() & (words < 100)).select("crawl_id", "id", "url", words.alias("words"))
    return top_per(p, ["crawl_id"], [C("words"), C("id")], k)


def content_list(pages: DataFrame, k: int = 100) -> DataFrame:
    """Pages by words, most first; unknown counts lead."""
    p = pages.where(is_html()).select("crawl_id", "id", "word_count", "text_ratio", "readability_score")
    return top_per(p, ["crawl_id"], [C("word_count").desc_nulls_first(), C("id")], k)


def depth_analysis(pages: DataFrame) -> DataFrame:
    return pages.where(is_html()).groupBy("crawl_id", "crawl_depth").agg(
        F.count("*").alias("n"), F.count_if(ok()).alias("ok"), F.count_if(C("status_code") >= 400).alias("errors"), F.count_if("is_indexable").alias("indexable"), whole(F.avg("response_time_ms")).alias("mean_ms"), whole(F.avg("word_count")).alias("mean_words")
    )


def readability(pages: DataFrame) -> DataFrame:
    """Averages over exact decimals, so that their rounding doesn't hang on the order of addition."""
    mean = lambda c, digits: F.round(F.avg(C(c).cast("decimal(12,4)")), digits).cast("double")
    p = pages.where(is_html() & ok() & C("text_ratio").isNotNull())
    return p.groupBy("crawl_id").agg(F.count("*").alias("total"), F.count("readability_score").alias("scored"), mean("readability_score", 1).alias("score"), mean("text_ratio", 2).alias("ratio"), mean("avg_words_per_sentence", 1).alias("sentence"))


def ratio_buckets(pages: DataFrame) -> DataFrame:
    p = pages.where(is_html() & ok() & C("text_ratio").isNotNull())
    return p.groupBy("crawl_id", buckets(C("text_ratio"), *RATIO_BUCKETS).alias("bucket")).agg(F.count("*").alias("n"))


def hardest_pages(pages: DataFrame, k: int = 50) -> DataFrame:
    p = pages.where(is_html() & ok() & C("readability_score").isNotNull()).select("crawl_id", "id", "readability_score")
    return top_per(p, ["crawl_id"], [C("readability_score"), C("id")], k)


def _document_field(name: str) -> Column:
    return F.try_variant_get("doc", f"$.{name}", "string")


def open_graph(pages: DataFrame) -> DataFrame:
    p = with_document(pages.where(is_html() & ok()))
    missing = lambda f: F.count_if(F.coalesce(_document_field(f"og.{f}"), F.lit("")) == "")
    return p.groupBy("crawl_id").agg(F.count("*").alias("pages"), F.count_if(_document_field("og").isNotNull()).alias("with_og"), missing("title").alias("no_title"), missing("description").alias("no_description"), missing("image").alias("no_image"))


def mobile(pages: DataFrame) -> DataFrame:
    p = with_document(pages.where(is_html() & ok()))
    v = F.coalesce(_document_field("viewport"), F.lit(""))
    return p.groupBy("crawl_id").agg(F.count("*").alias("pages"), F.count_if(v != "").alias("with_viewport"), F.count_if(F.contains(v, F.lit("width=device-width"))).alias("responsive"))


def resources(pages: DataFrame) -> DataFrame:
    return pages.groupBy("crawl_id", resource_class().alias("kind")).agg(F.count("*").alias("n"), F.count_if(ok()).alias("ok"), F.count_if(C("status_code") >= 400).alias("errors"), whole(F.avg("response_time_ms")).alias("mean_ms"))


def resource_list(pages: DataFrame, k: int = 300) -> DataFrame:
    """What has a type other than HTML: errors first, then the slow ones; unknown times last."""
    error = F.when(C("status_code") >= 400, 0).otherwise(1)
    p = pages.where(~is_html()).select("crawl_id", "id", resource_class().alias("kind"), "status_code", "response_time_ms", error.alias("_e"))
    return top_per(p, ["crawl_id"], [C("_e"), C("response_time_ms").desc_nulls_last(), C("id")], k).drop("_e")


def _unset(c: Column) -> Column:
    return F.coalesce(c, F.lit("")) == ""


def _without_alt(images: str) -> Column:
    return F.size(F.filter(images, lambda i: _unset(image_field(i, "alt"))))


def images(pages: DataFrame) -> DataFrame:
    """crawl_id, pages, images, no_alt, no_size, alt_share, per_page, over pages of any type that have images."""
    p = with_document(pages).select("crawl_id", F.coalesce("images", F.array().cast("array<variant>")).alias("images"))
    no_size = F.size(F.filter("images", lambda i: _unset(image_field(i, "width")) | _unset(image_field(i, "height"))))
    g = p.where(F.size("images") > 0).groupBy("crawl_id").agg(F.count("*").alias("pages"), F.sum(F.size("images")).alias("images"), F.sum(_without_alt("images")).alias("no_alt"), F.sum(no_size).alias("no_size"))
    return g.withColumn("alt_share", _share(C("images") - C("no_alt"), C("images"))).withColumn("per_page", F.round(C("images") / C("pages"), 1))


def images_without_alt(pages: DataFrame, k: int | None = 100) -> DataFrame:
    """The first ``k`` of each crawl by page and place; all of them where ``k`` is None."""
    p = with_document(pages).select("crawl_id", "id", F.posexplode("images").alias("place", "i"))
    p = p.where(_unset(image_field(C("i"), "alt"))).select("crawl_id", "id", "place", image_field(C("i"), "src").alias("src"))
    return p if k is None else top_per(p, ["crawl_id"], [C("id"), C("place")], k)


def _skips() -> Column:
    return F.size(heading_jumps(F.filter("levels", lambda x: x.rlike("^h[0-9]$")))) > 0


def accessibility(pages: DataFrame) -> DataFrame:
    """crawl_id, pages, images, no_alt, no_h1, several_h1, skipped (pages that skip a heading level), with_issues (pages with any of the three), alt_share."""
    p = with_document(pages.where(is_html() & ok())).withColumn("im", F.coalesce("images", F.array().cast("array<variant>")))
    n_h1 = F.size(F.coalesce("h1", F.array().cast("array<string>")))
    skipped = F.coalesce(_skips(), F.lit(False))
    g = p.groupBy("crawl_id").agg(
        F.count("*").alias("pages"), F.sum(F.size("im")).alias("images"), F.sum(_without_alt("im")).alias("no_alt"), F.count_if(n_h1 == 0).alias("no_h1"), F.count_if(n_h1 > 1).alias("several_h1"),
        F.count_if(skipped).alias("skipped"), F.count_if((n_h1 != 1) | skipped).alias("with_issues"),
    )
    return g.withColumn("alt_share", F.round((1 - C("no_alt") / F.greatest("images", F.lit(1))) * 100, 1))


def _blocks(pages: DataFrame) -> DataFrame:
    """HTML pages that answered 2xx with their JSON-LD array as ``blocks``."""
    return with_document(pages.where(is_html() & ok())).withColumn("blocks", F.coalesce(F.try_variant_get("doc", "$.json_ld", "array<variant>"), F.array().cast("array<variant>")))


def _type(block: Column) -> Column:
    """The type of a block; several types joined, 'Unknown' for none."""
    many = F.array_join(F.try_variant_get(block, "$['@type']", "array<string>"), ", ")
    return F.coalesce(many, F.try_variant_get(block, "$['@type']", "string"), F.lit("Unknown"))


def _is_object(block: Column) -> Column:
    return F.schema_of_variant(block).startswith("OBJECT")


def structured_types(pages: DataFrame) -> DataFrame:
    """crawl_id, type, blocks: JSON-LD objects of HTML pages that answered 2xx by their @type."""
    b = _blocks(pages).select("crawl_id", F.explode("blocks").alias("b")).where(_is_object(C("b")))
    return b.groupBy("crawl_id", _type(C("b")).alias("type")).agg(F.count("*").alias("blocks"))


def structured_pages(pages: DataFrame) -> DataFrame:
    """crawl_id, id, types, blocks, warnings: per HTML page with JSON-LD its types and what its objects lack, as texts."""
    has = lambda b, f: ~F.coalesce(F.try_variant_get(b, f"$['{f}']", "string"), F.lit("")).isin("", "[]", "{}", "false", "0")

    def lacks(b: Column) -> Column:
        kind = _type(b)
        tests = [F.when(~has(b, "@context"), F.concat(F.lit("Missing @context in "), kind))]
        for name in sorted({f for some in REQUIRED.values() for f in some}):
            tests.append(F.when(kind.isin([t for t, some in REQUIRED.items() if name in some]) & ~has(b, name), F.concat(F.lit(f"Missing {name} in "), kind)))
        return F.array_compact(F.array(*tests))

    p = _blocks(pages).where(F.size("blocks") > 0).withColumn("objects", F.filter("blocks", _is_object))
    return p.select("crawl_id", "id", F.transform("objects", _type).alias("types"), F.size("blocks").alias("blocks"), F.flatten(F.transform("objects", lacks)).alias("warnings"))


def structured_coverage(pages: DataFrame) -> DataFrame:
    """crawl_id, html_pages, with_data, coverage, with_warnings: HTML pages that answered 2xx."""
    every = pages.where(is_html() & ok()).groupBy("crawl_id").agg(F.count("*").alias("html_pages"))
    some = structured_pages(pages).groupBy("crawl_id").agg(F.count("*").alias("with_data"), F.count_if(F.size("warnings") > 0).alias("with_warnings"))
    both = every.join(some, "crawl_id", "left").na.fill(0, ["with_data", "with_warnings"])
    return both.select("crawl_id", "html_pages", "with_data", _share(C("with_data"), C("html_pages")).alias("coverage"), "with_warnings")


#: Fields each type should have.
RECOMMENDED = {
    "Article": ["headline", "author", "datePublished"], "NewsArticle": ["headline", "author", "datePublished"], "BlogPosting": ["headline", "author", "datePublished"],
    "Product": ["name"], "Organization": ["name"], "Person": ["name"], "WebPage": ["name"], "Recipe": ["name"], "LocalBusiness": ["name", "address"], "WebSite": ["name", "url"],
    "BreadcrumbList": ["itemListElement"], "FAQPage": ["mainEntity"], "HowTo": ["name", "step"], "Event": ["name", "startDate", "location"], "VideoObject": ["name", "uploadDate"],
    "ImageObject": ["contentUrl"], "Review": ["itemReviewed"], "AggregateRating": ["ratingValue", "reviewCount"],
}
REQUIRED = {"Article": ["headline", "datePublished", "author"], "BlogPosting": ["headline", "datePublished", "author"], "NewsArticle": ["headline", "datePublished", "author"], "Product": ["name", "offers"], "Organization": ["name"], "LocalBusiness": ["name"], "BreadcrumbList": ["itemListElement"]}


def structured_validation(pages: DataFrame, fields: dict[str, list[str]] = RECOMMENDED) -> DataFrame:
    """crawl_id, id, place, message: what each JSON-LD object lacks: its @type, its @context or fields of its type."""
    p = with_document(pages)
    blocks = F.coalesce(F.try_variant_get("doc", "$.json_ld", "array<variant>"), F.when(_document_field("json_ld").isNotNull(), F.array(F.try_variant_get("doc", "$.json_ld", "variant"))))
    b = p.select("crawl_id", "id", F.posexplode(blocks).alias("place", "b")).where(F.schema_of_variant("b").startswith("OBJECT"))
    has = lambda f: F.coalesce(F.try_variant_get("b", f"$['{f}']", "string"), F.lit("")) != ""
    kind = F.try_variant_get("b", "$['@type']", "string")
    tests = [F.when(~has("@type"), F.lit("no @type")), F.when(~has("@context"), F.lit("no @context"))]
    for name in sorted({f for some in fields.values() for f in some}):
        of = [t for t, some in fields.items() if name in some]
        tests.append(F.when(kind.isin(of) & ~has(name), F.lit(f"no {name}")))
    return b.select("crawl_id", "id", "place", F.explode(F.array_compact(F.array(*tests))).alias("message"))


def security(pages: DataFrame, issues: DataFrame) -> DataFrame:
    types = ["http_url", "mixed_content", "missing_hsts", "missing_csp", "missing_x_content_type_options", "missing_x_frame_options"]
    p = pages.groupBy("crawl_id").agg(F.count_if(ok() & C("url").startswith("https://")).alias("https"), F.count_if(ok() & C("url").startswith("http://")).alias("http"))
    i = issues.where(C("issue_type").isin(types)).groupBy("crawl_id").agg(*[F.count_if(C("issue_type") == t).alias(t) for t in types])
    return p.join(i, "crawl_id", "left").na.fill(0, types)


def cookies(pages: DataFrame, k: int = 200) -> DataFrame:
    """Pages with cookies, most first, and how many lack a flag."""
    p = with_document(pages).withColumn("cookies", F.try_variant_get("doc", "$.cookies", "array<variant>")).where(F.size("cookies") > 0)
    flag = lambda name: F.size(F.filter("cookies", lambda x: ~F.coalesce(F.try_variant_get(x, f"$.{name}", "boolean"), F.lit(False))))
    same = F.size(F.filter("cookies", lambda x: F.lower(F.coalesce(F.try_variant_get(x, "$.same_site", "string"), F.lit("none"))).isin("none", "")))
    p = p.select("crawl_id", "id", F.size("cookies").alias("n"), flag("secure").alias("not_secure"), flag("http_only").alias("not_http_only"), same.alias("no_same_site"))
    return top_per(p, ["crawl_id"], [C("n").desc(), C("id")], k)


def redirect_chains(pages: DataFrame, k: int = 200) -> DataFrame:
    p = pages.where(C("redirect_url").isNotNull())
    hops = F.greatest(F.size(F.coalesce("redirect_chain", F.array().cast("array<struct<url:string,status_code:int>>"))), F.lit(1))
    return top_per(p.select("crawl_id", "id", "url", "status_code", "redirect_url", hops.alias("hops")), ["crawl_id"], [C("hops").desc(), C("url"), C("id")], k)


def hreflang(pages: DataFrame) -> DataFrame:
    p = with_document(pages).select("crawl_id", "id", F.explode(F.try_variant_get("doc", "$.hreflang", "array<variant>")).alias("h"))
    return p.select("crawl_id", "id", F.try_variant_get("h", "$.lang", "string").alias("lang"), F.try_variant_get("h", "$.href", "string").alias("href"))


def link_scores(pages: DataFrame, k: int = 100) -> DataFrame:
    p = pages.where(C("link_score").isNotNull()).select("crawl_id", "id", "url", "link_score")
    return top_per(p, ["crawl_id"], [C("link_score").desc(), C("id")], k)


def _pdfs(pages: DataFrame) -> DataFrame:
    return pages.where(F.lower("content_type").like("%pdf%") | C("url").like("%.pdf%"))


def pdf_audit(pages: DataFrame, links: DataFrame) -> DataFrame:
    """PDF documents by type or address: crawl_id, id, url, status_code, size_bytes, size_kb, pdf_title, inlinks, issues (no title, over 5 MiB, error, slow)."""
    p = _pdfs(pages).withColumn("doc", seo_document())
    size = F.coalesce(F.try_variant_get("doc", "$.content_length", "bigint"), F.lit(0))
    name = F.coalesce(F.nullif(_document_field("pdf_title"), F.lit("")), F.nullif("title", F.lit("")))
    p = p.select("crawl_id", "id", "url", "status_code", "response_time_ms", size.alias("size_bytes"), F.round(size / 1024, 1).alias("size_kb"), name.alias("pdf_title"))
    into = links.join(p.select("crawl_id", C("url").alias("target_url")).distinct(), ["crawl_id", "target_url"], "left_semi").groupBy("crawl_id", C("target_url").alias("url")).agg(F.count("*").alias("inlinks"))
    wrong = [("missing_title", C("pdf_title").isNull()), ("large_file", C("size_bytes") > 5 * 1024 * 1024), ("broken", C("status_code") >= 400), ("slow", C("response_time_ms") > 5000)]
    issues = F.array_join(F.array_compact(F.array(*[F.when(test, F.lit(kind)) for kind, test in wrong])), ", ")
    joined = p.join(into, ["crawl_id", "url"], "left")
    return joined.select("crawl_id", "id", "url", "status_code", "size_bytes", "size_kb", "pdf_title", F.coalesce("inlinks", F.lit(0)).alias("inlinks"), issues.alias("issues"))


def pdf_inlinks(pages: DataFrame, links: DataFrame) -> DataFrame:
    """crawl_id, target_url, source_url, anchor_text: the links to PDF documents."""
    targets = _pdfs(pages).select("crawl_id", C("url").alias("target_url")).distinct()
    source = pages.select("crawl_id", C("id").alias("source_url_id"), C("url").alias("source_url"))
    return links.join(targets, ["crawl_id", "target_url"], "left_semi").join(source, ["crawl_id", "source_url_id"]).select("crawl_id", "target_url", "source_url", "anchor_text")


def site_structure(pages: DataFrame) -> DataFrame:
    """crawl_id, prefix, depth, pages, ok, errors: every directory of every path with all pages below it."""
    parts = F.filter(F.split(urls.path(C("url")), "/"), lambda x: x != "")
    prefixes = F.transform(F.sequence(F.lit(0), F.size("parts")), lambda n: F.struct(n.alias("depth"), F.concat(F.lit("/"), F.array_join(F.slice("parts", F.lit(1), n), "/")).alias("prefix")))
    p = pages.select("crawl_id", "status_code", parts.alias("parts")).select("crawl_id", "status_code", F.explode(prefixes).alias("x"))
    return p.groupBy("crawl_id", "x.prefix", "x.depth").agg(F.count("*").alias("pages"), F.count_if(ok()).alias("ok"), F.count_if(C("status_code") >= 400).alias("errors"))


def project_stats(crawls: DataFrame, k: int = 20) -> DataFrame:
    """The newest crawls of each project with their duration in seconds."""
    c = crawls.dropDuplicates(["id"]).select("project_id", "id", "status", "total_urls", "error_count", "created_at", ((F.unix_micros("completed_at") - F.unix_micros("started_at")) / 1e6).alias("seconds"))
    return top_per(c, ["project_id"], [C("created_at").desc(), C("id")], k)


def project_trends(crawls: DataFrame, pages: DataFrame, issues: DataFrame, k: int = 50) -> DataFrame:
    """Per completed crawl: issues by severity, mean and median response below 400; two aggregates joined once."""
    c = top_per(crawls.dropDuplicates(["id"]).where("status = 'completed'").select("project_id", C("id").alias("crawl_id"), "completed_at"), ["project_id"], [C("completed_at").desc_nulls_last(), C("crawl_id")], k)
    p = pages.where(C("status_code") < 400).groupBy("crawl_id").agg(F.round(F.avg("response_time_ms"), 3).alias("mean"), F.round(F.percentile("response_time_ms", 0.5), 3).alias("median"))
    i = issues.groupBy("crawl_id").agg(F.count("*").alias("issues"), F.count_if(C("severity") == "critical").alias("critical"), F.count_if(C("severity") == "warning").alias("warnings"), F.count_if(C("severity") == "info").alias("infos"))
    return c.join(p, "crawl_id", "left").join(i, "crawl_id", "left").na.fill(0, ["issues", "critical", "warnings", "infos"])


def dashboard(projects: DataFrame, crawls: DataFrame) -> DataFrame:
    """Per project: crawls, addresses, errors, active crawls, last crawl."""
    c = crawls.dropDuplicates(["id"]).groupBy("project_id").agg(F.count("*").alias("crawls"), F.sum("crawled_urls_count").alias("urls"), F.sum("error_count").alias("errors"), F.count_if(C("status") == "crawling").alias("active"), F.max("created_at").alias("last"))
    return projects.select(C("id").alias("project_id"), "name").join(c, "project_id", "left").na.fill(0, ["crawls", "urls", "errors", "active"])


def redirect_counts(pages: DataFrame) -> DataFrame:
    """Per crawl: redirecting pages, long chains (over two hops), pages that answered 301 and 302."""
    return pages.groupBy("crawl_id").agg(F.count_if(F.size("redirect_chain") > 0).alias("redirected"), F.count_if(F.size("redirect_chain") > 2).alias("long"), F.count_if(C("status_code") == 301).alias("moved"), F.count_if(C("status_code") == 302).alias("found"))


def cookie_totals(pages: DataFrame) -> DataFrame:
    """Per crawl: pages with cookies, cookies, and those not marked secure."""
    p = with_document(pages).select("crawl_id", F.try_variant_get("doc", "$.cookies", "array<variant>").alias("c")).where(F.size("c") > 0)
    open_ = F.size(F.filter("c", lambda x: ~F.coalesce(F.try_variant_get(x, "$.secure", "boolean"), F.lit(False))))
    return p.groupBy("crawl_id").agg(F.count("*").alias("pages"), F.sum(F.size("c")).alias("cookies"), F.sum(open_).alias("not_secure"))


def project_crawls(crawls: DataFrame, k: int = 50) -> DataFrame:
    """The newest crawls of each project."""
    return top_per(crawls.dropDuplicates(["id"]).select("project_id", "id", "status", "created_at"), ["project_id"], [C("created_at").desc(), C("id")], k)


def summary(pages: DataFrame, issues: DataFrame) -> dict[str, DataFrame]:
    """The sections of a crawl's summary report, for the report sink."""
    return {"health": health(pages, issues), "overview": overview(pages), "quick wins": quick_wins(pages, issues), "performance": performance(pages)}
