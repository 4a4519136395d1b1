"""Links between pages: in- and outlinks, orphans, anchors, the link graph, link score, crawl order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagequarry.functions.common import is_html, top_per
from pagequarry.session import cut, staged

C = F.col


def inlinks(pages: DataFrame, links: DataFrame) -> DataFrame:
    """crawl_id, target_url, source_url, anchor_text, link_type: every link with the page it stands on."""
    source = pages.select("crawl_id", C("id").alias("source_url_id"), C("url").alias("source_url"))
    return links.join(source, ["crawl_id", "source_url_id"]).select("crawl_id", "target_url", "source_url", "anchor_text", "link_type")


def inlink_counts(pages: DataFrame, links: DataFrame) -> DataFrame:
    """crawl_id, id, inlinks: internal links to each page, counted before the join, so one target with most links is one row."""
    n = links.where("link_type = 'internal'").groupBy("crawl_id", C("target_url_hash").alias("url_hash")).agg(F.count("*").alias("inlinks"))
    return pages.select("crawl_id", "id", "url_hash").join(n, ["crawl_id", "url_hash"], "left").select("crawl_id", "id", F.coalesce("inlinks", F.lit(0)).alias("inlinks"))


def orphans(pages: DataFrame, links: DataFrame, exclude_start: bool = False) -> DataFrame:
    """HTML pages without an internal link from another page; with ``exclude_start`` start pages are none and a link from itself counts.

    A link target is kept as its first two sources, which is enough to tell
    whether one is another page; so a target with most links is one row.
    """
    p = pages.where(is_html()).select("crawl_id", "id", "url", "url_hash", "crawl_depth")
    into = links.where("link_type = 'internal'").groupBy("crawl_id", C("target_url_hash").alias("url_hash")).agg(F.min("source_url_id").alias("a"), F.max("source_url_id").alias("b"))
    joined = p.join(into, ["crawl_id", "url_hash"], "left")
    if exclude_start:
        return joined.where(C("a").isNull() & (C("crawl_depth") > 0)).select("crawl_id", "id", "url")
    return joined.where(C("a").isNull() | ((C("a") == C("id")) & (C("b") == C("id")))).select("crawl_id", "id", "url")


def anchor_texts(links: DataFrame, k: int = 50) -> DataFrame:
    n = links.where("link_type = 'internal' and anchor_text <> ''").groupBy("crawl_id", "anchor_text").agg(F.count("*").alias("n"))
    return top_per(n, ["crawl_id"], [C("n").desc(), C("anchor_text")], k)


def external_links(pages: DataFrame, links: DataFrame, nofollow: bool | None = None, search: str | None = None) -> DataFrame:
    e = links.where("link_type = 'external'")
    has = F.coalesce(F.array_contains("rel_attrs", "nofollow"), F.lit(False))
    if nofollow is not None:
        e = e.where(has if nofollow else ~has)
    if search:
        e = e.where(F.contains(F.lower("target_url"), F.lit(search.strip().lower())))
    source = pages.select("crawl_id", C("id").alias("source_url_id"), C("url").alias("source_url"))
    return e.join(source, ["crawl_id", "source_url_id"]).select("crawl_id", C("id"), "target_url", "source_url", "anchor_text", has.alias("nofollow"))


def outlinks(links: DataFrame, k: int | None = 100) -> DataFrame:
    """The first ``k`` links of each page, all where ``k`` is None; a filter on one page reaches the scan."""
    shown = links.select("crawl_id", "source_url_id", "id", "target_url", "anchor_text", "link_type", F.coalesce("rel_attrs", F.array().cast("array<string>")).alias("rel_attrs"), "link_position", "is_javascript")
    return shown if k is None else top_per(shown, ["crawl_id", "source_url_id"], [C("id")], k)


def links_analysis(pages: DataFrame, links: DataFrame, k: int = 50) -> DataFrame:
    """crawl_id, part ('inlinks', 'orphans', 'depth', 'anchors'), name, n: the k pages with most inlinks, the first k orphans, pages by depth and the k commonest anchor texts of each crawl."""
    most = top_per(inlink_counts(pages, links).where("inlinks > 0"), ["crawl_id"], [C("inlinks").desc(), C("id")], k)
    alone = top_per(orphans(pages, links), ["crawl_id"], [C("url"), C("id")], k)
    depth = pages.groupBy("crawl_id", "crawl_depth").agg(F.count("*").alias("n"))
    rows = lambda df, part, name, n: df.select("crawl_id", F.lit(part).alias("part"), C(name).cast("string").alias("name"), n.cast("bigint").alias("n"))
    parts = [rows(most, "inlinks", "id", C("inlinks")), rows(alone, "orphans", "id", F.lit(0)), rows(depth, "depth", "crawl_depth", C("n")), rows(anchor_texts(links, k), "anchors", "anchor_text", C("n"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


def outlink_counts(links: DataFrame) -> DataFrame:
    internal = C("link_type") == "internal"
    return links.groupBy("crawl_id", "source_url_id").agg(F.count_if(internal).alias("internal"), F.count_if(~internal).alias("other"))


def uncrawled(pages: DataFrame, links: DataFrame) -> DataFrame:
    """Where a continued crawl starts: internal targets that weren't crawled."""
    known = pages.select("crawl_id", C("url_hash").alias("target_url_hash")).distinct()
    return links.where("link_type = 'internal'").join(known, ["crawl_id", "target_url_hash"], "left_anti").select("crawl_id", "target_url").distinct()


def _edges(pages: DataFrame, links: DataFrame) -> DataFrame:
    """crawl_id, source, target (page ids), nofollow: internal links between stored pages."""
    target = pages.select("crawl_id", C("url_hash").alias("target_url_hash"), C("id").alias("target"))
    follow = F.coalesce(F.array_contains("rel_attrs", "nofollow"), F.lit(False))
    return links.where("link_type = 'internal'").join(target, ["crawl_id", "target_url_hash"]).select("crawl_id", C("source_url_id").alias("source"), "target", follow.alias("nofollow"))


def graph_nodes(pages: DataFrame, links: DataFrame, k: int = 200) -> DataFrame:
    """The pages of each crawl most other pages link to: crawl_id, id, url, sources."""
    n = _edges(pages, links).select("crawl_id", "source", "target").distinct().groupBy("crawl_id", C("target").alias("id")).agg(F.count("*").alias("sources"))
    p = pages.select("crawl_id", "id", "url").dropDuplicates(["crawl_id", "id"]).join(n, ["crawl_id", "id"], "left").withColumn("sources", F.coalesce("sources", F.lit(0)))
    return top_per(p, ["crawl_id"], [C("sources").desc(), C("id")], k)


def graph_edges(pages: DataFrame, links: DataFrame, k: int = 200) -> DataFrame:
    """Distinct links between the nodes of ``graph_nodes``, none from a page to itself."""
    nodes = staged(graph_nodes(pages, links, k).select("crawl_id", "id"), "graph-nodes")
    e = _edges(pages, links).where("source <> target").select("crawl_id", "source", "target").distinct()
    for end in ("source", "target"):
        e = e.join(nodes.withColumnRenamed("id", end), ["crawl_id", end], "left_semi")
    return e.select("crawl_id", "source", "target")


DAMPING, ITERATIONS = 0.85, 10


def link_score(pages: DataFrame, links: DataFrame, damping: float = DAMPING, iterations: int = ITERATIONS) -> DataFrame:
    """crawl_id, id, link_score from 1 to 100: rank by links among the HTML pages that answered 200.

    A nofollow link counts as a link of its page but passes nothing on; what
    pages without links hold isn't spread.  Crawls of one page have no score;
    where all ranks are equal every score is 50.  Ranks are joined with
    links that were counted per pair of pages, so every round moves one
    row a pair; a page with most inlinks is summed before the shuffle.
    """
    nodes = pages.where(is_html() & (C("status_code") == 200)).select("crawl_id", "id").distinct()
    size = nodes.groupBy("crawl_id").agg(F.count("*").alias("n")).where("n > 1")
    nodes = staged(nodes.join(size, "crawl_id"), "score-nodes")
    ends = nodes.select("crawl_id", "id")
    e = _edges(pages, links).join(ends.withColumnRenamed("id", "source"), ["crawl_id", "source"], "left_semi").join(ends.withColumnRenamed("id", "target"), ["crawl_id", "target"], "left_semi")
    pairs = e.groupBy("crawl_id", "source", "target").agg(F.count("*").alias("all"), F.count_if(~C("nofollow")).alias("passing"))
    out = pairs.groupBy("crawl_id", "source").agg(F.sum("all").alias("out"))
    weights = pairs.where("passing > 0").join(out, ["crawl_id", "source"]).select("crawl_id", C("source").alias("id"), "target", (C("passing") / C("out")).alias("w"))
    weights = staged(weights, "score-links")
    ranks = nodes.select("crawl_id", "id", "n", (F.lit(1.0) / C("n")).alias("rank"))
    for i in range(iterations):
        got = weights.join(ranks.select("crawl_id", "id", "rank"), ["crawl_id", "id"]).groupBy("crawl_id", C("target").alias("id")).agg(F.sum(C("w") * C("rank")).alias("got"))
        ranks = nodes.join(got, ["crawl_id", "id"], "left").select("crawl_id", "id", "n", (F.lit(1 - damping) / C("n") + damping * F.coalesce("got", F.lit(0.0))).alias("rank"))
        if i % 3 == 2:
            ranks = cut(ranks)
    span = ranks.groupBy("crawl_id").agg(F.min("rank").alias("low"), F.max("rank").alias("high"))
    ratio = (C("rank") - C("low")) / (C("high") - C("low"))
    scaled = F.log10(ratio * 99 + 1) / F.log10(F.lit(100.0)) * 99 + 1
    score = F.when(C("high") > C("low"), F.greatest(F.lit(1), F.rint(F.round(scaled, 9)).cast("int"))).otherwise(F.lit(50))
    return ranks.join(span, "crawl_id").select("crawl_id", "id", score.alias("link_score"))


def with_link_score(pages: DataFrame, scores: DataFrame) -> DataFrame:
    """Pages with their new score; those without one keep theirs."""
    new = scores.select("crawl_id", "id", C("link_score").alias("_new"))
    return pages.join(new, ["crawl_id", "id"], "left").withColumn("link_score", F.coalesce("_new", "link_score")).drop("_new")


def crawl_order(pages: DataFrame, links: DataFrame, max_depth: int | None = 10) -> DataFrame:
    """crawl_id, id, depth: the least number of links from a start page (crawl_depth 0), level by level.

    Pages further than ``max_depth`` are left out; None goes on until a level is empty.
    """
    start = F.bool_or(F.coalesce(C("crawl_depth") == 0, F.lit(False))).alias("start")
    nodes = staged(pages.groupBy("crawl_id", "id").agg(start).withColumn("n", F.monotonically_increasing_id()), "order-pages")
    # pages are numbered, so that a level moves two numbers a link and not three ids
    numbered = pages.select("crawl_id", "id", "url_hash").join(nodes, ["crawl_id", "id"]).select("crawl_id", "url_hash", C("n").alias("id"))
    sources = nodes.select("crawl_id", C("id").alias("source"), C("n").alias("from"))
    edges = staged(_edges(numbered, links).join(sources, ["crawl_id", "source"]).select("from", C("target").alias("to")).distinct(), "order-links")
    level = cut(nodes.where("start").select("n", F.lit(0).alias("depth")))
    reached = level
    depth = 0
    while max_depth is None or depth < max_depth:
        depth += 1
        after = edges.join(level.select(C("n").alias("from")), "from").select(C("to").alias("n")).distinct()
        level = cut(after.join(reached.select("n"), "n", "left_anti").withColumn("depth", F.lit(depth)))
        if level.isEmpty():
            break
        reached = reached.unionByName(level)
        if depth % 10 == 0 and depth != max_depth:
            reached = cut(reached)
    return nodes.join(reached, "n").select("crawl_id", "id", "depth")
