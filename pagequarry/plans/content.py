"""Queries on extraction, text, addresses, sources, sinks and streams, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagequarry.functions import text, urls
from pagequarry.plans.audit import _PATH, _PIXELS, _QUERY, once, pages
from pagequarry.sources import html, readers, sinks
from pagequarry.streaming import events as streams
from pagequarry.session import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def add(name: str, f, sql: str | None = None) -> None:
    QUERIES[name] = f
    if sql:
        SQL[name] = once(sql)


def _rows(rows: list[tuple], names: str) -> str:
    shown = lambda v: "NULL" if v is None else str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, int | float) else "'" + v.replace("'", "''") + "'"
    return "SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(map(shown, r)) + ")" for r in rows) + f") AS t({names})"


_PAGES = [
    (
        "https://shop.example/a/",
        "<html><head><title> Caf&eacute; &amp; Bar </title><meta name='Description' content='Good coffee'><meta name=robots content='NOINDEX, follow'><link rel=canonical href='/a'>"
        "<link rel='next' href='?p=2'><meta property='og:title' content='T'><script type='application/ld+json'>{\"@type\": \"Product\"}</script><script type='application/ld+json'>{bad</script></head>"
        "<body><h1>One <b>two</b></h1><h3>x</h3><p>Words here<script>var s='</p>';</script><a href='/b#f' rel='nofollow ugc'>B</a><a href='mailto:x@y'>m</a><a href='http://other.example/'>O</a>"
        "<img src='http://cdn.example/i.png' alt=''><img data-src=j.png width=1 height=2>",
    ),
    ("http://shop.example/empty", ""),
    ("https://shop.example/none", None),
    ("https://shop.example/b", "<title>B</title><link rel=canonical href='https://shop.example/c'><body>tail without an end"),
]
_EXTRACTED = [
    ("https://shop.example/a/", "Café & Bar", "Good coffee", "noindex|follow", "https://shop.example/a", "One two", "h1|h3", 2, 2, 1, "https://shop.example/a/?p=2", 1, 1, 8, False, "noindex"),
    ("http://shop.example/empty", None, None, None, None, None, None, 0, 0, None, None, None, None, None, False, "non_html"),
    ("https://shop.example/none", None, None, None, None, None, None, 0, 0, None, None, None, None, None, False, "non_html"),
    ("https://shop.example/b", "B", None, "", "https://shop.example/c", "", "", 0, 0, 0, None, 0, 0, 4, False, "canonicalized"),
]
_NAMES = "url, title, description, robots, canonical, h1, levels, links, images, mixed, rel_next, json_ld, og, words, is_indexable, reason"


def _html(spark):
    return spark.createDataFrame(_PAGES, "url string, html string")


def html_extract(spark, d):
    x = html.extract(_html(spark))
    many = lambda c: F.array_join(c, "|").alias
    return x.select(
        "url", "title", F.col("meta_description").alias("description"), many("robots_meta")("robots"), F.col("canonical_url").alias("canonical"), many("h1")("h1"), many("heading_sequence")("levels"),
        F.size(F.filter("links", lambda x: x["kind"] != "resource")).alias("links"), F.size("images").alias("images"), F.when(F.col("mixed_content_urls").isNotNull(), F.size("mixed_content_urls")).alias("mixed"), "rel_next",
        F.when(F.col("json_ld").isNotNull(), F.size("json_ld")).alias("json_ld"), F.when(F.col("og").isNotNull(), F.cardinality("og")).alias("og"), F.col("word_count").alias("words"), "is_indexable", F.col("indexability_reason").alias("reason"),
    )


add("html_extract", html_extract, _rows(_EXTRACTED, _NAMES))
_EXTRACTORS = [
    {"id": "heading", "method": "css", "selector": "body > h1 b"}, {"id": "link", "method": "css", "selector": "a[rel~=ugc]", "extract_type": "attribute", "attribute_name": "href"}, {"id": "images", "method": "xpath", "selector": "//img", "extract_type": "count"},
    {"id": "alt", "method": "xpath", "selector": "//img[@width='1']/@data-src"}, {"id": "title", "method": "regex", "selector": "<title>\\s*(\\w+)"}, {"id": "bad", "method": "css", "selector": "p:::"},
]
add(
    "custom_extractions",
    lambda spark, d: html.custom_extractions(_html(spark), _EXTRACTORS),
    _rows([("https://shop.example/a/", "heading", "two"), ("https://shop.example/a/", "link", "/b#f"), ("https://shop.example/a/", "alt", "j.png"), ("https://shop.example/a/", "title", "Caf"), ("https://shop.example/b", "title", "B"), *[(u, "images", n) for u, n in (("https://shop.example/a/", "2"), ("http://shop.example/empty", "0"), ("https://shop.example/none", "0"), ("https://shop.example/b", "0"))]], "url, extractor_id, value"),
)
_SEARCHES = [{"id": "cache", "pattern": "Cache"}, {"id": "digits", "pattern": "[0-9]+ (links|pages)", "is_regex": True}, {"id": "no cookie", "pattern": "cookie", "case_sensitive": True, "contains": False}]
add(
    "custom_searches",
    lambda spark, d: html.custom_searches(table(spark, d, "documents"), "text", _SEARCHES, ["doc_id"]),
    """WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), f AS (SELECT doc_id, 'cache' AS search_id, CAST((length(lower(t)) - length(replace(lower(t), 'cache', ''))) / 5 AS INTEGER) AS found, true AS c FROM t
  UNION ALL SELECT doc_id, 'digits', CAST(len(regexp_extract_all(t, '(?i)[0-9]+ (links|pages)')) AS INTEGER), true FROM t UNION ALL SELECT doc_id, 'no cookie', CAST((length(t) - length(replace(t, 'cookie', ''))) / 6 AS INTEGER), false FROM t)
SELECT doc_id, search_id, found, (found > 0) = c AS triggered FROM f""",
)


def text_metrics(spark, d):
    t = table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("t"))
    m = t.select("doc_id", text.word_count(F.col("t")).alias("words"), text.sentence_count(F.col("t")).alias("sentences"), text.syllable_count(F.col("t")).alias("syllables"), text.content_hash(F.col("t")).alias("content_hash"))
    return m.withColumn("ease", text.reading_ease(F.col("words"), F.col("sentences"), F.col("syllables")))


add(
    "text_metrics",
    text_metrics,
    r"""WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), f AS (SELECT doc_id, t, trim(regexp_replace(t, '[\s\x0b]+', ' ', 'g'), ' ') AS flat FROM t),
m AS (SELECT doc_id, t, flat, list_filter(string_split(flat, ' '), lambda w: w <> '') AS w, list_filter(string_split(lower(flat), ' '), lambda w: w <> '') AS lw FROM f),
n AS (SELECT doc_id, CAST(len(w) AS INTEGER) AS words, CAST(greatest(len(list_filter(regexp_split_to_array(t, '[.!?]+[\s\x0b]+|\n'), lambda p: trim(regexp_replace(p, '[\s\x0b]+', ' ', 'g'), ' ') <> '')), 1) AS INTEGER) AS sentences,
  CAST(coalesce(list_sum(list_transform(lw, lambda x: greatest(len(regexp_extract_all(x, '[aeiouy]+')) - CASE WHEN x LIKE '%e' AND len(regexp_extract_all(x, '[aeiouy]+')) > 1 THEN 1 ELSE 0 END, 1))), 0) AS INTEGER) AS syllables, md5(lower(flat)) AS content_hash FROM m)
SELECT *, CASE WHEN words >= 30 THEN greatest(0, least(100, round(206.835 - 1.015 * (words / sentences) - 84.6 * (syllables / words), 1))) END AS ease FROM n""",
)
add("title_pixels", lambda spark, d: pages(spark, d).select("id", text.pixel_width(F.col("title")).alias("pixels")), f"SELECT id, CASE WHEN title <> '' THEN CAST({_PIXELS} AS INTEGER) ELSE 0 END AS pixels FROM crawled_urls")
add(
    "url_parts",
    lambda spark, d: pages(spark, d).select("id", urls.host(F.col("url")).alias("host"), urls.path(F.col("url")).alias("path"), urls.query(F.col("url")).alias("query"), urls.segment(F.col("url")).alias("segment")),
    f"""SELECT id, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)) AS host, {_PATH} AS path, {_QUERY} AS query,
  CASE WHEN regexp_extract({_PATH}, '^/([^/]+)/', 1) <> '' THEN '/' || regexp_extract({_PATH}, '^/([^/]+)/', 1) || '/' ELSE '/' END AS segment FROM crawled_urls""",
)
add("url_hash_check", lambda spark, d: pages(spark, d).select("id", (urls.url_hash(urls.normalise_url(F.col("url"))) == F.col("url_hash")).alias("same")), "SELECT id, true AS same FROM crawled_urls")
_URLS = [("HTTP://Shop.Example/a b/%7Ex?q=1#f",), ("mailto:a@b",), ("  https://shop.example  ",), ("/relative",), (None,), ("",), ("https://shop.example/%2F",)]
add("url_list", lambda spark, d: readers.url_list(spark.createDataFrame(_URLS, "u string"), "u"), _rows([("http://shop.example/a%20b/~x?q=1", 0), ("https://shop.example/", 0), ("https://shop.example//", 0)], "url, crawl_depth"))
add(
    "url_rewrite",
    lambda spark, d: pages(spark, d).select("id", urls.rewrite(F.col("url"), [("^http://", "https://")], ["ref", "v"]).alias("url")),
    r"SELECT id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(url, '([?&])(ref|v)=[^&#]*', '\1', 'g'), '&+', '&', 'g'), '\?&', '?'), '[?&]+(#|$)', '\1'), '^http://', 'https://') AS url FROM crawled_urls",
)
add("url_scope", lambda spark, d: pages(spark, d).where(urls.in_scope(F.col("url"), "fennel-mill-5.example", exclude=["*/help/*"], include=["*.html", "*/guides/*"])).select("id", "url"), "SELECT id, url FROM crawled_urls WHERE (url LIKE 'http%://fennel-mill-5.example/%' OR url LIKE 'http%://%.fennel-mill-5.example/%') AND url NOT LIKE '%/help/%' AND (url LIKE '%.html' OR url LIKE '%/guides/%')")
add(
    "redirect_rows",
    lambda spark, d: readers.redirect_rows(pages(spark, d)),
    """WITH h AS (SELECT crawl_id, id AS page_id, url, redirect_chain AS c, unnest(range(1, len(redirect_chain) + 1)) AS i FROM crawled_urls)
SELECT crawl_id, page_id, c[i].url AS source_url, coalesce(c[i + 1].url, url) AS target_url, c[i].status_code AS status_code, CAST(i AS INTEGER) AS hop_number FROM h""",
)
add("crawl_presets", lambda spark, d: readers.presets(spark), _rows(readers.PRESETS, ", ".join(c.split()[0] for c in readers.PRESET_FIELDS.split(", "))))
_RESPONSES = [("a", {"Strict-Transport-Security": "max-age=1", "X-Robots-Tag": "noindex"}), ("b", {"x-frame-options": "DENY", "X-FRAME-OPTIONS": "SAMEORIGIN"}), ("c", {}), ("d", None)]
add(
    "response_headers",
    lambda spark, d: spark.createDataFrame(_RESPONSES, "id string, headers map<string,string>").select("id", readers.security_headers(F.col("headers")).alias("h")).select("id", "h.*"),
    _rows([("a", "max-age=1", None, None, None, None, "noindex"), ("b", None, None, "SAMEORIGIN", None, None, None), ("c", *[None] * 6), ("d", *[None] * 6)], "id, strict_transport_security, content_security_policy, x_frame_options, x_content_type_options, referrer_policy, x_robots_tag"),
)
_BODIES = [("header", "text/html; charset=ISO-8859-1", "caf\u00e9".encode("latin-1")), ("meta", "text/html", b"<meta charset='windows-1251'>" + "\u0434\u0430".encode("cp1251")), ("http-equiv", None, b'<meta http-equiv="Content-Type" content="text/html; charset=shift_jis">' + "\u65e5".encode("shift_jis")), ("none", None, "\u00e9".encode()), ("wrong", "text/html; charset=nonsense", "\u00e9".encode()), ("null", None, None)]
add(
    "decoded_bodies",
    lambda spark, d: spark.createDataFrame(_BODIES, "id string, content_type string, body binary").select("id", F.regexp_replace(html.decoded("body", "content_type"), "<[^>]*>", "").alias("text")),
    _rows([("header", "caf\u00e9"), ("meta", "\u0434\u0430"), ("http-equiv", "\u65e5"), ("none", "\u00e9"), ("wrong", "\u00e9"), ("null", None)], "id, text"),
)
_ROBOTS = [("a.example", "User-agent: *\nDisallow: /p/ # private\nCrawl-delay: 2\n\nUser-agent: bot\nAllow: /\nSitemap: https://a.example/s.xml"), ("b.example", "")]
add(
    "robots_directives",
    lambda spark, d: readers.robots_directives(spark.createDataFrame(_ROBOTS, "host string, text string"), "host", "text"),
    _rows([("a.example", 1, "*", "disallow", "/p/"), ("a.example", 2, "*", "crawl-delay", "2"), ("a.example", 5, "bot", "allow", "/"), ("a.example", 6, None, "sitemap", "https://a.example/s.xml")], "host, line, agent, directive, value"),
)
_ASKED = [("https://a.example/p/x", "a.example"), ("https://a.example/q", "a.example"), ("https://c.example/p/x", "c.example")]
add(
    "robots_allowed",
    lambda spark, d: readers.robots_allowed(spark.createDataFrame(_ASKED, "url string, host string"), spark.createDataFrame(_ROBOTS, "host string, text string"), "url", "host").drop("host"),
    _rows([("https://a.example/p/x", False, 2.0), ("https://a.example/q", True, 2.0), ("https://c.example/p/x", True, None)], "url, allowed, crawl_delay"),
)
_COOKIE = "sid=1; Secure; HttpOnly; SameSite=Lax\nad=2; Domain=.ads.example; Path=/x\n\nbroken"
add(
    "cookie_headers",
    lambda spark, d: spark.createDataFrame([(_COOKIE, "www.shop.example"), (None, "x")], "h string, d string").select(F.explode(readers.cookies(F.col("h"), F.col("d"))).alias("c")).select("c.name", "c.domain", "c.path", "c.secure", "c.is_third_party", F.array_join("c.issues", ",").alias("issues")),
    _rows([("sid", "www.shop.example", "/", True, False, ""), ("ad", "ads.example", "/x", False, True, "missing_secure,missing_httponly,samesite_none_or_missing")], "name, domain, path, secure, is_third_party, issues"),
)
_CRON = [("*/15 * * * *", "2024-01-31 23:50:10"), ("0 3 1 * *", "2024-01-31 23:50:00"), ("30 6 * * 1-5", "2024-02-02 06:30:00"), ("bad", "2024-01-01 00:00:00"), ("0 0 30 2 *", "2024-01-01 00:00:00")]
add(
    "cron_next",
    lambda spark, d: spark.createDataFrame(_CRON, "expression string, after string").select("expression", F.date_format(readers.next_run_at(F.col("expression"), F.to_timestamp("after")), "yyyy-MM-dd HH:mm").alias("next")),
    _rows([("*/15 * * * *", "2024-02-01 00:00"), ("0 3 1 * *", "2024-02-01 03:00"), ("30 6 * * 1-5", "2024-02-05 06:30"), ("bad", None), ("0 0 30 2 *", None)], "expression, next"),
)
_SHOWN = ", ".join(f"coalesce(array_to_string({c}, ' | '), '') AS {c}" if c in ("h1", "h2", "robots_meta") else f"coalesce(CAST({c} AS VARCHAR), '') AS {c}" for c in sinks.EXPORT_COLUMNS)
add("csv_export", lambda spark, d: sinks.export_rows(pages(spark, d)), f"SELECT {_SHOWN} FROM crawled_urls")
add(
    "sitemap",
    lambda spark, d: sinks.sitemap_rows(pages(spark, d)),
    """SELECT crawl_id, url AS loc, strftime(crawled_at, '%Y-%m-%d') AS lastmod, CASE WHEN crawl_depth = 0 THEN 'daily' WHEN crawl_depth <= 2 THEN 'weekly' ELSE 'monthly' END AS changefreq,
  CASE WHEN crawl_depth = 0 THEN '1.0' WHEN crawl_depth = 1 THEN '0.8' WHEN crawl_depth = 2 THEN '0.6' WHEN crawl_depth <= 4 THEN '0.4' ELSE '0.2' END AS priority FROM crawled_urls WHERE lower(content_type) LIKE 'text/html%' AND status_code = 200 AND is_indexable""",
)
add(
    "sitemap_coverage",
    lambda spark, d: readers.sitemap_coverage(sinks.sitemap_rows(pages(spark, d)), pages(spark, d)),
    """WITH a AS (SELECT DISTINCT rtrim(url, '/') AS url FROM crawled_urls WHERE lower(content_type) LIKE 'text/html%' AND status_code = 200 AND is_indexable), b AS (SELECT DISTINCT rtrim(url, '/') AS url FROM crawled_urls)
SELECT b.url, CASE WHEN a.url IS NULL THEN 'crawl' ELSE 'both' END AS place FROM b LEFT JOIN a ON a.url = b.url""",
)


def _stream(spark, d):
    schema = table(spark, d, "events").schema
    # The path is a pattern, as a stream reads folders and the table may be one file.
    return streams.read_events(spark, f"{d}/event[s].parquet", schema).withColumn("ts", F.col("ts").cast("timestamp"))


def _kept(spark, stream, mode: str):
    return spark.read.parquet(streams.run_batches(stream, mode) + "/*")


def stream_windows(spark, d):
    rows = _kept(spark, streams.windowed(_stream(spark, d)), "update").groupBy("window_start", "event_type").agg(F.max_by("n", "n").alias("n"), F.max_by("total", "n").alias("total"))
    return rows.select(F.unix_micros("window_start").alias("window_start"), "event_type", "n", F.round("total", 2).alias("total"))


add("stream_windows", stream_windows, "SELECT epoch_us(date_trunc('hour', ts)) AS window_start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2")
add("stream_counters", lambda spark, d: _kept(spark, streams.running_counters(_stream(spark, d)), "complete"), "SELECT event_type, count(*) AS n, min(value) AS least, max(value) AS most FROM events GROUP BY 1")
add("stream_first", lambda spark, d: _kept(spark, streams.first_deliveries(_stream(spark, d)).select("event_id"), "append"), "SELECT DISTINCT event_id FROM events")
add(
    "stream_progress",
    lambda spark, d: _kept(spark, streams.throttled_progress(_stream(spark, d)), "append").withColumn("ts", F.unix_micros("ts")),
    f"""WITH RECURSIVE e AS (SELECT user_id, epoch_us(ts) AS ts, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS seen FROM events),
w(user_id, seen, ts, told, since) AS (SELECT user_id, seen, ts, seen, ts FROM e WHERE seen = 1 UNION ALL
  SELECT e.user_id, e.seen, e.ts, CASE WHEN e.seen - told >= {streams.EVERY} OR e.ts - since >= {int(streams.SECONDS * 1e6)} THEN e.seen ELSE told END, CASE WHEN e.seen - told >= {streams.EVERY} OR e.ts - since >= {int(streams.SECONDS * 1e6)} THEN e.ts ELSE since END
  FROM w JOIN e ON e.user_id = w.user_id AND e.seen = w.seen + 1)
SELECT user_id, ts, seen FROM w WHERE told = seen""",
)
