"""Queries of the training-data problems, by name, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagequarry.llm import encoding_repair, format_duplicates, leakage, mixing, quantiles, seen, shared_spans
from pagequarry.session import staged, table

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PERCENTILES = [0.25, 0.5, 0.75, 0.95, 0.99]
_PAGE = (["title", "meta_description"], ["h1"])


def _garbled(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "crawled_urls").select("id", "title", "meta_description")
    model = encoding_repair.fit(pages.select(F.explode(F.array("title", "meta_description")).alias("text")), "text")
    return encoding_repair.repair(pages, "id", ["title", "meta_description"], model)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return _garbled(spark, d).select("id", "field").distinct()


def p1_repaired(spark: SparkSession, d: str) -> DataFrame:
    return _garbled(spark, d).dropDuplicates(["id", "field"])


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return format_duplicates.copies(table(spark, d, "crawled_urls"), "id", "crawl_id", *_PAGE)


def p2_records(spark: SparkSession, d: str) -> DataFrame:
    return format_duplicates.collapse(table(spark, d, "crawled_urls"), "id", "crawl_id", *_PAGE).withColumnRenamed("scope", "crawl_id")


def _arrivals(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "crawled_urls").select("id", "url_hash", "crawled_at")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return seen.repeats(_arrivals(spark, d), "url_hash", "crawled_at", "id").where("repeat").select("id")


def p5_report(spark: SparkSession, d: str) -> DataFrame:
    answers = seen.repeats(_arrivals(spark, d), "url_hash", "crawled_at", "id")
    return seen.error_report(answers, _arrivals(spark, d), "url_hash", "crawled_at", "id")


def _response_times(spark: SparkSession, d: str) -> DataFrame:
    media = F.coalesce(F.lower(F.trim(F.split("content_type", ";")[0])), F.lit(""))
    return table(spark, d, "crawled_urls").select("id", "crawl_id", media.alias("content_type"), "response_time_ms").dropDuplicates(["id"])


_BY = ["crawl_id", "content_type"]


def p6_percentiles(spark: SparkSession, d: str) -> DataFrame:
    nodes = staged(quantiles.digest(_response_times(spark, d), _BY, "response_time_ms"), "digest")
    return quantiles.percentiles(nodes, _BY, PERCENTILES)


def p6_sites(spark: SparkSession, d: str) -> DataFrame:
    """Percentiles per content type over all crawls, from the merged digests of the single crawls."""
    nodes = quantiles.digest(_response_times(spark, d), _BY, "response_time_ms")
    merged = staged(quantiles.merge([nodes.drop("crawl_id")], ["content_type"]), "digest")
    return quantiles.percentiles(merged, ["content_type"], PERCENTILES)


def p6_bounds(spark: SparkSession, d: str) -> DataFrame:
    """Whether every answer keeps its bound against exact ranks."""
    rows = staged(_response_times(spark, d).where(F.col("response_time_ms").isNotNull()), "response-times")
    nodes = staged(quantiles.digest(rows, _BY, "response_time_ms"), "digest")
    counts = rows.groupBy(*_BY, F.col("response_time_ms").alias("x")).agg(F.count("*").alias("c"))
    exact = (
        quantiles.percentiles(nodes, _BY, PERCENTILES).join(counts, _BY)
        .groupBy(*_BY, "n", "p", "value", "rank_low", "rank_high")
        .agg(F.sum(F.when(F.col("x") <= F.col("value"), F.col("c")).otherwise(0)).alias("le"), F.sum(F.when(F.col("x") < F.col("value"), F.col("c")).otherwise(0)).alias("lt"))
    )
    error, rank = F.lit(quantiles.RANK_ERROR) * F.col("n"), F.greatest(F.ceil(F.col("p") * F.col("n") - 1e-9), F.lit(1))
    kept = F.col("le").between(F.col("rank_low"), F.col("rank_high")) & (rank <= F.col("le") + error) & (F.col("lt") < rank + error)
    return exact.select(*_BY, "n", "p", kept.alias("within_bound"))


def _leaks(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaks(table(spark, d, "documents"), table(spark, d, "eval_items"), "doc_id", "text", "item_id", "item_text")


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return _leaks(spark, d).select("doc_id", "item_id")


def p8_items(spark: SparkSession, d: str) -> DataFrame:
    """Per leaked item: in how many documents, and the largest share of it found in one."""
    return _leaks(spark, d).groupBy("item_id").agg(F.count("*").alias("documents"), F.round(F.max("containment"), 6).alias("most"))


def _mix(spark: SparkSession, d: str) -> DataFrame:
    docs = mixing.with_tokens(table(spark, d, "documents"), "text", VOCABULARY, ["doc_id", "source"])
    return mixing.mix(docs, table(spark, d, "mix_targets"), "doc_id", "source")


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d)


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.shares(staged(_mix(spark, d), "mix"), table(spark, d, "mix_targets"), "doc_id")


def _spans(spark: SparkSession, d: str) -> DataFrame:
    return shared_spans.shared_spans(table(spark, d, "documents"), "doc_id", "text")


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return _spans(spark, d).select(F.col("doc_a").alias("doc_id_a"), F.col("doc_b").alias("doc_id_b")).distinct()


def p10_shares(spark: SparkSession, d: str) -> DataFrame:
    return shared_spans.shared_shares(staged(_spans(spark, d), "spans"), table(spark, d, "documents"), "doc_id", "text")


QUERIES = {f.__name__: f for f in (p1_found, p1_repaired, p2_found, p2_records, p5_found, p5_report, p6_percentiles, p6_sites, p6_bounds, p8_found, p8_items, p9_mix, p9_shares, p10_found, p10_shares)}

_COPIES = r"""
WITH pages AS (SELECT DISTINCT id, crawl_id, title, meta_description, h1 FROM crawled_urls),
texts AS (SELECT id, crawl_id, unnest(list_concat([title, meta_description], coalesce(h1, []))) AS v FROM pages),
clean AS (SELECT id, crawl_id, regexp_replace(lower(v), '[^\p{L}\p{N}]', '', 'g') AS v FROM texts WHERE v IS NOT NULL),
canon AS (SELECT id, crawl_id, string_agg(v, '|' ORDER BY v) AS v FROM clean WHERE v <> '' GROUP BY id, crawl_id),
kept AS (SELECT id, crawl_id, min(id) OVER (PARTITION BY crawl_id, v) AS keep_id FROM canon)
"""

_LEAKS = r"""WITH i0 AS (SELECT item_id, regexp_extract_all(lower(item_text), '[\p{L}\p{N}]+') AS w FROM eval_items), i AS (SELECT item_id, w, least(len(w), 12) AS n FROM i0 WHERE len(w) > 0),
iw AS (SELECT DISTINCT item_id, n, array_to_string(w[k:k + n - 1], ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS k FROM i)),
d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents),
dw AS (SELECT DISTINCT doc_id, n, array_to_string(w[k:k + n - 1], ' ') AS g FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, (SELECT DISTINCT n FROM i)))"""

SQL = {
    "p2_found": _COPIES + "SELECT keep_id, id AS copy_id FROM kept WHERE id <> keep_id",
    "p2_records": _COPIES + "SELECT crawl_id, keep_id, count(*) AS copies FROM kept GROUP BY crawl_id, keep_id",
    "p5_found": """SELECT DISTINCT id FROM (SELECT id, first_value(id) OVER (PARTITION BY url_hash ORDER BY crawled_at, id) AS f
  FROM crawled_urls WHERE url_hash IS NOT NULL) WHERE id <> f""",
    "p5_report": """WITH k AS (SELECT DISTINCT id, url_hash, crawled_at FROM crawled_urls)
SELECT count(*) AS records, count(*) - count(DISTINCT url_hash) AS repeats, CAST(0 AS BIGINT) AS wrong, CAST(0 AS DOUBLE) AS wrong_rate FROM k""",
    "p6_bounds": """SELECT crawl_id, content_type, n, p, true AS within_bound FROM (
  SELECT crawl_id, coalesce(lower(trim(split_part(content_type, ';', 1))), '') AS content_type, count(*) AS n
  FROM (SELECT DISTINCT id, crawl_id, content_type, response_time_ms FROM crawled_urls) WHERE response_time_ms IS NOT NULL GROUP BY ALL),
  (SELECT unnest([0.25, 0.5, 0.75, 0.95, 0.99])::DOUBLE AS p)""",
    "p8_found": _LEAKS + " SELECT DISTINCT doc_id, item_id FROM dw JOIN iw USING (n, g)",
    "p8_items": _LEAKS
    + """, n AS (SELECT item_id, count(*) AS total FROM iw GROUP BY item_id), f AS (SELECT doc_id, item_id, count(*) AS found FROM dw JOIN iw USING (n, g) GROUP BY ALL)
SELECT item_id, count(*) AS documents, round(max(found / total), 6) AS most FROM f JOIN n USING (item_id) GROUP BY item_id""",
    "p10_found": """WITH d AS (SELECT doc_id, text FROM documents WHERE length(text) >= 300), g AS (SELECT DISTINCT doc_id, md5(substr(text, k, 300)) AS h FROM (SELECT doc_id, text, unnest(range(1, length(text) - 298)) AS k FROM d)),
r AS (SELECT h FROM g GROUP BY h HAVING count(*) > 1), m AS (SELECT doc_id, h FROM g JOIN r USING (h))
SELECT DISTINCT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b FROM m a JOIN m b ON a.h = b.h AND a.doc_id < b.doc_id""",
    "p10_shares": """WITH d AS (SELECT DISTINCT ON (doc_id) doc_id, text FROM documents), g AS (SELECT doc_id, k, md5(substr(text, k, 300)) AS h FROM (SELECT doc_id, text, unnest(range(1, length(text) - 298)) AS k FROM d WHERE length(text) >= 300)),
r AS (SELECT h FROM g GROUP BY h HAVING min(doc_id) <> max(doc_id)), m AS (SELECT doc_id, k, lead(k) OVER (PARTITION BY doc_id ORDER BY k) AS n FROM g JOIN r USING (h)),
c AS (SELECT doc_id, sum(least(coalesce(n - k, 300), 300)) AS shared FROM m GROUP BY 1)
SELECT doc_id, length(text) AS chars, CAST(coalesce(shared, 0) AS BIGINT) AS shared_chars, CASE WHEN shared > 0 THEN round(shared / length(text), 6) ELSE 0.0 END AS share FROM d LEFT JOIN c USING (doc_id)""",
}
