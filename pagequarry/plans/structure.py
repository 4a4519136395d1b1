"""Queries of the general data problems: hierarchies, snapshot changes, nested records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagequarry.operators import hierarchy, nested, snapshots
from pagequarry.session import staged, table


def _redirect_tree(spark: SparkSession, d: str) -> hierarchy.Hierarchy:
    return hierarchy.resolve(table(spark, d, "redirects"), "crawl_id", "source_url", "target_url")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    nodes = _redirect_tree(spark, d).nodes
    return nodes.select(F.col("scope").alias("crawl_id"), F.col("node").alias("url"), F.col("root").alias("root_url"), "depth")


def p3_paths(spark: SparkSession, d: str) -> DataFrame:
    nodes = _redirect_tree(spark, d).nodes
    return nodes.select(F.col("scope").alias("crawl_id"), F.col("node").alias("url"), "depth", F.array_join(F.reverse("path"), " > ").alias("path"))


def p3_descendants(spark: SparkSession, d: str) -> DataFrame:
    pairs = _redirect_tree(spark, d).descendants()
    return pairs.select(F.col("scope").alias("crawl_id"), F.col("ancestor").alias("url"), F.col("descendant").alias("leads_here"), F.col("distance").alias("hops"))


def _site_snapshots(spark: SparkSession, d: str) -> DataFrame:
    crawls = table(spark, d, "crawls").where((F.col("status") == "completed") & (F.col("mode") == "spider"))
    return snapshots.number_snapshots(crawls, "project_id", "id", "started_at")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "crawled_urls")
    found = snapshots.snapshot_changes(pages, _site_snapshots(spark, d), "crawl_id", "url", ["status_code", "title"], ["crawled_at", "id"])
    return found.select(F.col("snapshot").alias("crawl_id"), F.col("key").alias("url"), "change_type")


def p4_summary(spark: SparkSession, d: str) -> DataFrame:
    return p4_found(spark, d).groupBy("crawl_id").pivot("change_type", ["added", "removed", "changed"]).count().na.fill(0)


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    rows = nested.elements(table(spark, d, "crawled_urls"), "id", "seo_data")
    return rows.select(F.col("record_id").alias("id"), "node_path", "parent_path")


def p7_columns(spark: SparkSession, d: str) -> DataFrame:
    found = nested.table_columns(nested.json_triples(table(spark, d, "crawled_urls"), "id", "seo_data"))
    return found.select("table_path", "column", "n")


def p7_tables(spark: SparkSession, d: str) -> DataFrame:
    return nested.flat_tables(table(spark, d, "crawled_urls"), "id", "seo_data").withColumnRenamed("record_id", "id")


def p7_images(spark: SparkSession, d: str) -> DataFrame:
    rows = nested.json_triples(table(spark, d, "crawled_urls"), "id", "seo_data")
    flat = nested.pivot_table(rows, "images[]", ["src", "alt", "width", "height"])
    return flat.select(F.col("record_id").alias("id"), "node_path", "ordinal", "src", "alt", "width", "height")


def _offers(triples: DataFrame) -> DataFrame:
    """Offers under whatever holds them, each with the name of its product."""
    offers = nested.objects_under(triples, "offers", ["price", "priceCurrency"])
    names = nested.field_of_objects(triples, "name")
    return offers.join(names, ["record_id", "holder_path"], "left").select(
        F.col("record_id").alias("id"), "node_path", "parent_path", F.col("name").alias("product"), "price", F.col("priceCurrency").alias("currency")
    )


def p7_offers(spark: SparkSession, d: str) -> DataFrame:
    rows = nested.json_triples(table(spark, d, "crawled_urls"), "id", "seo_data")
    needed = F.col("node_path").contains("offers") | F.col("column").contains("offers") | (F.col("column") == "name") | F.col("column").endswith(".name")
    return _offers(staged(rows.where(needed), "nested-triples"))


QUERIES = {f.__name__: f for f in (p3_found, p3_paths, p3_descendants, p4_found, p4_summary, p7_found, p7_columns, p7_tables, p7_images, p7_offers)}

_TREE = """
WITH RECURSIVE e AS (SELECT DISTINCT crawl_id, source_url AS c, target_url AS p FROM redirects),
nodes AS (SELECT crawl_id, c AS u FROM e UNION SELECT crawl_id, p FROM e),
down(crawl_id, u, root, depth, path) AS (
  SELECT n.crawl_id, n.u, n.u, 0, n.u FROM nodes n
  WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.crawl_id = n.crawl_id AND e.c = n.u)
  UNION ALL
  SELECT e.crawl_id, e.c, d.root, d.depth + 1, e.c || ' > ' || d.path
  FROM down d JOIN e ON e.crawl_id = d.crawl_id AND e.p = d.u),
rest AS (SELECT n.crawl_id, n.u FROM nodes n
  WHERE NOT EXISTS (SELECT 1 FROM down d WHERE d.crawl_id = n.crawl_id AND d.u = n.u)),
walk(crawl_id, s, u) AS (
  SELECT r.crawl_id, r.u, e.p FROM rest r JOIN e ON e.crawl_id = r.crawl_id AND e.c = r.u
  UNION
  SELECT w.crawl_id, w.s, e.p FROM walk w JOIN e ON e.crawl_id = w.crawl_id AND e.c = w.u),
ends AS (SELECT r.crawl_id, r.u, CASE WHEN EXISTS (SELECT 1 FROM walk w
  WHERE w.crawl_id = r.crawl_id AND w.s = r.u AND w.u = r.u) THEN -1 ELSE -2 END AS depth FROM rest r)
"""

_CHANGES = """
WITH snaps AS (
  SELECT id, project_id, row_number() OVER (PARTITION BY project_id ORDER BY started_at NULLS FIRST, id) AS seq
  FROM (SELECT DISTINCT id, project_id, started_at FROM crawls WHERE status = 'completed' AND mode = 'spider')),
latest AS (
  SELECT crawl_id, url, status_code, title FROM crawled_urls
  QUALIFY row_number() OVER (PARTITION BY crawl_id, url ORDER BY crawled_at DESC, id DESC) = 1),
pages AS (SELECT s.project_id, s.seq, l.* FROM latest l JOIN snaps s ON s.id = l.crawl_id),
pairs AS (SELECT b.id AS crawl_id, a.project_id, a.seq FROM snaps a JOIN snaps b ON b.project_id = a.project_id AND b.seq = a.seq + 1),
changes AS (
  SELECT q.crawl_id, n.url, 'added' AS change_type FROM pairs q
  JOIN pages n ON n.project_id = q.project_id AND n.seq = q.seq + 1
  LEFT JOIN pages o ON o.project_id = q.project_id AND o.seq = q.seq AND o.url = n.url WHERE o.url IS NULL
  UNION ALL
  SELECT q.crawl_id, o.url, 'removed' FROM pairs q
  JOIN pages o ON o.project_id = q.project_id AND o.seq = q.seq
  LEFT JOIN pages n ON n.project_id = q.project_id AND n.seq = q.seq + 1 AND o.url = n.url WHERE n.url IS NULL
  UNION ALL
  SELECT q.crawl_id, n.url, 'changed' FROM pairs q
  JOIN pages n ON n.project_id = q.project_id AND n.seq = q.seq + 1
  JOIN pages o ON o.project_id = q.project_id AND o.seq = q.seq AND o.url = n.url
  WHERE o.status_code IS DISTINCT FROM n.status_code OR o.title IS DISTINCT FROM n.title)
"""

#: Every node of every document: its number, its parent's, type, path and value.
_NODES = r"""WITH doc0 AS (SELECT DISTINCT id, CASE WHEN json_valid(seo_data) THEN CAST(seo_data AS JSON) END AS j FROM crawled_urls),
s AS (SELECT id, CASE WHEN json_type(j) = 'VARCHAR' THEN CASE WHEN json_valid(j->>'$') THEN CAST(j->>'$' AS JSON) END ELSE j END AS doc FROM doc0),
t AS (SELECT s.id, t.id AS n, t.parent AS up, t.type, replace(regexp_replace(t.fullkey, '^\$\.?', ''), '"', '') AS p, t.value AS v FROM s, json_tree(s.doc) t WHERE s.doc IS NOT NULL)"""

SQL = {
    "p3_found": _TREE + "SELECT crawl_id, u AS url, root AS root_url, CAST(depth AS INTEGER) AS depth FROM down UNION ALL SELECT crawl_id, u, '', depth FROM ends",
    "p3_paths": _TREE + "SELECT crawl_id, u AS url, CAST(depth AS INTEGER) AS depth, path FROM down UNION ALL SELECT crawl_id, u, depth, u FROM ends",
    "p3_descendants": _TREE.rstrip()
    + """,
up(crawl_id, s, u, hops) AS (
  SELECT d.crawl_id, d.u, e.p, 1 FROM down d JOIN e ON e.crawl_id = d.crawl_id AND e.c = d.u
  UNION ALL
  SELECT w.crawl_id, w.s, e.p, w.hops + 1 FROM up w JOIN e ON e.crawl_id = w.crawl_id AND e.c = w.u)
SELECT crawl_id, u AS url, s AS leads_here, CAST(hops AS INTEGER) AS hops FROM up""",
    "p4_found": _CHANGES + "SELECT crawl_id, url, change_type FROM changes",
    "p4_summary": _CHANGES
    + """SELECT crawl_id, count(*) FILTER (change_type = 'added') AS added, count(*) FILTER (change_type = 'removed') AS removed,
  count(*) FILTER (change_type = 'changed') AS changed FROM changes GROUP BY crawl_id""",
    "p7_found": _NODES
    + """, e AS MATERIALIZED (SELECT a.id, a.p AS node_path FROM t a JOIN t b ON b.id = a.id AND b.n = a.up WHERE a.type = 'OBJECT' AND b.type = 'ARRAY')
SELECT e.id, e.node_path, coalesce((SELECT max_by(o.node_path, length(o.node_path)) FROM e o WHERE o.id = e.id AND length(o.node_path) < length(e.node_path) AND starts_with(e.node_path, o.node_path)), '') AS parent_path FROM e""",
    "p7_columns": _NODES
    + r""", leaf AS (SELECT p, regexp_extract(p, '^(.*\])', 1) AS e FROM t WHERE type NOT IN ('OBJECT', 'ARRAY'))
SELECT regexp_replace(e, '\[\d+\]', '[]', 'g') AS table_path, CASE WHEN e = p THEN 'value' ELSE ltrim(substr(p, length(e) + 1), '.') END AS "column", count(*) AS n FROM leaf GROUP BY ALL""",
    "p7_images": _NODES
    + r""", i AS (SELECT id, p AS node_path, CAST(regexp_extract(p, '(\d+)\]$', 1) AS INTEGER) AS ordinal, v FROM t WHERE regexp_full_match(p, 'images\[\d+\]'))
SELECT id, node_path, ordinal, v->>'$.src' AS src, v->>'$.alt' AS alt, v->>'$.width' AS width, v->>'$.height' AS height FROM i""",
    "p7_offers": _NODES
    + r""", o AS (SELECT id, p, v, type, regexp_replace(p, '((^|\.)offers(\[\d+\])*)+$', '') AS holder FROM t WHERE regexp_matches(p, '(^|\.)offers(\[\d+\])+$') AND type <> 'ARRAY'
  OR regexp_matches(p, '(^|\.)offers$') AND type = 'OBJECT' AND v::VARCHAR <> '{}'),
h AS (SELECT id, p, v->>'$.name' AS name FROM t WHERE type = 'OBJECT' AND json_type(v, '$.name') NOT IN ('OBJECT', 'ARRAY')),
e AS (SELECT a.id, a.p FROM t a JOIN t b ON b.id = a.id AND b.n = a.up WHERE a.type = 'OBJECT' AND b.type = 'ARRAY')
SELECT o.id, o.p AS node_path, coalesce((SELECT max_by(e.p, length(e.p)) FROM e WHERE e.id = o.id AND length(e.p) < length(o.p) AND starts_with(o.p, e.p)), '') AS parent_path,
  h.name AS product, v->>'$.price' AS price, v->>'$.priceCurrency' AS currency
FROM o LEFT JOIN h ON h.id = o.id AND h.p = o.holder""",
}
