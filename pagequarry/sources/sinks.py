"""Sinks: partitioned tables, CSV export, XML sitemap, HTML report."""

from __future__ import annotations

from html import escape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagequarry.functions.common import is_html

#: The exported columns in order.
EXPORT_COLUMNS = [
    "url", "status_code", "content_type", "title", "title_length", "title_pixel_width", "meta_description", "meta_desc_length",
    "h1", "h2", "canonical_url", "robots_meta", "is_indexable", "indexability_reason", "word_count", "crawl_depth",
    "response_time_ms", "redirect_url", "link_score", "text_ratio", "readability_score", "avg_words_per_sentence",
]


def write_table(df: DataFrame, path: str, mode: str = "append") -> None:
    """Parquet by crawl, so that a crawl's rows are one folder: pruned on read, dropped as a whole. A large crawl is split over several tasks."""
    df.hint("rebalance", "crawl_id").write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy("crawl_id").parquet(path)


def drop_crawls(spark, path: str, crawl_ids: list[str]) -> None:
    """Deletes the folders of the given crawls from a table that ``write_table`` wrote."""
    jvm = spark._jvm
    for crawl in crawl_ids:
        folder = jvm.org.apache.hadoop.fs.Path(path, f"crawl_id={crawl}")
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def split_valid(df: DataFrame, valid) -> tuple[DataFrame, DataFrame]:
    """Rows to store and rows to set aside; a null test sets aside."""
    test = F.coalesce(valid, F.lit(False))
    return df.where(test), df.where(~test)


def export_rows(pages: DataFrame) -> DataFrame:
    """The exported columns: lists joined by ' | ', null as '', by depth and address."""
    def shown(name: str):
        c = F.array_join(name, " | ") if dict(pages.dtypes)[name].startswith("array") else F.col(name).cast("string")
        return F.coalesce(c, F.lit("")).alias(name)

    return pages.orderBy("crawl_depth", "url").select(*[shown(c) for c in EXPORT_COLUMNS])


def write_csv(pages: DataFrame, path: str) -> None:
    export_rows(pages).write.option("header", True).option("emptyValue", "").csv(path)


def sitemap_rows(pages: DataFrame, all_statuses: bool = False, not_indexable: bool = False) -> DataFrame:
    """loc, lastmod, changefreq, priority of HTML pages that answered 200 and can be indexed."""
    p = pages.where(is_html())
    if not all_statuses:
        p = p.where("status_code = 200")
    if not not_indexable:
        p = p.where("is_indexable")
    d = F.col("crawl_depth")
    often = F.when(d == 0, "daily").when(d <= 2, "weekly").otherwise("monthly")
    weight = F.when(d == 0, "1.0").when(d == 1, "0.8").when(d == 2, "0.6").when(d <= 4, "0.4").otherwise("0.2")
    return p.select("crawl_id", F.col("url").alias("loc"), F.date_format("crawled_at", "yyyy-MM-dd").alias("lastmod"), often.alias("changefreq"), weight.alias("priority"))


def write_sitemap(pages: DataFrame, path: str) -> None:
    sitemap_rows(pages).drop("crawl_id").write.format("xml").option("rootTag", "urlset").option("rowTag", "url").save(path)


def html_report(title: str, sections: dict[str, DataFrame], most_rows: int | None = 100) -> str:
    """A page with one table for each report; reports are aggregates, and of longer ones the first rows are shown, or all where ``most_rows`` is None."""
    parts = [f"<!doctype html><html><head><meta charset='utf-8'><title>{escape(title)}</title></head><body><h1>{escape(title)}</h1>"]
    for name, df in sections.items():
        rows = (df if most_rows is None else df.limit(most_rows)).collect()
        head = "".join(f"<th>{escape(c)}</th>" for c in df.columns)
        body = "".join("<tr>" + "".join(f"<td>{escape('' if v is None else str(v))}</td>" for v in r) + "</tr>" for r in rows)
        parts.append(f"<h2>{escape(name)}</h2><table><thead><tr>{head}</tr></thead><tbody>{body}</tbody></table>")
    return "".join([*parts, "</body></html>"])
