"""Column helpers shared by the operators: rounding, buckets, content types, per-group top lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def whole(c: Column) -> Column:
    """Nearest whole number, halves away from zero."""
    return F.round(c).cast("int")


def buckets(value: Column, bounds: list[tuple[float, str]], last: str) -> Column:
    """The label of the first bound a value lies below, else ``last``; null for null."""
    chosen = F.lit(last)
    for bound, label in reversed(bounds):
        chosen = F.when(value < bound, F.lit(label)).otherwise(chosen)
    return F.when(value.isNotNull(), chosen)


def top_per(df: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    """The first ``k`` rows of each group; ranks are cut off before the shuffle, so a large group sends k rows a task."""
    return df.withColumn("_rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_rank") <= k).drop("_rank")


def is_html(c: Column | str = "content_type") -> Column:
    return F.lower(F.col(c) if isinstance(c, str) else c).like("text/html%")


def ok(c: str = "status_code") -> Column:
    return F.col(c).between(200, 299)


def status_class(c: str = "status_code") -> Column:
    s = F.col(c)
    return (
        F.when(s.between(200, 299), "2xx").when(s.between(300, 399), "3xx").when(s.between(400, 499), "4xx").when(s.between(500, 599), "5xx").when(s.isNotNull(), "other")
    )


def _first_match(c: Column, rules: list[tuple[str, str]], default: str) -> Column:
    low = F.lower(c)
    chosen = F.lit(default)
    for pattern, label in reversed(rules):
        chosen = F.when(low.like(pattern), F.lit(label)).otherwise(chosen)
    return chosen


#: First match wins.
CONTENT_CLASSES = [("text/html%", "HTML"), ("%javascript%", "JavaScript"), ("text/css%", "CSS"), ("image/%", "Images"), ("%json%", "JSON"), ("%xml%", "XML"), ("%pdf%", "PDF"), ("%font%", "Fonts")]
RESOURCE_CLASSES = [("%javascript%", "JavaScript"), ("%css%", "CSS"), ("%image/%", "Image"), ("%font%", "Font"), ("%woff%", "Font"), ("%pdf%", "PDF"), ("%json%", "JSON"), ("%xml%", "XML"), ("%text/html%", "HTML")]


def content_class(c: str = "content_type") -> Column:
    """Null stays null."""
    return F.when(F.col(c).isNotNull(), _first_match(F.col(c), CONTENT_CLASSES, "Other"))


def resource_class(c: str = "content_type") -> Column:
    """Null is Other."""
    return F.coalesce(_first_match(F.col(c), RESOURCE_CLASSES, "Other"), F.lit("Other"))


def seo_document(c: str = "seo_data") -> Column:
    """The page's JSON document as a variant, null if it isn't complete JSON; one encoded twice is decoded twice."""
    once = F.try_parse_json(F.col(c))
    return F.when(F.schema_of_variant(once) == "STRING", F.try_parse_json(F.try_variant_get(once, "$", "string"))).otherwise(once)


def field(path: str, kind: str, document: str = "doc") -> Column:
    return F.try_variant_get(F.col(document), path, kind)
