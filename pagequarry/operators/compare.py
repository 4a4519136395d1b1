"""Crawls against earlier crawls: page by page comparison and alerts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagequarry.functions.common import ok

C = F.col
_COMPARED = ["status_code", "title", "word_count", "is_indexable"]


def newest_pairs(crawls: DataFrame) -> DataFrame:
    """project_id, a, b: the newest completed crawl of each project (b) and the newest other one (a)."""
    done = crawls.dropDuplicates(["id"]).where("status = 'completed'")
    order = Window.partitionBy("project_id").orderBy(C("completed_at").desc_nulls_last(), C("id").desc())
    ranked = done.select("project_id", "id", F.row_number().over(order).alias("r")).where("r <= 2")
    return ranked.groupBy("project_id").agg(F.max(F.when(C("r") == 2, C("id"))).alias("a"), F.max(F.when(C("r") == 1, C("id"))).alias("b"))


def compare(pages: DataFrame, pairs: DataFrame) -> DataFrame:
    """b, url, change_type and both sides' values, for every pair of crawls at once.

    Full outer join on the address; a row counts as changed when status,
    title, words or indexability differ, null equal to null.  Several rows of
    one address in a crawl meet each other, as they are stored.
    """
    side = lambda name: pages.select(C("crawl_id").alias(name), "url", *[C(c).alias(f"{name}_{c}") for c in [*_COMPARED, "response_time_ms"]]).join(pairs.where("a is not null").select("a", "b"), name)
    both = side("a").join(side("b").drop("a"), ["b", "url"], "full")
    differ = F.lit(False)
    for c in _COMPARED:
        differ = differ | ~C(f"a_{c}").eqNullSafe(C(f"b_{c}"))
    kind = F.when(C("a_is_indexable").isNull(), "added").when(C("b_is_indexable").isNull(), "removed").when(differ, "changed").otherwise("unchanged")
    return both.select("b", "url", kind.alias("change_type"), *[f"{s}_{c}" for c in [*_COMPARED, "response_time_ms"] for s in ("a", "b")])


def alerts(crawls: DataFrame, pages: DataFrame, issues: DataFrame, health: DataFrame) -> DataFrame:
    """project_id, crawl_id, alert_type, severity, before, after: what to report on each project's newest completed crawl."""
    p = pages.groupBy("crawl_id").agg(F.count("*").alias("pages"), F.count_if(C("status_code") >= 400).alias("errors"), F.avg(F.when(ok(), C("response_time_ms"))).alias("ms"))
    i = issues.groupBy("crawl_id").agg(F.count("*").alias("issues"), F.count_if(C("severity") == "critical").alias("critical"))
    facts = p.join(i, "crawl_id", "left").na.fill(0, ["issues", "critical"]).join(health.select("crawl_id", "score"), "crawl_id", "left")
    side = lambda s: facts.select(*[C(c).alias(f"{s}_{c}" if c != "crawl_id" else s) for c in facts.columns])
    x = newest_pairs(crawls).join(side("b"), "b").join(side("a"), "a", "left")
    rate = lambda s: C(f"{s}_errors") / C(f"{s}_pages")
    diff = C("b_score") - C("a_score")
    rules = [
        (diff <= -10, "health_regression", F.when(diff <= -20, "critical").otherwise("warning"), C("a_score"), C("b_score")),
        (diff >= 10, "health_improvement", F.lit("info"), C("a_score"), C("b_score")),
        (C("b_score") < 50, "low_health", F.lit("critical"), F.lit(None), C("b_score")),
        (rate("b") > rate("a") + 0.05, "error_spike", F.lit("warning"), rate("a"), rate("b")),
        (C("b_errors") > 10, "high_errors", F.when(C("b_errors") >= 50, "critical").otherwise("warning"), F.lit(None), C("b_errors")),
        (C("b_critical") > 0, "critical_issues", F.lit("critical"), F.lit(None), C("b_critical")),
        (C("b_issues") - C("a_issues") > 10, "issues_increased", F.lit("warning"), C("a_issues"), C("b_issues")),
        (C("b_ms") > 3000, "slow_site", F.lit("warning"), F.lit(None), C("b_ms")),
    ]
    rows = F.array_compact(F.array(*[F.when(test, F.struct(F.lit(kind).alias("alert_type"), severity.alias("severity"), F.round(a.cast("double"), 4).alias("before"), F.round(b.cast("double"), 4).alias("after"))) for test, kind, severity, a, b in rules]))
    return x.select("project_id", C("b").alias("crawl_id"), F.explode(rows).alias("r")).select("project_id", "crawl_id", "r.*")
