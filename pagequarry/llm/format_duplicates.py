"""Records that differ only in formatting or in which field holds what.

Byte-identical raw rows collapse first, with counts; only their distinct
survivors are canonicalised and grouped again on the full canonical text.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagequarry.session import staged

_NOISE = r"[^\p{L}\p{N}]+"


def canonical(texts: list[str], lists: list[str]) -> Column:
    """All values lower-cased, without anything but letters and digits, sorted; values that are left empty are dropped."""
    values = F.concat(F.array(*[F.col(c) for c in texts]), *[F.coalesce(F.col(c), F.array().cast("array<string>")) for c in lists])
    clean = F.transform(values, lambda v: F.regexp_replace(F.lower(v), _NOISE, ""))
    return F.array_join(F.array_sort(F.filter(clean, lambda v: v.isNotNull() & (v != ""))), "|")


def _survivors(df: DataFrame, record_id: str, scope: str, texts: list[str], lists: list[str]) -> tuple[DataFrame, DataFrame]:
    """The distinct raw rows of every scope with their canonical text, smallest id and number of ids; and all ids with the raw row they have.

    A raw row is known by the MD5 of its bytes, which every shuffle but the
    first carries in place of the row.
    """
    t, k = [f"t{i}" for i in range(len(texts))], [f"l{i}" for i in range(len(lists))]
    named = df.select(
        F.col(record_id).alias("id"), F.col(scope).alias("scope"), *[F.col(c).alias(n) for c, n in zip(texts, t, strict=True)], *[F.col(c).alias(n) for c, n in zip(lists, k, strict=True)]
    )
    filled = [F.coalesce(F.col(n), F.lit("")) != "" for n in t] + [F.coalesce(F.size(n), F.lit(0)) > 0 for n in k]
    raw = F.unhex(F.md5(F.to_json(F.struct(*t, *k), {"ignoreNullFields": "false"}).cast("binary")))
    rows = named.where(F.col("id").isNotNull() & F.col("scope").isNotNull() & reduce(lambda a, b: a | b, filled)).withColumn("raw", raw)
    members = rows.select("id", "scope", "raw").dropDuplicates(["id"])
    counts = members.groupBy("scope", "raw").agg(F.min("id").alias("first_id"), F.count("*").alias("n"))
    distinct = rows.groupBy("scope", "raw").agg(*[F.first(c).alias(c) for c in (*t, *k)])
    text = distinct.select("scope", "raw", canonical(t, k).alias("canonical")).where(F.col("canonical") != "")
    return staged(text.join(counts, ["scope", "raw"]), "distinct-rows"), members


def _groups(survivors: DataFrame) -> DataFrame:
    return survivors.groupBy("scope", "canonical").agg(F.min("first_id").alias("keep_id"), F.sum("n").alias("copies"))


def collapse(df: DataFrame, record_id: str, scope: str, texts: list[str], lists: list[str]) -> DataFrame:
    """One row per distinct record of a scope: scope, keep_id (the smallest id), copies (how many ids it stands for).

    Rows with the same id are one record.  Two records are the same when
    their canonical values agree with multiplicity, in whatever field.  Nulls
    and empty values don't count; a record without any value, without id or
    without scope is left out.  Other columns are not read.
    """
    return _groups(_survivors(df, record_id, scope, texts, lists)[0]).select("scope", "keep_id", "copies")


def copies(df: DataFrame, record_id: str, scope: str, texts: list[str], lists: list[str]) -> DataFrame:
    """Membership: keep_id and copy_id for every record but the kept one of each group.

    Both joins leave out what has no copy.  A raw row that a third of the
    records share is a skewed partition of ids that the adaptive join splits,
    its other side being one row.
    """
    survivors, members = _survivors(df, record_id, scope, texts, lists)
    shared = _groups(survivors).where(F.col("copies") > 1)
    kept = survivors.join(shared, ["scope", "canonical"]).select("scope", "raw", "keep_id")
    found = members.join(kept, ["scope", "raw"]).select("keep_id", F.col("id").alias("copy_id"))
    return found.where(F.col("keep_id") != F.col("copy_id"))
