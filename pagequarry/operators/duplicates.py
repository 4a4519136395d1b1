"""Near-duplicate texts by SimHash: exact search within a few bits, then classes."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagequarry.functions.text import simhash, word_count
from pagequarry.session import cut, staged

C = F.col
_CUTS = [0, 11, 22, 33, 43, 53, 64]
LEAST_WORDS, MOST_BITS = 50, 3


def fingerprints(texts: DataFrame, text_id: str, text: str) -> DataFrame:
    """id and fingerprint of texts of at least 50 words; null and shorter texts have none."""
    t = texts.select(F.col(text_id).alias("id"), F.col(text).alias("text")).where(C("text").isNotNull() & (word_count(C("text")) >= LEAST_WORDS))
    return t.select("id", simhash("text").alias("fingerprint")).where("fingerprint <> 0")


_TABLES = list(combinations(range(6), 3))


def _keyed(values: DataFrame) -> DataFrame:
    """fingerprint, t, k: each distinct fingerprint in the bucket of every choice of three of six blocks.

    Of fingerprints that differ in at most 3 bits at least three blocks are
    equal, so they share a bucket; three blocks are about 32 bits, so that
    buckets are met by chance only rarely.
    """
    f = C("fingerprint")
    blocks = [F.shiftrightunsigned(f, a).bitwiseAND(F.lit((1 << (b - a)) - 1)) for a, b in zip(_CUTS, _CUTS[1:], strict=False)]
    keys = [F.struct(F.lit(i).alias("t"), F.xxhash64(*[blocks[j] for j in chosen]).alias("k")) for i, chosen in enumerate(_TABLES)]
    return values.select("fingerprint").distinct().select("fingerprint", F.explode(F.array(*keys)).alias("x")).select("fingerprint", "x.t", "x.k")


def near_pairs(values: DataFrame) -> DataFrame:
    """a < b: distinct fingerprints (column fingerprint) that differ in at most 3 bits, all of them. Classes don't need them all: ``near_classes``."""
    masks = [(1 << b) - (1 << a) for a, b in zip(_CUTS, _CUTS[1:], strict=False)]
    keyed = _keyed(values)
    a, b = keyed.withColumnRenamed("fingerprint", "a"), keyed.withColumnRenamed("fingerprint", "b")
    differ = C("a").bitwiseXOR(C("b"))
    signed = [m - (1 << 64) if m >= 1 << 63 else m for m in masks]
    first = F.lit(False)  # a pair met in several tables counts in the one of its first three equal blocks
    for i, chosen in enumerate(_TABLES):
        here = C("t") == i
        for j in range(chosen[-1]):
            if j not in chosen:
                here = here & (differ.bitwiseAND(F.lit(signed[j]).cast("bigint")) != 0)
        first = first | here
    return a.join(b, ["t", "k"]).where((C("a") < C("b")) & (F.bit_count(differ) <= MOST_BITS) & first).select("a", "b")


def components(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, root: the smallest node each is connected with, by hooking every node to the least root around and shortening paths."""
    edges = staged(pairs.select("a", "b").unionByName(pairs.select(C("b").alias("a"), C("a").alias("b"))), "component-links")
    roots = cut(nodes.select("node", C("node").alias("root")))
    while True:
        least = edges.join(roots.select(C("node").alias("b"), "root"), "b").groupBy(C("a").alias("node")).agg(F.min("root").alias("near"))
        hooked = roots.join(least, "node", "left").select("node", "root", F.least("root", F.coalesce("near", "root")).alias("to"))
        lowest = hooked.groupBy("root").agg(F.min("to").alias("to"))  # a whole tree goes where its least neighbour is
        moved = cut(roots.join(lowest, "root").select("node", "root", "to"))
        jump = moved.groupBy(C("root").alias("to")).agg(F.min("to").alias("beyond"))
        new = cut(moved.join(jump, "to", "left").select("node", F.least("to", F.coalesce("beyond", "to")).alias("root"), C("root").alias("was")))
        if new.where("root <> was").isEmpty():
            return new.select("node", "root")
        roots = new.select("node", "root")


def near_classes(values: DataFrame) -> DataFrame:
    """node, root: every distinct fingerprint with the smallest one that a chain of steps of at most 3 bits leads to.

    Each bucket's members are first linked with its smallest, where near
    enough.  A link within a class so found tells nothing new, so only buckets
    that hold several classes are looked at again, and there only members
    outside the bucket's largest class are compared with the others.
    """
    near = F.bit_count(C("a").bitwiseXOR(C("b"))) <= MOST_BITS
    keyed = staged(_keyed(values), "near-keys")
    least = keyed.groupBy("t", "k").agg(F.min("fingerprint").alias("a"), F.max("fingerprint").alias("b")).where("a <> b").drop("b")
    members = keyed.join(least, ["t", "k"]).select("t", "k", "a", C("fingerprint").alias("b"))
    stars = members.where((C("a") != C("b")) & near).select("a", "b").distinct()
    first = staged(components(stars, keyed.select(C("fingerprint").alias("node")).distinct()), "near-stars")

    tagged = keyed.join(least.select("t", "k"), ["t", "k"]).join(first.withColumnRenamed("node", "fingerprint"), "fingerprint")
    sizes = tagged.groupBy("t", "k", "root").agg(F.count("*").alias("n"))
    mixed = sizes.groupBy("t", "k").agg(F.max_by("root", F.struct("n", "root")).alias("largest"), F.count("*").alias("roots")).where("roots > 1").drop("roots")
    rows = staged(tagged.join(mixed, ["t", "k"]), "near-mixed")
    some = rows.where("root <> largest").select("t", "k", C("fingerprint").alias("a"), C("root").alias("root_a"))
    others = rows.select("t", "k", C("fingerprint").alias("b"), C("root").alias("root_b"))
    links = staged(some.join(others, ["t", "k"]).where((C("root_a") != C("root_b")) & near).select(F.least("root_a", "root_b").alias("a"), F.greatest("root_a", "root_b").alias("b")).distinct(), "near-links")
    if links.isEmpty():
        return first
    ends = links.select(C("a").alias("node")).union(links.select(C("b").alias("node"))).distinct()
    joined = components(links, ends).select(C("node").alias("root"), C("root").alias("_root"))
    return first.join(joined, "root", "left").select("node", F.coalesce("_root", "root").alias("root"))


def near_duplicates(texts: DataFrame, text_id: str, text: str) -> DataFrame:
    """id, class_id (the smallest id of the class), class_size: one row per text with a near duplicate.

    Texts of equal fingerprint collapse to one before the search; copies are
    never expanded into pairs.
    """
    f = staged(fingerprints(texts, text_id, text), "fingerprints")
    values = f.select("fingerprint").distinct()
    roots = near_classes(values)
    rooted = f.join(roots.withColumnRenamed("node", "fingerprint"), "fingerprint")
    classes = rooted.groupBy("root").agg(F.min("id").alias("class_id"), F.count("*").alias("class_size")).where("class_size > 1")
    return rooted.join(classes, "root").select("id", "class_id", "class_size")
