import random

import numpy as np
from pyspark.sql import functions as F

from pagequarry.functions.text import _simhash
from pagequarry.operators import compare, duplicates, links
from pagequarry.operators.duplicates import components, near_classes, near_duplicates, near_pairs


def slow_simhash(text):
    flat = " ".join(text.lower().split())
    votes = [0] * 64
    for g in [flat[i : i + 3] for i in range(len(flat) - 2)] or [flat]:
        h = 14695981039346656037
        for b in g.encode():
            h = ((h ^ b) * 1099511628211) % 2**64
        votes = [v + (1 if h >> i & 1 else -1) for i, v in enumerate(votes)]
    return int(np.array(sum(1 << i for i in range(64) if votes[i] > 0), dtype=np.uint64).view(np.int64))


def test_simhash_against_plain_loop():
    for t in ["a", "Hello  World", "żółte książki — 12", "x" * 500, "The quick brown fox jumps"]:
        assert _simhash(t) == slow_simhash(t)
    assert _simhash("  ") == 0


def test_near_pairs_are_all_pairs(spark):
    random.seed(3)
    base = [random.getrandbits(64) for _ in range(40)]
    values = {int(np.uint64(b ^ sum(1 << p for p in random.sample(range(64), k))).view(np.int64)) for b in base for k in (0, 1, 2, 3, 4)}
    got = {(r.a, r.b) for r in near_pairs(spark.createDataFrame([(v,) for v in values], "fingerprint long")).collect()}
    expected = {(a, b) for a in values for b in values if a < b and bin((a ^ b) % 2**64).count("1") <= 3}
    assert got == expected


def test_components_of_long_chain_and_star(spark):
    pairs = [(i, i + 1) for i in range(30)] + [(100, i) for i in range(101, 140)]
    nodes = [(i,) for i in [*range(31), *range(100, 140), 500]]
    got = {r.node: r.root for r in components(spark.createDataFrame(pairs, "a long, b long"), spark.createDataFrame(nodes, "node long")).collect()}
    assert got == {i: 0 if i < 31 else 100 if i < 140 else 500 for (i,) in nodes}


def test_near_duplicates_of_texts(spark):
    long = " ".join(f"word{i}" for i in range(80))
    rows = [(1, long), (2, long), (3, long + "!"), (4, " ".join(f"other{i * 7}" for i in range(90))), (5, "short text"), (6, None), (7, "")]
    got = {r.id: (r.class_id, r.class_size) for r in near_duplicates(spark.createDataFrame([(*r, "x") for r in rows], "n long, t string, fingerprint string"), "n", "t").collect()}
    assert got[1] == got[2] and got[1][0] == 1 and not set(got) & {4, 5, 6, 7}
    assert near_duplicates(spark.createDataFrame([], "n long, t string"), "n", "t").count() == 0


PAGE = "id string, crawl_id string, url string, url_hash binary, status_code int, content_type string, crawl_depth int, title string, word_count int, is_indexable boolean, response_time_ms int"
LINK = "crawl_id string, source_url_id string, target_url string, target_url_hash binary, link_type string, rel_attrs array<string>"


def page(i, crawl="c", **kw):
    return {"id": f"{crawl}{i}", "crawl_id": crawl, "url": i, "url_hash": i.encode(), "status_code": 200, "content_type": "text/html", "crawl_depth": 1, "title": "t", "word_count": 5, "is_indexable": True, "response_time_ms": 1} | kw


def link(a, b, rel=None):
    return ("c", f"c{a}", b, b.encode(), "internal", rel)


def test_link_score_against_plain_loop(spark):
    pages = spark.createDataFrame([page(x) for x in "abcd"] + [page("z", "one")], PAGE)
    edges = [("a", "b", None), ("a", "b", None), ("a", "c", ["nofollow"]), ("b", "c", None), ("c", "a", None), ("d", "d", None)]
    got = {r.id[1:]: r.link_score for r in links.link_score(pages, spark.createDataFrame([link(*e) for e in edges], LINK)).collect()}
    ranks = dict.fromkeys("abcd", 0.25)
    out = {x: sum(e[0] == x for e in edges) for x in "abcd"}
    for _ in range(10):
        ranks = {x: 0.15 / 4 + 0.85 * sum(ranks[a] / out[a] for a, b, rel in edges if b == x and not rel) for x in "abcd"}
    low, high = min(ranks.values()), max(ranks.values())
    assert got == {x: max(1, round(np.log10((r - low) / (high - low) * 99 + 1) / 2 * 99 + 1)) for x, r in ranks.items()}


def test_orphans_and_order(spark):
    pages = spark.createDataFrame([page("a", crawl_depth=0), page("b"), page("c"), page("d"), page("e")], PAGE)
    rows = spark.createDataFrame([link("a", "b"), link("b", "c"), link("d", "d"), link("c", "a")], LINK)
    assert sorted(r.url for r in links.orphans(pages, rows).collect()) == ["d", "e"]
    assert sorted(r.url for r in links.orphans(pages, rows, exclude_start=True).collect()) == ["e"]
    assert {r.id: r.depth for r in links.crawl_order(pages, rows).collect()} == {"ca": 0, "cb": 1, "cc": 2}
    assert [(r.source, r.target) for r in links.graph_edges(pages, rows, k=2).orderBy("source").collect()] == [("ca", "cb")] and links.graph_edges(pages, rows).count() == 3


def test_order_of_a_deep_site(spark):
    names = [f"{i:02}" for i in range(14)]
    pages = spark.createDataFrame([page(x, crawl_depth=0 if x == "00" else 99) for x in names], PAGE)
    rows = spark.createDataFrame([link(a, b) for a, b in zip(names, names[1:])] + [link("13", "05")], LINK)
    assert {r.id: r.depth for r in links.crawl_order(pages, rows, max_depth=None).collect()} == {f"c{x}": int(x) for x in names}
    assert links.crawl_order(pages, rows).count() == 11


def test_compare(spark):
    crawls = spark.createDataFrame([("p", "x", "completed", 1), ("p", "y", "completed", 2), ("p", "z", "failed", 3), ("q", "w", "completed", 1)], "project_id string, id string, status string, completed_at int")
    pairs = compare.newest_pairs(crawls)
    assert sorted(tuple(r) for r in pairs.collect()) == [("p", "x", "y"), ("q", None, "w")]
    pages = spark.createDataFrame([page("a", "x"), page("b", "x", title=None), page("c", "x"), page("a", "y", response_time_ms=9), page("b", "y"), page("d", "y"), page("e", "w")], PAGE)
    assert sorted((r.url, r.change_type) for r in compare.compare(pages, pairs).collect()) == [("a", "unchanged"), ("b", "changed"), ("c", "removed"), ("d", "added")]


def test_fingerprints_need_words(spark):
    assert duplicates.fingerprints(spark.createDataFrame([(1, "a " * 49), (2, "a " * 50)], "i int, t string"), "i", "t").select(F.collect_list("id")).first()[0] == [2]


def test_near_classes_equal_components_of_all_pairs(spark):
    rng = random.Random(8)
    values = [rng.getrandbits(63) for _ in range(40)]
    for _ in range(400):  # chains and dense groups around them
        v = rng.choice(values)
        for bit in rng.sample(range(63), rng.randrange(1, 5)):
            v ^= 1 << bit
        values.append(v)
    base = rng.getrandbits(63)
    values += [base ^ x for x in range(200)] + values[:20]
    df = spark.createDataFrame([(v,) for v in values], "fingerprint long")
    expected = {r.node: r.root for r in components(near_pairs(df), df.selectExpr("fingerprint as node").distinct()).collect()}
    assert {r.node: r.root for r in near_classes(df).collect()} == expected
    assert 40 < len(set(expected.values())) < len(set(values)) and near_classes(df.limit(0)).count() == 0
