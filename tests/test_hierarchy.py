import random

import pytest

from pagequarry.operators.hierarchy import resolve

SCHEMA = "scope string, c string, p string, node int, path string, depth string"


def nodes(spark, rows, **kw):
    df = spark.createDataFrame([(*r, 1, "x", "y") for r in rows], SCHEMA)
    return resolve(df, "scope", "c", "p", **kw)


def as_dict(h):
    return {(r.scope, r.node): (r.root, r.depth) for r in h.nodes.collect()}


def test_chain_tree_and_scopes(spark):
    h = nodes(spark, [("k", "a", "b"), ("k", "b", "c"), ("k", "x", "b"), ("m", "a", "z"), ("k", "a", "b")])
    assert as_dict(h) == {("k", "c"): ("c", 0), ("k", "b"): ("c", 1), ("k", "a"): ("c", 2), ("k", "x"): ("c", 2), ("m", "z"): ("z", 0), ("m", "a"): ("z", 1)}
    paths = {(r.scope, r.node): r.path for r in h.nodes.collect()}
    assert paths[("k", "a")] == ["c", "b", "a"]
    below = sorted((r.scope, r.ancestor, r.descendant, r.distance) for r in h.descendants().collect())
    assert below == [("k", "b", "a", 1), ("k", "b", "x", 1), ("k", "c", "a", 2), ("k", "c", "b", 1), ("k", "c", "x", 2), ("m", "z", "a", 1)]


def test_cycles_and_what_leads_into_them(spark):
    h = nodes(spark, [("k", "a", "b"), ("k", "b", "a"), ("k", "t", "s"), ("k", "s", "a"), ("k", "self", "self"), ("k", "u", "self")])
    assert as_dict(h) == {("k", "a"): ("", -1), ("k", "b"): ("", -1), ("k", "s"): ("", -2), ("k", "t"): ("", -2), ("k", "self"): ("", -1), ("k", "u"): ("", -2)}


def test_nulls_empty_and_several_parents(spark):
    assert as_dict(nodes(spark, [])) == {}
    h = nodes(spark, [(None, "a", "b"), ("k", None, "b"), ("k", "a", None), ("k", "a", "c"), ("k", "a", "b"), ("k", "", "b")])
    assert as_dict(h) == {("k", "b"): ("b", 0), ("k", "c"): ("c", 0), ("k", "a"): ("b", 1), ("k", ""): ("b", 1)}
    assert [tuple(r) for r in h.further_links.collect()] == [("k", "a", "c")]


def test_deep_chain(spark):
    h = nodes(spark, [("k", f"n{i:03}", f"n{i + 1:03}") for i in range(25)])
    assert max(r.depth for r in h.nodes.collect()) == 25
    assert len(h.nodes._jdf.queryExecution().logical().toString()) < 5000


def plain(rows):
    parent = {}
    for s, c, p in rows:
        parent[s, c] = min(p, parent.get((s, c), p))
    found = {}
    for s, n in {(s, x) for s, *ends in rows for x in ends}:
        at, seen = n, []
        while at not in seen and (s, at) in parent:
            seen.append(at)
            at = parent[s, at]
        found[s, n] = (at, len(seen)) if (s, at) not in parent else ("", -1 if at == n else -2)
    return found


@pytest.mark.parametrize("broadcast_bytes", [0, 1 << 20])
def test_random_links_against_plain_loop(spark, broadcast_bytes):
    rng = random.Random(4)
    rows = [(rng.choice("km"), f"n{c}", f"n{rng.randrange(max(0, c - 40), c + 1) if rng.random() < 0.97 else rng.randrange(300)}") for c in range(300)]
    rows += [("hot", f"x{i}", "top") for i in range(500)] + [("hot", f"y{i}", f"x{i % 3}") for i in range(40)] + rows[:20]
    h = nodes(spark, rows, broadcast_bytes=broadcast_bytes)
    assert as_dict(h) == plain(rows)
    assert all(len(r.path) == max(r.depth, 0) + 1 and r.path[-1] == r.node for r in h.nodes.collect())
