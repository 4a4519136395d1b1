import json

from hypothesis import given, settings
from hypothesis import strategies as st

from pagequarry.operators.nested import elements, flat_tables, json_triples, pivot_table, table_columns, triples
from pagequarry.plans import structure


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "id string, doc string, node_path string, ordinal int")


def found(spark, rows):
    return sorted((r.record_id, r.node_path, r.parent_path) for r in elements(frame(spark, rows), "id", "doc").collect())


def test_paths_positions_and_parents(spark):
    doc = '{"offers":[{"rates":[{"a":1},2,{"b":[]}]},"s",[[{"x":1}]]],"o":{"l":[{"m":{"n":[{"z":0}]}}]},"e":[]}'
    assert found(spark, [("1", doc)]) == [
        ("1", "o.l[0]", ""), ("1", "o.l[0].m.n[0]", "o.l[0]"), ("1", "offers[0]", ""), ("1", "offers[0].rates[0]", "offers[0]"), ("1", "offers[0].rates[2]", "offers[0]"), ("1", "offers[2][0][0]", ""),
    ]


def test_encoded_twice_broken_null_empty_and_repeated(spark):
    twice = json.dumps(json.dumps({"a": [{"b": 1}]}))
    rows = [("1", twice), ("2", '{"a":[{"b":1}'), ("3", None), ("4", ""), ("5", "null"), ("6", "[{}]"), ("6", "[{}]"), ("7", '{"a":[{"b":NaN}]}'), ("8", '{"a": [{}]} x')]
    assert found(spark, rows) == [("1", "a[0]", ""), ("6", "[0]", "")]
    assert found(spark, []) == []


def test_tables(spark):
    doc = '{"t":1,"i":[{"src":"a","w":10,"deep":{"k":true}},{"src":null},7,{"node_path":"n"}]}'
    triples = json_triples(frame(spark, [("1", doc)]), "id", "doc").cache()
    columns = {(r.table_path, r.column): r.n for r in table_columns(triples).collect()}
    assert columns == {("", "t"): 1, ("i[]", "src"): 2, ("i[]", "w"): 1, ("i[]", "deep.k"): 1, ("i[]", "value"): 1, ("i[]", "node_path"): 1}
    flat = {r.node_path: (r.src, r.w, r["deep.k"], r._node_path) for r in pivot_table(triples, "i[]", ["src", "w", "deep.k", "node_path"]).collect()}
    assert flat == {"i[0]": ("a", "10", "true", None), "i[1]": (None, None, None, None), "i[2]": (None, None, None, None), "i[3]": (None, None, None, "n")}


def test_very_deep_and_very_long(spark):
    assert len(found(spark, [("1", '{"x":[' + "[" * 2000 + "{}" + "]" * 2000 + "]}")])) == 1
    deep = '{"a":[' * 1000 + "1" + "]}" * 1000
    assert len(triples(deep)) == 1002 and triples(deep[:-1]) == []
    long = json.dumps({"a": [{"v": "x" * 2_000_000}, {"n": 1}]})
    assert len(found(spark, [("1", long)])) == 2
    assert triples('{"n":' + "9" * 6000 + "}")[1][5] == "9" * 6000


def leaves(value, path=""):
    """Path and text of every scalar, from the library's tree."""
    if isinstance(value, dict):
        for k, v in value.items():
            yield from leaves(v, f"{path}.{k}" if path else k)
    elif isinstance(value, list):
        for i, v in enumerate(value):
            yield from leaves(v, f"{path}[{i}]")
    else:
        yield path, value if value is None or isinstance(value, str) else json.dumps(value)


@settings(max_examples=300, deadline=None)
@given(st.recursive(st.none() | st.booleans() | st.integers() | st.floats(allow_nan=False, allow_infinity=False) | st.text(), lambda x: st.lists(x, max_size=4) | st.dictionaries(st.text(min_size=1, max_size=3), x, max_size=4), max_leaves=25), st.sampled_from([None, 1]), st.booleans())
def test_triples_agree_with_the_library(value, indent, ascii):
    if isinstance(value, str):
        value = [value]
    text = json.dumps(value, indent=indent, ensure_ascii=ascii)
    got, kinds = [], {}
    for table, node, _, _, column, scalar, kind in triples(text):
        if column is None:
            kinds[table, node] = kind
        else:
            whole = kinds[table, node] not in ("object", "array")
            got.append((node if whole else f"{node}.{column}" if node else column, scalar))
    assert sorted(map(repr, got)) == sorted(map(repr, leaves(value)))
    assert triples(text[:-1]) == [] or not isinstance(value, dict | list)


def test_what_is_not_json():
    for text in ["", "{", "[1,]", '{"a"}', '{"a":1,}', "1 2", "[1 2]", "}", '{"a":1]', "01", "nul", '"a\n"', '["\\x"]', "[١]", "[1]]", "NaN", '{1:2}', '[,1]', "﻿{}"]:
        assert triples(text) == [], text


def test_repeated_keys():
    doc = '{"a":[{"x":1},{"x":2}],"b":1,"a":{"c":[3]},"b":2,"k":{"z":1,"z":[{}]}}'
    assert [(t, n, c, v) for t, n, _, _, c, v, _ in triples(doc)] == [
        ("", "", None, None), ("a.c[]", "a.c[0]", None, None), ("a.c[]", "a.c[0]", "value", "3"), ("", "", "b", "2"), ("k.z[]", "k.z[0]", None, None),
    ]


def test_offers_of_every_shape(spark, tmp_path):
    offer = {"price": 1, "priceCurrency": "EUR", "seller": {"name": "S"}}
    docs = {
        "array": {"json_ld": [{"name": "A", "offers": [offer, {}, None]}]},
        "object": {"name": "page", "json_ld": {"name": "B", "offers": [offer]}},
        "nested": {"json_ld": [[{"name": "C", "offers": [[offer], offer]}]]},
        "single": {"json_ld": [{"name": "D", "offers": offer | {"rates": [{"price": 9}]}}, {"offers": None}, {"offers": "no"}, {"special_offers": [offer]}]},
        "alone": {"json_ld": {"main": {"name": "E", "offers": offer}}},
        "aggregate": {"json_ld": [{"name": "F", "offers": {"lowPrice": 1, "offers": [offer]}}]},
        "no name": {"json_ld": [{"offers": [offer]}]},
    }
    spark.createDataFrame([(k, json.dumps(v)) for k, v in docs.items()], "id string, seo_data string").write.parquet(f"{tmp_path}/crawled_urls.parquet")
    got = sorted(tuple(r) for r in structure.p7_offers(spark, str(tmp_path)).collect())
    assert got == [
        ("aggregate", "json_ld[0].offers", "json_ld[0]", "F", None, None),
        ("aggregate", "json_ld[0].offers.offers[0]", "json_ld[0]", "F", "1", "EUR"),
        ("alone", "json_ld.main.offers", "", "E", "1", "EUR"),
        ("array", "json_ld[0].offers[0]", "json_ld[0]", "A", "1", "EUR"),
        ("array", "json_ld[0].offers[1]", "json_ld[0]", "A", None, None),
        ("array", "json_ld[0].offers[2]", "json_ld[0]", "A", None, None),
        ("nested", "json_ld[0][0].offers[0][0]", "json_ld[0][0]", "C", "1", "EUR"),
        ("nested", "json_ld[0][0].offers[1]", "json_ld[0][0]", "C", "1", "EUR"),
        ("no name", "json_ld[0].offers[0]", "json_ld[0]", None, "1", "EUR"),
        ("object", "json_ld.offers[0]", "", "B", "1", "EUR"),
        ("single", "json_ld[0].offers", "json_ld[0]", "D", "1", "EUR"),
    ]


def test_all_flat_tables(spark):
    docs = [
        ("1", '{"t":"x","o":[{"p":1,"s":{"n":"S"},"ship":[{"rates":[{"v":2.50},{"v":null}]},{}]},7,[{"k":true}]]}'),
        ("2", '{"o":{"p":"1"},"a.b":1,"a":{"b":2}}'),
        ("3", '{"o":[{"p":"one"}]}'),
        ("4", '{"broken":['),
        ("5", "null"),
        ("6", '[{"h":"\\ud800"}]'),
    ]
    frame_ = frame(spark, docs)
    flat = flat_tables(frame_, "id", "doc").collect()
    got = {(r.record_id, r.table_path, r.node_path): (r.parent_path, r.ordinal, r.kind, {k: tuple(v) for k, v in r.fields.items()}) for r in flat}
    assert len(got) == len(flat)
    assert got == {
        ("1", "", ""): (None, 0, "object", {"t": ("x", "string")}),
        ("1", "o[]", "o[0]"): ("", 0, "object", {"p": ("1", "number"), "s.n": ("S", "string")}),
        ("1", "o[].ship[]", "o[0].ship[0]"): ("o[0]", 0, "object", {}),
        ("1", "o[].ship[]", "o[0].ship[1]"): ("o[0]", 1, "object", {}),
        ("1", "o[].ship[].rates[]", "o[0].ship[0].rates[0]"): ("o[0].ship[0]", 0, "object", {"v": ("2.50", "number")}),
        ("1", "o[].ship[].rates[]", "o[0].ship[0].rates[1]"): ("o[0].ship[0]", 1, "object", {"v": (None, "null")}),
        ("1", "o[]", "o[1]"): ("", 1, "number", {"value": ("7", "number")}),
        ("1", "o[]", "o[2]"): ("", 2, "array", {}),
        ("1", "o[][]", "o[2][0]"): ("", 0, "object", {"k": ("true", "boolean")}),
        ("2", "", ""): (None, 0, "object", {"o.p": ("1", "string"), "a.b": ("1", "number"), "_a.b": ("2", "number")}),
        ("3", "", ""): (None, 0, "object", {}),
        ("3", "o[]", "o[0]"): ("", 0, "object", {"p": ("one", "string")}),
        ("5", "", ""): (None, 0, "null", {"value": (None, "null")}),
        ("6", "", ""): (None, 0, "array", {}),
        ("6", "[]", "[0]"): ("", 0, "object", {"h": ("?", "string")}),
    }


def test_flat_tables_have_the_columns_of_table_columns(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/crawled_urls.parquet")
    expected = {(r.table_path, r.column): (r.n, sorted(r.kinds)) for r in table_columns(json_triples(pages, "id", "seo_data")).collect()}
    counts: dict = {}
    for r in structure.p7_tables(spark, "/root/testdata/sf0.001").collect():
        for column, cell in r.fields.items():
            n, kinds = counts.setdefault((r.table_path, column), [0, set()])
            counts[r.table_path, column][0] = n + 1
            kinds.add(cell.kind)
    assert {k: (n, sorted(kinds)) for k, (n, kinds) in counts.items()} == expected
