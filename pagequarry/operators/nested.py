"""Deeply nested JSON records as related flat tables.

Each record is stream-parsed into path-value-ordinal triples.  Paths that share
their nearest repeated ancestor (array) belong to one table; every array
element is one row of it and points to the row of the element around it.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_SPACE = r"[ \t\r\n]*"
_STRING = r'"([^"\\\x00-\x1f]*(?:\\.[^"\\\x00-\x1f]*)*)"'
_VALUE = re.compile(rf"{_SPACE}(?:{_STRING}|(-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?)|(true|false)|(null)|(\{{)|(\[)){_SPACE}", re.S)
_KEY = re.compile(rf"{_SPACE}{_STRING}{_SPACE}:", re.S)
_BLANK = re.compile(_SPACE)
_KINDS = (None, "string", "number", "boolean", "null", "object", "array")


def _decoded(inside: str) -> str:
    return json.loads(f'"{inside}"') if "\\" in inside else inside


def triples(text: str) -> list[tuple]:
    """(table, node, parent, ordinal, column, value, kind) of one JSON text, read once from front to end.

    table: the path without positions of the nearest array around the value, ''
    outside any.  node: the element's path with positions; parent: that of the
    nearest object around it that is itself an array element.  Each element
    has one triple with column null, whose kind says what it is; scalars below
    it follow, column being the path from the element ('value' for an element
    that is a scalar).  Numbers keep their spelling.  Of a key repeated in one
    object the last counts.  A text that is not complete JSON has no triples,
    one encoded as JSON more than once has those of its content.

    No tree is built and nothing recurses; what is kept besides the triples is
    one entry per open bracket and the keys of open objects.
    """
    try:
        return _events(text)
    except ValueError:
        return []


def _events(text: str) -> list[tuple]:
    rows: list = []
    put, value_at, key_at, end = rows.append, _VALUE.match, _KEY.match, len(text)
    stack: list[tuple] = []
    in_object, keys, index, replaced = False, None, 0, False
    path = table = node = within = below = key = ""
    around, parent, ordinal, pos = None, "", 0, 0
    while True:
        m = value_at(text, pos)
        if m is None:
            raise ValueError("not JSON")
        pos, which = m.end(), m.lastindex
        kind = _KINDS[which]
        value = _decoded(m.group(1)) if which == 1 else m.group(which) if which < 4 else None
        if not stack:
            if which == 1:
                if pos != end:
                    raise ValueError("not JSON")
                return _events(value)  # encoded once more
            put(("", "", None, 0, None, None, kind))
            if which < 5:
                put(("", "", None, 0, "value", value, kind))
            inner = "", "", "", None, "", "", 0
        elif in_object:
            full = f"{within}.{key}" if within else key
            if which < 5:
                put((table, node, around, ordinal, full, value, kind))
            else:
                inner = f"{path}.{key}" if path else key, table, node, around, parent, full, ordinal
        else:
            at = f"{path}[{index}]"
            put((below, at, parent, index, None, None, kind))
            if which < 5:
                put((below, at, parent, index, "value", value, kind))
            else:
                inner = at, below, at, parent, at if which == 5 else parent, "", index
        if which >= 5:
            stack.append((in_object, path, table, node, around, parent, within, ordinal, keys, index, below))
            path, table, node, around, parent, within, ordinal = inner
            in_object = which == 5
            if in_object:
                keys = {}
            else:
                index = 0
                below = f"{table}.{within}[]" if table and within else f"{table}[]" if table else f"{within}[]"
            if text[pos : pos + 1] != ("}" if in_object else "]"):
                if in_object:
                    m = key_at(text, pos)
                    if m is None:
                        raise ValueError("not JSON")
                    pos, key = m.end(), _decoded(m.group(1))
                    keys[key] = len(rows)
                continue
        while stack:
            c = text[pos : pos + 1]
            if c == ",":
                pos += 1
                break
            if c != ("}" if in_object else "]"):
                raise ValueError("not JSON")
            pos = _BLANK.match(text, pos + 1).end()
            in_object, path, table, node, around, parent, within, ordinal, keys, index, below = stack.pop()
        if not stack:
            if pos != end:
                raise ValueError("not JSON")
            return [r for r in rows if r is not None] if replaced else rows
        if not in_object:
            index += 1
            continue
        m = key_at(text, pos)
        if m is None:
            raise ValueError("not JSON")
        pos, key = m.end(), _decoded(m.group(1))
        if key in keys:  # what the key held before is void
            a = keys.pop(key)
            b = min((n for n in keys.values() if n > a), default=len(rows))
            rows[a:b] = [None] * (b - a)
            replaced = True
        keys[key] = len(rows)


_NAMES = ("table_path", "node_path", "parent_path", "ordinal", "column", "value", "kind")
_SCHEMA = "table_path string, node_path string, parent_path string, ordinal int, column string, value string, kind string"


def _text(column: list) -> pa.Array:
    try:
        return pa.array(column, pa.string())
    except (UnicodeEncodeError, pa.ArrowInvalid):  # half of a surrogate pair
        return pa.array([None if x is None else x.encode("utf-8", "replace").decode() for x in column], pa.string())


def _records(df: DataFrame, record_id: str, document: str) -> DataFrame:
    return df.select(F.col(record_id).alias("record_id"), F.col(document).alias("document")).where(F.col("document").isNotNull()).dropDuplicates(["record_id"])


def json_triples(df: DataFrame, record_id: str, document: str) -> DataFrame:
    """Triples of every record: record_id and the columns that ``triples`` names.

    Rows with the same id are one record.  A document that is null or empty
    has no triples.  Other columns of ``df`` are not read.
    """
    one = _records(df, record_id, document)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            where, rows = [], []
            ids, texts = batch.column(0), batch.column(1)

            def flush():
                columns = list(zip(*rows, strict=True)) if rows else [[] for _ in _NAMES]
                return pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(where, pa.int64())), *[pa.array(columns[3], pa.int32()) if n == "ordinal" else _text(list(columns[i])) for i, n in enumerate(_NAMES)]], ["record_id", *_NAMES]
                )

            for i, text in enumerate(texts):
                own = triples(text.as_py())
                rows.extend(own)
                where.extend([i] * len(own))
                if len(rows) > 100_000:
                    yield flush()
                    where, rows = [], []
            yield flush()

    return one.mapInArrow(run, f"record_id {dict(df.dtypes)[record_id]}, {_SCHEMA}")


def elements(df: DataFrame, record_id: str, document: str) -> DataFrame:
    """One row per object that is an array element, from the flat tables: record_id, table_path, node_path, parent_path ('' for none), ordinal."""
    rows = flat_tables(df, record_id, document).where((F.col("kind") == "object") & (F.col("table_path") != ""))
    return rows.select("record_id", "table_path", "node_path", "parent_path", "ordinal")


def table_columns(all_triples: DataFrame) -> DataFrame:
    """Which tables and columns there are: table_path, column, with the number of values."""
    return all_triples.where(F.col("column").isNotNull()).groupBy("table_path", "column").agg(F.count("*").alias("n"), F.collect_set("kind").alias("kinds"))


def pivot_table(all_triples: DataFrame, table_path: str, columns: list[str]) -> DataFrame:
    """The flat table of one repeated ancestor: record_id, node_path, parent_path, ordinal and the named columns as text.

    An absent field and a null one are both null; ``json_triples`` tells them
    apart by kind.  Column names that clash with the keys get a leading '_'.
    """
    keys = ["record_id", "node_path", "parent_path", "ordinal"]
    rows = all_triples.where(F.col("table_path") == table_path)
    return rows.groupBy(*keys).agg(*[F.max(F.when(F.col("column") == c, F.col("value"))).alias(f"_{c}" if c in keys else c) for c in columns])


def flat_rows(text: str) -> Iterator[tuple]:
    """(table, node, parent, ordinal, kind, fields) per row of all flat tables of one JSON text.

    The triples of an element, pivoted: fields has (value, kind) by column.
    Two values that have the same path, as a key may hold a dot, are both
    kept; the later one's column gets a leading '_'.
    """
    rows: dict[tuple, tuple] = {}
    for table, node, parent, ordinal, column, value, kind in triples(text):
        if column is None:
            rows.setdefault((table, node), (table, node, parent, ordinal, kind, {}))
            continue
        fields = rows[table, node][5]
        while column in fields:
            column = f"_{column}"
        fields[column] = (value, kind)
    yield from rows.values()


def flat_tables(df: DataFrame, record_id: str, document: str) -> DataFrame:
    """Every flat table there is: a row per record (table_path '') and per array element.

    record_id, table_path, node_path, parent_path, ordinal, kind of the
    element, and fields: column -> (value, kind).  Tables and columns are
    those of ``table_columns``, whatever they are called; a field that is null
    has kind 'null', an absent one is not in the map.  All triples of an
    element come from one record, so they are grouped where it is parsed.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            where, rows, size = [], [], 0
            ids, texts = batch.column(0), batch.column(1)

            def flush():
                columns = list(zip(*rows, strict=True)) if rows else [[] for _ in range(6)]
                ends, names, values, kinds = [0], [], [], []
                for fields in columns[5]:
                    names.extend(fields)
                    for text, kind in fields.values():
                        values.append(text)
                        kinds.append(kind)
                    ends.append(len(names))
                cells = pa.StructArray.from_arrays([_text(values), pa.array(kinds, pa.string())], ["value", "kind"])
                fields = pa.MapArray.from_arrays(pa.array(ends, pa.int32()), _text(names), cells)
                texts = [pa.array(c, pa.int32()) if i == 3 else _text(list(c)) for i, c in enumerate(columns[:5])]
                return pa.RecordBatch.from_arrays([ids.take(pa.array(where, pa.int64())), *texts, fields], ["record_id", "table_path", "node_path", "parent_path", "ordinal", "kind", "fields"])

            for i, text in enumerate(texts):
                for row in flat_rows(text.as_py()):
                    rows.append(row)
                    where.append(i)
                    size += 1 + len(row[5])
                if size > 100_000:
                    yield flush()
                    where, rows, size = [], [], 0
            yield flush()

    schema = "table_path string, node_path string, parent_path string, ordinal int, kind string, fields map<string, struct<value: string, kind: string>>"
    return _records(df, record_id, document).mapInArrow(run, f"record_id {dict(df.dtypes)[record_id]}, {schema}")


def _full_path():
    """node_path and column as one path; that of an element ends with a dot."""
    return F.ltrim(F.concat("node_path", F.lit("."), F.coalesce("column", F.lit(""))), F.lit("."))


def objects_under(all_triples: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """What stands under ``key`` at any depth, be it one object, an array or arrays of arrays.

    One row each: record_id, node_path, parent_path, holder_path (the object
    that has ``key``; of objects under ``key`` within each other, the one
    around them all) and the named columns as text.  An object outside an
    array has no position; an empty one leaves no triples and so no row.
    """
    step = re.escape(key)
    rows = all_triples.withColumn("_full", _full_path()).withColumn("_node", F.regexp_extract("_full", rf"^((?:.*\.)?{step}(?:\[\d+\])*)\.", 1)).where("_node != ''")
    element = F.col("column").isNull() & (F.col("node_path") == F.col("_node"))
    found = rows.where(~element | (F.col("kind") != "array")).groupBy("record_id", "_node").agg(
        F.max(F.when(element, F.col("parent_path"))).alias("_parent"),
        *[F.max(F.when(F.col("_full") == F.concat("_node", F.lit(f".{c}")), F.col("value"))).alias(c) for c in columns],
    )
    around = F.regexp_extract(F.regexp_replace("_node", r"(\[\d+\])+$", ""), r"^(.*\])\.", 1)
    holder = F.regexp_replace("_node", rf"((^|\.){step}(\[\d+\])*)+$", "")
    return found.select("record_id", F.col("_node").alias("node_path"), F.coalesce("_parent", around).alias("parent_path"), holder.alias("holder_path"), *[F.col(f"`{c}`") for c in columns])


def field_of_objects(all_triples: DataFrame, field: str) -> DataFrame:
    """The text of ``field`` in every object that has it: record_id, holder_path (the object) and the field."""
    rows = all_triples.where((F.col("column") == field) | F.col("column").endswith(f".{field}"))
    holder = F.regexp_replace(_full_path(), rf"(^|\.){re.escape(field)}$", "")
    return rows.groupBy("record_id", holder.alias("holder_path")).agg(F.max("value").alias(field))
