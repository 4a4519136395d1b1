import numpy as np
import pytest
from pyspark.sql import functions as F

from pagequarry.operators.snapshots import Bitmap, Ordinals, number_snapshots, snapshot_changes

ROWS = "id string, snap string, k string, v int, t string, at int, seq string, chunk int"


def changes(spark, snaps, rows, **kw):
    s = number_snapshots(spark.createDataFrame(snaps, "series string, id string, taken int"), "series", "id", "taken")
    df = spark.createDataFrame([(*r, "x", 3) for r in rows], ROWS)
    return sorted((r.snapshot, r.key, r.change_type) for r in snapshot_changes(df, s, "snap", "k", ["v", "t"], ["at", "id"], **kw).collect())


SNAPS = [("p", "s2", 2), ("p", "s1", 1), ("p", "s1", 1), ("p", "s3", 3), ("q", "t1", None)]


@pytest.mark.parametrize("chunk", [1, 2, 8192])
def test_added_removed_changed(spark, chunk):
    rows = [
        ("1", "s1", "a", 200, "A", 1), ("2", "s1", "b", 200, None, 1), ("3", "s1", "c", 200, "C", 1), ("4", "s1", "e", None, "E", 1),
        ("5", "s2", "a", 200, "A", 1), ("6", "s2", "b", 200, "B", 1), ("7", "s2", "d", 200, "D", 1), ("8", "s2", "e", None, "E", 1),
        ("9", "t1", "a", 1, "z", 1), ("10", "zz", "a", 1, "z", 1), ("11", "s1", None, 1, "z", 1),
    ]
    assert changes(spark, SNAPS, rows, chunk=chunk) == [("s2", "b", "changed"), ("s2", "c", "removed"), ("s2", "d", "added"), ("s3", "a", "removed"), ("s3", "b", "removed"), ("s3", "d", "removed"), ("s3", "e", "removed")]


def test_latest_version_counts_with_ties_and_repeats(spark):
    rows = [("1", "s1", "a", 1, "x", 5), ("1", "s1", "a", 1, "x", 5), ("2", "s1", "a", 2, "x", 5), ("3", "s1", "a", 3, "x", 1), ("4", "s2", "a", 2, "x", 1), ("5", "s3", "a", 2, "", 1)]
    assert changes(spark, SNAPS, rows) == [("s3", "a", "changed")]


def test_empty(spark):
    assert changes(spark, SNAPS, []) == [] and changes(spark, [], [("1", "s1", "a", 1, "x", 5)]) == []


def numbers(df):
    return {(r.series, r.key): r.ordinal for r in df.collect()}


def test_dictionary_outlasts_a_run_and_grows(spark, tmp_path):
    keys = lambda *rows: spark.createDataFrame(list(rows), "series string, key string")
    first = numbers(Ordinals(spark, str(tmp_path)).extend(keys(("p", "b"), ("p", "d"), ("p", "b"), ("q", "b"))))
    assert sorted(v for (s, _), v in first.items() if s == "p") == [0, 1] and first["q", "b"] == 0
    more = numbers(Ordinals(spark, str(tmp_path)).extend(keys(("p", "a"), ("p", "b"), ("r", "z"))))
    assert more == first | {("p", "a"): 2, ("r", "z"): 0}
    assert numbers(Ordinals(spark, str(tmp_path)).extend(keys(("p", "a")))) == more
    many = numbers(Ordinals(spark, str(tmp_path)).extend(keys(*[("p", f"k{i}") for i in range(500)])))
    assert sorted(v for (s, _), v in many.items() if s == "p") == list(range(503)) and many.items() >= more.items()


def test_changes_with_a_dictionary_of_an_earlier_run(spark, tmp_path):
    keys = [f"k{i}" for i in range(12)]
    rows = [(k, "s1", k, 1, "x", 1) for k in keys[:8]] + [(k, "s2", k, 2 if k == "k5" else 1, "x", 1) for k in keys[2:]]
    expected = changes(spark, SNAPS, rows)
    assert len(expected) == 17 and ("s2", "k5", "changed") in expected
    assert changes(spark, SNAPS[:3], rows[:8], ordinals=Ordinals(spark, str(tmp_path))) == [("s2", k, "removed") for k in sorted(keys[:8])]
    for chunk, span in ((3, 1), (8192, 2)):
        assert changes(spark, SNAPS, rows, chunk=chunk, span=span, ordinals=Ordinals(spark, str(tmp_path))) == expected


def test_many_snapshots_in_spans(spark):
    snaps = [("p", f"s{i:02}", i) for i in range(11)]
    rows = [(f"{i}{k}", f"s{i:02}", k, i // 3, "x", 1) for i in range(11) if i != 5 for k in ("a", "b" if i % 2 else "c")]
    expected = changes(spark, snaps, rows, span=100)
    assert len(expected) > 20
    for span in (1, 3, 10):
        assert changes(spark, snaps, rows, span=span) == expected


def test_bitmaps_against_sets():
    rng = np.random.default_rng(1)
    for size, n in ((10, 3), (20000, 50), (20000, 9000), (70000, 100)):
        a, b = (rng.choice(size, min(n, size), replace=False) for _ in range(2))
        x, y = Bitmap(a, size), Bitmap(b, size)
        assert x.and_not(y).tolist() == sorted(set(a.tolist()) - set(b.tolist())) and x.and_(y).tolist() == sorted(set(a.tolist()) & set(b.tolist()))


def test_large_snapshot_is_cut(spark):
    s = number_snapshots(spark.createDataFrame([("p", "a", 1), ("p", "b", 2)], "series string, id string, taken int"), "series", "id", "taken")
    rows = spark.range(4000).select(F.col("id").cast("string").alias("k"), F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("snap"), F.lit(1).alias("v"), F.lit(1).alias("at"))
    got = snapshot_changes(rows, s, "snap", "k", ["v"], ["at"], chunk=500).groupBy("change_type").count().collect()
    assert {r.change_type: r["count"] for r in got} == {"added": 2000, "removed": 2000}
