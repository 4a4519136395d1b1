import datetime as dt
import random
import re

from pagequarry.llm import format_duplicates as fd
from pagequarry.llm import seen

SCHEMA = "id string, crawl string, a string, b string, l array<string>, scope string, raw string, canonical string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "s", "r", "c") for r in rows], SCHEMA)


def plain(rows):
    groups = {}
    for i, c, a, b, many in {r[0]: r for r in rows if r[0] and r[1]}.values():
        values = sorted(v for v in (re.sub(r"[\W_]+", "", (x or "").lower()) for x in [a, b, *(many or [])]) if v)
        if values:
            groups.setdefault((c, tuple(values)), []).append(i)
    return groups


def test_copies_against_plain_loop(spark):
    rng = random.Random(2)
    parts = ["Red Sofa", "red-sofa!", "BLUE  chair", "blue chair", None, "", "…", "ÉTÉ", "été", "x1"]
    rows = [(f"{i:03}", rng.choice("ab"), rng.choice(parts), rng.choice(parts), rng.choice([None, [], [rng.choice(parts)], [rng.choice(parts), rng.choice(parts)]])) for i in range(300)]
    rows += rows[:40] + [(None, "a", "x", "y", None), ("zz", None, "x", "y", None)]
    groups = plain(rows)
    df = frame(spark, rows)
    got = sorted(tuple(r) for r in fd.copies(df, "id", "crawl", ["a", "b"], ["l"]).collect())
    assert got == sorted((min(g), i) for g in groups.values() for i in g if i != min(g))
    counts = sorted(tuple(r) for r in fd.collapse(df, "id", "crawl", ["a", "b"], ["l"]).collect())
    assert counts == sorted((c, min(g), len(g)) for (c, _), g in groups.items())


def test_multiplicity_field_order_and_long_texts(spark):
    long = "word " * 100000
    rows = [("1", "c", "A", "A", None), ("2", "c", "a", None, None), ("3", "c", None, "b", ["A!"]), ("4", "c", "a", "B", []), ("5", "c", long, None, None), ("6", "c", long.upper(), "", None)]
    assert sorted(tuple(r) for r in fd.copies(frame(spark, rows), "id", "crawl", ["a", "b"], ["l"]).collect()) == [("3", "4"), ("5", "6")]
    assert fd.copies(frame(spark, []), "id", "crawl", ["a", "b"], ["l"]).count() == 0


def test_hot_group(spark):
    rows = [(f"{i:04}", "c", "Same title" if i % 3 else f"t{i}", None, None) for i in range(1500)]
    assert fd.copies(frame(spark, rows), "id", "crawl", ["a", "b"], ["l"]).count() == 999


def times(*minutes):
    return [dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc) + dt.timedelta(minutes=m) for m in minutes]


def answers(df):
    return {r.id: r.repeat for r in df.collect()}


def test_first_or_repeat_against_plain_loop(spark):
    rng = random.Random(5)
    stamps = times(*range(50))
    rows = [(f"{i:03}", rng.choice([None, "hot", "hot", *[f"k{j}" for j in range(60)]]), rng.choice([None, *stamps]), "x") for i in range(400)]
    rows += rows[:30]
    df = spark.createDataFrame(rows, "id string, k string, t timestamp, key string")
    expected, known = {}, set()
    for i, k, _, _ in sorted(set(rows), key=lambda r: (r[2] is not None, r[2] or stamps[0], r[0])):
        expected[i] = k in known
        if k is not None:
            known.add(k)
    for n in (1, 4):
        got = seen.repeats(df, "k", "t", "id", deliveries=n)
        assert answers(got) == expected
    report = seen.error_report(got, df, "k", "t", "id").first()
    assert (report.records, report.repeats, report.wrong, report.wrong_rate) == (400, sum(expected.values()), 0, 0.0)


def test_state_outlasts_a_delivery_and_late_rows(spark):
    t = times(0, 5, 9)
    rows = lambda *r: spark.createDataFrame(list(r), "id string, k binary, t timestamp")
    stream = seen.SeenKeys(spark)
    assert answers(stream.deliver(rows(("1", b"a", t[1]), ("2", b"a", t[1])), "k", "t", "id")) == {"1": False, "2": True}
    assert answers(stream.deliver(rows(("3", b"a", t[2]), ("4", b"b", t[2])), "k", "t", "id")) == {"3": True, "4": False}
    assert answers(stream.deliver(rows(("5", b"a", t[0]),), "k", "t", "id")) == {"5": False}
    assert answers(stream.deliver(rows(), "k", "t", "id")) == {}
