import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagequarry.llm import quantiles as q


def check(rows, values, bits, error, low=0.0, step=1.0):
    for r in rows:
        own = np.sort([min(max(np.floor((v - low) / step), 0), 2**bits - 1) * step + low for v in values[r.g]])
        n, rank = own.size, max(1, int(np.ceil(r.p * own.size - 1e-9)))
        le, lt = int((own <= r.value).sum()), int((own < r.value).sum())
        assert r.n == n and r.rank_low <= le <= r.rank_high and rank <= le + error * n and lt < rank + error * n, r


@pytest.mark.parametrize(("bits", "error"), [(20, 0.01), (10, 0.05), (6, 0.3)])
def test_bounds_hold_also_after_merging(spark, bits, error):
    rng = random.Random(bits)
    values = {"a": [rng.paretovariate(1) * 50 for _ in range(6000)], "b": [float(rng.randrange(30)) for _ in range(500)], None: [7.0], "c": [-5.0, 1e12, 3.0]}
    rows = [(g, v, i % 3, "n") for g, vs in values.items() for i, v in enumerate(vs)]
    df = spark.createDataFrame(rows, "g string, v double, part int, node string")
    at = [0.0, 0.1, 0.5, 0.9, 0.99, 1.0]
    whole = q.digest(df, ["g"], "v", bits, error)
    check(q.percentiles(whole, ["g"], at, bits).collect(), values, bits, error)
    parts = [q.digest(df.where(F.col("part") == i), ["g"], "v", bits, error) for i in range(3)]
    merged = q.merge(parts, ["g"], bits, error)
    check(q.percentiles(merged, ["g"], at, bits).collect(), values, bits, error)
    assert merged.agg(F.sum("count")).first()[0] == len(rows)
    if bits == 6:
        assert whole.where("g = 'a'").count() <= 3 * bits / error


def test_small_groups_are_exact(spark):
    df = spark.createDataFrame([("g", float(v), None) for v in range(1, 101)], "g string, v double, x string")
    got = {r.p: (r.value, r.rank_low, r.rank_high) for r in q.percentiles(q.digest(df, ["g"], "v"), ["g"], [0.5, 0.95]).collect()}
    assert got == {0.5: (50.0, 50, 50), 0.95: (95.0, 95, 95)}


def test_nulls_nan_ties_empty_and_steps(spark):
    df = spark.createDataFrame([("g", None), ("g", float("nan")), ("g", 0.25), ("g", 0.25), ("h", None)], "g string, v double")
    got = q.percentiles(q.digest(df, ["g"], "v", step=0.25), ["g"], [0.5], step=0.25).collect()
    assert [(r.g, r.n, r.value) for r in got] == [("g", 2, 0.25)]
    assert q.percentiles(q.digest(df.limit(0), ["g"], "v"), ["g"], [0.5]).count() == 0


def test_many_groups_in_one_task(spark):
    df = spark.range(30000).select((F.col("id") % 9000).alias("g"), F.lit("x").alias("h"), (F.col("id") % 7).cast("double").alias("v"))
    nodes = q.digest(df.coalesce(1), ["g", "h"], "v")
    assert nodes.groupBy("g", "h").agg(F.sum("count").alias("n")).agg(F.sum("n"), F.count("*")).first() == (30000, 9000)
