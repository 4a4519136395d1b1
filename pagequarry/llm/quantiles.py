"""Percentiles per group from mergeable dyadic-tree digests with deterministic rank error.

Values are quantized to a universe of 2**bits ordered steps.  A digest keeps
counts on nodes of the binary tree over that universe; a node, its sibling and
their parent are folded into the parent while together they hold no more than
n / k values.  Adding the counts of equal nodes merges digests, and the rank
of any answer is off by at most bits * n / k.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BITS = 20
RANK_ERROR = 0.01


def _compress(code: np.ndarray, node: np.ndarray, count: np.ndarray, limit: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Folds the nodes of many groups at once; code numbers the group, limit[code] is its n / k."""
    depth = np.frexp(node.astype(np.float64))[1] - 1
    shift = np.int64(bits + 1)
    kept = []
    up_key, up_count = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    for d in range(bits, 0, -1):
        own = depth == d
        key, inverse = np.unique(np.concatenate([(code[own] << shift) | node[own], up_key]), return_inverse=True)
        sums = np.zeros(key.size, dtype=np.int64)
        np.add.at(sums, inverse, np.concatenate([count[own], up_count]))
        c, n = key >> shift, key & ((1 << shift) - 1)
        parent, at = np.unique((c << shift) | (n >> 1), return_inverse=True)
        total = np.zeros(parent.size, dtype=np.int64)
        np.add.at(total, at, sums)
        above = depth == d - 1
        there = (code[above] << shift) | node[above]
        if there.size:
            where = np.searchsorted(parent, there)
            hit = (where < parent.size) & (parent[np.minimum(where, parent.size - 1)] == there) if parent.size else np.zeros(there.size, dtype=bool)
            np.add.at(total, where[hit], count[above][hit])
        fold = (total <= limit[parent >> shift])[at] if parent.size else np.zeros(0, dtype=bool)
        kept.append((c[~fold], n[~fold], sums[~fold]))
        up_key, up_count = (c[fold] << shift) | (n[fold] >> 1), sums[fold]
    root = depth == 0
    key, inverse = np.unique(np.concatenate([(code[root] << shift) | node[root], up_key]), return_inverse=True)
    sums = np.zeros(key.size, dtype=np.int64)
    np.add.at(sums, inverse, np.concatenate([count[root], up_count]))
    kept.append((key >> shift, key & ((1 << shift) - 1), sums))
    return tuple(np.concatenate(x) for x in zip(*kept, strict=True))


def _folded(groups: list[str], bits: int, k: int):
    def flush(rows: pd.DataFrame) -> pd.DataFrame:
        code = rows.groupby(groups, sort=False, dropna=False).ngroup().to_numpy().astype(np.int64)
        node, count = rows["node"].to_numpy(dtype=np.int64), rows["count"].to_numpy(dtype=np.int64)
        n = np.zeros(code.max() + 1, dtype=np.int64)
        np.add.at(n, code, count)
        first = np.full(n.size, -1, dtype=np.int64)
        first[code[::-1]] = np.arange(code.size)[::-1]
        c, node, count = _compress(code, node, count, n // k, bits)
        out = rows[groups].iloc[first[c]].reset_index(drop=True)
        return out.assign(node=node, count=count)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        size = 0
        for batch in batches:  # sorted by group: all but the last group of what is held are complete
            held.append(batch)
            size += len(batch)
            if size < 200_000:
                continue
            rows = pd.concat(held, ignore_index=True)
            last = reduce(lambda a, b: a & b, [(rows[g] == rows[g].iloc[-1]) | (rows[g].isna() & pd.isna(rows[g].iloc[-1])) for g in groups]).to_numpy()
            if not last.all():
                yield flush(rows[~last])
            held = [rows[last]]
            size = int(last.sum())
        rows = pd.concat(held, ignore_index=True) if held else None
        if rows is not None and len(rows):
            yield flush(rows)

    return run


def _fold(nodes: DataFrame, groups: list[str], bits: int, k: int) -> DataFrame:
    placed = nodes.repartition(*groups).sortWithinPartitions(*groups)
    return placed.mapInPandas(_folded(groups, bits, k), nodes.select(*groups, F.col("node").cast("bigint"), F.col("count").cast("bigint")).schema)


def digest(df: DataFrame, groups: list[str], value: str, bits: int = BITS, error: float = RANK_ERROR, low: float = 0.0, step: float = 1.0) -> DataFrame:
    """Digests of all groups: the group columns, node, count.

    A value's leaf is floor((value - low) / step), held within the universe;
    null and NaN are left out.  Equal leaves are counted before the shuffle,
    so no group sends more than its universe, and a group that holds most rows
    is spread over leaves until its at most 2**bits counts are folded.
    Group values may be null; names 'node', 'count' and '_leaf' are taken.
    """
    v = F.col(value).cast("double")
    leaf = F.greatest(F.lit(0.0), F.least(F.lit(float(2**bits - 1)), F.floor((v - low) / step).cast("double"))).cast("bigint")
    leaves = df.where(v.isNotNull() & ~F.isnan(v)).select(*groups, (leaf + F.lit(2**bits)).alias("node")).groupBy(*groups, "node").agg(F.count("*").alias("count"))
    return _fold(leaves, groups, bits, round(bits / error))


def merge(digests: list[DataFrame], groups: list[str], bits: int = BITS, error: float = RANK_ERROR) -> DataFrame:
    """The digest of all rows together; the digests must have the same bits, low and step."""
    together = reduce(lambda a, b: a.unionByName(b), digests)
    return _fold(together.groupBy(*groups, "node").agg(F.sum("count").alias("count")), groups, bits, round(bits / error))


def percentiles(nodes: DataFrame, groups: list[str], at: list[float], bits: int = BITS, low: float = 0.0, step: float = 1.0) -> DataFrame:
    """One row per group and p: n, value, rank_low and rank_high.

    The number of values up to ``value`` lies between rank_low and rank_high,
    which differ by no more than bits * n / k.  The asked rank is ceil(p * n),
    at least 1; ``value`` holds it, or a rank that far from it at most.
    """
    depth = F.floor(F.log2(F.col("node").cast("double")) + F.lit(1e-12)).cast("int")
    upper = F.expr(f"shiftleft(node + 1, {bits} - depth) - 1 - {2**bits}")
    lower = F.expr(f"shiftleft(node, {bits} - depth) - {2**bits}")
    spread = nodes.withColumn("depth", depth).withColumn("upper", upper).withColumn("lower", lower)
    by = Window.partitionBy(*groups)
    order = by.orderBy("upper", F.col("depth").desc())
    summed = spread.withColumn("cum", F.sum("count").over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("n", F.sum("count").over(by))
    rank = {p: F.greatest(F.ceil(F.lit(p) * F.col("n") - F.lit(1e-9)), F.lit(1)) for p in at}
    picked = summed.groupBy(*groups).agg(F.first("n").alias("n"), *[F.min(F.when(F.col("cum") >= rank[p], F.col("upper"))).alias(f"_v{i}") for i, p in enumerate(at)])
    answers = picked.select(*groups, "n", F.explode(F.array(*[F.struct(F.lit(p).alias("p"), F.col(f"_v{i}").alias("leaf")) for i, p in enumerate(at)])).alias("_a")).select(*groups, "n", "_a.p", "_a.leaf")
    same = reduce(lambda a, b: a & b, [F.col(f"a.{g}").eqNullSafe(F.col(f"s.{g}")) for g in groups])
    bounds = (
        answers.alias("a").join(spread.alias("s"), same)
        .groupBy(*[F.col(f"a.{g}").alias(g) for g in groups], F.col("a.n").alias("n"), F.col("a.p").alias("p"), F.col("a.leaf").alias("leaf"))
        .agg(
            F.sum(F.when(F.col("s.upper") <= F.col("a.leaf"), F.col("s.count")).otherwise(0)).alias("rank_low"),
            F.sum(F.when(F.col("s.lower") <= F.col("a.leaf"), F.col("s.count")).otherwise(0)).alias("rank_high"),
        )
    )
    return bounds.select(*groups, "n", "p", (F.col("leaf") * step + low).alias("value"), "rank_low", "rank_high")
