"""Mixing sources to target weights.

Each source is put in a random order, its records laid end to end by size and
the sequence repeated as often as it may be used; the front of it, up to the
source's quota, is the source's part of the mix, cut into blocks.  A splitting
tree deals the blocks to output shards: every node draws from the
multivariate hypergeometric distribution how many blocks of each source go to
its left half.  Any node can be drawn anew from its seed, so a task finds the
shard of a block by walking down, and nothing is gathered.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache
from math import gcd

import numpy as np
import pandas as pd
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagequarry.session import staged

#: How the byte-level vocabulary cuts text into pieces; fixed by the vocabulary.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
BLOCK_TOKENS, SHARD_TOKENS = 4096, 1 << 20
_BUCKET_ROWS = 20_000
_MOST_SOURCES = 10_000


def _encoding(path: str) -> tiktoken.Encoding:
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("byte-bpe", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={})


def with_tokens(df: DataFrame, text: str, vocabulary: str, keep: list[str]) -> DataFrame:
    """The columns ``keep`` and tokens, the number of tokens of the whole text; null counts 0.

    vocabulary: path of a byte-level vocabulary in tiktoken's format, readable by every executor.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = _encoding(vocabulary).encode_ordinary
        for batch in batches:
            counts = [len(encode(t)) if isinstance(t, str) else 0 for t in batch["_text"]]
            yield batch[keep].assign(tokens=np.array(counts, dtype=np.int64))

    chosen = df.select(*keep, F.col(text).alias("_text"))
    return chosen.mapInPandas(run, f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in df.select(*keep).schema)}, tokens bigint")


class SplittingTree:
    """Deals blocks of several sources to ``shards`` shards; a pure function of its arguments."""

    def __init__(self, blocks: list[int], shards: int, seed: int):
        self.blocks, self.shards, self.seed = np.array(blocks, dtype=np.int64), shards, seed
        self.draw = lru_cache(maxsize=200_000)(self._draw)
        self.steps = []
        for i, n in enumerate(blocks):  # an affine permutation of each source's blocks
            a = int(np.random.default_rng([seed, i]).integers(1, max(2, n)))
            while n > 1 and gcd(a, n) != 1:
                a += 1
            self.steps.append((a, int(np.random.default_rng([seed, i, 1]).integers(0, max(1, n)))))

    def _draw(self, low: int, high: int, here: tuple[int, ...]) -> tuple[int, ...]:
        """How many blocks of each source go to shards [low, middle) of those that shards [low, high) get."""
        middle = (low + high) // 2
        total = sum(here)
        left = round(total * (middle - low) / (high - low))
        rng = np.random.default_rng([self.seed, low, high])
        return tuple(int(x) for x in rng.multivariate_hypergeometric(here, left, method="marginals"))

    def shard(self, source: np.ndarray, block: np.ndarray) -> np.ndarray:
        """The shard of each block."""
        place = np.array([(self.steps[s][0] * b + self.steps[s][1]) % int(self.blocks[s]) for s, b in zip(source.tolist(), block.tolist(), strict=True)], dtype=np.int64)
        result = np.zeros(source.size, dtype=np.int64)
        stack = [(0, self.shards, tuple(self.blocks.tolist()), np.arange(source.size))]
        while stack:
            low, high, here, mine = stack.pop()
            if not mine.size:
                continue
            if high - low == 1:
                result[mine] = low
                continue
            middle = (low + high) // 2
            left = self.draw(low, high, here)
            takes = np.array(left, dtype=np.int64)[source[mine]]
            goes = place[mine] < takes
            place[mine[~goes]] -= takes[~goes]
            stack.append((low, middle, left, mine[goes]))
            stack.append((middle, high, tuple(h - x for h, x in zip(here, left, strict=True)), mine[~goes]))
        return result


def mix(
    records: DataFrame,
    targets: DataFrame,
    record_id: str,
    source: str,
    size: str = "tokens",
    total: int | None = None,
    seed: int = 7,
    block_size: int = BLOCK_TOKENS,
    shard_size: int = SHARD_TOKENS,
) -> DataFrame:
    """shard, position, record id, source, use (1 for a record's first) and size: the mix, shuffled within each shard.

    targets has source, target_share and max_repeats.  A source that isn't
    listed, has no share, may not be used or holds nothing has no part; the
    shares of the others are scaled to sum to 1.  The mix is as large as the
    caps allow, or ``total`` if that is less; each source misses its quota by
    less than one record.  Records of null or no size, null ids and null
    sources are left out; ids are taken to be unique within a source.
    """
    wanted = targets.select("source", F.col("target_share").cast("double").alias("share"), F.col("max_repeats").cast("long").alias("uses")).where("share > 0 and uses > 0 and source is not null")
    sized = records.select(F.col(record_id).alias("id"), F.col(source).alias("source"), F.col(size).cast("bigint").alias("size")).where("size > 0 and id is not null and source is not null")
    sized = sized.join(wanted.select("source").distinct(), "source")
    sized = staged(sized.withColumn("draw", F.xxhash64(F.lit(seed), "id")), "mix-records")
    buckets = max(1, -(-sized.count() // _BUCKET_ROWS))
    placed = sized.withColumn("bucket", F.expr(f"cast(floor((draw / 18446744073709551616D + 0.5D) * {buckets}) as int)"))
    sums = placed.groupBy("source", "bucket").agg(F.sum("size").alias("n"))
    ahead = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("source", "bucket", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("source", "bucket").orderBy("draw", "id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    laid = placed.join(offsets, ["source", "bucket"]).withColumn("start", F.col("offset") + F.sum("size").over(inside) - F.col("size"))

    rows = sums.groupBy("source").agg(F.sum("n").alias("n")).join(wanted.groupBy("source").agg(F.max("share").alias("share"), F.max("uses").alias("uses")), "source").orderBy("source").limit(_MOST_SOURCES + 1).collect()
    if len(rows) > _MOST_SOURCES:
        raise ValueError(f"more than {_MOST_SOURCES} sources")
    schema = f"shard bigint, position int, {record_id} {dict(records.dtypes)[record_id]}, source string, use int, {size} bigint"
    if not rows:
        return records.sparkSession.createDataFrame([], schema)
    share = sum(r["share"] for r in rows)
    whole = min(r["n"] * r["uses"] * share / r["share"] for r in rows)
    whole = min(whole, total) if total is not None else whole
    names = [r["source"] for r in rows]
    quota = [int(whole * r["share"] / share) for r in rows]
    blocks = [-(-q // block_size) for q in quota]
    shards = max(1, -(-sum(quota) // shard_size))
    plan = records.sparkSession.createDataFrame([(r["source"], i, q, r["n"], r["uses"]) for i, (r, q) in enumerate(zip(rows, quota, strict=True))], "source string, number int, quota bigint, whole bigint, uses bigint")
    uses = laid.join(plan, "source").where("start < quota")
    last = F.least(F.col("uses") - 1, F.floor((F.col("quota") - 1 - F.col("start")) / F.col("whole")).cast("bigint"))
    drawn = uses.withColumn("again", F.explode(F.sequence(F.lit(0).cast("bigint"), last))).withColumn("block", F.floor((F.col("start") + F.col("again") * F.col("whole")) / block_size).cast("bigint"))

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tree = SplittingTree(blocks, shards, seed)
        for batch in batches:
            yield batch[["id", "number", "again", "size"]].assign(shard=tree.shard(batch["number"].to_numpy(dtype=np.int64), batch["block"].to_numpy(dtype=np.int64)))

    dealt = drawn.select("id", "number", "again", "size", "block").mapInPandas(deal, f"id {dict(sized.dtypes)['id']}, number int, again bigint, size bigint, shard bigint")
    order = Window.partitionBy("shard").orderBy(F.xxhash64(F.lit(seed), "id", "again"), "id", "again")
    named = F.element_at(F.array(*[F.lit(n) for n in names]), F.col("number") + 1)
    return dealt.select(
        "shard", F.row_number().over(order).alias("position"), F.col("id").alias(record_id), named.alias("source"), (F.col("again") + 1).cast("int").alias("use"), F.col("size").alias(size)
    )


def shares(mixed: DataFrame, targets: DataFrame, record_id: str, size: str = "tokens") -> DataFrame:
    """Per target source: target_share, tokens, share (of all tokens), records, distinct_records, most_uses, max_repeats."""
    used = mixed.select("source", F.col(record_id).alias("_id"), F.col(size).alias("_size")).groupBy("source", "_id").agg(F.count("*").alias("_uses"), F.sum("_size").alias("_size"))
    reached = used.groupBy("source").agg(F.sum("_size").alias("tokens"), F.sum("_uses").alias("records"), F.count("*").alias("distinct_records"), F.max("_uses").alias("most_uses"))
    joined = targets.select("source", "target_share", "max_repeats").join(reached, "source", "left").withColumn("all", F.sum("tokens").over(Window.partitionBy()))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return joined.select("source", "target_share", "max_repeats", zero("tokens"), F.round(F.coalesce(F.col("tokens") / F.col("all"), F.lit(0.0)), 6).alias("share"), zero("records"), zero("distinct_records"), zero("most_uses"))
