import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagequarry.llm import mixing

TARGETS = [("big", 0.5, 1), ("small", 0.3, 4), ("tiny", 0.2, 2), ("absent", 0.1, 3), ("barred", 0.1, 0)]


def setup(spark, n=3000):
    rng = random.Random(1)
    rows = [(i, "big" if i % 10 < 7 else "small" if i % 10 < 9 else "tiny", rng.randrange(1, 60), "x") for i in range(n)]
    rows += [(n + 1, "barred", 50, "x"), (n + 2, "unlisted", 50, "x"), (n + 3, "big", 0, "x"), (n + 4, "big", None, "x"), (n + 5, None, 9, "x"), (None, "big", 9, "x")]
    return rows, spark.createDataFrame(rows, "n long, src string, size long, bucket string"), spark.createDataFrame(TARGETS, "source string, target_share double, max_repeats int")


def test_shares_caps_and_shards(spark):
    rows, df, targets = setup(spark)
    mixed = mixing.mix(df, targets, "n", "src", "size", block_size=50, shard_size=4000).toPandas()
    by = mixed.groupby("source")["size"].sum()
    total = by.sum()
    for s, share in (("big", 0.5), ("small", 0.3), ("tiny", 0.2)):
        assert abs(by[s] - share * total) <= 3 * 60
    uses = mixed.groupby(["source", "n"]).agg(n=("use", "count"), most=("use", "max"))
    assert (uses.n == uses.most).all() and uses.groupby("source").n.max().to_dict() == {"big": 1, "small": uses.loc["small"].n.max(), "tiny": 2}
    assert uses.loc["small"].n.max() <= 4
    per = mixed.groupby("shard")["size"].sum()
    assert per.size == -(-int(total) // 4000) or abs(per.size - total / 4000) <= 1
    assert per.max() < 1.5 * per.mean()
    for _, part in mixed.groupby("shard"):
        assert sorted(part.position) == list(range(1, len(part) + 1))
        assert part.source.nunique() == 3
    again = mixing.mix(df.repartition(7), targets, "n", "src", "size", block_size=50, shard_size=4000).toPandas()
    order = ["shard", "position"]
    assert again.sort_values(order).reset_index(drop=True).equals(mixed.sort_values(order).reset_index(drop=True))
    report = {r.source: r for r in mixing.shares(df.sparkSession.createDataFrame(mixed), targets, "n", "size").collect()}
    assert report["absent"].share == 0 and abs(report["big"].share - 0.5) < 0.01 and report["tiny"].most_uses == 2


def test_total_nothing_and_one_record(spark):
    _, df, targets = setup(spark, 500)
    assert abs(mixing.mix(df, targets, "n", "src", "size", total=1000).agg(F.sum("size")).first()[0] - 1000) <= 3 * 60
    assert mixing.mix(df.limit(0), targets, "n", "src", "size").count() == 0
    one = spark.createDataFrame([(1, "big", 10)], "n long, src string, size long")
    assert [(r.n, r.use) for r in mixing.mix(one, targets, "n", "src", "size").collect()] == [(1, 1)]


@pytest.mark.parametrize("shards", [1, 2, 7, 33])
def test_tree_deals_every_block_once(shards):
    blocks = [100, 1, 57, 0]
    tree = mixing.SplittingTree(blocks, shards, 3)
    source = np.repeat(np.arange(4), blocks)
    got = tree.shard(source, np.concatenate([np.arange(b) for b in blocks]))
    counts = np.bincount(got, minlength=shards)
    assert counts.sum() == 158 and counts.max() - counts.min() <= 8 and set(got.tolist()) <= set(range(shards))
    assert (tree.shard(source[::-1], np.concatenate([np.arange(b) for b in blocks])[::-1])[::-1] == got).all()


def test_tokens_of_odd_texts(spark):
    df = spark.createDataFrame([(1, "Hello world"), (2, ""), (3, None), (4, "<|endoftext|> żó"), (5, "word " * 50000)], "n int, t string")
    got = {r.n: r.tokens for r in mixing.with_tokens(df, "t", "/opt/tokenizers/byte_bpe_50k.tiktoken", ["n"]).collect()}
    assert got[1] == 2 and got[2] == got[3] == 0 and got[4] > 3 and got[5] >= 50000
