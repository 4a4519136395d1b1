"""Evaluation texts leaking into training text.

Size-partitioned MinHash containment search.  The smallest passage that counts
is a window of ``words`` words of an item, or a whole item that is shorter;
windows are partitioned by their size.  Each one is a small set of word
shingles with a signature of several permutations' minima.  A document holds
far more shingles than an item, so it has a signature for each of its windows
of every size that occurs: a contained window always has the item's minima,
and containment in a long document becomes a look-up.  What agrees is verified
by exact containment of the window's words.

The signatures of all items are computed once and sent out as sorted arrays of
at most ``block_keys`` numbers; the items' texts stay in a table that the few
hits are joined with.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagequarry.session import staged

WORDS = 12
SHINGLE = 5
PERMUTATIONS = 3
BLOCK_KEYS = 8_000_000  # signatures one pass over the documents looks up: 64 MB
_CHARS = 4_000_000
_WORD = re.compile(r"[^\W_]+")
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def words_of(text: str) -> list[str]:
    """Runs of letters and digits in lower case."""
    return _WORD.findall(text.lower())


def _hashes(words: list[str]) -> np.ndarray:
    codes, distinct = pd.factorize(np.array(words, dtype=object))
    return np.fromiter((xxhash.xxh3_64_intdigest(w) for w in distinct), np.uint64, len(distinct))[codes]


def _scrambled(h: np.ndarray, seed: int) -> np.ndarray:
    h = (h ^ np.uint64(seed * 0x632BE59BD9B4E019 & 0xFFFFFFFFFFFFFFFF)) * _MIX[1]
    h ^= h >> np.uint64(31)
    h = h * _MIX[2]
    return h ^ (h >> np.uint64(29))


def _shingles(word: np.ndarray, k: int) -> np.ndarray:
    n = max(0, word.size - k + 1)
    h = np.zeros(n, dtype=np.uint64)
    for j in range(k):
        h = (h ^ word[j : j + n]) * _MIX[j]
        h ^= h >> np.uint64(29)
    return h


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """The minimum of every ``width`` neighbours."""
    length = 1
    while 2 * length <= width:
        values = np.minimum(values[:-length], values[length:])
        length *= 2
    rest = width - length
    return np.minimum(values[:-rest], values[rest:]) if rest else values


def signatures(word: np.ndarray, sizes: list[int]) -> Iterator[tuple[int, np.ndarray]]:
    """For each size the signatures of all windows of so many words: the minima of all permutations in one number."""
    permuted: dict[int, list[np.ndarray]] = {}
    for size in sizes:
        k = min(SHINGLE, size)
        if word.size < size:
            yield size, np.empty(0, dtype=np.uint64)
            continue
        if k not in permuted:
            plain = _shingles(word, k)
            permuted[k] = [_scrambled(plain, p + 1) for p in range(PERMUTATIONS)]
        one = np.full(word.size - size + 1, np.uint64(size))
        for values in permuted[k]:
            one = (one ^ _least(values, size - k + 1)) * _MIX[0]
            one ^= one >> np.uint64(32)
        yield size, one


def item_windows(items: DataFrame, item_id: str, item_text: str, words: int = WORDS) -> DataFrame:
    """item_id, size, window, signature: every distinct window of every item, a shorter item being one window."""
    named = items.select(F.col(item_id).alias("item_id"), F.col(item_text).alias("item_text")).dropna()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, text in enumerate(batch.column(1)):
                own = words_of(text.as_py())
                size = min(words, len(own))
                if not size:
                    continue
                found: dict[str, int] = {}
                for _, values in signatures(_hashes(own), [size]):
                    for p, v in enumerate(values.view(np.int64).tolist()):
                        found.setdefault(" ".join(own[p : p + size]), v)
                n = len(found)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array([i] * n, pa.int64())), pa.array([size] * n, pa.int32()), pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())],
                    ["item_id", "size", "window", "signature"],
                )

    return named.mapInArrow(run, f"item_id {dict(items.dtypes)[item_id]}, size int, window string, signature bigint").dropDuplicates(["item_id", "window"])


class Signatures:
    """A block of signatures to look up."""

    def __init__(self, keys: np.ndarray):
        self.keys = np.sort(keys.view(np.uint64))
        bits = max(16, min(26, int(keys.size * 8).bit_length()))
        self.mask = np.uint64((1 << bits) - 1)
        self.table = np.zeros(1 << bits, dtype=bool)
        self.table[(self.keys & self.mask).astype(np.int64)] = True

    def hits(self, values: np.ndarray) -> np.ndarray:
        """Positions of the values that are among the keys."""
        maybe = np.flatnonzero(self.table[(values & self.mask).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.keys, values[maybe]), self.keys.size - 1)
        return maybe[self.keys[at] == values[maybe]]


def _windows_found(index: Signatures, texts: list[str], sizes: list[int]) -> set[tuple[int, str]]:
    """(number of the text, window) for every window of a text whose signature is in the index."""
    words: list[str] = []
    ends = []
    for t in texts:
        words += words_of(t)
        ends.append(len(words))
    if not words:
        return set()
    end, found = np.array(ends), set()
    for size, values in signatures(_hashes(words), sizes):
        at = index.hits(values)
        doc = np.searchsorted(end, at, side="right")
        inside = at + size <= end[doc]
        found.update((d, " ".join(words[p : p + size])) for p, d in zip(at[inside].tolist(), doc[inside].tolist(), strict=True))
    return found


def leaks(documents: DataFrame, items: DataFrame, doc_id: str, text: str, item_id: str, item_text: str, words: int = WORDS, block_keys: int = BLOCK_KEYS) -> DataFrame:
    """One row per document and item that leaked into it: doc_id, item_id, containment.

    An item leaks when ``words`` consecutive words of it, or all of a shorter
    one, are consecutive words of the document; containment is the share of
    its distinct windows found there.  Null texts and items without a word
    give nothing; repeated ids are one document, one item.  The documents are
    read once for each block of signatures and never shuffled; only the hits are.
    """
    spark = documents.sparkSession
    windows = staged(item_windows(items, item_id, item_text, words), "leak-windows")
    keys = windows.select("signature").distinct()
    blocks, most = 1, keys.count()
    while most > block_keys:
        blocks = max(blocks + 1, -(-most * blocks // block_keys))
        most = keys.groupBy(F.pmod(F.xxhash64("signature"), F.lit(blocks))).count().agg(F.max("count")).first()[0]
    sizes = sorted(r[0] for r in windows.select("size").distinct().collect())
    docs = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).dropna()

    def block(number: int) -> DataFrame:
        part = keys.where(F.pmod(F.xxhash64("signature"), F.lit(blocks)) == number)
        shared = spark.sparkContext.broadcast(np.sort(part.toArrow().column("signature").to_numpy()))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = Signatures(shared.value)
            for batch in batches:
                ids, texts = batch.column(0), batch.column(1).to_pylist()
                start = 0
                while start < len(texts) and sizes:
                    stop, size = start, 0
                    while stop < len(texts) and (stop == start or size < _CHARS):
                        size += len(texts[stop])
                        stop += 1
                    found = list(_windows_found(index, texts[start:stop], sizes))
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array([start + d for d, _ in found], pa.int64())), pa.array([w for _, w in found], pa.string())], ["doc_id", "window"])
                    start = stop

        return docs.mapInArrow(run, f"doc_id {dict(documents.dtypes)[doc_id]}, window string")

    hits = block(0)
    for number in range(1, blocks):
        hits = hits.unionByName(block(number))
    totals = windows.groupBy("item_id").agg(F.count("*").alias("total"))
    verified = hits.join(windows.select("item_id", "window"), "window").groupBy("doc_id", "item_id").agg(F.count_distinct("window").alias("found"))
    return verified.join(totals, "item_id").select("doc_id", "item_id", (F.col("found") / F.col("total")).alias("containment"))
