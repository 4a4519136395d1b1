"""Long exact spans shared between records.

1. Winnowed character grams mark each text so that any span of the asked
   length holds a mark.  A span goes on for half the rest of its length at
   least, to the left or to the right of the mark; that stretch with the mark
   is a seed.  Seeds found in one text only can't belong to a shared span;
   what lies around the others are the regions to search.
2. Regions are dealt to shards by text.  A shard holds a compressed FM-index:
   a wavelet matrix over the Burrows-Wheeler transform of its regions.
3. Regions are streamed to the shards in which their seeds occur.  Every span
   of the asked length covers one whole block of half that length; backward
   search takes all blocks of a stream at once, drops those that match nothing
   else and yields the places where the rest occur.
4. Each place is verified and extended on the texts themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagequarry.session import staged

LEAST = 300
GRAM = 64
SHARD_CHARS = 1_000_000
STREAM_CHARS = 4_000_000
_CHARS = 4_000_000
_SPARE = 100
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)]


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)


def _gram_hashes(codes: np.ndarray, gram: int) -> np.ndarray:
    """A hash of every ``gram`` characters, built from hashes of half the length; gram is a power of two."""
    h = (codes.astype(np.uint64) + np.uint64(1)) * _ODD[0]
    h ^= h >> np.uint64(31)
    length, step = 1, 1
    while length < gram:
        h = h[:-length] * _ODD[step % len(_ODD)] + h[length:] if h.size > length else h[:0]
        h ^= h >> np.uint64(32)
        length, step = 2 * length, step + 1
    return h


def _sliding(a: np.ndarray, width: int, pick) -> np.ndarray:
    """Minimum or maximum (pick) of every ``width`` neighbours."""
    length = 1
    while 2 * length <= width:
        a = pick(a[:-length], a[length:])
        length *= 2
    rest = width - length
    return pick(a[:-rest], a[rest:]) if rest else a


def marks(h: np.ndarray, least: int, gram: int) -> np.ndarray:
    """Positions of grams whose hash is the smallest of some window of ``least`` characters."""
    width = least - gram + 1
    if h.size < width:
        return np.empty(0, dtype=np.int64)
    low = _sliding(h, width, np.minimum)
    edge = np.zeros(width - 1, dtype=np.uint64)
    return np.flatnonzero(_sliding(np.concatenate([edge, low, edge]), width, np.maximum) == h)


def seeds(codes: np.ndarray, least: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of marks and hashes of the seeds they belong to, one to the left and one to the right.

    Of equal seeds that stand close together, as in periodic text, one is kept.
    """
    h = _gram_hashes(codes, gram)
    at = marks(h, least, gram)
    side = -(-(least - gram) // 2)
    positions, values = [], []
    for offsets in ([*range(-side, 0, gram), 0], [*range(0, side, gram), side]):
        p = at[(at + offsets[0] >= 0) & (at + offsets[-1] < h.size)]
        v = np.full(p.size, np.uint64(offsets[-1] + 1))
        for o in offsets:
            v = (v ^ h[p + o]) * _ODD[1]
            v ^= v >> np.uint64(31)
        if p.size and (v[1:] == v[:-1]).any():
            _, one = np.unique(np.stack([v, (p // _SPARE).astype(np.uint64)]), axis=1, return_index=True)
            p, v = p[np.sort(one)], v[np.sort(one)]
        positions.append(p)
        values.append(v)
    return np.concatenate(positions), np.concatenate(values)


class FMIndex:
    """Backward search over many texts; correct for patterns of up to ``context`` characters.

    Suffixes are sorted by their first ``context`` characters or more: backward
    search only counts, so suffixes that agree that far may stand in any order.
    That order has no walk back to sampled places, so every place is kept, in
    four bytes.
    """

    def __init__(self, texts: list[np.ndarray], context: int):
        joined = np.concatenate([x for t in texts for x in (t + np.uint32(1), np.zeros(1, dtype=np.uint32))])
        self.starts = np.cumsum([0] + [t.size + 1 for t in texts[:-1]])
        self.alphabet, symbols = np.unique(joined, return_inverse=True)
        self.n = joined.size
        suffixes = self._sort(symbols.astype(np.int64), context)
        self._wavelet(symbols[suffixes - 1].astype(np.int64))
        self.suffixes = suffixes.astype(np.int32 if self.n < 2**31 else np.int64)
        counts = np.bincount(symbols, minlength=self.alphabet.size)
        self.first = np.concatenate([[0], np.cumsum(counts)[:-1]]) - self._descend(np.zeros(self.alphabet.size, dtype=np.int64), np.arange(self.alphabet.size))

    def _sort(self, symbols: np.ndarray, context: int) -> np.ndarray:
        bits = max(1, int(self.alphabet.size).bit_length())
        packed, length = symbols.copy(), 1
        while (length + 1) * bits <= 62:
            packed = (packed << bits) | np.concatenate([symbols[length:], np.zeros(min(length, self.n), dtype=np.int64)])[: self.n]
            length += 1
        order = np.argsort(packed, kind="stable")
        while True:
            key = packed[order]
            rank = np.empty(self.n, dtype=np.int64)
            steps = np.concatenate([[0], np.cumsum(key[1:] != key[:-1])])
            rank[order] = steps
            if length >= context or steps[-1] == self.n - 1:
                return order
            behind = np.concatenate([rank[length:] + 1, np.zeros(min(length, self.n), dtype=np.int64)])[: self.n]
            packed = rank * (self.n + 1) + behind
            order = np.argsort(packed, kind="stable")
            length *= 2

    def _wavelet(self, bwt: np.ndarray) -> None:
        self.levels = []
        for level in range(max(1, int(self.alphabet.size - 1).bit_length()) - 1, -1, -1):
            bit = (bwt >> level) & 1
            words, before = self._bits(bit)
            zeros = int(self.n - bit.sum())
            self.levels.append((level, words, before, zeros))
            bwt = np.concatenate([bwt[bit == 0], bwt[bit == 1]])

    def _bits(self, flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Packed flags, and how many are set before each word."""
        padded = np.zeros((self.n // 64 + 1) * 64, dtype=np.uint8)
        padded[: self.n] = flags
        words = np.packbits(padded, bitorder="little").view(np.uint64)
        return words, np.concatenate([[0], np.cumsum(np.bitwise_count(words).astype(np.int64))[:-1]])

    def _descend(self, at: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        for level, words, before, zeros in self.levels:
            w = at >> 6
            ones = before[w] + np.bitwise_count(words[w] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)))
            at = np.where((symbol >> level) & 1, zeros + ones, at - ones)
        return at

    def search(self, codes: np.ndarray, starts: np.ndarray, length: int, enough: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the blocks of ``codes`` at ``starts``, those that occur ``enough`` times: number, and their range of suffixes."""
        symbol = np.searchsorted(self.alphabet, codes + np.uint32(1))
        symbol[symbol == self.alphabet.size] = 0
        symbol[self.alphabet[symbol] != codes + np.uint32(1)] = -1
        lane = np.arange(starts.size)
        low, high = np.zeros(lane.size, dtype=np.int64), np.full(lane.size, self.n, dtype=np.int64)
        for step in range(length - 1, -1, -1):
            c = symbol[starts[lane] + step]
            known = c >= 0
            lane, low, high, c = lane[known], low[known], high[known], c[known]
            low, high = self.first[c] + self._descend(low, c), self.first[c] + self._descend(high, c)
            alive = high - low >= enough[lane]
            lane, low, high = lane[alive], low[alive], high[alive]
            if not lane.size:
                break
        return lane, low, high

    def places(self, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of the text and position in it."""
        at = self.suffixes[ranks].astype(np.int64)
        text = np.searchsorted(self.starts, at, side="right") - 1
        return text, at - self.starts[text]


def _runs(equal: np.ndarray, least: int) -> list[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(np.concatenate([[0], equal.view(np.int8), [0]])))
    return [(int(s), int(e)) for s, e in zip(edges[::2], edges[1::2], strict=True) if e - s >= least]


def match_regions(index_side: pd.DataFrame, stream: pd.DataFrame, least: int) -> list[tuple]:
    """(doc_a, doc_b, start_a, start_b, length) of maximal common spans; both sides have doc_id, start, text, and stream says whether it is at home."""
    if not len(index_side) or not len(stream):
        return []
    block = least // 2
    texts = [_codes(t) for t in index_side["text"]]
    index = FMIndex(texts, block)
    ids, offsets = index_side["doc_id"].to_numpy(), index_side["start"].to_numpy()
    q_texts = [_codes(t) for t in stream["text"]]
    q_ids, q_offsets, home = stream["doc_id"].to_numpy(), stream["start"].to_numpy(), stream["home"].to_numpy(dtype=bool)
    q_base = np.cumsum([0] + [t.size for t in q_texts[:-1]])
    blocks = np.array([t.size // block for t in q_texts])
    owner = np.repeat(np.arange(blocks.size), blocks)
    inside = (np.arange(owner.size) - np.repeat(np.cumsum(blocks) - blocks, blocks)) * block
    lane, low, high = index.search(np.concatenate(q_texts), q_base[owner] + inside, block, np.where(home[owner], 2, 1))
    spans: dict[tuple, None] = {}
    for a in range(0, lane.size, 20_000):
        n = (high - low)[a : a + 20_000]
        at = np.repeat(low[a : a + 20_000] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        text, place = index.places(at)
        q = np.repeat(owner[lane[a : a + 20_000]], n)
        shift = place - np.repeat(inside[lane[a : a + 20_000]], n)
        other = (ids[text] != q_ids[q]) & (~home[q] | (ids[text] > q_ids[q]))
        found = np.unique(np.stack([q[other], text[other], shift[other]], axis=1), axis=0)
        for i, j, s in found.tolist():
            x, y = q_texts[i], texts[j]
            lo, hi = max(0, -s), min(x.size, y.size - s)
            for b, e in _runs(x[lo:hi] == y[lo + s : hi + s], least):
                one = (int(q_ids[i]), int(q_offsets[i]) + lo + b, int(ids[j]), int(offsets[j]) + lo + b + s, e - b)
                spans[one if one[0] < one[2] else (*one[2:4], *one[:2], one[4])] = None
    return [(a, b, sa, sb, n) for a, sa, b, sb, n in spans]


def shared_spans(documents: DataFrame, doc_id: str, text: str, least: int = LEAST, shard_chars: int = SHARD_CHARS, stream_chars: int = STREAM_CHARS) -> DataFrame:
    """Maximal spans of at least ``least`` characters that two documents have in common.

    doc_a < doc_b, start_a, start_b, length, in characters; characters compare
    exactly, white space included.  doc_id is a whole number; rows with the
    same doc_id never pair.  Null texts and shorter ones have no spans.  A
    span occurring at several places has a row for each combination of places.
    """
    gram = GRAM
    while gram > max(1, least // 3):
        gram //= 2
    docs = documents.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text")).where(F.col("doc_id").isNotNull() & (F.length("text") >= least))

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def one(ids, positions, hashes):
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (ids, positions, hashes)], ["doc_id", "position", "seed"])

        for batch in batches:
            ids, positions, hashes, size = [], [], [], 0
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                p, h = seeds(_codes(t.as_py()), least, gram)
                ids.append(np.full(p.size, i, dtype=np.int64))
                positions.append(p.astype(np.int32))
                hashes.append(h.view(np.int64))
                size += p.size
                if size > 500_000:
                    yield one(ids, positions, hashes)
                    ids, positions, hashes, size = [], [], [], 0
            if ids:
                yield one(ids, positions, hashes)

    every = staged(docs.mapInArrow(mark, "doc_id bigint, position int, seed bigint"), "span-seeds")
    common = every.groupBy("seed").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where(F.col("a") != F.col("b")).select("seed")
    hits = staged(every.join(common, "seed"), "span-hits")
    shards = max(1, -(-hits.count() * (least - gram) // (4 * shard_chars)))
    home = F.expr(f"cast(pmod(xxhash64(doc_id), {shards}) as int)")

    near = hits.groupBy("doc_id").agg(F.array_sort(F.collect_set("position")).alias("at"))

    def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        margin = least + _SPARE
        for batch in batches:
            ids, starts, parts = [], [], []
            for i, t, at in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                p = np.array(at)
                new = np.flatnonzero(np.diff(p) > 2 * margin + gram)
                for s, e in zip(np.concatenate([[0], new + 1]), np.concatenate([new, [p.size - 1]]), strict=True):
                    start = max(0, int(p[s]) - margin)
                    ids.append(i)
                    starts.append(start)
                    parts.append(t[start : int(p[e]) + gram + margin])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(starts, pa.int32()), pa.array(parts, pa.string())], ["doc_id", "start", "text"])

    regions = staged(docs.join(near, "doc_id").select("doc_id", "text", "at").mapInArrow(cut_out, "doc_id bigint, start int, text string"), "span-regions")
    homes = hits.select("seed", home.alias("shard")).distinct()
    routes = hits.select("doc_id", "seed", home.alias("own")).join(homes, "seed").where(F.col("shard") >= F.col("own")).select("doc_id", "shard", (F.col("shard") == F.col("own")).alias("home")).distinct()
    stream = staged(regions.join(routes, "doc_id"), "span-streams")
    # A shard with a long stream is searched in several lots, each with its own copy of the index; the others are built once.
    lots = stream.groupBy("shard").agg(F.ceil(F.sum(F.length("text")) / stream_chars).cast("int").alias("lots"))
    stream = stream.join(lots, "shard").withColumn("lot", F.expr("cast(pmod(xxhash64(doc_id, 7), lots) as int)")).drop("lots")
    held = regions.withColumn("shard", home).join(lots, "shard").withColumn("lot", F.explode(F.sequence(F.lit(0), F.col("lots") - 1))).drop("lots")

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        rows = np.array(match_regions(left, right, least), dtype=np.int64).reshape(-1, 5)
        return pd.DataFrame({"doc_a": rows[:, 0], "doc_b": rows[:, 1], "start_a": rows[:, 2].astype("int32"), "start_b": rows[:, 3].astype("int32"), "length": rows[:, 4].astype("int32")})

    found = held.groupBy("shard", "lot").cogroup(stream.groupBy("shard", "lot")).applyInPandas(search, "doc_a bigint, doc_b bigint, start_a int, start_b int, length int")
    return found.distinct()


def shared_shares(spans: DataFrame, documents: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Per document: doc_id, chars, shared_chars, share; overlapping spans count once. Without a shared span (or text) the share is 0."""
    a = spans.select(F.col("doc_a").alias("doc_id"), F.col("start_a").alias("start"), (F.col("start_a") + F.col("length")).alias("end"))
    b = spans.select(F.col("doc_b").alias("doc_id"), F.col("start_b").alias("start"), (F.col("start_b") + F.col("length")).alias("end"))
    before = Window.partitionBy("doc_id").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    one = a.unionByName(b).groupBy("doc_id", "start").agg(F.max("end").alias("end"))
    new = one.withColumn("from", F.greatest("start", F.coalesce(F.max("end").over(before), F.lit(0))))
    covered = new.groupBy("doc_id").agg(F.sum(F.greatest(F.col("end") - F.col("from"), F.lit(0))).alias("shared_chars"))
    sizes = documents.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.length(text).alias("chars")).dropDuplicates(["doc_id"])
    shared = sizes.join(covered, "doc_id", "left").withColumn("shared_chars", F.coalesce("shared_chars", F.lit(0)))
    share = F.when(F.col("shared_chars") > 0, F.round(F.col("shared_chars") / F.col("chars"), 6)).otherwise(F.lit(0.0))
    return shared.select("doc_id", "chars", "shared_chars", share.alias("share"))
