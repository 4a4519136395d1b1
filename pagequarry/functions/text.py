"""Text metrics as column expressions: words, sentences, syllables, reading ease, pixel width, simhash."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Widths of the characters from space to tilde in pixels, and of any other character.
PIXELS = [
    3.6, 3.6, 4.6, 7.2, 7.2, 11.5, 8.6, 2.5, 4.3, 4.3, 5.0, 7.6, 3.6, 4.3, 3.6, 3.6,
    7.2, 7.2, 7.2, 7.2, 7.2, 7.2, 7.2, 7.2, 7.2, 7.2, 3.6, 3.6, 7.6, 7.6, 7.6, 7.2,
    13.1, 8.6, 8.6, 9.3, 9.3, 8.6, 7.9, 10.0, 9.3, 3.6, 6.5, 8.6, 7.2, 10.8, 9.3, 10.0,
    8.6, 10.0, 9.3, 8.6, 7.9, 9.3, 8.6, 12.2, 8.6, 8.6, 7.9, 3.6, 3.6, 3.6, 6.1, 7.2,
    4.3, 7.2, 7.2, 6.5, 7.2, 7.2, 3.6, 7.2, 7.2, 2.9, 2.9, 6.5, 2.9, 10.8, 7.2, 7.2,
    7.2, 7.2, 4.3, 6.5, 3.6, 7.2, 6.5, 9.3, 6.5, 6.5, 6.5, 4.3, 3.4, 4.3, 7.6,
]
OTHER_PIXELS = 7.0

#: Words that are no keywords.
STOP_WORDS = [
    "the", "a", "an", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with", "by", "from", "as", "is", "was",
    "are", "were", "be", "been", "being", "have", "has", "had", "do", "does", "did", "will", "would", "could", "should", "may", "might", "shall",
    "can", "need", "it", "its", "this", "that", "these", "those", "i", "you", "he", "she", "we", "they", "me", "him", "her", "us",
    "them", "my", "your", "his", "our", "their", "not", "no", "all", "each", "every", "both", "few", "more", "most", "some", "any", "other",
    "such", "than", "too", "very", "just", "about", "up", "out", "how", "what", "which", "who", "when", "where", "why", "so", "if", "then",
    "also", "s", "t",
]


def collapsed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def words(text: Column) -> Column:
    """Words between white space; none for a blank text."""
    return F.filter(F.split(collapsed(text), " "), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.size(words(text))


def sentence_count(text: Column) -> Column:
    parts = F.filter(F.split(text, r"[.!?]+\s+|\n"), lambda p: F.trim(F.regexp_replace(p, r"\s+", " ")) != "")
    return F.greatest(F.size(parts), F.lit(1))


def syllable_count(text: Column) -> Column:
    """Vowel groups, a silent e less, at least one a word."""

    def one(w: Column) -> Column:
        n = F.regexp_count(w, F.lit("[aeiouy]+"))
        return F.greatest(n - F.when(w.endswith("e") & (n > 1), 1).otherwise(0), F.lit(1))

    return F.aggregate(words(F.lower(text)), F.lit(0), lambda total, w: total + one(w))


def reading_ease(word_total: Column, sentences: Column, syllables: Column) -> Column:
    """Flesch reading ease within 0 to 100, null under 30 words."""
    score = F.lit(206.835) - F.lit(1.015) * (word_total / sentences) - F.lit(84.6) * (syllables / word_total)
    return F.when(word_total >= 30, F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.round(score, 1))))


def pixel_width(text: Column) -> Column:
    """Width as a search result shows it, rounded half to even; 0 for null or empty."""
    widths = F.array(*[F.lit(w) for w in PIXELS])
    code = lambda c: F.ascii(c)
    width = lambda c: F.when(code(c).between(32, 126), F.element_at(widths, F.greatest(code(c) - 31, F.lit(1)))).otherwise(F.lit(OTHER_PIXELS))
    total = F.aggregate(F.split(text, ""), F.lit(0.0), lambda a, c: a + F.when(F.length(c) > 0, width(c)).otherwise(F.lit(0.0)))
    return F.when(F.coalesce(F.length(text), F.lit(0)) > 0, F.bround(F.round(total, 6), 0).cast("int")).otherwise(F.lit(0))


def content_hash(html: Column) -> Column:
    return F.md5(F.lower(collapsed(html)))


_OFFSET, _PRIME = np.uint64(14695981039346656037), np.uint64(1099511628211)


_TRIGRAMS_AT_ONCE = 200_000


def _gram_bits(grams: list[str]) -> np.ndarray:
    """One row of 64 votes, +1 or -1, for each gram's FNV-1a hash."""
    raw = [g.encode() for g in grams]
    size = np.array([len(r) for r in raw])
    data = np.zeros((len(raw), int(size.max())), dtype=np.uint64)
    for i, r in enumerate(raw):
        data[i, : len(r)] = np.frombuffer(r, dtype=np.uint8)
    h = np.full(len(raw), _OFFSET)
    for j in range(data.shape[1]):
        h = np.where(size > j, (h ^ data[:, j]) * _PRIME, h)
    return (((h[:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)).astype(np.int16) * 2 - 1).astype(np.int16)


def _simhashes(texts: list[str]) -> list[int]:
    """Signed 64-bit SimHashes over character trigrams; 0 for a blank text.  Each distinct trigram of the lot is hashed once."""
    flat = [" ".join(t.lower().split()) for t in texts]
    result = [0] * len(texts)
    long = [i for i, t in enumerate(flat) if len(t) >= 3]
    for i, t in enumerate(flat):
        if 0 < len(t) < 3:
            result[i] = _folded(_gram_bits([t])[0])
    start = 0
    while start < len(long):
        stop, n = start, 0
        while stop < len(long) and (stop == start or n < _TRIGRAMS_AT_ONCE):
            n += len(flat[long[stop]]) - 2
            stop += 1
        keys = []
        for i in long[start:stop]:
            c = np.frombuffer(flat[i].encode("utf-32-le"), dtype=np.uint32).astype(np.int64)
            keys.append((c[:-2] << 42) | (c[1:-1] << 21) | c[2:])
        distinct, which = np.unique(np.concatenate(keys), return_inverse=True)
        votes = _gram_bits([chr(k >> 42) + chr((k >> 21) & 0x1FFFFF) + chr(k & 0x1FFFFF) for k in distinct.tolist()])
        ends = np.cumsum([k.size for k in keys])
        for i, a, b in zip(long[start:stop], [0, *ends[:-1]], ends, strict=True):
            counts = np.bincount(which[a:b], minlength=distinct.size)
            here = np.flatnonzero(counts)
            result[i] = _folded(counts[here] @ votes[here].astype(np.int64))
        start = stop
    return result


def _folded(votes: np.ndarray) -> int:
    return int(np.packbits(votes > 0, bitorder="little").view(np.int64)[0])


def _simhash(text: str) -> int:
    return _simhashes([text])[0]


@F.pandas_udf(T.LongType())
def simhash(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        given = texts.notna().to_numpy()
        out = np.zeros(len(texts), dtype=np.int64)
        out[given] = _simhashes(texts[given].tolist())
        yield pd.Series(pd.array(out, dtype="Int64")).mask(~given)
