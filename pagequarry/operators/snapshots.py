"""What changed between consecutive full snapshots of a table.

Keys get ordinals from a stored dictionary; they stay the same from snapshot to
snapshot and from run to run.  Within a chunk of ordinals every snapshot is one
compressed bitmap; AND-NOT of neighbours gives additions and removals, AND
gives the common keys, whose values are compared in vectors aligned by ordinal.
"""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagequarry.session import staged, work_path

CHUNK = 8192  # ordinals compared in one task
SPAN = 32  # pairs of snapshots compared in one task
_DEALERS = 1024
_SPARSE = 4096


class Bitmap:
    """A set of ordinals: sorted numbers while sparse, packed bits once dense."""

    __slots__ = ("bits", "few", "size")

    def __init__(self, ordinals: np.ndarray, size: int):
        self.size = size
        if ordinals.size <= min(_SPARSE, size // 32):
            self.few, self.bits = np.unique(ordinals), None
        else:
            flags = np.zeros(size, dtype=bool)
            flags[ordinals] = True
            self.few, self.bits = None, np.packbits(flags)

    def _packed(self) -> np.ndarray:
        if self.bits is not None:
            return self.bits
        flags = np.zeros(self.size, dtype=bool)
        flags[self.few] = True
        return np.packbits(flags)

    def _list(self, packed: np.ndarray) -> np.ndarray:
        return np.flatnonzero(np.unpackbits(packed, count=self.size))

    def and_not(self, other: Bitmap) -> np.ndarray:
        if self.few is not None and other.few is not None:
            return np.setdiff1d(self.few, other.few, assume_unique=True)
        return self._list(self._packed() & ~other._packed())

    def and_(self, other: Bitmap) -> np.ndarray:
        if self.few is not None and other.few is not None:
            return np.intersect1d(self.few, other.few, assume_unique=True)
        return self._list(self._packed() & other._packed())


class Ordinals:
    """The dictionary of keys, kept below ``path``: numbers from 0 for each series, never changed or given twice."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path = spark, (path or work_path(spark, "ordinals")).rstrip("/")

    def _parts(self) -> list[str]:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/part-*/_SUCCESS")
        found = where.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(where)
        return [str(f.getPath().getParent().toString()) for f in found] if found else []

    def extend(self, keys: DataFrame) -> DataFrame:
        """series, key, ordinal of all keys so far; those of ``keys`` (series, key) that are new are numbered and added.

        New keys of a series are dealt to parts by their hash and numbered
        part by part, so that a series with most keys is no single task.
        """
        parts = self._parts()
        new = keys.select("series", "key").distinct()
        schema = new.withColumn("ordinal", F.lit(0).cast("bigint")).schema
        known = self.spark.read.schema(schema).parquet(*parts) if parts else None
        if known is not None:
            new = new.join(known, ["series", "key"], "left_anti")
        dealt = new.withColumn("_dealer", F.pmod(F.xxhash64("key"), F.lit(_DEALERS)).cast("int"))
        order = Window.partitionBy("series", "_dealer")
        ranked = staged(dealt.withColumn("_rank", F.row_number().over(order.orderBy("key")) - 1), "ordinals-new")
        counts = ranked.groupBy("series", "_dealer").agg(F.count("*").alias("n"))
        before = Window.partitionBy("series").orderBy("_dealer").rowsBetween(Window.unboundedPreceding, -1)
        offsets = counts.select("series", "_dealer", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_offset"))
        if known is not None:
            top = known.groupBy("series").agg((F.max("ordinal") + 1).alias("_next"))
            offsets = offsets.join(top, "series", "left").select("series", "_dealer", (F.col("_offset") + F.coalesce("_next", F.lit(0))).alias("_offset"))
        at = f"{self.path}/part-{len(parts):06d}-{uuid.uuid4().hex}"
        ranked.join(offsets, ["series", "_dealer"]).select("series", "key", (F.col("_offset") + F.col("_rank")).cast("bigint").alias("ordinal")).write.parquet(at)
        return self.spark.read.schema(schema).parquet(*parts, at)


def _differ(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Null-safe inequality of two object vectors."""
    null_a, null_b = pd.isna(a), pd.isna(b)
    return np.where(null_a | null_b, null_a != null_b, a != b)


def _compare(columns: list[str], size: int, span: int):
    def chunk(rows: pd.DataFrame) -> pd.DataFrame:
        keys = np.empty(size, dtype=object)
        keys[rows["place"].to_numpy()] = rows["key"].to_numpy(dtype=object)
        last, block = int(rows["last"].iloc[0]), int(rows["block"].iloc[0])
        parts = {}
        for seq, part in rows.groupby("seq", sort=False):
            at = part["place"].to_numpy()
            vectors = []
            for c in columns:
                v = np.empty(size, dtype=object)
                v[at] = part[c].to_numpy(dtype=object)
                vectors.append(v)
            parts[int(seq)] = (Bitmap(at, size), vectors)
        none = (Bitmap(np.empty(0, dtype=np.int64), size), None)
        seqs, found, kinds = [], [], []

        def emit(seq: int, ordinals: np.ndarray, kind: str) -> None:
            seqs.extend([seq] * ordinals.size)
            found.append(ordinals)
            kinds.extend([kind] * ordinals.size)

        for seq in sorted({s for k in parts for s in (k, k + 1) if 1 < s <= last and (s - 2) // span == block}):
            (before, old), (after, new) = parts.get(seq - 1, none), parts.get(seq, none)
            emit(seq, after.and_not(before), "added")
            emit(seq, before.and_not(after), "removed")
            both = after.and_(before)
            if both.size:
                changed = np.zeros(both.size, dtype=bool)
                for a, b in zip(old, new, strict=True):
                    changed |= _differ(a[both], b[both]).astype(bool)
                emit(seq, both[changed], "changed")
        at = np.concatenate(found) if found else np.empty(0, dtype=np.int64)
        plain = {"series": [rows["series"].iloc[0]] * len(seqs), "key": keys[at], "change_type": kinds}
        return pd.DataFrame({"seq": np.array(seqs, dtype="int32")} | {k: pd.Series(v, dtype=object) for k, v in plain.items()})

    return chunk


def number_snapshots(snapshots: DataFrame, series: str, snapshot: str, taken_at: str) -> DataFrame:
    """series, snapshot, seq (1 = first) and last (seq of the series' newest), by time, then snapshot id; null times come first."""
    known = snapshots.select(F.col(series).alias("series"), F.col(snapshot).alias("snapshot"), F.col(taken_at).alias("_at")).dropDuplicates(["snapshot"])
    by = Window.partitionBy("series")
    return known.select(
        "series",
        "snapshot",
        F.row_number().over(by.orderBy(F.col("_at").asc_nulls_first(), "snapshot")).alias("seq"),
        F.count("*").over(by).cast("int").alias("last"),
    )


def snapshot_changes(
    rows: DataFrame, snapshots: DataFrame, snapshot: str, key: str, columns: list[str], version: list[str], ordinals: Ordinals | None = None, chunk: int = CHUNK, span: int = SPAN
) -> DataFrame:
    """Keys added, removed or changed in each snapshot against the one before it in its series.

    rows: one per record, with ``snapshot``, ``key``, the compared ``columns``
    and ``version``, columns whose greatest values say which of several rows
    of one key in one snapshot counts.  snapshots: from ``number_snapshots``.
    ordinals: the dictionary of earlier runs, which is extended by new keys;
    without one a new dictionary is begun.

    Result: snapshot (the later one), key, change_type.  Values compare
    exactly, null equals null.  Rows with a null key or an unknown snapshot
    are left out; a snapshot without rows has everything removed.  A task
    holds ``chunk`` ordinals of ``span`` + 1 snapshots, however large a series
    or its history is; a snapshot between two spans goes to both.
    """
    dictionary = ordinals or Ordinals(rows.sparkSession)
    named = rows.select(
        F.col(snapshot).alias("snapshot"), F.col(key).alias("key"), F.struct(*version).alias("_version"), F.struct(*[F.col(c).alias(f"v{i}") for i, c in enumerate(columns)]).alias("_values")
    ).where(F.col("key").isNotNull())
    # By series and key from here to the join with the dictionary: one shuffle for the versions and the join.
    latest = (
        named.join(snapshots, "snapshot")
        .repartition("series", "key")
        .groupBy("series", "key", "seq", "last")
        .agg(F.max_by("_values", "_version").alias("_values"))
    )
    keys = named.select("snapshot", "key").join(snapshots.select("snapshot", "series"), "snapshot")
    placed = latest.join(dictionary.extend(keys), ["series", "key"])
    names = [f"v{i}" for i in range(len(columns))]
    pairs = [F.when(F.col("seq") > 1, F.floor((F.col("seq") - 2) / span)), F.when(F.col("seq") < F.col("last"), F.floor((F.col("seq") - 1) / span))]
    placed = placed.select(
        "series", F.floor(F.col("ordinal") / chunk).alias("chunk"), F.explode(F.array_distinct(F.array_compact(F.array(*pairs)))).alias("block"), "seq", "last", "key", F.pmod("ordinal", F.lit(chunk)).cast("int").alias("place"),
        *[F.col(f"_values.{n}").cast("string").alias(n) for n in names],
    )
    changes = placed.groupBy("series", "chunk", "block").applyInPandas(_compare(names, chunk, span), f"series {dict(snapshots.dtypes)['series']}, seq int, key {dict(rows.dtypes)[key]}, change_type string")
    return changes.join(snapshots.select("series", "seq", "snapshot"), ["series", "seq"]).select("snapshot", "key", "change_type")
