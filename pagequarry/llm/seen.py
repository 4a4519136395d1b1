"""Has this key been seen before?  Exact first-or-repeat answers from a streaming state store.

The stream is partitioned by key; its state, on disk (RocksDB) with
checkpoints, holds one small entry per key, the earliest record, and never
expires.  A key's records of one delivery are combined before the shuffle, so
a key with a third of all rows sends one row per task.  Each micro-batch emits
the answers for its records from what the state says of their keys; nothing of
earlier deliveries is read again.
"""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagequarry.session import work_path

DELIVERIES = 3
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def _conf(spark: SparkSession, **values: str):
    old = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _rename(spark: SparkSession, old: str, new: str) -> bool:
    jvm = spark._jvm
    source, target = jvm.org.apache.hadoop.fs.Path(old), jvm.org.apache.hadoop.fs.Path(new)
    fs = source.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(source):
        return False
    fs.mkdirs(target.getParent())
    return fs.rename(source, target)


class SeenKeys:
    """Answers for deliveries of records; the state lives below ``path`` and outlasts the session."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark = spark
        self.path = path or work_path(spark, "seen-keys")

    def _run(self, arrival: str, schema, answers: str) -> None:
        """One micro-batch: the state takes the part that has arrived, and its answers are written."""
        rows = self.spark.read.schema(schema).parquet(arrival).select("id", F.col("key").isNotNull().alias("keyed"))

        def answer(touched: DataFrame, _: int) -> None:
            # The state gives each key of this part its earliest record of all time. A record that isn't that one came after it.
            first = touched.select(F.col("first.id").alias("id"), F.lit(True).alias("first")).distinct()
            told = rows.join(first, "id", "left").select("id", (F.col("keyed") & F.col("first").isNull()).alias("repeat"))
            told.write.mode("overwrite").parquet(answers)

        with _conf(self.spark, **{"spark.sql.streaming.stateStore.providerClass": _ROCKS, "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true"}):
            stream = self.spark.readStream.schema(schema).parquet(f"{self.path}/arrivals").where(F.col("key").isNotNull())
            earliest = stream.groupBy("key").agg(F.min(F.struct("at", "id")).alias("first"))
            query = (
                earliest.writeStream.outputMode("update")
                .option("checkpointLocation", f"{self.path}/checkpoint")
                .trigger(availableNow=True)
                .foreachBatch(answer)
                .start()
            )
            query.awaitTermination()

    def deliver(self, rows: DataFrame, key: str, at: str, record_id: str, deliveries: int = 1) -> DataFrame:
        """id and repeat for every record of ``rows``: whether its key came before.

        Records count in the order of (at, record_id), nulls first; they are
        handed over in ``deliveries`` parts of ascending ``at``, each one
        micro-batch, so what is in memory is one part and not the history.
        Repeats of one id are one record.  A record whose key is null is never
        a repeat.  One that comes late, in a later delivery although its time
        is earlier than all its key's records so far, is no repeat either.
        """
        named = rows.select(F.col(key).alias("key"), F.col(at).alias("at"), F.col(record_id).alias("id"))
        cuts = []
        if deliveries > 1:
            seconds = named.select(F.col("at").cast("double").alias("s"))
            cuts = sorted(set(seconds.approxQuantile("s", [i / deliveries for i in range(1, deliveries)], 0.01)))
        part = F.lit(0)
        for c in cuts:
            part = part + F.coalesce((F.col("at").cast("double") > c).cast("int"), F.lit(0))
        landing = work_path(self.spark, "deliveries")
        named.withColumn("part", part).write.partitionBy("part").parquet(landing)
        parts = []
        for i in range(len(cuts) + 1):
            arrival = f"{self.path}/arrivals/from={landing.rsplit('-', 1)[-1]}-{i}"
            if _rename(self.spark, f"{landing}/part={i}", arrival):
                parts.append(f"{landing}-answers/part={i}")
                self._run(arrival, named.schema, parts[-1])
        if not parts:
            return named.select("id", F.lit(False).alias("repeat")).limit(0)
        told = self.spark.read.schema(named.select("id", F.lit(False).alias("repeat")).schema).parquet(*parts)
        return told.groupBy("id").agg(F.min("repeat").alias("repeat"))


def repeats(rows: DataFrame, key: str, at: str, record_id: str, deliveries: int = DELIVERIES) -> DataFrame:
    """id and repeat for every record of a table whose history starts with it."""
    return SeenKeys(rows.sparkSession).deliver(rows, key, at, record_id, deliveries)


def error_report(answers: DataFrame, rows: DataFrame, key: str, at: str, record_id: str) -> DataFrame:
    """One row that holds the answers against a full batch computation: records, repeats, wrong, wrong_rate."""
    named = rows.select(F.col(key).alias("key"), F.col(at).alias("at"), F.col(record_id).alias("id"))
    first = named.where(F.col("key").isNotNull()).groupBy("key").agg(F.min(F.struct("at", "id")).alias("f")).select("f.id", F.lit(True).alias("is_first"))
    keyed = named.groupBy("id").agg(F.max(F.col("key").isNotNull()).alias("keyed"))
    truth = keyed.join(first, "id", "left").select("id", (F.col("keyed") & F.col("is_first").isNull()).alias("truth"))
    both = answers.join(truth, "id", "full")
    wrong = F.count_if(~F.col("repeat").eqNullSafe(F.col("truth")))
    return both.agg(F.count("*").alias("records"), F.count_if("truth").alias("repeats"), wrong.alias("wrong"), F.coalesce(F.round(wrong / F.count("*"), 6), F.lit(0.0)).alias("wrong_rate"))
