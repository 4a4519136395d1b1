"""Streams of crawl events: windows, running counters, deduplication, throttled progress, micro-batch writes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from pagequarry.session import work_path


def read_events(spark: SparkSession, path: str, schema, files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).parquet(path)


def windowed(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """window_start, event_type, n, total: tumbling windows that close ``late`` after their end; later rows are dropped."""
    timed = events.withWatermark("ts", late)
    return timed.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


def running_counters(events: DataFrame) -> DataFrame:
    """event_type, n, users' least and greatest value so far."""
    return events.groupBy("event_type").agg(F.count("*").alias("n"), F.min("value").alias("least"), F.max("value").alias("most"))


def first_deliveries(events: DataFrame, key: str = "event_id", late: str = "1 day") -> DataFrame:
    """Each key once within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


PROGRESS_SCHEMA = "user_id bigint, ts timestamp, seen bigint"
EVERY, SECONDS = 10, 0.5


def throttled_progress(events: DataFrame, every: int = EVERY, seconds: float = SECONDS) -> DataFrame:
    """user_id, ts, seen: a progress row when ``every`` events or ``seconds`` have passed since the key's last one."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen, told, at = state.get if state.exists else (0, 0, 0.0)
        rows = []
        times = pd.concat([b["ts"] for b in batches]).sort_values()
        for t in times:
            seen += 1
            now = t.timestamp()
            if seen - told >= every or now - at >= seconds:
                rows.append((key[0], t, seen))
                told, at = seen, now
        state.update((seen, told, at))
        yield pd.DataFrame(rows, columns=["user_id", "ts", "seen"]).astype({"user_id": "int64", "ts": "datetime64[us]", "seen": "int64"})

    return events.groupBy("user_id").applyInPandasWithState(step, PROGRESS_SCHEMA, "seen long, told long, at double", "append", GroupStateTimeout.NoTimeout)


def run_batches(stream: DataFrame, mode: str, write: Callable[[DataFrame, int], None] | None = None, checkpoint: str | None = None) -> str:
    """Runs a stream over what has arrived and returns where its rows are; each micro-batch overwrites its own folder, so a repeated one counts once."""
    out = work_path(stream.sparkSession, "stream")

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint or f"{out}-checkpoint").trigger(availableNow=True).foreachBatch(write or keep).start()
    query.awaitTermination()
    return out
