"""Session helpers: building a local session, reading tables, cutting lineage in a shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "*", shuffle_partitions: int = 8, app: str = "pagequarry") -> SparkSession:
    """A session for tests and benches on one machine; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (``spark.checkpoint.dir``).

    Where a session on one machine names none, as in tests, a temporary folder
    is set once and used from then on; on a cluster that is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    context = spark.sparkContext._jsc.sc()
    if context.getCheckpointDir().isEmpty():
        if not context.isLocal():
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="pagequarry-"))
    return context.getCheckpointDir().get()


_WORK: list[str] = []


def work_path(spark: SparkSession, purpose: str) -> str:
    """A fresh path below the shared folder; ``clear_work`` removes what is there."""
    _WORK.append(f"{shared_dir(spark).rstrip('/')}/{purpose}-{uuid.uuid4().hex}")
    return _WORK[-1]


def discard(spark: SparkSession, paths: list[str]) -> list[str]:
    """Removes intermediate tables that nothing reads any more; gives an empty list."""
    for path in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    return []


def clear_work(spark: SparkSession) -> None:
    """Removes all intermediate tables of this process; DataFrames that read them must not be used any more."""
    discard(spark, _WORK)
    _WORK.clear()


def cut(df: DataFrame) -> DataFrame:
    """Runs ``df`` and returns it without lineage, from reliable checkpoint files."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def staged(df: DataFrame, purpose: str) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it again: lineage is cut, statistics are known and columns prune."""
    path = work_path(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
