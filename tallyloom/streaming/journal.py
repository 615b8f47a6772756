"""Judged streams: every record is validated on arrival and appended once.

Each micro-batch is judged as a batch and written to a folder of its own, named by its number,
so a batch that is run again after a failure replaces what it left. A batch counts once the
stream has committed it; readers go by those commits and never see half a batch. Accepted and
rejected records go to two partitions of that folder in a single pass.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tallyloom.operators.validate import REASON

OUTCOME = "outcome"
BATCH = "batch"

Judge = Callable[[DataFrame], DataFrame]


def append_judged(
    feed: DataFrame, judge: Judge, path: str, quarantine: Judge | None = None
) -> StreamingQuery:
    """Start a query that drains what has arrived and then stops.

    ``quarantine`` gives the records of a batch that cannot even be judged.
    """
    verdict = F.when(F.col(REASON).isNull(), "accepted").otherwise("rejected")

    def write(batch: DataFrame, number: int) -> None:
        if quarantine is not None:
            quarantine(batch).write.mode("overwrite").parquet(f"{path}/quarantine/{BATCH}={number}")
        judge(batch).withColumn(OUTCOME, verdict).write.mode("overwrite").partitionBy(OUTCOME).parquet(
            f"{path}/data/{BATCH}={number}")

    return (
        feed.writeStream.foreachBatch(write)
        .option("checkpointLocation", f"{path}/progress")
        .trigger(availableNow=True)
        .start()
    )


def drain(feed: DataFrame, judge: Judge, path: str, quarantine: Judge | None = None) -> None:
    append_judged(feed, judge, path, quarantine).awaitTermination()


def folder(spark: SparkSession, path: str):
    """The Hadoop file system and path object of ``path``."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def numbered_files(spark: SparkSession, path: str) -> list[int]:
    """The files of a folder that are named by a number; none if there is no such folder."""
    files, place = folder(spark, path)
    if not files.exists(place):
        return []
    names = [status.getPath().getName() for status in files.listStatus(place)]
    return sorted(int(name) for name in names if name.isdigit())


def committed(spark: SparkSession, path: str) -> int:
    """The last micro-batch that is written for good, -1 before the first."""
    return max(numbered_files(spark, f"{path}/progress/commits"), default=-1)


def _read(spark: SparkSession, path: str, columns: str, after: int, upto: int | None) -> DataFrame:
    last = committed(spark, path) if upto is None else upto
    if last <= after:
        return spark.createDataFrame([], columns)
    batches = [f"{path}/{BATCH}={number}" for number in range(after + 1, last + 1)]
    return spark.read.schema(columns).option("basePath", path).parquet(*batches).drop(BATCH)


def read_outcome(spark: SparkSession, path: str, columns: str, outcome: str,
                 after: int = -1, upto: int | None = None) -> DataFrame:
    """Records with one outcome of the batches behind ``after`` up to ``upto`` (the last one
    committed); only their folders are read."""
    last = committed(spark, path) if upto is None else upto
    rows = _read(spark, f"{path}/data", f"{columns}, {OUTCOME} STRING", after, last)
    return rows.filter(F.col(OUTCOME) == outcome).drop(OUTCOME)


def read_quarantine(spark: SparkSession, path: str, columns: str) -> DataFrame:
    return _read(spark, f"{path}/quarantine", columns, -1, committed(spark, path))
