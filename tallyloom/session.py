"""Session settings and the shared work folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

# Runtime SQL settings the jobs count on. AQE measures every shuffled side before it
# turns a join into a broadcast and splits join partitions that one hot key has blown
# up; forcing the split accepts one more shuffle rather than one straggling task.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
}


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session somebody else built."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


# What one task takes at most. A task that sums or sorts rows by a key holds many bytes for each
# row it reads, so its memory goes with these sizes, whatever the tables' size.
TASK_SIZES = {
    "spark.sql.files.maxPartitionBytes": 32 << 20,
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": 16 << 20,
}
# Enough partitions that those of a large shuffle can be that small; few rows are coalesced.
LEAST_PARTITIONS = 200


def _bytes(spark: SparkSession, size: str) -> int:
    return spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(size)


def bound_tasks(spark: SparkSession) -> SparkSession:
    """For jobs that hold their rows by key: cut them into tasks of bounded size.

    The settings stay, as results are computed when they are asked for. A session whose tasks
    are smaller already keeps its own sizes.
    """
    for key, most in TASK_SIZES.items():
        if _bytes(spark, spark.conf.get(key)) > most:
            spark.conf.set(key, str(most))
    if int(spark.conf.get("spark.sql.shuffle.partitions")) < LEAST_PARTITIONS:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.initialPartitionNum", str(LEAST_PARTITIONS))
    return spark


def local_session(cores: int | str = "*", partitions: int = 8, *, work: str) -> SparkSession:
    """A session for tests and the benchmark, with its work folder; clusters bring their own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("tallyloom")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.checkpoint.dir", work)
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return tune(spark)


def work_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    A session that was built without one may name it later as ``tallyloom.work.dir``. A
    missing folder is an error on any master: only the caller knows what executors can reach.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("tallyloom.work.dir", None)
    if not shared:
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    return shared.rstrip("/")


_HANDED: list[str] = []


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder."""
    path = f"{work_dir(spark)}/{label}-{uuid.uuid4().hex}"
    _HANDED.append(path)
    return path


def release(spark: SparkSession) -> int:
    """Remove what this process has written to the shared folder; returns how many paths.

    To be called when the results of its jobs are written: frames that were read back from
    those paths cannot be used any more.
    """
    paths = [spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p) for p in _HANDED]
    _HANDED.clear()
    settings = spark.sparkContext._jsc.hadoopConfiguration()
    return sum(p.getFileSystem(settings).delete(p, True) for p in paths)


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage in reliable storage, so several outputs of one job share a single
    computation and a lost executor costs a re-read, not a recompute.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
