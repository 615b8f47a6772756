"""Which base table is current, and which part of the log it holds already.

A manifest is a folder of small files, one per version, each naming a base and the last
micro-batch that is folded into it. A version is committed by renaming a finished file to its
number, which fails if that number is taken. Readers take the newest version and fold the
batches behind it, so a compaction may run beside a drain, beside readers and beside another
compaction, of which one wins. What dies before its commit has changed nothing.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

from tallyloom.streaming.journal import committed, folder, numbered_files


@dataclass(frozen=True)
class State:
    """``base``: path of the base table, None for the one the job started with; ``through``:
    the last micro-batch in it."""

    version: int = 0
    base: str | None = None
    through: int = -1


class LostRace(RuntimeError):
    """Another compaction has committed this version."""


def read_state(spark: SparkSession, path: str) -> State:
    versions = numbered_files(spark, f"{path}/manifest")
    if not versions:
        return State()
    files, place = folder(spark, f"{path}/manifest/{versions[-1]}")
    stream = files.open(place)
    try:
        text = bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()
    held = json.loads(text)
    return State(versions[-1], held["base"], held["through"])


def commit_state(spark: SparkSession, path: str, state: State) -> None:
    """Make ``state`` the newest version, or raise if its number is taken."""
    jvm = spark.sparkContext._jvm
    text = json.dumps({"base": state.base, "through": state.through})
    files, draft = folder(spark, f"{path}/manifest/draft-{uuid.uuid4().hex}")
    out = files.create(draft)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    _, target = folder(spark, f"{path}/manifest/{state.version}")
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(
        files.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    try:
        context.rename(draft, target, options)
    except Py4JJavaError as error:
        files.delete(draft, False)
        if "FileAlreadyExistsException" not in str(error):
            raise
        raise LostRace(f"version {state.version} of {path} is taken") from error


def base_table(spark: SparkSession, state: State, first: DataFrame) -> DataFrame:
    """The base of a state; ``first`` is the table the job started with."""
    return first if state.base is None else spark.read.schema(first.schema).parquet(state.base)


def compact(spark: SparkSession, path: str, fold: Callable[[State, int], DataFrame]) -> State:
    """Write base and log as the next base and commit it.

    ``fold`` gives the table of a state with the log up to a batch. Batches that are committed
    meanwhile stay in the log of the new version.
    """
    state, upto = read_state(spark, path), committed(spark, path)
    target = f"{path}/base-{uuid.uuid4().hex}"
    fold(state, upto).write.mode("errorifexists").parquet(target)
    done = State(state.version + 1, target, upto)
    commit_state(spark, path, done)
    return done
