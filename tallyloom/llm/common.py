"""What the operators share: boxed rows, Arrow batches, byte-exact text rules."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.session import tune

# Rows of one Arrow batch. Texts may be long, so a batch is kept small; it is what a Python
# worker holds at once, whatever the size of the partition.
BATCH_ROWS = "256"

# Stands for a NULL id inside joins, so that such rows meet themselves and sort last.
NO_ID = 2**63 - 1

# ASCII blanks, as the word rules name them: [\x20\x09-\x0D].
BLANKS = b" \t\n\x0b\x0c\r"


def prepare(spark: SparkSession) -> SparkSession:
    """Settings every operator counts on."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    return tune(spark)


def field(name: str) -> Column:
    """A column by its literal name, dots included."""
    return F.col(f"`{name}`")


def boxed(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with every row packed into ``row``, beside the named columns.

    An operator works on the named columns only and unpacks ``row`` at the end, so input
    columns of any name cannot clash with its own.
    """
    prepare(df.sparkSession)
    row = F.struct(*[field(c) for c in df.columns]).alias("row")
    return df.select(row, *[expr.alias(name) for name, expr in columns.items()])


def with_row(df: DataFrame, columns: str) -> T.StructType:
    """A schema of ``df``'s box and the named columns; its names need no quoting this way."""
    return T.StructType([df.schema["row"], *T.StructType.fromDDL(columns).fields])


def number_id(name: str = "doc_id") -> Column:
    return field(name).cast("long")


def map_batches(df: DataFrame, work: Callable[[pa.RecordBatch], pa.RecordBatch | None],
                schema: str | T.StructType) -> DataFrame:
    """Apply ``work`` to every Arrow batch; None leaves nothing of it."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = work(batch)
            if made is not None and made.num_rows:
                yield made

    return df.mapInArrow(run, schema)


_KEPT: dict[tuple, object] = {}


def worker_cache(*key, make: Callable[[], object]) -> object:
    """What a Python worker keeps from task to task: the cache of one operator at a time."""
    if key not in _KEPT:
        _KEPT.clear()
        _KEPT[key] = make()
    return _KEPT[key]


def chunks(batches: Iterable[pa.RecordBatch], size: int) -> Iterator[pa.Table]:
    """Neighbouring batches as tables of about ``size`` bytes."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.nbytes for b in held) >= size:
            yield pa.Table.from_batches(held)
            held = []
    if held:
        yield pa.Table.from_batches(held)


def utf8(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """The texts of a batch as UTF-8; NULL is empty."""
    return [x or b"" for x in batch.column(name).cast(pa.binary()).to_pylist()]


def strings(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """The texts of a batch; NULL is empty."""
    return [x or "" for x in batch.column(name).to_pylist()]


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
