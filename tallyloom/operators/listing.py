"""Listings: project, rename, sort with the NULL order and tie-break spelled out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.session import materialise


def up(column: str) -> Column:
    """Ascending, NULLs last."""
    return F.col(column).asc_nulls_last()


def down(column: str) -> Column:
    """Descending, NULLs first."""
    return F.col(column).desc_nulls_first()


def down_nulls_last(column: str) -> Column:
    return F.col(column).desc_nulls_last()


def listing(df: DataFrame, order: Sequence[Column], columns: Sequence | None = None) -> DataFrame:
    """Sorted listing; the last sort key must be unique.

    A unique last key makes the result repeatable and lets the range partitioner cut
    through a value shared by very many rows instead of sending them all to one task.
    """
    ordered = df.orderBy(*order)
    return ordered.select(*columns) if columns else ordered


def lookup(df: DataFrame, keys: DataFrame, column: str = "id") -> DataFrame:
    """Rows of ``df`` whose ``column`` is one of ``keys.id``.

    The key set is folded and written first, so its size is known: small sets are broadcast
    and the table is not shuffled at all.
    """
    wanted = materialise(keys.select(F.col("id").alias(column)).distinct(), "keys")
    return df.join(wanted, column, "left_semi")


def newest_matching(
    log: DataFrame, dimension: DataFrame, key: str, newest: str, rows: int
) -> DataFrame:
    """The ``rows`` newest rows of the inner join of a long log with a dimension, by ``newest``
    and then ``id``, both descending.

    The winners are found from three narrow columns: rows with a known reference, of which each
    task keeps the best ``rows``. Only their ids, at most ``rows``, come to the driver. The wide
    log is then read for those ids and never shuffled, however few references are known.
    """
    order = [down(newest), down("id")]
    best = (
        log.select("id", key, newest).join(dimension.select(key), key, "left_semi")
        .orderBy(*order).limit(rows).collect()
    )
    people = dimension.filter(F.col(key).isin([row[key] for row in best]))
    wide = log.filter(F.col("id").isin([row["id"] for row in best]))
    return wide.join(people, key).orderBy(*order).limit(rows)


def misplaced(df: DataFrame, order: Sequence[tuple[str, bool, bool]]) -> DataFrame:
    """Neighbouring rows in the wrong order: (part, place) of the later one; none if sorted.

    ``order``: column, descending, NULLs first, for each key. Every partition is compared row
    by row on its own; of each partition only the first and the last row meet those of its
    neighbours, so the proof is as distributed as the sort it checks.
    """
    keys = F.struct(*[
        part for name, down, first in order
        for part in (F.col(name).isNull().alias(f"{name}_gone"), F.col(name).alias(name))])
    placed = df.select(F.spark_partition_id().alias("part"),
                       F.monotonically_increasing_id().alias("place"), keys.alias("key"))
    inside = Window.partitionBy("part").orderBy("place")
    pairs = placed.withColumn("before", F.lag("key").over(inside))
    ends = placed.groupBy("part").agg(
        F.min("place").alias("place"), F.min_by("key", "place").alias("key"),
        F.max_by("key", "place").alias("last"))
    # One row per partition of the sort.
    borders = ends.withColumn("before", F.lag("last").over(Window.orderBy("part")))
    both = pairs.unionByName(borders.drop("last")).filter(F.col("before").isNotNull())
    return both.filter(_after("before", "key", list(order))).select("part", "place")


def _after(left: str, right: str, order: list[tuple[str, bool, bool]]) -> Column:
    """Does the key ``left`` come after ``right``?"""
    (name, down, first), rest = order[0], order[1:]
    a, b = F.col(f"{left}.{name}"), F.col(f"{right}.{name}")
    a_gone, b_gone = F.col(f"{left}.{name}_gone"), F.col(f"{right}.{name}_gone")
    worse = F.when(a_gone | b_gone, (b_gone & ~a_gone) if first else (a_gone & ~b_gone)).otherwise(
        a < b if down else a > b)
    if not rest:
        return worse
    return worse | (a.eqNullSafe(b) & _after(left, right, rest))


def one_row(*parts: DataFrame) -> DataFrame:
    """Put several one-row frames side by side, without a cross join."""
    columns = [(c, t) for part in parts for c, t in part.dtypes]
    stacked = None
    for part in parts:
        padded = part.select(
            *[F.col(c) if c in part.columns else F.lit(None).cast(t).alias(c) for c, t in columns]
        )
        stacked = padded if stacked is None else stacked.unionAll(padded)
    return stacked.agg(*[F.max(c).alias(c) for c, _ in columns])
