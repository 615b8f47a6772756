"""Documents: one header row per parent and one row per child, the same at every size.

A document is two frames. Headers carry the number of children, summed up by a partial
aggregate before it meets the parents; children carry their parent's id and their own, sorted
by (parent, place in the document, id). Nothing is gathered into an array, so a parent with
very many children is cut by the range partitioner like any other rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.operators.listing import listing, up


def with_count(parents: DataFrame, children: DataFrame, key: str, name: str) -> DataFrame:
    """``parents`` with the number of their ``children``, zero without any."""
    sizes = children.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("id")).agg(
        F.count(F.lit(1)).alias("__n")
    )
    return parents.join(sizes, "id", "left").select(
        *parents.columns, F.coalesce("__n", F.lit(0)).alias(name)
    )


def children_of(
    parents: DataFrame, children: DataFrame, key: str, fields: Sequence[str],
    order: Sequence[Column] = (),
) -> DataFrame:
    """The children of known parents, sorted by parent, ``order`` and their own id."""
    known = children.join(parents.select(F.col("id").alias(key)), key, "left_semi")
    return listing(known, [up(key), *order, up("id")], [key, *fields])
