"""Connected components by alternating stars (Kiveris et al., 2014).

Edges are only ever grouped by a minimum and joined with it; no neighbour list, component or
set of links is gathered in one place, and each round is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.session import materialise


def components(edges: DataFrame) -> DataFrame:
    """``edges`` (a, b: long) to (id, root): every node that is not its component's smallest.

    Nodes without an edge and the smallest node of each component do not appear. Loops,
    repeated edges and both directions are allowed; edges with a NULL end are ignored.
    """
    lo, hi = F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")
    known = F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b"))
    now = materialise(edges.where(known).select(lo, hi).distinct(), "edges")
    mark = _mark(now)
    while mark[0]:
        now = materialise(_small_star(_large_star(now)), "stars")
        last, mark = mark, _mark(now)
        if last == mark:
            break
    return now.select(F.col("hi").alias("id"), F.col("lo").alias("root"))


def _large_star(edges: DataFrame) -> DataFrame:
    """Hang every larger neighbour of a node on the smallest node around it."""
    both = edges.select(F.col("lo").alias("u"), F.col("hi").alias("v")).unionAll(
        edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")))
    # Written first: a hub's rows then meet two plain sides, which Spark can split.
    least = materialise(
        both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("lo")), "minima")
    return materialise(
        both.join(least, "u").where("v > u and v <> lo")
        .select("lo", F.col("v").alias("hi")).distinct(), "large")


def _small_star(edges: DataFrame) -> DataFrame:
    """Hang every smaller neighbour of a node, and the node, on the smallest of them."""
    least = materialise(
        edges.groupBy(F.col("hi").alias("u")).agg(F.min("lo").alias("m")), "minima")
    moved = edges.join(least, edges.hi == least.u).where("lo <> m").select(
        F.col("m").alias("lo"), F.col("lo").alias("hi"))
    return moved.unionAll(least.select(F.col("m").alias("lo"), F.col("u").alias("hi"))).distinct()


def _mark(edges: DataFrame) -> tuple:
    """Changes whenever the set of edges does."""
    row = edges.agg(
        F.count("*"), F.bit_xor(F.xxhash64("lo", "hi")), F.bit_xor(F.xxhash64("hi", "lo")),
        F.sum(F.col("lo").cast("decimal(38,0)"))).first()
    return tuple(row)
