"""Who holds a unique key when one feed asks for it several times: the earliest valid row.

A row that fails any other rule does not occupy its keys. Aggregates find the holders, so
a key asked for by a third of the feed costs one partial row per task, never a window
over the whole group. Keys and verdicts are formed from the few columns they need, in passes
of their own, so the feed should be judged and written before. What it is joined back to is
written too: it is small as a rule and then broadcast by its known size; if it is not, both
sides of the join are plain and a hot key is split.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.session import materialise


def _either(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def _contested(df: DataFrame, column: str, table: DataFrame) -> DataFrame:
    """(__held, __stored): asked values that are stored already or asked for more than once."""
    stored = table.select(F.col(column).alias("__held"), F.lit(1).alias("__stored"), F.lit(0).alias("__asked"))
    asked = df.select(F.col(column).alias("__held"), F.lit(0).alias("__stored"), F.lit(1).alias("__asked"))
    keys = stored.unionByName(asked).filter(F.col("__held").isNotNull()).groupBy("__held").agg(
        F.max("__stored").alias("__stored"), F.sum("__asked").alias("__asked"))
    return materialise(
        keys.filter("(__stored = 1 and __asked > 0) or __asked > 1")
        .select("__held", (F.col("__stored") == 1).alias("__stored")), "contested")


def _ranked(claims: DataFrame, names: Sequence[str], order: str) -> DataFrame:
    """Add ``__first_i`` for each key: the first open claim of it (the row itself at NULL)."""
    for i, column in enumerate(names):
        first = claims.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("__held")).agg(
            F.min(order).alias(f"__first_{i}"))
        claims = claims.join(first, F.col(column) == F.col("__held"), "left").drop("__held").withColumn(
            f"__first_{i}", F.coalesce(f"__first_{i}", order))
    return claims


def _follow(links: DataFrame) -> DataFrame:
    """Contract chains: every link (row, to, flip) leads to the end of its chain.

    Each step replaces a link by two, so a chain of n rows takes log2(n) steps. ``flip`` says
    whether the number of links passed is odd.
    """
    while True:
        onward = links.select(F.col("row").alias("to"), F.col("to").alias("__to"),
                              F.col("flip").alias("__flip"))
        links = materialise(
            links.join(onward, "to", "left").select(
                "row", F.coalesce("__to", "to").alias("to"),
                (F.col("flip") != F.coalesce("__flip", F.lit(False))).alias("flip"),
                F.col("__to").isNotNull().alias("moved")), "claims-links")
        if links.filter("moved").isEmpty():
            return links.drop("moved")


def _winners(claims: DataFrame, columns: Sequence[str], order: str) -> DataFrame:
    """The claims that end up holding all their keys.

    A row that is the first claim of each of its keys wins. A row that is the second claim of
    one key and the first of its others wins exactly if the first claim of that key loses: such
    rows form chains, each link turning win into loss, and a chain of any length is contracted
    by doubling. And whichever of the two wins, that key is then taken, so all its later claims
    are out at once. Rows that share a key with a winner are out. What stays open are rows with
    rivals still open at two or more of their keys; the earliest of a round is always settled.
    """
    names, won = list(columns), []
    open_rows = materialise(claims.select(order, *names), "claims-open")
    while not open_rows.isEmpty():
        ranked = materialise(_ranked(open_rows, names, order), "claims-ranked")
        firsts = [F.col(f"__first_{i}") for i in range(len(names))]
        behind = sum(((first != F.col(order)).cast("int") for first in firsts), F.lit(0))
        placed = ranked.withColumn("__behind", behind)
        # The second claim of each key, and whether it is first everywhere else: both as least
        # numbers, which a hash aggregate holds in place.
        for i, column in enumerate(names):
            second = ranked.withColumn("__behind", behind).filter(firsts[i] != F.col(order)).groupBy(
                F.col(column).alias("__key")).agg(
                F.min(order).alias(f"__second_{i}"),
                F.min(F.when(F.col("__behind") == 1, F.col(order))).alias(f"__sure_{i}"))
            placed = placed.join(second, F.col(column) == F.col("__key"), "left").drop("__key")
        placed = materialise(placed, "claims-placed")
        seconds = [F.col(f"__second_{i}") for i in range(len(names))]
        is_second = [F.coalesce(second == F.col(order), F.lit(False)) for second in seconds]
        too_late = _either([
            F.coalesce((second < F.col(order)) & (second == F.col(f"__sure_{i}")), F.lit(False))
            for i, second in enumerate(seconds)])
        rival = F.coalesce(*[F.when(mine, first) for mine, first in zip(is_second, firsts)])
        links = _follow(placed.filter((F.col("__behind") == 1) & _either(is_second)).select(
            F.col(order).alias("row"), rival.alias("to"), F.lit(True).alias("flip")))
        free = placed.filter("__behind = 0").select(F.col(order).alias("to"))
        # A chain that ends at a free row, which wins, is settled: even turns are a win too.
        even = links.filter(~F.col("flip")).join(free, "to", "left_semi").select(
            F.col("row").alias(order), F.lit(True).alias("__even"))
        settled = materialise(placed.join(even, order, "left").select(
            order, *names, too_late.alias("__late"),
            (F.col("__behind").eqNullSafe(0) | F.coalesce("__even", F.lit(False))).alias("__wins")),
            "claims-settled")
        winners = settled.filter("__wins").select(order, *names)
        won.append(winners)
        left = settled.filter("not __wins and not __late").select(order, *names)
        for column in names:
            held = winners.select(column).filter(F.col(column).isNotNull())
            left = left.join(held, column, "left_anti")
        open_rows = materialise(left.select(order, *names), "claims-open")
    return reduce(DataFrame.unionByName, won) if won else open_rows


def _mark_one(
    df: DataFrame, column: str, table: DataFrame, eligible: Column, order: str
) -> DataFrame:
    """One key: stored values and claims share one aggregate.

    Only keys that can make a row late, those stored or asked for more than once, are joined
    back.
    """
    stored = table.select(
        F.col(column).alias("__held"), F.lit(1).alias("__stored"), F.lit(0).alias("__asked"),
        F.lit(None).cast(df.schema[order].dataType).alias("__claim"),
    )
    claims = df.select(
        F.col(column).alias("__held"), F.lit(0).alias("__stored"), F.lit(1).alias("__asked"),
        F.when(eligible, F.col(order)).alias("__claim"),
    )
    keys = stored.unionByName(claims).groupBy("__held").agg(
        F.max("__stored").alias("__stored"), F.sum("__asked").alias("__asked"),
        F.min("__claim").alias("__holder"),
    )
    contested = materialise(
        keys.filter(
            F.col("__held").isNotNull()
            & (((F.col("__stored") == 1) & (F.col("__asked") > 0)) | (F.col("__asked") > 1))
        ).drop("__asked"),
        "contested",
    )
    late = (F.col("__stored") == 1) | (F.col("__holder") < F.col(order))
    joined = df.join(contested, F.col(column) == F.col("__held"), "left")
    return joined.withColumn("duplicate", F.coalesce(late, F.lit(False))).drop(
        "__held", "__stored", "__holder"
    )


def mark_duplicates(
    df: DataFrame, columns: Sequence[str], table: DataFrame, eligible: Column, order: str
) -> DataFrame:
    """Add ``duplicate``: some key is stored already or held by an earlier valid row."""
    if len(columns) == 1:
        return _mark_one(df, columns[0], table, eligible, order)
    contested = [_contested(df, column, table) for column in columns]
    # Only rows that ask for a value somebody else asks for can be late or make others late.
    claims = df.filter(eligible).select(order, *columns)
    for i, column in enumerate(columns):
        keys = contested[i].withColumnRenamed("__stored", f"__stored_{i}")
        claims = claims.join(keys, F.col(column) == F.col("__held"), "left").drop("__held")
    known = [F.col(f"__stored_{i}") for i in range(len(columns))]
    free = ~_either([F.coalesce(stored, F.lit(False)) for stored in known])
    winners = _winners(
        claims.filter(free & _either([stored.isNotNull() for stored in known])), columns, order)
    late = []
    for i, column in enumerate(columns):
        taken = contested[i].filter("__stored").select(
            "__held", F.lit(True).alias(f"__stored_{i}"),
            F.lit(None).cast(df.schema[order].dataType).alias(f"__holder_{i}"))
        held = winners.filter(F.col(column).isNotNull()).select(
            F.col(column).alias("__held"), F.lit(False).alias(f"__stored_{i}"),
            F.col(order).alias(f"__holder_{i}"))
        df = df.join(taken.unionByName(held), F.col(column) == F.col("__held"), "left").drop("__held")
        late.append(F.coalesce(F.col(f"__stored_{i}") | (F.col(f"__holder_{i}") < F.col(order)), F.lit(False)))
    gone = [f"{kind}_{i}" for i in range(len(columns)) for kind in ("__stored", "__holder")]
    return df.withColumn("duplicate", _either(late)).drop(*gone)
