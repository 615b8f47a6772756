"""Bulk validation: one pass of column expressions, then joins for the keyed rules.

Every input row comes back exactly once with its cleaned fields and ``reject_reason``
(NULL = accepted). The reason is the first failing rule in the order the rules are given;
uniqueness comes after the field rules and unknown references come last, which is the
order a database meets them in when it stores the row.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.operators.claims import mark_duplicates
from tallyloom.session import materialise

REASON = "reject_reason"


@dataclass(frozen=True)
class Rule:
    bad: Column
    reason: str


def parsed(name: str) -> Column:
    """The field's ``parse`` result, to be used in its value and rules."""
    return F.col(f"__p_{name}")


def cleaned(name: str) -> Column:
    """The field's value, to be used in rules."""
    return F.col(f"__v_{name}")


@dataclass(frozen=True)
class Field:
    """A cleaned output column with its rules; ``late`` rules run after all others.

    Columns are computed in three steps: ``parse`` from the raw row, ``value`` from that,
    rules from both. Referring to a step (``parsed``, ``cleaned``) instead of repeating its
    expression keeps text from being parsed once per rule.
    """

    name: str
    value: Column
    rules: tuple[Rule, ...] = ()
    late: tuple[Rule, ...] = ()
    parse: Column | None = None
    # All values a valid row can have, where they are a fixed vocabulary.
    members: tuple = ()


@dataclass(frozen=True)
class Reference:
    """``column`` must be NULL or an ``id`` of ``table``."""

    column: str
    table: DataFrame
    reason: str


@dataclass(frozen=True)
class Unique:
    """Each column must be new: not in ``table`` and not claimed earlier in the feed."""

    columns: tuple[str, ...]
    table: DataFrame
    reason: str


def first_reason(rules: Sequence[Rule]) -> Column:
    arms = [F.when(rule.bad, F.lit(rule.reason)) for rule in rules]
    return F.coalesce(*arms) if arms else F.lit(None).cast("string")


def rules_of(fields: Sequence[Field]) -> list[Rule]:
    """All rules in the order they are judged."""
    rules = [rule for each in fields for rule in each.rules]
    return rules + [rule for each in fields for rule in each.late]


def first_rule(rules: Sequence[Rule]) -> Column:
    """Position of the first failing rule, NULL when all hold."""
    return F.coalesce(*[F.when(rule.bad, F.lit(i)) for i, rule in enumerate(rules)])


def clean(
    feed: DataFrame,
    fields: Sequence[Field],
    keep: Sequence[str] = ("request_id",),
    *,
    verdict: tuple[str, Column] | None = None,
) -> DataFrame:
    """Cleaned columns plus the first failing field rule; narrow, no shuffle.

    ``verdict`` replaces the ``reject_reason`` column by another one over the rules.
    """
    name, judged = verdict or (REASON, first_reason(rules_of(fields)))
    parsing = [each.parse.alias(f"__p_{each.name}") for each in fields if each.parse is not None]
    valued = feed.select("*", *parsing).select(
        "*", *[each.value.alias(f"__v_{each.name}") for each in fields]
    )
    return valued.select(
        *keep,
        *[cleaned(each.name).alias(each.name) for each in fields],
        judged.alias(name),
    )


def flag_known(df: DataFrame, column: str, table: DataFrame, flag: str) -> DataFrame:
    """Add a boolean: does ``column`` equal an ``id`` of ``table``? (left join, one row in,
    one row out as ids are unique; no broadcast hint, Spark decides by measured size)."""
    ids = table.select(F.col("id").alias("__id"), F.lit(True).alias(flag))
    joined = df.join(ids, F.col(column) == F.col("__id"), "left").drop("__id")
    return joined.withColumn(flag, F.coalesce(flag, F.lit(False)))


# Unknown ids up to this number in all become literal sets; their number is counted
# first. More of them are joined back from a written table of known size.
LITERAL_IDS = 1000


def unknown_flags(
    df: DataFrame, references: Sequence[tuple[str, DataFrame]]
) -> tuple[DataFrame, list[Column]]:
    """For each (column, table): is the column's value an id that ``table`` does not have?

    ``df`` is read several times, so it should be written before. Every task reduces the ids it
    asks for to distinct ones, a table is asked once for all columns that point at it, and only
    unknown ids come back: as a rule few or none, so that ``df`` stays where it is, however
    large the tables are. Returns ``df`` with columns added if it had to be joined, and the
    conditions.
    """
    tables: list[DataFrame] = []
    for _, table in references:
        if not any(table is each for each in tables):
            tables.append(table)
    missing = []
    for place, table in enumerate(tables):
        asked = reduce(DataFrame.unionAll, [
            df.select(F.col(column).cast("bigint").alias("__id"))
            for column, target in references if target is table])
        known = table.select(F.col("id").cast("bigint").alias("__id"))
        missing.append(
            asked.filter(F.col("__id").isNotNull()).distinct().join(known, "__id", "left_anti")
            .select("__id", F.lit(place).alias("__table")))
    if not missing:
        return df, []
    unknown = materialise(reduce(DataFrame.unionAll, missing), "unknown")
    few = unknown.limit(LITERAL_IDS + 1).collect()
    flags = []
    for i, (column, target) in enumerate(references):
        place = next(n for n, each in enumerate(tables) if each is target)
        if len(few) <= LITERAL_IDS:
            ids = [row["__id"] for row in few if row["__table"] == place]
            flags.append(F.coalesce(F.col(column).cast("bigint").isin(ids), F.lit(False)))
            continue
        ids = unknown.filter(F.col("__table") == place).select("__id", F.lit(True).alias(f"__unknown_{i}"))
        df = df.join(ids, F.col(column).cast("bigint") == F.col("__id"), "left").drop("__id")
        flags.append(F.col(f"__unknown_{i}").isNotNull())
    return df, flags


def validate(
    feed: DataFrame,
    fields: Sequence[Field],
    *,
    keep: Sequence[str] = ("request_id",),
    references: Sequence[Reference] = (),
    unique: Unique | None = None,
) -> DataFrame:
    """Judge a feed. With references or unique keys the field rules run once and their result
    is written, as the keys are then gathered from it in passes of their own."""
    checked = clean(feed, fields, keep)
    if references or unique:
        checked = materialise(checked, "judged")
    checked, flags = unknown_flags(checked, [(ref.column, ref.table) for ref in references])
    missing = first_reason([Rule(flag, ref.reason) for flag, ref in zip(flags, references)])
    checked = checked.withColumn("__missing", missing)
    if unique is not None:
        eligible = F.col(REASON).isNull() & F.col("__missing").isNull()
        checked = mark_duplicates(checked, unique.columns, unique.table, eligible, keep[0])
        taken = F.when(F.col("duplicate"), F.lit(unique.reason))
        checked = checked.withColumn(REASON, F.coalesce(REASON, taken, "__missing"))
    else:
        checked = checked.withColumn(REASON, F.coalesce(REASON, "__missing"))
    return checked.select(*keep, *[each.name for each in fields], REASON)


def split(validated: DataFrame, key: str = "request_id") -> tuple[DataFrame, DataFrame]:
    """Accepted rows and rejections (key, reason), judged once: the verdicts are written to
    the shared folder and both sides read from there, each skipping the other's row groups."""
    settled = materialise(validated, "verdicts")
    bad = F.col(REASON).isNotNull()
    return settled.filter(~bad).drop(REASON), settled.filter(bad).select(key, REASON)


def outcome(validated: DataFrame, keep: Sequence[str] = ("request_id",)) -> DataFrame:
    """Accepted rows in full, rejected rows with their key and reason only."""
    ok = F.col(REASON).isNull()
    return validated.select(
        *keep,
        *[F.when(ok, F.col(c)).alias(c) for c in validated.columns if c not in (*keep, REASON)],
        REASON,
    )
