"""Header-and-line documents: judged as a whole, posted all or nothing.

Lines are judged where they lie, then summed up per document by a partial aggregate, so a
document with a third of all lines is cut down in every task before it is shuffled. A new
document's id is its ``request_id``: no global numbering, which would need one task.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.operators.validate import (
    REASON, Field, Rule, clean, first_reason, first_rule, flag_known, rules_of, unknown_flags,
)
from tallyloom.session import bound_tasks, materialise

KEY = "request_id"


@dataclass(frozen=True)
class Documents:
    """``headers``: every request with its totals and ``reject_reason``; ``lines()``: the
    lines of accepted documents; ``rejected_lines()``: all other lines that came in."""

    headers: DataFrame
    checked_lines: DataFrame
    raw_lines: DataFrame
    unknown: str

    def lines(self) -> DataFrame:
        """The accepted keys are written to the shared folder first. The line join then has
        two plain sides of known size: a small one is broadcast, a hot document is split."""
        good = self.headers.filter(F.col(REASON).isNull()).select(KEY)
        return self.checked_lines.join(materialise(good, "accepted"), KEY, "left_semi")

    def rejected_lines(self) -> DataFrame:
        """(request_id, line_no, reject_reason): lines of rejected documents with the reason of
        their document, and lines that name no document that came in, or none at all.

        One row per line, so accepted and rejected lines add up to those that came in. The
        verdicts are written first, for the same reasons as the accepted keys."""
        verdicts = materialise(self.headers.select(KEY, REASON, F.lit(True).alias("__sent")), "verdicts")
        judged = self.raw_lines.select(KEY, "line_no").join(verdicts, KEY, "left")
        return judged.filter(F.col("__sent").isNull() | F.col(REASON).isNotNull()).select(
            KEY, "line_no",
            F.when(F.col("__sent").isNull(), F.lit(self.unknown)).otherwise(F.col(REASON)).alias(REASON))


def post_documents(
    headers: DataFrame,
    lines: DataFrame,
    header_fields: Sequence[Field],
    line_fields: Sequence[Field],
    *,
    line_values: dict[str, Column],
    totals: dict[str, Column],
    no_lines: str,
    unknown: str,
    least: int = 1,
    document_rules: Sequence[Rule] = (),
    line_key: tuple[str, DataFrame, str] | None = None,
    header_key: tuple[str, DataFrame, str] | None = None,
    numbered: bool = False,
) -> Documents:
    """Judge documents in this order: header fields, number of lines, line fields (first bad
    line by number), ``document_rules`` over the ``totals``, unknown references.

    ``line_values`` are derived per line, ``totals`` are aggregates over them. With
    ``numbered`` a line's reason ends in its number. ``unknown`` is the reason for lines of
    documents that did not come in. Lines with a reference are judged once and written; the
    unknown ids are then found from the distinct ids they name. A task holds one row of sums for
    each document it meets, so tasks are bounded in size, here and in the joins that follow.
    """
    bound_tasks(lines.sparkSession)
    line_rules = rules_of(line_fields)
    checked = clean(
        lines.filter(F.col(KEY).isNotNull()), line_fields, keep=(KEY, "line_no"),
        verdict=("__rule", first_rule(line_rules)),
    )
    checked = checked.select("*", *[value.alias(name) for name, value in line_values.items()])
    known = F.lit(True)
    if line_key is not None:
        checked, (stray,) = unknown_flags(materialise(checked, "lines"), [line_key[:2]])
        known = ~stray
    # The first failing rule of the first bad line as one number: fixed-width buffers keep
    # this a hash aggregate, where a struct or a text would have all lines sorted first.
    step = len(line_rules)
    place = F.col("line_no").cast("bigint") * step + F.col("__rule")
    per_document = checked.groupBy(KEY).agg(
        F.count(F.lit(1)).alias("__n"),
        F.min(place).alias("__bad"),
        F.min(F.when(F.col("line_no").isNull(), F.col("__rule"))).alias("__unnumbered"),
        F.max(~known).alias("__stray"),
        *[value.alias(name) for name, value in totals.items()],
    )
    judged = clean(headers, header_fields, keep=(KEY,)).withColumnRenamed(REASON, "__header")
    judged = judged.join(per_document, KEY, "left")
    missing = [Rule(F.col("__stray"), line_key[2])] if line_key is not None else []
    if header_key is not None:
        column, table, reason = header_key
        judged = flag_known(judged, column, table, "__owner")
        missing.insert(0, Rule(F.col(column).isNotNull() & ~F.col("__owner"), reason))
    texts = F.array(*[F.lit(rule.reason) for rule in line_rules])
    bad = F.get(texts, F.pmod("__bad", F.lit(step)).cast("int"))
    if numbered:
        line = F.floor(F.col("__bad").cast("decimal(20,0)") / step).cast("string")
        bad = F.concat(bad, F.lit(" for line "), line)
    reason = F.coalesce(
        F.col("__header"),
        F.when(F.coalesce("__n", F.lit(0)) < least, F.lit(no_lines)),
        F.when(F.col("__bad").isNotNull(), bad),
        F.get(texts, F.col("__unnumbered").cast("int")),
        first_reason([*document_rules, *missing]),
    )
    result = judged.withColumn(REASON, reason).select(
        KEY, *[each.name for each in header_fields], *totals, REASON
    )
    kept = checked.select(KEY, "line_no", *[each.name for each in line_fields], *line_values)
    return Documents(result, kept, lines, unknown)
