"""Ready-made field rules: required text, vocabularies, amounts, whole numbers, dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyloom.functions import cleaning, reasons
from tallyloom.operators.validate import Field, Rule, cleaned, parsed


def required_text(name: str, *, default: str | None = None) -> Field:
    raw = cleaning.or_default(F.col(name), default) if default else F.col(name)
    return Field(
        name, cleaning.text_or_null(raw), (Rule(cleaned(name).isNull(), reasons.required(name)),)
    )


def optional_text(name: str) -> Field:
    return Field(name, cleaning.text_or_null(F.col(name)))


def plain_text(name: str) -> Field:
    return Field(name, F.col(name))


def choice(name: str, members: list[str], *, default: str | None = None) -> Field:
    """Trimmed, case-sensitive member of a vocabulary."""
    raw = cleaning.or_default(F.col(name), default) if default else F.col(name)
    value = F.coalesce(cleaning.trimmed(raw), F.lit(""))
    return Field(
        name, value, (Rule(~cleaned(name).isin(members), reasons.one_of(name, members)),),
        members=tuple(members),
    )


def exact_choice(name: str, members: list[str], *, default: str | None = None) -> Field:
    """Member of a vocabulary without trimming; absent takes the default when there is one."""
    value = F.coalesce(F.col(name), F.lit(default)) if default else F.col(name)
    bad = ~F.coalesce(cleaned(name), F.lit("")).isin(members)
    return Field(name, value, (Rule(bad, reasons.one_of(name, members)),), members=tuple(members))


def amount(
    name: str,
    reason: str,
    *,
    negative: bool = False,
    positive: bool = False,
    zero_if_blank: bool = False,
    at_most: int | None = None,
    too_big: str = "",
    source: str | None = None,
    optional: bool = False,
) -> Field:
    """Money with two places. The sign is judged before rounding, the maximum after."""
    text = F.col(source or name)
    raw = cleaning.number_or_zero(text) if zero_if_blank else cleaning.number(text)
    bad = cleaned(name).isNull()
    if optional:
        bad = bad & text.isNotNull()
    if not negative:
        bad = bad | (parsed(name) < 0)
    if positive:
        bad = bad | (parsed(name) <= 0)
    rules = [Rule(bad, reason)]
    if at_most is not None:
        rules.append(Rule(cleaned(name) > at_most, too_big))
    return Field(name, cleaning.cents(parsed(name)), tuple(rules), parse=raw)


def whole_number(
    name: str,
    reason: str,
    *,
    low: int = 1,
    high: int | None = None,
    optional: bool = False,
    default: int | None = None,
) -> Field:
    value = parsed(name)
    if default is not None:
        value = F.when(F.col(name).isNull(), F.lit(default).cast("bigint")).otherwise(value)
    bad = cleaned(name).isNull() | (cleaned(name) < low)
    if high is not None:
        bad = bad | (cleaned(name) > high)
    if optional:
        bad = F.col(name).isNotNull() & bad
    return Field(name, value, (Rule(bad, reason),), parse=cleaning.integer(F.col(name)))


def date(
    name: str,
    *,
    required: bool = False,
    default: Column | None = None,
    strict: bool = False,
) -> Field:
    """ISO date. A missing date is caught first, an unreadable one when the row is stored;
    ``strict`` checks both up front."""
    text = F.nullif(F.col(name), F.lit(""))
    unreadable = Rule(text.isNotNull() & parsed(name).isNull(), reasons.valid_date(name))
    missing = (Rule(text.isNull(), reasons.required(name)),) if required else ()
    if strict:
        bad = Rule(parsed(name).isNull(), unreadable.reason) if required else unreadable
        first, late = (bad,), ()
    else:
        first, late = missing, (unreadable,)
    value = parsed(name)
    if default is not None:
        value = F.when(text.isNull(), default).otherwise(value)
    return Field(name, value, first, late, parse=cleaning.iso_date(text))


def moment(name: str, *, default: Column | None = None) -> Field:
    """Optional UTC date-time."""
    value = parsed(name)
    if default is not None:
        value = F.when(F.col(name).isNull(), default).otherwise(value)
    bad = F.col(name).isNotNull() & parsed(name).isNull()
    return Field(
        name, value, (Rule(bad, reasons.valid_datetime(name)),),
        parse=cleaning.iso_datetime(F.col(name)),
    )


def flag(
    name: str, *, default: bool | None = None, required: bool = False, reason: str | None = None
) -> Field:
    value = parsed(name)
    bad = value.isNull() if required else F.col(name).isNotNull() & value.isNull()
    if default is not None:
        value = F.when(F.col(name).isNull(), F.lit(default)).otherwise(value)
    return Field(
        name, value, (Rule(bad, reason or reasons.true_or_false(name)),),
        parse=cleaning.boolean(F.col(name)), members=(False, True),
    )
