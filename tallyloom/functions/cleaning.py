"""Column expressions that read untrusted text: trimming, numbers, money, dates, booleans.

None of them can raise under ANSI mode; unreadable input becomes NULL.
"""

from __future__ import annotations

import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters that count as white space around request text.
BLANKS = (
    "\t\n\v\f\r \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007"
    "\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
)

EMAIL = r"(?i)^[a-z0-9_'+\-.]*[a-z0-9_+\-]@([a-z0-9][a-z0-9\-]*\.)+[a-z]{2,}$"


def trimmed(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANKS))


def text_or_null(text: Column) -> Column:
    """Trimmed text, blank as NULL."""
    return F.nullif(trimmed(text), F.lit(""))


def or_default(text: Column, default: str) -> Column:
    """``default`` where the field is missing or the empty string."""
    return F.coalesce(F.nullif(text, F.lit("")), F.lit(default))


NUMBER = "decimal(38,10)"


def number(text: Column) -> Column:
    """Clean text is read as it is; only what does not read is trimmed and tried again."""
    return F.coalesce(text.try_cast(NUMBER), trimmed(text).try_cast(NUMBER))


def number_or_zero(text: Column) -> Column:
    """Number where a missing or blank field counts as zero."""
    blank = F.coalesce(text_or_null(text), F.lit("0")).try_cast(NUMBER)
    return F.coalesce(text.try_cast(NUMBER), blank)


def cents(value: Column) -> Column:
    """Round half up to two places."""
    return value.try_cast("decimal(18,2)")


def whole(value: Column) -> Column:
    """A whole number as BIGINT, anything else as NULL."""
    return F.when(value == F.floor(value), value.try_cast("bigint"))


def integer(text: Column) -> Column:
    """Whole number in text: plain digits first, then spellings like ``12.0`` or ``1e2``."""
    return F.coalesce(text.try_cast("bigint"), whole(number(text)))


def iso_date(text: Column) -> Column:
    """Strict ``YYYY-MM-DD`` calendar date."""
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), text.try_cast("date"))


def iso_datetime(text: Column) -> Column:
    """Strict UTC ``YYYY-MM-DDTHH:MM:SS[.fff]Z``."""
    return F.when(
        text.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?Z$"),
        F.rtrim(text, F.lit("Z")).try_cast("timestamp_ntz"),
    )


def boolean(text: Column) -> Column:
    return F.when(text == "true", F.lit(True)).when(text == "false", F.lit(False))


def is_email(text: Column) -> Column:
    return text.rlike(EMAIL) & ~text.startswith(".") & ~text.contains("..")


def instant(at: datetime.datetime) -> Column:
    """A fixed zone-less timestamp."""
    return F.lit(at.isoformat(sep=" ")).cast("timestamp_ntz")
