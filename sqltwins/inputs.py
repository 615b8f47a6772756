"""Turn a query over business tables into one statement over the landing tables."""

from __future__ import annotations

import re

from tallyloom.sources import requests, roles, samples

# What the whole ones of the raw customer bodies say.
READ_BODIES = """
    SELECT CAST(id AS BIGINT) AS request_id, company_name, CAST(NULL AS VARCHAR) AS industry,
           CAST(NULL AS VARCHAR) AS primary_contact_name, CAST(NULL AS VARCHAR) AS primary_email,
           CAST(NULL AS VARCHAR) AS primary_phone, CAST(NULL AS VARCHAR) AS billing_address,
           CAST(NULL AS VARCHAR) AS shipping_address, status
    FROM {customers} WHERE id % 31 <> 0 AND id % 37 <> 0 AND id % 41 <> 0 AND id % 43 <> 0
      AND id % 47 <> 0 AND id % 53 <> 0 AND id % 59 <> 0 AND id % 61 <> 0"""

# Lines of nested order bodies: their number is their place in the body.
NESTED_LINES = """
    SELECT request_id, CAST(row_number() OVER (PARTITION BY request_id
               ORDER BY line_no, product_id, quantity, unit_price) AS INTEGER) AS line_no,
           product_id, quantity, unit_price
    FROM {sales_order_line_feed} WHERE request_id IS NOT NULL"""

DEFINITIONS = {
    **samples.TABLES, **requests.FEEDS, "read_bodies": READ_BODIES, "nested_line_feed": NESTED_LINES}

_USES = re.compile(r"(?i)\b(?:from|join)\s+(\w+)")
_PLACEHOLDER = re.compile(r"\{(\w+)\}")

# Blanks trimmed around request text, as one SQL literal.
BLANKS = (
    "\t\n\v\f\r \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007"
    "\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
)


def _roles() -> str:
    def row(role_id, name, owner):
        items = ", ".join(f"'{p}'" for p in roles.permissions_of(owner))
        return f"({role_id}, '{name}', '{owner}', [{items}])"

    rows = ", ".join(row(*each) for each in roles.ROLE_IDS)
    return (
        "SELECT CAST(id AS BIGINT) AS id, name, canonical_name, permissions "
        f"FROM (VALUES {rows}) AS t(id, name, canonical_name, permissions)"
    )


def _definition(name: str) -> str | None:
    if name == "roles":
        return _roles()
    return DEFINITIONS.get(name)


def statement(query: str, extra: dict[str, str] | None = None) -> str:
    """Prefix ``query`` with the definitions of every input it names.

    ``extra`` holds further named steps, in order; they may use inputs too.
    """
    steps: dict[str, str] = {}

    def need(name: str) -> None:
        text = _definition(name)
        if text is None or name in steps:
            return
        for used in _PLACEHOLDER.findall(text):
            need(used)
        plain = text.replace("{ntz}", "TIMESTAMP")
        steps[name] = _PLACEHOLDER.sub(lambda m: m.group(1), plain)

    texts = [*(extra or {}).values(), query]
    for text in texts:
        for used in _USES.findall(text):
            if used not in (extra or {}):
                need(used)
    steps.update(extra or {})
    if not steps:
        return query
    prefix = ",\n".join(f"{name} AS ({text})" for name, text in steps.items())
    return f"WITH {prefix}\n{query}"


def trim(column: str) -> str:
    return f"trim({column}, '{BLANKS}')"


def text(column: str) -> str:
    return f"nullif({trim(column)}, '')"


def number(column: str) -> str:
    return f"try_cast({trim(column)} AS DECIMAL(38,10))"


def number0(column: str) -> str:
    return f"try_cast(coalesce({text(column)}, '0') AS DECIMAL(38,10))"


def cents(value: str) -> str:
    return f"try_cast({value} AS DECIMAL(18,2))"


def money(column: str) -> str:
    return cents(number(column))


def money0(column: str) -> str:
    return cents(number0(column))


def whole(column: str) -> str:
    n = number(column)
    return f"CASE WHEN {n} = floor({n}) THEN CAST({n} AS BIGINT) END"


def iso_date(column: str) -> str:
    return (
        f"CASE WHEN regexp_full_match({column}, '\\d{{4}}-\\d{{2}}-\\d{{2}}') "
        f"THEN try_cast({column} AS DATE) END"
    )


def iso_moment(column: str) -> str:
    return (
        f"CASE WHEN regexp_full_match({column}, "
        f"'\\d{{4}}-\\d{{2}}-\\d{{2}}T\\d{{2}}:\\d{{2}}:\\d{{2}}(\\.\\d+)?Z') "
        f"THEN try_cast(rtrim({column}, 'Z') AS TIMESTAMP) END"
    )


def boolean(column: str) -> str:
    return f"CASE {column} WHEN 'true' THEN true WHEN 'false' THEN false END"


def one_of(column: str, members: list[str]) -> str:
    return f"{column} must be one of: {', '.join(members)}"


def members(values: list[str]) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"
