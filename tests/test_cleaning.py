"""Scalar expressions, value by value."""

import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tallyloom.functions import business, cleaning


def apply(make, expression, *values):
    rows = make([(i, v) for i, v in enumerate(values)], "i INT, v STRING")
    return [r[0] for r in rows.orderBy("i").select(expression(F.col("v"))).collect()]


def test_trim_takes_all_white_space(make):
    got = apply(make, cleaning.text_or_null, " a ", "\t\n\r", " x﻿", "　 y z ", "",
                None)
    assert got == ["a", None, "x", "y z", None, None]


def test_numbers(make):
    got = apply(make, lambda c: cleaning.cents(cleaning.number(c)),
                " 7 ", "1e2", "10.239", "1.005", "-0.125", "abc", "", None, "NaN", "9" * 40)
    assert got == [Decimal("7.00"), Decimal("100.00"), Decimal("10.24"), Decimal("1.01"),
                   Decimal("-0.13"), None, None, None, None, None]


def test_blank_counts_as_zero_only_on_request(make):
    got = apply(make, lambda c: cleaning.cents(cleaning.number_or_zero(c)), "", " ", None, "x", "2")
    assert got == [Decimal("0.00"), Decimal("0.00"), Decimal("0.00"), None, Decimal("2.00")]


def test_whole_numbers(make):
    got = apply(make, lambda c: cleaning.integer(c), "12.0", "1e2", "1.5", "x", "-3")
    assert got == [12, 100, None, None, -3]


def test_dates(make):
    got = apply(make, cleaning.iso_date, "2024-02-29", "2024-02-30", "2024-2-3", "2024-01-01x", None)
    assert got == [datetime.date(2024, 2, 29), None, None, None, None]


def test_datetimes(make):
    got = apply(make, cleaning.iso_datetime, "2024-01-02T03:04:05Z", "2024-01-02T03:04:05.250Z",
                "2024-01-02 03:04:05Z", "2024-01-02T03:04:05", "2024-13-02T03:04:05Z")
    assert got == [datetime.datetime(2024, 1, 2, 3, 4, 5),
                   datetime.datetime(2024, 1, 2, 3, 4, 5, 250000), None, None, None]


@pytest.mark.parametrize("text, good", [
    ("a@b.co", True), ("a.b+c@d-e.org", True), ("a@b", False), (".a@b.co", False),
    ("a..b@c.co", False), ("a b@c.co", False), ("@c.co", False)])
def test_email(make, text, good):
    assert apply(make, cleaning.is_email, text) == [good]


def test_roles(make):
    got = apply(make, business.canonical_role, "Admin", " SUPERADMIN ", "hr director",
                "Junior Sales", "pilot", "", None)
    assert got == ["Admin", "Admin", "Human Resource", "Junior sales", None, None, None]
    ids = apply(make, lambda c: business.preferred_role_id(business.canonical_role(c)),
                "executive board", "sales viewer", "nobody")
    assert ids == [123, 116, None]


def test_asset_category_and_status(make):
    got = apply(make, business.asset_category, " TECH ", "it equipment", "HVAC", "hvac", " ")
    assert got == ["IT Equipment", "IT Equipment", "HVAC", "hvac", None]
    assert apply(make, business.asset_status, " ", None, "Degraded") == [
        "Operational", "Operational", "Degraded"]


def test_payment_method(make):
    assert apply(make, business.payment_method, "M-Pesa", "Cash") == ["Mobile Money", "Cash"]


def test_sku_base(make):
    got = apply(make, business.sku_base, "red widget", "  --x!!y--", "??", "abcdefghijkl-mnop")
    assert got == ["RED-WIDGET", "X-Y", "PRD", "ABCDEFGHIJKL"]


def test_depreciation(make):
    rows = make([(Decimal("900.00"), None, 7), (Decimal("900.00"), Decimal("100.00"), 3),
                 (Decimal("900.00"), None, 0)],
                "cost DECIMAL(18,2), salvage DECIMAL(18,2), years INT")
    got = [r[0] for r in rows.select(business.yearly_depreciation(
        F.col("cost"), F.col("salvage"), F.col("years"))).collect()]
    assert got == [Decimal("128.57"), Decimal("266.67"), None]


def test_month_label(spark):
    row = spark.range(1).select(
        business.month_start(F.lit("2024-05-17").cast("date")),
        business.month_label(F.lit("2024-05-17").cast("date"))).first()
    assert tuple(row) == (datetime.date(2024, 5, 1), "May 2024")
