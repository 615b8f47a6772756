"""Figures of the sf0.01 sample that were worked out by hand in SQL before the build."""

import os
from decimal import Decimal

import pytest

from tallyloom.plans import bi, finance, inventory, scm
from tallyloom.sources.tables import SampleTables

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def sample(spark):
    if not os.path.isdir(FOLDER):
        pytest.skip("sf0.01 is not here")
    return SampleTables(spark, FOLDER)


def test_revenue(sample):
    assert bi.revenue(sample).first()[0] == Decimal("3611431113.07")


@pytest.mark.parametrize("rows, report", [
    (14743, finance.journal_entries), (14357, finance.receivables), (6250, finance.payables),
    (8483, bi.audit_joined), (13500, finance.unreversed_entries), (208, inventory.alerts),
])
def test_row_counts(sample, rows, report):
    assert report(sample).count() == rows


def test_low_stock(sample):
    assert bi.low_stock_count(sample).first()[0] == 100


def test_supplier_name_sources(sample):
    """Names come from the supplier where there is one, from the vendor otherwise."""
    orders = sample.purchase_orders
    named = scm.with_supplier(orders, sample).filter("supplier_name IS NOT NULL")
    assert named.filter("supplier_name LIKE 'Vendor %'").count() == 2319
    assert named.filter("supplier_name NOT LIKE 'Vendor %'").count() == 4501 + 4501
    assert scm.with_supplier_only(orders, sample).filter("supplier_name IS NULL").count() == (
        2319 + 3679)
