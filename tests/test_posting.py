"""Posting jobs: documents as a whole, balance, reversals, payments."""

import datetime
import os
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tallyloom import session
from tallyloom.plans import access, posting
from tallyloom.sources.roles import role_table

NOW = datetime.datetime(2024, 5, 1)
DAY = datetime.date(2024, 5, 1)


def reasons(frame):
    return {r["request_id"]: r["reject_reason"] for r in frame.collect()}


def ids(make, *values):
    return make([(v,) for v in values], "id BIGINT")


def test_sales_orders_are_all_or_nothing(make, bundle):
    heads = make([(i, "1", None, None) for i in range(9)],
                 "request_id BIGINT, customer_id STRING, order_date STRING, status STRING")
    lines = make(
        [(0, 1, "1", "2", "0.125"), (0, 2, "2", "1", "1"), (2, 1, "1", "0", "1"),
         (2, 2, "1", "1", "1"), (3, 1, "1", "1", "-1"), (4, 1, "9", "1", "1"),
         (4, 2, "1", "1", "1"), (5, 1, "x", "0", "1"), (6, 2, "1", "0", "1"),
         (6, 1, "1", "1", "x"), (7, 1, "1", "1.0", "1e1"), (8, 1, "1", "1", "1"),
         (8, None, "1", "0", "-5"), (None, 1, "1", "1", "1")],
        "request_id BIGINT, line_no INT, product_id STRING, quantity STRING, unit_price STRING")
    t = bundle(customers=ids(make, 1), products=ids(make, 1, 2))
    done = posting.sales_orders(t, NOW, heads, lines)
    assert reasons(done.headers) == {
        0: None, 1: "order_lines must contain at least one item",
        2: "quantity must be at least 1", 3: "unit_price must be 0 or greater",
        4: "Invalid customer_id or product_id reference", 5: "product_id is required",
        6: "unit_price must be 0 or greater", 7: None, 8: "quantity must be at least 1"}
    first = done.headers.filter("request_id = 0").first()
    assert first["total_amount"] == Decimal("1.250000")
    assert (first["status"], first["order_date"]) == ("Draft", NOW)
    assert done.lines().groupBy("request_id").count().orderBy("request_id").collect() == [(0, 2),
                                                                                        (7, 1)]


def test_purchase_orders_round_lines_then_total(make, bundle):
    heads = make([(0, " P ", "1", ""), (1, "P", "1", None), (2, " ", "0", None),
                  (3, "P", "1", "soon")],
                 "request_id BIGINT, po_number STRING, supplier_id STRING, "
                 "expected_delivery_date STRING")
    lines = make(
        [(0, 1, "1", "3", "3.456"), (0, 2, "1", "1", "0.005"), (1, 1, "1", "1", "1"),
         (1, 2, "1", "1.5", "1"), (2, 1, "1", "1", "1"), (3, 1, "1", "1", "1")],
        "request_id BIGINT, line_no INT, product_id STRING, quantity_ordered STRING, "
        "unit_cost STRING")
    done = posting.purchase_orders(bundle(), heads, lines)
    assert reasons(done.headers) == {
        0: None, 1: "quantity_ordered must be a positive integer for line 2",
        2: "po_number is required", 3: "expected_delivery_date must be a valid date"}
    first = done.headers.filter("request_id = 0").first()
    assert (first["total_amount"], first["status"]) == (Decimal("10.39"), "Submitted")


@pytest.mark.parametrize("lines, reason", [
    ([("1", "5", "0"), ("2", "0", "5")], None),
    ([("1", "5", "0")], "At least two journal lines are required"),
    ([("1", "5", "0"), ("2", "0", "4.99")], "Debits must equal Credits"),
    ([("1", "0.004", ""), ("1", "0.004", ""), ("2", "", "0.008")], "Debits must equal Credits"),
    ([("1", "0", "0"), ("2", "", None)], "Journal entry total must be greater than 0"),
    ([("1", "5", "0"), ("2", "0", "5"), ("1", "0", "0")],
     "Each journal line must include a debit or credit amount"),
    ([("1", "-5", "0"), ("2", "0", "-5")], "debit must be 0 or greater"),
    ([("0", "5", "0"), ("2", "0", "5")], "account_id is required"),
    ([("1", "5", "0"), ("7", "0", "5")], "Invalid foreign key reference in finance request"),
])
def test_journal_rules(make, bundle, lines, reason):
    heads = make([(1, "d", "2024-01-01", None)],
                 "request_id BIGINT, description STRING, entry_date STRING, created_by STRING")
    rows = make([(1, i, *line) for i, line in enumerate(lines)],
                "request_id BIGINT, line_no INT, account_id STRING, debit STRING, credit STRING")
    done = posting.journal_entries(bundle(accounts=ids(make, 1, 2)), heads, rows)
    assert reasons(done.headers) == {1: reason}
    assert posting.journal_lines(done).count() == (len(lines) if reason is None else 0)


def test_posted_journals_balance(tables):
    lines = posting.journal_lines(posting.journal_entries(tables))
    sums = lines.groupBy("request_id").agg(F.sum("debit").alias("d"), F.sum("credit").alias("c"))
    assert sums.count() > 0 and sums.filter("d <> c OR d <= 0").isEmpty()


def test_reversals(make, bundle):
    entries = make(
        [(1, "one", None, None), (2, "two", None, None), (3, "rev", "JournalReversal", 2),
         (4, "bare", None, None)],
        "id BIGINT, description STRING, reference_type STRING, reference_id BIGINT")
    lines = make(
        [(1, 5, Decimal("3.00"), Decimal("0.00")), (1, 6, Decimal("0.00"), Decimal("3.00")),
         (2, 5, Decimal("1.00"), Decimal("0.00")), (3, 5, Decimal("0.00"), Decimal("1.00"))],
        "journal_entry_id BIGINT, account_id BIGINT, debit DECIMAL(18,2), credit DECIMAL(18,2)")
    feed = make([(10, 1, 7), (9, 1, 8), (11, 2, 7), (12, 3, 7), (13, 4, 7), (14, 50, 7)],
                "request_id BIGINT, journal_entry_id BIGINT, created_by BIGINT")
    done = posting.reversals(bundle(journal_entries=entries, journal_entry_lines=lines), DAY, feed)
    again = "This journal entry has already been reversed"
    assert reasons(done.requests) == {
        9: None, 10: again, 11: again, 12: None, 13: "Journal entry has no lines to reverse",
        14: "Journal entry not found"}
    heads = {r["id"]: r for r in done.entries.collect()}
    assert heads[9]["description"] == "Reversal of JE #1 - one" and heads[9]["created_by"] == 8
    assert (heads[9]["entry_date"], heads[9]["reference_id"]) == (DAY, 1)
    swapped = sorted((r["account_id"], r["debit"], r["credit"])
                     for r in done.lines().filter("journal_entry_id = 9").collect())
    assert swapped == [(5, Decimal("0.00"), Decimal("3.00")), (6, Decimal("3.00"), Decimal("0.00"))]


PAYMENT = {"invoice_id": "1", "amount_paid": "10.005", "payment_method": "M-Pesa",
           "debit_account_id": "1", "credit_account_id": "2", "payment_reference": " ",
           "payment_date": None}


@pytest.mark.parametrize("change, reason", [
    ({}, None),
    ({"amount_paid": "0", "invoice_id": "9"}, "amount_paid must be greater than 0"),
    ({"payment_method": "Barter"}, "payment_method must be a supported payment type"),
    ({"invoice_id": "9", "debit_account_id": "9"}, "Invoice not found"),
    ({"debit_account_id": "9"}, "Invalid debit_account_id or credit_account_id"),
    ({"credit_account_id": "1"}, "Invalid debit_account_id or credit_account_id"),
    ({"credit_account_id": "3"}, "All journal accounts must be active"),
])
def test_payment(make, bundle, change, reason):
    row = {**PAYMENT, **change}
    feed = make([(5, *row.values())],
                "request_id BIGINT, " + ", ".join(f"{c} STRING" for c in row))
    t = bundle(
        invoices=make([(1, "INV-1")], "id BIGINT, invoice_number STRING"),
        accounts=make([(1, True), (2, True), (3, False)], "id BIGINT, is_active BOOLEAN"))
    done = posting.payments(t, NOW, feed)
    assert reasons(done.requests) == {5: reason}
    rows = done.payments.collect()
    assert len(rows) == (reason is None)
    if reason is None:
        assert tuple(rows[0]) == (5, 1, None, Decimal("10.01"), NOW, "Mobile Money")
        assert done.entries.first()["description"] == "Payment received for Invoice INV-1"
        assert sorted(tuple(r) for r in done.lines.collect()) == [
            (5, 1, Decimal("10.01"), Decimal("0.00")), (5, 2, Decimal("0.00"), Decimal("10.01"))]


def test_settled_payments_are_the_same(tables):
    plain, settled = [posting.payments(tables, NOW, settle=s) for s in (False, True)]
    for name in ("requests", "payments", "entries", "lines"):
        left, right = getattr(plain, name), getattr(settled, name)
        assert left.exceptAll(right).isEmpty() and right.exceptAll(left).isEmpty()


def test_access(spark, make, bundle):
    t = bundle(
        roles=role_table(spark),
        users=make([(1, 113), (2, 118), (3, 500), (4, None)], "id BIGINT, role_id BIGINT"),
        access_log=make([(1, 1, "any:thing"), (2, 2, "inventory:read"), (3, 2, "finance:read"),
                         (4, 3, "bi:read"), (5, 4, "bi:read"), (6, 77, "bi:read")],
                        "id BIGINT, user_id BIGINT, action STRING"))
    verdicts = {r["id"]: r["verdict"] for r in access.access_audit(t).collect()}
    assert verdicts == {
        1: "allowed", 2: "allowed", 3: "Forbidden: insufficient permissions",
        4: "Role not found", 5: "User role is missing", 6: "User role is missing"}
    granted = {(r["user_id"], r["permission"]) for r in access.user_permissions(t).collect()}
    assert (1, "*") in granted and (1, "hr:write") in granted
    assert {p for u, p in granted if u == 2} == {"inventory:read", "inventory:write"}


def test_no_line_is_lost(make, bundle):
    """Accepted and rejected lines are the lines that came in, each once."""
    heads = make([(0, "d", "2024-01-01", "1"), (1, " ", "2024-01-01", "1"), (2, "d", "2024-01-01", "1")],
                 "request_id BIGINT, description STRING, entry_date STRING, created_by STRING")
    sent = [(0, 1, "1", "5", "0"), (0, 2, "2", "0", "5"), (1, 1, "1", "5", "0"), (1, 2, "2", "0", "5"),
            (2, 1, "1", "5", "0"), (2, None, "1", "5", "0"), (2, None, "1", "5", "0"),
            (7, 1, "1", "1", "0"), (None, 1, "1", "1", "0"), (None, None, None, None, None)]
    lines = make(sent, "request_id BIGINT, line_no INT, account_id STRING, debit STRING, credit STRING")
    t = bundle(accounts=ids(make, 1, 2))
    done = posting.journal_entries(t, heads, lines)
    rejected = sorted((tuple(r) for r in done.rejected_lines().collect()), key=str)
    assert posting.journal_lines(done).count() + len(rejected) == len(sent)
    assert rejected == sorted([
        (1, 1, "description is required"), (1, 2, "description is required"),
        (2, 1, "Debits must equal Credits"), (2, None, "Debits must equal Credits"),
        (2, None, "Debits must equal Credits"), (7, 1, "Journal entry not found"),
        (None, 1, "Journal entry not found"), (None, None, "Journal entry not found")], key=str)


@pytest.mark.parametrize("job", ["sales_orders", "purchase_orders", "journal_entries"])
def test_posted_and_rejected_lines_add_up(tables, job):
    feeds = {"sales_orders": "sales_order_line_feed", "purchase_orders": "purchase_order_line_feed",
             "journal_entries": "journal_line_feed"}
    args = (NOW,) if job == "sales_orders" else ()
    done = getattr(posting, job)(tables, *args)
    sent = getattr(tables, feeds[job])
    good, bad = done.lines().select("request_id", "line_no"), done.rejected_lines().select("request_id", "line_no")
    assert bad.count() > 0
    assert sent.select("request_id", "line_no").exceptAll(good.unionAll(bad)).isEmpty()
    assert good.count() + bad.count() == sent.count()


def test_tasks_over_the_lines_are_bounded(spark, tables, monkeypatch):
    """However few cores or partitions a session has, its tasks take no more than the sizes set."""
    known = {key: spark.conf.get(key) for key in session.TASK_SIZES}
    parts = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    monkeypatch.setattr(session, "TASK_SIZES", {key: 20000 for key in known})
    try:
        for key in known:
            spark.conf.set(key, "64m")
        posted = posting.journal_entries(tables)
        assert {spark.conf.get(key) for key in known} == {"20000"}
        assert int(spark.conf.get(parts)) == session.LEAST_PARTITIONS
        size = sum(os.path.getsize(name.removeprefix("file://")) for name in posted.checked_lines.inputFiles())
        assert posted.checked_lines.rdd.getNumPartitions() >= size / 20000
        spark.conf.set("spark.sql.files.maxPartitionBytes", "10k")
        session.bound_tasks(spark)
        assert spark.conf.get("spark.sql.files.maxPartitionBytes") == "10k"
    finally:
        for key, value in known.items():
            spark.conf.set(key, value)
        spark.conf.unset(parts)
