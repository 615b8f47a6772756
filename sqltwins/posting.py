"""Expected outcome of the posting jobs and the access rules, as SQL."""

from __future__ import annotations

from sqltwins import intake as i
from sqltwins.inputs import (
    cents, iso_moment, members, money, money0, number, number0, statement, text, trim, whole,
)

M = "DECIMAL(18,2)"


def documents(headers, lines, columns, rules, line_columns, line_rules, totals, no_lines, least=1,
              late=(), line_key=None, header_key=None, numbered=False, hidden=(), derived=None,
              unknown=None):
    typed = ", ".join(f"{v} AS {n}" for n, v in columns.items())
    line_typed = ", ".join(f"{v} AS {n}" for n, v in line_columns.items())
    more = "".join(f", {v} AS {n}" for n, v in (derived or {}).items())
    stray = (f"{line_key[0]} IS NOT NULL AND {line_key[0]} NOT IN (SELECT id FROM {line_key[1]})"
             if line_key else "false")
    suffix = " || ' for line ' || CAST(line_no AS VARCHAR)" if numbered else ""
    missing = []
    if header_key:
        missing.append((f"h.{header_key[0]} NOT IN (SELECT id FROM {header_key[1]})",
                        header_key[2]))
    if line_key:
        missing.append(("d.stray", line_key[2]))
    steps = {
        "judged_lines": f"SELECT f.request_id, f.line_no, {line_typed}, {i.reasons(line_rules)} "
                        f"AS l0, {i.reasons([(c, str(n)) for n, (c, _) in enumerate(line_rules)])}"
                        f" AS rule FROM {lines} f WHERE f.request_id IS NOT NULL",
        "all_lines": f"SELECT l.*{more}, ({stray}) AS stray FROM judged_lines l",
        "worst": "SELECT request_id, reason FROM (SELECT request_id, l0" + suffix + " AS reason, "
                 "row_number() OVER (PARTITION BY request_id ORDER BY line_no, rule) AS rn "
                 "FROM all_lines WHERE l0 IS NOT NULL) x WHERE rn = 1",
        "sums": "SELECT request_id, count(*) AS n, bool_or(stray) AS stray, "
                + ", ".join(f"{v} AS {k}" for k, v in totals.items())
                + " FROM all_lines GROUP BY request_id",
        "heads": f"SELECT f.request_id, {typed}, {i.reasons(rules)} AS h0 FROM {headers} f",
        "verdict": "SELECT h.*, " + ", ".join(f"d.{k}" for k in totals)
                   + f", coalesce(h.h0, CASE WHEN coalesce(d.n, 0) < {least} THEN "
                   f"{i.quoted(no_lines)} END, w.reason, {i.reasons([*late, *missing])}) "
                   "AS reject_reason FROM heads h LEFT JOIN sums d ON d.request_id = h.request_id "
                   "LEFT JOIN worst w ON w.request_id = h.request_id",
    }
    shown = ", ".join(
        f"CASE WHEN reject_reason IS NULL THEN {n} END AS {n}"
        for n in [*columns, *totals] if n not in hidden
    )
    kept = ", ".join(n for n in [*line_columns, *(derived or {})] if n not in hidden)
    return (
        statement(f"SELECT request_id, {shown}, reject_reason FROM verdict", steps),
        statement(f"SELECT request_id, line_no, {kept} FROM all_lines WHERE request_id IN "
                  "(SELECT request_id FROM verdict WHERE reject_reason IS NULL)", steps),
        statement(f"SELECT f.request_id, f.line_no, coalesce(v.reject_reason, {i.quoted(unknown)}) "
                  f"AS reject_reason FROM {lines} f LEFT JOIN verdict v ON v.request_id = f.request_id "
                  "WHERE v.request_id IS NULL OR v.reject_reason IS NOT NULL", steps),
    )


_PRICE = number("f.unit_price")
_SALES_KEY = "Invalid customer_id or product_id reference"


def sales(lines):
    return documents(
        "sales_order_feed", lines,
        {"customer_id": whole("f.customer_id"),
         "order_date": f"CASE WHEN f.order_date IS NULL THEN {i.MOMENT} "
                       f"ELSE {iso_moment('f.order_date')} END",
         "status": f"coalesce({trim('f.status')}, 'Draft')"},
        [i.not_positive("customer_id", "customer_id is required"),
         (f"f.order_date IS NOT NULL AND ({iso_moment('f.order_date')}) IS NULL",
          "order_date must be a valid datetime"),
         (f"{trim('f.status')} = ''", "status must not be blank")],
        {"product_id": whole("f.product_id"), "quantity": whole("f.quantity"),
         "unit_price": f"CAST({_PRICE} AS DECIMAL(20,6))"},
        [i.not_positive("product_id", "product_id is required"),
         i.not_positive("quantity", "quantity must be at least 1"),
         (f"{_PRICE} IS NULL OR {_PRICE} < 0", "unit_price must be 0 or greater")],
        {"total_amount": "CAST(sum(subtotal) AS DECIMAL(28,6))"},
        "order_lines must contain at least one item", unknown="Sales order not found",
        line_key=("product_id", "products", _SALES_KEY),
        header_key=("customer_id", "customers", _SALES_KEY),
        derived={"subtotal": "CAST(CAST(quantity AS DECIMAL(10,0)) * unit_price AS DECIMAL(28,6))"},
    )


SALES = sales("sales_order_line_feed")
NESTED_SALES = sales("nested_line_feed")

PURCHASE = documents(
    "purchase_order_feed", "purchase_order_line_feed",
    {"po_number": text("f.po_number"), "supplier_id": whole("f.supplier_id"),
     "expected_delivery_date": i.day("expected_delivery_date"), "status": "'Submitted'"},
    [i.required("po_number"),
     i.not_positive("supplier_id", "supplier_id must be a valid vendor id"),
     i.bad_day("expected_delivery_date")],
    {"unit_cost": money("f.unit_cost"), "product_id": whole("f.product_id"),
     "quantity_ordered": whole("f.quantity_ordered"), "quantity_received": "0"},
    [i.bad_amount("unit_cost", "Invalid unit_cost"),
     i.not_positive("product_id", "product_id is invalid"),
     i.not_positive("quantity_ordered", "quantity_ordered must be a positive integer")],
    {"total_amount": f"CAST(sum(subtotal) AS {M})"},
    "At least one line item is required", numbered=True, unknown="Purchase order not found",
    derived={"subtotal": f"CAST(CAST(quantity_ordered AS DECIMAL(10,0)) * unit_cost AS {M})"},
)

JOURNAL = documents(
    "journal_feed", "journal_line_feed",
    {"description": text("f.description"), "entry_date": i.day("entry_date"),
     "created_by": whole("f.created_by")},
    [i.required("description"),
     (f"({i.day('entry_date')}) IS NULL", "entry_date must be a valid date")],
    {"account_id": whole("f.account_id"), "debit": money0("f.debit"),
     "credit": money0("f.credit"), "raw_debit": number0("f.debit"),
     "raw_credit": number0("f.credit")},
    [i.not_positive("account_id", "account_id is required"),
     (f"{money0('f.debit')} IS NULL OR {number0('f.debit')} < 0", "debit must be 0 or greater"),
     (f"{money0('f.credit')} IS NULL OR {number0('f.credit')} < 0",
      "credit must be 0 or greater")],
    {"total_debit": f"CAST(sum(debit) AS {M})", "total_credit": f"CAST(sum(credit) AS {M})",
     "rd": "round(sum(raw_debit), 2)", "rc": "round(sum(raw_credit), 2)",
     "void": "bool_or(debit <= 0 AND credit <= 0)"},
    "At least two journal lines are required", least=2, unknown="Journal entry not found",
    late=[("d.rd <> d.rc OR d.total_debit <> d.total_credit", "Debits must equal Credits"),
          ("d.total_debit <= 0", "Journal entry total must be greater than 0"),
          ("d.void", "Each journal line must include a debit or credit amount")],
    line_key=("account_id", "accounts", "Invalid foreign key reference in finance request"),
    hidden=("rd", "rc", "void", "raw_debit", "raw_credit"),
)

_REVERSED = {
    "ranked": "SELECT f.*, row_number() OVER (PARTITION BY journal_entry_id ORDER BY request_id) "
              "AS turn FROM reversal_feed f",
    "verdict": """SELECT r.*, e.description, CASE
        WHEN e.id IS NULL THEN 'Journal entry not found'
        WHEN NOT EXISTS (SELECT 1 FROM journal_entry_lines l
          WHERE l.journal_entry_id = r.journal_entry_id)
          THEN 'Journal entry has no lines to reverse'
        WHEN r.turn > 1 OR EXISTS (SELECT 1 FROM journal_entries o
          WHERE o.reference_type = 'JournalReversal' AND o.reference_id = r.journal_entry_id)
          THEN 'This journal entry has already been reversed' END AS reject_reason
        FROM ranked r LEFT JOIN journal_entries e ON e.id = r.journal_entry_id""",
}

_PAY = {
    "checked": f"""SELECT f.request_id, {whole('f.invoice_id')} AS invoice_id,
        {money('f.amount_paid')} AS amount_paid,
        CASE WHEN f.payment_method = 'M-Pesa' THEN 'Mobile Money' ELSE f.payment_method END
          AS payment_method,
        {whole('f.debit_account_id')} AS debit_account_id,
        {whole('f.credit_account_id')} AS credit_account_id,
        {text('f.payment_reference')} AS payment_reference,
        CASE WHEN f.payment_date IS NULL THEN {i.MOMENT} ELSE {iso_moment('f.payment_date')} END
          AS payment_date,
        {i.reasons([
            i.not_positive('invoice_id', 'invoice_id is required'),
            (f"{money('f.amount_paid')} IS NULL OR {number('f.amount_paid')} <= 0",
             'amount_paid must be greater than 0'),
            ("coalesce(f.payment_method, '') NOT IN " + members(
                ['Bank Transfer', 'Credit Card', 'Cash', 'Mobile Money', 'M-Pesa', 'Check']),
             'payment_method must be a supported payment type'),
            i.not_positive('debit_account_id', 'debit_account_id is required'),
            i.not_positive('credit_account_id', 'credit_account_id is required'),
            (f"f.payment_date IS NOT NULL AND ({iso_moment('f.payment_date')}) IS NULL",
             'payment_date must be a valid datetime'),
        ])} AS r0 FROM payment_feed f""",
    "verdict": """SELECT c.*, v.invoice_number, coalesce(r0, CASE
        WHEN v.id IS NULL THEN 'Invoice not found'
        WHEN (SELECT count(*) FROM accounts a
          WHERE a.id IN (c.debit_account_id, c.credit_account_id)) <> 2
          THEN 'Invalid debit_account_id or credit_account_id'
        WHEN EXISTS (SELECT 1 FROM accounts a WHERE a.id IN (c.debit_account_id,
          c.credit_account_id) AND NOT a.is_active)
          THEN 'All journal accounts must be active' END) AS reject_reason
        FROM checked c LEFT JOIN invoices v ON v.id = c.invoice_id""",
}
_GOOD = "FROM verdict WHERE reject_reason IS NULL"

ORACLES = {
    "post_sales_orders": SALES[0], "post_sales_order_lines": SALES[1],
    "post_purchase_orders": PURCHASE[0], "post_purchase_order_lines": PURCHASE[1],
    "post_journal_entries": JOURNAL[0], "post_journal_lines": JOURNAL[1],
    "post_sales_order_lines_rejected": SALES[2],
    "post_purchase_order_lines_rejected": PURCHASE[2],
    "post_journal_lines_rejected": JOURNAL[2],
    "journal_balance": statement(
        f"""SELECT request_id, total_debit, total_credit, has_empty_line,
        total_debit = total_credit AS balanced FROM (SELECT request_id,
          CAST(sum({cents(number0('debit'))}) AS {M}) AS total_debit,
          CAST(sum({cents(number0('credit'))}) AS {M}) AS total_credit,
          bool_or({money0('debit')} <= 0 AND {money0('credit')} <= 0) AS has_empty_line
          FROM journal_line_feed WHERE request_id IS NOT NULL GROUP BY request_id) x"""),
    "reverse_requests": statement(
        "SELECT request_id, journal_entry_id, reject_reason FROM verdict", _REVERSED),
    "reverse_entries": statement(
        f"""SELECT request_id AS id, {i.DAY} AS entry_date, 'Reversal of JE #'
        || CAST(journal_entry_id AS VARCHAR) || ' - ' || description AS description,
        'JournalReversal' AS reference_type, journal_entry_id AS reference_id, created_by
        {_GOOD}""", _REVERSED),
    "reverse_lines": statement(
        """SELECT w.new_id AS journal_entry_id, l.account_id, l.credit AS debit, l.debit AS credit
        FROM wanted w JOIN journal_entry_lines l ON l.journal_entry_id = w.journal_entry_id""",
        {"undone": """SELECT e.id FROM journal_entries e LEFT JOIN (
            SELECT DISTINCT reference_id FROM journal_entries
            WHERE reference_type = 'JournalReversal') o ON o.reference_id = e.id
            WHERE o.reference_id IS NULL""",
         "wanted": """SELECT f.journal_entry_id, min(f.request_id) AS new_id
            FROM reversal_feed f JOIN undone u ON u.id = f.journal_entry_id
            GROUP BY f.journal_entry_id"""}),
    "payment_requests": statement("SELECT request_id, reject_reason FROM verdict", _PAY),
    "payment_rows": statement(
        f"""SELECT request_id AS id, invoice_id, payment_reference, amount_paid, payment_date,
        payment_method {_GOOD}""", _PAY),
    "payment_entries": statement(
        f"""SELECT request_id AS id, CAST(payment_date AS DATE) AS entry_date,
        'Payment received for Invoice ' || invoice_number AS description,
        'Payment' AS reference_type, request_id AS reference_id {_GOOD}""", _PAY),
    "payment_lines": statement(
        f"""SELECT request_id AS journal_entry_id, debit_account_id AS account_id,
        amount_paid AS debit, CAST(0 AS {M}) AS credit {_GOOD} UNION ALL
        SELECT request_id, credit_account_id, CAST(0 AS {M}), amount_paid {_GOOD}""", _PAY),
    "payment_accounts": statement(
        """SELECT request_id, (SELECT count(*) FROM accounts a WHERE a.is_active
          AND a.id IN (d, c)) = 2 AS usable FROM (SELECT request_id,
            TRY_CAST(debit_account_id AS BIGINT) AS d, TRY_CAST(credit_account_id AS BIGINT) AS c
            FROM payment_feed) x"""),
    "user_permissions": statement(
        """SELECT u.id AS user_id, r.name AS role, unnest(r.permissions) AS permission
        FROM users u JOIN roles r ON r.id = u.role_id"""),
    "access_audit": statement(
        """SELECT l.id, l.user_id, l.action, CASE
        WHEN u.role_id IS NULL THEN 'User role is missing'
        WHEN r.id IS NULL THEN 'Role not found'
        WHEN list_contains(r.permissions, '*') OR list_contains(r.permissions, l.action)
          THEN 'allowed' ELSE 'Forbidden: insufficient permissions' END AS verdict
        FROM access_log l LEFT JOIN users u ON u.id = l.user_id
        LEFT JOIN roles r ON r.id = u.role_id"""),
    "resolve_roles": statement(
        """SELECT request_id, role, CAST(CASE lower(trim(role)) WHEN 'admin' THEN 113
          WHEN 'finance controller' THEN 122 WHEN '119' THEN 119 WHEN 'junior sales' THEN 116
          WHEN 'hr director' THEN 120 END AS BIGINT) AS role_id,
        CASE WHEN lower(trim(role)) IN ('pilot', '-3') THEN 'Unsupported role' END
          AS reject_reason FROM role_feed"""),
}
