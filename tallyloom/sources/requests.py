"""Request feeds: every field arrives as text, some rows are damaged on purpose.

A damaged row is chosen by ``id % m = 0`` with m = 31, 37, 41, 43, 47, 53 for damage
1..6; the first match wins. All other rows are the clean row written out as text.
"""

from __future__ import annotations

MODULI = (31, 37, 41, 43, 47, 53)


def _feed(source: str, fields: dict[str, str], damage: dict[int, dict[str, str]], key="id") -> str:
    """SELECT over ``source`` giving ``request_id`` and text fields with damage applied."""
    columns = [f"CAST({key} AS BIGINT) AS request_id"]
    for name, clean in fields.items():
        cases = "".join(
            f" WHEN {k} THEN {change[name]}" for k, change in damage.items() if name in change
        )
        columns.append(f"CASE dmg{cases} ELSE {clean} END AS {name}" if cases
                       else f"{clean} AS {name}")
    picks = " ".join(f"WHEN {key} % {MODULI[k - 1]} = 0 THEN {k}" for k in damage)
    return (
        f"SELECT {', '.join(columns)} "
        f"FROM (SELECT s.*, CASE {picks} ELSE 0 END AS dmg FROM {{{source}}} AS s) AS d"
    )


def _text(column: str) -> str:
    return f"CAST({column} AS STRING)"


def _choose(id_column: str, *values: str) -> str:
    """Cycle through values by id (used for columns the base table does not have)."""
    arms = " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values[:-1]))
    return f"CASE {id_column} % {len(values)} {arms} ELSE {values[-1]} END"


TAB = "chr(9)"
DAY_TIME = "'T00:00:00Z'"

FEEDS = {
    "customer_feed": _feed(
        "customers",
        {c: c for c in ("company_name", "industry", "primary_contact_name", "primary_email",
                        "primary_phone", "billing_address", "shipping_address", "status")},
        {1: {"company_name": f"'  ' || {TAB}"}, 2: {"status": "'VIP'"}, 3: {"status": "NULL"},
         4: {"primary_email": f"'  ' || primary_email || {TAB}"},
         5: {"primary_phone": "'   '", "industry": f"{TAB}"},
         6: {"status": "' Active '", "company_name": "NULL"}},
    ),
    "opportunity_feed": _feed(
        "opportunities",
        {"customer_id": _text("customer_id"), "title": "title", "stage": "stage",
         "estimated_value": _text("estimated_value"),
         "expected_close_date": _text("expected_close_date")},
        {1: {"customer_id": "'1.5'"}, 2: {"customer_id": "'x'"},
         3: {"estimated_value": "'-1'"}, 4: {"estimated_value": "'10.239'"},
         5: {"estimated_value": "'abc'", "stage": "'Won'"},
         6: {"customer_id": "' 12.0 '", "expected_close_date": "'2024-02-30'"}},
    ),
    "quotation_feed": _feed(
        "quotations",
        {"customer_id": _text("customer_id"), "quote_number": "quote_number",
         "valid_until": _text("valid_until"), "status": "status",
         "total_amount": _text("total_amount")},
        {1: {"customer_id": "'0'"}, 2: {"quote_number": f"{TAB} || ' '"}, 3: {"status": "NULL"},
         4: {"status": "'draft'"}, 5: {"total_amount": "'1e2'"}, 6: {"total_amount": "'-0.01'"}},
    ),
    "pricing_rule_feed": _feed(
        "pricing_rules",
        {"rule_name": "rule_name", "product_id": _text("product_id"),
         "min_quantity": _text("min_quantity"),
         "discount_percentage": _text("discount_percentage"), "is_active": _text("is_active")},
        {1: {"discount_percentage": "'100.01'"}, 2: {"min_quantity": "'0'"},
         3: {"is_active": "NULL"}, 4: {"discount_percentage": "'100.00'"},
         5: {"rule_name": "''", "product_id": "'none'"}, 6: {"product_id": "'7.5'"}},
    ),
    "invoice_feed": _feed(
        "invoices",
        {"invoice_number": "'N' || invoice_number", "order_id": _text("order_id"),
         "invoice_date": _text("invoice_date"), "due_date": _text("due_date"),
         "subtotal": _text("subtotal"), "tax_amount": _text("tax_amount"), "status": "status"},
        {1: {"due_date": "'2024-02-30'"}, 2: {"subtotal": "'-5'"},
         3: {"invoice_number": f"' ' || {TAB}"}, 4: {"status": "'Settled'"},
         5: {"status": "NULL", "invoice_date": "NULL", "order_id": "'987654321'"},
         6: {"invoice_number": "invoice_number"}},
    ),
    "account_feed": _feed(
        "customers",
        {"account_code": "'CU-' || CAST(id AS STRING)", "name": "company_name",
         "type": _choose("id", "'Asset'", "'Revenue'", "'Expense'"), "is_active": "'false'"},
        {1: {"account_code": "'AC-' || CAST(id % 40 AS STRING)"}, 2: {"name": "'  '"},
         3: {"type": "NULL"}, 4: {"is_active": "NULL"}, 5: {"account_code": "'CU-SAME'"},
         6: {"account_code": "'CU-SAME'", "type": "''"}},
    ),
    "asset_feed": _feed(
        "assets",
        {"asset_tag": "'N' || asset_tag", "name": "name", "category": "category",
         "purchase_date": _text("purchase_date"), "initial_cost": _text("initial_cost"),
         "useful_life_years": "CAST(useful_life_years + 1 AS STRING)", "status": "status"},
        {1: {"category": "'tech'"}, 2: {"category": "' IT '"}, 3: {"category": "'Boat'"},
         4: {"useful_life_years": "'0'"}, 5: {"status": "' '", "initial_cost": "NULL"},
         6: {"asset_tag": "asset_tag", "status": "'Broken'"}},
    ),
    "budget_feed": _feed(
        "budgets",
        {"department": "department", "fiscal_year": "fiscal_year",
         "allocated_amount": _text("allocated_amount"), "spent_amount": _text("spent_amount")},
        {1: {"department": "NULL"}, 2: {"fiscal_year": "''"}, 3: {"allocated_amount": "''"},
         4: {"spent_amount": "'lots'"}, 5: {"allocated_amount": "'-12.345'"}},
    ),
    "tax_payment_feed": _feed(
        "tax_payments",
        {"tax_period": "tax_period", "amount_paid": _text("amount_paid"),
         "payment_date": _text("payment_date"), "reference_number": "reference_number"},
        {1: {"amount_paid": "'n/a'"}, 2: {"amount_paid": "'-3.999'"}, 3: {"tax_period": "NULL"}},
    ),
    "bill_feed": _feed(
        "bills",
        {"vendor_id": _text("vendor_id"), "total_amount": _text("total_amount"),
         "amount_paid": _text("amount_paid"), "tax_amount": _text("tax_amount"),
         "issue_date": _text("issue_date"), "due_date": _text("due_date"), "status": "status"},
        {1: {"vendor_id": "'-4'"}, 2: {"issue_date": "''"}, 3: {"due_date": "NULL"},
         4: {"status": "' '"}, 5: {"tax_amount": "'ten'"}, 6: {"total_amount": "NULL"}},
    ),
    "payroll_feed": _feed(
        "employees",
        {"pay_period": "'P' || CAST(id % 12 AS STRING) || ' '",
         "total_gross": _text("base_salary"), "total_taxes": "'10.005'", "total_net": "'0'"},
        {1: {"pay_period": "'  '"}, 2: {"total_gross": "'x'"}, 3: {"total_taxes": "NULL"},
         4: {"total_net": "'1e3'"}},
    ),
    "review_feed": _feed(
        "performance_reviews",
        {"employee_id": _text("employee_id"), "reviewer_id": _text("reviewer_id"),
         "rating": _text("rating"), "comments": "comments"},
        {1: {"rating": "'6'"}, 2: {"rating": "'4.5'"}, 3: {"employee_id": "'0'"},
         4: {"comments": "' fine '"}},
    ),
    "job_feed": _feed(
        "job_postings",
        {"title": "title", "department": "department", "employment_type": "employment_type",
         "status": "status", "posted_date": _text("posted_date")},
        {1: {"title": "' '"}, 2: {"department": "NULL"}, 3: {"employment_type": "NULL"},
         4: {"status": "''"}, 5: {"status": "'Filled'"}, 6: {"posted_date": "NULL"}},
    ),
    "applicant_feed": _feed(
        "applicants",
        {"job_posting_id": _text("job_posting_id"), "first_name": "first_name",
         "last_name": "last_name", "email": "email", "pipeline_stage": "pipeline_stage",
         "application_date": _text("application_date")},
        {1: {"job_posting_id": "'seven'"}, 2: {"first_name": "''"}, 3: {"last_name": "NULL"},
         4: {"email": "' '"}, 5: {"pipeline_stage": "NULL", "application_date": "NULL"},
         6: {"pipeline_stage": "'hired'"}},
    ),
    "training_feed": _feed(
        "training_programs",
        {"title": "title", "description": "description", "trainer_name": "trainer_name",
         "scheduled_date": _text("scheduled_date")},
        {1: {"title": "NULL"}, 2: {"description": "'  '"},
         3: {"trainer_name": f"{TAB} || 'Ann '"}},
    ),
    "vendor_feed": _feed(
        "suppliers",
        {"company_name": "company_name", "contact_name": "contact_name", "email": "email",
         "phone": "phone", "payment_terms": "payment_terms"},
        {1: {"company_name": "' '"}, 2: {"email": "''"}, 3: {"phone": "' 07 '"}},
    ),
    "category_feed": _feed(
        "products", {"name": "name", "description": "description", "colour": "'red'"},
        {1: {"name": "NULL", "description": "NULL"}, 2: {"description": "NULL"}},
    ),
    "warehouse_feed": _feed(
        "customers",
        {"name": "company_name", "location_address": "billing_address",
         "manager_id": _text("id"), "is_active": "'true'"},
        {1: {"name": "' '"}, 2: {"location_address": "NULL"}, 3: {"manager_id": "'0'"},
         4: {"is_active": "NULL", "manager_id": "NULL"}, 5: {"name": f"{TAB} || 'Depot '"}},
    ),
    "storage_bin_feed": _feed(
        "storage_bins",
        {"warehouse_id": _text("warehouse_id"), "zone": "zone", "barcode": "barcode",
         "max_weight": _text("max_weight")},
        {1: {"zone": "NULL"},
         2: {"warehouse_id": "NULL", "zone": "NULL", "barcode": "NULL", "max_weight": "NULL"}},
    ),
    "product_feed": _feed(
        "products",
        {"category_id": _text("category_id"), "sku": "'N' || sku", "name": "name",
         "description": "description", "unit_price": _text("unit_price"),
         "cost_price": _text("cost_price"), "stock_quantity": _text("stock_quantity")},
        {1: {"sku": "sku"}, 2: {"sku": "'NSKU-TWIN'"}, 3: {"unit_price": "NULL"},
         4: {c: "NULL" for c in ("category_id", "sku", "name", "description", "unit_price",
                                 "cost_price", "stock_quantity")}},
    ),
    "new_product_feed": _feed(
        "products",
        {"name": "name || ' ' || CAST(id AS STRING)", "price": _text("unit_price"),
         "stock_quantity": _text("stock_quantity")},
        {1: {"name": "'  '"}, 2: {"price": "'-1'"}, 3: {"price": "'free'"},
         4: {"stock_quantity": "NULL"}, 5: {"name": "'-- ?? --'"},
         6: {"stock_quantity": "'1.5'"}},
    ),
    "employee_feed": _feed(
        "customers",
        {"username": "'emp' || CAST(id AS STRING)",
         "password": "'secret-' || CAST(id AS STRING)",
         "email": "'e' || CAST(id AS STRING) || '@example.test'",
         "first_name": "'First' || CAST(id % 97 AS STRING)",
         "last_name": "'Last' || CAST(id % 89 AS STRING)", "hire_date": "'2024-05-01'",
         "role": _choose("id", "'Admin'", "'Accountant'", "NULL", "'Junior sales'"),
         "role_id": _choose("id", "NULL", "NULL", "'121'", "'114'"),
         "department_id": "CAST(id % 6 AS STRING)", "job_title": "industry",
         "base_salary": "'1000.50'", "is_active": _choose("id", "NULL", "'false'", "'true'")},
        {1: {"username": "'ab'", "email": "'not-an-email'"}, 2: {"password": "'short'"},
         3: {"role": "NULL", "role_id": "NULL"}, 4: {"username": "'user1'"},
         5: {"email": "'shared@example.test'"}, 6: {"hire_date": "'2024-13-01'"}},
    ),
    # Documents: headers and lines as two feeds; a header without lines is an empty document.
    "sales_order_feed": _feed(
        "sales_orders",
        {"customer_id": _text("customer_id"),
         "order_date": f"CAST(CAST(order_date AS DATE) AS STRING) || {DAY_TIME}",
         "status": "status"},
        {1: {}, 2: {"status": "NULL"}, 3: {"customer_id": "'0'"},
         4: {"order_date": "'1998-01-01'"}, 5: {"status": "'Parked'"},
         6: {"status": "' '", "order_date": "NULL"}},
    ),
    "sales_order_line_feed": """
        SELECT CASE WHEN order_id % 31 = 0 THEN NULL ELSE order_id END AS request_id,
               line_number AS line_no,
               CASE WHEN order_id % 61 = 0 AND line_number = 2 THEN '0'
                    ELSE CAST(abs(product_id) AS STRING) END AS product_id,
               CASE WHEN order_id % 59 = 0 AND line_number = 1 THEN '0'
                    ELSE CAST(quantity AS STRING) END AS quantity,
               CASE WHEN order_id % 67 = 0 THEN '-1.00'
                    WHEN order_id % 71 = 0 AND product_id = -1 THEN '0.125'
                    ELSE CAST(unit_price AS STRING) END AS unit_price
        FROM {order_lines}""",
    "purchase_order_feed": _feed(
        "purchase_orders",
        {"po_number": "'N' || po_number", "supplier_id": _text("supplier_id"),
         "expected_delivery_date": _text("expected_delivery_date")},
        {1: {"po_number": f"{TAB}"}, 2: {"supplier_id": "'0'"}, 3: {"supplier_id": "'1.5'"},
         4: {"expected_delivery_date": "''"}, 5: {}},
    ),
    "purchase_order_line_feed": """
        SELECT CASE WHEN purchase_order_id % 47 = 0 THEN NULL ELSE purchase_order_id END
                   AS request_id,
               line_number AS line_no,
               CASE WHEN purchase_order_id % 61 = 0 AND line_number = 2 THEN 'x'
                    ELSE CAST(product_id AS STRING) END AS product_id,
               CASE WHEN purchase_order_id % 59 = 0 AND line_number = 1 THEN '1.5'
                    ELSE CAST(quantity_ordered AS STRING) END AS quantity_ordered,
               CASE WHEN purchase_order_id % 67 = 0 THEN '3.456'
                    WHEN purchase_order_id % 71 = 0 THEN '-2'
                    ELSE CAST(unit_cost AS STRING) END AS unit_cost
        FROM {purchase_order_lines}""",
    "journal_feed": _feed(
        "journal_entries",
        {"description": "description", "entry_date": _text("entry_date"),
         "created_by": _text("created_by")},
        {1: {"description": "' '"}, 2: {"entry_date": "'2024-2-3'"}, 3: {"entry_date": "NULL"}},
    ),
    "journal_line_feed": """
        SELECT journal_entry_id AS request_id, account_id AS line_no,
               CAST(CASE WHEN journal_entry_id % 59 = 0 AND account_id > 20 THEN 0
                         ELSE (account_id - 1) % 25 + 1 END AS STRING) AS account_id,
               CASE WHEN journal_entry_id % 61 = 0 THEN '0'
                    WHEN journal_entry_id % 67 = 0 THEN CAST(debit + 0.01 AS STRING)
                    WHEN journal_entry_id % 71 = 0 AND account_id = 3 THEN '-1'
                    ELSE CAST(debit AS STRING) END AS debit,
               CASE WHEN journal_entry_id % 61 = 0 THEN '0' ELSE CAST(credit AS STRING) END
                   AS credit
        FROM {journal_entry_lines}""",
    "reversal_feed": """
        SELECT CAST(event_id AS BIGINT) AS request_id,
               CASE WHEN event_id % 50 = 0 THEN CAST(-5 AS BIGINT) WHEN event_id % 53 = 0 THEN NULL
                    ELSE CAST((event_id * 3) % 9000 + 1 AS BIGINT) END AS journal_entry_id,
               CAST(user_id + 1 AS BIGINT) AS created_by
        FROM {events}""",
    "payment_feed": _feed(
        "invoices",
        {"invoice_id": _text("id"), "amount_paid": _text("total_amount"),
         "payment_method": _choose("id", "'Cash'", "'M-Pesa'", "'Check'", "'Bank Transfer'"),
         "debit_account_id": "CAST(id % 25 + 1 AS STRING)",
         "credit_account_id": "CAST((id * 3) % 25 + 1 AS STRING)",
         "payment_reference": _choose("id", "NULL", "' R1 '", "''"),
         "payment_date": f"CAST(due_date AS STRING) || {DAY_TIME}"},
        {1: {"amount_paid": "'0'"}, 2: {"invoice_id": "'99999999'"},
         3: {"debit_account_id": "'4'", "credit_account_id": "'4'"},
         4: {"payment_method": "'Barter'"}, 5: {"credit_account_id": "'77'"},
         6: {"payment_date": "NULL"}},
    ),
    "receipt_feed": """
        SELECT CAST(event_id AS BIGINT) AS request_id,
               CASE WHEN event_id % 43 = 0 THEN 'p1'
                    ELSE CAST(user_id * 10 + event_id % 12 + 1 AS STRING) END AS product_id,
               CASE WHEN event_id % 31 = 0 THEN '0' WHEN event_id % 37 = 0 THEN '2.5'
                    ELSE CAST(event_id % 9 + 1 AS STRING) END AS quantity
        FROM {events}""",
    "movement_feed": _feed(
        "stock_movements",
        {"product_id": _text("product_id"), "from_bin_id": _text("from_bin_id"),
         "to_bin_id": _text("to_bin_id"), "quantity": _text("quantity"),
         "movement_type": "movement_type", "moved_by": _text("moved_by"),
         "reference_type": "reference_type", "reference_id": _text("reference_id"),
         "movement_date": f"CAST(CAST(movement_date AS DATE) AS STRING) || {DAY_TIME}"},
        {1: {"quantity": "'many'"}, 2: {"from_bin_id": "'5000000'"},
         3: {"movement_date": "NULL", "reference_type": "' '"},
         4: {"movement_date": "'yesterday'"}, 5: {"product_id": "'1e9'"}},
    ),
    "key_feed": """
        SELECT DISTINCT CAST(user_id + 1 AS BIGINT) AS id FROM {events}""",
    "access_log": """
        SELECT CAST(event_id + 1 AS BIGINT) AS id, CAST(user_id + 1 AS BIGINT) AS user_id,
               CASE event_type WHEN 'view' THEN 'bi:read' WHEN 'click' THEN 'inventory:write'
                    WHEN 'purchase' THEN 'sales:write' WHEN 'signup' THEN 'hr:write'
                    ELSE 'finance:read' END AS action
        FROM {events}""",
}


def _changes(entity: str, id_expr: str, field: str, values: tuple[str, ...]) -> None:
    """A change feed over the events: ``seq``, ``id`` and one new value per event."""
    view, click, purchase, signup, error = values
    FEEDS[f"{entity}_{field}_feed"] = f"""
        SELECT CAST(event_id AS BIGINT) AS seq,
               CASE WHEN event_id % 19 = 0 THEN CAST(900000000 + event_id AS BIGINT)
                    ELSE CAST({id_expr} AS BIGINT) END AS id,
               CASE event_type WHEN 'view' THEN {view} WHEN 'click' THEN {click}
                    WHEN 'purchase' THEN {purchase} WHEN 'signup' THEN {signup}
                    ELSE {error} END AS {field}
        FROM {{events}}"""


WIDE = "user_id * 10 + event_id % 12 + 1"
NARROW = "event_id % 30 + 1"
PER_USER = "user_id + 1"
EVERY = "event_id + 1 - event_id % 2"

_changes("opportunity", WIDE, "stage",
         ("'Qualified'", "' Proposal '", "'Lost'", "'Closed Won'", "NULL"))
_changes("quotation", WIDE, "status", ("'Sent'", "'Accepted'", "'sent'", "' Rejected'", "''"))
_changes("account", NARROW, "is_active", ("'true'", "'false'", "'yes'", "NULL", "'false'"))
_changes("asset", WIDE, "status", ("'Degraded'", "' '", "'Lost'", "'Under Repair'", "NULL"))
_changes("employee", WIDE, "is_active", ("'true'", "'false'", "'0'", "'false'", "NULL"))
_changes("leave", EVERY, "status", ("'Approved'", "'Rejected'", "'approved'", "'Pending'", "NULL"))
_changes("payroll", "199501 + event_id % 12", "status",
         ("'Completed'", "'In Progress'", "'Paid'", "'Cancelled'", "''"))
_changes("job", WIDE, "status", ("'Open'", "'Closed'", "'open'", "'On Hold '", "NULL"))
_changes("applicant", EVERY, "pipeline_stage",
         ("'Screening'", "'Offered'", "'Fired'", "' Hired'", "NULL"))
_changes("training", "user_id * 2 + event_id % 2 + 1", "status",
         ("'In Progress'", "'Completed'", "'Done'", "'Cancelled'", "NULL"))
_changes("sales_order", WIDE, "status",
         ("'Confirmed'", "'Shipped'", "'shipped'", "' Cancelled'", "NULL"))
_changes("vendor", PER_USER, "status", ("'Active'", "'On Hold'", "'Gone'", "'Terminated'", "''"))
_changes("purchase_order", WIDE, "status",
         ("'Submitted'", "'Received'", "'Lost'", "'Partially Received'", "NULL"))
_changes("shipment", WIDE, "status",
         ("'Stage 9'", "' customs '", "''", "'Delivered'", "NULL"))


def _replacements(entity: str, id_expr: str, fields: dict[str, str]) -> None:
    """A change feed that replaces several fields at once."""
    columns = ", ".join(f"{expr} AS {name}" for name, expr in fields.items())
    FEEDS[f"{entity}_replace_feed"] = f"""
        SELECT CAST(event_id AS BIGINT) AS seq,
               CASE WHEN event_id % 19 = 0 THEN CAST(900000000 + event_id AS BIGINT)
                    ELSE CAST({id_expr} AS BIGINT) END AS id, {columns}
        FROM {{events}}"""


def _by_type(view, click, purchase, signup, error) -> str:
    return (f"CASE event_type WHEN 'view' THEN {view} WHEN 'click' THEN {click} "
            f"WHEN 'purchase' THEN {purchase} WHEN 'signup' THEN {signup} ELSE {error} END")


_E = "CAST(event_id AS STRING)"
_replacements("customer", WIDE, {
    "company_name": _by_type(f"'Co ' || {_E}", f"' Co ' || {_E}", "' '", f"'C' || {_E}", "'Co'"),
    "industry": _by_type("'Farming'", "''", "NULL", "'Retail'", "'Retail'"),
    "primary_contact_name": "'Person ' || CAST(user_id AS STRING)",
    "primary_email": _by_type("'x@example.test'", "NULL", "NULL", "' y@example.test '", "''"),
    "primary_phone": "CAST(NULL AS STRING)", "billing_address": f"'Box ' || {_E}",
    "shipping_address": "' '",
    "status": _by_type("'Active'", "NULL", "'Lead'", "'Churned'", "'Unknown'"),
})
_replacements("pricing_rule", WIDE, {
    "rule_name": f"'Rule ' || {_E}", "product_id": "CAST(user_id + 1 AS STRING)",
    "min_quantity": _by_type("'5'", "'2'", "'0'", "'7'", "'9'"),
    "discount_percentage": _by_type("'12.345'", "'100'", "'1'", "'100.5'", "'0'"),
    "is_active": _by_type("'true'", "NULL", "'true'", "'true'", "'false'"),
})
_replacements("account", NARROW, {
    "account_code": f"'NC-' || {_E}", "name": _by_type("'Cash'", "' Bank '", "''", "'Till'", "'A'"),
    "type": _by_type("'Asset'", "'Asset'", "'Asset'", "NULL", "'Equity'"),
})
_replacements("asset", WIDE, {
    "asset_tag": f"'T' || {_E}", "name": "'Asset ' || CAST(user_id AS STRING)",
    "category": _by_type("'tech'", "'HVAC'", "'Boat'", "' Vehicle '", "''"),
    "purchase_date": _by_type("'2020-01-31'", "NULL", "'2020-01-31'", "'2021-02-28'", "NULL"),
    "initial_cost": _by_type("'10.239'", "''", "'5'", "'77'", "'1'"),
    "useful_life_years": "CAST(event_id % 4 AS STRING)",
    "status": _by_type("'Degraded'", "NULL", "''", "' '", "'Gone'"),
})
_replacements("budget", PER_USER, {
    "department": _by_type("'Ops'", "' IT '", "''", "'HR'", "'Legal'"),
    "fiscal_year": _by_type("'2024'", "'2025'", "'2024'", "NULL", "'2026'"),
    "allocated_amount": f"{_E} || '.555'",
    "spent_amount": _by_type("'1'", "''", "'2'", "'3'", "'x'"),
})
_replacements("review", EVERY, {
    "rating": _by_type("'5'", "'1'", "'0'", "'3.5'", "'2'"),
    "review_date": _by_type("'2024-06-01'", "'2024-06-02'", "'2024-06-03'", "'2024-06-04'", "NULL"),
    "comments": _by_type("' ok '", "''", "'c'", "NULL", "'late'"),
})
_replacements("vendor", PER_USER, {
    "company_name": _by_type("'Vend'", "' V ' ", "''", "'Sup'", "'S'"),
    "contact_name": f"'K ' || {_E}",
    "email": _by_type("'v@example.test'", "''", "''", "NULL", "'e'"),
    "phone": "' '", "payment_terms": "'Net ' || CAST(event_id % 60 AS STRING)",
})


def _patches(entity: str, id_expr: str, fields: dict[str, str], present: str) -> None:
    """A patch feed: ``present`` lists the fields the body carried, comma separated."""
    columns = ", ".join(f"{expr} AS {name}" for name, expr in fields.items())
    FEEDS[f"{entity}_patch_feed"] = f"""
        SELECT CAST(event_id AS BIGINT) AS seq,
               CASE WHEN event_id % 19 = 0 THEN CAST(900000000 + event_id AS BIGINT)
                    ELSE CAST({id_expr} AS BIGINT) END AS id,
               {present} AS present, {columns}
        FROM {{events}}"""


_patches("category", NARROW,
         {"name": f"'Cat ' || {_E}", "description": _by_type("NULL", "'d'", "'e'", "'f'", "NULL")},
         _by_type("'description'", "'name,description'", "''", "'name'", "'colour'"))
_patches("product", WIDE, {
    "category_id": "CAST(event_id % 25 + 1 AS STRING)",
    "sku": f"' NEW-' || {_E}", "name": _by_type("'n'", "' '", "'m'", "'o '", "'p'"),
    "description": _by_type("' text '", "''", "'t'", "'u'", "'v'"),
    "unit_price": _by_type("'12.5'", "'3'", "'-1'", "'4'", "'5.129'"),
    "cost_price": "CAST(event_id % 50 AS STRING)",
    "stock_quantity": _by_type("'7'", "'8'", "'9'", "'1.5'", "'0'"),
}, _by_type("'unit_price,description'", "'name'", "'unit_price,sku'", "'stock_quantity'",
            "'category_id,cost_price,stock_quantity'"))
_patches("warehouse", NARROW, {
    "name": _by_type("'Depot'", "' Yard '", "''", "'Hub'", "'Dock'"),
    "location_address": f"'Lane ' || {_E}",
    "manager_id": _by_type("'5'", "'6'", "'7'", "'0'", "'8'"),
    "is_active": _by_type("'true'", "'false'", "'true'", "'true'", "'false'"),
}, _by_type("'name,is_active'", "'name'", "'name'", "'manager_id'", "'location_address,is_active'"))
_patches("storage_bin", PER_USER, {
    "warehouse_id": "CAST(event_id % 25 + 1 AS STRING)",
    "zone": _by_type("'ZX'", "NULL", "'ZY'", "'ZZ'", "'ZW'"),
    "barcode": f"'BB-' || {_E}", "max_weight": "CAST(event_id % 90 AS STRING)",
}, _by_type("'zone'", "'zone,barcode'", "''", "'max_weight'", "'warehouse_id'"))


def _deletions(entity: str, id_expr: str) -> None:
    FEEDS[f"{entity}_delete_feed"] = f"""
        SELECT CAST(event_id AS BIGINT) AS seq,
               CASE WHEN event_type = 'error' AND event_id % 19 <> 0 THEN CAST({id_expr} AS BIGINT)
                    ELSE CAST(900000000 + event_id AS BIGINT) END AS id
        FROM {{events}}"""


_deletions("category", "event_id % 11 + 1")
_deletions("product", WIDE)
_deletions("warehouse", "event_id % 11 + 1")
_deletions("storage_bin", "user_id % 60 + 1")
_deletions("invoice", WIDE)
_deletions("bill", WIDE)
FEEDS["invoice_paid_feed"] = FEEDS.pop("invoice_delete_feed")
FEEDS["bill_paid_feed"] = FEEDS.pop("bill_delete_feed")
FEEDS["product_upsert_feed"] = f"""
    SELECT CAST(event_id AS BIGINT) AS seq, CAST({WIDE} + 1000 AS BIGINT) AS id,
           'UP-' || {_E} AS sku, 'Upserted ' || {_E} AS name,
           CAST(event_id % 500 AS DECIMAL(18,2)) AS unit_price
    FROM {{events}}"""
FEEDS["product_op_feed"] = f"""
    SELECT CAST(event_id AS BIGINT) AS seq, CAST({WIDE} AS BIGINT) AS id,
           CASE WHEN event_id % 101 = 0 THEN NULL WHEN event_id % 103 = 0 THEN 'purge'
                WHEN event_type = 'error' THEN 'delete' ELSE 'update' END AS op,
           {_by_type("'name'", "'unit_price'", "'name,unit_price'", "''", "''")} AS present,
           'Name ' || {_E} AS name, {_by_type("'1'", "'2.50'", "'-3'", "'4'", "'5'")} AS unit_price
    FROM {{events}}"""
FEEDS["role_feed"] = f"""
    SELECT CAST(event_id AS BIGINT) AS request_id,
           CASE event_id % 9 WHEN 0 THEN ' ADMIN ' WHEN 1 THEN 'Finance Controller' WHEN 2 THEN '119'
                WHEN 3 THEN 'junior sales' WHEN 4 THEN 'Pilot' WHEN 5 THEN '' WHEN 6 THEN '-3'
                WHEN 7 THEN 'HR Director' ELSE NULL END AS role
    FROM {{events}}"""
# Customer bodies as raw text: cut off, an array, no JSON, text behind the object, two objects,
# no request id, a request id that is no number, blank; all others are whole. Braces are written
# as characters, since names of inputs stand in braces here.
_ID, _OPEN, _CLOSE = "CAST(id AS STRING)", "chr(123)", "chr(125)"
_START = f"{_OPEN} || '\"request_id\": ' || {_ID}"
FEEDS["customer_body_feed"] = f"""
    SELECT CAST(id AS BIGINT) AS id,
           CASE WHEN id % 31 = 0 THEN {_START} || ', "company_name": "Cut'
                WHEN id % 37 = 0 THEN '[' || {_START} || {_CLOSE} || ']'
                WHEN id % 41 = 0 THEN 'company_name=' || {_ID}
                WHEN id % 43 = 0 THEN {_START} || {_CLOSE} || ' tail'
                WHEN id % 47 = 0 THEN {_START} || {_CLOSE} || ', ' || {_START} || {_CLOSE}
                WHEN id % 53 = 0 THEN {_OPEN} || '"company_name": "No id ' || {_ID} || '"' || {_CLOSE}
                WHEN id % 59 = 0 THEN {_OPEN} || '"request_id": "x' || {_ID} || '"' || {_CLOSE}
                WHEN id % 61 = 0 THEN '  '
                ELSE {_START} || ', "company_name": "' || company_name || '", "status": "' || status
                     || '", "more": ' || {_OPEN} || '"deep": [1, 2]' || {_CLOSE} || {_CLOSE} END AS body
    FROM {{customers}}"""
# Stored roles: those of the catalogue with old permissions, and some of the house.
FEEDS["stored_roles"] = """
    SELECT CAST(id AS BIGINT) AS id, name,
           split(CASE WHEN id % 2 = 0 THEN 'old:read' ELSE 'own:read,own:write' END, ',') AS permissions,
           CAST(DATE '1997-01-01' AS {ntz}) AS updated_at
    FROM (SELECT n_nationkey + 105 AS id, 'Role ' || n_name AS name FROM {nation}) AS s"""
