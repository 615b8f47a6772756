"""Expected outcome of the intake jobs, as SQL."""

from __future__ import annotations

from sqltwins.inputs import (
    boolean, cents, iso_date, iso_moment, members, money, money0, number, number0, one_of,
    statement, text, trim, whole,
)

DAY = "DATE '1998-06-30'"
MOMENT = "TIMESTAMP '1998-06-30 00:00:00'"
FINANCE_KEY = "Invalid foreign key reference in finance request"
FINANCE_TWIN = "A unique finance record already exists with these values"
BAD_MONEY = "Invalid monetary amount"

CUSTOMER = ["Lead", "Active", "Inactive", "Churned"]
STAGE = ["Lead", "Qualified", "Proposal", "Negotiation", "Closed Won", "Closed Lost"]
QUOTE = ["Draft", "Sent", "Accepted", "Expired", "Rejected"]
CATEGORY = ["Vehicle", "Machinery", "IT Equipment", "HVAC", "Facility"]
ASSET = ["Operational", "Degraded", "Under Repair", "Decommissioned"]
INVOICE = ["Draft", "Unpaid", "Partial", "Paid", "Overdue", "Cancelled"]
JOB = ["Draft", "Open", "Closed", "On Hold"]
APPLICANT = ["Applied", "Screening", "Interviewing", "Offered", "Hired", "Rejected"]
MOVEMENT = ["Receiving", "Putaway", "Transfer", "Picking", "Shipping", "Adjustment"]
ROLES = ["Admin", "Accountant", "Auditor", "Sales executive", "Human Resource",
         "Inventory Manager", "Logistics manager", "Warehouse manager", "Junior sales"]


def quoted(message: str) -> str:
    return "'" + message.replace("'", "''") + "'"


def reasons(rules: list[tuple[str, str]]) -> str:
    if not rules:
        return "CAST(NULL AS VARCHAR)"
    arms = " ".join(f"WHEN {bad} THEN {quoted(message)}" for bad, message in rules)
    return f"CASE {arms} END"


def intake(feed, columns, rules, refs=(), unique=None, keep=("request_id",)) -> str:
    """``columns``: name -> cleaned value; ``rules``: (bad, message) in order; ``refs``:
    (column, table, message); ``unique``: (columns, table, message)."""
    typed = ", ".join(f"{value} AS {name}" for name, value in columns.items())
    steps = {
        "checked": f"SELECT {', '.join('f.' + k for k in keep)}, {typed}, "
                   f"{reasons(rules)} AS r0 FROM {feed} f",
    }
    missing = reasons([
        (f"c.{col} IS NOT NULL AND c.{col} NOT IN (SELECT id FROM {table})", message)
        for col, table, message in refs
    ])
    steps["referred"] = f"SELECT c.*, {missing} AS r1 FROM checked c"
    joins, late = "", "false"
    if unique:
        keys, table, message = unique
        taken = " OR ".join(f"coalesce(r.{k} IN (SELECT {k} FROM {table}), false)" for k in keys)
        steps["stored"] = f"SELECT r.*, ({taken}) AS taken FROM referred r"
        source = "stored"
        open_rows = "SELECT * FROM stored WHERE r0 IS NULL AND r1 IS NULL AND NOT taken"
        late = "taken"
        for i, k in enumerate(keys):
            # Later keys only see rows that hold the earlier ones; the feed has no longer
            # chains (the general case is tested against brute force).
            steps[f"open_{i}"] = open_rows
            steps[f"held_{i}"] = (f"SELECT {k} AS held_key, min(request_id) AS holder "
                                  f"FROM open_{i} GROUP BY {k}")
            open_rows = (f"SELECT o.* FROM open_{i} o JOIN held_{i} h ON o.{k} = h.held_key "
                         "AND o.request_id = h.holder")
            joins += f" LEFT JOIN held_{i} ON s.{k} = held_{i}.held_key"
            late += f" OR coalesce(held_{i}.holder < s.request_id, false)"
        reason = f"coalesce(r0, CASE WHEN {late} THEN {quoted(message)} END, r1)"
    else:
        source, reason = "referred", "coalesce(r0, r1)"
    steps["judged"] = f"SELECT s.*, {reason} AS reject_reason FROM {source} s{joins}"
    shown = ", ".join(
        f"CASE WHEN reject_reason IS NULL THEN {name} END AS {name}"
        for name in columns if not name.startswith("_")
    )
    return statement(f"SELECT {', '.join(keep)}, {shown}, reject_reason FROM judged", steps)


def default(column: str, value: str) -> str:
    return f"coalesce(nullif({column}, ''), '{value}')"


def required(column: str, message: str | None = None) -> tuple[str, str]:
    return f"{text('f.' + column)} IS NULL", message or f"{column} is required"


def not_in(value: str, column: str, values: list[str]) -> tuple[str, str]:
    return f"coalesce({value}, '') NOT IN {members(values)}", one_of(column, values)


def not_positive(column: str, message: str) -> tuple[str, str]:
    return f"({whole('f.' + column)}) IS NULL OR ({whole('f.' + column)}) < 1", message


def bad_if_given(column: str, message: str) -> tuple[str, str]:
    w = whole("f." + column)
    return f"f.{column} IS NOT NULL AND (({w}) IS NULL OR ({w}) < 1)", message


def bad_amount(column: str, message: str) -> tuple[str, str]:
    return f"{money('f.' + column)} IS NULL OR {number('f.' + column)} < 0", message


def day(column: str) -> str:
    return iso_date(f"nullif(f.{column}, '')")


def bad_day(column: str) -> tuple[str, str]:
    return (f"nullif(f.{column}, '') IS NOT NULL AND ({day(column)}) IS NULL",
            f"{column} must be a valid date")


def no_day(column: str) -> tuple[str, str]:
    return f"nullif(f.{column}, '') IS NULL", f"{column} is required"


def day_or_today(column: str) -> str:
    return f"CASE WHEN nullif(f.{column}, '') IS NULL THEN {DAY} ELSE {day(column)} END"


def bad_flag(column: str) -> tuple[str, str]:
    return (f"f.{column} IS NOT NULL AND f.{column} NOT IN ('true', 'false')",
            f"{column} must be true or false")


def flag(column: str, fallback: str) -> str:
    return f"CASE WHEN f.{column} IS NULL THEN {fallback} ELSE {boolean('f.' + column)} END"


def texts(*names: str) -> dict[str, str]:
    return {name: text("f." + name) for name in names}


_alias = """CASE lower({t}) WHEN 'tech' THEN 'IT Equipment' WHEN 'technology' THEN 'IT Equipment'
    WHEN 'it' THEN 'IT Equipment' WHEN 'it equipment' THEN 'IT Equipment'
    WHEN 'information technology' THEN 'IT Equipment' ELSE {t} END"""
ASSET_CATEGORY = _alias.format(t=text("f.category"))
ASSET_STATUS = f"coalesce({text('f.status')}, 'Operational')"

CUSTOMER_COLUMNS = {
    **texts("company_name", "industry", "primary_contact_name", "primary_email", "primary_phone",
            "billing_address", "shipping_address"),
    "status": trim(default("f.status", "Lead")),
}
CUSTOMER_RULES = [required("company_name"),
                  not_in(trim(default("f.status", "Lead")), "status", CUSTOMER)]

PRICING_COLUMNS = {
    "rule_name": text("f.rule_name"), "product_id": whole("f.product_id"),
    "min_quantity": whole("f.min_quantity"),
    "discount_percentage": money("f.discount_percentage"),
}
PRICING_RULES = [
    required("rule_name"),
    not_positive("product_id", "product_id must be a positive integer"),
    not_positive("min_quantity", "min_quantity must be a positive integer"),
    bad_amount("discount_percentage", "discount_percentage must be a valid amount"),
    (f"{money('f.discount_percentage')} > 100",
     "discount_percentage must be between 0 and 100"),
    bad_flag("is_active"),
]

ASSET_COLUMNS = {
    "category": ASSET_CATEGORY, "initial_cost": money0("f.initial_cost"), "status": ASSET_STATUS,
    "asset_tag": text("f.asset_tag"), "name": text("f.name"),
    "purchase_date": day("purchase_date"), "useful_life_years": whole("f.useful_life_years"),
}
ASSET_RULES = [
    required("category"),
    not_in(ASSET_CATEGORY, "category", CATEGORY),
    (f"{money0('f.initial_cost')} IS NULL", BAD_MONEY),
    not_in(ASSET_STATUS, "status", ASSET),
    required("asset_tag"), required("name"), no_day("purchase_date"),
    not_positive("useful_life_years", "useful_life_years must be a positive integer"),
    bad_day("purchase_date"),
]

BUDGET_COLUMNS = {
    "allocated_amount": money0("f.allocated_amount"), "spent_amount": money0("f.spent_amount"),
    **texts("department", "fiscal_year"),
}
BUDGET_RULES = [
    (f"{money0('f.allocated_amount')} IS NULL", BAD_MONEY),
    (f"{money0('f.spent_amount')} IS NULL", BAD_MONEY),
    required("department"), required("fiscal_year"),
]

VENDOR_COLUMNS = texts("company_name", "contact_name", "email", "phone", "payment_terms")
VENDOR_RULES = [required("company_name")]
ACCOUNT_COLUMNS = texts("account_code", "name", "type")
ACCOUNT_RULES = [required("account_code"), required("name"), required("type")]


def number_or_bad(column: str, kind: str) -> tuple[str, tuple[str, str]]:
    value = whole("f." + column) if kind == "BIGINT" else cents(number("f." + column))
    return value, (f"f.{column} IS NOT NULL AND ({value}) IS NULL", f"{column} must be a number")


_EMAIL_OK = (
    f"regexp_full_match(lower({trim('f.email')}), "
    "'[a-z0-9_''+\\-.]*[a-z0-9_+\\-]@([a-z0-9][a-z0-9\\-]*\\.)+[a-z]{2,}') "
    f"AND NOT starts_with({trim('f.email')}, '.') AND NOT contains({trim('f.email')}, '..')"
)
_PREFERRED = "(SELECT p.id FROM preferred p WHERE p.name = f.role)"
_SKU = (
    "coalesce(nullif(substr(trim(regexp_replace(upper({n}), '[^A-Z0-9]+', '-', 'g'), '-'), 1, 12), "
    "''), 'PRD') || '-' || lpad(CAST(abs(f.request_id) AS VARCHAR), 9, '0')"
).format(n=text("f.name"))

_product = {c: number_or_bad(c, "BIGINT") for c in ("category_id", "stock_quantity")}
_product.update({c: number_or_bad(c, "MONEY") for c in ("unit_price", "cost_price")})
_bin = {"warehouse_id": number_or_bad("warehouse_id", "BIGINT"),
        "max_weight": number_or_bad("max_weight", "MONEY")}
_WHEN = f"CASE WHEN f.movement_date IS NULL THEN {MOMENT} ELSE {iso_moment('f.movement_date')} END"
MOVEMENT_COLUMNS = {
    **{c: whole("f." + c) for c in ("product_id", "from_bin_id", "to_bin_id", "quantity",
                                    "moved_by", "reference_id")},
    "movement_type": "f.movement_type", "reference_type": text("f.reference_type"),
    "movement_date": _WHEN,
}
MOVEMENT_RULES = [
    not_positive("product_id", "product_id is required"),
    bad_if_given("from_bin_id", "from_bin_id must be a positive integer"),
    bad_if_given("to_bin_id", "to_bin_id must be a positive integer"),
    not_positive("quantity", "quantity must be greater than 0"),
    (f"coalesce(f.movement_type, '') NOT IN {members(MOVEMENT)}",
     "movement_type must be a supported warehouse movement"),
    bad_if_given("moved_by", "moved_by must be a positive integer"),
    bad_if_given("reference_id", "reference_id must be a positive integer"),
    (f"f.movement_date IS NOT NULL AND ({iso_moment('f.movement_date')}) IS NULL",
     "movement_date must be a valid datetime"),
    ("f.from_bin_id IS NULL AND f.to_bin_id IS NULL",
     "At least one of from_bin_id or to_bin_id is required"),
]
_WMS = "Invalid product, bin, or employee reference"

def viewed(name: str, table: str, key: str, column: str, alias: str, kind: str) -> str:
    """Accepted rows shown with a name from another table."""
    return (
        f"SELECT x.* EXCLUDE (reject_reason), r.{column} AS {alias} FROM ({ORACLES[name]}) x "
        f"{kind} JOIN ({statement(f'SELECT * FROM {table}')}) r ON r.id = x.{key} "
        "WHERE x.reject_reason IS NULL"
    )


ORACLES = {
    "intake_customers": intake("customer_feed", CUSTOMER_COLUMNS, CUSTOMER_RULES),
    "intake_opportunities": intake(
        "opportunity_feed",
        {"customer_id": whole("f.customer_id"), "title": text("f.title"), "stage": trim("f.stage"),
         "estimated_value": money("f.estimated_value"),
         "expected_close_date": day("expected_close_date")},
        [not_positive("customer_id", "customer_id must be a positive integer"), required("title"),
         not_in(trim("f.stage"), "stage", STAGE),
         bad_amount("estimated_value", "estimated_value must be a valid amount"),
         bad_day("expected_close_date")],
    ),
    "intake_quotations": intake(
        "quotation_feed",
        {"customer_id": whole("f.customer_id"), "quote_number": text("f.quote_number"),
         "valid_until": day("valid_until"), "status": trim(default("f.status", "Draft")),
         "total_amount": money("f.total_amount")},
        [not_positive("customer_id", "customer_id must be a positive integer"),
         required("quote_number"),
         not_in(trim(default("f.status", "Draft")), "status", QUOTE),
         bad_amount("total_amount", "total_amount must be a valid amount"),
         bad_day("valid_until")],
    ),
    "intake_pricing_rules": intake(
        "pricing_rule_feed", {**PRICING_COLUMNS, "is_active": flag("is_active", "true")},
        PRICING_RULES,
    ),
    "intake_invoices": intake(
        "invoice_feed",
        {"invoice_number": text("f.invoice_number"), "order_id": whole("f.order_id"),
         "invoice_date": day_or_today("invoice_date"), "due_date": day("due_date"),
         "subtotal": money0("f.subtotal"), "tax_amount": money0("f.tax_amount"),
         "status": "coalesce(f.status, 'Unpaid')"},
        [required("invoice_number"),
         bad_if_given("order_id", "order_id must be a positive integer"),
         bad_day("invoice_date"),
         (f"({day('due_date')}) IS NULL", "due_date must be a valid date"),
         (f"{money0('f.subtotal')} IS NULL OR {number0('f.subtotal')} < 0",
          "subtotal must be 0 or greater"),
         (f"{money0('f.tax_amount')} IS NULL OR {number0('f.tax_amount')} < 0",
          "tax_amount must be 0 or greater"),
         not_in("coalesce(f.status, 'Unpaid')", "status", INVOICE)],
        refs=[("order_id", "sales_orders", FINANCE_KEY)],
        unique=(["invoice_number"], "invoices", FINANCE_TWIN),
    ),
    "intake_accounts": intake(
        "account_feed", {**ACCOUNT_COLUMNS, "is_active": flag("is_active", "true")},
        [*ACCOUNT_RULES, bad_flag("is_active")],
        unique=(["account_code"], "accounts", FINANCE_TWIN),
    ),
    "intake_assets": intake(
        "asset_feed", ASSET_COLUMNS, ASSET_RULES, unique=(["asset_tag"], "assets", FINANCE_TWIN)
    ),
    "intake_budgets": intake("budget_feed", BUDGET_COLUMNS, BUDGET_RULES),
    "intake_tax_payments": intake(
        "tax_payment_feed",
        {"amount_paid": money("f.amount_paid"), "tax_period": "f.tax_period",
         "payment_date": day("payment_date"), "reference_number": "f.reference_number"},
        [(f"{money('f.amount_paid')} IS NULL", BAD_MONEY), bad_day("payment_date")],
    ),
    "intake_bills": intake(
        "bill_feed",
        {**{c: money0("f." + c) for c in ("total_amount", "amount_paid", "tax_amount")},
         "vendor_id": whole("f.vendor_id"), "issue_date": day("issue_date"),
         "due_date": day("due_date"), "status": f"coalesce({text('f.status')}, 'Draft')"},
        [*[(f"{money0('f.' + c)} IS NULL", BAD_MONEY)
           for c in ("total_amount", "amount_paid", "tax_amount")],
         not_positive("vendor_id", "vendor_id must be a valid vendor id"),
         no_day("issue_date"), no_day("due_date"), bad_day("issue_date"), bad_day("due_date")],
        refs=[("vendor_id", "vendors", FINANCE_KEY)],
    ),
    "intake_payroll_runs": intake(
        "payroll_feed",
        {"pay_period": text("f.pay_period"),
         **{c: money("f." + c) for c in ("total_gross", "total_taxes", "total_net")},
         "run_date": DAY, "status": "'Draft'"},
        [required("pay_period"),
         *[(f"{money('f.' + c)} IS NULL", f"Invalid {c} amount")
           for c in ("total_gross", "total_taxes", "total_net")]],
    ),
    "intake_performance_reviews": intake(
        "review_feed",
        {"employee_id": whole("f.employee_id"), "reviewer_id": whole("f.reviewer_id"),
         "rating": whole("f.rating"), "comments": text("f.comments"), "review_date": DAY},
        [not_positive("employee_id", "employee_id must be a valid user id"),
         not_positive("reviewer_id", "reviewer_id is required"),
         (f"coalesce({whole('f.rating')}, 0) NOT BETWEEN 1 AND 5",
          "rating must be an integer between 1 and 5")],
    ),
    "intake_job_postings": intake(
        "job_feed",
        {**texts("title", "department"),
         "employment_type": text(default("f.employment_type", "Full-Time")),
         "status": trim(default("f.status", "Open")), "posted_date": day_or_today("posted_date")},
        [required("title"), required("department"),
         (f"{text(default('f.employment_type', 'Full-Time'))} IS NULL",
          "employment_type is required"),
         not_in(trim(default("f.status", "Open")), "status", JOB), bad_day("posted_date")],
    ),
    "intake_applicants": intake(
        "applicant_feed",
        {"job_posting_id": whole("f.job_posting_id"), **texts("first_name", "last_name", "email"),
         "pipeline_stage": trim(default("f.pipeline_stage", "Applied")),
         "application_date": day_or_today("application_date")},
        [not_positive("job_posting_id", "job_posting_id must be a valid positive integer"),
         required("first_name"), required("last_name"), required("email"),
         not_in(trim(default("f.pipeline_stage", "Applied")), "pipeline_stage", APPLICANT),
         bad_day("application_date")],
    ),
    "intake_training_programs": intake(
        "training_feed",
        {"title": f"coalesce({trim('f.title')}, '')", **texts("description", "trainer_name"),
         "scheduled_date": day("scheduled_date")},
        [bad_day("scheduled_date")],
    ),
    "intake_vendors": intake("vendor_feed", {**VENDOR_COLUMNS, "status": "'Active'"}, VENDOR_RULES),
    "intake_categories": intake(
        "category_feed", {"name": "f.name", "description": "f.description"},
        [("coalesce(f.name, f.description) IS NULL", "No valid fields provided for categories.")],
    ),
    "intake_warehouses": intake(
        "warehouse_feed",
        {**texts("name", "location_address"), "manager_id": whole("f.manager_id"),
         "is_active": boolean("f.is_active")},
        [required("name"), required("location_address"),
         bad_if_given("manager_id", "manager_id must be a positive integer"),
         bad_flag("is_active")],
    ),
    "intake_storage_bins": intake(
        "storage_bin_feed",
        {"warehouse_id": _bin["warehouse_id"][0], "zone": "f.zone", "barcode": "f.barcode",
         "max_weight": _bin["max_weight"][0]},
        [("coalesce(f.warehouse_id, f.zone, f.barcode, f.max_weight) IS NULL",
          "No valid fields provided for storage_bins."),
         _bin["warehouse_id"][1], _bin["max_weight"][1]],
    ),
    "intake_products": intake(
        "product_feed",
        {**{c: v[0] for c, v in _product.items()}, "sku": "f.sku", "name": "f.name",
         "description": "f.description"},
        [("coalesce(f.category_id, f.sku, f.name, f.description, f.unit_price, f.cost_price, "
          "f.stock_quantity) IS NULL", "No valid fields provided for products."),
         *[_product[c][1] for c in ("category_id", "unit_price", "cost_price", "stock_quantity")]],
        unique=(["sku"], "products", "A record already exists with these values"),
    ),
    "intake_new_products": intake(
        "new_product_feed",
        {"name": text("f.name"), "unit_price": money("f.price"), "cost_price": money("f.price"),
         "stock_quantity":
             f"CASE WHEN f.stock_quantity IS NULL THEN 0 ELSE {whole('f.stock_quantity')} END",
         "sku": _SKU},
        [required("name"), bad_amount("price", "price must be 0 or greater"),
         (f"f.stock_quantity IS NOT NULL AND coalesce({whole('f.stock_quantity')}, -1) < 0",
          "stock_quantity must be 0 or greater")],
    ),
    "intake_employees": intake(
        "employee_feed",
        {"username": text("f.username"), "email": trim("f.email"),
         **texts("first_name", "last_name"), "hire_date": day("hire_date"),
         "role_id": f"""CASE WHEN f.role IS NOT NULL THEN
             CASE f.role WHEN 'Admin' THEN 113 WHEN 'Accountant' THEN 122 WHEN 'Auditor' THEN 123
               WHEN 'Sales executive' THEN 115 WHEN 'Human Resource' THEN 120
               WHEN 'Inventory Manager' THEN 124 WHEN 'Logistics manager' THEN 119
               WHEN 'Warehouse manager' THEN 118 WHEN 'Junior sales' THEN 116 END
             ELSE {whole('f.role_id')} END""",
         "department_id": whole("f.department_id"), "job_title": text("f.job_title"),
         "base_salary": f"nullif({money('f.base_salary')}, 0)",
         "is_active": flag("is_active", "true")},
        [(f"length(coalesce({text('f.username')}, '')) < 3", "username is required"),
         ("length(coalesce(f.password, '')) < 8", "password must be at least 8 characters"),
         (f"NOT coalesce({_EMAIL_OK}, false)", "email must be valid"),
         required("first_name"), required("last_name"),
         (f"({day('hire_date')}) IS NULL", "hire_date must be a valid date"),
         (f"f.role IS NOT NULL AND f.role NOT IN {members(ROLES)}", one_of("role", ROLES)),
         bad_if_given("role_id", "role_id must be a positive integer"),
         bad_if_given("department_id", "department_id must be a positive integer"),
         ("f.base_salary IS NOT NULL AND coalesce("
          f"{number('f.base_salary')}, -1) < 0", "base_salary must be 0 or greater"),
         bad_flag("is_active"),
         ("f.role IS NULL AND f.role_id IS NULL", "role is required")],
        refs=[("role_id", "roles", "Invalid role or department reference"),
              ("department_id", "departments", "Invalid role or department reference")],
        unique=(["username", "email"], "users", "Username or email already exists"),
    ),
    "intake_movements": intake(
        "movement_feed", MOVEMENT_COLUMNS, MOVEMENT_RULES,
        refs=[("product_id", "products", _WMS), ("from_bin_id", "storage_bins", _WMS),
              ("to_bin_id", "storage_bins", _WMS), ("moved_by", "employees", _WMS)],
    ),
}
ORACLES["new_quotations"] = viewed(
    "intake_quotations", "customers", "customer_id", "company_name", "customer_name", "LEFT")
ORACLES["new_applicants"] = viewed(
    "intake_applicants", "job_postings", "job_posting_id", "title", "job_title", "INNER")
