"""Expected outcome of the keyed changes, as SQL."""

from __future__ import annotations

from sqltwins import intake as i
from sqltwins.inputs import boolean, money, number, statement, text, trim, whole
from tallyloom.sources.schemas import BUSINESS

STAMP = {"updated_at": i.MOMENT}


def columns_of(table: str) -> list[str]:
    depth, names, word = 0, [], ""
    for char in BUSINESS[table] + ",":
        depth += {"(": 1, ")": -1}.get(char, 0)
        if char == "," and depth == 0:
            names.append(word.split()[0])
            word = ""
        else:
            word += char
    return names


def types_of(table: str) -> dict[str, str]:
    depth, kinds, word = 0, {}, ""
    for char in BUSINESS[table] + ",":
        depth += {"(": 1, ")": -1}.get(char, 0)
        if char == "," and depth == 0:
            name, kind = word.split(None, 1)
            kinds[name] = kind.replace("TIMESTAMP_NTZ", "TIMESTAMP")
            word = ""
        else:
            word += char
    return kinds


def _rejected(base: str, not_found: str) -> str:
    return (f"SELECT seq, id, reject_reason FROM (SELECT c.seq, c.id, coalesce(r0, CASE WHEN c.id "
            f"NOT IN (SELECT id FROM {base}) THEN {i.quoted(not_found)} END) AS reject_reason "
            "FROM checked c) x WHERE reject_reason IS NOT NULL")


def replace(base, feed, columns, rules, not_found, stamp=None, view="SELECT * FROM changed"):
    """changed / rejected / table statements for a whole-field replacement."""
    typed = ", ".join(f"{v} AS {n}" for n, v in columns.items())
    kinds = types_of(base)
    steps = {
        "checked": f"SELECT f.seq, f.id, {typed}, {i.reasons(rules)} AS r0 FROM {feed} f",
        "last": "SELECT * FROM (SELECT c.*, row_number() OVER (PARTITION BY id ORDER BY seq DESC)"
                " AS rn FROM checked c WHERE r0 IS NULL) x WHERE rn = 1",
    }
    new = {**{c: f"CAST(l.{c} AS {kinds[c]})" for c in columns}, **(stamp or {})}
    shown = ", ".join(f"{new[c]} AS {c}" if c in new else f"b.{c}" for c in columns_of(base))
    kept = ", ".join(
        f"CASE WHEN l.id IS NULL THEN b.{c} ELSE {new[c]} END AS {c}" if c in new else f"b.{c}"
        for c in columns_of(base)
    )
    steps["changed"] = f"SELECT {shown} FROM {base} b JOIN last l ON l.id = b.id"
    return {
        "changed": statement(view, steps),
        "rejected": statement(_rejected(base, not_found), steps),
        "table": statement(f"SELECT {kept} FROM {base} b LEFT JOIN last l ON l.id = b.id", steps),
    }


def patch(base, feed, columns, rules, not_found, empty):
    """``rules``: column -> (bad, message); a rule counts only where the field was given."""
    kinds = types_of(base)
    has = {c: f"list_contains(string_split(f.present, ','), '{c}')" for c in columns}
    checks = [(f"NOT ({' OR '.join(has.values())})", empty)]
    checks += [(f"{has[c]} AND ({bad})", message) for c, bad, message in rules]
    typed = ", ".join(f"{v} AS {n}, {has[n]} AS has_{n}" for n, v in columns.items())
    steps = {"checked": f"SELECT f.seq, f.id, {typed}, {i.reasons(checks)} AS r0 FROM {feed} f"}
    for c in columns:
        steps[f"last_{c}"] = (
            f"SELECT id, {c} AS value FROM (SELECT id, {c}, row_number() OVER (PARTITION BY id "
            f"ORDER BY seq DESC) AS rn FROM checked WHERE r0 IS NULL AND has_{c}) x WHERE rn = 1"
        )
    joins = " ".join(f"LEFT JOIN last_{c} ON last_{c}.id = b.id" for c in columns)
    kept = ", ".join(
        f"CASE WHEN last_{c}.id IS NULL THEN b.{c} ELSE CAST(last_{c}.value AS {kinds[c]}) END AS {c}"
        if c in columns else f"b.{c}" for c in columns_of(base)
    )
    steps["patched"] = f"SELECT {kept} FROM {base} b {joins}"
    return {
        "changed": statement(
            "SELECT * FROM patched WHERE id IN (SELECT id FROM checked WHERE r0 IS NULL)", steps),
        "rejected": statement(_rejected(base, not_found), steps),
        "table": statement("SELECT * FROM patched", steps),
    }


def delete(base, feed, not_found):
    late = (f"SELECT f.seq, f.id, {i.quoted(not_found)} AS reject_reason FROM {feed} f "
            f"WHERE f.id NOT IN (SELECT id FROM {base}) OR EXISTS "
            f"(SELECT 1 FROM {feed} g WHERE g.id = f.id AND g.seq < f.seq)")
    return {
        "changed": statement(f"SELECT * FROM {base} WHERE id IN (SELECT id FROM {feed})"),
        "table": statement(f"SELECT * FROM {base} WHERE id NOT IN (SELECT id FROM {feed})"),
        "rejected": statement(late),
    }


def paid(base, feed, not_found, stamp):
    new = {"status": "'Paid'", "amount_paid": "b.total_amount", **stamp}
    shown = ", ".join(f"{new[c]} AS {c}" if c in new else f"b.{c}" for c in columns_of(base))
    return {
        "changed": statement(
            f"SELECT {shown} FROM {base} b WHERE b.id IN (SELECT id FROM {feed})"),
        "rejected": statement(
            f"SELECT seq, id, {i.quoted(not_found)} AS reject_reason FROM {feed} "
            f"WHERE id NOT IN (SELECT id FROM {base})"),
    }


def enum(column: str, values: list[str]):
    return {column: trim("f." + column)}, [i.not_in(trim("f." + column), column, values)]


def active(message: str):
    return ({"is_active": boolean("f.is_active")},
            [("coalesce(f.is_active, '') NOT IN ('true', 'false')", message)])


CUSTOMER_VIEW = """SELECT x.*, c.company_name AS customer_name FROM changed x
    LEFT JOIN customers c ON c.id = x.customer_id"""
REVIEW_VIEW = """SELECT r.*, e.first_name, e.last_name, w.first_name AS reviewer_first_name,
    w.last_name AS reviewer_last_name FROM changed r JOIN users e ON r.employee_id = e.id
    LEFT JOIN users w ON r.reviewer_id = w.id"""

STATUS = {
    "opportunity": replace("opportunities", "opportunity_stage_feed", *enum("stage", i.STAGE),
                           "Opportunity not found", view=CUSTOMER_VIEW),
    "quotation": replace("quotations", "quotation_status_feed", *enum("status", i.QUOTE),
                         "Quotation not found", view=CUSTOMER_VIEW),
    "account": replace("accounts", "account_is_active_feed",
                       *active("is_active must be a boolean value"), "Account not found"),
    "asset": replace("assets", "asset_status_feed", {"status": i.ASSET_STATUS},
                     [i.not_in(i.ASSET_STATUS, "status", i.ASSET)], "Asset not found", STAMP),
    "leave": replace("leave_requests", "leave_status_feed",
                     *enum("status", ["Pending", "Approved", "Rejected"]),
                     "Leave request not found",
                     view="""SELECT l.*, u.first_name, u.last_name FROM changed l
                         JOIN users u ON l.employee_id = u.id"""),
    "payroll": replace("payroll_runs", "payroll_status_feed",
                       *enum("status", ["Draft", "In Progress", "Completed", "Cancelled"]),
                       "Payroll run not found"),
    "job": replace("job_postings", "job_status_feed", *enum("status", i.JOB),
                   "Job posting not found"),
    "applicant": replace("applicants", "applicant_pipeline_stage_feed",
                         *enum("pipeline_stage", i.APPLICANT), "Applicant not found",
                         view="""SELECT a.*, j.title AS job_title FROM changed a
                             JOIN job_postings j ON a.job_posting_id = j.id"""),
    "training": replace("training_programs", "training_status_feed",
                        *enum("status", ["Scheduled", "In Progress", "Completed", "Cancelled"]),
                        "Training program not found"),
    "sales_order": replace("sales_orders", "sales_order_status_feed",
                           *enum("status", ["Draft", "Confirmed", "Shipped", "Cancelled"]),
                           "Sales order not found", STAMP),
    "vendor": replace("suppliers", "vendor_status_feed",
                      *enum("status", ["Active", "On Hold", "Terminated"]),
                      "Vendor not found", STAMP),
    "purchase_order": replace(
        "purchase_orders", "purchase_order_status_feed",
        *enum("status", ["Draft", "Submitted", "Partially Received", "Received", "Cancelled"]),
        "Purchase order not found", STAMP,
        view="""SELECT po.*, s.company_name AS supplier_name FROM changed po
            LEFT JOIN suppliers s ON s.id = po.supplier_id"""),
    "shipment": replace("shipments", "shipment_status_feed", {"status": text("f.status")},
                        [i.required("status")], "Shipment not found", STAMP),
}

REPLACE = {
    "customer": replace("customers", "customer_replace_feed", i.CUSTOMER_COLUMNS,
                        i.CUSTOMER_RULES, "Customer not found", STAMP),
    "pricing_rule": replace(
        "pricing_rules", "pricing_rule_replace_feed",
        {**i.PRICING_COLUMNS, "is_active": i.flag("is_active", "false")}, i.PRICING_RULES,
        "Pricing rule not found",
        view="""SELECT r.*, p.name AS product_name FROM changed r
            LEFT JOIN products p ON r.product_id = p.id"""),
    "account": replace("accounts", "account_replace_feed", i.ACCOUNT_COLUMNS, i.ACCOUNT_RULES,
                       "Account not found", STAMP),
    "asset": replace("assets", "asset_replace_feed", i.ASSET_COLUMNS, i.ASSET_RULES,
                     "Asset not found", STAMP),
    "budget": replace("budgets", "budget_replace_feed", i.BUDGET_COLUMNS, i.BUDGET_RULES,
                      "Budget not found"),
    "review": replace(
        "performance_reviews", "review_replace_feed",
        {"rating": whole("f.rating"), "review_date": i.day("review_date"),
         "comments": text("f.comments")},
        [(f"coalesce({whole('f.rating')}, 0) NOT BETWEEN 1 AND 5",
          "rating must be an integer between 1 and 5"),
         i.no_day("review_date"), i.bad_day("review_date")],
        "Performance review not found", view=REVIEW_VIEW),
    "vendor": replace("suppliers", "vendor_replace_feed", i.VENDOR_COLUMNS, i.VENDOR_RULES,
                      "Vendor not found", STAMP),
}


def _blank(column):
    return column, f"{text('f.' + column)} IS NULL", f"{column} is required"


def _negative(column):
    return (column, f"{money('f.' + column)} IS NULL OR {number('f.' + column)} < 0",
            f"{column} must be 0 or greater")


def _not_positive(column):
    return (column, f"coalesce({whole('f.' + column)}, 0) < 1",
            f"{column} must be a positive integer")


PATCH = {
    "category": patch("categories", "category_patch_feed",
                      {"name": "f.name", "description": "f.description"}, [],
                      "Category not found", "No valid fields provided for categories update."),
    "product": patch(
        "products", "product_patch_feed",
        {"sku": text("f.sku"), "name": text("f.name"), "unit_price": money("f.unit_price"),
         "cost_price": money("f.cost_price"), "category_id": whole("f.category_id"),
         "description": trim("f.description"), "stock_quantity": whole("f.stock_quantity")},
        [_blank("sku"), _blank("name"), _negative("unit_price"), _negative("cost_price"),
         _not_positive("category_id"),
         ("description", "f.description IS NULL", "description must be text"),
         ("stock_quantity", f"coalesce({whole('f.stock_quantity')}, -1) < 0",
          "stock_quantity must be 0 or greater")],
        "Product not found", "At least one product field is required for update"),
    "warehouse": patch(
        "warehouses", "warehouse_patch_feed",
        {"name": text("f.name"), "location_address": text("f.location_address"),
         "manager_id": whole("f.manager_id"), "is_active": boolean("f.is_active")},
        [_blank("name"), _blank("location_address"), _not_positive("manager_id"),
         ("is_active", "coalesce(f.is_active, '') NOT IN ('true', 'false')",
          "is_active must be true or false")],
        "Warehouse not found", "At least one warehouse field is required for update"),
    "storage_bin": patch(
        "storage_bins", "storage_bin_patch_feed",
        {"warehouse_id": whole("f.warehouse_id"), "zone": "f.zone", "barcode": "f.barcode",
         "max_weight": money("f.max_weight")},
        [("warehouse_id", f"f.warehouse_id IS NOT NULL AND ({whole('f.warehouse_id')}) IS NULL",
          "warehouse_id must be a number"),
         ("max_weight", f"f.max_weight IS NOT NULL AND {money('f.max_weight')} IS NULL",
          "max_weight must be a number")],
        "Storage bin not found", "No valid fields provided for storage_bins update."),
}

DELETE = {
    "category": delete("categories", "category_delete_feed", "Category not found"),
    "product": delete("products", "product_delete_feed", "Product not found"),
    "warehouse": delete("warehouses", "warehouse_delete_feed", "Warehouse not found"),
    "storage_bin": delete("storage_bins", "storage_bin_delete_feed", "Storage bin not found"),
}

# Employee status: the feed names employees, the users change.
_EMPLOYEE_STEPS = {
    "checked": f"SELECT f.seq, f.id, {boolean('f.is_active')} AS is_active, CASE WHEN "
               "coalesce(f.is_active, '') NOT IN ('true', 'false') THEN "
               "'is_active must be true or false' END AS r0 FROM employee_is_active_feed f",
    "reachable": "SELECT e.id, e.user_id FROM employees e JOIN users u ON u.id = e.user_id",
    "last": "SELECT * FROM (SELECT c.*, row_number() OVER (PARTITION BY c.id ORDER BY seq DESC) "
            "AS rn FROM checked c WHERE r0 IS NULL) x WHERE rn = 1",
    "hit": "SELECT r.id, r.user_id, l.is_active FROM reachable r JOIN last l ON l.id = r.id",
    "new_users": "SELECT u.id, username, email, first_name, last_name, role_id, "
                 "CASE WHEN h.user_id IS NULL THEN u.is_active ELSE h.is_active END AS is_active, "
                 f"CASE WHEN h.user_id IS NULL THEN updated_at ELSE {i.MOMENT} END AS updated_at "
                 "FROM users u LEFT JOIN hit h ON h.user_id = u.id",
}
EMPLOYEE = {
    "status_employee_users": statement("SELECT * FROM new_users", _EMPLOYEE_STEPS),
    "status_employee_rejected": statement(
        _rejected("reachable", "Employee not found"), _EMPLOYEE_STEPS),
    "status_employee": statement(
        """SELECT e.id, e.user_id, e.first_name, e.last_name, e.job_title, e.hire_date,
        e.base_salary, e.created_at, e.updated_at, d.id AS department_id,
        d.name AS department_name, u.username, u.email, u.role_id, u.is_active
        FROM employees e JOIN hit h ON h.id = e.id
        LEFT JOIN departments d ON d.id = e.department_id
        LEFT JOIN new_users u ON u.id = e.user_id""", _EMPLOYEE_STEPS),
}

_RECEIPT_STEPS = {
    "checked": f"SELECT f.request_id AS seq, {whole('f.product_id')} AS id, "
               f"{whole('f.quantity')} AS quantity, CASE "
               f"WHEN coalesce({whole('f.product_id')}, 0) < 1 THEN 'Invalid product id.' "
               f"WHEN coalesce({whole('f.quantity')}, 0) < 1 THEN 'Invalid quantity.' END AS r0 "
               "FROM receipt_feed f",
    "added": "SELECT id, sum(quantity) AS quantity FROM checked WHERE r0 IS NULL GROUP BY id",
    "stocked": "SELECT p.* REPLACE (CAST(p.stock_quantity + coalesce(a.quantity, 0) AS INT) AS "
               "stock_quantity) FROM products p LEFT JOIN added a ON a.id = p.id",
}
RECEIPT = {
    "receive_stock": statement(
        "SELECT * FROM stocked WHERE id IN (SELECT id FROM added)", _RECEIPT_STEPS),
    "receive_stock_table": statement("SELECT * FROM stocked", _RECEIPT_STEPS),
    "receive_stock_rejected": statement(
        "SELECT seq, id, reject_reason FROM (SELECT seq, id, coalesce(r0, CASE WHEN NOT coalesce("
        "id IN (SELECT id FROM products), false) THEN 'Product not found' END) AS reject_reason "
        "FROM checked) x WHERE reject_reason IS NOT NULL", _RECEIPT_STEPS),
}

_UPSERT_STEPS = {
    "last": "SELECT * FROM (SELECT f.*, row_number() OVER (PARTITION BY id ORDER BY seq DESC) "
            "AS rn FROM product_upsert_feed f) x WHERE rn = 1",
}
UPSERT = statement(
    """SELECT coalesce(l.id, p.id) AS id, p.category_id,
    CASE WHEN l.id IS NULL THEN p.sku ELSE l.sku END AS sku,
    CASE WHEN l.id IS NULL THEN p.name ELSE l.name END AS name, p.description,
    CASE WHEN l.id IS NULL THEN p.unit_price ELSE l.unit_price END AS unit_price, p.cost_price,
    p.stock_quantity, p.reorder_point, p.optimal_reorder_quantity
    FROM products p FULL OUTER JOIN last l ON l.id = p.id""", _UPSERT_STEPS)

_OPS_COLUMNS = {"name": text("f.name"), "unit_price": money("f.unit_price")}
_OPS_HAS = {c: f"list_contains(string_split(f.present, ','), '{c}')" for c in _OPS_COLUMNS}
_OPS_STEPS = {
    "gone": "SELECT id, min(seq) AS gone FROM product_op_feed WHERE op = 'delete' GROUP BY id",
    "checked": f"""SELECT f.seq, f.id, {text('f.name')} AS name,
        {money('f.unit_price')} AS unit_price, {_OPS_HAS['name']} AS has_name,
        {_OPS_HAS['unit_price']} AS has_unit_price, CASE
        WHEN coalesce(f.op, '') NOT IN ('update', 'delete') THEN 'op must be update or delete'
        WHEN f.op = 'delete' THEN CASE WHEN f.seq > g.gone THEN 'Product not found' END
        WHEN NOT ({_OPS_HAS['name']} OR {_OPS_HAS['unit_price']})
          THEN 'At least one product field is required for update'
        WHEN {_OPS_HAS['name']} AND {text('f.name')} IS NULL THEN 'name is required'
        WHEN {_OPS_HAS['unit_price']} AND ({money('f.unit_price')} IS NULL
          OR {number('f.unit_price')} < 0) THEN 'unit_price must be 0 or greater'
        WHEN f.seq > g.gone THEN 'Product not found' END AS r0, f.op
        FROM product_op_feed f LEFT JOIN gone g ON g.id = f.id""",
    "last_name": """SELECT id, arg_max(name, seq) AS value FROM checked
        WHERE r0 IS NULL AND op = 'update' AND has_name GROUP BY id""",
    "last_price": """SELECT id, arg_max(unit_price, seq) AS value FROM checked
        WHERE r0 IS NULL AND op = 'update' AND has_unit_price GROUP BY id""",
}
OPS = {
    "product_changes_table": statement(
        """SELECT p.* REPLACE (coalesce(n.value, p.name) AS name,
        coalesce(u.value, p.unit_price) AS unit_price)
        FROM products p LEFT JOIN last_name n ON n.id = p.id LEFT JOIN last_price u ON u.id = p.id
        WHERE p.id NOT IN (SELECT id FROM gone)""", _OPS_STEPS),
    "product_changes_rejected": statement(_rejected("products", "Product not found"), _OPS_STEPS),
}

ORACLES = {**EMPLOYEE, **RECEIPT, **OPS, "upsert_products": UPSERT}
for _prefix, _family in (("status", STATUS), ("replace", REPLACE), ("patch", PATCH),
                         ("delete", DELETE)):
    for _entity, _parts in _family.items():
        ORACLES[f"{_prefix}_{_entity}"] = _parts["changed"]
        ORACLES[f"{_prefix}_{_entity}_rejected"] = _parts["rejected"]
        ORACLES[f"{_prefix}_{_entity}_table"] = _parts["table"]
for _name, _parts in (
    ("invoices_paid", paid("invoices", "invoice_paid_feed", "Invoice not found", STAMP)),
    ("bills_paid", paid("bills", "bill_paid_feed", "Bill not found", {})),
):
    ORACLES[_name] = _parts["changed"]
    ORACLES[f"{_name}_rejected"] = _parts["rejected"]
