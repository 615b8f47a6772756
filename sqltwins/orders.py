"""The order of every listing, as rules: columns, directions, and where NULLs stand.

Written from the rules of the listings, not from the code that sorts them. Ascending puts NULLs
last and descending first, unless it says otherwise; the id settles ties.
"""

from __future__ import annotations

ORDERS = {
    "list_customers": "id DESC", "list_customer_names": "name, id", "list_accounts": "account_code, id",
    "list_budgets": "allocated_amount DESC, id", "list_tax_payments": "payment_date DESC, id DESC",
    "list_categories": "id", "list_products": "name, id", "list_storage_bins": "id",
    "list_payroll_runs": "id DESC", "list_job_postings": "posted_date DESC, id DESC",
    "list_training_programs": "scheduled_date, id DESC", "list_shipments": "estimated_arrival, id",
    "list_vendors": "name, id", "list_assets": "purchase_date DESC, id",
    "warehouse_bins": "warehouse_id, id", "reorder_alerts": "stock_quantity, name, id",
    "opportunities": "expected_close_date, id DESC", "quotations": "created_at DESC, id DESC",
    "pricing_rules": "rule_name, id", "receivables": "due_date, id", "payables": "due_date, id",
    "journal_entries": "entry_date DESC, id DESC", "employees": "id",
    "leave_requests": "created_at DESC, id DESC", "performance_reviews": "review_date DESC, id DESC",
    "applicants": "application_date DESC, id DESC", "sales_orders": "created_at DESC, id DESC",
    "purchase_orders": "created_at DESC, id DESC", "bin_contents": "warehouse_id, zone, product_name, id",
    "warehouses": "name, id", "revenue_trend": "month_start",
    "inventory_valuation": "total_valuation DESC, name, id",
    "audit_trail": "created_at DESC, id DESC",
    "customer_opportunities": "customer_id, expected_close_date, id",
    "customer_quotations": "customer_id, created_at DESC, id",
    "order_document_lines": "order_id, id", "journal_document_lines": "journal_entry_id, id",
}

# Sorted by columns that are not shown: the order stands behind the statement itself.
HIDDEN = {
    "export_finance": "invoice_date DESC NULLS LAST, id DESC", "export_hr": "id", "export_scm": "created_at DESC, id DESC",
    "export_crm": "id DESC",
    "stockout_forecast": "CASE WHEN velocity > 0 THEN CAST(stock_quantity AS DECIMAL(20,0)) / velocity END,"
                         " product_name, id",
    "recent_sales": "",
}


def parts(order: str) -> list[tuple[str, bool, bool]]:
    """(column, descending, NULLs first) of each sort key."""
    found = []
    for key in order.split(", "):
        words = key.split(" ")
        down = "DESC" in words
        found.append((words[0], down, down and "LAST" not in words))
    return found


def clause(order: str) -> str:
    """The same for DuckDB, with the place of NULLs spelled out."""
    return ", ".join(
        f"{column} {'DESC' if down else 'ASC'} NULLS {'FIRST' if first else 'LAST'}"
        for column, down, first in parts(order))


def _hidden(name: str, query: str) -> str:
    if name == "stockout_forecast":
        return f"{query} ORDER BY {HIDDEN[name]} NULLS LAST".replace(
            "END, product_name, id NULLS LAST", "END ASC NULLS LAST, product_name, id")
    return f"{query} ORDER BY {clause(HIDDEN[name])}" if HIDDEN[name] else query


def ordered(oracles: dict[str, str]) -> dict[str, str]:
    """Every sorted query's statement with its rows in order."""
    visible = {name: f"SELECT * FROM ({oracles[name]}) listed ORDER BY {clause(order)}"
               for name, order in ORDERS.items()}
    return visible | {name: _hidden(name, oracles[name]) for name in HIDDEN}
