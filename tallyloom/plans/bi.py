"""Key figures, trends, audit, dashboard and the module exports."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.business import month_label, month_start
from tallyloom.operators.listing import (
    down, down_nulls_last, listing, newest_matching, one_row, up,
)
from tallyloom.plans import hr, inventory, scm
from tallyloom.plans.finance import total

MONEY = "decimal(18,2)"


def billed(t) -> DataFrame:
    """Invoices that are no drafts; an unknown status does not qualify."""
    return t.invoices.filter(F.col("status") != "Draft")


def revenue(t) -> DataFrame:
    return total(billed(t), "total_amount", "total_revenue")


def pipeline(t) -> DataFrame:
    open_deals = t.opportunities.filter(~F.col("stage").isin("Closed Won", "Closed Lost"))
    return total(open_deals, "estimated_value", "total_pipeline")


def kpis(t) -> DataFrame:
    return one_row(revenue(t), pipeline(t), inventory.inventory_value(t))


def revenue_trend(t, as_of: datetime.date) -> DataFrame:
    """Monthly revenue of the year of ``as_of``; the year is a date range so that the
    parquet scan can skip by statistics."""
    first, last = datetime.date(as_of.year, 1, 1), datetime.date(as_of.year + 1, 1, 1)
    year = billed(t).filter(
        (F.col("invoice_date") >= F.lit(first)) & (F.col("invoice_date") < F.lit(last))
    )
    months = year.groupBy(month_start(F.col("invoice_date")).alias("month_start")).agg(
        F.sum("total_amount").cast(MONEY).alias("revenue")
    )
    return listing(
        months, [up("month_start")],
        ["month_start", month_label(F.col("month_start")).alias("month_label"), "revenue"],
    )


def audit_trail(t, rows: int = 100) -> DataFrame:
    """The latest audit entries of known users."""
    people = t.users.select(F.col("id").alias("user_id"), "first_name", "last_name")
    return newest_matching(t.audit_logs, people, "user_id", "created_at", rows)


def audit_joined(t) -> DataFrame:
    people = t.users.select(F.col("id").alias("user_id"), "first_name", "last_name")
    return t.audit_logs.join(people, "user_id")


def order_revenue(t) -> DataFrame:
    return total(t.sales_orders, "total_amount", "total_revenue")


def user_count(t) -> DataFrame:
    return t.users.agg(F.count(F.lit(1)).alias("employee_count"))


def low_stock_count(t) -> DataFrame:
    return t.products.filter(F.col("stock_quantity") < 10).agg(
        F.count(F.lit(1)).alias("low_stock_count")
    )


def recent_sales(t, rows: int = 5) -> DataFrame:
    names = t.customers.select(
        F.col("id").alias("customer_id"), F.col("company_name").alias("customer_name")
    )
    orders = t.sales_orders.select("id", "total_amount", "created_at", "customer_id")
    newest = newest_matching(orders, names, "customer_id", "created_at", rows)
    return newest.select("total_amount", "created_at", "customer_name")


def dashboard(t) -> DataFrame:
    """The scalar figures; ``recent_sales`` is the list that goes with them."""
    return one_row(order_revenue(t), user_count(t), low_stock_count(t))


def export_finance(t) -> DataFrame:
    return listing(
        t.invoices, [down_nulls_last("invoice_date"), down("id")],
        ["invoice_number", "status", "invoice_date", "due_date", "total_amount"],
    )


def export_hr(t) -> DataFrame:
    return listing(
        hr.employee_profiles(t.employees, t), [up("id")],
        [F.col("id").alias("employee_id"), "first_name", "last_name", "email", "department_name",
         "job_title", "hire_date", "is_active"],
    )


def export_scm(t) -> DataFrame:
    return listing(
        scm.with_supplier(t.purchase_orders, t), [down("created_at"), down("id")],
        ["po_number", "supplier_name", "order_date", "expected_delivery_date", "status",
         "total_amount"],
    )


def export_crm(t) -> DataFrame:
    return listing(
        t.customers, [down("id")],
        ["company_name", "primary_contact_name", "primary_email", "primary_phone", "industry",
         "status"],
    )


EXPORTS = {
    "finance": export_finance, "hr": export_hr, "scm": export_scm, "crm": export_crm,
}


def export(t, module: str | None) -> DataFrame:
    """Export frame of a module; the name is trimmed and case does not matter."""
    name = (module or "").strip().lower()
    if name not in EXPORTS:
        raise ValueError("Unsupported export module")
    return EXPORTS[name](t)


