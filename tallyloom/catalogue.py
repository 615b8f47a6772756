"""Every registered query by name: what it covers and how to build it."""

from __future__ import annotations

import datetime
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.operators.listing import lookup
from tallyloom.operators.validate import outcome, split, validate
from tallyloom.plans import (
    access, bi, crm, edits, finance, hr, intake, inventory, posting, sales, scm,
)
from tallyloom.session import bound_tasks, scratch_path
from tallyloom.sources import bodies, sinks
from tallyloom.sources.tables import StreamTables
from tallyloom.streaming import edits as edit_stream
from tallyloom.streaming import movements as movement_stream

AS_OF = datetime.date(1998, 6, 30)


def _customer_documents(t) -> DataFrame:
    return crm.customer_documents(t).select(
        "id", "company_name", "status", "opportunity_count", "quotation_count")


def _order_documents(t, orders: DataFrame | None = None) -> DataFrame:
    return sales.order_documents(t, orders).select(
        "id", "status", "total_amount", "customer_company_name", "primary_email", "line_count")


def _journal_documents(t) -> DataFrame:
    return finance.journal_documents(t).select("id", "entry_date", "description", "line_count")


def _csv(module: str) -> Callable:
    def run(t) -> DataFrame:
        frame = bi.export(t, f" {module.upper()} ")
        path = scratch_path(t.spark, f"csv-{module}")
        sinks.write_csv(frame, path)
        return sinks.read_csv(t.spark, path, frame.columns)

    return run


def _available(t) -> DataFrame:
    stock = t.inventory_batches.filter(F.col("status") == "Available").groupBy("product_id").agg(
        F.count(F.lit(1)).alias("batches"), F.sum("quantity_remaining").alias("quantity")
    )
    return t.products.select("id").join(stock, F.col("id") == F.col("product_id"), "left").select(
        "id", F.coalesce("batches", F.lit(0)).alias("batches"),
        F.coalesce("quantity", F.lit(0)).cast("bigint").alias("quantity"),
    )


def _billed_this_year(t) -> DataFrame:
    first = datetime.date(AS_OF.year, 1, 1)
    return bi.billed(t).filter(
        (F.col("invoice_date") >= F.lit(first))
        & (F.col("invoice_date") < F.lit(first.replace(year=first.year + 1)))
    ).select("id", "invoice_date", "total_amount")


# name -> (operator ids of the survey, builder over the tables)
REPORTS: dict[str, tuple[str, Callable]] = {
    "list_customers": ("L-1", crm.customers),
    "list_customer_names": ("L-2", sales.customer_names),
    "list_accounts": ("L-3", finance.accounts),
    "list_budgets": ("L-4", finance.budgets),
    "list_tax_payments": ("L-5", finance.tax_payments),
    "list_categories": ("L-6", inventory.categories),
    "list_products": ("L-7", inventory.products),
    "list_storage_bins": ("L-8", inventory.storage_bins),
    "list_payroll_runs": ("L-9", hr.payroll_runs),
    "list_job_postings": ("L-10", hr.job_postings),
    "list_training_programs": ("L-11", hr.training_programs),
    "list_shipments": ("L-12", scm.shipments),
    "list_vendors": ("L-13", scm.vendors),
    "list_assets": ("L-14 F-9 F-16", finance.assets),
    "lookup_categories": ("P-1", lambda t: lookup(t.categories, t.key_feed)),
    "lookup_products": ("P-1", lambda t: lookup(t.products, t.key_feed)),
    "lookup_warehouses": ("P-1", lambda t: lookup(t.warehouses, t.key_feed)),
    "lookup_storage_bins": ("P-1", lambda t: lookup(t.storage_bins, t.key_feed)),
    "lookup_invoice_recipients": ("P-1", lambda t: sales.invoice_recipients(t, t.key_feed)),
    "warehouse_bins": ("P-2", lambda t: inventory.warehouse_bins(t, t.key_feed)),
    "billed_invoices": ("P-3", lambda t: bi.billed(t).select("id", "status", "total_amount")),
    "open_opportunities": (
        "P-4",
        lambda t: t.opportunities.filter(
            ~F.col("stage").isin("Closed Won", "Closed Lost")
        ).select("id", "stage", "estimated_value"),
    ),
    "reorder_alerts": ("P-5", inventory.alerts),
    "billed_this_year": ("P-6", _billed_this_year),
    "opportunities": ("J-1", crm.opportunities),
    "quotations": ("J-2", crm.quotations),
    "pricing_rules": ("J-3", crm.pricing_rules),
    "receivables": ("J-4", finance.receivables),
    "payables": ("J-5", finance.payables),
    "journal_lines": ("J-6", finance.journal_lines),
    "journal_entries": ("J-7", finance.journal_entries),
    "employees": ("J-8", hr.employees),
    "leave_requests": ("J-9", hr.leave_requests),
    "performance_reviews": ("J-10", hr.performance_reviews),
    "applicants": ("J-11", hr.applicants),
    "sales_orders": ("J-12", sales.sales_orders),
    "order_lines_with_product": ("J-13", sales.lines_with_product),
    "purchase_orders": ("J-14", scm.purchase_orders),
    "purchase_order_supplier_only": (
        "J-15", lambda t: scm.with_supplier_only(t.purchase_orders, t)
    ),
    "bin_contents": ("J-16", inventory.bin_contents),
    "warehouses": ("J-17", inventory.warehouses),
    "audit_logs": ("J-18", bi.audit_joined),
    "users_with_role": ("J-19 F-7", hr.users_with_role),
    "available_stock": ("J-20", _available),
    "accounts_in_use": (
        "J-21",
        lambda t: t.accounts.join(
            t.journal_entry_lines.select(F.col("account_id").alias("id")).distinct(),
            "id", "left_semi",
        ),
    ),
    "unreversed_entries": ("J-22 T-3", finance.unreversed_entries),
    "kpi_revenue": ("A-1", bi.revenue),
    "kpi_pipeline": ("A-2", bi.pipeline),
    "kpi_inventory_value": ("A-3", inventory.inventory_value),
    "revenue_trend": ("A-4 F-12", lambda t: bi.revenue_trend(t, AS_OF)),
    "dashboard_revenue": ("A-5", bi.order_revenue),
    "dashboard_user_count": ("A-6", bi.user_count),
    "dashboard_low_stock": ("A-7", bi.low_stock_count),
    "inventory_valuation": ("A-8", inventory.valuation),
    "stockout_forecast": ("A-9 T-4", inventory.forecast),
    "tax_summary": ("A-10", finance.tax_summary),
    "journal_totals": ("A-11", finance.journal_totals),
    "invoice_totals": ("A-15", sales.invoice_totals),
    "kpis": ("A-16", bi.kpis),
    "dashboard_metrics": ("A-16", bi.dashboard),
    "payments_per_invoice": ("A-17", finance.payments_per_invoice),
    "audit_trail": ("T-1", bi.audit_trail),
    "recent_sales": ("T-2", bi.recent_sales),
    "customer_documents": ("N-1", _customer_documents),
    "customer_opportunities": ("N-1", crm.customer_opportunities),
    "customer_quotations": ("N-1", crm.customer_quotations),
    "order_documents": ("N-2", _order_documents),
    "order_document_lines": ("N-2", sales.order_document_lines),
    "journal_documents": ("N-3", _journal_documents),
    "journal_document_lines": ("N-3", finance.journal_document_lines),
    "invoice_documents": ("N-4 A-15", sales.invoice_documents),
    "invoice_document_lines": ("N-4", sales.invoice_document_lines),
    "export_finance": ("K-1a", bi.export_finance),
    "export_hr": ("K-1b", bi.export_hr),
    "export_scm": ("K-1c", bi.export_scm),
    "export_crm": ("K-1d", bi.export_crm),
    "csv_finance": ("K-1 F-13", _csv("finance")),
    "csv_hr": ("K-1 F-13", _csv("hr")),
    "csv_scm": ("K-1 F-13", _csv("scm")),
    "csv_crm": ("K-1 F-13", _csv("crm")),
}

NOW = datetime.datetime(1998, 6, 30)


def _judged(job: Callable, *args) -> Callable:
    return lambda t: outcome(job(t, *args))


def _new_quotations(t) -> DataFrame:
    good, _ = split(intake.quotations(t))
    return crm.with_customer(good, t)


def _new_applicants(t) -> DataFrame:
    good, _ = split(intake.applicants(t, AS_OF))
    return hr.with_posting(good, t)


def _registered(part: int) -> Callable:
    """Users (0) or employees (1) of the accepted registrations."""
    return lambda t: intake.split_staff(split(intake.employees(t))[0])[part]


INTAKE: dict[str, tuple[str, Callable]] = {
    "intake_customers": ("V-1 F-1 F-2 F-5", _judged(intake.customers)),
    "intake_opportunities": ("V-2 F-3 F-6", _judged(intake.opportunities)),
    "intake_quotations": ("V-3", _judged(intake.quotations)),
    "intake_pricing_rules": ("V-4 F-4", _judged(intake.pricing_rules)),
    "intake_invoices": ("V-5 V-20 F-14", _judged(intake.invoices, AS_OF)),
    "intake_accounts": ("V-6 V-20", _judged(intake.accounts)),
    "intake_assets": ("V-7 F-8", _judged(intake.assets)),
    "intake_budgets": ("V-8", _judged(intake.budgets)),
    "intake_tax_payments": ("V-9", _judged(intake.tax_payments)),
    "intake_bills": ("V-10", _judged(intake.bills)),
    "intake_payroll_runs": ("V-11", _judged(intake.payroll_runs, AS_OF)),
    "intake_performance_reviews": ("V-12", _judged(intake.performance_reviews, AS_OF)),
    "intake_job_postings": ("V-13", _judged(intake.job_postings, AS_OF)),
    "intake_applicants": ("V-14", _judged(intake.applicants, AS_OF)),
    "intake_training_programs": ("V-15", _judged(intake.training_programs)),
    "intake_vendors": ("V-16", _judged(intake.vendors)),
    "intake_categories": ("V-17", _judged(intake.categories)),
    "intake_warehouses": ("V-17", _judged(intake.warehouses)),
    "intake_storage_bins": ("V-17", _judged(intake.storage_bins)),
    "intake_products": ("V-17 V-20", _judged(intake.products)),
    "intake_new_products": ("V-18 F-11", _judged(intake.new_products)),
    "intake_employees": ("V-19 V-20 R-3 F-7 F-14", _judged(intake.employees)),
    "intake_movements": ("W-7 V-20", _judged(intake.movements, NOW)),
    "new_quotations": ("V-3 J-2", _new_quotations),
    "new_applicants": ("V-14 J-11", _new_applicants),
    "new_users": ("V-19", _registered(0)),
    "new_employees": ("V-19", _registered(1)),
}


def _status_change(entity: str, part: str) -> Callable:
    def run(t) -> DataFrame:
        changes = edits.status_changes()[entity](t, NOW)
        return edits.enriched(entity, changes.changed, t) if part == "changed" else getattr(
            changes, part)

    return run


def _change(job: Callable, part: str, entity: str = "") -> Callable:
    def run(t) -> DataFrame:
        changes = job(t, NOW)
        return edits.enriched(entity, changes.changed, t) if part == "changed" else getattr(
            changes, part)

    return run


STATUS_IDS = {
    "opportunity": "U-1a", "quotation": "U-1b", "account": "U-1c", "asset": "U-1d",
    "leave": "U-1f", "payroll": "U-1g", "job": "U-1h", "applicant": "U-1i", "training": "U-1j",
    "sales_order": "U-1k", "vendor": "U-1l", "purchase_order": "U-1m", "shipment": "U-1n",
}
REPLACE_IDS = {
    "customer": "U-2a", "pricing_rule": "U-2b", "account": "U-2c", "asset": "U-2d",
    "budget": "U-2e", "review": "U-2f", "vendor": "U-2g",
}
PATCH_IDS = {"category": "U-3a", "product": "U-3b", "warehouse": "U-3c", "storage_bin": "U-3d"}
DELETE_IDS = {"category": "U-4a", "product": "U-4b", "warehouse": "U-4c", "storage_bin": "U-4d"}

EDITS: dict[str, tuple[str, Callable]] = {}
for _entity, _id in STATUS_IDS.items():
    EDITS[f"status_{_entity}"] = (f"{_id} U-8", _status_change(_entity, "changed"))
    EDITS[f"status_{_entity}_rejected"] = (_id, _status_change(_entity, "rejected"))
EDITS["status_sales_order_table"] = ("U-1k", _status_change("sales_order", "table"))
EDITS["status_sales_order_documents"] = (
    "U-1k N-2", lambda t: _order_documents(t, _status_change("sales_order", "changed")(t)))
EDITS["status_sales_order_lines"] = (
    "U-1k N-2",
    lambda t: sales.order_document_lines(t, _status_change("sales_order", "changed")(t)))
EDITS["status_employee"] = ("U-1e J-23 U-8", _change(edits.employee_status, "changed"))
EDITS["status_employee_rejected"] = ("U-1e", _change(edits.employee_status, "rejected"))
EDITS["status_employee_users"] = ("U-1e J-23", _change(edits.employee_status, "table"))
for _entity, _job in edits.REPLACEMENTS.items():
    _id = REPLACE_IDS[_entity]
    EDITS[f"replace_{_entity}"] = (f"{_id} U-8", _change(_job, "changed", _entity))
    EDITS[f"replace_{_entity}_rejected"] = (_id, _change(_job, "rejected"))
EDITS["replace_customer_table"] = ("U-2a", _change(edits.customer, "table"))
for _entity, _job in edits.PATCHES.items():
    EDITS[f"patch_{_entity}"] = (PATCH_IDS[_entity], _change(_job, "changed"))
    EDITS[f"patch_{_entity}_rejected"] = (PATCH_IDS[_entity], _change(_job, "rejected"))
EDITS["patch_product_table"] = ("U-3b", _change(edits.product_patch, "table"))
for _entity, _job in edits.DELETIONS.items():
    EDITS[f"delete_{_entity}"] = (DELETE_IDS[_entity], _change(_job, "changed"))
    EDITS[f"delete_{_entity}_table"] = (DELETE_IDS[_entity], _change(_job, "table"))
    EDITS[f"delete_{_entity}_rejected"] = (DELETE_IDS[_entity], _change(_job, "rejected"))
EDITS["product_changes_table"] = ("U-3b U-4b", _change(edits.product_changes, "table"))
EDITS["product_changes_rejected"] = ("U-3b U-4b", _change(edits.product_changes, "rejected"))
EDITS["receive_stock"] = ("U-5 W-6", _change(edits.receive_stock, "changed"))
EDITS["receive_stock_table"] = ("U-5 W-6", _change(edits.receive_stock, "table"))
EDITS["receive_stock_rejected"] = ("U-5 W-6", _change(edits.receive_stock, "rejected"))
EDITS["invoices_paid"] = ("U-6", _change(edits.invoices_paid, "changed"))
EDITS["invoices_paid_rejected"] = ("U-6", _change(edits.invoices_paid, "rejected"))
EDITS["bills_paid"] = ("U-7", _change(edits.bills_paid, "changed"))
EDITS["bills_paid_rejected"] = ("U-7", _change(edits.bills_paid, "rejected"))
EDITS["upsert_products"] = ("U-9", edits.upsert_products)

def _new_purchase_orders(t) -> DataFrame:
    good, _ = split(posting.purchase_orders(t).headers)
    return scm.with_supplier(good, t)


POSTING: dict[str, tuple[str, Callable]] = {
    "post_sales_orders": ("W-1 A-13", lambda t: outcome(posting.sales_orders(t, NOW).headers)),
    "post_sales_order_lines": ("W-1 A-13", lambda t: posting.sales_orders(t, NOW).lines()),
    "post_sales_order_lines_rejected": (
        "W-1", lambda t: posting.sales_orders(t, NOW).rejected_lines()),
    "post_purchase_orders": ("W-2 A-14", lambda t: outcome(posting.purchase_orders(t).headers)),
    "new_purchase_orders": ("W-2 J-14", _new_purchase_orders),
    "post_purchase_order_lines": ("W-2 A-14", lambda t: posting.purchase_orders(t).lines()),
    "post_purchase_order_lines_rejected": (
        "W-2", lambda t: posting.purchase_orders(t).rejected_lines()),
    "post_journal_entries": (
        "W-3", lambda t: outcome(posting.journal_headers(posting.journal_entries(t)))
    ),
    "post_journal_lines": ("W-3", lambda t: posting.journal_lines(posting.journal_entries(t))),
    "post_journal_lines_rejected": (
        "W-3", lambda t: posting.journal_entries(t).rejected_lines()),
    "journal_balance": ("A-12", lambda t: posting.journal_balance(t.journal_line_feed)),
    "reverse_requests": ("W-4 J-22", lambda t: posting.reversals(t, AS_OF).requests),
    "reverse_entries": ("W-4 F-15", lambda t: posting.reversals(t, AS_OF).entries),
    "reverse_lines": ("W-4", lambda t: posting.reversals(t, AS_OF).lines()),
    "payment_requests": ("W-5 P-7", lambda t: posting.payments(t, NOW).requests),
    "payment_rows": ("W-5 F-10", lambda t: posting.payments(t, NOW).payments),
    "payment_entries": ("W-5 F-15", lambda t: posting.payments(t, NOW).entries),
    "payment_lines": ("W-5", lambda t: posting.payments(t, NOW).lines),
    "payment_accounts": ("P-7", lambda t: posting.known_accounts(t, t.payment_feed)),
}



def _json_customers(t) -> DataFrame:
    """Customer requests written and read as JSON bodies, then judged."""
    path = scratch_path(t.spark, "bodies")
    feed = t.customer_feed
    sinks.write_documents(feed, path)
    schema = bodies.body_schema([c for c in feed.columns if c != "request_id"])
    return outcome(validate(bodies.read_bodies(t.spark, path, schema), intake.customer_fields()))


def _written_bodies(t) -> str:
    """Raw customer bodies, some of them damaged, as a folder of text files."""
    path = scratch_path(t.spark, "raw-bodies")
    t.customer_body_feed.select("body").write.text(path)
    return path


def _customer_bodies(t) -> DataFrame:
    schema = bodies.body_schema([field.name for field in intake.customer_fields()])
    return bodies.parse_bodies(bodies.read_lines(t.spark, _written_bodies(t)), schema)


def _bodies_judged(t) -> DataFrame:
    return outcome(validate(bodies.readable(_customer_bodies(t)), intake.customer_fields()))


def _bodies_quarantined(t) -> DataFrame:
    return bodies.unreadable(_customer_bodies(t))


def _stream_bodies_quarantined(t) -> DataFrame:
    """The damaged bodies of a stream of movement requests."""
    path = scratch_path(t.spark, "body-log")
    schema = bodies.body_schema([field.name for field in intake.movement_fields(NOW)])
    movement_stream.ingest_bodies(t, bodies.stream_lines(t.spark, _written_bodies(t)), schema, path, NOW)
    return movement_stream.quarantined(t, path)


def _order_bodies(t) -> tuple[DataFrame, DataFrame]:
    """Sales orders written and read as nested bodies: headers and lines."""
    bound_tasks(t.spark)
    path = scratch_path(t.spark, "order-bodies")
    lines = t.sales_order_line_feed.filter(F.col("request_id").isNotNull())
    items = bodies.LINES["sales_order"][1]
    nested = lines.groupBy("request_id").agg(
        F.array_sort(F.collect_list(F.struct("line_no", *items))).alias("order_lines"))
    sinks.write_documents(t.sales_order_feed.join(nested, "request_id", "left"), path)
    read = bodies.read_bodies(t.spark, path, bodies.document_schema("sales_order"))
    return bodies.split_documents(read, "sales_order")


def _json_round_trip(t, documents: DataFrame) -> DataFrame:
    """Headers or lines of documents written as compressed JSON and read back."""
    path = scratch_path(t.spark, "documents")
    sinks.write_documents(documents, path, "snappy")
    bound_tasks(t.spark)
    return t.spark.read.schema(documents.schema).json(path)


def _appended(t) -> DataFrame:
    """Accepted categories appended to a table, whitelisted columns only."""
    path = scratch_path(t.spark, "categories")
    rows, _ = split(intake.categories(t))
    sinks.append_rows(rows, path, ["name", "description"])
    return t.spark.read.schema("name STRING, description STRING").parquet(path)


FILES: dict[str, tuple[str, Callable]] = {
    "json_customers": ("S-2", _json_customers),
    "json_bodies": ("S-2", _bodies_judged),
    "json_bodies_quarantined": ("S-2", _bodies_quarantined),
    "json_sales_orders": (
        "S-2 W-1", lambda t: outcome(posting.sales_orders(t, NOW, *_order_bodies(t)).headers)),
    "json_sales_order_lines": (
        "S-2 W-1", lambda t: posting.sales_orders(t, NOW, *_order_bodies(t)).lines()),
    "json_order_documents": ("K-3 S-2", lambda t: _json_round_trip(t, _order_documents(t))),
    "json_order_document_lines": (
        "K-3 S-2", lambda t: _json_round_trip(t, sales.order_document_lines(t))),
    "append_categories": ("K-2", _appended),
}

ACCESS: dict[str, tuple[str, Callable]] = {
    "user_permissions": ("R-1 S-3", access.user_permissions),
    "access_audit": ("R-2", access.access_audit),
    "upsert_roles": ("S-3 U-9", lambda t: edits.upsert_roles(t.stored_roles, t.roles, NOW).withColumn(
        "permissions", F.array_join("permissions", ","))),
    "resolve_roles": ("R-3 F-7", lambda t: access.resolve_roles(t.role_feed)),
}



def _moved(read: Callable) -> Callable:
    def run(t) -> DataFrame:
        arriving, path = StreamTables(t.spark, t.root), scratch_path(t.spark, "movements")
        movement_stream.ingest(t, arriving.movement_feed, path, NOW)
        return read(t, path)

    return run


def _received(read: Callable) -> Callable:
    def run(t) -> DataFrame:
        arriving, path = StreamTables(t.spark, t.root), scratch_path(t.spark, "receipts")
        edit_stream.log_receipts(t, arriving.receipt_feed, path)
        return read(t, path)

    return run


def _order_status(read: Callable, *args) -> Callable:
    def run(t) -> DataFrame:
        arriving, path = StreamTables(t.spark, t.root), scratch_path(t.spark, "order-status")
        edit_stream.log_order_status(t, arriving.sales_order_status_feed, path)
        return read(t, path, *args)

    return run


def _with_a_compaction(feed: str, log: Callable, compact: Callable, current: Callable, *args) -> Callable:
    """Half of the events arrive and go into a new base, then the others arrive."""

    def run(t) -> DataFrame:
        arrived, path = scratch_path(t.spark, "arrivals"), scratch_path(t.spark, "log")
        events = t.landing("events")
        middle = events.agg(F.max("event_id")).first()[0] or 0
        early = F.coalesce(F.col("event_id") <= middle // 2, F.lit(True))
        events.filter(early).write.parquet(arrived)
        arriving = StreamTables(t.spark, t.root, arrived)
        log(t, arriving.table(feed), path)
        compact(t, path, *args)
        events.filter(~early).write.mode("append").parquet(arrived)
        log(t, arriving.table(feed), path)
        return current(t, path, *args)

    return run


STREAMS: dict[str, tuple[str, Callable]] = {
    "stream_movements": ("X-1 K-2", _moved(movement_stream.accepted)),
    "stream_movements_rejected": ("X-1", _moved(movement_stream.rejected)),
    "stream_bodies_quarantined": ("X-1 S-2", _stream_bodies_quarantined),
    "stream_receipts": ("X-2 U-5", _received(edit_stream.stocked)),
    "stream_receipts_compacted": ("X-2 U-5", _with_a_compaction(
        "receipt_feed", edit_stream.log_receipts, edit_stream.compact_receipts, edit_stream.stocked)),
    "stream_receipts_rejected": ("X-2", _received(edit_stream.refused_receipts)),
    "stream_order_status": ("X-2 U-1k", _order_status(edit_stream.current_orders, NOW)),
    "stream_order_status_compacted": ("X-2 U-1k", _with_a_compaction(
        "sales_order_status_feed", edit_stream.log_order_status,
        edit_stream.compact_order_status, edit_stream.current_orders, NOW)),
    "stream_order_status_rejected": ("X-2", _order_status(edit_stream.refused_order_status)),
}

QUERIES = {**REPORTS, **INTAKE, **EDITS, **POSTING, **FILES, **ACCESS, **STREAMS}
