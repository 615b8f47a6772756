"""Keyed changes per entity: which fields, which rules, what is stamped."""

from __future__ import annotations

import datetime
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions import business as b
from tallyloom.functions import cleaning
from tallyloom.functions import fields as f
from tallyloom.functions import reasons
from tallyloom.functions.reasons import not_found as missing
from tallyloom.operators.changes import (
    Changes, add_to, apply_latest, delete_rows, judge_targets, patch_and_delete, patch_fields,
    replace_fields, stamp_keys, upsert_rows,
)
from tallyloom.operators.validate import REASON, Field, Rule, clean
from tallyloom.plans import crm, hr, intake, scm


def stamped(as_of: datetime.datetime) -> dict[str, Column]:
    return {"updated_at": cleaning.instant(as_of)}


def _status(
    table: str, feed: str, field: Field, not_found: str, *, stamps: bool = False
) -> Callable:
    def apply(t, as_of: datetime.datetime) -> Changes:
        return replace_fields(
            t.table(table), t.table(feed), [field], not_found=not_found,
            stamp=stamped(as_of) if stamps else None,
        )

    return apply


def _active(reason: str) -> Field:
    return f.flag("is_active", required=True, reason=reason)


def _shipment_status() -> Field:
    return f.required_text("status")


# Built on first use: column expressions need a running session.
def status_changes() -> dict[str, Callable]:
    """One status-like field per entity, keyed by the entity's name."""
    return {
        "opportunity": _status("opportunities", "opportunity_stage_feed",
                               f.choice("stage", b.OPPORTUNITY_STAGES), missing("Opportunity")),
        "quotation": _status("quotations", "quotation_status_feed",
                             f.choice("status", b.QUOTATION_STATUSES), missing("Quotation")),
        "account": _status("accounts", "account_is_active_feed",
                           _active(reasons.BOOLEAN_VALUE), missing("Account")),
        "asset": _status("assets", "asset_status_feed", intake.asset_status(), missing("Asset"),
                         stamps=True),
        "leave": _status("leave_requests", "leave_status_feed",
                         f.choice("status", b.LEAVE_STATUSES), missing("Leave request")),
        "payroll": _status("payroll_runs", "payroll_status_feed",
                           f.choice("status", b.PAYROLL_STATUSES), missing("Payroll run")),
        "job": _status("job_postings", "job_status_feed", f.choice("status", b.JOB_STATUSES),
                       missing("Job posting")),
        "applicant": _status("applicants", "applicant_pipeline_stage_feed",
                             f.choice("pipeline_stage", b.APPLICANT_STAGES),
                             missing("Applicant")),
        "training": _status("training_programs", "training_status_feed",
                            f.choice("status", b.TRAINING_STATUSES), missing("Training program")),
        "sales_order": _status("sales_orders", "sales_order_status_feed",
                               f.choice("status", b.SALES_ORDER_STATUSES),
                               missing("Sales order"), stamps=True),
        "vendor": _status("suppliers", "vendor_status_feed",
                          f.choice("status", b.VENDOR_STATUSES), missing("Vendor"), stamps=True),
        "purchase_order": _status("purchase_orders", "purchase_order_status_feed",
                                  f.choice("status", b.PURCHASE_ORDER_STATUSES),
                                  missing("Purchase order"), stamps=True),
        "shipment": _status("shipments", "shipment_status_feed", _shipment_status(),
                            missing("Shipment"), stamps=True),
    }


def employee_status(t, as_of: datetime.datetime) -> Changes:
    """The change names an employee, the row that changes is the employee's user.

    Changes are folded per employee, then per user (two employees may share one), so the
    users meet at most one change each.
    """
    checked = clean(
        t.employee_is_active_feed, [_active(reasons.true_or_false("is_active"))],
        keep=("seq", "id"),
    )
    users, links = t.users, t.employees.select("id", "user_id")
    valid_seq = F.when(F.col(REASON).isNull(), F.col("seq"))
    latest = checked.groupBy("id").agg(
        F.max_by("is_active", valid_seq).alias("is_active"), F.max(valid_seq).alias("seq")
    ).filter(F.col("seq").isNotNull())
    per_user = latest.join(links, "id").select(
        F.col("user_id").alias("id"), "seq", "is_active", F.lit(None).cast("string").alias(REASON)
    )
    done = apply_latest(users, per_user, ["is_active"], stamped(as_of), (False, True))

    def profiles() -> DataFrame:
        touched = t.employees.join(latest.select("id"), "id", "left_semi")
        shown = hr.employee_profiles(touched, t, done.changed)
        return shown.filter(F.col("username").isNotNull())

    def refused() -> DataFrame:
        # An employee without a user cannot be switched: "not found", as for an unknown id.
        known = users.select(F.col("id").alias("user_id"))
        reachable = links.join(known, "user_id", "left_semi")
        judged = judge_targets(checked, reachable, missing("Employee"))
        return judged.filter(F.col(REASON).isNotNull()).select("seq", "id", REASON)

    return Changes(lambda: done.table, profiles, refused)


def customer(t, as_of) -> Changes:
    return replace_fields(
        t.customers, t.customer_replace_feed, intake.customer_fields(),
        not_found=missing("Customer"), stamp=stamped(as_of),
    )


def pricing_rule(t, as_of) -> Changes:
    """A missing ``is_active`` means false here (a new rule defaults to true)."""
    return replace_fields(
        t.pricing_rules, t.pricing_rule_replace_feed,
        intake.pricing_rule_fields(active_by_default=False), not_found=missing("Pricing rule"),
    )


def account(t, as_of) -> Changes:
    return replace_fields(
        t.accounts, t.account_replace_feed, intake.account_fields(),
        not_found=missing("Account"), stamp=stamped(as_of),
    )


def asset(t, as_of) -> Changes:
    return replace_fields(
        t.assets, t.asset_replace_feed, intake.asset_fields(), not_found=missing("Asset"),
        stamp=stamped(as_of),
    )


def budget(t, as_of) -> Changes:
    return replace_fields(
        t.budgets, t.budget_replace_feed, intake.budget_fields(), not_found=missing("Budget")
    )


def review(t, as_of) -> Changes:
    rules = [intake.review_rating(), f.date("review_date", required=True),
             f.optional_text("comments")]
    return replace_fields(
        t.performance_reviews, t.review_replace_feed, rules,
        not_found=missing("Performance review"),
    )


def vendor(t, as_of) -> Changes:
    return replace_fields(
        t.suppliers, t.vendor_replace_feed, intake.vendor_fields(),
        not_found=missing("Vendor"), stamp=stamped(as_of),
    )


REPLACEMENTS = {
    "customer": customer, "pricing_rule": pricing_rule, "account": account, "asset": asset,
    "budget": budget, "review": review, "vendor": vendor,
}


def _money(name: str) -> Field:
    return f.amount(name, reasons.zero_or_greater(name))


def category_patch(t, as_of) -> Changes:
    return patch_fields(
        t.categories, t.category_patch_feed, [f.plain_text("name"), f.plain_text("description")],
        not_found=missing("Category"), empty=reasons.no_valid_update("categories"),
    )


def product_patch(t, as_of) -> Changes:
    description = Field("description", cleaning.trimmed(F.col("description")), (
        Rule(F.col("description").isNull(), reasons.DESCRIPTION),))
    rules = [
        f.required_text("sku"), f.required_text("name"), _money("unit_price"),
        _money("cost_price"),
        f.whole_number("category_id", reasons.positive_integer("category_id")),
        description,
        f.whole_number("stock_quantity", reasons.zero_or_greater("stock_quantity"), low=0),
    ]
    return patch_fields(
        t.products, t.product_patch_feed, rules, not_found=missing("Product"),
        empty=reasons.nothing_to_update("product"),
    )


def warehouse_patch(t, as_of) -> Changes:
    rules = [
        f.required_text("name"), f.required_text("location_address"),
        f.whole_number("manager_id", reasons.positive_integer("manager_id")),
        _active(reasons.true_or_false("is_active")),
    ]
    return patch_fields(
        t.warehouses, t.warehouse_patch_feed, rules, not_found=missing("Warehouse"),
        empty=reasons.nothing_to_update("warehouse"),
    )


def storage_bin_patch(t, as_of) -> Changes:
    return patch_fields(
        t.storage_bins, t.storage_bin_patch_feed, intake.storage_bin_fields(),
        not_found=missing("Storage bin"),
        empty=reasons.no_valid_update("storage_bins"),
    )


PATCHES = {
    "category": category_patch, "product": product_patch, "warehouse": warehouse_patch,
    "storage_bin": storage_bin_patch,
}


def _deletion(table: str, entity: str, not_found: str) -> Callable:
    return lambda t, as_of: delete_rows(
        t.table(table), t.table(f"{entity}_delete_feed"), not_found=not_found
    )


DELETIONS = {
    "category": _deletion("categories", "category", missing("Category")),
    "product": _deletion("products", "product", missing("Product")),
    "warehouse": _deletion("warehouses", "warehouse", missing("Warehouse")),
    "storage_bin": _deletion("storage_bins", "storage_bin", missing("Storage bin")),
}


def product_changes(t, as_of) -> Changes:
    """Updates and deletions of products in one feed, in ``seq`` order."""
    return patch_and_delete(
        t.products, t.product_op_feed, [f.required_text("name"), _money("unit_price")],
        not_found=missing("Product"), empty=reasons.nothing_to_update("product"),
    )


def receive_stock(t, as_of=None, feed: DataFrame | None = None) -> Changes:
    product = f.whole_number("product_id", reasons.RECEIVED_PRODUCT)
    quantity = f.whole_number("quantity", reasons.RECEIVED_QUANTITY)
    return add_to(
        t.products, t.receipt_feed if feed is None else feed, "stock_quantity", product, quantity,
        not_found=missing("Product"),
    )


def invoices_paid(t, as_of) -> Changes:
    new = {"status": F.lit("Paid"), "amount_paid": F.col("total_amount"), **stamped(as_of)}
    return stamp_keys(t.invoices, t.invoice_paid_feed, new, not_found=missing("Invoice"))


def bills_paid(t, as_of) -> Changes:
    new = {"status": F.lit("Paid"), "amount_paid": F.col("total_amount")}
    return stamp_keys(t.bills, t.bill_paid_feed, new, not_found=missing("Bill"))


def upsert_products(t) -> DataFrame:
    return upsert_rows(t.products, t.product_upsert_feed)


def upsert_roles(roles: DataFrame, catalogue: DataFrame, as_of: datetime.datetime) -> DataFrame:
    """Keep a stored role table in line with the catalogue; roles of its own stay."""
    feed = catalogue.select(
        F.lit(0).alias("seq"), "id", "name", "permissions",
        cleaning.instant(as_of).alias("updated_at"),
    )
    return upsert_rows(roles, feed)


# How the changed rows are shown again, where they are shown with more than their own columns.
def enriched(entity: str, changed: DataFrame, t) -> DataFrame:
    views = {
        "opportunity": crm.with_customer, "quotation": crm.with_customer,
        "pricing_rule": crm.with_product, "leave": hr.with_requester, "review": hr.with_people,
        "applicant": hr.with_posting, "purchase_order": scm.with_supplier_only,
    }
    return views[entity](changed, t) if entity in views else changed
