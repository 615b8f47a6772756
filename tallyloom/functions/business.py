"""Business scalar expressions: depreciation, roles, categories, codes, labels."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyloom.functions.cleaning import text_or_null
from tallyloom.sources import roles

# Accepted members of each vocabulary, in the order messages list them.
CUSTOMER_STATUSES = ["Lead", "Active", "Inactive", "Churned"]
OPPORTUNITY_STAGES = [
    "Lead", "Qualified", "Proposal", "Negotiation", "Closed Won", "Closed Lost",
]
QUOTATION_STATUSES = ["Draft", "Sent", "Accepted", "Expired", "Rejected"]
ASSET_CATEGORIES = ["Vehicle", "Machinery", "IT Equipment", "HVAC", "Facility"]
ASSET_STATUSES = ["Operational", "Degraded", "Under Repair", "Decommissioned"]
INVOICE_STATUSES = ["Draft", "Unpaid", "Partial", "Paid", "Overdue", "Cancelled"]
PAYMENT_METHODS = ["Bank Transfer", "Credit Card", "Cash", "Mobile Money", "M-Pesa", "Check"]
LEAVE_STATUSES = ["Pending", "Approved", "Rejected"]
JOB_STATUSES = ["Draft", "Open", "Closed", "On Hold"]
APPLICANT_STAGES = ["Applied", "Screening", "Interviewing", "Offered", "Hired", "Rejected"]
TRAINING_STATUSES = ["Scheduled", "In Progress", "Completed", "Cancelled"]
PAYROLL_STATUSES = ["Draft", "In Progress", "Completed", "Cancelled"]
SALES_ORDER_STATUSES = ["Draft", "Confirmed", "Shipped", "Cancelled"]
VENDOR_STATUSES = ["Active", "On Hold", "Terminated"]
PURCHASE_ORDER_STATUSES = ["Draft", "Submitted", "Partially Received", "Received", "Cancelled"]
MOVEMENT_TYPES = ["Receiving", "Putaway", "Transfer", "Picking", "Shipping", "Adjustment"]

# Other spellings of an asset category, lower case.
CATEGORY_ALIASES = {
    "tech": "IT Equipment",
    "technology": "IT Equipment",
    "it": "IT Equipment",
    "it equipment": "IT Equipment",
    "information technology": "IT Equipment",
}


def lookup(values: dict, key: Column) -> Column:
    """Constant dictionary lookup, NULL when absent."""
    table = F.create_map(*[F.lit(each) for each in chain.from_iterable(values.items())])
    return F.try_element_at(table, key)


def asset_category(text: Column) -> Column:
    raw = text_or_null(text)
    return F.coalesce(lookup(CATEGORY_ALIASES, F.lower(raw)), raw)


def asset_status(text: Column) -> Column:
    return F.coalesce(text_or_null(text), F.lit("Operational"))


def payment_method(text: Column) -> Column:
    return F.when(text == "M-Pesa", F.lit("Mobile Money")).otherwise(text)


def canonical_role(text: Column) -> Column:
    """Canonical role of a role name or alias in any case; NULL when unknown."""
    spelling = {name.lower(): name for name in roles.CANONICAL_ROLES}
    return lookup({**roles.ROLE_ALIASES, **spelling}, F.lower(text_or_null(text)))


def preferred_role_id(canonical: Column) -> Column:
    ids = {name: roles.preferred_id(name) for name in roles.CANONICAL_ROLES}
    return lookup(ids, canonical).cast("bigint")


def yearly_depreciation(cost: Column, salvage: Column, years: Column) -> Column:
    """Straight line over the useful life, NULL for a life of zero."""
    loss = cost - F.coalesce(salvage, F.lit(0).cast("decimal(18,2)"))
    return F.round(F.try_divide(loss, years.cast("decimal(10,0)")), 2).cast("decimal(18,2)")


def sku_base(name: Column) -> Column:
    """Up to twelve characters of upper-case letters, digits and dashes; PRD when none."""
    dashed = F.regexp_replace(F.upper(name), "[^A-Z0-9]+", "-")
    return F.coalesce(
        F.nullif(F.substring(F.btrim(dashed, F.lit("-")), 1, 12), F.lit("")), F.lit("PRD")
    )


def generated_sku(name: Column, request_id: Column) -> Column:
    """SKU base plus the request id, so that a retried task yields the same code."""
    return F.concat_ws("-", sku_base(name), F.lpad(F.abs(request_id).cast("string"), 9, "0"))


def month_start(day: Column) -> Column:
    return F.trunc(day, "month")


def month_label(day: Column) -> Column:
    return F.date_format(day, "MMM yyyy")
