"""Bulk intake: the rules of every kind of new row, and the jobs that apply them."""

from __future__ import annotations

import datetime
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.functions import business as b
from tallyloom.functions import cleaning
from tallyloom.functions import fields as f
from tallyloom.functions import reasons
from tallyloom.operators.validate import (
    Field, Reference, Rule, Unique, cleaned, parsed, validate,
)
from tallyloom.sources import roles


def customer_fields() -> list[Field]:
    optional = ["industry", "primary_contact_name", "primary_email", "primary_phone",
                "billing_address", "shipping_address"]
    return [
        f.required_text("company_name"), *[f.optional_text(c) for c in optional],
        f.choice("status", b.CUSTOMER_STATUSES, default="Lead"),
    ]


def customers(t) -> DataFrame:
    return validate(t.customer_feed, customer_fields())


def opportunities(t) -> DataFrame:
    return validate(t.opportunity_feed, [
        f.whole_number("customer_id", reasons.positive_integer("customer_id")),
        f.required_text("title"),
        f.choice("stage", b.OPPORTUNITY_STAGES),
        f.amount("estimated_value", reasons.valid_amount("estimated_value")),
        f.date("expected_close_date"),
    ])


def quotations(t) -> DataFrame:
    return validate(t.quotation_feed, [
        f.whole_number("customer_id", reasons.positive_integer("customer_id")),
        f.required_text("quote_number"),
        f.date("valid_until"),
        f.choice("status", b.QUOTATION_STATUSES, default="Draft"),
        f.amount("total_amount", reasons.valid_amount("total_amount")),
    ])


def pricing_rule_fields(active_by_default: bool = True) -> list[Field]:
    return [
        f.required_text("rule_name"),
        f.whole_number("product_id", reasons.positive_integer("product_id")),
        f.whole_number("min_quantity", reasons.positive_integer("min_quantity")),
        f.amount(
            "discount_percentage", reasons.valid_amount("discount_percentage"), at_most=100,
            too_big=reasons.DISCOUNT_RANGE,
        ),
        f.flag("is_active", default=active_by_default),
    ]


def pricing_rules(t) -> DataFrame:
    return validate(t.pricing_rule_feed, pricing_rule_fields())


def invoices(t, as_of: datetime.date) -> DataFrame:
    rules = [
        f.required_text("invoice_number"),
        f.whole_number("order_id", reasons.positive_integer("order_id"), optional=True),
        f.date("invoice_date", default=F.lit(as_of), strict=True),
        f.date("due_date", required=True, strict=True),
        f.amount("subtotal", reasons.zero_or_greater("subtotal"), zero_if_blank=True),
        f.amount("tax_amount", reasons.zero_or_greater("tax_amount"), zero_if_blank=True),
        f.exact_choice("status", b.INVOICE_STATUSES, default="Unpaid"),
    ]
    return validate(
        t.invoice_feed, rules,
        references=[Reference("order_id", t.sales_orders, reasons.FINANCE_KEY)],
        unique=Unique(("invoice_number",), t.invoices, reasons.FINANCE_TWIN),
    )


def account_fields() -> list[Field]:
    return [f.required_text("account_code"), f.required_text("name"), f.required_text("type")]


def accounts(t) -> DataFrame:
    return validate(
        t.account_feed, [*account_fields(), f.flag("is_active", default=True)],
        unique=Unique(("account_code",), t.accounts, reasons.FINANCE_TWIN),
    )


def asset_category() -> Field:
    value = cleaned("category")
    return Field("category", b.asset_category(F.col("category")), (
        Rule(value.isNull(), reasons.required("category")),
        Rule(~value.isin(b.ASSET_CATEGORIES), reasons.one_of("category", b.ASSET_CATEGORIES)),
    ))


def asset_status() -> Field:
    return Field("status", b.asset_status(F.col("status")), (
        Rule(~cleaned("status").isin(b.ASSET_STATUSES), reasons.one_of("status", b.ASSET_STATUSES)),
    ), members=tuple(b.ASSET_STATUSES))


def asset_fields() -> list[Field]:
    """In the order the rules are judged."""
    return [
        asset_category(),
        f.amount("initial_cost", reasons.MONEY, negative=True, zero_if_blank=True),
        asset_status(),
        f.required_text("asset_tag"),
        f.required_text("name"),
        f.date("purchase_date", required=True),
        f.whole_number("useful_life_years", reasons.positive_integer("useful_life_years")),
    ]


def assets(t) -> DataFrame:
    return validate(
        t.asset_feed, asset_fields(), unique=Unique(("asset_tag",), t.assets, reasons.FINANCE_TWIN)
    )


def budget_fields() -> list[Field]:
    return [
        f.amount("allocated_amount", reasons.MONEY, negative=True, zero_if_blank=True),
        f.amount("spent_amount", reasons.MONEY, negative=True, zero_if_blank=True),
        f.required_text("department"),
        f.required_text("fiscal_year"),
    ]


def budgets(t) -> DataFrame:
    return validate(t.budget_feed, budget_fields())


def tax_payments(t) -> DataFrame:
    return validate(t.tax_payment_feed, [
        f.amount("amount_paid", reasons.MONEY, negative=True),
        f.plain_text("tax_period"), f.date("payment_date"), f.plain_text("reference_number"),
    ])


def bills(t) -> DataFrame:
    money = [f.amount(c, reasons.MONEY, negative=True, zero_if_blank=True)
             for c in ("total_amount", "amount_paid", "tax_amount")]
    return validate(
        t.bill_feed,
        [
            *money,
            f.whole_number("vendor_id", reasons.VENDOR_ID),
            f.date("issue_date", required=True),
            f.date("due_date", required=True),
            Field("status", F.coalesce(cleaning.text_or_null(F.col("status")), F.lit("Draft"))),
        ],
        references=[Reference("vendor_id", t.vendors, reasons.FINANCE_KEY)],
    )


def payroll_runs(t, as_of: datetime.date) -> DataFrame:
    money = [f.amount(c, reasons.invalid_amount(c), negative=True)
             for c in ("total_gross", "total_taxes", "total_net")]
    return validate(t.payroll_feed, [
        f.required_text("pay_period"), *money,
        Field("run_date", F.lit(as_of)), Field("status", F.lit("Draft")),
    ])


def review_rating() -> Field:
    return f.whole_number("rating", reasons.RATING, high=5)


def performance_reviews(t, as_of: datetime.date) -> DataFrame:
    return validate(t.review_feed, [
        f.whole_number("employee_id", reasons.REVIEWED_USER),
        f.whole_number("reviewer_id", reasons.required("reviewer_id")),
        review_rating(),
        f.optional_text("comments"),
        Field("review_date", F.lit(as_of)),
    ])


def job_postings(t, as_of: datetime.date) -> DataFrame:
    return validate(t.job_feed, [
        f.required_text("title"), f.required_text("department"),
        f.required_text("employment_type", default="Full-Time"),
        f.choice("status", b.JOB_STATUSES, default="Open"),
        f.date("posted_date", default=F.lit(as_of)),
    ])


def applicants(t, as_of: datetime.date) -> DataFrame:
    return validate(t.applicant_feed, [
        f.whole_number("job_posting_id", reasons.POSTING_ID),
        f.required_text("first_name"), f.required_text("last_name"), f.required_text("email"),
        f.choice("pipeline_stage", b.APPLICANT_STAGES, default="Applied"),
        f.date("application_date", default=F.lit(as_of)),
    ])


def training_programs(t) -> DataFrame:
    """Nothing is rejected but an unreadable date: a blank title is stored as ''."""
    title = F.coalesce(cleaning.trimmed(F.col("title")), F.lit(""))
    return validate(t.training_feed, [
        Field("title", title), f.optional_text("description"), f.optional_text("trainer_name"),
        f.date("scheduled_date"),
    ])


def vendor_fields() -> list[Field]:
    optional = ["contact_name", "email", "phone", "payment_terms"]
    return [f.required_text("company_name"), *[f.optional_text(c) for c in optional]]


def vendors(t) -> DataFrame:
    return validate(t.vendor_feed, [*vendor_fields(), Field("status", F.lit("Active"))])


def whitelist(entity: str, fields: list[Field]) -> list[Field]:
    """Prefix the rule that at least one allowed field must be given."""
    nothing = F.coalesce(*[F.col(each.name) for each in fields]).isNull()
    empty = Rule(nothing, reasons.no_valid_fields(entity))
    return [replace(fields[0], rules=(empty, *fields[0].rules)), *fields[1:]]


def categories(t) -> DataFrame:
    return validate(t.category_feed, whitelist(
        "categories", [f.plain_text("name"), f.plain_text("description")]
    ))


def warehouse_fields() -> list[Field]:
    return [
        f.required_text("name"), f.required_text("location_address"),
        f.whole_number("manager_id", reasons.positive_integer("manager_id"), optional=True),
        f.flag("is_active"),
    ]


def warehouses(t) -> DataFrame:
    return validate(t.warehouse_feed, warehouse_fields())


def stored_number(name: str, kind: str) -> Field:
    """No rule of its own, but the column it is stored in only takes numbers."""
    read = cleaning.integer if kind == "bigint" else cleaning.number
    bad = Rule(F.col(name).isNotNull() & cleaned(name).isNull(), reasons.a_number(name))
    return Field(name, parsed(name).try_cast(kind), (), (bad,), parse=read(F.col(name)))


def storage_bin_fields() -> list[Field]:
    return [
        stored_number("warehouse_id", "bigint"), f.plain_text("zone"), f.plain_text("barcode"),
        stored_number("max_weight", "decimal(18,2)"),
    ]


def storage_bins(t) -> DataFrame:
    return validate(t.storage_bin_feed, whitelist("storage_bins", storage_bin_fields()))


def products(t) -> DataFrame:
    rules = [
        stored_number("category_id", "bigint"), f.plain_text("sku"), f.plain_text("name"),
        f.plain_text("description"), stored_number("unit_price", "decimal(18,2)"),
        stored_number("cost_price", "decimal(18,2)"), stored_number("stock_quantity", "bigint"),
    ]
    return validate(
        t.product_feed, whitelist("products", rules),
        unique=Unique(("sku",), t.products, reasons.INVENTORY_TWIN),
    )


def new_products(t) -> DataFrame:
    """The product form: one price for both price columns, a generated SKU."""
    name = cleaning.text_or_null(F.col("name"))
    price = f.amount("unit_price", reasons.zero_or_greater("price"), source="price")
    return validate(t.new_product_feed, [
        f.required_text("name"),
        price,
        replace(price, name="cost_price", value=cleaning.cents(parsed("unit_price")), rules=(),
                parse=None),
        f.whole_number(
            "stock_quantity", reasons.zero_or_greater("stock_quantity"), low=0, default=0
        ),
        Field("sku", b.generated_sku(name, F.col("request_id"))),
    ])


def employee_fields() -> list[Field]:
    role, role_id = F.col("role"), parsed("role_id")
    salary = f.amount("base_salary", reasons.zero_or_greater("base_salary"), optional=True)
    named = b.preferred_role_id(b.canonical_role(role))
    return [
        Field("username", cleaning.text_or_null(F.col("username")), (
            Rule(F.coalesce(F.length(cleaned("username")), F.lit(0)) < 3,
                 reasons.required("username")),)),
        Field("__password", F.lit(None).cast("string"), (
            Rule(F.coalesce(F.length("password"), F.lit(0)) < 8,
                 reasons.PASSWORD),)),
        Field("email", cleaning.trimmed(F.col("email")), (
            Rule(~F.coalesce(cleaning.is_email(cleaned("email")), F.lit(False)),
                 reasons.EMAIL),)),
        f.required_text("first_name"),
        f.required_text("last_name"),
        f.date("hire_date", required=True, strict=True),
        Field("role_id", F.when(role.isNotNull(), named).otherwise(role_id), (
            Rule(role.isNotNull() & ~role.isin(roles.CANONICAL_ROLES),
                 reasons.one_of("role", roles.CANONICAL_ROLES)),
            Rule(F.col("role_id").isNotNull() & (role_id.isNull() | (role_id < 1)),
                 reasons.positive_integer("role_id")),),
            parse=cleaning.integer(F.col("role_id"))),
        f.whole_number("department_id", reasons.positive_integer("department_id"),
                       optional=True),
        f.optional_text("job_title"),
        # A salary of zero is stored as unknown.
        replace(salary, value=F.nullif(salary.value, F.lit(0)), rules=(
            Rule(F.col("base_salary").isNotNull()
                 & (parsed("base_salary").isNull() | (parsed("base_salary") < 0)),
                 reasons.zero_or_greater("base_salary")),)),
        f.flag("is_active", default=True),
        Field("__role", role, (Rule(role.isNull() & role_id.isNull(), reasons.required("role")),)),
    ]


def employees(t) -> DataFrame:
    """Registrations, checked; ``users`` and ``employees`` rows come from ``split_staff``."""
    checked = validate(
        t.employee_feed, employee_fields(),
        references=[
            Reference("role_id", t.roles, reasons.HR_KEY),
            Reference("department_id", t.departments, reasons.HR_KEY),
        ],
        unique=Unique(("username", "email"), t.users, reasons.HR_TWIN),
    )
    return checked.drop("__password", "__role")


def split_staff(accepted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """New users and employees of accepted registrations; passwords are not kept."""
    users = accepted.select(
        F.col("request_id").alias("id"), "username", "email", "role_id", "is_active"
    )
    staff = accepted.select(
        F.col("request_id").alias("id"), F.col("request_id").alias("user_id"), "first_name",
        "last_name", "department_id", "job_title", "hire_date", "base_salary",
    )
    return users, staff


def movement_fields(as_of: datetime.datetime) -> list[Field]:
    from_bin, to_bin = F.col("from_bin_id"), F.col("to_bin_id")
    when = f.moment("movement_date", default=cleaning.instant(as_of))
    nowhere = Rule(
        from_bin.isNull() & to_bin.isNull(),
        reasons.NO_BIN,
    )

    def optional_id(name: str) -> Field:
        return f.whole_number(name, reasons.positive_integer(name), optional=True)

    return [
        f.whole_number("product_id", reasons.required("product_id")),
        optional_id("from_bin_id"), optional_id("to_bin_id"),
        f.whole_number("quantity", reasons.greater_than_zero("quantity")),
        Field("movement_type", F.col("movement_type"), (Rule(
            ~F.coalesce(F.col("movement_type"), F.lit("")).isin(b.MOVEMENT_TYPES),
            reasons.MOVEMENT_TYPE),)),
        optional_id("moved_by"), f.optional_text("reference_type"), optional_id("reference_id"),
        replace(when, rules=(*when.rules, nowhere)),
    ]


def movements(t, as_of: datetime.datetime, feed: DataFrame | None = None) -> DataFrame:
    """Stock movements; the same rules serve the batch and the stream."""
    return validate(
        t.movement_feed if feed is None else feed, movement_fields(as_of),
        references=[
            Reference("product_id", t.products, reasons.WMS_KEY),
            Reference("from_bin_id", t.storage_bins, reasons.WMS_KEY),
            Reference("to_bin_id", t.storage_bins, reasons.WMS_KEY),
            Reference("moved_by", t.employees, reasons.WMS_KEY),
        ],
    )
