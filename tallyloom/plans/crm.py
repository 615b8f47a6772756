"""CRM reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.operators.documents import children_of, with_count
from tallyloom.operators.listing import down, listing, up


def customers(t) -> DataFrame:
    return listing(t.customers, [down("id")])


def with_customer(rows: DataFrame, t) -> DataFrame:
    """Opportunities or quotations with the customer's name, kept when unknown."""
    names = t.customers.select(
        F.col("id").alias("customer_id"), F.col("company_name").alias("customer_name")
    )
    return rows.join(names, "customer_id", "left")


def opportunities(t) -> DataFrame:
    return listing(with_customer(t.opportunities, t), [up("expected_close_date"), down("id")])


def quotations(t) -> DataFrame:
    return listing(with_customer(t.quotations, t), [down("created_at"), down("id")])


def with_product(rules: DataFrame, t) -> DataFrame:
    names = t.products.select(F.col("id").alias("product_id"), F.col("name").alias("product_name"))
    return rules.join(names, "product_id", "left")


def pricing_rules(t) -> DataFrame:
    return listing(with_product(t.pricing_rules, t), [up("rule_name"), up("id")])


def customer_documents(t) -> DataFrame:
    """Each customer with the number of its opportunities and of its quotations."""
    counted = with_count(t.customers, t.opportunities, "customer_id", "opportunity_count")
    return with_count(counted, t.quotations, "customer_id", "quotation_count")


def customer_opportunities(t) -> DataFrame:
    return children_of(
        t.customers, t.opportunities, "customer_id",
        ["id", "title", "stage", "estimated_value", "expected_close_date"],
        [up("expected_close_date")],
    )


def customer_quotations(t) -> DataFrame:
    return children_of(
        t.customers, t.quotations, "customer_id",
        ["id", "quote_number", "valid_until", "status", "total_amount", "created_at"],
        [down("created_at")],
    )
