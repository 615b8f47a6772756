"""Sales reports and order documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.operators.documents import children_of, with_count
from tallyloom.operators.listing import down, listing, lookup, up

MONEY = "decimal(18,2)"


def customer_names(t) -> DataFrame:
    return listing(
        t.customers, [up("company_name"), up("id")], ["id", F.col("company_name").alias("name")]
    )


def invoice_recipients(t, keys: DataFrame) -> DataFrame:
    return lookup(t.customers, keys).select(
        "id", F.col("company_name").alias("name"), F.col("primary_email").alias("email")
    )


def orders_with_customer(t, *extra: str, orders: DataFrame | None = None) -> DataFrame:
    owners = t.customers.select(
        F.col("id").alias("customer_id"), F.col("company_name").alias("customer_company_name"),
        *extra,
    )
    columns = ["id", "customer_id", "order_date", "status", "total_amount", "created_at",
               "updated_at"]
    orders = t.sales_orders if orders is None else orders
    return orders.select(*columns).join(owners, "customer_id")


def sales_orders(t) -> DataFrame:
    return listing(orders_with_customer(t), [down("created_at"), down("id")])


def lines_with_product(t) -> DataFrame:
    names = t.products.select(
        F.col("id").alias("product_id"), F.col("sku").alias("product_sku"),
        F.col("name").alias("product_name"),
    )
    return t.order_lines.join(names, "product_id")


def order_documents(t, orders: DataFrame | None = None) -> DataFrame:
    """Each order of a known customer with its customer's contact and its number of lines."""
    heads = orders_with_customer(t, "primary_contact_name", "primary_email", orders=orders)
    return with_count(heads, lines_with_product(t), "order_id", "line_count")


def order_document_lines(t, orders: DataFrame | None = None) -> DataFrame:
    """The lines of those orders, by line id."""
    return children_of(
        orders_with_customer(t, orders=orders), lines_with_product(t), "order_id",
        ["id", "line_number", "product_id", "quantity", "unit_price", "subtotal", "created_at",
         "product_sku", "product_name"],
    )


def line_total():
    """A line's subtotal, or quantity times price where none is stored."""
    return F.coalesce(F.col("subtotal"), (F.col("quantity") * F.col("unit_price")).cast(MONEY))


def invoice_totals(t) -> DataFrame:
    """Grand total and line count per order; lines of unknown products do not count."""
    known = t.order_lines.join(
        t.products.select(F.col("id").alias("product_id")), "product_id", "left_semi"
    )
    return known.groupBy("order_id").agg(
        F.sum(line_total()).cast(MONEY).alias("grand_total"),
        F.count(F.lit(1)).alias("line_count"),
    )


def invoice_documents(t) -> DataFrame:
    """What an order's invoice shows; orders without an e-mail address come out as skipped."""
    heads = orders_with_customer(t, "primary_email").select(
        "id", F.coalesce("order_date", "created_at").alias("date"),
        F.col("customer_company_name").alias("customer_name"),
        F.col("primary_email").alias("email"),
    )
    totals = invoice_totals(t)
    # An address of "" counts as missing, as does NULL.
    reachable = F.coalesce(F.col("email"), F.lit("")) != ""
    return heads.join(totals, F.col("id") == F.col("order_id"), "left").select(
        "id", "date", "customer_name", "email",
        F.coalesce("line_count", F.lit(0)).alias("line_count"),
        F.coalesce("grand_total", F.lit(0).cast(MONEY)).alias("grand_total"),
        F.when(reachable, F.lit("ready")).otherwise(F.lit("skipped")).alias("delivery"),
    )


def invoice_document_lines(t) -> DataFrame:
    """The lines of every invoice that has somewhere to go."""
    ready = orders_with_customer(t, "primary_email").filter(
        F.coalesce(F.col("primary_email"), F.lit("")) != ""
    )
    return lines_with_product(t).join(
        ready.select(F.col("id").alias("order_id")), "order_id", "left_semi"
    ).select(
        "order_id", "line_number", "product_id", "quantity", "unit_price",
        line_total().alias("line_total"),
    )
