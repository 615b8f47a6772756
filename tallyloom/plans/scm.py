"""Purchasing reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.operators.listing import down, listing, up


def vendors(t) -> DataFrame:
    return listing(
        t.suppliers, [up("company_name"), up("id")],
        ["id", F.col("company_name").alias("name"), "email", "payment_terms", "status",
         "created_at", "updated_at"],
    )


def shipments(t) -> DataFrame:
    return listing(t.shipments, [up("estimated_arrival"), up("id")])


def _names_by_id(orders: DataFrame, t) -> DataFrame:
    """Orders with both possible names; the orders are joined directly to one plain table
    after the other, so that a supplier with very many orders can be split."""
    suppliers = t.suppliers.select(
        F.col("id").alias("supplier_id"), F.col("company_name").alias("__supplier"),
        F.lit(True).alias("__known"),
    )
    vendor_names = t.vendors.select(
        F.col("id").alias("supplier_id"), F.col("name").alias("__vendor")
    )
    return orders.join(suppliers, "supplier_id", "left").join(vendor_names, "supplier_id", "left")


def with_supplier(orders: DataFrame, t) -> DataFrame:
    """The supplier's name, else the vendor's name under the same id."""
    name = F.coalesce("__supplier", "__vendor")
    return _names_by_id(orders, t).select(*orders.columns, name.alias("supplier_name"))


def with_supplier_only(orders: DataFrame, t) -> DataFrame:
    """The same name for suppliers; an id that is only a vendor has none here."""
    name = F.when(F.col("__known"), F.coalesce("__supplier", "__vendor"))
    return _names_by_id(orders, t).select(*orders.columns, name.alias("supplier_name"))


def purchase_orders(t) -> DataFrame:
    return listing(with_supplier(t.purchase_orders, t), [down("created_at"), down("id")])
