"""Inventory and warehouse reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.operators.listing import down, listing, lookup, up

MONEY = "decimal(18,2)"


def categories(t) -> DataFrame:
    return listing(t.categories, [up("id")])


def products(t) -> DataFrame:
    return listing(t.products, [up("name"), up("id")])


def storage_bins(t) -> DataFrame:
    return listing(t.storage_bins, [up("id")])


def warehouse_bins(t, keys: DataFrame) -> DataFrame:
    """Bins of the warehouses in a key set."""
    return listing(lookup(t.storage_bins, keys, "warehouse_id"), [up("warehouse_id"), up("id")])


def alerts(t) -> DataFrame:
    low = t.products.filter(
        F.col("reorder_point").isNotNull() & (F.col("stock_quantity") <= F.col("reorder_point"))
    )
    return listing(
        low, [up("stock_quantity"), up("name"), up("id")],
        ["id", "sku", "name", "unit_price", "cost_price", "stock_quantity", "reorder_point",
         "optimal_reorder_quantity"],
    )


def available_stock(t) -> DataFrame:
    """Remaining quantity and value per product over Available batches, one shuffle."""
    worth = F.col("quantity_remaining") * F.col("unit_cost")
    return t.inventory_batches.filter(F.col("status") == "Available").groupBy("product_id").agg(
        F.sum("quantity_remaining").alias("quantity"), F.sum(worth).alias("worth")
    )


def valuation(t) -> DataFrame:
    """Every product with its Available stock, zero where there is none. Batches are summed
    before they meet the products, so only one row per product is joined."""
    joined = t.products.select("id", "sku", "name").join(
        available_stock(t), F.col("id") == F.col("product_id"), "left"
    ).select(
        "id", "sku", "name",
        F.coalesce("quantity", F.lit(0)).cast("bigint").alias("total_remaining_quantity"),
        F.coalesce("worth", F.lit(0)).cast(MONEY).alias("total_valuation"),
    )
    return listing(joined, [down("total_valuation"), up("name"), up("id")])


def inventory_value(t) -> DataFrame:
    """Value of all Available stock of known products."""
    known = available_stock(t).join(
        t.products.select(F.col("id").alias("product_id")), "product_id", "left_semi"
    )
    return known.agg(F.coalesce(F.sum("worth"), F.lit(0)).cast(MONEY).alias("inventory_value"))


def forecast(t) -> DataFrame:
    """Lifetime units sold per product and the stock left at that pace.

    The ratio is rounded in whole numbers, halves away from zero, so it cannot drift; the
    sort uses the unrounded ratio.
    """
    sold = t.order_lines.groupBy("product_id").agg(F.sum("quantity").alias("units"))
    joined = t.products.select("id", F.col("name").alias("product_name"), "stock_quantity").join(
        sold, F.col("id") == F.col("product_id"), "left"
    ).withColumn("velocity", F.coalesce("units", F.lit(0)).cast("bigint"))
    stock, pace = F.col("stock_quantity").cast("decimal(20,0)"), F.col("velocity")
    ratio = F.when(pace > 0, F.try_divide(stock, pace.cast("decimal(20,0)")))
    tenths = F.floor(F.try_divide(F.abs(stock) * 20 + pace, (pace * 2).cast("decimal(20,0)")))
    signed = (F.signum(stock).cast("int") * tenths.cast("decimal(17,0)")) / 10
    days = F.when(pace > 0, signed.cast("decimal(18,1)"))
    ranked = joined.withColumn("__ratio", ratio).select(
        "id", "product_name", "stock_quantity", "velocity",
        days.alias("days_until_stockout"), "__ratio",
    )
    return listing(ranked, [up("__ratio"), up("product_name"), up("id")]).drop("__ratio")


def warehouses(t) -> DataFrame:
    managers = t.users.select(F.col("id").alias("manager_id"), "first_name", "last_name")
    return listing(t.warehouses.join(managers, "manager_id", "left"), [up("name"), up("id")])


def bin_contents(t, keys: DataFrame | None = None) -> DataFrame:
    """What lies in each bin, for all warehouses or a key set; bins are cut down first."""
    bins = t.storage_bins if keys is None else lookup(t.storage_bins, keys, "warehouse_id")
    bins = bins.select(
        F.col("id").alias("bin_id"), "warehouse_id", "zone", F.col("barcode").alias("bin_barcode"),
        "max_weight",
    )
    goods = t.products.select(
        F.col("id").alias("product_id"), F.col("sku").alias("product_sku"),
        F.col("name").alias("product_name"), F.col("description").alias("product_description"),
        "unit_price", "stock_quantity",
    )
    joined = t.bin_inventory.join(bins, "bin_id").join(goods, "product_id")
    return listing(joined, [up("warehouse_id"), up("zone"), up("product_name"), up("id")])
