"""Finance reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.business import yearly_depreciation
from tallyloom.operators.documents import children_of, with_count
from tallyloom.operators.listing import down, listing, one_row, up

MONEY = "decimal(18,2)"


def total(df: DataFrame, column: str, name: str) -> DataFrame:
    """One row: the column's sum, zero when there is nothing to add."""
    return df.agg(F.coalesce(F.sum(column), F.lit(0)).cast(MONEY).alias(name))


def accounts(t) -> DataFrame:
    return listing(t.accounts, [up("account_code"), up("id")])


def budgets(t) -> DataFrame:
    return listing(t.budgets, [down("allocated_amount"), up("id")])


def tax_payments(t) -> DataFrame:
    return listing(t.tax_payments, [down("payment_date"), down("id")])


def assets(t) -> DataFrame:
    return listing(
        t.assets, [down("purchase_date"), up("id")],
        ["id", "asset_tag", "name", "category", "purchase_date", "initial_cost", "salvage_value",
         "useful_life_years", "status",
         yearly_depreciation(
             F.col("initial_cost"), F.col("salvage_value"), F.col("useful_life_years")
         ).alias("annual_depreciation")],
    )


def receivables(t) -> DataFrame:
    """Invoices whose order and customer are known."""
    owners = t.sales_orders.select(F.col("id").alias("order_id"), "customer_id")
    names = t.customers.select(
        F.col("id").alias("customer_id"), F.col("company_name").alias("customer_name")
    )
    joined = t.invoices.select(
        "id", "invoice_number", "total_amount", "amount_paid", "due_date", "status", "order_id"
    ).filter(F.col("order_id").isNotNull()).join(owners, "order_id").join(names, "customer_id")
    return listing(joined.drop("order_id", "customer_id"), [up("due_date"), up("id")])


def payables(t) -> DataFrame:
    names = t.vendors.select(F.col("id").alias("vendor_id"), F.col("name").alias("vendor_name"))
    joined = t.bills.select(
        "id", "total_amount", "amount_paid", "status", "due_date", "vendor_id"
    ).join(names, "vendor_id")
    return listing(joined.drop("vendor_id"), [up("due_date"), up("id")])


def journal_lines(t) -> DataFrame:
    chart = t.accounts.select(
        F.col("id").alias("account_id"), "account_code", F.col("name").alias("account_name"),
        F.col("type").alias("account_type"),
    )
    return t.journal_entry_lines.join(chart, "account_id", "left")


def journal_totals(t) -> DataFrame:
    return t.journal_entry_lines.groupBy("journal_entry_id").agg(
        F.sum("debit").cast(MONEY).alias("total")
    )


def journal_entries(t) -> DataFrame:
    """Entries that have lines, with their debit total; lines are summed before the join."""
    heads = t.journal_entries.select(
        "id", "entry_date", "description", "reference_type", "reference_id"
    )
    joined = heads.join(journal_totals(t), F.col("id") == F.col("journal_entry_id"))
    return listing(joined.drop("journal_entry_id"), [down("entry_date"), down("id")])


def unreversed_entries(t) -> DataFrame:
    """Entries nobody has reversed yet."""
    reversals = t.journal_entries.filter(
        (F.col("reference_type") == "JournalReversal") & F.col("reference_id").isNotNull()
    ).select(F.col("reference_id").alias("id")).distinct()
    return t.journal_entries.join(reversals, "id", "left_anti").select(
        "id", "entry_date", "description"
    )


def journal_documents(t) -> DataFrame:
    """Each entry with its number of lines."""
    return with_count(t.journal_entries, t.journal_entry_lines, "journal_entry_id", "line_count")


def journal_document_lines(t) -> DataFrame:
    """The lines of stored entries with their accounts, by line id."""
    return children_of(
        t.journal_entries, journal_lines(t), "journal_entry_id",
        ["id", "account_id", "debit", "credit", "account_code", "account_name", "account_type"],
    )


def tax_summary(t) -> DataFrame:
    sums = one_row(
        total(t.invoices, "tax_amount", "tax_collected"),
        total(t.bills, "tax_amount", "tax_paid"),
        total(t.tax_payments, "amount_paid", "total_remitted"),
    )
    net = F.col("tax_collected") - F.col("tax_paid") - F.col("total_remitted")
    return sums.withColumn("net_liability", net.cast(MONEY))


def payments_per_invoice(t) -> DataFrame:
    return t.payments.groupBy("invoice_id").agg(
        F.sum("amount_paid").cast(MONEY).alias("paid_total"),
        F.count(F.lit(1)).alias("payment_count"),
        F.max("payment_date").alias("last_payment"),
    )
