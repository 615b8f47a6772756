"""Posting jobs: sales orders, purchase orders, journal entries, reversals, payments."""

from __future__ import annotations

import datetime
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.functions import business as b
from tallyloom.functions import cleaning
from tallyloom.functions import fields as f
from tallyloom.functions import reasons
from tallyloom.operators.posting import Documents, post_documents
from tallyloom.operators.validate import (
    REASON, Field, Rule, clean, cleaned, first_reason, flag_known, parsed,
)
from tallyloom.session import materialise

MONEY = "decimal(18,2)"


def sales_orders(t, as_of: datetime.datetime, headers=None, lines=None) -> Documents:
    """Orders with their lines; prices and totals are not rounded."""
    price = parsed("unit_price")
    exact_price = Field(
        "unit_price", price.try_cast("decimal(20,6)"),
        (Rule(price.isNull() | (price < 0), reasons.zero_or_greater("unit_price")),),
        parse=cleaning.number(F.col("unit_price")),
    )
    subtotal = F.col("quantity").cast("decimal(10,0)") * F.col("unit_price")
    return post_documents(
        t.sales_order_feed if headers is None else headers,
        t.sales_order_line_feed if lines is None else lines,
        [
            f.whole_number("customer_id", reasons.required("customer_id")),
            f.moment("order_date", default=cleaning.instant(as_of)),
            Field("status", F.coalesce(cleaning.trimmed(F.col("status")), F.lit("Draft")),
                  (Rule(cleaned("status") == "", reasons.ORDER_STATUS),)),
        ],
        [
            f.whole_number("product_id", reasons.required("product_id")),
            f.whole_number("quantity", reasons.ORDER_QUANTITY),
            exact_price,
        ],
        line_values={"subtotal": subtotal.cast("decimal(28,6)")},
        totals={"total_amount": F.sum("subtotal").cast("decimal(28,6)")},
        no_lines=reasons.NO_ORDER_LINES,
        unknown=reasons.not_found("Sales order"),
        line_key=("product_id", t.products, reasons.SALES_KEY),
        header_key=("customer_id", t.customers, reasons.SALES_KEY),
    )


def purchase_orders(t, headers=None, lines=None) -> Documents:
    """Purchase orders; each line is rounded, then the total. New orders are Submitted."""
    subtotal = (F.col("quantity_ordered").cast("decimal(10,0)") * F.col("unit_cost")).cast(MONEY)
    return post_documents(
        t.purchase_order_feed if headers is None else headers,
        t.purchase_order_line_feed if lines is None else lines,
        [
            f.required_text("po_number"),
            f.whole_number("supplier_id", reasons.SUPPLIER_ID),
            f.date("expected_delivery_date"),
            Field("status", F.lit("Submitted")),
        ],
        [
            f.amount("unit_cost", reasons.PURCHASE_COST),
            f.whole_number("product_id", reasons.PURCHASE_PRODUCT),
            f.whole_number("quantity_ordered", reasons.positive_integer("quantity_ordered")),
            Field("quantity_received", F.lit(0)),
        ],
        line_values={"subtotal": subtotal},
        totals={"total_amount": F.sum("subtotal").cast(MONEY)},
        no_lines=reasons.NO_PURCHASE_LINES,
        unknown=reasons.not_found("Purchase order"),
        numbered=True,
    )


def _balance_side(name: str) -> Field:
    return f.amount(name, reasons.zero_or_greater(name), zero_if_blank=True)


def journal_entries(t, headers=None, lines=None) -> Documents:
    """Double entry: debits equal credits, as given and after rounding each line."""
    differs = F.round("__raw_debit", 2) != F.round("__raw_credit", 2)
    empty_line = (F.col("debit") <= 0) & (F.col("credit") <= 0)
    return post_documents(
        t.journal_feed if headers is None else headers,
        t.journal_line_feed if lines is None else lines,
        [
            f.required_text("description"),
            f.date("entry_date", required=True, strict=True),
            Field("created_by", cleaning.integer(F.col("created_by"))),
        ],
        [
            f.whole_number("account_id", reasons.required("account_id")),
            _balance_side("debit"), _balance_side("credit"),
            Field("__rd", parsed("debit")), Field("__rc", parsed("credit")),
        ],
        line_values={"__void": empty_line},
        totals={
            "total_debit": F.sum("debit").cast(MONEY),
            "total_credit": F.sum("credit").cast(MONEY),
            "__raw_debit": F.sum("__rd"), "__raw_credit": F.sum("__rc"),
            "__any_void": F.max("__void"),
        },
        no_lines=reasons.TWO_JOURNAL_LINES,
        unknown=reasons.not_found("Journal entry"),
        least=2,
        document_rules=[
            Rule(differs | (F.col("total_debit") != F.col("total_credit")),
                 reasons.UNBALANCED),
            Rule(F.col("total_debit") <= 0, reasons.JOURNAL_TOTAL),
            Rule(F.col("__any_void"), reasons.EMPTY_JOURNAL_LINE),
        ],
        line_key=("account_id", t.accounts, reasons.FINANCE_KEY),
    )


def journal_headers(documents: Documents) -> DataFrame:
    return documents.headers.drop("__raw_debit", "__raw_credit", "__any_void")


def journal_lines(documents: Documents) -> DataFrame:
    return documents.lines().select("request_id", "line_no", "account_id", "debit", "credit")


def journal_balance(lines: DataFrame) -> DataFrame:
    """Per document: both sums, whether they agree at two places, whether a line is empty."""
    debit, credit = [cleaning.cents(cleaning.number_or_zero(F.col(c))) for c in ("debit", "credit")]
    sums = lines.filter(F.col("request_id").isNotNull()).groupBy("request_id").agg(
        F.sum(debit).cast(MONEY).alias("total_debit"),
        F.sum(credit).cast(MONEY).alias("total_credit"),
        F.max((debit <= 0) & (credit <= 0)).alias("has_empty_line"),
    )
    return sums.withColumn("balanced", F.col("total_debit") == F.col("total_credit"))


@dataclass(frozen=True)
class Reversals:
    """Judged requests, the new entries, and ``lines()``: the swapped lines."""

    requests: DataFrame
    entries: DataFrame
    stored_lines: DataFrame

    def lines(self) -> DataFrame:
        """Debit and credit change sides. What is to be reversed is written to the shared
        folder first, so that an entry with very many lines is split in the join."""
        wanted = materialise(
            self.entries.select(
                F.col("reference_id").alias("journal_entry_id"), F.col("id").alias("new_id")),
            "reversed",
        )
        return self.stored_lines.join(wanted, "journal_entry_id").select(
            F.col("new_id").alias("journal_entry_id"), "account_id",
            F.col("credit").alias("debit"), F.col("debit").alias("credit"),
        )


def reversals(t, as_of: datetime.date, feed: DataFrame | None = None) -> Reversals:
    """Reverse entries once: swap debit and credit of every line under a new entry.

    All is decided once per requested entry; only the earliest request of an entry can win.
    """
    feed = t.reversal_feed if feed is None else feed
    # Written first: the long line table is cut down to the wanted entries before its distinct.
    wanted = materialise(feed.filter(F.col("journal_entry_id").isNotNull()).groupBy(
        "journal_entry_id").agg(F.min("request_id").alias("__first")), "wanted")
    entries = t.journal_entries
    heads = entries.select(F.col("id").alias("journal_entry_id"),
                           F.col("description").alias("__text"), F.lit(True).alias("__found"))
    lined = t.journal_entry_lines.select("journal_entry_id").join(
        wanted, "journal_entry_id", "left_semi"
    ).distinct().withColumn("__lined", F.lit(True))
    done = entries.filter(
        (F.col("reference_type") == "JournalReversal") & F.col("reference_id").isNotNull()
    ).select(F.col("reference_id").alias("journal_entry_id")).distinct().withColumn(
        "__done", F.lit(True)
    )
    rules = [
        Rule(F.col("__found").isNull(), reasons.not_found("Journal entry")),
        Rule(F.col("__lined").isNull(), reasons.NOTHING_TO_REVERSE),
        Rule(F.col("__done").isNotNull(), reasons.ALREADY_REVERSED),
    ]
    # One row per entry, written first: an entry that very many requests name is then split
    # in the join, and all three results share the verdict.
    verdict = materialise(
        wanted.join(heads, "journal_entry_id", "left")
        .join(lined, "journal_entry_id", "left")
        .join(done, "journal_entry_id", "left")
        .select("journal_entry_id", "__first", "__text", first_reason(rules).alias("__verdict")),
        "reversals",
    )
    late = F.when(F.col("request_id") > F.col("__first"), F.lit(reasons.ALREADY_REVERSED))
    # A request without an entry id meets no verdict and is told so, not lost.
    unknown = F.when(F.col("__first").isNull(), F.lit(reasons.not_found("Journal entry")))
    requests = feed.join(verdict, "journal_entry_id", "left").withColumn(
        REASON, F.coalesce("__verdict", unknown, late)
    )
    accepted = requests.filter(F.col(REASON).isNull())
    number = F.col("journal_entry_id").cast("string")
    new_entries = accepted.select(
        F.col("request_id").alias("id"), F.lit(as_of).alias("entry_date"),
        F.concat(F.lit("Reversal of JE #"), number, F.lit(" - "), "__text").alias("description"),
        F.lit("JournalReversal").alias("reference_type"),
        F.col("journal_entry_id").alias("reference_id"), "created_by",
    )
    return Reversals(
        requests.select("request_id", "journal_entry_id", REASON), new_entries,
        t.journal_entry_lines,
    )


@dataclass(frozen=True)
class Payments:
    requests: DataFrame
    payments: DataFrame
    entries: DataFrame
    lines: DataFrame


def payment_fields(as_of: datetime.datetime) -> list[Field]:
    return [
        f.whole_number("invoice_id", reasons.required("invoice_id")),
        f.amount("amount_paid", reasons.greater_than_zero("amount_paid"), positive=True),
        Field("payment_method", b.payment_method(F.col("payment_method")), (Rule(
            ~F.coalesce(F.col("payment_method"), F.lit("")).isin(b.PAYMENT_METHODS),
            reasons.PAYMENT_METHOD),)),
        f.whole_number("debit_account_id", reasons.required("debit_account_id")),
        f.whole_number("credit_account_id", reasons.required("credit_account_id")),
        f.optional_text("payment_reference"),
        f.moment("payment_date", default=cleaning.instant(as_of)),
    ]


def payments(
    t, as_of: datetime.datetime, feed: DataFrame | None = None, *, settle: bool = False
) -> Payments:
    """Payments with their journal entry: one debit and one credit line each.

    With ``settle`` the verdicts are written to the shared folder once and all four results
    read them; without it each result is a plan of its own.
    """
    feed = t.payment_feed if feed is None else feed
    checked = clean(feed, payment_fields(as_of)).withColumnRenamed(REASON, "__field")
    bills = t.invoices.select(F.col("id").alias("invoice_id"), "invoice_number",
                              F.lit(True).alias("__billed"))
    judged = checked.join(bills, "invoice_id", "left")
    for side in ("debit", "credit"):
        chart = t.accounts.select(
            F.col("id").alias(f"{side}_account_id"), F.col("is_active").alias(f"__{side}_active"),
            F.lit(True).alias(f"__{side}_known"),
        )
        judged = judged.join(chart, f"{side}_account_id", "left")
    both = F.col("__debit_known").isNotNull() & F.col("__credit_known").isNotNull()
    distinct = F.col("debit_account_id") != F.col("credit_account_id")
    active = F.coalesce(F.col("__debit_active") & F.col("__credit_active"), F.lit(False))
    reason = F.coalesce(
        F.col("__field"),
        first_reason([
            Rule(F.col("__billed").isNull(), reasons.not_found("Invoice")),
            Rule(~(both & distinct), reasons.PAYMENT_ACCOUNTS),
            Rule(~active, reasons.INACTIVE_ACCOUNT),
        ]),
    )
    judged = judged.withColumn(REASON, reason)
    if settle:
        judged = materialise(judged, "payments")
    good = judged.filter(F.col(REASON).isNull())
    amount, nothing = F.col("amount_paid"), F.lit(0).cast(MONEY)
    sides = F.array(
        F.struct(F.col("debit_account_id").alias("account_id"), amount.alias("debit"),
                 nothing.alias("credit")),
        F.struct(F.col("credit_account_id").alias("account_id"), nothing.alias("debit"),
                 amount.alias("credit")),
    )
    return Payments(
        requests=judged.select("request_id", REASON),
        payments=good.select(
            F.col("request_id").alias("id"), "invoice_id", "payment_reference", "amount_paid",
            "payment_date", "payment_method",
        ),
        entries=good.select(
            F.col("request_id").alias("id"), F.col("payment_date").cast("date").alias("entry_date"),
            F.concat(F.lit("Payment received for Invoice "), "invoice_number").alias("description"),
            F.lit("Payment").alias("reference_type"), F.col("request_id").alias("reference_id"),
        ),
        lines=good.select(F.col("request_id").alias("journal_entry_id"), F.inline(sides)),
    )


def known_accounts(t, feed: DataFrame) -> DataFrame:
    """Per payment request: are both accounts there, distinct and active?"""
    ids = feed.select(
        "request_id",
        *[cleaning.integer(F.col(c)).alias(c)
          for c in ("debit_account_id", "credit_account_id")],
    )
    live = t.accounts.filter("is_active").select("id")
    flagged = flag_known(ids, "debit_account_id", live, "debit_ok")
    flagged = flag_known(flagged, "credit_account_id", live, "credit_ok")
    usable = (F.col("debit_ok") & F.col("credit_ok")
              & (F.col("debit_account_id") != F.col("credit_account_id")))
    return flagged.select("request_id", F.coalesce(usable, F.lit(False)).alias("usable"))
