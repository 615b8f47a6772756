"""Keyed changes as a stream: judged on arrival, kept as a log, folded when read.

The base table is not rewritten per micro-batch. The current table is the base of the newest
manifest version joined with the log behind it; ``compact_receipts`` and
``compact_order_status`` write it out as the next base, beside drains and readers. A change
that arrives after a compaction counts as later than those before it.
"""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.functions import business as b
from tallyloom.functions import fields as f
from tallyloom.functions import reasons
from tallyloom.operators.changes import apply_latest, apply_sums, judge_targets
from tallyloom.operators.validate import REASON, clean
from tallyloom.plans.edits import stamped
from tallyloom.streaming.journal import drain, read_outcome
from tallyloom.streaming.manifest import State, base_table, compact, read_state

RECEIPTS = f"seq BIGINT, id BIGINT, quantity BIGINT, {REASON} STRING"
ORDER_STATUS = f"seq BIGINT, id BIGINT, status STRING, {REASON} STRING"


def log_receipts(t, feed: DataFrame, path: str) -> None:
    """Stock receipts: product, quantity."""

    def judge(batch: DataFrame) -> DataFrame:
        checked = clean(
            batch,
            [f.whole_number("product_id", reasons.RECEIVED_PRODUCT),
             f.whole_number("quantity", reasons.RECEIVED_QUANTITY)],
        ).select(F.col("request_id").alias("seq"), F.col("product_id").alias("id"), "quantity", REASON)
        return judge_targets(checked, t.products, reasons.not_found("Product")).select(
            "seq", "id", "quantity", REASON)

    drain(feed, judge, path)


def stocked(t, path: str, state: State | None = None, upto: int | None = None) -> DataFrame:
    """Products with all receipts logged so far."""
    state = state or read_state(t.spark, path)
    log = read_outcome(t.spark, path, RECEIPTS, "accepted", state.through, upto)
    return apply_sums(base_table(t.spark, state, t.products), log, "stock_quantity", "quantity").table


def compact_receipts(t, path: str) -> State:
    return compact(t.spark, path, lambda state, upto: stocked(t, path, state, upto))


def refused_receipts(t, path: str) -> DataFrame:
    return read_outcome(t.spark, path, RECEIPTS, "rejected").select("seq", "id", REASON)


def log_order_status(t, feed: DataFrame, path: str) -> None:
    def judge(batch: DataFrame) -> DataFrame:
        checked = clean(batch, [f.choice("status", b.SALES_ORDER_STATUSES)], keep=("seq", "id"))
        return judge_targets(checked, t.sales_orders, reasons.not_found("Sales order")).select(
            "seq", "id", "status", REASON)

    drain(feed, judge, path)


def current_orders(t, path: str, as_of: datetime.datetime, state: State | None = None,
                   upto: int | None = None) -> DataFrame:
    """Sales orders with the latest status logged so far."""
    state = state or read_state(t.spark, path)
    log = read_outcome(t.spark, path, ORDER_STATUS, "accepted", state.through, upto)
    base = base_table(t.spark, state, t.sales_orders)
    return apply_latest(base, log, ["status"], stamped(as_of), b.SALES_ORDER_STATUSES).table


def compact_order_status(t, path: str, as_of: datetime.datetime) -> State:
    return compact(t.spark, path, lambda state, upto: current_orders(t, path, as_of, state, upto))


def refused_order_status(t, path: str) -> DataFrame:
    return read_outcome(t.spark, path, ORDER_STATUS, "rejected").select("seq", "id", REASON)
