"""Stock movements as a stream, under exactly the rules of the batch job."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame

from tallyloom.operators.validate import REASON
from tallyloom.plans import intake
from tallyloom.sources import bodies
from tallyloom.streaming.journal import drain, read_outcome, read_quarantine

MOVEMENTS = (
    "request_id BIGINT, product_id BIGINT, from_bin_id BIGINT, to_bin_id BIGINT, quantity BIGINT, "
    "movement_type STRING, moved_by BIGINT, reference_type STRING, reference_id BIGINT, "
    f"movement_date TIMESTAMP_NTZ, {REASON} STRING"
)


def ingest(t, feed: DataFrame, path: str, as_of: datetime.datetime) -> None:
    """Judge a stream of movement requests against the stored products, bins and staff. A
    micro-batch asks the tables for its distinct ids only."""
    drain(feed, lambda batch: intake.movements(t, as_of, batch), path)


def ingest_bodies(t, lines: DataFrame, schema: str, path: str, as_of: datetime.datetime) -> None:
    """The same for a stream of JSON bodies; those that cannot be read are set aside whole."""
    drain(
        lines,
        lambda batch: intake.movements(t, as_of, bodies.readable(bodies.parse_bodies(batch, schema))),
        path,
        quarantine=lambda batch: bodies.unreadable(bodies.parse_bodies(batch, schema)),
    )


def accepted(t, path: str) -> DataFrame:
    return read_outcome(t.spark, path, MOVEMENTS, "accepted").drop(REASON)


def rejected(t, path: str) -> DataFrame:
    return read_outcome(t.spark, path, MOVEMENTS, "rejected").select("request_id", REASON)


def quarantined(t, path: str) -> DataFrame:
    return read_quarantine(t.spark, path, bodies.QUARANTINE)
