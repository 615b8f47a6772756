"""JSON request bodies: text fields and, for documents, an array of line objects."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.functions import reasons
from tallyloom.operators.validate import REASON
from tallyloom.session import materialise

QUARANTINE = f"body STRING, {REASON} STRING"

LINES = {
    "sales_order": ("order_lines", ["product_id", "quantity", "unit_price"]),
    "purchase_order": ("lines", ["product_id", "quantity_ordered", "unit_cost"]),
    "journal_entry": ("lines", ["account_id", "debit", "credit"]),
}
HEADERS = {
    "sales_order": ["customer_id", "order_date", "status"],
    "purchase_order": ["po_number", "supplier_id", "expected_delivery_date"],
    "journal_entry": ["description", "entry_date", "created_by"],
}


def body_schema(fields: Sequence[str], lines: tuple[str, Sequence[str]] | None = None) -> str:
    """Schema of a body: everything as text, so that no value is lost before it is judged."""
    columns = ["request_id BIGINT", *[f"{c} STRING" for c in fields]]
    if lines:
        name, items = lines
        inner = ", ".join(f"{c}: STRING" for c in items)
        columns.append(f"{name} ARRAY<STRUCT<{inner}>>")
    return ", ".join(columns)


def document_schema(kind: str) -> str:
    return body_schema(HEADERS[kind], LINES[kind])


def parse_bodies(lines: DataFrame, schema: str) -> DataFrame:
    """The columns of ``schema`` with ``body``, the line as it came, and ``reject_reason``.

    A line is malformed unless it is one JSON object and nothing else; a body without a readable
    request id cannot be answered. Blank lines are no bodies. Nothing is dropped but those.
    """
    # Wrapped as the only item of an array, since what follows a complete object is not looked at.
    whole = F.json_array_length(F.concat(F.lit("["), F.col("body"), F.lit("]"))) == 1
    # A single value that begins with a brace is an object.
    proper = F.ltrim("body", F.lit(" \t\r\n")).startswith("{") & F.coalesce(whole, F.lit(False))
    parsed = lines.filter(F.trim("body") != "").select("body", F.from_json("body", schema).alias("__read"), proper.alias("__proper"))
    reason = F.when(~F.col("__proper"), F.lit(reasons.MALFORMED_BODY)).when(
        F.col("__read.request_id").isNull(), F.lit(reasons.NO_REQUEST_ID))
    return parsed.select("__read.*", "body", reason.alias(REASON))


def readable(parsed: DataFrame) -> DataFrame:
    """The bodies that can be judged, without their raw text."""
    return parsed.filter(F.col(REASON).isNull()).drop("body", REASON)


def unreadable(parsed: DataFrame) -> DataFrame:
    """The others: raw text and reason."""
    return parsed.filter(F.col(REASON).isNotNull()).select("body", REASON)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.col("value").alias("body"))


def read_bodies(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The readable bodies, parsed once: they are written with their reasons and picked from there.

    A filter by the reason would otherwise be moved below the parsed columns and parse every
    body again, and so would each further use of the bodies."""
    parsed = parse_bodies(read_lines(spark, path), schema).drop("body")
    return readable(materialise(parsed, "bodies"))


def stream_lines(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """Bodies as they arrive; a micro-batch takes a bounded number of files."""
    lines = spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(path)
    return lines.select(F.col("value").alias("body"))


def split_documents(bodies: DataFrame, kind: str) -> tuple[DataFrame, DataFrame]:
    """Headers and numbered lines of document bodies; narrow, no shuffle."""
    name, items = LINES[kind]
    headers = bodies.select("request_id", *HEADERS[kind])
    lines = bodies.select("request_id", F.posexplode(name).alias("__pos", "__line")).select(
        "request_id", (F.col("__pos") + 1).alias("line_no"),
        *[F.col(f"__line.{c}").alias(c) for c in items],
    )
    return headers, lines
