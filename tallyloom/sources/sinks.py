"""Sinks: CSV exports, appends with a column whitelist, nested JSON documents."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

# How a CSV value is written (doubled quotes, NULL and empty as nothing,
# spaces kept).
CSV_OPTIONS = {
    "header": "true",
    "escape": '"',
    "emptyValue": "",
    "nullValue": "",
    "ignoreLeadingWhiteSpace": "false",
    "ignoreTrailingWhiteSpace": "false",
}

# Rows of a compressed JSON file at most.
COMPRESSED_ROWS = 500_000


def write_csv(df: DataFrame, path: str) -> None:
    """Write a sorted export as CSV part files, in order, without passing the driver."""
    df.write.mode("errorifexists").options(**CSV_OPTIONS).csv(path)


def read_csv(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """Read an export back as text."""
    schema = ", ".join(f"{c} STRING" for c in columns)
    return spark.read.schema(schema).options(**CSV_OPTIONS, multiLine="true").csv(path)


def append_rows(df: DataFrame, path: str, columns: Sequence[str]) -> None:
    """Append accepted rows, whitelisted columns only."""
    df.select(*columns).write.mode("append").parquet(path)


def write_documents(df: DataFrame, path: str, compression: str | None = None) -> None:
    """Nested documents, one JSON object per line.

    Their text repeats every field name in every row. Compressed files, which one task reads from
    start to end, are cut at a number of rows.
    """
    options = {"compression": compression, "maxRecordsPerFile": COMPRESSED_ROWS} if compression else {}
    df.write.mode("errorifexists").options(ignoreNullFields="false", **options).json(path)
