import os

import pytest
from pyspark.sql import functions as F

DATA = os.environ.get("TEST_LLM_SF_DIR", "/root/testdata/sf0.001")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def documents(spark):
    """Documents from (doc_id, text) or (doc_id, text, source), in two files' worth of partitions."""

    def build(rows, partitions=3):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "a", len(r[1] or "")) for r in rows]
        return spark.createDataFrame(full, DOCS).repartition(partitions)

    return build


@pytest.fixture
def odd(spark):
    """Rows with NULLs in every column, empty, blank, long and repeated texts, and columns
    named like the operators' own."""
    long = " ".join(f"word{i % 977} tail{i}" for i in range(12_000))
    rows = [(1, "one two three four five", "en", "a", 23), (1, "one two three four five", "en", "a", 23),
            (2, None, None, None, None), (None, "", None, None, 0), (None, None, None, None, None),
            (3, " \t\n ", "en", "b", 4), (4, long, "en", "a", len(long)), (5, long, "en", "b", len(long)),
            (6, "İ. café \U0001f600   x", "tr", "a/b", 12)]
    frame = spark.createDataFrame(rows, DOCS)
    for name in ("score", "row", "id", "kept", "size", "text_sha256", "rid", "slot", "key", "a.b"):
        frame = frame.withColumn(name, F.lit("clash"))
    return frame


@pytest.fixture
def no_documents(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture
def table(spark):
    return lambda name: spark.read.parquet(f"{DATA}/{name}.parquet")
