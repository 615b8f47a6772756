"""Exact dedup: two Bloom filter passes, then only possibly repeated rows shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import boxed, number_id, field
from tallyloom.session import materialise

# The filter has eight slots a row, so that about one unique row in eight passes it, up to
# 2**FILTER_BITS. The second pass broadcasts its repeated bits as at most 2**FILTER_BITS / 64
# words of 16 bytes, 64 MB with this setting. A fuller filter (beyond about 30 million distinct
# texts) lets more rows through to the exact comparison; it never changes a result.
LEAST_BITS = 20
FILTER_BITS = 28


def bits_for(rows: int, most: int = FILTER_BITS) -> int:
    return min(most, max(LEAST_BITS, (8 * rows).bit_length()))


def exact_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id",
                     filter_bits: int | None = None) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256), one row per input row.

    Texts are equal when identical; NULL counts as empty. Of equal texts the row with the
    largest doc_id stays, NULL being smaller than every id; of repeated rows with that id
    exactly one is kept. An empty table gives no rows. Other input columns are not read.

    Pass one counts the hits of every filter slot and keeps the slots hit at least twice.
    Pass two tests each row against them: a row whose slot nobody else hit is unique and goes
    straight to the result. Only the rest is grouped by digest (with partial aggregation) and
    joined with its group, two plain sides that Spark splits for a hot text.
    """
    digest = F.sha2(F.coalesce(field(text).cast("string"), F.lit("")), 256)
    rows = materialise(
        boxed(docs, doc_id=number_id(doc_id), text_sha256=digest).select(
            "doc_id", "text_sha256", F.monotonically_increasing_id().alias("rid")), "digests")
    filter_bits = filter_bits or bits_for(rows.count())
    slot = F.xxhash64("text_sha256").bitwiseAND(2**filter_bits - 1)
    repeated = materialise(
        rows.groupBy(slot.alias("slot")).agg(F.count("*").alias("hits")).where("hits > 1")
        .groupBy(F.shiftright("slot", 6).alias("word"))
        .agg(F.bit_or(_bit(F.col("slot"))).alias("bits")), "filter")
    tested = rows.withColumn("slot", slot).withColumn("word", F.shiftright("slot", 6)).join(
        F.broadcast(repeated), "word", "left")
    hit = F.coalesce(F.col("bits"), F.lit(0)).bitwiseAND(_bit(F.col("slot"))) != 0
    columns = ["doc_id", "text_sha256", "rid"]
    suspects = tested.where(hit).select(*columns)
    groups = materialise(
        suspects.groupBy("text_sha256").agg(
            F.max(F.struct("doc_id", "rid")).alias("best"), F.count("*").alias("group_size")),
        "groups")
    unique = tested.where(~hit).select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"),
        F.lit(True).alias("kept"), "text_sha256")
    grouped = suspects.join(groups, "text_sha256").select(
        "doc_id", F.col("best.doc_id").alias("keep_id"), "group_size",
        (F.col("rid") == F.col("best.rid")).alias("kept"), "text_sha256")
    return unique.unionAll(grouped)


def _bit(slot: Column) -> Column:
    """One bit of a 64-bit word."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), slot.bitwiseAND(63).cast("int"))
