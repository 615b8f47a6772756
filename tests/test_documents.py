"""Documents as headers and rows, the same for small and for very large parents."""

from pyspark.sql import functions as F

from tallyloom.operators.documents import children_of, with_count
from tallyloom.plans import crm, finance, sales


def test_children_are_sorted_with_nulls_where_they_belong(make, bundle):
    t = bundle(
        customers=make([(1, "c"), (2, "d")], "id BIGINT, company_name STRING"),
        opportunities=make(
            [(1, 1, "a", "Lead", None, None), (2, 1, "b", "Lead", None, "2024-02-01"),
             (3, 1, "c", "Lead", None, "2024-01-01"), (4, 9, "x", "Lead", None, None),
             (5, None, "y", "Lead", None, None)],
            "id BIGINT, customer_id BIGINT, title STRING, stage STRING, "
            "estimated_value DECIMAL(18,2), expected_close_date STRING",
        ).withColumn("expected_close_date", F.col("expected_close_date").cast("date")),
        quotations=make(
            [(1, 1, None, "2024-01-01 10:00:00"), (2, 1, None, None),
             (3, 1, None, "2024-01-02 00:00:00")],
            "id BIGINT, customer_id BIGINT, valid_until DATE, created_at STRING",
        ).select("id", "customer_id", F.lit("q").alias("quote_number"), "valid_until",
                 F.lit("Draft").alias("status"),
                 F.lit(1).cast("decimal(18,2)").alias("total_amount"),
                 F.col("created_at").cast("timestamp_ntz")),
    )
    heads = {r["id"]: (r["opportunity_count"], r["quotation_count"])
             for r in crm.customer_documents(t).collect()}
    assert heads == {1: (3, 3), 2: (0, 0)}
    assert [(r["customer_id"], r["id"]) for r in crm.customer_opportunities(t).collect()] == [
        (1, 3), (1, 2), (1, 1)]
    assert [r["id"] for r in crm.customer_quotations(t).collect()] == [2, 3, 1]


def test_a_very_large_parent_has_the_same_shape(spark):
    parents = spark.range(5)
    children = spark.range(60_000).select(
        "id", F.when(F.col("id") < 50_000, 1).otherwise(F.col("id") % 4).cast("long").alias("owner"))
    heads = with_count(parents, children, "owner", "n")
    assert {r["id"]: r["n"] for r in heads.collect()} == {
        0: 2500, 1: 52_500, 2: 2500, 3: 2500, 4: 0}
    rows = children_of(parents, children, "owner", ["id"]).collect()
    assert [tuple(r) for r in rows] == sorted(tuple(r) for r in rows) and len(rows) == 60_000


def test_headers_count_what_the_rows_hold(tables):
    for heads, rows, key in (
            (sales.order_documents(tables), sales.order_document_lines(tables), "order_id"),
            (finance.journal_documents(tables), finance.journal_document_lines(tables),
             "journal_entry_id")):
        sizes = rows.groupBy(F.col(key).alias("id")).count()
        assert heads.join(sizes, "id", "left").where(
            "line_count <> coalesce(count, 0)").isEmpty()
        assert heads.agg(F.sum("line_count")).first()[0] == rows.count()
