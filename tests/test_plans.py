"""Physical plans: what large tables get when nothing is small enough to broadcast."""

import datetime

import os

import pytest
from conftest import DATA
from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F

import __spark_entry__ as entry_points
from tallyloom.catalogue import ACCESS, EDITS, INTAKE, POSTING, REPORTS
from tallyloom.operators import validate
from tallyloom.operators.claims import mark_duplicates
from tallyloom.operators.validate import flag_known
from tallyloom.plans import bi, crm, finance, inventory, scm
from tallyloom import session
from tallyloom.session import materialise, release, work_dir
from tallyloom.sources.tables import SampleTables


@pytest.fixture
def large(spark):
    """Broadcasts by size off, as if every table were large."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield spark
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


FILE_JOBS = {"csv_finance", "csv_hr", "csv_scm", "csv_crm"}


@pytest.mark.parametrize("name", sorted({*REPORTS, *INTAKE, *EDITS, *POSTING, *ACCESS} - FILE_JOBS))
def test_no_single_task_operators(large, name):
    text = plan(entry_points.queries()[name](large, DATA))
    for operator in ("CartesianProduct", "BroadcastNestedLoopJoin", "Window", "EvalPython"):
        assert operator not in text
    assert "Broadcast" not in text


def test_filters_and_columns_reach_the_scan(large, tmp_path):
    tables = SampleTables(large, DATA)
    tables.invoices.write.parquet(str(tmp_path / "invoices"))

    class Stored:
        invoices = large.read.parquet(str(tmp_path / "invoices"))

    large.conf.set("spark.sql.maxMetadataStringLength", "2000")
    text = plan(bi.revenue_trend(Stored, datetime.date(1998, 6, 30)))
    large.conf.unset("spark.sql.maxMetadataStringLength")
    assert "GreaterThanOrEqual(invoice_date,1998-01-01)" in text
    assert "LessThan(invoice_date,1999-01-01)" in text
    assert "ReadSchema: struct<invoice_date:date,total_amount:decimal(18,2),status:string>" in text


def test_lines_are_summed_before_they_are_joined(large):
    text = plan(finance.journal_totals(SampleTables(large, DATA)))
    assert text.count("Exchange hashpartitioning") == 1 and "partial_sum" in text
    valuation = plan(inventory.valuation(SampleTables(large, DATA)))
    # One shuffle of summed batches, one of products, one range shuffle for the order.
    assert valuation.count("Exchange hashpartitioning") == 2


def hot(spark, key, rows=60000, keys=5000):
    """A third of all rows share one key."""
    share = F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id") % keys)
    return spark.range(0, rows, 1, 8).select("id", share.alias(key))


def named(spark, name):
    return spark.range(5000).select("id", F.concat(F.lit("n"), F.col("id")).alias(name))


def opportunities(spark, bundle):
    t = bundle(customers=named(spark, "company_name"))
    return crm.with_customer(hot(spark, "customer_id"), t)


def purchases(spark, bundle):
    t = bundle(suppliers=named(spark, "company_name"), vendors=named(spark, "name"))
    return scm.with_supplier(hot(spark, "supplier_id"), t)


def purchases_of_suppliers(spark, bundle):
    t = bundle(suppliers=named(spark, "company_name"), vendors=named(spark, "name"))
    return scm.with_supplier_only(hot(spark, "supplier_id"), t)


def references(spark, bundle):
    return flag_known(hot(spark, "product_id"), "product_id", spark.range(5000), "known")


@pytest.mark.parametrize("name, feed", [
    ("intake_movements", "quantity"), ("post_journal_entries", "debit"), ("intake_invoices", "due_date")])
def test_a_feed_meets_its_references_where_it_lies(large, monkeypatch, name, feed):
    """With broadcasts off no job shuffles rows of a feed to look up ids: what is shuffled are
    distinct ids, keys and sums, never a row with its other fields."""
    plans, write = [], DataFrameWriter.parquet

    def record(self, *args, **options):
        plans.append(plan(self._df))
        return write(self, *args, **options)

    monkeypatch.setattr(DataFrameWriter, "parquet", record)
    result = entry_points.queries()[name](large, DATA)
    for text in plans:
        for line in text.splitlines():
            below = text.split(line, 1)[1].splitlines()[0] if "Exchange hashpartitioning" in line else ""
            assert feed not in below, below
    if name == "intake_movements":
        assert "Exchange" not in plan(result)


def test_unknown_ids_beyond_the_literal_set_are_joined(spark, make, monkeypatch):
    monkeypatch.setattr(validate, "LITERAL_IDS", 3)
    rows = [(i, i % 7, None if i % 5 == 0 else 100 + i % 3) for i in range(60)]
    frame = make(rows, "request_id BIGINT, a BIGINT, b BIGINT")
    known = [make([(0,), (1,)], "id BIGINT"), make([(100,)], "id BIGINT")]
    judged, flags = validate.unknown_flags(frame, [("a", known[0]), ("b", known[1]), ("request_id", known[0])])
    got = judged.select("request_id", *[flag.alias(f"f{i}") for i, flag in enumerate(flags)]).collect()
    assert {tuple(r) for r in got} == {
        (i, a not in (0, 1), b is not None and b != 100, i not in (0, 1)) for i, a, b in rows}
    assert len(got) == 60


def claims(spark, bundle):
    feed = hot(spark, "code")
    return mark_duplicates(
        feed, ("code",), spark.range(10).toDF("code"), F.col("id") % 2 == 0, "id")


@pytest.mark.parametrize(
    "job", [opportunities, purchases, purchases_of_suppliers, references, claims])
def test_a_hot_key_is_split(large, bundle, job):
    settings = {
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20000",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20000",
    }
    for key, value in settings.items():
        large.conf.set(key, value)
    try:
        joined = job(large, bundle)
        assert len(joined.collect()) == 60000
        assert "skew=true" in plan(joined)
    finally:
        for key in settings:
            large.conf.unset(key)


class FakeSession:
    """A session that only knows its master and its settings."""

    def __init__(self, master, settings):
        self.sparkContext = type("Context", (), {"master": master})
        self.conf = type("Conf", (), {"get": staticmethod(settings.get),
                                      "set": staticmethod(settings.__setitem__)})


def test_work_goes_to_the_shared_folder():
    settings = {"spark.checkpoint.dir": "hdfs://shared/work"}
    assert work_dir(FakeSession("yarn", settings)) == "hdfs://shared/work"
    assert work_dir(FakeSession("local[8]", settings)) == "hdfs://shared/work"


def test_a_missing_shared_folder_is_an_error():
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        work_dir(FakeSession("yarn", {}))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        work_dir(FakeSession("local[8]", {}))


def test_materialised_rows_are_read_back_from_files(spark):
    kept = materialise(spark.range(5).toDF("id"), "kept")
    assert kept.count() == 5 and kept.inputFiles()[0].startswith(f"file://{work_dir(spark)}")


def test_a_job_removes_what_it_wrote(spark, monkeypatch):
    monkeypatch.setattr(session, "_HANDED", [])
    kept = materialise(spark.range(5).toDF("id"), "kept")
    folder = os.path.dirname(kept.inputFiles()[0].removeprefix("file://"))
    assert os.path.isdir(folder) and release(spark) == 1
    assert not os.path.exists(folder) and release(spark) == 0
