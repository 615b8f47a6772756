"""CSV exports, JSON documents and bodies, appends, declared schemas."""

import csv
import datetime
import glob
import json
import os

import pytest
from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F

from tallyloom import catalogue
from tallyloom.catalogue import FILES, REPORTS
from tallyloom.plans import access, bi, posting, sales
from tallyloom.sources import bodies, schemas, sinks
from tallyloom.sources.tables import ParquetTables

NOW = datetime.datetime(2024, 5, 1)


def test_csv_escaping(spark, make, tmp_path):
    values = ['plain', 'a,b', 'say "hi"', 'two\nlines', ' padded ', '', None]
    path = str(tmp_path / "csv")
    sinks.write_csv(make([(i, v) for i, v in enumerate(values)], "i INT, v STRING").coalesce(1),
                    path)
    text = open(glob.glob(f"{path}/part-*.csv")[0], newline="").read()
    assert text == ('i,v\n0,plain\n1,"a,b"\n2,"say ""hi"""\n3,"two\nlines"\n4, padded \n5,\n6,\n')
    back = sinks.read_csv(spark, path, ["i", "v"]).orderBy("i").collect()
    assert [r["v"] for r in back] == [*values[:5], None, None]


def test_export_parts_are_in_order(spark, tables, tmp_path):
    path = str(tmp_path / "csv")
    sinks.write_csv(bi.export(tables, "Finance "), path)
    dates = []
    for part in sorted(glob.glob(f"{path}/part-*.csv")):
        with open(part, newline="") as handle:
            dates += [row["invoice_date"] for row in csv.DictReader(handle)]
    assert len(dates) == tables.invoices.count() and dates == sorted(dates, reverse=True)


@pytest.mark.parametrize("module", ["payroll", "", None])
def test_unknown_export_module(tables, module):
    with pytest.raises(ValueError, match="Unsupported export module"):
        bi.export(tables, module)


def test_documents_as_json(spark, tables, tmp_path):
    path = str(tmp_path / "json")
    documents = sales.order_document_lines(tables)
    sinks.write_documents(documents, path)
    line = json.loads(open(glob.glob(f"{path}/part-*.json")[0]).readline())
    assert set(line) >= {"order_id", "id", "product_sku", "quantity", "unit_price"}
    back = spark.read.schema(documents.schema).json(path)
    assert back.exceptAll(documents).isEmpty() and documents.exceptAll(back).isEmpty()


def test_documents_come_back_from_small_files(spark, tables, monkeypatch):
    """Compressed text takes far less than plain text, in files of a bounded number of rows."""
    monkeypatch.setattr(sinks, "COMPRESSED_ROWS", 1000)
    back = FILES["json_order_document_lines"][1](tables)
    documents = sales.order_document_lines(tables)
    assert back.exceptAll(documents).isEmpty() and documents.exceptAll(back).isEmpty()
    files = back.inputFiles()
    assert len(files) >= documents.count() / 1000 and all(name.endswith(".json.snappy") for name in files)
    size = sum(os.path.getsize(name.removeprefix("file://")) for name in files)
    assert size < documents.select(F.sum(F.length(F.to_json(F.struct("*"))))).first()[0] / 2


@pytest.mark.parametrize("text, proper", [
    ('{"request_id": 1}', True), (' \t{"request_id": 1} ', True), ('{"request_id": 1} x', False),
    ('{"request_id": 1}{}', False), ('{"request_id": 1},', False), ('[{"request_id": 1}]', False),
    ('\u00a0{"request_id": 1}', False), ('"{"', False), ("7", False), ("null", False), ("{", False),
    ('{"request_id": 1, "a": [1, {"b": null}]}', True), (',{"request_id": 1}', False)])
def test_a_body_is_one_object(make, text, proper):
    row = bodies.parse_bodies(make([(text,)], "body STRING"), "request_id BIGINT").first()
    assert (row["reject_reason"] is None) == proper and row["body"] == text


def test_bodies_are_parsed_once(spark, tables, monkeypatch):
    """Headers and lines, filtered or not, come from the written bodies and parse no text again."""
    plans = []
    monkeypatch.setattr(DataFrameWriter, "parquet", lambda self, path, write=DataFrameWriter.parquet: (
        plans.append(self._df._jdf.queryExecution().executedPlan().toString()), write(self, path))[1])
    headers, lines = catalogue._order_bodies(tables)
    text = "".join(plans)
    assert text.count("from_json(") == 1 and headers.count() and lines.count()
    for frame in (headers, lines):
        read = frame._jdf.queryExecution().executedPlan().toString()
        assert "from_json(" not in read and "FileScan text" not in read


def test_nested_order_bodies(spark, tables, tmp_path):
    path = tmp_path / "orders.json"
    requests = [
        {"request_id": 1, "customer_id": 2, "order_lines": [
            {"product_id": "3", "quantity": 2, "unit_price": 1.5},
            {"product_id": 4, "quantity": "1", "unit_price": "0"}]},
        {"request_id": 2, "customer_id": 2, "order_lines": []},
        {"request_id": 3, "customer_id": 2},
        {"request_id": 4, "customer_id": 2, "status": "Confirmed", "order_lines": [
            {"product_id": 3, "quantity": 1, "unit_price": 1},
            {"product_id": 3, "quantity": 0, "unit_price": 1}]},
    ]
    path.write_text("\n".join(json.dumps(r) for r in requests))
    body = bodies.read_bodies(spark, str(path), bodies.document_schema("sales_order"))
    heads, lines = bodies.split_documents(body, "sales_order")
    done = posting.sales_orders(tables, NOW, heads, lines)
    assert {r["request_id"]: r["reject_reason"] for r in done.headers.collect()} == {
        1: None, 2: "order_lines must contain at least one item",
        3: "order_lines must contain at least one item", 4: "quantity must be at least 1"}
    assert sorted((r["line_no"], str(r["subtotal"])) for r in done.lines().collect()) == [
        (1, "3.000000"), (2, "0.000000")]


def test_append_takes_whitelisted_columns(spark, make, tmp_path):
    path = str(tmp_path / "table")
    rows = make([(1, "a", "x")], "id BIGINT, name STRING, extra STRING")
    sinks.append_rows(rows, path, ["id", "name"])
    sinks.append_rows(rows, path, ["id", "name"])
    assert spark.read.parquet(path).columns == ["id", "name"]
    assert spark.read.parquet(path).count() == 2


def test_sample_tables_have_the_declared_schema(spark, tables):
    for name, ddl in schemas.BUSINESS.items():
        assert tables.table(name).dtypes == spark.createDataFrame([], ddl).dtypes, name


def test_stored_tables_are_read_by_schema(spark, tables, tmp_path):
    tables.customers.write.parquet(str(tmp_path / "customers"))
    stored = ParquetTables(spark, str(tmp_path))
    assert stored.customers.dtypes == tables.customers.dtypes
    assert stored.customers.filter(F.col("id") == 1).count() == 1


def test_reports_over_stored_tables(spark, tables, tmp_path):
    """A user's own tables on disk give what the derived tables give."""
    names = ["customers", "products", "sales_orders", "order_lines", "inventory_batches",
             "invoices", "opportunities", "quotations", "users", "employees", "departments",
             "suppliers", "vendors", "purchase_orders", "accounts", "journal_entries",
             "journal_entry_lines"]
    for name in names:
        tables.table(name).write.parquet(str(tmp_path / name))
    stored = ParquetTables(spark, str(tmp_path))
    for report in ("kpis", "inventory_valuation", "stockout_forecast", "receivables",
                   "customer_documents", "order_documents", "journal_entries", "employees",
                   "purchase_orders", "users_with_role", "export_finance"):
        build = REPORTS[report][1]
        left, right = build(stored), build(tables)
        assert left.exceptAll(right).isEmpty() and right.exceptAll(left).isEmpty(), report


def test_stored_roles_come_before_the_catalogue(spark, tmp_path):
    stored = ParquetTables(spark, str(tmp_path))
    assert {r["name"] for r in stored.roles.collect()} >= {"Admin"}
    spark.createDataFrame([(900, "Night shift", ["wms:read"])],
                          "id long, name string, permissions array<string>").write.parquet(
        str(tmp_path / "roles"))
    assert [tuple(r) for r in stored.roles.collect()] == [(900, "Night shift", ["wms:read"])]
    spark.createDataFrame([(1, 900), (2, 113)], "id long, role_id long").write.parquet(
        str(tmp_path / "users"))
    assert [tuple(r) for r in access.user_permissions(stored).collect()] == [
        (1, "Night shift", "wms:read")]
