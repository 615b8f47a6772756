"""Keyed changes: folding by ``seq``, presence, deletions, sums, upserts."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from tallyloom.functions import fields as f
from tallyloom.operators import changes
from tallyloom.plans import edits
from tallyloom.sources.roles import role_table

NOW = datetime.datetime(2024, 5, 1)


@pytest.fixture
def items(make):
    return make([(1, "a", "x"), (2, "b", None), (3, "c", "z")],
                "id BIGINT, name STRING, note STRING")


def table(frame):
    return {r["id"]: tuple(r)[1:] for r in frame.collect()}


def refused(frame):
    return {r["seq"]: r["reject_reason"] for r in frame.collect()}


def test_the_last_valid_change_wins_in_any_row_order(make, items):
    rows = [(1, 1, "first"), (3, 1, "last"), (4, 1, " "), (2, 1, "middle"), (5, 9, "gone"),
            (6, 9, "")]
    for seed in range(3):
        random.Random(seed).shuffle(rows)
        feed = make(rows, "seq BIGINT, id BIGINT, name STRING")
        done = changes.replace_fields(items, feed, [f.required_text("name")], not_found="none")
        assert table(done.table) == {1: ("last", "x"), 2: ("b", None), 3: ("c", "z")}
        assert table(done.changed) == {1: ("last", "x")}
        assert refused(done.rejected) == {4: "name is required", 5: "none",
                                          6: "name is required"}


def patch(items, feed):
    return changes.patch_fields(items, feed, [f.required_text("name"), f.plain_text("note")],
                                not_found="none", empty="empty")


def test_absent_keeps_and_null_clears(make, items):
    feed = make([(1, 1, "note", "ignored", None), (2, 2, "name", "bb", "ignored"),
                 (3, 2, "note", None, "n"), (4, 3, "", "x", "x"), (5, 3, "colour", "x", "x"),
                 (6, 3, "name", " ", "x"), (7, 8, "name", "x", "x")],
                "seq BIGINT, id BIGINT, present STRING, name STRING, note STRING")
    done = patch(items, feed)
    assert table(done.table) == {1: ("a", None), 2: ("bb", "n"), 3: ("c", "z")}
    assert table(done.changed) == {1: ("a", None), 2: ("bb", "n")}
    assert refused(done.rejected) == {4: "empty", 5: "empty", 6: "name is required", 7: "none"}


def test_fields_fold_one_by_one(make, items):
    feed = make([(3, 1, "name", "late", None), (1, 1, "name,note", "early", "kept")],
                "seq BIGINT, id BIGINT, present STRING, name STRING, note STRING")
    assert table(patch(items, feed).table)[1] == ("late", "kept")


def test_deletion(make, items):
    feed = make([(1, 1), (2, 1), (3, 7)], "seq BIGINT, id BIGINT")
    done = changes.delete_rows(items, feed, not_found="none")
    assert sorted(table(done.table)) == [2, 3]
    assert table(done.changed) == {1: ("a", "x")}
    assert refused(done.rejected) == {2: "none", 3: "none"}


def test_nothing_is_found_after_a_deletion(make, items):
    feed = make([(1, 1, "update", "name", "a1"), (2, 1, "delete", "", None),
                 (3, 1, "update", "name", "a3"), (4, 1, "delete", "", None),
                 (5, 1, "update", "", None), (6, 2, "update", "name", "b6"),
                 (7, 2, "purge", "name", "b7"), (8, 3, None, "name", "c8")],
                "seq BIGINT, id BIGINT, op STRING, present STRING, name STRING")
    done = changes.patch_and_delete(items, feed, [f.required_text("name")], not_found="none",
                                    empty="empty")
    assert table(done.table) == {2: ("b6", None), 3: ("c", "z")}
    unknown = "op must be update or delete"
    assert refused(done.rejected) == {3: "none", 4: "none", 5: "empty", 7: unknown, 8: unknown}


def test_upsert_keeps_untouched_columns(make, items):
    feed = make([(1, 1, "n1"), (2, 1, "n2"), (3, 9, "new")], "seq BIGINT, id BIGINT, name STRING")
    assert table(changes.upsert_rows(items, feed)) == {
        1: ("n2", "x"), 2: ("b", None), 3: ("c", "z"), 9: ("new", None)}


def test_receipts_add_up_whatever_the_order(tables):
    done = edits.receive_stock(tables)
    shuffled = edits.receive_stock(tables, feed=tables.receipt_feed.orderBy(F.rand(3)))
    assert done.table.exceptAll(shuffled.table).isEmpty()
    valid = tables.receipt_feed.count() - done.rejected.count()
    assert 0 < valid < tables.receipt_feed.count()


def test_deleted_rows_cannot_be_looked_up(tables):
    done = edits.DELETIONS["product"](tables, NOW)
    assert done.table.join(done.changed, "id", "left_semi").isEmpty()
    assert done.table.count() + done.changed.count() == tables.products.count()


def test_two_employees_with_one_user(make, bundle):
    """Both changes reach the user; the later one wins and the user stays one row."""
    schema = "id BIGINT, user_id BIGINT, first_name STRING, last_name STRING, "\
             "department_id BIGINT, job_title STRING, hire_date DATE, base_salary DECIMAL(18,2), "\
             "created_at TIMESTAMP_NTZ, updated_at TIMESTAMP_NTZ"
    rest = ("f", "l", None, "j", None, None, None, None)
    t = bundle(
        employees=make([(1, 10, *rest), (2, 10, *rest), (3, 99, *rest)], schema),
        users=make([(10, "u", "e", "f", "l", 113, True, None)],
                   "id BIGINT, username STRING, email STRING, first_name STRING, "
                   "last_name STRING, role_id BIGINT, is_active BOOLEAN, "
                   "updated_at TIMESTAMP_NTZ"),
        departments=make([], "id BIGINT, name STRING"),
        employee_is_active_feed=make(
            [(1, 1, "true"), (2, 2, "false"), (3, 3, "true"), (4, 1, "yes")],
            "seq BIGINT, id BIGINT, is_active STRING"),
    )
    done = edits.employee_status(t, NOW)
    users = done.table.collect()
    assert [(u["id"], u["is_active"], u["updated_at"]) for u in users] == [(10, False, NOW)]
    assert sorted((r["id"], r["is_active"]) for r in done.changed.collect()) == [
        (1, False), (2, False)]
    assert refused(done.rejected) == {3: "Employee not found",
                                      4: "is_active must be true or false"}


def test_role_catalogue_upsert_is_idempotent(spark, make):
    stored = make([(113, "Boss", ["x"], None), (900, "Own", ["y"], None)],
                  "id BIGINT, name STRING, permissions ARRAY<STRING>, updated_at TIMESTAMP_NTZ")
    catalogue = role_table(spark)
    once = edits.upsert_roles(stored, catalogue, NOW)
    twice = edits.upsert_roles(once, catalogue, NOW)
    rows = {r["id"]: r for r in once.collect()}
    assert len(rows) == 15 and rows[900]["name"] == "Own"
    assert rows[113]["name"] == "Admin" and rows[113]["permissions"][0] == "*"
    assert {tuple(map(str, r)) for r in twice.collect()} == {
        tuple(map(str, r)) for r in once.collect()}


def test_money_paid_in_full(tables):
    done = edits.invoices_paid(tables, NOW)
    assert done.changed.filter("status <> 'Paid' OR amount_paid <> total_amount").isEmpty()


@pytest.mark.parametrize("order", range(3))
def test_ties_do_not_depend_on_the_order_of_rows(make, items, order):
    """Two different changes with one ``seq``: always the same one counts, as a whole."""
    rows = [(5, 1, "p", "1"), (5, 1, "q", "2"), (5, 1, "q", "2"), (4, 1, "r", "3"), (5, 2, "s", "4")]
    random.Random(order).shuffle(rows)
    feed = make(rows, "seq BIGINT, id BIGINT, name STRING, note STRING").repartition(3)
    fields = [f.required_text("name"), f.plain_text("note")]
    done = table(changes.replace_fields(items, feed, fields, not_found="none").table)
    assert done[1] in (("p", "1"), ("q", "2")) and done[2] == ("s", "4")
    again = make(sorted(rows), "seq BIGINT, id BIGINT, name STRING, note STRING")
    assert table(changes.replace_fields(items, again, fields, not_found="none").table) == done
    single = make([(seq, i, n) for seq, i, n, _ in rows], "seq BIGINT, id BIGINT, name STRING")
    member = [f.choice("name", ["q", "p", "r", "s"])]
    assert table(changes.replace_fields(items, single, member, not_found="none").table)[1][0] == "p"


def test_extreme_sequence_numbers(make, items):
    big = 2**63 - 1
    feed = make([(big, 1, "p"), (-big, 1, "q"), (-5, 2, "q"), (-6, 2, "p"), (None, 3, "p")],
                "seq BIGINT, id BIGINT, name STRING")
    for field in (f.required_text("name"), f.choice("name", ["p", "q"])):
        done = changes.replace_fields(items, feed, [field], not_found="none")
        assert {k: v[0] for k, v in table(done.table).items()} == {1: "p", 2: "q", 3: "c"}


@pytest.mark.parametrize("name", ["status_sales_order", "replace_customer"])
def test_the_latest_change_is_found_without_sorting(spark, tables, name, monkeypatch):
    """Hash aggregates only, in every frame that is written and in the result."""
    texts, plain = [], changes.materialise

    def record(df, label):
        texts.append(df._jdf.queryExecution().executedPlan().toString())
        return plain(df, label)

    monkeypatch.setattr(changes, "materialise", record)
    job = edits.status_changes()["sales_order"] if name.startswith("status") else edits.REPLACEMENTS["customer"]
    result = job(tables, NOW).table
    texts.append(result._jdf.queryExecution().executedPlan().toString())
    assert any("HashAggregate" in text for text in texts)
    assert not any("SortAggregate" in text for text in texts)
