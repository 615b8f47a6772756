"""Rule tables: what is accepted and with which reason the rest is rejected."""

import datetime

import pytest
from pyspark.sql import functions as F

from tallyloom.operators.validate import Reference, Unique, split, validate
from tallyloom.plans import intake

DAY = datetime.date(2024, 5, 1)
NOW = datetime.datetime(2024, 5, 1)


def reasons(frame):
    return {r["request_id"]: r["reject_reason"] for r in frame.orderBy("request_id").collect()}


def feed(make, columns, *rows):
    schema = "request_id BIGINT, " + ", ".join(f"{c} STRING" for c in columns)
    return make([(i, *row) for i, row in enumerate(rows)], schema)


def test_opportunities(make, bundle):
    columns = ["customer_id", "title", "stage", "estimated_value", "expected_close_date"]
    rows = feed(
        make, columns,
        ("1", "t", "Lead", "0", None), ("0", "t", "Lead", "1", None), ("1", " ", "Lead", "1", None),
        ("1", "t", "lead", "1", None), ("1", "t", " Lead ", "-0.001", None),
        ("1", "t", "Lead", "1", "2024-02-30"), ("x", " ", "?", "?", "?"))
    assert reasons(intake.opportunities(bundle(opportunity_feed=rows))) == {
        0: None, 1: "customer_id must be a positive integer", 2: "title is required",
        3: "stage must be one of: Lead, Qualified, Proposal, Negotiation, Closed Won, Closed Lost",
        4: "estimated_value must be a valid amount",
        5: "expected_close_date must be a valid date",
        6: "customer_id must be a positive integer"}


def test_pricing_rules(make, bundle):
    columns = ["rule_name", "product_id", "min_quantity", "discount_percentage", "is_active"]
    rows = feed(make, columns, ("r", "1", "1", "100", None), ("r", "1", "1", "100.004", "false"),
                ("r", "1", "1", "100.006", None), ("r", "1", "0", "5", None),
                ("r", "1", "1", "5", "maybe"))
    got = intake.pricing_rules(bundle(pricing_rule_feed=rows))
    assert reasons(got) == {
        0: None, 1: None, 2: "discount_percentage must be between 0 and 100",
        3: "min_quantity must be a positive integer", 4: "is_active must be true or false"}
    assert [r[0] for r in got.orderBy("request_id").select("is_active").take(2)] == [True, False]


def test_assets_check_category_before_tag(make, bundle):
    columns = ["category", "initial_cost", "status", "asset_tag", "name", "purchase_date",
               "useful_life_years"]
    stored = make([("OLD",)], "asset_tag STRING")
    rows = feed(
        make, columns,
        ("tech", "", " ", "A", "n", "2024-01-01", "3"), (" ", "1", "", "", "", None, "0"),
        ("Boat", "1", "", "", "", None, "0"), ("HVAC", "x", "", "", "", None, "0"),
        ("HVAC", "1", "Lost", "", "", None, "0"), ("HVAC", "1", "", " ", "", None, "0"),
        ("HVAC", "1", "", "B", "n", "", "0"), ("HVAC", "1", "", "B", "n", "2024-01-01", "0"),
        ("HVAC", "1", "", "OLD", "n", "2024-01-01", "1"))
    twin = "A unique finance record already exists with these values"
    assert list(reasons(intake.assets(bundle(asset_feed=rows, assets=stored))).values()) == [
        None, "category is required",
        "category must be one of: Vehicle, Machinery, IT Equipment, HVAC, Facility",
        "Invalid monetary amount",
        "status must be one of: Operational, Degraded, Under Repair, Decommissioned",
        "asset_tag is required", "purchase_date is required",
        "useful_life_years must be a positive integer", twin]


def test_budget_money_is_checked_first_and_may_be_negative(make, bundle):
    rows = feed(make, ["department", "fiscal_year", "allocated_amount", "spent_amount"],
                ("d", "2024", "-5", None), (None, None, "x", "y"), ("d", " ", "1", ""))
    assert reasons(intake.budgets(bundle(budget_feed=rows))) == {
        0: None, 1: "Invalid monetary amount", 2: "fiscal_year is required"}


def test_payroll(make, bundle):
    rows = feed(make, ["pay_period", "total_gross", "total_taxes", "total_net"],
                (" P1 ", "1", "-2", "3"), (" ", "1", "1", "1"), ("p", "1", "x", "y"))
    got = intake.payroll_runs(bundle(payroll_feed=rows), DAY)
    assert reasons(got) == {0: None, 1: "pay_period is required",
                            2: "Invalid total_taxes amount"}
    first = got.filter("request_id = 0").first()
    assert (first["pay_period"], first["run_date"], first["status"]) == ("P1", DAY, "Draft")


def test_training_rejects_nothing_but_bad_dates(make, bundle):
    rows = feed(make, ["title", "description", "trainer_name", "scheduled_date"],
                (None, " ", " x ", None), ("t", None, None, "2024-1-1"))
    got = intake.training_programs(bundle(training_feed=rows))
    assert reasons(got) == {0: None, 1: "scheduled_date must be a valid date"}
    assert tuple(got.filter("request_id = 0").first())[1:4] == ("", None, "x")


def test_whitelist_needs_a_known_field(make, bundle):
    rows = feed(make, ["name", "description", "colour"], (None, None, "red"), ("n", None, None))
    assert reasons(intake.categories(bundle(category_feed=rows))) == {
        0: "No valid fields provided for categories.", 1: None}


def test_new_product(make, bundle):
    rows = feed(make, ["name", "price", "stock_quantity"], (" Red  box ", "2.5", None),
                ("n", "-1", "1"), ("n", "1", "1.5"))
    got = intake.new_products(bundle(new_product_feed=rows))
    assert reasons(got) == {0: None, 1: "price must be 0 or greater",
                            2: "stock_quantity must be 0 or greater"}
    first = got.filter("request_id = 0").first()
    assert first["sku"] == "RED-BOX-000000000" and first["stock_quantity"] == 0
    assert first["unit_price"] == first["cost_price"]


EMPLOYEE = {"username": "anna", "password": "longenough", "email": "a@b.co", "first_name": "A",
            "last_name": "B", "hire_date": "2024-01-01", "role": "Auditor", "role_id": None,
            "department_id": None, "job_title": None, "base_salary": "0", "is_active": None}


@pytest.mark.parametrize("change, reason", [
    ({}, None),
    ({"username": " ab "}, "username is required"),
    ({"password": "short"}, "password must be at least 8 characters"),
    ({"email": "nope"}, "email must be valid"),
    ({"first_name": None}, "first_name is required"),
    ({"hire_date": None}, "hire_date must be a valid date"),
    ({"role": "auditor"}, "role must be one of: Admin, Accountant, Auditor, Sales executive, "
     "Human Resource, Inventory Manager, Logistics manager, Warehouse manager, Junior sales"),
    ({"role": None}, "role is required"),
    ({"role": None, "role_id": "121"}, None),
    ({"role": None, "role_id": "500"}, "Invalid role or department reference"),
    ({"department_id": "9"}, "Invalid role or department reference"),
    ({"base_salary": "-1"}, "base_salary must be 0 or greater"),
    ({"username": "taken"}, "Username or email already exists"),
    ({"email": "t@b.co", "department_id": "9"}, "Username or email already exists"),
])
def test_employee(spark, make, bundle, change, reason):
    from tallyloom.sources.roles import role_table

    row = {**EMPLOYEE, **change}
    t = bundle(
        employee_feed=feed(make, list(row), tuple(row.values())), roles=role_table(spark),
        departments=make([(1, "d")], "id BIGINT, name STRING"),
        users=make([("taken", "t@b.co")], "username STRING, email STRING"))
    judged = intake.employees(t).first()
    assert judged["reject_reason"] == reason
    if not change:
        assert (judged["role_id"], judged["base_salary"], judged["is_active"]) == (123, None, True)


def test_staff_split_keeps_no_password(tables):
    judged = intake.employees(tables)
    users, staff = intake.split_staff(judged.filter(F.col("reject_reason").isNull()))
    assert not [c for c in users.columns + staff.columns if "password" in c]
    assert users.count() == staff.count() > 0


@pytest.mark.parametrize("change, reason", [
    ({}, None),
    ({"product_id": "0"}, "product_id is required"),
    ({"quantity": "0"}, "quantity must be greater than 0"),
    ({"movement_type": "Teleport"}, "movement_type must be a supported warehouse movement"),
    ({"from_bin_id": None, "to_bin_id": None},
     "At least one of from_bin_id or to_bin_id is required"),
    ({"movement_date": "today"}, "movement_date must be a valid datetime"),
    ({"to_bin_id": "99"}, "Invalid product, bin, or employee reference"),
    ({"moved_by": "99"}, "Invalid product, bin, or employee reference"),
    ({"product_id": "99"}, "Invalid product, bin, or employee reference"),
])
def test_movement(make, bundle, change, reason):
    row = {"product_id": "1", "from_bin_id": "1", "to_bin_id": None, "quantity": "2",
           "movement_type": "Transfer", "moved_by": None, "reference_type": " ",
           "reference_id": None, "movement_date": None, **change}
    ids = make([(1,)], "id BIGINT")
    t = bundle(movement_feed=feed(make, list(row), tuple(row.values())), products=ids,
               storage_bins=ids, employees=ids)
    judged = intake.movements(t, NOW).first()
    assert judged["reject_reason"] == reason
    if not change:
        assert (judged["movement_date"], judged["reference_type"]) == (NOW, None)


def test_unknown_reference_does_not_hold_a_unique_key(make):
    """Row 1 fails its reference, so row 2 gets the code; row 3 is the duplicate, and a
    duplicate is reported before an unknown reference."""
    from tallyloom.functions import fields as f

    rows = feed(make, ["code", "owner"], ("A", "9"), ("A", "1"), ("A", "9"), ("B", "9"),
                ("OLD", "1"))
    got = validate(
        rows, [f.required_text("code"), f.whole_number("owner", "bad owner")],
        references=[Reference("owner", make([(1,)], "id BIGINT"), "unknown owner")],
        unique=Unique(("code",), make([("OLD",)], "code STRING"), "duplicate"))
    assert reasons(got) == {0: "unknown owner", 1: None, 2: "duplicate", 3: "unknown owner",
                            4: "duplicate"}


def test_accepted_and_rejected_make_up_the_feed(tables):
    judged = intake.invoices(tables, DAY)
    good, bad = split(judged)
    assert good.count() + bad.count() == tables.invoice_feed.count()
    assert bad.filter("reject_reason IS NULL").count() == 0
