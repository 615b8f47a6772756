"""HR reports. Leave requests and reviews refer to users, not to employees."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.business import canonical_role
from tallyloom.operators.listing import down, listing, up


def payroll_runs(t) -> DataFrame:
    return listing(t.payroll_runs, [down("id")])


def job_postings(t) -> DataFrame:
    return listing(t.job_postings, [down("posted_date"), down("id")])


def training_programs(t) -> DataFrame:
    return listing(t.training_programs, [up("scheduled_date"), down("id")])


def employee_profiles(employees: DataFrame, t, users: DataFrame | None = None) -> DataFrame:
    places = t.departments.select(
        F.col("id").alias("__department"), F.col("name").alias("department_name")
    )
    logins = (t.users if users is None else users).select(
        F.col("id").alias("user_id"), "username", "email", "role_id", "is_active"
    )
    # The department id shown is the department's own: NULL when it does not exist.
    return (
        employees.join(places, F.col("department_id") == F.col("__department"), "left")
        .join(logins, "user_id", "left")
        .select(
            "id", "user_id", "first_name", "last_name", "job_title", "hire_date", "base_salary",
            "created_at", "updated_at", F.col("__department").alias("department_id"),
            "department_name", "username", "email", "role_id", "is_active",
        )
    )


def employees(t) -> DataFrame:
    return listing(employee_profiles(t.employees, t), [up("id")])


def with_requester(requests: DataFrame, t) -> DataFrame:
    people = t.users.select(F.col("id").alias("employee_id"), "first_name", "last_name")
    return requests.join(people, "employee_id")


def leave_requests(t) -> DataFrame:
    return listing(with_requester(t.leave_requests, t), [down("created_at"), down("id")])


def with_people(reviews: DataFrame, t) -> DataFrame:
    """Reviews with the reviewed user (required) and the reviewer (if known)."""
    reviewers = t.users.select(
        F.col("id").alias("reviewer_id"), F.col("first_name").alias("reviewer_first_name"),
        F.col("last_name").alias("reviewer_last_name"),
    )
    return with_requester(reviews, t).join(reviewers, "reviewer_id", "left")


def performance_reviews(t) -> DataFrame:
    return listing(with_people(t.performance_reviews, t), [down("review_date"), down("id")])


def with_posting(applicants: DataFrame, t) -> DataFrame:
    titles = t.job_postings.select(
        F.col("id").alias("job_posting_id"), F.col("title").alias("job_title")
    )
    return applicants.join(titles, "job_posting_id")


def applicants(t) -> DataFrame:
    return listing(with_posting(t.applicants, t), [down("application_date"), down("id")])


def users_with_role(t) -> DataFrame:
    names = t.roles.select(F.col("id").alias("role_id"), F.col("name").alias("role_name"))
    joined = t.users.join(names, "role_id", "left")
    return joined.select(
        "id", "username", "email", "role_id", "is_active", "role_name",
        F.coalesce(canonical_role(F.col("role_name")), F.col("role_name")).alias("role"),
    )
