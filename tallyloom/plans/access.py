"""Roles: effective permissions of every user and the audit of an access log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.functions import business, cleaning, reasons


def user_permissions(t) -> DataFrame:
    """One row per user and permission."""
    grants = t.roles.select(F.col("id").alias("role_id"), F.col("name").alias("role"),
                            F.explode("permissions").alias("permission"))
    return t.users.select(F.col("id").alias("user_id"), "role_id").join(grants, "role_id").select("user_id", "role", "permission")


def access_audit(t) -> DataFrame:
    """Each logged action: allowed, or why not. Unknown users have no role."""
    people = t.users.select(F.col("id").alias("user_id"), "role_id")
    grants = t.roles.select(F.col("id").alias("role_id"), "permissions")
    granted = F.array_contains("permissions", "*") | F.array_contains(
        F.col("permissions"), F.col("action")
    )
    verdict = (
        F.when(F.coalesce("role_id", F.lit(0)) == 0, reasons.NO_ROLE)
        .when(F.col("permissions").isNull(), reasons.not_found("Role"))
        .when(granted, reasons.ALLOWED)
        .otherwise(reasons.FORBIDDEN)
    )
    return t.access_log.join(people, "user_id", "left").join(grants, "role_id", "left").select("id", "user_id", "action", verdict.alias("verdict"))


def resolve_roles(feed: DataFrame) -> DataFrame:
    """A role given as an id or as any spelling of its name, turned into a role id."""
    given = F.col("role")
    by_id = cleaning.integer(given)
    by_id = F.when(by_id > 0, by_id)
    by_name = business.preferred_role_id(business.canonical_role(given))
    role_id = F.coalesce(by_id, by_name)
    absent = given.isNull() | (given == "")
    return feed.select(
        "request_id", "role", F.when(~absent, role_id).alias("role_id"),
        F.when(~absent & role_id.isNull(), F.lit(reasons.UNSUPPORTED_ROLE)).alias("reject_reason"),
    )
