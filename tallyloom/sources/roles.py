"""Role catalogue: a fixed dimension of fourteen rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Module access per canonical role, in catalogue order.
MODULE_ACCESS = {
    "Admin": {
        "Finance": "write", "BI": "write", "CRM": "write", "Inventory": "write",
        "SCM": "write", "Sales Orders": "write", "HR": "write",
    },
    "Accountant": {"Finance": "write"},
    "Auditor": {
        "BI": "write", "CRM": "read", "Inventory": "read", "SCM": "read",
        "Sales Orders": "read", "HR": "read",
    },
    "Sales executive": {"BI": "write", "SCM": "write", "Sales Orders": "write", "CRM": "write"},
    "Human Resource": {"HR": "write"},
    "Inventory Manager": {"Inventory": "write", "SCM": "write"},
    "Logistics manager": {"Sales Orders": "write", "SCM": "write", "Inventory": "read"},
    "Warehouse manager": {"Inventory": "write"},
    "Junior sales": {"Sales Orders": "write"},
}

# Stored role ids, their names and canonical roles; the first id of a
# canonical role is the preferred one.
ROLE_IDS = [
    (113, "Admin", "Admin"),
    (1, "SuperAdmin", "Admin"),
    (122, "Accountant", "Accountant"),
    (123, "Auditor", "Auditor"),
    (114, "Executive Board", "Auditor"),
    (115, "Sales executive", "Sales executive"),
    (120, "Human Resource", "Human Resource"),
    (121, "HR Assistant", "Human Resource"),
    (124, "Inventory Manager", "Inventory Manager"),
    (119, "Logistics manager", "Logistics manager"),
    (118, "Warehouse manager", "Warehouse manager"),
    (116, "Junior sales", "Junior sales"),
    (2, "Sales Viewer", "Junior sales"),
    (117, "Customer Support", "Junior sales"),
]

# Other spellings of a role, lower case.
ROLE_ALIASES = {
    "executive board": "Auditor",
    "superadmin": "Admin",
    "super administrator": "Admin",
    "sales viewer": "Junior sales",
    "sales manager": "Sales executive",
    "sales representative": "Junior sales",
    "customer support": "Junior sales",
    "finance controller": "Accountant",
    "financial auditor": "Auditor",
    "hr director": "Human Resource",
    "hr assistant": "Human Resource",
    "logistics coordinator": "Logistics manager",
}

# Permission prefix per module.
MODULE_KEYS = {
    "Finance": "finance", "BI": "bi", "CRM": "crm", "Inventory": "inventory", "SCM": "scm",
    "Sales Orders": "sales", "HR": "hr",
}

CANONICAL_ROLES = list(MODULE_ACCESS)


def permissions_of(canonical: str) -> list[str]:
    """Permission strings of a canonical role; write access includes read."""
    granted = ["*"] if canonical == "Admin" else []
    for module, level in MODULE_ACCESS[canonical].items():
        levels = ("read", "write") if level == "write" else ("read",)
        granted += [f"{MODULE_KEYS[module]}:{each}" for each in levels]
    return granted


def preferred_id(canonical: str) -> int:
    return next(role_id for role_id, _, owner in ROLE_IDS if owner == canonical)


def role_table(spark: SparkSession) -> DataFrame:
    """The catalogue as an inline relation (no Python worker is started for it)."""

    def row(role_id: int, name: str, owner: str) -> str:
        items = ", ".join(f"'{p}'" for p in permissions_of(owner))
        return f"(CAST({role_id} AS BIGINT), '{name}', '{owner}', array({items}))"

    rows = ", ".join(row(*each) for each in ROLE_IDS)
    return spark.sql(f"SELECT * FROM VALUES {rows} AS r(id, name, canonical_name, permissions)")
