"""Reject reasons. The wording below is part of the results."""

from __future__ import annotations

# Wordings shared by many fields and tables.


def required(field: str) -> str:
    return f"{field} is required"


def positive_integer(field: str) -> str:
    return f"{field} must be a positive integer"


def valid_amount(field: str) -> str:
    return f"{field} must be a valid amount"


def zero_or_greater(field: str) -> str:
    return f"{field} must be 0 or greater"


def greater_than_zero(field: str) -> str:
    return f"{field} must be greater than 0"


def valid_date(field: str) -> str:
    return f"{field} must be a valid date"


def valid_datetime(field: str) -> str:
    return f"{field} must be a valid datetime"


def true_or_false(field: str) -> str:
    return f"{field} must be true or false"


def a_number(field: str) -> str:
    return f"{field} must be a number"


def one_of(field: str, members: list[str]) -> str:
    return f"{field} must be one of: {', '.join(members)}"


def invalid_amount(field: str) -> str:
    return f"Invalid {field} amount"


def no_valid_fields(table: str) -> str:
    return f"No valid fields provided for {table}."


def no_valid_update(table: str) -> str:
    return f"No valid fields provided for {table} update."


def nothing_to_update(entity: str) -> str:
    return f"At least one {entity} field is required for update"


OPERATION = "op must be update or delete"


def not_found(entity: str) -> str:
    return f"{entity} not found"


# Intake.
DISCOUNT_RANGE = "discount_percentage must be between 0 and 100"
MONEY = "Invalid monetary amount"
VENDOR_ID = "vendor_id must be a valid vendor id"
REVIEWED_USER = "employee_id must be a valid user id"
RATING = "rating must be an integer between 1 and 5"
POSTING_ID = "job_posting_id must be a valid positive integer"
PASSWORD = "password must be at least 8 characters"
EMAIL = "email must be valid"
MOVEMENT_TYPE = "movement_type must be a supported warehouse movement"
NO_BIN = "At least one of from_bin_id or to_bin_id is required"
DESCRIPTION = "description must be text"
BOOLEAN_VALUE = "is_active must be a boolean value"
RECEIVED_PRODUCT = "Invalid product id."
RECEIVED_QUANTITY = "Invalid quantity."

# Documents.
NO_ORDER_LINES = "order_lines must contain at least one item"
ORDER_QUANTITY = "quantity must be at least 1"
ORDER_STATUS = "status must not be blank"
SUPPLIER_ID = "supplier_id must be a valid vendor id"
NO_PURCHASE_LINES = "At least one line item is required"
PURCHASE_COST = "Invalid unit_cost"
PURCHASE_PRODUCT = "product_id is invalid"
TWO_JOURNAL_LINES = "At least two journal lines are required"
UNBALANCED = "Debits must equal Credits"
JOURNAL_TOTAL = "Journal entry total must be greater than 0"
EMPTY_JOURNAL_LINE = "Each journal line must include a debit or credit amount"
NOTHING_TO_REVERSE = "Journal entry has no lines to reverse"
ALREADY_REVERSED = "This journal entry has already been reversed"
PAYMENT_METHOD = "payment_method must be a supported payment type"
PAYMENT_ACCOUNTS = "Invalid debit_account_id or credit_account_id"
INACTIVE_ACCOUNT = "All journal accounts must be active"

# Keys.
FINANCE_KEY = "Invalid foreign key reference in finance request"
FINANCE_TWIN = "A unique finance record already exists with these values"
HR_KEY = "Invalid role or department reference"
HR_TWIN = "Username or email already exists"
WMS_KEY = "Invalid product, bin, or employee reference"
SALES_KEY = "Invalid customer_id or product_id reference"
INVENTORY_TWIN = "A record already exists with these values"

# Access.
ALLOWED = "allowed"
NO_ROLE = "User role is missing"
FORBIDDEN = "Forbidden: insufficient permissions"
UNSUPPORTED_ROLE = "Unsupported role"

# Bodies that cannot be judged at all.
MALFORMED_BODY = "Malformed JSON body"
NO_REQUEST_ID = "Body has no request_id"
