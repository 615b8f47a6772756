"""Expected results as SQL over the landing tables."""

from sqltwins import edits, intake, posting, reports

ORACLES = {**reports.ORACLES, **intake.ORACLES, **edits.ORACLES, **posting.ORACLES}

# A stream must end where the batch job over the same input ends.
_MOVEMENTS = ORACLES["intake_movements"]
ORACLES["stream_movements"] = (
    f"SELECT * EXCLUDE (reject_reason) FROM ({_MOVEMENTS}) x WHERE reject_reason IS NULL"
)
ORACLES["stream_movements_rejected"] = (
    f"SELECT request_id, reject_reason FROM ({_MOVEMENTS}) x WHERE reject_reason IS NOT NULL"
)
ORACLES["stream_receipts"] = ORACLES["receive_stock_table"]
ORACLES["stream_receipts_rejected"] = ORACLES["receive_stock_rejected"]
ORACLES["stream_order_status"] = ORACLES["status_sales_order_table"]
ORACLES["stream_order_status_rejected"] = ORACLES["status_sales_order_rejected"]
ORACLES["stream_receipts_compacted"] = ORACLES["receive_stock_table"]
ORACLES["stream_order_status_compacted"] = ORACLES["status_sales_order_table"]
# What a caller gets back after a change or a new document.
_STAFF = f"SELECT * FROM ({ORACLES['intake_employees']}) x WHERE reject_reason IS NULL"
ORACLES["new_users"] = (
    f"SELECT request_id AS id, username, email, role_id, is_active FROM ({_STAFF}) s")
ORACLES["new_employees"] = f"""SELECT request_id AS id, request_id AS user_id, first_name, last_name,
    department_id, job_title, hire_date, base_salary FROM ({_STAFF}) s"""
ORACLES["new_purchase_orders"] = reports.statement(
    f"""SELECT * EXCLUDE (reject_reason) FROM ({ORACLES['post_purchase_orders']}) x
    NATURAL LEFT JOIN ({reports.SUPPLIER_NAMES}) names WHERE reject_reason IS NULL""")
ORACLES["status_sales_order_documents"] = f"""
    SELECT d.id, o.status, d.total_amount, d.customer_company_name, d.primary_email, d.line_count
    FROM ({ORACLES['order_documents']}) d JOIN ({ORACLES['status_sales_order']}) o USING (id)"""
ORACLES["status_sales_order_lines"] = f"""
    SELECT * FROM ({ORACLES['order_document_lines']}) l
    WHERE order_id IN (SELECT id FROM ({ORACLES['status_sales_order']}) o)"""
# Through files and back nothing may change.
ORACLES["json_customers"] = ORACLES["intake_customers"]
ORACLES["json_order_documents"] = ORACLES["order_documents"]
ORACLES["json_order_document_lines"] = ORACLES["order_document_lines"]
ORACLES["append_categories"] = (
    "SELECT name, description FROM "
    f"({ORACLES['intake_categories']}) x WHERE reject_reason IS NULL"
)
ORACLES["json_sales_orders"], ORACLES["json_sales_order_lines"] = posting.NESTED_SALES[:2]
# Raw bodies: the whole ones are judged like any request, the others come out as they came in.
ORACLES["json_bodies"] = intake.intake("read_bodies", intake.CUSTOMER_COLUMNS, intake.CUSTOMER_RULES)
_BROKEN = " OR ".join(f"id % {m} = 0" for m in (31, 37, 41, 43, 47))
ORACLES["json_bodies_quarantined"] = reports.statement(
    f"""SELECT body, CASE WHEN {_BROKEN} THEN 'Malformed JSON body' ELSE 'Body has no request_id' END
    AS reject_reason FROM customer_body_feed WHERE {_BROKEN} OR id % 53 = 0 OR id % 59 = 0""")
ORACLES["stream_bodies_quarantined"] = ORACLES["json_bodies_quarantined"]
ORACLES["upsert_roles"] = reports.statement(
    f"""SELECT coalesce(c.id, s.id) AS id, coalesce(c.name, s.name) AS name,
    array_to_string(coalesce(c.permissions, s.permissions), ',') AS permissions,
    CASE WHEN c.id IS NULL THEN s.updated_at ELSE {intake.MOMENT} END AS updated_at
    FROM stored_roles s FULL JOIN roles c ON c.id = s.id""")
