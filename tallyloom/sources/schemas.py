"""Declared schemas: the landing tables and the business tables (no inference anywhere)."""

from __future__ import annotations

# Landing tables as delivered.
LANDING = {
    "region": "r_regionkey INT, r_name STRING",
    "nation": "n_nationkey INT, n_name STRING, n_regionkey INT",
    "customer": (
        "c_custkey BIGINT, c_name STRING, c_nationkey INT, c_acctbal DOUBLE, c_mktsegment STRING"
    ),
    "supplier": "s_suppkey BIGINT, s_name STRING, s_nationkey INT, s_acctbal DOUBLE",
    "part": (
        "p_partkey BIGINT, p_name STRING, p_brand STRING, p_type STRING, p_size INT, "
        "p_retailprice DOUBLE"
    ),
    "orders": (
        "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE, "
        "o_orderdate TIMESTAMP_NTZ, o_orderpriority STRING"
    ),
    "lineitem": (
        "l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT, "
        "l_quantity DOUBLE, l_extendedprice DOUBLE, l_discount DOUBLE, l_tax DOUBLE, "
        "l_returnflag STRING, l_linestatus STRING, l_shipdate TIMESTAMP_NTZ"
    ),
    "events": (
        "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, "
        "props STRING"
    ),
    "pages": "page_id BIGINT, url STRING, html STRING",
}

MONEY = "DECIMAL(18,2)"

# Business tables. The operators only ever touch these columns.
BUSINESS = {
    "customers": (
        "id BIGINT, company_name STRING, industry STRING, primary_contact_name STRING, "
        "primary_email STRING, primary_phone STRING, billing_address STRING, "
        "shipping_address STRING, status STRING, updated_at TIMESTAMP_NTZ"
    ),
    "opportunities": (
        "id BIGINT, customer_id BIGINT, title STRING, stage STRING, "
        f"estimated_value {MONEY}, expected_close_date DATE"
    ),
    "quotations": (
        "id BIGINT, customer_id BIGINT, quote_number STRING, valid_until DATE, status STRING, "
        f"total_amount {MONEY}, created_at TIMESTAMP_NTZ"
    ),
    "pricing_rules": (
        "id BIGINT, rule_name STRING, product_id BIGINT, min_quantity INT, "
        f"discount_percentage {MONEY}, is_active BOOLEAN"
    ),
    "sales_orders": (
        f"id BIGINT, customer_id BIGINT, order_date TIMESTAMP_NTZ, status STRING, "
        f"total_amount {MONEY}, created_at TIMESTAMP_NTZ, updated_at TIMESTAMP_NTZ"
    ),
    "order_lines": (
        "id BIGINT, order_id BIGINT, line_number INT, product_id BIGINT, quantity INT, "
        f"unit_price {MONEY}, subtotal {MONEY}, created_at TIMESTAMP_NTZ"
    ),
    "products": (
        "id BIGINT, category_id BIGINT, sku STRING, name STRING, description STRING, "
        f"unit_price {MONEY}, cost_price {MONEY}, stock_quantity INT, reorder_point INT, "
        "optimal_reorder_quantity INT"
    ),
    "categories": "id BIGINT, name STRING, description STRING",
    "warehouses": (
        "id BIGINT, name STRING, location_address STRING, manager_id BIGINT, is_active BOOLEAN"
    ),
    "storage_bins": (
        f"id BIGINT, warehouse_id BIGINT, zone STRING, barcode STRING, max_weight {MONEY}"
    ),
    "bin_inventory": "id BIGINT, bin_id BIGINT, product_id BIGINT, quantity BIGINT",
    "inventory_batches": (
        f"product_id BIGINT, quantity_remaining INT, unit_cost {MONEY}, status STRING"
    ),
    "stock_movements": (
        "id BIGINT, product_id BIGINT, from_bin_id BIGINT, to_bin_id BIGINT, quantity INT, "
        "movement_type STRING, moved_by BIGINT, reference_type STRING, reference_id BIGINT, "
        "movement_date TIMESTAMP_NTZ"
    ),
    "suppliers": (
        "id BIGINT, company_name STRING, contact_name STRING, email STRING, phone STRING, "
        "payment_terms STRING, status STRING, created_at TIMESTAMP_NTZ, updated_at TIMESTAMP_NTZ"
    ),
    "vendors": "id BIGINT, name STRING",
    "purchase_orders": (
        "id BIGINT, po_number STRING, supplier_id BIGINT, order_date DATE, "
        f"expected_delivery_date DATE, status STRING, total_amount {MONEY}, "
        "created_at TIMESTAMP_NTZ, updated_at TIMESTAMP_NTZ"
    ),
    "purchase_order_lines": (
        "purchase_order_id BIGINT, line_number INT, product_id BIGINT, quantity_ordered INT, "
        f"quantity_received INT, unit_cost {MONEY}"
    ),
    "shipments": (
        "id BIGINT, status STRING, estimated_arrival TIMESTAMP_NTZ, updated_at TIMESTAMP_NTZ"
    ),
    "invoices": (
        "id BIGINT, invoice_number STRING, order_id BIGINT, invoice_date DATE, due_date DATE, "
        f"subtotal {MONEY}, tax_amount {MONEY}, total_amount {MONEY}, amount_paid {MONEY}, "
        "status STRING, updated_at TIMESTAMP_NTZ"
    ),
    "bills": (
        f"id BIGINT, vendor_id BIGINT, total_amount {MONEY}, amount_paid {MONEY}, "
        f"tax_amount {MONEY}, status STRING, issue_date DATE, due_date DATE"
    ),
    "payments": (
        f"id BIGINT, invoice_id BIGINT, payment_reference STRING, amount_paid {MONEY}, "
        "payment_date TIMESTAMP_NTZ, payment_method STRING"
    ),
    "accounts": (
        "id BIGINT, account_code STRING, name STRING, type STRING, is_active BOOLEAN, "
        "updated_at TIMESTAMP_NTZ"
    ),
    "journal_entries": (
        "id BIGINT, entry_date DATE, description STRING, reference_type STRING, "
        "reference_id BIGINT, created_at TIMESTAMP_NTZ, created_by BIGINT"
    ),
    "journal_entry_lines": (
        f"id BIGINT, journal_entry_id BIGINT, account_id BIGINT, debit {MONEY}, credit {MONEY}"
    ),
    "tax_payments": (
        f"id BIGINT, tax_period STRING, amount_paid {MONEY}, payment_date DATE, "
        "reference_number STRING"
    ),
    "assets": (
        "id BIGINT, asset_tag STRING, name STRING, category STRING, purchase_date DATE, "
        f"initial_cost {MONEY}, salvage_value {MONEY}, useful_life_years INT, status STRING, "
        "updated_at TIMESTAMP_NTZ"
    ),
    "budgets": (
        f"id BIGINT, department STRING, fiscal_year STRING, allocated_amount {MONEY}, "
        f"spent_amount {MONEY}"
    ),
    "roles": "id BIGINT, name STRING, permissions ARRAY<STRING>",
    "users": (
        "id BIGINT, username STRING, email STRING, first_name STRING, last_name STRING, "
        "role_id BIGINT, is_active BOOLEAN, updated_at TIMESTAMP_NTZ"
    ),
    "employees": (
        "id BIGINT, user_id BIGINT, first_name STRING, last_name STRING, department_id BIGINT, "
        f"job_title STRING, hire_date DATE, base_salary {MONEY}, created_at TIMESTAMP_NTZ, "
        "updated_at TIMESTAMP_NTZ"
    ),
    "departments": "id BIGINT, name STRING",
    "leave_requests": (
        "id BIGINT, employee_id BIGINT, status STRING, created_at TIMESTAMP_NTZ"
    ),
    "performance_reviews": (
        "id BIGINT, employee_id BIGINT, reviewer_id BIGINT, review_date DATE, rating INT, "
        "comments STRING"
    ),
    "payroll_runs": (
        f"id BIGINT, pay_period STRING, run_date DATE, status STRING, total_gross {MONEY}, "
        f"total_taxes {MONEY}, total_net {MONEY}"
    ),
    "job_postings": (
        "id BIGINT, title STRING, department STRING, employment_type STRING, status STRING, "
        "posted_date DATE"
    ),
    "applicants": (
        "id BIGINT, job_posting_id BIGINT, first_name STRING, last_name STRING, email STRING, "
        "pipeline_stage STRING, application_date DATE"
    ),
    "training_programs": (
        "id BIGINT, title STRING, description STRING, trainer_name STRING, scheduled_date DATE, "
        "status STRING"
    ),
    "audit_logs": "id BIGINT, user_id BIGINT, action STRING, created_at TIMESTAMP_NTZ",
}
