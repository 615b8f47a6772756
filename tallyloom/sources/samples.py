"""Business tables and request feeds derived from the landing tables.

Every definition is one SELECT that both Spark and an ANSI SQL engine run unchanged, so
a check can rebuild exactly the same inputs. ``{name}`` stands for a table and ``{ntz}``
for the zone-less timestamp type. All rows of a landing table are used; rows that must
not resolve in a join get a negative id instead of being left out.
"""

from __future__ import annotations

TABLES = {
    "customers": """
        SELECT CAST(c_custkey + 1 AS BIGINT) AS id, c_name AS company_name,
               c_mktsegment AS industry,
               'Contact ' || CAST(c_custkey AS STRING) AS primary_contact_name,
               CASE WHEN c_custkey % 11 = 0 THEN NULL
                    ELSE 'c' || CAST(c_custkey AS STRING) || '@example.test' END AS primary_email,
               CASE WHEN c_custkey % 7 = 0 THEN NULL
                    ELSE '0700-' || CAST(c_custkey AS STRING) END AS primary_phone,
               'Box ' || CAST(c_custkey AS STRING) AS billing_address,
               CASE WHEN c_custkey % 3 = 0 THEN NULL
                    ELSE 'Yard ' || CAST(c_custkey AS STRING) END AS shipping_address,
               CASE c_custkey % 4 WHEN 0 THEN 'Lead' WHEN 1 THEN 'Active'
                    WHEN 2 THEN 'Inactive' ELSE 'Churned' END AS status,
               {ntz} '1997-01-01 00:00:00' AS updated_at
        FROM {customer}""",
    "products": """
        SELECT CAST(p_partkey + 1 AS BIGINT) AS id,
               CAST(substr(p_brand, 7) AS BIGINT) AS category_id,
               'SKU-' || CAST(p_partkey AS STRING) AS sku, p_name AS name,
               CASE WHEN p_partkey % 6 = 0 THEN NULL ELSE p_type || ' ' || p_name END
                   AS description,
               CAST(p_retailprice AS DECIMAL(18,2)) AS unit_price,
               CAST(CAST(p_retailprice AS DECIMAL(18,2)) * CAST(0.80 AS DECIMAL(3,2))
                   AS DECIMAL(18,2)) AS cost_price,
               CAST((p_partkey * 37) % 200 AS INT) AS stock_quantity,
               CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE p_size END AS reorder_point,
               CAST(p_size * 4 AS INT) AS optimal_reorder_quantity
        FROM {part}""",
    "categories": """
        SELECT DISTINCT CAST(substr(p_brand, 7) AS BIGINT) AS id, p_brand AS name,
               'All of ' || p_brand AS description
        FROM {part}""",
    "sales_orders": """
        SELECT CAST(o_orderkey + 1 AS BIGINT) AS id,
               CASE WHEN o_orderkey % 53 = 0 THEN CAST(-1 AS BIGINT)
                    ELSE CAST(o_custkey + 1 AS BIGINT) END AS customer_id,
               o_orderdate AS order_date,
               CASE WHEN o_orderstatus = 'F' THEN 'Shipped'
                    WHEN o_orderstatus = 'O' THEN 'Confirmed'
                    WHEN o_orderpriority = '5-LOW' THEN 'Cancelled' ELSE 'Draft' END AS status,
               CAST(o_totalprice AS DECIMAL(18,2)) AS total_amount,
               o_orderdate AS created_at, o_orderdate + INTERVAL '1' DAY AS updated_at
        FROM {orders}""",
    "order_lines": """
        SELECT CAST(l_orderkey * 8 + l_linenumber AS BIGINT) AS id,
               CAST(l_orderkey + 1 AS BIGINT) AS order_id,
               CAST(l_linenumber AS INT) AS line_number,
               CASE WHEN l_partkey % 19 = 0 THEN CAST(-1 AS BIGINT)
                    ELSE CAST(l_partkey + 1 AS BIGINT) END AS product_id,
               CAST(l_quantity AS INT) AS quantity,
               CAST(l_extendedprice AS DECIMAL(18,2)) AS unit_price,
               CAST(CAST(l_quantity AS INT) * CAST(l_extendedprice AS DECIMAL(18,2))
                   AS DECIMAL(18,2)) AS subtotal,
               l_shipdate AS created_at
        FROM {lineitem}""",
    "inventory_batches": """
        SELECT CASE WHEN l_partkey % 23 = 0 THEN CAST(-1 AS BIGINT)
                    ELSE CAST(l_partkey + 1 AS BIGINT) END AS product_id,
               CAST(l_quantity AS INT) AS quantity_remaining,
               CAST(l_extendedprice AS DECIMAL(18,2)) AS unit_cost,
               CASE l_returnflag WHEN 'A' THEN 'Available' WHEN 'R' THEN 'Quarantined'
                    ELSE 'Depleted' END AS status
        FROM {lineitem}""",
    "invoices": """
        SELECT CAST(o_orderkey + 1 AS BIGINT) AS id,
               'INV-' || CAST(o_orderkey AS STRING) AS invoice_number,
               CASE WHEN o_orderkey % 41 = 0 THEN NULL ELSE CAST(o_orderkey + 1 AS BIGINT) END
                   AS order_id,
               CAST(o_orderdate AS DATE) AS invoice_date,
               CAST(o_orderdate + INTERVAL '30' DAY AS DATE) AS due_date,
               CAST(o_totalprice AS DECIMAL(18,2)) AS subtotal,
               CAST(CAST(o_totalprice AS DECIMAL(18,2)) * CAST(0.16 AS DECIMAL(3,2))
                   AS DECIMAL(18,2)) AS tax_amount,
               CAST(CAST(o_totalprice AS DECIMAL(18,2))
                   + CAST(CAST(o_totalprice AS DECIMAL(18,2)) * CAST(0.16 AS DECIMAL(3,2))
                       AS DECIMAL(18,2)) AS DECIMAL(18,2)) AS total_amount,
               CASE WHEN o_orderkey % 6 = 3 THEN CAST(o_totalprice AS DECIMAL(18,2))
                    ELSE CAST(0 AS DECIMAL(18,2)) END AS amount_paid,
               CASE WHEN o_orderkey % 101 = 0 THEN NULL
                    WHEN o_orderkey % 6 = 0 THEN 'Draft' WHEN o_orderkey % 6 = 1 THEN 'Unpaid'
                    WHEN o_orderkey % 6 = 2 THEN 'Partial' WHEN o_orderkey % 6 = 3 THEN 'Paid'
                    WHEN o_orderkey % 6 = 4 THEN 'Overdue' ELSE 'Cancelled' END AS status,
               o_orderdate AS updated_at
        FROM {orders}""",
    "bills": """
        SELECT CAST(o_orderkey + 1 AS BIGINT) AS id,
               CAST((o_orderkey % 120) + 1 AS BIGINT) AS vendor_id,
               CAST(o_totalprice AS DECIMAL(18,2)) AS total_amount,
               CAST(0 AS DECIMAL(18,2)) AS amount_paid,
               CAST(CAST(o_totalprice AS DECIMAL(18,2)) * CAST(0.10 AS DECIMAL(3,2))
                   AS DECIMAL(18,2)) AS tax_amount,
               CASE WHEN o_orderstatus = 'F' THEN 'Paid' ELSE 'Draft' END AS status,
               CAST(o_orderdate AS DATE) AS issue_date,
               CAST(o_orderdate + INTERVAL '45' DAY AS DATE) AS due_date
        FROM {orders}""",
    "payments": """
        SELECT CAST(o_orderkey + 1 AS BIGINT) AS id,
               CAST((o_orderkey % 5000) + 1 AS BIGINT) AS invoice_id,
               CASE WHEN o_orderkey % 3 = 0 THEN NULL
                    ELSE 'REF-' || CAST(o_orderkey AS STRING) END AS payment_reference,
               CAST(o_totalprice AS DECIMAL(18,2)) AS amount_paid,
               o_orderdate AS payment_date,
               CASE o_orderkey % 5 WHEN 0 THEN 'Bank Transfer' WHEN 1 THEN 'Credit Card'
                    WHEN 2 THEN 'Cash' WHEN 3 THEN 'Mobile Money' ELSE 'Check' END
                   AS payment_method
        FROM {orders}""",
    "tax_payments": """
        SELECT CAST(o_orderkey + 1 AS BIGINT) AS id,
               CAST(year(o_orderdate) AS STRING) AS tax_period,
               CAST(CAST(o_totalprice AS DECIMAL(18,2)) * CAST(0.01 AS DECIMAL(3,2))
                   AS DECIMAL(18,2)) AS amount_paid,
               CAST(o_orderdate AS DATE) AS payment_date,
               'TX-' || CAST(o_orderkey AS STRING) AS reference_number
        FROM {orders}""",
    "accounts": """
        SELECT CAST(n_nationkey + 1 AS BIGINT) AS id,
               'AC-' || CAST(n_nationkey AS STRING) AS account_code, n_name AS name,
               CASE n_regionkey WHEN 0 THEN 'Asset' WHEN 1 THEN 'Liability'
                    WHEN 2 THEN 'Equity' WHEN 3 THEN 'Revenue' ELSE 'Expense' END AS type,
               n_nationkey % 7 <> 0 AS is_active, {ntz} '1997-01-01 00:00:00' AS updated_at
        FROM {nation}""",
    "journal_entries": """
        SELECT CAST(o_orderkey + 1 AS BIGINT) AS id, CAST(o_orderdate AS DATE) AS entry_date,
               'Entry ' || CAST(o_orderkey AS STRING) AS description,
               CASE WHEN o_orderkey % 10 = 9 THEN 'JournalReversal' END AS reference_type,
               CASE WHEN o_orderkey % 10 = 9 THEN CAST(o_orderkey AS BIGINT) END
                   AS reference_id,
               o_orderdate AS created_at, CAST(o_custkey + 1 AS BIGINT) AS created_by
        FROM {orders}""",
    "journal_entry_lines": """
        SELECT CAST((l_orderkey * 8 + l_linenumber) * 2 AS BIGINT) AS id,
               CAST(l_orderkey + 1 AS BIGINT) AS journal_entry_id,
               CAST((l_partkey % 30) + 1 AS BIGINT) AS account_id,
               CAST(l_extendedprice AS DECIMAL(18,2)) AS debit, CAST(0 AS DECIMAL(18,2)) AS credit
        FROM {lineitem}
        UNION ALL
        SELECT CAST((l_orderkey * 8 + l_linenumber) * 2 + 1 AS BIGINT),
               CAST(l_orderkey + 1 AS BIGINT), CAST((l_suppkey % 25) + 1 AS BIGINT),
               CAST(0 AS DECIMAL(18,2)), CAST(l_extendedprice AS DECIMAL(18,2))
        FROM {lineitem}""",
    "assets": """
        SELECT CAST(p_partkey + 1 AS BIGINT) AS id,
               'AST-' || CAST(p_partkey AS STRING) AS asset_tag, p_name AS name,
               CASE p_partkey % 5 WHEN 0 THEN 'Vehicle' WHEN 1 THEN 'Machinery'
                    WHEN 2 THEN 'IT Equipment' WHEN 3 THEN 'HVAC' ELSE 'Facility' END AS category,
               CAST(DATE '2010-01-01' + CAST(p_partkey % 3000 AS INT) AS DATE) AS purchase_date,
               CAST(p_retailprice AS DECIMAL(18,2)) AS initial_cost,
               CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE CAST(100 AS DECIMAL(18,2)) END
                   AS salvage_value,
               CAST(p_size % 11 AS INT) AS useful_life_years, 'Operational' AS status,
               {ntz} '1997-01-01 00:00:00' AS updated_at
        FROM {part}""",
    "budgets": """
        SELECT CAST(s_suppkey + 1 AS BIGINT) AS id, s_name AS department,
               CAST(1995 + s_suppkey % 4 AS STRING) AS fiscal_year,
               CAST(s_suppkey * 1000 + s_nationkey AS DECIMAL(18,2)) AS allocated_amount,
               CAST(s_acctbal AS DECIMAL(18,2)) AS spent_amount
        FROM {supplier}""",
    "opportunities": """
        SELECT CAST(o_orderkey + 1 AS BIGINT) AS id,
               CASE WHEN o_orderkey % 59 = 0 THEN CAST(-1 AS BIGINT)
                    ELSE CAST(o_custkey + 1 AS BIGINT) END AS customer_id,
               'Deal ' || CAST(o_orderkey AS STRING) AS title,
               CASE o_orderkey % 6 WHEN 0 THEN 'Lead' WHEN 1 THEN 'Qualified'
                    WHEN 2 THEN 'Proposal' WHEN 3 THEN 'Negotiation' WHEN 4 THEN 'Closed Won'
                    ELSE 'Closed Lost' END AS stage,
               CAST(o_totalprice AS DECIMAL(18,2)) AS estimated_value,
               CASE WHEN o_orderkey % 8 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) END
                   AS expected_close_date
        FROM {orders}""",
    "quotations": """
        SELECT CAST(o_orderkey + 1 AS BIGINT) AS id, CAST(o_custkey + 1 AS BIGINT) AS customer_id,
               'Q-' || CAST(o_orderkey AS STRING) AS quote_number,
               CASE WHEN o_orderkey % 9 = 0 THEN NULL
                    ELSE CAST(o_orderdate + INTERVAL '60' DAY AS DATE) END AS valid_until,
               CASE o_orderkey % 5 WHEN 0 THEN 'Draft' WHEN 1 THEN 'Sent' WHEN 2 THEN 'Accepted'
                    WHEN 3 THEN 'Expired' ELSE 'Rejected' END AS status,
               CAST(o_totalprice AS DECIMAL(18,2)) AS total_amount, o_orderdate AS created_at
        FROM {orders}""",
    "pricing_rules": """
        SELECT CAST(p_partkey + 1 AS BIGINT) AS id,
               'Rule ' || CAST(p_partkey AS STRING) AS rule_name,
               CASE WHEN p_partkey % 29 = 0 THEN CAST(-1 AS BIGINT)
                    ELSE CAST(p_partkey + 1 AS BIGINT) END AS product_id,
               CAST(p_size AS INT) AS min_quantity,
               CAST(p_size % 40 AS DECIMAL(18,2)) AS discount_percentage,
               p_partkey % 2 = 0 AS is_active
        FROM {part}""",
    "suppliers": """
        SELECT CASE WHEN s_suppkey % 3 = 0 THEN CAST(-1 - s_suppkey AS BIGINT)
                    ELSE CAST(s_suppkey + 1 AS BIGINT) END AS id,
               s_name AS company_name, 'Rep ' || CAST(s_suppkey AS STRING) AS contact_name,
               's' || CAST(s_suppkey AS STRING) || '@example.test' AS email,
               CASE WHEN s_suppkey % 4 = 0 THEN NULL
                    ELSE '0720-' || CAST(s_suppkey AS STRING) END AS phone,
               'Net 30' AS payment_terms,
               CASE s_suppkey % 3 WHEN 1 THEN 'Active' ELSE 'On Hold' END AS status,
               {ntz} '1996-06-01 00:00:00' AS created_at,
               {ntz} '1997-01-01 00:00:00' AS updated_at
        FROM {supplier}""",
    "vendors": """
        SELECT CASE WHEN s_suppkey % 2 = 0 THEN CAST(s_suppkey + 1 AS BIGINT)
                    ELSE CAST(-1 - s_suppkey AS BIGINT) END AS id,
               'Vendor ' || s_name AS name
        FROM {supplier}""",
    "purchase_orders": """
        SELECT CAST(o_orderkey + 1 AS BIGINT) AS id,
               'PO-' || CAST(o_orderkey AS STRING) AS po_number,
               CAST((o_orderkey % 110) + 1 AS BIGINT) AS supplier_id,
               CAST(o_orderdate AS DATE) AS order_date,
               CASE WHEN o_orderkey % 7 = 0 THEN NULL
                    ELSE CAST(o_orderdate + INTERVAL '14' DAY AS DATE) END
                   AS expected_delivery_date,
               CASE o_orderkey % 5 WHEN 0 THEN 'Draft' WHEN 1 THEN 'Submitted'
                    WHEN 2 THEN 'Partially Received' WHEN 3 THEN 'Received'
                    ELSE 'Cancelled' END AS status,
               CAST(o_totalprice AS DECIMAL(18,2)) AS total_amount, o_orderdate AS created_at,
               o_orderdate + INTERVAL '2' DAY AS updated_at
        FROM {orders}""",
    "purchase_order_lines": """
        SELECT CAST(l_orderkey + 1 AS BIGINT) AS purchase_order_id,
               CAST(l_linenumber AS INT) AS line_number,
               CAST(l_partkey + 1 AS BIGINT) AS product_id,
               CAST(l_quantity AS INT) AS quantity_ordered, CAST(0 AS INT) AS quantity_received,
               CAST(l_extendedprice AS DECIMAL(18,2)) AS unit_cost
        FROM {lineitem}""",
    "shipments": """
        SELECT CAST(o_orderkey + 1 AS BIGINT) AS id,
               'Stage ' || CAST(o_orderkey % 4 AS STRING) AS status,
               CASE WHEN o_orderkey % 12 = 0 THEN NULL
                    ELSE o_orderdate + INTERVAL '21' DAY END AS estimated_arrival,
               o_orderdate AS updated_at
        FROM {orders}""",
    "users": """
        SELECT CASE WHEN c_custkey % 10 = 0 THEN CAST(-1 - c_custkey AS BIGINT)
                    ELSE CAST(c_custkey + 1 AS BIGINT) END AS id,
               'user' || CAST(c_custkey AS STRING) AS username,
               'u' || CAST(c_custkey AS STRING) || '@example.test' AS email,
               'First' || CAST(c_custkey % 97 AS STRING) AS first_name,
               'Last' || CAST(c_custkey % 89 AS STRING) AS last_name,
               CASE WHEN c_custkey % 25 = 3 THEN NULL
                    ELSE CAST(113 + c_custkey % 14 AS BIGINT) END AS role_id,
               c_custkey % 6 <> 0 AS is_active, {ntz} '1997-01-01 00:00:00' AS updated_at
        FROM {customer}""",
    "departments": """
        SELECT CAST(r_regionkey + 1 AS BIGINT) AS id, r_name AS name FROM {region}""",
    "employees": """
        SELECT CAST(c_custkey + 1 AS BIGINT) AS id,
               CAST(c_custkey + 1 AS BIGINT) AS user_id,
               'First' || CAST(c_custkey % 97 AS STRING) AS first_name,
               'Last' || CAST(c_custkey % 89 AS STRING) AS last_name,
               CAST((c_nationkey % 7) + 1 AS BIGINT) AS department_id, c_mktsegment AS job_title,
               CAST(DATE '2012-03-01' + CAST(c_custkey % 2500 AS INT) AS DATE) AS hire_date,
               CAST(c_acctbal AS DECIMAL(18,2)) AS base_salary,
               {ntz} '1996-06-01 00:00:00' AS created_at,
               {ntz} '1997-01-01 00:00:00' AS updated_at
        FROM {customer}""",
    "leave_requests": """
        SELECT CAST(event_id + 1 AS BIGINT) AS id, CAST(user_id + 1 AS BIGINT) AS employee_id,
               CASE event_id % 3 WHEN 0 THEN 'Pending' WHEN 1 THEN 'Approved'
                    ELSE 'Rejected' END AS status, ts AS created_at
        FROM {events}""",
    "performance_reviews": """
        SELECT CAST(event_id + 1 AS BIGINT) AS id, CAST(user_id + 1 AS BIGINT) AS employee_id,
               CASE WHEN event_id % 4 = 0 THEN NULL
                    ELSE CAST((user_id * 7) % 100 + 1 AS BIGINT) END AS reviewer_id,
               CAST(ts AS DATE) AS review_date, CAST(event_id % 5 + 1 AS INT) AS rating,
               CASE WHEN event_id % 2 = 0 THEN NULL
                    ELSE 'Review ' || CAST(event_id AS STRING) END AS comments
        FROM {events}""",
    "payroll_runs": """
        SELECT CAST(year(o_orderdate) * 100 + month(o_orderdate) AS BIGINT) AS id,
               CAST(year(o_orderdate) AS STRING) || '-'
                   || lpad(CAST(month(o_orderdate) AS STRING), 2, '0') AS pay_period,
               CAST(max(o_orderdate) AS DATE) AS run_date, 'Draft' AS status,
               CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DECIMAL(18,2)) AS total_gross,
               CAST(sum(CAST(CAST(o_totalprice AS DECIMAL(18,2))
                   * CAST(0.30 AS DECIMAL(3,2)) AS DECIMAL(18,2))) AS DECIMAL(18,2))
                   AS total_taxes,
               CAST(sum(CAST(o_totalprice AS DECIMAL(18,2)))
                   - sum(CAST(CAST(o_totalprice AS DECIMAL(18,2))
                   * CAST(0.30 AS DECIMAL(3,2)) AS DECIMAL(18,2))) AS DECIMAL(18,2)) AS total_net
        FROM {orders} GROUP BY year(o_orderdate), month(o_orderdate)""",
    "job_postings": """
        SELECT CASE WHEN p_partkey % 4 = 0 THEN CAST(-1 - p_partkey AS BIGINT)
                    ELSE CAST(p_partkey + 1 AS BIGINT) END AS id,
               p_name AS title, p_brand AS department,
               CASE WHEN p_partkey % 3 = 0 THEN 'Contract' ELSE 'Full-Time' END
                   AS employment_type,
               CASE p_partkey % 4 WHEN 0 THEN 'Draft' WHEN 1 THEN 'Open' WHEN 2 THEN 'Closed'
                    ELSE 'On Hold' END AS status,
               CAST(DATE '2023-01-01' + CAST(p_partkey % 300 AS INT) AS DATE) AS posted_date
        FROM {part}""",
    "applicants": """
        SELECT CAST(event_id + 1 AS BIGINT) AS id,
               CAST(event_id % 180 + 1 AS BIGINT) AS job_posting_id,
               'First' || CAST(event_id % 97 AS STRING) AS first_name,
               'Last' || CAST(event_id % 89 AS STRING) AS last_name,
               'a' || CAST(event_id AS STRING) || '@example.test' AS email,
               CASE event_id % 6 WHEN 0 THEN 'Applied' WHEN 1 THEN 'Screening'
                    WHEN 2 THEN 'Interviewing' WHEN 3 THEN 'Offered' WHEN 4 THEN 'Hired'
                    ELSE 'Rejected' END AS pipeline_stage,
               CAST(ts AS DATE) AS application_date
        FROM {events}""",
    "training_programs": """
        SELECT CAST(page_id + 1 AS BIGINT) AS id, 'Training ' || CAST(page_id AS STRING) AS title,
               'See ' || url AS description,
               CASE WHEN page_id % 5 = 0 THEN NULL
                    ELSE 'Trainer ' || CAST(page_id % 9 AS STRING) END AS trainer_name,
               CAST(DATE '2024-01-01' + CAST(page_id % 60 AS INT) AS DATE) AS scheduled_date,
               CASE page_id % 4 WHEN 0 THEN 'Scheduled' WHEN 1 THEN 'In Progress'
                    WHEN 2 THEN 'Completed' ELSE 'Cancelled' END AS status
        FROM {pages}""",
    "audit_logs": """
        SELECT CAST(event_id + 1 AS BIGINT) AS id,
               CASE WHEN event_id % 17 = 0 THEN NULL ELSE CAST(user_id + 1 AS BIGINT) END
                   AS user_id,
               event_type AS action, ts AS created_at
        FROM {events}""",
    "warehouses": """
        SELECT CAST(n_nationkey + 1 AS BIGINT) AS id, n_name AS name,
               'Road ' || CAST(n_nationkey AS STRING) AS location_address,
               CASE WHEN n_nationkey % 4 = 0 THEN NULL ELSE CAST(n_nationkey + 1 AS BIGINT) END
                   AS manager_id,
               n_nationkey % 6 <> 0 AS is_active
        FROM {nation}""",
    "storage_bins": """
        SELECT CAST(s_suppkey + 1 AS BIGINT) AS id, CAST(s_nationkey + 1 AS BIGINT) AS warehouse_id,
               'Z' || CAST(s_suppkey % 4 AS STRING) AS zone,
               'BIN-' || CAST(s_suppkey AS STRING) AS barcode,
               CAST(500 + s_suppkey % 50 AS DECIMAL(18,2)) AS max_weight
        FROM {supplier}""",
    "bin_inventory": """
        SELECT CAST(l_suppkey * 1000000000 + l_partkey + 1 AS BIGINT) AS id,
               CAST(l_suppkey + 1 AS BIGINT) AS bin_id, CAST(l_partkey + 1 AS BIGINT) AS product_id,
               CAST(SUM(CAST(l_quantity AS INT)) AS BIGINT) AS quantity
        FROM {lineitem} GROUP BY l_suppkey, l_partkey""",
    "stock_movements": """
        SELECT CAST(event_id + 1 AS BIGINT) AS id,
               CAST(event_id % 200 + 1 AS BIGINT) AS product_id,
               CASE WHEN event_type IN ('view', 'signup') THEN NULL
                    ELSE CAST(user_id % 10 + 1 AS BIGINT) END AS from_bin_id,
               CASE WHEN event_type IN ('click', 'signup') THEN NULL
                    ELSE CAST(event_id % 10 + 1 AS BIGINT) END AS to_bin_id,
               CAST(event_id % 13 AS INT) AS quantity,
               CASE event_type WHEN 'view' THEN 'Receiving' WHEN 'click' THEN 'Shipping'
                    WHEN 'purchase' THEN 'Transfer' WHEN 'signup' THEN 'Adjustment'
                    ELSE 'Teleport' END AS movement_type,
               CASE WHEN event_id % 3 = 0 THEN NULL ELSE CAST(user_id + 1 AS BIGINT) END
                   AS moved_by,
               CASE WHEN event_id % 4 = 0 THEN NULL ELSE 'Count' END AS reference_type,
               CASE WHEN event_id % 4 = 0 THEN NULL ELSE CAST(event_id + 1 AS BIGINT) END
                   AS reference_id,
               ts AS movement_date
        FROM {events}""",
}
