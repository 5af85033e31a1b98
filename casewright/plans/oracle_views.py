"""The lab views once more as ANSI SQL, for the independent check in DuckDB.

``with_views(sql)`` puts the views a query mentions (and the views those mention) in front of it.
"""

from __future__ import annotations

import re


def _values(rows: list[tuple]) -> str:
    def cell(value: object) -> str:
        if value is None:
            return "NULL"
        return str(value) if isinstance(value, int) else "'" + str(value).replace("'", "''") + "'"

    return ", ".join("(" + ", ".join(cell(v) for v in row) + ")" for row in rows)


def _fixed() -> dict[str, str]:
    """Views over plain word lists shared with the vocabulary."""
    from casewright import vocabulary as V
    from casewright.plans import lab_views as L

    return {
        "v_location": "SELECT * FROM (VALUES "
        + _values(list(enumerate(L.LOCATIONS)))
        + ") t(id, description)",
        "v_alias": "SELECT * FROM (VALUES "
        + _values(list(V.LOCATION_ALIASES.items()))
        + ") t(raw, label)",
        "v_planning": "SELECT * FROM (VALUES "
        + _values([(v,) for v in V.PLANNING_LOCATIONS])
        + ") t(location)",
        "v_priority": "SELECT * FROM (VALUES "
        + _values([(v, i) for i, v in enumerate(V.CATEGORY_PRIORITY, 1)])
        + ") t(pattern, pos)",
        "v_location_order": "SELECT * FROM (VALUES "
        + _values([(v, i) for i, v in enumerate(V.LOCATION_ORDER, 1)])
        + ") t(location, pos)",
        "v_workload_order": "SELECT * FROM (VALUES "
        + _values([(v, i) for i, v in enumerate(V.WORKLOAD_CATEGORY_ORDER, 1)])
        + ") t(category, pos)",
        "v_checkin_order": "SELECT * FROM (VALUES "
        + _values([(v, i) for i, v in enumerate(V.CHECKIN_CATEGORY_ORDER, 1)])
        + ") t(category, pos)",
        "v_stage": "SELECT * FROM (VALUES "
        + _values([(g, loc) for g, locs in V.STAGE_GROUPS.items() for loc in locs])
        + ") t(stage_group, location)",
        "listed_holiday": "SELECT CAST(d AS DATE) AS d FROM (VALUES "
        + _values([(d.isoformat(),) for d in sorted(L.CALENDAR.listed)])
        + ") t(d)",
    }


VIEWS = {
    "all_days": """
        SELECT CAST(d AS DATE) AS d FROM (
          SELECT unnest(generate_series(TIMESTAMP '1990-12-01', TIMESTAMP '2002-12-31', INTERVAL 1 DAY)) AS d
          UNION ALL
          SELECT unnest(generate_series(TIMESTAMP '2022-12-01', TIMESTAMP '2024-03-31', INTERVAL 1 DAY)) AS d
        ) x""",
    "rule_holiday": """
        SELECT make_date(y, m, dd) AS d FROM (SELECT DISTINCT year(d) AS y FROM all_days) ys
          CROSS JOIN (VALUES (1, 1), (1, 2), (7, 4), (11, 11), (12, 25), (12, 26)) f(m, dd)
        UNION ALL
        SELECT max(d) FROM all_days WHERE month(d) = 5 AND isodow(d) = 1 GROUP BY year(d)
        UNION ALL
        SELECT min(d) FROM all_days WHERE month(d) = 9 AND isodow(d) = 1 GROUP BY year(d)
        UNION ALL
        SELECT min(d) + 21 FROM all_days WHERE month(d) = 11 AND isodow(d) = 4 GROUP BY year(d)
        UNION ALL
        SELECT min(d) + 22 FROM all_days WHERE month(d) = 11 AND isodow(d) = 4 GROUP BY year(d)""",
    "holiday": """
        SELECT d FROM listed_holiday
        UNION
        SELECT d FROM rule_holiday WHERE year(d) NOT IN (SELECT year(d) FROM listed_holiday)""",
    "bday": """
        SELECT d, row_number() OVER (ORDER BY d) AS n FROM all_days
        WHERE isodow(d) < 6 AND d NOT IN (SELECT d FROM holiday WHERE d IS NOT NULL)""",
    "cal": """
        SELECT a.d, p.d AS prev_bd FROM all_days a ASOF LEFT JOIN bday p ON a.d > p.d""",
    "lines": """
        SELECT l_orderkey, min(l_shipdate) AS first_ship, max(l_shipdate) AS last_ship
        FROM lineitem GROUP BY l_orderkey""",
    "last_line": """
        SELECT l_orderkey, l_suppkey AS last_location_id FROM (
          SELECT l_orderkey, l_suppkey, row_number() OVER (PARTITION BY l_orderkey
            ORDER BY l_shipdate DESC, l_linenumber DESC, l_partkey DESC, l_suppkey DESC) AS rn
          FROM lineitem) x WHERE rn = 1""",
    "cases": """
        SELECT o_orderkey AS case_id, CAST(o_orderkey AS VARCHAR) AS case_number,
          CASE WHEN o_orderpriority = '1-URGENT' THEN 'R' || (o_orderkey % 90)
               ELSE CAST(o_orderkey % 9000 + 1000 AS VARCHAR) END AS pan_number,
          CASE o_orderstatus WHEN 'F' THEN 'Invoiced' WHEN 'O' THEN 'In Production' ELSE
            CASE WHEN o_orderkey % 5 = 0 THEN 'Submitted' WHEN o_orderkey % 7 = 0 THEN 'Cancelled'
                 ELSE 'On Hold' END END AS status,
          coalesce(first_ship, o_orderdate + INTERVAL 30 DAY) AS ship_date,
          coalesce(first_ship, o_orderdate + INTERVAL 30 DAY) + INTERVAL 2 DAY AS due_date,
          o_orderdate AS date_in, o_orderdate AS create_date,
          CASE WHEN o_orderstatus = 'F'
               THEN coalesce(last_ship, first_ship, o_orderdate + INTERVAL 30 DAY) END AS invoice_date,
          CASE WHEN o_orderstatus = 'P'
               THEN coalesce(first_ship, o_orderdate + INTERVAL 30 DAY) END AS hold_date,
          CASE o_orderkey % 5 WHEN 0 THEN 'Production, Waiting on Scan' WHEN 1 THEN 'Airway, How to Proceed'
            WHEN 2 THEN 'Email Plan,Waiting on Approval' WHEN 3 THEN 'Zoom Plan, Waiting on Approval'
            ELSE 'Customer Request' END AS hold_status,
          CASE o_orderkey % 8
            WHEN 0 THEN '(AFU) ' || month(o_orderdate) || '/' || day(o_orderdate) || ' waiting on scan'
            WHEN 1 THEN 'zfu' || month(o_orderdate) || '/' || day(o_orderdate) || ' then (EFU) '
                     || (o_orderkey % 12 + 1) || '/' || (o_orderkey % 28 + 1)
            WHEN 2 THEN '(ZFU)' || month(o_orderdate) || '/' || day(o_orderdate)
            WHEN 3 THEN 'no date given' WHEN 4 THEN '(AFU) 2/30 call back' WHEN 5 THEN '(EFU) 2/29 plan'
            WHEN 6 THEN 'AFU 13/40, afu 7/4' END AS hold_reason,
          last_location_id, o_orderpriority = '2-HIGH' AS local_delivery,
          CAST(o_custkey AS VARCHAR) AS customer_id, 'Dr ' || o_custkey AS doctor_name,
          CASE WHEN o_orderkey % 13 <> 0 THEN 'Pat' || (o_orderkey % 100) END AS patient_first,
          'Doe' || (o_orderkey % 37) AS patient_last,
          CASE WHEN o_orderkey % 53 = 0 THEN 'R' ELSE 'D' END AS type,
          o_orderkey % 97 = 0 AS deleted,
          CASE WHEN o_orderkey % 3 <> 0 THEN o_orderkey % 61 = 0 END AS is_adjustment,
          CASE WHEN o_orderkey % 3 = 0 THEN 'North Lab' ELSE 'South Lab' END AS lab_name,
          CAST(o_totalprice AS DECIMAL(18,2)) AS taxable_amount,
          CAST(o_orderkey % 100 AS DECIMAL(18,2)) AS non_taxable_amount,
          CAST(o_orderkey % 10 AS DECIMAL(18,2)) AS sales_discount,
          CAST(o_orderkey % 4 AS DECIMAL(18,2)) AS remake_discount,
          CAST(o_orderkey % 20 AS DECIMAL(18,2)) AS total_tax,
          CAST(o_totalprice AS DECIMAL(18,2)) AS total_charge,
          CASE o_orderkey % 10 WHEN 0 THEN 'Remake' WHEN 5 THEN '  ' END AS remake,
          CASE WHEN o_orderkey % 10 = 0 THEN
            CASE o_orderkey % 3 WHEN 0 THEN 'Fit' WHEN 1 THEN 'Shade' ELSE 'Broken' END END AS remake_reason,
          CASE WHEN o_orderkey % 4 = 0 THEN 'note ' || o_orderkey END AS work_order_notes
        FROM orders LEFT JOIN lines ON lines.l_orderkey = o_orderkey
          LEFT JOIN last_line ON last_line.l_orderkey = o_orderkey""",
    "case_products": """
        SELECT l_orderkey AS case_id, l_linenumber AS case_product_id, l_partkey AS product_id,
          l_suppkey AS source_id, l_shipdate AS line_date, CAST(l_quantity AS INTEGER) AS quantity,
          CAST(l_extendedprice AS DECIMAL(18,2)) AS unit_price,
          CAST(l_extendedprice AS DECIMAL(18,2)) AS extended_amount,
          CAST(l_discount AS DECIMAL(18,2)) AS sales_discount,
          CAST(l_tax AS DECIMAL(18,2)) AS remake_discount,
          CASE l_returnflag WHEN 'R' THEN 'R' WHEN 'N' THEN '' END AS remake
        FROM lineitem""",
    "products": """
        SELECT p_partkey AS product_id,
          CASE WHEN p_size = 50 THEN '' WHEN p_size = 49 THEN NULL
            WHEN p_type = 'LARGE' THEN 'Hybrid'
            WHEN p_type = 'ECONOMY' THEN CASE WHEN p_size % 2 = 0 THEN 'E² Expanders' ELSE 'E-expander Plus' END
            WHEN p_type = 'SMALL' THEN CASE WHEN p_size % 2 = 0 THEN 'Lab to Lab' ELSE 'Lab to lab' END
            WHEN p_type = 'MEDIUM' THEN CASE WHEN p_size % 2 = 0 THEN 'Metal' ELSE 'Clear' END
            WHEN p_type = 'PROMO' THEN CASE WHEN p_size % 2 = 0 THEN 'Marpe' ELSE 'Wire Bending' END
            WHEN p_type = 'STANDARD' THEN CASE WHEN p_size % 2 = 0 THEN 'Airway' ELSE 'Accessories' END
          END AS category,
          CASE WHEN p_size % 10 = 0 THEN 'Rush ' || p_name ELSE p_name END AS description,
          CAST(p_size AS DECIMAL(18,2)) AS unit_value
        FROM part""",
    "case_tasks": """
        SELECT l_orderkey AS case_id, l_linenumber AS case_product_id, 'task' || l_linenumber AS task,
          'dept' || (l_linenumber % 3) AS department,
          CASE WHEN l_linestatus = 'F' THEN l_shipdate END AS complete_date,
          l_partkey AS part_id, l_suppkey AS source_id
        FROM lineitem""",
    "task_history": """
        SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS case_id,
          json_extract_string(props, '$.k') AS case_number, event_id % 5 AS case_product_id,
          CASE event_type WHEN 'click' THEN '3dplan' WHEN 'error' THEN '3dfin-exp'
            WHEN 'purchase' THEN '3drevise' WHEN 'signup' THEN '3dd' WHEN 'view' THEN '3dcf' END AS task,
          CAST(user_id AS VARCHAR) AS completed_by, ts AS complete_date,
          CASE WHEN event_id % 10 = 0 THEN 'Yes' ELSE 'No' END AS rejected,
          CAST(event_id % 3 + 1 AS INTEGER) AS quantity, value
        FROM events""",
    "planned": """
        SELECT case_id, task, case_product_id,
          CAST(CAST(CAST(value AS DECIMAL(18,2)) AS DECIMAL(18,4)) * CAST(0.01 AS DECIMAL(3,2))
               AS DECIMAL(18,4)) AS duration
        FROM (SELECT *, row_number() OVER (PARTITION BY case_id, task, case_product_id
                ORDER BY complete_date DESC, event_id DESC) AS rn FROM task_history) x
        WHERE rn = 1""",
    "employees": """
        SELECT c_custkey AS employee_id, 'Given' || c_custkey || ' Mid Family' || c_custkey AS staff_name,
          'payroll ' || c_custkey AS payroll_name,
          CASE WHEN c_mktsegment = 'HOUSEHOLD' THEN 'z_Not On Report'
               WHEN c_custkey % 11 <> 0 THEN c_mktsegment END AS team,
          CAST(c_custkey % 3 AS INTEGER) AS training_plan
        FROM customer WHERE c_custkey IN (SELECT user_id FROM events)""",
    "timesheets": """
        SELECT CAST(ts AS DATE) AS date, 'payroll ' || user_id AS name,
          CAST(CASE WHEN user_id % 17 = 0 THEN 0 ELSE count(DISTINCT hour(ts)) END AS DOUBLE) AS work_hours
        FROM events GROUP BY CAST(ts AS DATE), user_id""",
    "case_links": """
        SELECT o_orderkey AS case_id, o_orderkey - 1 - o_orderkey % 7 AS link_case_id,
          CASE WHEN o_orderkey % 3 = 0 THEN 'Remake Of ' || (o_orderkey - 1) ELSE 'Split From' END AS notes
        FROM orders WHERE o_orderkey - 1 - o_orderkey % 7 >= 0""",
    "audit_trail": """
        SELECT l_orderkey AS case_id,
          CASE l_suppkey % 23 WHEN 0 THEN NULL WHEN 1 THEN 'Web' WHEN 2 THEN 'Solo'
            ELSE 'User' || (l_suppkey % 23) || ' Surname' || (l_suppkey % 23) END AS created_by,
          l_shipdate + to_hours(l_partkey % 24) AS create_date,
          CASE l_linenumber % 3 WHEN 0 THEN 'New Case' WHEN 1 THEN 'Accept Remote Case' ELSE 'Edited' END AS type,
          l_linenumber AS line, l_partkey AS part_id, l_suppkey AS source_id
        FROM lineitem""",
    "customers": """
        SELECT CAST(c_custkey AS VARCHAR) AS customer_id, 'Practice ' || (c_custkey // 2) AS practice_name,
          CASE WHEN r_name <> 'AFRICA' THEN r_name END AS dental_group,
          CASE WHEN c_custkey % 4 <> 0 THEN 'First' || c_custkey END AS first_name,
          'Last' || (c_custkey % 50) AS last_name, 'Rep ' || (c_custkey % 12) AS sales_person,
          c_mktsegment AS type,
          CASE WHEN c_custkey % 3 <> 0 THEN CASE WHEN c_custkey % 2 = 0 THEN 'Ortho' ELSE 'General' END END AS specialty,
          'City ' || (c_custkey % 40) AS city, n_name AS state,
          CASE WHEN c_custkey % 11 = 0 THEN 'Rep ' || (c_custkey % 5) END AS referred_by,
          CASE WHEN c_custkey % 5 <> 0 THEN 'front' || c_custkey || '@practice' || (c_custkey // 2) || '.example' END AS email,
          phone AS office_phone, CASE WHEN c_custkey % 3 = 0 THEN '556-' || c_custkey END AS cell,
          CASE WHEN c_custkey % 4 = 1 THEN phone END AS fax, street AS address1,
          CASE WHEN c_custkey % 7 = 0 THEN 'Suite ' || (c_custkey % 20) END AS address2,
          lpad(CAST(c_custkey % 100000 AS VARCHAR), 5, '0') AS zip_code, n_name AS country,
          CASE WHEN c_custkey % 2 = 0 THEN 'Last' || (c_custkey % 50) END AS bill_contact,
          CASE WHEN c_custkey % 6 <> 1 THEN 'billing' || c_custkey || '@practice' || (c_custkey // 2) || '.example' END
            AS bill_email,
          phone AS bill_phone, street AS bill_address1,
          CASE WHEN c_custkey % 7 = 0 THEN 'Suite ' || (c_custkey % 20) END AS bill_address2,
          'City ' || (c_custkey % 40) AS bill_city, n_name AS bill_state,
          lpad(CAST(c_custkey % 100000 AS VARCHAR), 5, '0') AS bill_zip_code, n_name AS bill_country,
          CASE WHEN c_custkey % 12 <> 0 THEN CAST(DATE '1998-06-15' - CAST(c_custkey % 200 AS INTEGER) AS DATE) END
            AS last_payment_date,
          CASE WHEN c_custkey % 6 = 0 THEN '' ELSE 'Catalog ' || (c_custkey % 4) END AS price_catalog,
          c_custkey % 3 <> 1 AS active, c_custkey % 4 = 1 AS prospect, c_custkey % 89 = 0 AS deleted,
          CASE WHEN c_custkey % 2 = 0 THEN 'North Lab' ELSE 'South Lab' END AS lab_name,
          CASE WHEN c_custkey % 7 = 0 THEN NULL WHEN c_custkey % 5 = 0 THEN bal ELSE 0 END AS past_due_30,
          CASE WHEN c_custkey % 7 = 1 THEN NULL WHEN c_custkey % 5 = 1 THEN bal ELSE 0 END AS past_due_60,
          CASE WHEN c_custkey % 7 = 2 THEN NULL WHEN c_custkey % 5 = 2 THEN bal ELSE 0 END AS past_due_90,
          CASE WHEN c_custkey % 7 = 3 THEN NULL WHEN c_custkey % 5 = 3 THEN bal ELSE 0 END AS past_due_over_90,
          bal AS current_balance, CAST(bal * 2 AS DECIMAL(18,2)) AS total_balance,
          CASE WHEN c_custkey % 9 <> 0 THEN CAST(c_custkey % 30 AS DECIMAL(18,2)) END AS unapplied_payments,
          CAST(c_custkey % 8 AS DECIMAL(18,2)) AS unapplied_credits,
          CASE WHEN c_custkey % 5 <> 0 THEN CAST(c_custkey % 70 AS DECIMAL(18,2)) END AS this_period_charges,
          CAST(c_custkey % 500 AS DECIMAL(18,2)) AS last_payment_amount,
          c_custkey % 10 = 0 AS is_on_cod, c_custkey % 6 = 0 AS on_credit_hold, c_custkey % 4 = 0 AS in_collection
        FROM (SELECT *, CAST(c_acctbal AS DECIMAL(18,2)) AS bal,
            '555-' || lpad(CAST(c_custkey * 7 % 10000 AS VARCHAR), 4, '0') AS phone, c_custkey || ' Main Street' AS street FROM customer) c
          LEFT JOIN nation ON n_nationkey = c_nationkey LEFT JOIN region ON r_regionkey = n_regionkey""",
    "sales_summary": """
        SELECT CAST(o_custkey AS VARCHAR) AS customer_id,
          sum(CASE WHEN o_orderdate >= DATE '1998-06-01' THEN amt END) AS mtd_sales,
          sum(CASE WHEN o_orderdate >= DATE '1998-05-01' AND o_orderdate < DATE '1998-06-01' THEN amt END) AS lm_sales,
          sum(CASE WHEN o_orderdate >= DATE '1998-01-01' THEN amt END) AS ytd_sales,
          sum(CASE WHEN o_orderdate >= DATE '1997-01-01' AND o_orderdate < DATE '1998-01-01' THEN amt END) AS ly_sales,
          sum(amt) AS ltd_sales
        FROM (SELECT *, CAST(o_totalprice AS DECIMAL(18,2)) AS amt FROM orders) o
        WHERE CAST(o_orderdate AS DATE) <= DATE '1998-06-15' GROUP BY o_custkey""",
    "call_notes": """
        SELECT conv_id * 1000 + turn AS call_id, text AS note,
          CAST(DATE '1998-01-01' + CAST(conv_id % 160 AS INTEGER) AS DATE) AS call_date,
          CASE role WHEN 'user' THEN (conv_id % 90) || '.0' WHEN 'assistant' THEN role END AS user_id
        FROM conversations""",
    "case_calls": """
        SELECT conv_id * 1000 + turn AS call_id,
          CASE WHEN conv_id % 6 <> 0 THEN conv_id * 5 + turn END AS anchor_case_id,
          CASE WHEN conv_id % 4 <> 0 THEN conv_id * 3 END AS link_case_id
        FROM conversations""",
    "goals": """
        SELECT DISTINCT year(o_orderdate) AS year, month(o_orderdate) AS month,
          CAST(month(o_orderdate) * 100000 + 5000000 AS DECIMAL(18,2)) AS revenue_goal
        FROM orders WHERE year(o_orderdate) <> 1996""",
    # -- shared intermediate results --------------------------------------------------------------
    "numbered_cases": """
        SELECT * REPLACE (CASE WHEN case_id % 3 = 0 THEN 'S' || (case_id % 40) ELSE case_number END AS case_number) FROM cases""",
    "numbered": """
        SELECT c.*, v.description AS location FROM numbered_cases c
          LEFT JOIN supplier s ON s.s_suppkey = c.last_location_id LEFT JOIN v_location v ON v.id = s.s_nationkey""",
    "open_number": """
        SELECT * FROM (
          SELECT l.*, t.task, t.complete_date, t.department, row_number() OVER (PARTITION BY l.case_number
            ORDER BY t.complete_date DESC NULLS LAST, l.case_id DESC, t.case_product_id DESC, t.part_id DESC, t.source_id DESC) AS rn
          FROM numbered l JOIN case_tasks t ON t.case_id = l.case_id WHERE l.status = 'In Production') x WHERE rn = 1""",
    "best_of_number": """
        SELECT case_number, category FROM (
          SELECT l.case_number, p.category, row_number() OVER (
            PARTITION BY l.case_number ORDER BY coalesce(v.pos, 99), p.category DESC) AS rn
          FROM numbered_cases l JOIN case_products cp ON cp.case_id = l.case_id JOIN products p ON p.product_id = cp.product_id
            LEFT JOIN v_priority v ON p.category LIKE v.pattern
          WHERE p.category IS NOT NULL AND l.status = 'In Production') x WHERE rn = 1""",
    "located": """
        SELECT c.*, v.description AS location FROM cases c
          LEFT JOIN supplier s ON s.s_suppkey = c.last_location_id LEFT JOIN v_location v ON v.id = s.s_nationkey""",
    "best_category": """
        SELECT case_id, category FROM (
          SELECT cp.case_id, p.category, row_number() OVER (
            PARTITION BY cp.case_id ORDER BY coalesce(v.pos, 99), p.category DESC) AS rn
          FROM case_products cp JOIN products p ON p.product_id = cp.product_id
            LEFT JOIN v_priority v ON p.category LIKE v.pattern
          WHERE p.category IS NOT NULL) x WHERE rn = 1""",
    "latest_task": """
        SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY complete_date DESC NULLS LAST,
            case_product_id DESC, part_id DESC, source_id DESC) AS rn FROM case_tasks) x WHERE rn = 1""",
    "case_list": """
        SELECT *, CASE WHEN upper(trim(pan_number)) LIKE 'R%' AND length(trim(pan_number)) < 4
                  THEN true ELSE false END AS is_rush,
          ship_date = DATE '1998-06-15' AS leaves_today,
          ship_date < DATE '1998-06-15' AND ship_date >= DATE '1998-06-10' OR
            (ship_date = DATE '1998-06-15' AND upper(trim(pan_number)) LIKE 'R%'
             AND length(trim(pan_number)) < 4) AS is_overdue_or_earlier,
          ship_date = DATE '1998-06-11' OR (ship_date = DATE '1998-06-15'
             AND upper(trim(pan_number)) LIKE 'R%' AND length(trim(pan_number)) < 4) AS is_overdue
        FROM (
          SELECT case_id, case_number, pan_number, CAST(ship_date AS DATE) AS ship_date,
            CAST(due_date AS DATE) AS due_date, status, category,
            coalesce(a.label, location) AS location, last_task, last_scan, local_delivery
          FROM (
            SELECT l.case_id, l.case_number, l.pan_number, l.ship_date, l.due_date, l.status, l.location,
              CASE WHEN lower(b.category) LIKE '%expander%' THEN 'E² Expanders'
                WHEN b.category IN ('Airway', 'Marpe') THEN 'MARPE' WHEN b.category = 'Lab to lab' THEN 'Lab to Lab'
                WHEN b.category IS NULL OR trim(b.category) = '' THEN 'Other' ELSE trim(b.category) END AS category,
              l.task AS last_task, l.complete_date AS last_scan, l.local_delivery
            FROM open_number l LEFT JOIN best_of_number b ON b.case_number = l.case_number
            WHERE l.ship_date >= TIMESTAMP '1998-06-10') y
          LEFT JOIN v_alias a ON a.raw = y.location
          WHERE NOT (category = 'MARPE' AND location IS NOT NULL AND location IN (SELECT location FROM v_planning))
        ) z""",
    "workload_rows": """
        SELECT w.* FROM (
          SELECT l.case_id, l.case_number, l.pan_number, l.status, l.local_delivery, l.location,
            CAST(l.ship_date AS DATE) AS orig_ship_date, CAST(l.due_date AS DATE) AS due_date,
            CASE WHEN upper(trim(l.pan_number)) LIKE 'R%' AND length(trim(l.pan_number)) < 4
                 THEN c.prev_bd ELSE CAST(l.ship_date AS DATE) END AS ship_date,
            CASE WHEN k.category IS NULL OR trim(k.category) = '' THEN 'Other'
              WHEN lower(k.category) LIKE '%expander%' THEN 'E² Expanders'
              WHEN k.category = 'Accessories' THEN 'Other' WHEN k.category = 'Marpe' THEN 'MARPE'
              WHEN k.category = 'Lab to lab' THEN 'Lab to Lab' ELSE trim(k.category) END AS category
          FROM numbered l JOIN cal c ON c.d = CAST(l.ship_date AS DATE)
            JOIN (
              SELECT case_id, category FROM (
                SELECT n.case_id, p.category, row_number() OVER (PARTITION BY n.case_number, CAST(n.ship_date AS DATE)
                  ORDER BY coalesce(v.pos, 99), p.category DESC, n.case_id DESC) AS rn
                FROM numbered_cases n JOIN case_products cp ON cp.case_id = n.case_id
                  JOIN products p ON p.product_id = cp.product_id
                  LEFT JOIN v_priority v ON p.category LIKE v.pattern
                WHERE p.category <> 'Airway' AND n.status IN ('In Production', 'Invoiced')) x WHERE rn = 1
              UNION ALL
              SELECT case_id, NULL FROM cases WHERE NOT EXISTS (
                SELECT 1 FROM case_products cp JOIN products p ON p.product_id = cp.product_id
                WHERE cp.case_id = cases.case_id)) k ON k.case_id = l.case_id
          WHERE l.status IN ('In Production', 'Invoiced')) w
        WHERE ship_date BETWEEN DATE '1998-06-11' AND DATE '1998-07-26'""",
    "invoiced": """
        SELECT CAST(invoice_date AS DATE) AS day, lab_name, case_id,
          taxable_amount + non_taxable_amount AS amount, sales_discount, remake_discount, total_tax
        FROM cases WHERE NOT deleted AND type = 'D' AND coalesce(is_adjustment, false) = false
          AND invoice_date IS NOT NULL""",
    "remake_pairs": """
        SELECT k.case_id AS main_id, k.link_case_id AS og_id
        FROM case_links k JOIN cases m ON m.case_id = k.case_id JOIN cases o ON o.case_id = k.link_case_id
        WHERE k.notes LIKE '%Remake Of%' AND m.date_in >= TIMESTAMP '1997-06-15' AND m.date_in < TIMESTAMP '1998-06-16'
          AND m.status <> 'Cancelled'""",
    "past_due": """
        SELECT * FROM (SELECT *, coalesce(past_due_30, 0) AS d30, coalesce(past_due_60, 0) AS d60,
            coalesce(past_due_90, 0) AS d90, coalesce(past_due_over_90, 0) AS d90p FROM customers) c
        WHERE NOT deleted AND d90 + d90p > 0 AND coalesce(dental_group, '') <> 'ASIA'""",
    "daily_eff": """
        SELECT t.date, e.employee_id, e.staff_name, e.team, e.training_plan, t.work_hours,
          k.cases_worked_on, k.tasks_completed, k.hours,
          CASE WHEN t.work_hours = 0 THEN 0 ELSE
            CAST(round_even(CAST(k.hours * 10000 AS DOUBLE) / t.work_hours, 0) AS BIGINT) END AS cents
        FROM timesheets t JOIN employees e ON e.payroll_name = t.name
        JOIN (SELECT CAST(h.complete_date AS DATE) AS date, CAST(h.completed_by AS BIGINT) AS employee_id,
                count(DISTINCT h.case_number) AS cases_worked_on, count(*) AS tasks_completed,
                sum(coalesce(p.duration, 0)) AS hours
              FROM task_history h LEFT JOIN planned p ON p.case_id = h.case_id AND p.task = h.task
                AND p.case_product_id = h.case_product_id
              WHERE h.rejected = 'No' GROUP BY 1, 2) k
          ON k.date = t.date AND k.employee_id = e.employee_id""",
}


def with_views(sql: str) -> str:
    """Prefix a query with the views it needs, in dependency order."""
    views = {**_fixed(), **VIEWS}
    order: list[str] = []
    seen: set[str] = set()

    def visit(text: str) -> None:
        for name in views:
            if name not in seen and re.search(rf"\b{name}\b", text):
                seen.add(name)
                visit(views[name])
                order.append(name)

    visit(sql)
    if not order:
        return sql.strip()
    head = ",\n".join(f"{name} AS ({views[name].strip()})" for name in order)
    body = sql.strip()
    if body.upper().startswith("WITH "):
        return f"WITH {head},\n{body[5:]}"
    return f"WITH {head}\n{body}"
