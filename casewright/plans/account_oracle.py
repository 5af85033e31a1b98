"""Oracle SQL for remakes, receivables, customers, stores and mirrors."""

_RATE = """
  SELECT cu.practice_name, count(ca.case_id) AS cases,
    count(CASE WHEN nullif(trim(ca.remake), '') IS NOT NULL THEN 1 END) AS remakes
  FROM cases ca JOIN customers cu ON cu.customer_id = ca.customer_id
  WHERE ca.invoice_date >= TIMESTAMP '1998-03-16' AND ca.invoice_date < TIMESTAMP '1998-06-16'
  GROUP BY cu.practice_name"""
_BOOK = """
  SELECT c.customer_id, practice_name, coalesce(first_name, '') || ' ' || coalesce(last_name, '') AS full_name,
    sales_person, dental_group, type, specialty, city, state, price_catalog, first_name, last_name, referred_by,
    email, office_phone, cell, fax, address1, address2, zip_code, country, bill_contact, bill_email, bill_phone,
    bill_address1, bill_address2, bill_city, bill_state, bill_zip_code, bill_country,
    CAST(coalesce(mtd_sales, 0) AS DOUBLE) AS mtd_sales, CAST(coalesce(lm_sales, 0) AS DOUBLE) AS lm_sales,
    CAST(coalesce(ytd_sales, 0) AS DOUBLE) AS ytd_sales, CAST(coalesce(ly_sales, 0) AS DOUBLE) AS ly_sales,
    CAST(coalesce(ltd_sales, 0) AS DOUBLE) AS ltd_sales, date_of_first_case, date_of_last_case, active, prospect
  FROM customers c LEFT JOIN sales_summary s ON s.customer_id = c.customer_id
  LEFT JOIN (SELECT CAST(o_custkey AS VARCHAR) AS customer_id, CAST(min(o_orderdate) AS DATE) AS date_of_first_case,
      CAST(max(o_orderdate) AS DATE) AS date_of_last_case FROM orders GROUP BY 1) d ON d.customer_id = c.customer_id
  WHERE NOT deleted"""
_OPEN = """
  SELECT customer_id, case_id, case_number, patient_first, patient_last, status,
    CAST(due_date AS DATE) AS due_date, CAST(date_in AS DATE) AS date_entered
  FROM cases WHERE status IN ('In Production', 'On Hold') AND NOT deleted
    AND customer_id IN (SELECT customer_id FROM past_due)"""
_SECTIONED = f"""
  SELECT p.*, CASE WHEN dental_group = 'AMERICA' THEN 'named group' WHEN d90 + d90p >= 500 THEN 'general'
      ELSE 'small' END AS section, d30 + d60 + d90 + d90p AS total_past_due,
    (SELECT count(*) FROM ({_OPEN}) o WHERE o.customer_id = p.customer_id AND o.status = 'In Production') AS open_cases,
    (SELECT count(*) FROM ({_OPEN}) o WHERE o.customer_id = p.customer_id AND o.status = 'On Hold') AS on_hold
  FROM past_due p"""


def _currency(value: str) -> str:
    return f"""CASE WHEN {value} >= 1000000 THEN '$' || printf('%.1f', CAST({value} / 1000000 AS DOUBLE)) || 'M'
      WHEN {value} >= 1000 THEN '$' || printf('%.0f', CAST({value} / 1000 AS DOUBLE)) || 'K'
      ELSE '$' || printf('%.0f', CAST({value} AS DOUBLE)) END"""


_STATS = f"""count(*) AS n, CAST(sum(d30) AS DOUBLE) AS past_due_30, CAST(sum(d60) AS DOUBLE) AS past_due_60,
  CAST(sum(d90) AS DOUBLE) AS past_due_90, CAST(sum(d90p) AS DOUBLE) AS past_due_over_90,
  CAST(sum(total_past_due) AS DOUBLE) AS total_past_due, CAST(sum(total_balance) AS DOUBLE) AS total_balance,
  {_currency("sum(total_past_due)")} AS total_text"""

ORACLE = {
    "remakes": f"""
        SELECT m.case_id AS main_case_id, o.case_id AS og_case_id, m.case_number, o.case_number AS og_case_number,
          CAST(m.date_in AS DATE) AS date_in, CAST(m.ship_date AS DATE) AS ship_date,
          CAST(o.ship_date AS DATE) AS og_ship_date, CAST(o.due_date AS DATE) AS og_due_date,
          CAST(m.total_charge AS DOUBLE) AS total_charge, m.remake, m.remake_reason,
          CAST(m.remake_discount AS DOUBLE) AS remake_discount, m.status, o.customer_id AS og_customer_id,
          o.work_order_notes AS og_work_order_notes, c.practice_name, c.sales_person,
          coalesce(r.cases, 0) AS cases, coalesce(r.remakes, 0) AS remakes, t.description AS product
        FROM remake_pairs k JOIN cases m ON m.case_id = k.main_id JOIN cases o ON o.case_id = k.og_id
          JOIN customers c ON c.customer_id = m.customer_id
          LEFT JOIN ({_RATE}) r ON r.practice_name = c.practice_name
          LEFT JOIN (SELECT cp.case_id, p.description, row_number() OVER (PARTITION BY cp.case_id
              ORDER BY cp.unit_price DESC, cp.case_product_id DESC, cp.product_id DESC, cp.source_id DESC,
                cp.line_date DESC) AS rn
            FROM case_products cp JOIN products p ON p.product_id = cp.product_id
            WHERE p.description NOT LIKE '%Rush%') t ON t.case_id = o.case_id AND t.rn = 1""",
    "remakes_meeting": """
        SELECT k.main_id AS main_case_id, k.og_id AS og_case_id, m.remake
        FROM remake_pairs k JOIN cases m ON m.case_id = k.main_id WHERE m.remake IS DISTINCT FROM 'Remake'""",
    "practice_remake_rate": _RATE,
    "remake_tasks": """
        SELECT case_id, task, completed_by, CAST(complete_date AS DATE) AS complete_date FROM task_history
        WHERE case_id IN (SELECT main_id FROM remake_pairs UNION SELECT og_id FROM remake_pairs)""",
    "remake_notes": """
        WITH ids AS (SELECT main_id AS id FROM remake_pairs UNION SELECT og_id FROM remake_pairs)
        SELECT n.call_id, n.note, n.call_date, n.user_id, k.anchor_case_id, k.link_case_id,
          coalesce(e.staff_name, trim(n.user_id), '') AS user_name
        FROM call_notes n JOIN case_calls k ON k.call_id = n.call_id
          LEFT JOIN employees e ON e.employee_id = CAST(try_cast(n.user_id AS DOUBLE) AS BIGINT)
        WHERE k.anchor_case_id IN (SELECT id FROM ids) OR k.link_case_id IN (SELECT id FROM ids)""",
    "case_details": """
        SELECT h.case_id, h.task, h.completed_by, h.complete_date, k.main_id AS main_case_id, 'main' AS side
        FROM remake_pairs k JOIN task_history h ON h.case_id = k.main_id
        UNION ALL
        SELECT h.case_id, h.task, h.completed_by, h.complete_date, k.main_id, 'og'
        FROM remake_pairs k JOIN task_history h ON h.case_id = k.og_id""",
    "documents_exploded": """
        WITH d AS (SELECT doc_id AS case_id, doc_id % 6 AS shape, CAST(doc_id AS VARCHAR) AS t FROM documents
          WHERE doc_id % 50 <> 0),
        f AS (SELECT case_id, shape, t, unnest(CASE shape
            WHEN 0 THEN ['doc_' || t || '.pdf']
            WHEN 1 THEN ['upper ' || t || '.stl', 'lower.jpeg', 'photo one.png']
            WHEN 2 THEN ['plan' || t, 'notes', 'sketch'] WHEN 3 THEN ['link']
            WHEN 4 THEN ['scan a' || t || '.ply', 'b.ply']
            ELSE ['scan a' || t || '.ply b.ply'] END) AS file_name,
          unnest(range(0, CASE shape WHEN 1 THEN 3 WHEN 2 THEN 3 WHEN 4 THEN 2 ELSE 1 END)) AS file_no FROM d)
        SELECT case_id, CASE shape WHEN 0 THEN 'CaseDocuments/Feb/24/doc_' || t || '.pdf'
            WHEN 1 THEN 'DigitalImpressions/' || t || '/Upload_1/' || file_name
            WHEN 2 THEN 'Designs/' || t || '/' || file_name WHEN 3 THEN 'https://host.example/' || t
            WHEN 4 THEN 'modelscans/' || t || '/' || file_name
            ELSE 'Archive/modelscans/' || t || '/' || file_name END AS file_path,
          CASE shape WHEN 0 THEN 'CaseDocuments' WHEN 1 THEN 'Digital Impression' WHEN 2 THEN 'Design'
            WHEN 4 THEN 'Model Scan' WHEN 5 THEN 'Archive' END AS repository,
          shape = 3 AS is_url, CAST(CASE shape WHEN 1 THEN 3 WHEN 2 THEN 3 WHEN 4 THEN 2 WHEN 5 THEN 4 ELSE 1 END AS BIGINT)
            AS file_count, false AS deleted, file_no, file_name FROM f""",
    "preferences": """
        SELECT customer_id, department, preference, preference_value, create_date, preference_id, version FROM (
          SELECT CAST(o_custkey AS VARCHAR) AS customer_id, 'dept' || (o_orderkey % 3) AS department,
            o_orderpriority AS preference, CAST(o_orderkey AS VARCHAR) AS preference_value,
            o_orderdate AS create_date, o_orderkey AS preference_id,
            row_number() OVER (PARTITION BY o_custkey, o_orderkey % 3
              ORDER BY o_orderdate DESC, o_orderkey DESC) AS version FROM orders) x""",
    "past_due_accounts": """
        SELECT lab_name, customer_id, practice_name, dental_group,
          coalesce(first_name, '') || ' ' || coalesce(last_name, '') AS full_name, sales_person,
          office_phone, bill_email, last_payment_date,
          CAST(last_payment_amount AS DOUBLE) AS last_payment_amount,
          CAST(coalesce(unapplied_payments, 0) + coalesce(unapplied_credits, 0) AS DOUBLE) AS unapplied,
          CAST(coalesce(this_period_charges, 0) AS DOUBLE) AS this_period,
          CAST(current_balance AS DOUBLE) AS current_balance, CAST(d30 AS DOUBLE) AS past_due_30,
          CAST(d60 AS DOUBLE) AS past_due_60, CAST(d90 AS DOUBLE) AS past_due_90,
          CAST(d90p AS DOUBLE) AS past_due_over_90, CAST(d30 + d60 + d90 + d90p AS DOUBLE) AS total_past_due,
          CAST(total_balance AS DOUBLE) AS total_balance,
          CASE WHEN is_on_cod THEN 'COD' WHEN on_credit_hold THEN 'Credit Hold'
            WHEN in_collection THEN 'In Collection' ELSE '' END AS account_flag
        FROM past_due""",
    "open_cases_past_due": _OPEN,
    "collections_sections": f"""
        SELECT customer_id, section, open_cases, on_hold, CAST(total_past_due AS DOUBLE) AS total_past_due
        FROM ({_SECTIONED}) s""",
    "section_stats": f"""
        WITH s AS ({_SECTIONED})
        SELECT section, {_STATS} FROM s GROUP BY section
        UNION ALL SELECT 'overall', {_STATS} FROM s""",
    "collections_summary": f"""
        SELECT count(*) AS accounts, CAST(coalesce(sum(open_cases), 0) AS BIGINT) AS open_cases,
          CAST(sum(d90) AS DOUBLE) AS past_due_90, CAST(sum(d90p) AS DOUBLE) AS past_due_over_90
        FROM ({_SECTIONED}) s""",
    "cases_by_customer": f"""
        SELECT *, count(*) OVER (PARTITION BY customer_id) AS total,
          CAST(ceil(count(*) OVER (PARTITION BY customer_id) / 3.0) AS BIGINT) AS pages FROM ({_OPEN}) o""",
    "customers": _BOOK,
    "filter_customers": f"""
        SELECT customer_id, practice_name, price_catalog FROM ({_BOOK}) b
        WHERE active AND NOT prospect AND type = 'BUILDING' AND lower(price_catalog) LIKE '%catalog 2%'""",
    "customers_by_mail": f"""
        SELECT customer_id, email FROM ({_BOOK}) b WHERE lower(email) LIKE '%front1%' OR lower(bill_email) LIKE '%front1%'""",
    "customer_metrics": f"""
        SELECT count(*) FILTER (WHERE active AND NOT prospect) AS active,
          count(*) FILTER (WHERE prospect AND NOT active) AS prospects,
          count(*) FILTER (WHERE date_trunc('month', date_of_first_case) = DATE '1998-06-01') AS new_this_month,
          count(*) FILTER (WHERE year(date_of_first_case) = 1998) AS new_this_year,
          CAST(coalesce(sum(CAST(ytd_sales AS DECIMAL(18,2))) FILTER (WHERE year(date_of_first_case) = 1998), 0) AS DOUBLE)
            AS new_sales,
          {_currency("coalesce(sum(CAST(ytd_sales AS DECIMAL(18,2))) FILTER (WHERE year(date_of_first_case) = 1998), 0)")}
            AS new_sales_text
        FROM ({_BOOK}) b""",
    "filter_options": f"""
        WITH b AS ({_BOOK})
        SELECT DISTINCT * FROM (
          SELECT 'sales_person' AS "column", sales_person AS value FROM b
          UNION ALL SELECT 'dental_group', dental_group FROM b UNION ALL SELECT 'type', type FROM b
          UNION ALL SELECT 'specialty', specialty FROM b UNION ALL SELECT 'state', state FROM b
          UNION ALL SELECT 'city', city FROM b UNION ALL SELECT 'price_catalog', price_catalog FROM b) x
        WHERE trim(value) <> ''""",
    "natural_sort_page": f"""
        WITH b AS ({_BOOK}),
        o AS (SELECT customer_id, practice_name, row_number() OVER (
            ORDER BY CAST(substr(practice_name, 10) AS BIGINT), CAST(customer_id AS BIGINT)) AS r FROM b)
        SELECT customer_id, practice_name, (SELECT count(*) FROM b) AS total, r - 100 AS position
        FROM o WHERE r BETWEEN 101 AND 200""",
    "mixed_sort_page": f"""
        WITH b AS (SELECT customer_id, CASE CAST(customer_id AS BIGINT) % 3 WHEN 0 THEN CAST(date_of_first_case AS VARCHAR)
            WHEN 1 THEN customer_id || ' units' ELSE practice_name END AS shown FROM ({_BOOK}) x),
        o AS (SELECT customer_id, shown, row_number() OVER (ORDER BY
            CASE WHEN shown LIKE '____-__-__' THEN 0 WHEN shown LIKE '% units' THEN 1 ELSE 2 END,
            CASE WHEN shown LIKE '% units' THEN CAST(customer_id AS BIGINT) END, coalesce(shown, ''), customer_id) AS r FROM b)
        SELECT customer_id, shown, r AS position FROM o""",
    "business_calendar": """
        SELECT x.day, x.day IN (SELECT d FROM bday) AS is_business, p.d AS previous,
          (SELECT d FROM bday WHERE n = p.n + CASE WHEN x.day IN (SELECT d FROM bday) THEN 2 ELSE 1 END) AS next_1,
          (SELECT d FROM bday WHERE n = p.n + CASE WHEN x.day IN (SELECT d FROM bday) THEN 3 ELSE 2 END) AS next_2,
          (SELECT d FROM bday WHERE n = p.n - 4) AS ago_5, (SELECT d FROM bday WHERE n = p.n - 249) AS ago_250,
          (SELECT d FROM (SELECT d, row_number() OVER (ORDER BY d) AS k FROM all_days WHERE isodow(d) < 6) w
           WHERE k = (SELECT count(*) - 5 FROM all_days v WHERE isodow(v.d) < 6 AND v.d <= x.day)) AS weekday_6,
          x.day - CAST(isodow(x.day) - 1 AS INTEGER) AS week_monday, least(x.day, x.day - CAST(isodow(x.day) - 5 AS INTEGER)) AS week_friday,
          x.day - CAST(isodow(x.day) + 6 AS INTEGER) AS last_monday, x.day - CAST(isodow(x.day) + 2 AS INTEGER) AS last_friday,
          CAST(date_trunc('month', x.day) - INTERVAL 2 MONTH AS DATE) AS month_first,
          CAST(date_trunc('month', x.day) - INTERVAL 1 MONTH AS DATE) - 1 AS month_last
        FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders) x ASOF LEFT JOIN bday p ON x.day > p.d""",
    "holiday_rules": """
        WITH f AS (
          SELECT o_totalprice, CAST(o_orderdate AS DATE) AS d, CASE strftime(o_orderdate, '%m-%d')
            WHEN '01-01' THEN 'New Year''s Day' WHEN '01-02' THEN 'Day After New Year''s'
            WHEN '07-04' THEN 'Independence Day' WHEN '11-11' THEN 'Veterans Day'
            WHEN '12-25' THEN 'Christmas Day' WHEN '12-26' THEN 'Day After Christmas' END AS fixed FROM orders),
        n AS (SELECT *, CASE WHEN fixed IS NOT NULL THEN fixed
            WHEN d NOT IN (SELECT d FROM rule_holiday) THEN NULL WHEN month(d) = 5 THEN 'Memorial Day'
            WHEN month(d) = 9 THEN 'Labor Day' WHEN isodow(d) = 4 THEN 'Thanksgiving'
            ELSE 'Day After Thanksgiving' END AS holiday FROM f)
        SELECT holiday, count(*) AS orders, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS amount
        FROM n WHERE holiday IS NOT NULL GROUP BY holiday""",
    "upsert_customers": """
        WITH c AS (SELECT *, CAST(customer_id AS BIGINT) AS k FROM customers WHERE NOT deleted)
        SELECT customer_id AS customer_code, coalesce(practice_name, '') AS practice_name, address1 AS address_line1,
          address2 AS address_line2, city, CASE WHEN length(trim(state)) BETWEEN 1 AND 2 THEN state END AS state,
          zip_code AS zip, office_phone AS phone, email, coalesce(active, true) AS is_active,
          CASE WHEN k % 9 = 0 OR (k % 4 = 0 AND office_phone <> '555-0000') OR (k % 7 = 0 AND address2 IS NOT NULL)
              OR (k % 10 = 3 AND email IS NOT NULL)
            THEN TIMESTAMP '1998-06-15 02:00:00' ELSE TIMESTAMP '1998-05-16 02:00:00' END AS updated_at
        FROM c""",
    "upsert_cases": """
        WITH live AS (SELECT * FROM cases WHERE NOT deleted AND date_in <= TIMESTAMP '1998-06-15'),
        fresh AS (SELECT * FROM live WHERE date_in >= TIMESTAMP '1997-12-17'),
        stale AS (SELECT * FROM live WHERE date_in >= TIMESTAMP '1997-06-15' AND date_in < TIMESTAMP '1998-05-16 02:00:00'),
        every AS (SELECT case_id FROM fresh UNION SELECT case_id FROM stale),
        flags AS (SELECT case_id, case_id IN (SELECT case_id FROM fresh) AS is_fresh,
          case_id IN (SELECT case_id FROM stale) AS is_stale FROM every)
        SELECT case_number, coalesce(trim(remake), '') <> '' AS is_remake, remake_reason, pan_number,
          CAST(due_date AS DATE) AS due_date, CAST(date_in AS DATE) AS received_date,
          CAST(invoice_date AS DATE) AS invoice_date, CAST(ship_date AS DATE) AS ship_date,
          CAST(total_charge + CASE WHEN NOT is_fresh AND case_id % 4 = 0 THEN 1 ELSE 0 END AS DOUBLE) AS invoice_amount,
          work_order_notes AS notes,
          customer_id IN (SELECT customer_id FROM customers WHERE NOT deleted) AS has_customer,
          status <> 'Cancelled' AS has_status,
          CASE WHEN is_fresh AND (NOT is_stale OR case_id % 4 = 0) THEN TIMESTAMP '1998-06-15 02:00:00'
               ELSE TIMESTAMP '1998-05-16 02:00:00' END AS updated_at
        FROM live JOIN flags USING (case_id)""",
    "replace_children": """
        WITH touched AS (SELECT case_id FROM cases WHERE NOT deleted AND date_in >= TIMESTAMP '1997-12-17'
          AND date_in < TIMESTAMP '1998-06-16')
        SELECT t.case_id, CASE WHEN k.case_id IS NULL THEN 'old' ELSE t.task END AS task_name,
          t.complete_date AS completed_at
        FROM case_tasks t JOIN cases c ON c.case_id = t.case_id LEFT JOIN touched k ON k.case_id = t.case_id
        WHERE c.date_in <= TIMESTAMP '1998-06-15'""",
    "orphan_children": """
        SELECT c.case_number, t.task AS task_name, t.complete_date AS completed_at
        FROM case_tasks t JOIN cases c ON c.case_id = t.case_id WHERE c.deleted""",
    "history_children": """
        SELECT CASE WHEN rejected = 'Yes' THEN 'Rejected' ELSE 'Completed' END AS action,
          completed_by IN (SELECT CAST(employee_id AS VARCHAR) FROM employees WHERE team IS NOT NULL) AS known,
          count(*) AS n, max(complete_date) AS newest
        FROM task_history GROUP BY 1, 2""",
    "apply_edits": """
        WITH e AS (SELECT CAST(user_id * 11 AS VARCHAR) AS customer_id, ts, event_id,
            CASE event_type WHEN 'click' THEN json_extract_string(props, '$.k') WHEN 'error' THEN '' END AS outcome,
            CASE event_type WHEN 'view' THEN CAST(value AS VARCHAR) END AS notes,
            CASE event_type WHEN 'purchase' THEN true WHEN 'signup' THEN false END AS completed FROM events),
        last_ AS (SELECT customer_id, max(ts) AS ts,
            max_by(outcome, ts) FILTER (WHERE outcome IS NOT NULL) AS outcome,
            max_by(notes, ts) FILTER (WHERE notes IS NOT NULL) AS notes,
            max_by(completed, ts) FILTER (WHERE completed IS NOT NULL) AS completed FROM e GROUP BY 1)
        SELECT coalesce(c.customer_id, l.customer_id) AS customer_id,
          coalesce(l.outcome, CASE WHEN c.customer_id IS NOT NULL THEN 'first call' ELSE '' END) AS outcome,
          coalesce(l.notes, c.seg, '') AS notes, coalesce(l.completed, false) AS completed,
          coalesce(l.ts, TIMESTAMP '2023-12-31') AS last_updated
        FROM (SELECT CAST(c_custkey AS VARCHAR) AS customer_id, c_mktsegment AS seg FROM customer) c
          FULL JOIN last_ l ON l.customer_id = c.customer_id""",
    "fold_duplicates": """
        SELECT source || '/' || lang AS shelf,
          (array_agg(text ORDER BY length(text) DESC, encode(text) DESC))[1] AS text,
          bool_or(doc_id % 10 = 3) AS marked, max(doc_id) AS doc_id
        FROM documents GROUP BY 1""",
    "dataset_profile": """
        SELECT 'orders' AS name, count(*) AS n, max(o_orderdate) AS newest FROM orders
        UNION ALL SELECT 'lines', count(*), max(l_shipdate) FROM lineitem
        UNION ALL SELECT 'events', count(*), max(ts) FROM events
        UNION ALL SELECT 'customers', count(*), NULL FROM customer
        UNION ALL SELECT 'documents', count(*), NULL FROM documents""",
    "rename_reapply": """
        SELECT date, employee_id,
          CASE WHEN employee_id % 2 = 0 THEN 'New ' || staff_name ELSE staff_name END AS staff_name,
          CASE WHEN team IS NULL AND staff_name IN ('Given11 Mid Family11', 'Given33 Mid Family33') THEN 'z_Not On Report'
            WHEN team IS NULL THEN '0' WHEN employee_id % 4 = 0 THEN team WHEN team = 'BUILDING' THEN 'Bricks'
            WHEN team = 'MACHINERY' THEN 'Engines' ELSE team END AS team,
          CAST(CASE WHEN employee_id % 2 = 0 THEN 9 ELSE training_plan END AS BIGINT) AS training_plan
        FROM daily_eff""",
}
