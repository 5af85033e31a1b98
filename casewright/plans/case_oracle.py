"""Oracle SQL for the case, workload and sales queries."""

from casewright import vocabulary as V

_DAYS = [f"DATE '1998-06-11' + {k}" for k in range(46)]


def _day_sums(value: str) -> str:
    return ", ".join(
        f"CAST(coalesce(sum(CASE WHEN ship_date = {day} THEN {value} END), 0) AS BIGINT) AS day_{k:02d}"
        for k, day in enumerate(_DAYS)
    )


_CATEGORY_RANK = "CAST(coalesce((SELECT pos FROM v_workload_order o WHERE o.category = x.category), 9) AS BIGINT)"
_PACE = """
  invoiced + in_production AS total,
  round_even(CASE WHEN invoiced + in_production = 0 THEN 0.0
    ELSE invoiced * CAST(100.0 AS DOUBLE) / (invoiced + in_production) END, 1) AS pct,
  CASE WHEN invoiced + in_production = 0 OR invoiced * 100.0 / (invoiced + in_production) <= 25.05 THEN 'red'
    WHEN invoiced * 100.0 / (invoiced + in_production) <= 50.05 THEN 'orange'
    WHEN invoiced * 100.0 / (invoiced + in_production) <= 75.05 THEN 'yellow' ELSE 'green' END AS tier,
  strftime(ship_date, '%a %b %d') AS label"""
_STATUS_COUNTS = """
  SELECT status, d AS ship_date, count(*) AS n FROM (
    SELECT status, CASE WHEN pan_number LIKE 'R%' AND length(pan_number) < 4 THEN prev_bd
                        ELSE CAST(ship_date AS DATE) END AS d
    FROM cases JOIN cal ON cal.d = CAST(ship_date AS DATE)
    WHERE status IN ('In Production', 'Invoiced')) s
  WHERE d BETWEEN DATE '1998-06-11' AND DATE '1998-07-26' GROUP BY status, d"""
_BOTH = """
  CAST(coalesce(sum(n) FILTER (WHERE status = 'Invoiced'), 0) AS BIGINT) AS invoiced,
  CAST(coalesce(sum(n) FILTER (WHERE status = 'In Production'), 0) AS BIGINT) AS in_production"""
_GOAL_BAND = """CASE WHEN pct IS NULL THEN 'no data' WHEN pct >= 110 THEN 'dark green'
  WHEN pct >= 100 THEN 'green' WHEN pct >= 90 THEN 'amber' ELSE 'red' END AS goal_band"""
_MONTHLY = """
  SELECT year(day) AS y, month(day) AS m, count(*) AS n, sum(amount) AS subtotal FROM invoiced
  WHERE day >= DATE '1996-11-01' AND day < DATE '1998-07-01' GROUP BY 1, 2"""

_AIRWAY = """
  SELECT l.customer_id, l.doctor_name, c.practice_name, l.location,
    CASE WHEN l.pan_number LIKE 'R%' AND length(l.pan_number) < 4 THEN cal.prev_bd
         ELSE CAST(l.ship_date AS DATE) END AS ship_date,
    l.case_number, l.pan_number, CAST(l.create_date AS DATE) AS create_date, l.status,
    l.task AS last_task, l.complete_date AS last_scan
  FROM (
      SELECT n.*, t.task, t.complete_date, row_number() OVER (PARTITION BY n.case_number ORDER BY t.complete_date DESC NULLS LAST,
        n.case_id DESC, t.case_product_id DESC NULLS LAST, t.part_id DESC NULLS LAST, t.source_id DESC NULLS LAST) AS rn
      FROM numbered n LEFT JOIN case_tasks t ON t.case_id = n.case_id) l
    JOIN v_stage s ON s.location = l.location
    JOIN cal ON cal.d = CAST(l.ship_date AS DATE)
    LEFT JOIN customers c ON c.customer_id = l.customer_id
  WHERE rn = 1 AND l.status IN ('In Production', 'On Hold')"""

ORACLE = {
    "open_case_list": """
        SELECT case_id, case_number, pan_number, ship_date, due_date, status, category, location,
          last_task, last_scan, local_delivery FROM case_list""",
    "open_case_list_by_dept": """
        SELECT l.case_id, l.case_number, l.pan_number, CAST(l.ship_date AS DATE) AS ship_date, l.status,
          l.department AS category, l.location, l.task AS last_task, l.complete_date AS last_scan,
          l.local_delivery
        FROM open_number l""",
    "case_flags": """
        SELECT case_number, pan_number, ship_date, is_rush, leaves_today, is_overdue FROM case_list""",
    "filter_cases": """
        SELECT case_number, pan_number, ship_date, category, location FROM case_list
        WHERE is_rush AND (upper(case_number) LIKE '%R1%' OR upper(pan_number) LIKE '%R1%')""",
    "case_badges": """
        SELECT count(*) AS all_cases, count(*) FILTER (WHERE is_rush) AS rush,
          count(*) FILTER (WHERE is_overdue) AS overdue,
          count(*) FILTER (WHERE location IS NULL OR trim(location) = '') AS nowhere,
          count(*) FILTER (WHERE category = 'Metal') AS metal,
          count(*) FILTER (WHERE month(ship_date) = 7 AND day(ship_date) = 4) AS on_july_4,
          count(*) FILTER (WHERE regexp_matches(case_number, '^1.*7$')
            OR regexp_matches(pan_number, '^1.*7$')) AS pattern
        FROM case_list""",
    "case_filter_options": """
        SELECT 'location' AS "column", location AS value FROM case_list WHERE trim(location) <> ''
        UNION SELECT 'category', category FROM case_list
        UNION SELECT 'ship_day', month(ship_date) || '/' || day(ship_date) FROM case_list""",
    "airway_workflow": _AIRWAY,
    "airway_workflow_by_location": f"SELECT * FROM ({_AIRWAY}) a WHERE location = '{next(iter(V.STAGE_GROUPS.values()))[0]}'",
    "airway_workflow_by_day": f"SELECT * FROM ({_AIRWAY}) a WHERE ship_date = DATE '1998-06-15'",
    "location_summary": """
        SELECT location, category, n, location_total,
          CASE WHEN location = 'No Location' THEN 24 ELSE
            coalesce((SELECT pos FROM v_location_order o WHERE o.location = t.location), 23) END::BIGINT AS location_rank,
          n * CAST(360.0 AS DOUBLE) / location_total AS degrees,
          CASE WHEN location_total < 15 THEN 'low' WHEN location_total < 50 THEN 'medium' ELSE 'high' END AS load_tier
        FROM (SELECT location, category, n, CAST(sum(n) OVER (PARTITION BY location) AS BIGINT) AS location_total
              FROM (SELECT coalesce(nullif(trim(location), ''), 'No Location') AS location, category, count(*) AS n
                    FROM case_list GROUP BY 1, 2) g) t""",
    "stage_summary": """
        SELECT s.stage_group, s.location, coalesce(t.total, 0) AS total,
          greatest(coalesce(t.dates, 0) - 6, 0) AS extra_dates, coalesce(g.r, 0) AS date_rank,
          g.ship_date, coalesce(g.n, 0) AS n
        FROM v_stage s
        LEFT JOIN (SELECT location, count(*) AS total, count(DISTINCT CAST(ship_date AS DATE)) AS dates
                   FROM located WHERE status IN ('In Production', 'On Hold') GROUP BY 1) t USING (location)
        LEFT JOIN (SELECT location, CAST(ship_date AS DATE) AS ship_date, count(*) AS n,
                     row_number() OVER (PARTITION BY location ORDER BY CAST(ship_date AS DATE)) AS r
                   FROM located WHERE status IN ('In Production', 'On Hold') GROUP BY 1, 2) g
          ON g.location = s.location AND g.r <= 6""",
    "local_delivery": """
        SELECT case_number, ship_date, leaves_today AS ships_today FROM case_list WHERE local_delivery""",
    "overdue_no_scan": """
        SELECT case_number, ship_date, location, last_scan FROM case_list
        WHERE is_overdue_or_earlier AND (last_scan IS NULL OR last_scan < TIMESTAMP '1998-06-15 08:00:00')
          AND (location IS NULL OR (location <> 'QC' AND location NOT IN (SELECT location FROM v_planning)))""",
    "submitted_cases": """
        SELECT case_number, pan_number,
          CASE WHEN pan_number LIKE 'R%' AND length(pan_number) < 4 THEN prev_bd
               ELSE CAST(ship_date AS DATE) END AS ship_date, status, location,
          row_number() OVER (ORDER BY CASE WHEN pan_number LIKE 'R%' AND length(pan_number) < 4 THEN prev_bd
               ELSE CAST(ship_date AS DATE) END, case_number) AS position
        FROM located JOIN cal ON cal.d = CAST(ship_date AS DATE)
        WHERE status = 'Submitted' AND NOT deleted""",
    "hold_list": """
        WITH held AS (SELECT * FROM located WHERE status = 'On Hold' AND trim(pan_number) LIKE '7%'
            AND hold_status <> 'Customer Request'),
        pairs AS (SELECT case_id,
            unnest(regexp_extract_all(hold_reason, '(?i)\\(?(AFU|ZFU|EFU)\\)?\\s*(\\d{1,2})/(\\d{1,2})', 2)) AS m,
            unnest(regexp_extract_all(hold_reason, '(?i)\\(?(AFU|ZFU|EFU)\\)?\\s*(\\d{1,2})/(\\d{1,2})', 3)) AS dd
          FROM held),
        options AS (SELECT case_id, m, dd,
            try_cast(y || '-' || lpad(m, 2, '0') || '-' || lpad(dd, 2, '0') AS DATE) AS d
          FROM pairs CROSS JOIN (VALUES (1997), (1998), (1999)) years(y)),
        scored AS (SELECT case_id, m, dd, d, date_diff('day', DATE '1998-06-15', d) AS ahead FROM options
          WHERE d IS NOT NULL),
        best AS (SELECT case_id, m, dd, d, row_number() OVER (PARTITION BY case_id, m, dd
            ORDER BY CASE WHEN ahead <= 0 THEN -ahead - 30 ELSE ahead END, d) AS rn
          FROM scored WHERE ahead <= 180 AND ahead >= -365),
        follow AS (SELECT case_id, max(d) AS d FROM best WHERE rn = 1 GROUP BY case_id)
        SELECT h.case_number, h.pan_number, h.doctor_name, c.practice_name,
          coalesce(h.patient_first, '') || ' ' || coalesce(h.patient_last, '') AS patient_name,
          CAST(h.create_date AS DATE) AS create_date, CAST(h.ship_date AS DATE) AS ship_date,
          CAST(h.hold_date AS DATE) AS hold_date, h.hold_status, h.hold_reason,
          CASE WHEN hold_reason LIKE '%(AFU)%' THEN 'AFU' WHEN hold_reason LIKE '%(ZFU)%' THEN 'ZFU'
               WHEN hold_reason LIKE '%(EFU)%' THEN 'EFU' END AS follow_up_type,
          f.d AS follow_up_date,
          CAST(CASE WHEN hold_reason LIKE '%(_FU)%' THEN 0 ELSE 1 END AS BIGINT) AS type_rank,
          row_number() OVER (ORDER BY CASE WHEN hold_reason LIKE '%(_FU)%' THEN 0 ELSE 1 END, f.d NULLS LAST, h.case_number)
            AS position
        FROM held h LEFT JOIN customers c ON c.customer_id = h.customer_id
          LEFT JOIN follow f ON f.case_id = h.case_id""",
    "hold_status_counts": """
        SELECT hold_status, count(*) AS n FROM cases WHERE status = 'On Hold' AND hold_status IN
          ('Production, Waiting on Scan', 'Airway, How to Proceed', 'Email Plan,Waiting on Approval',
          'Zoom Plan, Waiting on Approval')
        GROUP BY hold_status""",
    "workload_status": _STATUS_COUNTS,
    "workload_pivot": f"""
        SELECT category, status, ship_date, n, {_CATEGORY_RANK} AS category_rank
        FROM (SELECT category, status, ship_date, count(*) AS n FROM workload_rows GROUP BY ALL) x""",
    "uncategorised_cases": """
        SELECT case_number, status, CAST(ship_date AS DATE) AS ship_date FROM cases
        WHERE case_id NOT IN (SELECT cp.case_id FROM case_products cp JOIN products USING (product_id))""",
    "workload_chart": f"""
        SELECT ship_date, {_BOTH}, strftime(ship_date, '%a %b %d') AS label
        FROM ({_STATUS_COUNTS}) s GROUP BY ship_date""",
    "workload_pace": f"""
        SELECT ship_date, invoiced, in_production, {_PACE}
        FROM (SELECT ship_date, {_BOTH} FROM ({_STATUS_COUNTS}) s GROUP BY ship_date
              ORDER BY ship_date LIMIT 6) t""",
    "category_pace": f"""
        WITH counted AS (SELECT category, status, ship_date, count(*) AS n FROM workload_rows GROUP BY ALL),
        first_dates AS (SELECT DISTINCT ship_date FROM counted ORDER BY ship_date LIMIT 6),
        grid AS (SELECT k.category, f.ship_date,
            CAST(coalesce(sum(c.n) FILTER (WHERE c.status = 'Invoiced'), 0) AS BIGINT) AS invoiced,
            CAST(coalesce(sum(c.n) FILTER (WHERE c.status = 'In Production'), 0) AS BIGINT) AS in_production
          FROM (SELECT DISTINCT category FROM counted) k CROSS JOIN first_dates f
          LEFT JOIN counted c ON c.category = k.category AND c.ship_date = f.ship_date GROUP BY ALL)
        SELECT category, ship_date, invoiced, in_production, {_PACE}, {_CATEGORY_RANK} AS category_rank
        FROM grid x""",
    "workload_matrix": f"""
        WITH shown AS (SELECT category, ship_date, count(*) AS n FROM workload_rows
          WHERE status = 'In Production' GROUP BY ALL)
        SELECT category, {_day_sums("n")}, {_CATEGORY_RANK} AS category_rank FROM shown x GROUP BY category
        UNION ALL
        SELECT 'TOTAL', {_day_sums("n")}, 10 FROM shown""",
    "pivot_margins": f"""
        WITH shown AS (SELECT * FROM workload_rows)
        SELECT category, {_day_sums("1")}, count(*) AS total FROM shown GROUP BY category
        UNION ALL SELECT 'TOTAL', {_day_sums("1")}, count(*) FROM shown""",
    "workload_summary": f"""
        SELECT invoiced, in_production, submitted, design, manufacturing, production_floor,
          round_even(CASE WHEN invoiced + in_production = 0 THEN 0.0
            ELSE invoiced * CAST(100.0 AS DOUBLE) / (invoiced + in_production) END, 0) AS pace_pct
        FROM (SELECT {_BOTH} FROM ({_STATUS_COUNTS}) s) a
        CROSS JOIN (SELECT count(*) AS submitted FROM cases WHERE status = 'Submitted' AND NOT deleted) b
        CROSS JOIN (SELECT count(*) FILTER (WHERE location IN ('Design Cart', '3D Design')) AS design,
            count(*) FILTER (WHERE location IN ('3D Manufacturing', 'Oven', 'Tumbler')) AS manufacturing,
            count(*) FILTER (WHERE location IN ('Metal Shelf', 'Metal Finish', 'Metal Polishing', 'Banding',
              'Metal Bending', 'Welding', 'Marpe', 'Wire Bending', 'Acrylic', 'Wire Finishing/Polishing',
              'Essix Shelf', 'QC', 'Production Floor Desk')) AS production_floor FROM case_list) c""",
    "workload_by_category": """
        SELECT p.category, CAST(c.ship_date AS DATE) AS ship_date, count(DISTINCT c.case_number) AS n
        FROM cases c JOIN case_products cp ON cp.case_id = c.case_id
          JOIN products p ON p.product_id = cp.product_id
        WHERE c.status = 'In Production' AND p.category IS NOT NULL GROUP BY 1, 2""",
    "gemba_grid": """
        SELECT loc.location, d.ship_date, CAST(d.day_rank AS BIGINT) AS day_rank, count(c.case_id) AS total,
          count(*) FILTER (WHERE c.is_rush) AS rush,
          count(*) FILTER (WHERE c.category = 'Hybrid') AS category_1,
          count(*) FILTER (WHERE c.category = 'E² Expanders') AS category_2,
          count(*) FILTER (WHERE c.category = 'Lab to Lab') AS category_3,
          count(*) FILTER (WHERE c.category = 'MARPE') AS category_4,
          count(*) FILTER (WHERE c.category = 'Metal') AS category_5,
          count(*) FILTER (WHERE c.category = 'Clear') AS category_6,
          count(*) FILTER (WHERE c.category = 'Wire Bending') AS category_7,
          count(*) FILTER (WHERE c.category = 'Other') AS category_8
        FROM (VALUES ('3D Manufacturing'), ('Oven'), ('Tumbler')) loc(location)
        CROSS JOIN (VALUES (DATE '1998-06-11', 0), (DATE '1998-06-15', 1), (DATE '1998-06-16', 2),
                           (DATE '1998-06-17', 3)) d(ship_date, day_rank)
        LEFT JOIN case_list c ON c.location = loc.location AND c.ship_date = d.ship_date
        GROUP BY loc.location, d.ship_date, d.day_rank""",
    "pace_cases": """
        SELECT case_id, case_number, pan_number, status, local_delivery, location, ship_date,
          orig_ship_date, due_date, category
        FROM workload_rows WHERE status = 'In Production' AND ship_date = DATE '1998-06-17'""",
    "daily_sales": """
        SELECT day AS sales_date, lab_name, 'I' AS type, count(*) AS n, CAST(sum(amount) AS DOUBLE) AS subtotal,
          CAST(sum(sales_discount) AS DOUBLE) AS discount, CAST(sum(remake_discount) AS DOUBLE) AS remake_discount,
          CAST(sum(total_tax) AS DOUBLE) AS tax, CAST(0 AS DOUBLE) AS new_units, CAST(0 AS DOUBLE) AS remake_units
        FROM invoiced WHERE day BETWEEN DATE '1998-05-11' AND DATE '1998-06-15' GROUP BY 1, 2
        UNION ALL
        SELECT CAST(c.date_in AS DATE), c.lab_name, 'S', count(DISTINCT c.case_id),
          CAST(sum(CASE WHEN coalesce(cp.remake, '') = '' THEN cp.extended_amount ELSE 0 END) AS DOUBLE),
          CAST(sum(cp.sales_discount) AS DOUBLE), CAST(sum(cp.remake_discount) AS DOUBLE), 0,
          CAST(sum(CASE WHEN coalesce(cp.remake, '') = '' THEN cp.quantity * p.unit_value ELSE 0 END) AS DOUBLE),
          CAST(sum(CASE WHEN coalesce(cp.remake, '') <> '' THEN cp.quantity * p.unit_value ELSE 0 END) AS DOUBLE)
        FROM case_products cp LEFT JOIN cases c ON c.case_id = cp.case_id
          LEFT JOIN products p ON p.product_id = cp.product_id
        WHERE c.type = 'D' AND NOT c.deleted AND c.date_in >= TIMESTAMP '1998-05-11'
          AND c.date_in < TIMESTAMP '1998-06-16' AND c.status NOT IN ('Cancelled', 'Submitted', 'Sent for TryIn')
        GROUP BY 1, 2""",
    "monthly_sales": f"""
        SELECT y AS sales_year, m AS sales_month, n, CAST(subtotal AS DOUBLE) AS subtotal FROM ({_MONTHLY}) x""",
    "revenue_by_day": """
        SELECT CAST(invoice_date AS DATE) AS invoice_date,
          CAST(sum(taxable_amount + non_taxable_amount) AS DOUBLE) AS revenue
        FROM cases WHERE NOT deleted AND type = 'D' AND status NOT IN ('Cancelled', 'Submitted')
          AND invoice_date >= TIMESTAMP '1997-06-15' AND invoice_date < TIMESTAMP '1998-06-16' GROUP BY 1""",
    "monthly_trend": f"""
        WITH months AS (SELECT CAST(unnest(generate_series(TIMESTAMP '1996-12-01', TIMESTAMP '1998-06-01',
            INTERVAL 1 MONTH)) AS DATE) AS month),
        series AS (SELECT month, coalesce(subtotal, 0) AS subtotal FROM months
          LEFT JOIN ({_MONTHLY}) x ON x.y = year(month) AND x.m = month(month))
        SELECT a.month, CAST(a.subtotal AS DOUBLE) AS subtotal,
          (SELECT CASE WHEN count(*) = 3 THEN CAST(sum(b.subtotal) AS DOUBLE) / 3 END FROM series b
           WHERE CASE WHEN a.month = DATE '1998-06-01'
                 THEN b.month >= a.month - INTERVAL 3 MONTH AND b.month < a.month
                 ELSE b.month > a.month - INTERVAL 3 MONTH AND b.month <= a.month END) AS trend,
          a.month = DATE '1998-06-01' AS is_current, strftime(a.month, '%b ''%y') AS label
        FROM series a WHERE a.month > DATE '1996-12-01'""",
    "daily_trend": """
        WITH days AS (SELECT CAST(unnest(generate_series(TIMESTAMP '1998-05-17', TIMESTAMP '1998-06-15',
            INTERVAL 1 DAY)) AS DATE) AS d),
        series AS (SELECT d, coalesce(sum(amount), 0) AS v FROM days LEFT JOIN invoiced ON day = d GROUP BY d)
        SELECT s.d AS sales_date, CAST(s.v AS DOUBLE) AS subtotal,
          (SELECT CASE WHEN count(*) = 5 THEN CAST(sum(v) AS DOUBLE) / 5 END FROM (
             SELECT b.v FROM series b WHERE isodow(b.d) < 6
               AND (b.d < s.d OR (b.d = s.d AND s.d < DATE '1998-06-15'))
             ORDER BY b.d DESC LIMIT 5) t) AS trend,
          s.d = DATE '1998-06-15' AS is_today, strftime(s.d, '%d %b %y') AS label
        FROM series s""",
    "sales_history": """
        SELECT day AS sales_date, count(*) AS n, CAST(sum(amount) AS DOUBLE) AS subtotal,
          strftime(day, '%a %b %d') AS label
        FROM invoiced JOIN bday ON bday.d = day
        WHERE day BETWEEN DATE '1998-05-11' AND DATE '1998-06-15' GROUP BY day ORDER BY day DESC LIMIT 5""",
    "monthly_goals": f"""
        SELECT month, actual, goal, pct, {_GOAL_BAND} FROM (
          SELECT month, CAST(subtotal AS DOUBLE) AS actual, CAST(coalesce(revenue_goal, 0) AS DOUBLE) AS goal,
            CASE WHEN revenue_goal > 0 THEN CAST(subtotal AS DOUBLE) / CAST(revenue_goal AS DOUBLE) * 100 END AS pct
          FROM (SELECT CAST(unnest(range(1, 13)) AS BIGINT) AS month) s
          LEFT JOIN (SELECT m, subtotal FROM ({_MONTHLY}) x WHERE y = 1998 AND m <= 6) a ON a.m = s.month
          LEFT JOIN (SELECT month AS gm, revenue_goal FROM goals WHERE year = 1998) g ON g.gm = s.month) t""",
    "annual_goals": f"""
        SELECT year, actual, goal, label, pct, {_GOAL_BAND} FROM (
          SELECT s.year, CAST(coalesce(a.amount, 0) AS DOUBLE) AS actual, CAST(coalesce(g.goal, 0) AS DOUBLE) AS goal,
            s.year || CASE WHEN s.year = 1998 THEN ' (YTD)' ELSE '' END AS label,
            CASE WHEN g.goal > 0 THEN CAST(coalesce(a.amount, 0) AS DOUBLE) / CAST(g.goal AS DOUBLE) * 100 END AS pct
          FROM (SELECT CAST(unnest(range(1994, 1999)) AS BIGINT) AS year) s
          LEFT JOIN (SELECT year(day) AS year, sum(amount) AS amount FROM invoiced GROUP BY 1) a USING (year)
          LEFT JOIN (SELECT year, sum(revenue_goal) AS goal FROM goals GROUP BY 1) g USING (year)) t""",
}
